"""Runs that end by silence: session windows, the same on a table and, with a watermark, on a stream.

On a stream a session's state is a few numbers. The watermark is its timer: when it has passed the last event by the gap, the session is emitted once and its state is dropped. Events that come later
than the watermark allows are dropped by Spark; those of a run that has ended by silence begin another session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.streaming.jobs import status_of


def sessions(events: DataFrame, keys: list[str], gap: str, aggs: list[Column], time: str = "at_time", late: str | None = None) -> DataFrame:
    """(keys, session_start, session_end, aggs): events of equal keys that are at most ``gap`` apart; the end is that of the last event and the gap.

    ``late`` is a stream's watermark. Events without a time belong to none. Spark merges the windows of sorted events of a key as they pass, holding one session at a time; with
    spark.sql.sessionWindow.merge.sessions.in.local.partition it merges them before the shuffle, too, which keeps a key with many events small.
    """
    e = events.withWatermark(time, late) if late else events
    # bounds from the events: the optimizer pushes a filter on the window's own end below the merging, where it would drop a session's last events
    bounds = [F.min(time).alias("session_start"), (F.max(time) + F.expr(f"interval {gap}")).alias("session_end")]
    return e.groupBy(*keys, F.session_window(time, gap)).agg(*bounds, *aggs).drop("session_window")


def run_sessions(events: DataFrame, silent_seconds: int = 600, total: int = 10, late: str | None = None) -> DataFrame:
    """Sessions of runs (events as in jobs.py, with a time ``at_time``): (run_id, session_start, session_end, target_url, pages, progress, status, error_message).

    As a session has ended, a run in it that hasn't finished has failed, with the silence as its error. Write it to a stream in the mode append.
    """
    kind = F.col("kind")
    aggs = [
        F.max(F.when(kind == "started", F.col("target_url"))).alias("target_url"),
        F.count(F.when(kind == "page", 1)).alias("pages"),
        F.coalesce(F.bool_or(kind == "finished"), F.lit(False)).alias("finished"),
    ]
    s = sessions(events, ["run_id"], f"{silent_seconds} seconds", aggs, "at_time", late)
    status = F.when(F.col("finished"), status_of(F.coalesce("target_url", F.lit("")), F.col("finished"), F.col("pages"))).otherwise("failed")
    error = F.when(~F.col("finished"), F.lit(f"silent for {silent_seconds} seconds")).when(status == "failed", F.concat(F.lit("crawl failed: "), "target_url"))
    progress = F.least(F.lit(100), (F.col("pages") * 100 / total).cast("int"))
    return s.select("run_id", "session_start", "session_end", "target_url", "pages", progress.alias("progress"), status.alias("status"), error.alias("error_message"))


def ended(sessions: DataFrame, events: DataFrame, late: str, time: str = "at_time") -> DataFrame:
    """Of a table's sessions those that a stream of the same events would have emitted: their end is at most the greatest time less ``late``."""
    mark = events.agg((F.max(time) - F.expr(f"interval {late}")).alias("_mark")).first()["_mark"]  # one number
    return sessions.where(F.col("session_end") <= F.lit(mark)) if mark is not None else sessions.limit(0)
