"""Crawl jobs as events: the same state from a table or a stream, looked up, listed and parsed from logs.

Events: run_id, seq, at (epoch seconds), kind (started, page, finished), target_url, page (a page row).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.filters import simulated_failure
from corpusloom.plans.lineage import cut, exists, list_paths, read_text, write_text
from corpusloom.schema import JOB_STATES, READABLE_JOB_STATES


def started(requests: DataFrame) -> DataFrame:
    """Requests (target_url) as pending jobs with a new run_id and the time."""
    return requests.select(F.expr("uuid()").alias("run_id"), "target_url", F.lit("pending").alias("status"), F.lit(0).alias("progress"), F.unix_timestamp().cast("double").alias("started_at"), F.lit(None).cast("string").alias("error_message"))


def progress_events(pages: DataFrame, order: list[str]) -> DataFrame:
    """Pages (run_id and the order) with the percent done after each.

    Pages are counted in two steps, within chunks of a run and over the chunks, so that a large run is not one task's work. The
    chunks are cut: both steps have to see the same ones.
    """
    n = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = cut(pages.repartitionByRange(n, "run_id", *order).withColumn("_part", F.spark_partition_id()))
    d = d.withColumn("_in", F.row_number().over(Window.partitionBy("run_id", "_part").orderBy(*order)))
    run = Window.partitionBy("_run")
    chunk = d.groupBy(F.col("run_id").alias("_run"), F.col("_part").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    before = chunk.select("_run", "_at", (F.sum("_n").over(run.orderBy("_at")) - F.col("_n")).alias("_before"), F.sum("_n").over(run).alias("_all"))
    done = F.col("_before") + F.col("_in")
    return d.join(before, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("_part") == F.col("_at"))).select(*pages.columns, (done * 100 / F.col("_all")).cast("int").alias("progress"))


def status_of(target_url: Column, finished: Column, pages: Column) -> Column:
    return F.when(finished, F.when(simulated_failure(target_url), "failed").otherwise("complete")).when(pages > 0, "running").otherwise("pending")


def job_states(events: DataFrame, total: int = 10, with_results: bool = False) -> DataFrame:
    """State of each run from its events: (run_id, target_url, status, progress, num_pages_indexed, started_at, error_message[, results]).

    Works on a table and, with an output mode of update or complete, on a stream: it is one aggregation.
    ``with_results`` gathers a run's pages into one row, as a response for a small run has them; page_results() gives them as rows.
    """
    pages = F.count(F.when(F.col("kind") == "page", 1))
    agg = [F.max(F.when(F.col("kind") == "started", F.col("target_url"))).alias("target_url"), pages.alias("pages"), F.coalesce(F.bool_or(F.col("kind") == "finished"), F.lit(False)).alias("finished"), F.min(F.when(F.col("kind") == "started", F.col("at"))).alias("started_at")]
    if with_results:
        agg.append(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "page", F.struct("seq", "page")))), lambda x: x["page"]).alias("results"))
    s = events.groupBy("run_id").agg(*agg)
    status = status_of(F.col("target_url"), F.col("finished"), F.col("pages"))
    progress = F.least(F.lit(100), (F.col("pages") * 100 / total).cast("int"))
    return s.select("run_id", "target_url", status.alias("status"), progress.alias("progress"), F.col("pages").alias("num_pages_indexed"), "started_at", F.when(status == "failed", F.concat(F.lit("crawl failed: "), "target_url")).alias("error_message"), *(["results"] if with_results else []))


def streamed_states(events: DataFrame, total: int = 10) -> DataFrame:
    """The same states on a stream with state of our own (update mode): one row whenever a run has new events.

    State is a few numbers for each run, whatever the number of its pages.
    """
    out = "run_id string, target_url string, status string, progress int, num_pages_indexed long, started_at double"
    kept = "target_url string, pages long, finished boolean, started_at double"
    names = ["run_id", "target_url", "status", "progress", "num_pages_indexed", "started_at"]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        target, pages, finished, at = state.get if state.exists else (None, 0, False, None)
        for b in batches:
            # plain loops: a run has few events in a batch, for which a column's operations would cost more than they do
            for kind, named, timed in zip(b["kind"].tolist(), b["target_url"].tolist(), b["at"].tolist()):
                if kind == "page":
                    pages += 1
                elif kind == "finished":
                    finished = True
                elif kind == "started":  # of several starts the greatest target and the least time, as of a table
                    if isinstance(named, str) and (target is None or named > target):
                        target = named
                    if timed is not None and timed == timed and (at is None or timed < at):
                        at = timed
        state.update((target, pages, finished, at))
        status = ("failed" if "error" in (target or "") else "complete") if finished else "running" if pages else "pending"
        yield pd.DataFrame([(key[0], target, status, min(100, pages * 100 // total), pages, at)], columns=names, dtype=object)

    # page rows aren't looked at: they'd be shuffled and made Python objects
    return events.select("run_id", "kind", "target_url", "at").groupBy("run_id").applyInPandasWithState(update, out, kept, "update", GroupStateTimeout.NoTimeout)


def job_status(states: DataFrame, run_id: str) -> DataFrame:
    """One row; LookupError for an unknown run."""
    found = states.where(F.col("run_id") == run_id)
    if found.isEmpty():
        raise LookupError(f"no run {run_id}")
    return found


def page_results(events: DataFrame, states: DataFrame) -> DataFrame:
    """(run_id, seq, page) of the runs that are running or complete: rows, whatever the number of a run's pages."""
    # from a table, so that the join can split the events of a run that has many
    readable = cut(states.where(F.col("status").isin(*READABLE_JOB_STATES)).select("run_id"))
    return events.where("kind = 'page'").join(readable, "run_id").select("run_id", "seq", "page")


def job_results(states: DataFrame, run_id: str, events: DataFrame | None = None) -> DataFrame:
    """The page rows of a run that is running or complete; PermissionError in other states, LookupError for an unknown run.

    They come from ``events``, or without these from the results in ``states``.
    """
    found = job_status(states, run_id)
    if found.where(F.col("status").isin(*READABLE_JOB_STATES)).isEmpty():
        raise PermissionError(f"results of {run_id} can't be read in its state")
    if events is not None:
        return events.where((F.col("run_id") == run_id) & (F.col("kind") == "page")).orderBy("seq").select("page.*")
    return found.select(F.explode("results").alias("r")).select("r.*")


def recent_runs(states: DataFrame, most: int = 10) -> DataFrame:
    return states.orderBy(F.desc("started_at"), "run_id").limit(most).select(F.col("target_url").alias("url"), F.col("run_id").alias("runId"), F.col("num_pages_indexed").cast("int").alias("pages"), "status")


def valid_states(states: DataFrame) -> Column:
    return F.col("status").isin(*JOB_STATES) & F.col("progress").between(0, 100)


def parse_log(line: Column) -> list[Column]:
    """Columns time, level, status, method, path, bytes of lines ``HH:mm:ss [LEVEL] key=value ...``; null where absent."""
    value = lambda k: F.nullif(F.regexp_extract(line, rf"(?:^|\s){k}=(\S+)", 1), F.lit(""))
    part = lambda i: F.nullif(F.regexp_extract(line, r"^(\d\d:\d\d:\d\d) \[(\w+)\]", i), F.lit(""))
    return [part(1).alias("time"), part(2).alias("level"), value("status").try_cast("int").alias("status"), value("method").alias("method"), value("path").alias("path"), value("bytes").try_cast("long").alias("bytes")]


def event_counts(events: DataFrame, kind: str = "event") -> DataFrame:
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def commit_once(out: str, ledger: str):
    """A foreachBatch function that commits a batch's rows and its line (batch_id, sent) in the ledger, each once, however often the batch is replayed.

    A batch is a partition of ``out`` that is written as a whole, over what a failed attempt has left; its line is a file named after it, written last. What has no line isn't committed:
    read_committed() reads the batches of the ledger only, so a reader sees all rows of a batch or none.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, line = batch.sparkSession, f"{ledger}/batch-{batch_id}"
        if exists(spark, line):
            return
        at = f"{out}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(at)
        write_text(spark, line, str(spark.read.schema(batch.schema).parquet(at).count()))

    return run


def committed(spark: SparkSession, ledger: str) -> DataFrame:
    """(batch_id, sent) of the ledger."""
    rows = [(int(p.rpartition("-")[2]), int(read_text(spark, p))) for p in list_paths(spark, f"{ledger}/batch-*")]
    return spark.createDataFrame(rows, "batch_id long, sent long")


def read_committed(spark: SparkSession, out: str, ledger: str, schema: str) -> DataFrame:
    """Rows of the committed batches, with batch_id."""
    found = [int(p.rpartition("-")[2]) for p in list_paths(spark, f"{ledger}/batch-*")]
    if not found:
        return spark.createDataFrame([], f"{schema}, batch_id long")
    return spark.read.schema(f"{schema}, batch_id long").option("basePath", out).parquet(*[f"{out}/batch_id={i}" for i in found])
