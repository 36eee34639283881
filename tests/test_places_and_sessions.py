"""Places of words, fragments, sessions and kept days against plain versions."""

from __future__ import annotations

import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.values import running_sums
from corpusloom.operators import positions, rollups
from corpusloom.streaming import sessions

WORD = r"[^\W_]"


def texts():
    r = random.Random(1)
    text = lambda n: "".join(r.choice(["foo", "Bar", "é1", "x", "baz"]) + r.choice([" ", ", ", "\n\n", "_", "😀 "]) for _ in range(n))
    return [(0, None), (1, ""), (2, "--- "), (3, "x"), (4, " Ärger und"), (5, "f" * 300 + " x")] + [(i, r.choice(["", "  "]) + text(r.choice([1, 5, 50, 400]))) for i in range(6, 40)]


def plain_fragments(t, terms, size, number):
    t = t or ""
    occ = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(f"{WORD}+", t) if m.group().lower() in terms]
    cands = []
    for k, (a, z, _) in enumerate(occ):
        own = [o for o in occ[k:] if o[1] <= max(a + size, z)]
        end = max(o[1] for o in own)
        first = max(0, a - max(0, size - (end - a)) // 2)
        cands.append((-len({o[2] for o in own}), -len(own), first, max(first + size, end)))
    out = []
    while cands and len(out) < number:
        _, _, first, last = min(cands)
        cands = [c for c in cands if c[3] <= first or c[2] >= last]
        lo, hi = first, min(last, len(t))
        if first > 0 and re.match(WORD, t[first - 1]):
            while lo < len(t) and re.match(WORD, t[lo]):
                lo += 1
        if last < len(t) and re.match(WORD, t[last]):
            while hi > lo and re.match(WORD, t[hi - 1]):
                hi -= 1
        piece, at = "", lo
        for a, z, _ in occ:
            if a >= lo and z <= hi:
                piece, at = piece + t[at:a] + "<em>" + t[a:z] + "</em>", z
        out.append((piece + t[at:hi]).strip(" \t\r\n"))
    return out


def test_running_sums(spark):
    for n in (0, 1, 2, 7, 1000):
        got = spark.range(1).select(running_sums(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x) if n else F.array().cast("array<int>")).alias("s")).first()["s"]
        assert got == [k * (k + 1) // 2 for k in range(n)]


def test_places_are_offsets_of_words(spark):
    got: dict = {}
    for q in positions.places(spark.createDataFrame(texts(), "doc_id long, text string"), ["text"]).collect():
        got.setdefault(q.doc_id, []).append((q["at"], q["token"], q["start"], q["stop"]))
    for i, t in texts():
        assert sorted(got.get(i, [])) == [(k, m.group().lower(), m.start(), m.end()) for k, m in enumerate(re.finditer(f"{WORD}+", t or ""))]


@pytest.mark.parametrize("size, number", [(100, 5), (30, 3), (4, 2)])
def test_fragments_from_written_places(spark, tmp_path, size, number):
    docs = spark.createDataFrame([(i, t, "foo") for i, t in texts()], "doc_id long, text string, token string")
    positions.write_places(docs, ["text"], str(tmp_path / "p"), buckets=4, tasks_a_bucket=2)
    found = positions.read_places(spark, str(tmp_path / "p"), ["foo", "x", "f" * 300, "none"])
    got = {q.doc_id: q.fragments for q in positions.field_fragments(docs, found, ["text"], size, number).collect()}
    want = {i: plain_fragments(t, {"foo", "x", "f" * 300}, size, number) for i, t in texts()}
    assert got == {i: w for i, w in want.items() if w}
    hits = spark.createDataFrame([(7, 1.0), (9, 0.5), (0, 0.1)], "doc_id long, _score double")
    shown = positions.hit_fragments(docs, hits, str(tmp_path / "p"), ["foo", "x"], ["text"], size, number).collect()
    assert {q.doc_id: q.fragments for q in shown} == {i: w for i, t in texts() if i in (7, 9, 0) and (w := plain_fragments(t, {"foo", "x"}, size, number))}


def test_no_texts_no_places(spark, tmp_path):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    positions.write_places(docs, ["text"], str(tmp_path / "p"))
    assert positions.read_places(spark, str(tmp_path / "p"), ["x"]).count() == 0 and positions.read_places(spark, str(tmp_path / "p"), []).count() == 0


EVENT = "run_id string, seq long, at_time timestamp, kind string, target_url string"
T0 = datetime(2024, 1, 1)


def run_events():
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [("a", 0, at(0), "started", "http://x"), ("a", 1, at(100), "page", None), ("a", 2, at(150), "finished", None)]
    rows += [("b", 3, at(10), "started", "http://error"), ("b", 4, at(20), "finished", None), ("c", 5, at(30), "started", "http://c"), ("c", 6, at(900), "page", None), ("d", 7, at(880), "page", None)]
    return rows + [("z", 8, at(1300), "started", "http://z"), ("z", 9, at(1310), "finished", None)]


def states(df):
    return sorted((r["run_id"], (r["session_start"] - T0).seconds, (r["session_end"] - T0).seconds, r["pages"], r["status"], r["error_message"]) for r in df.collect())


def test_a_silent_run_fails(spark):
    e = spark.createDataFrame(run_events(), EVENT)
    got = states(sessions.ended(sessions.run_sessions(e, 300), e, "60 seconds"))
    assert got == [("a", 0, 450, 1, "complete", None), ("b", 10, 320, 0, "failed", "crawl failed: http://error"), ("c", 30, 330, 0, "failed", "silent for 300 seconds"), ("c", 900, 1200, 1, "failed", "silent for 300 seconds"), ("d", 880, 1180, 1, "failed", "silent for 300 seconds")]
    assert sessions.ended(sessions.run_sessions(e.limit(0), 300), e.limit(0), "60 seconds").count() == 0


def test_a_filter_on_the_end_keeps_sessions_whole(spark):
    e = spark.createDataFrame([("a", 0, T0, "page", None), ("a", 1, T0 + timedelta(seconds=200), "page", None)], EVENT)
    late = T0 + timedelta(seconds=400)
    assert sessions.run_sessions(e, 300).where(F.col("session_end") <= F.lit(late)).count() == 0, "the session ends at 500"


def test_the_stream_emits_each_ended_session_once(spark, tmp_path):
    for k, part in enumerate([run_events()[:5], run_events()[5:8], run_events()[8:]]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    e = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = sessions.run_sessions(e, 300, late="60 seconds")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    all_ = spark.createDataFrame(run_events(), EVENT)
    assert states(spark.read.parquet(str(tmp_path / "out"))) == states(sessions.ended(sessions.run_sessions(all_, 300), all_, "60 seconds"))


def test_days_are_counted_again_without_change_and_add_up(spark, tmp_path):
    r = random.Random(3)
    rows = [(datetime(2024, 1, 1 + r.randint(0, 3), 5), r.choice([None, 1, 2, 40_000, 10**9]), r.choice(["a", "b", None])) for _ in range(300)]
    e, path = spark.createDataFrame(rows, "ts timestamp, who long, kind string"), str(tmp_path / "days")
    for part in (e, e.where("ts < '2024-01-02'"), e.where("ts >= '2024-01-03'")):
        rollups.keep(rollups.by_day(part, ["kind"], "who"), path)
    got = {(q["kind"], q["level"]): (q["events"], q["distinct"]) for q in rollups.cube(rollups.kept(spark, path, "2024-01-02", "2024-01-03"), [["kind"], []]).collect()}
    inside = [(w, k) for t, w, k in rows if date(2024, 1, 2) <= t.date() <= date(2024, 1, 3)]
    count = lambda own: (len(own), len({w for w, _ in own} - {None}))
    assert got == {(None, 1): count(inside)} | {(k, 0): count([x for x in inside if x[1] == k]) for k in ("a", "b", None)}
    with pytest.raises(LookupError):
        rollups.kept(spark, str(tmp_path / "none"))
