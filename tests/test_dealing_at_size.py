"""Work that grows with the input is dealt over tasks and not sent through the driver or left to one of them."""

from __future__ import annotations

import json
from glob import glob

import pytest

from pyspark.sql import functions as F

from corpusloom.operators import frontier, positions, search
from corpusloom.sources import ranges
from corpusloom.streaming import jobs


@pytest.fixture
def small_parts(spark):
    """Partitions of a few bytes, so that small tables stand for large ones."""
    names = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_frequent_words_bucket_is_written_by_many_tasks(spark, tmp_path, small_parts):
    docs = spark.createDataFrame([(i, "foo " * 50 + f"x{i}") for i in range(2000)], "doc_id long, text string").repartition(16)
    positions.write_places(docs, ["text"], str(tmp_path / "p"), buckets=2, tasks_a_bucket=1)
    assert max(len(glob(f"{tmp_path}/p/places/bucket={b}/*.parquet")) for b in (0, 1)) > 2
    assert positions.read_places(spark, str(tmp_path / "p"), ["foo"]).count() == 100_000
    search.write_index(docs, ["text"], str(tmp_path / "i"), buckets=2, tasks_a_bucket=1)
    assert max(len(glob(f"{tmp_path}/i/postings/bucket={b}/*.parquet")) for b in (0, 1)) > 2
    assert search.Index.read(spark, str(tmp_path / "i")).of_terms(["foo"]).count() == 2000


def test_canonical_groups_send_no_table_to_all_tasks(spark, monkeypatch):
    plans, cut = [], frontier.cut
    monkeypatch.setattr(frontier, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    links = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(40)] + [("a", "b"), ("b", "a")], "url string, target string")
    got = {r["url"]: (r["canonical"], r["hops"], r["loop"]) for r in frontier.canonical_groups(links).collect()}
    assert got["u0"] == ("u40", 40, False) and got["b"] == ("a", None, True)
    assert "Broadcast" not in "".join(plans) and "SortMergeJoin" in "".join(plans)


def test_many_files_shapes_are_walked_by_many_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i}.json").write_text(json.dumps({"hits": {"hits": [{"_id": f"{i}/{k}", "_source": {"text": "{[" * k}} for k in range(5)]}}) if i % 7 else "{")
    files = spark.createDataFrame([(f"file:{tmp_path}/{i}.json", i, (tmp_path / f"{i}.json").stat().st_size) for i in range(60)], "path string, nr long, length long")
    places = ranges.located(files, "UTF-8", 64)
    assert len(places.inputFiles()) > 4
    assert {r["path"].rpartition("/")[2] for r in places.where("error is not null").collect()} == {f"{i}.json" for i in range(0, 60, 7)}
    found = ranges.hit_texts(places, "UTF-8").collect()
    assert sorted(json.loads(r["json"])["_id"] for r in found) == sorted(f"{i}/{k}" for i in range(60) if i % 7 for k in range(5))


def test_streamed_states_move_what_they_look_at(spark, tmp_path):
    schema = "run_id string, seq long, at double, kind string, target_url string, page struct<id:string>"
    rows = [("a", 1, 5.0, "started", "http://b", None), ("a", 2, 4.0, "started", "http://a/error", None), ("a", 3, 6.0, "page", None, ("p",)), ("b", 4, 7.0, "finished", None, None), ("c", 5, None, "started", None, None)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "e"))
    states = jobs.streamed_states(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e")))
    plan = states._jdf.queryExecution().analyzed().toString()
    assert plan.index("FlatMapGroupsInPandasWithState") < plan.index("Project [run_id") < plan.index("page#"), "pages stay behind"
    out, table = str(tmp_path / "o"), jobs.job_states(spark.read.schema(schema).parquet(str(tmp_path / "e"))).drop("error_message")
    keep = lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)
    states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("run_id").agg(F.max_by(F.struct("target_url", "status", "progress", "num_pages_indexed", "started_at"), "batch").alias("s")).select("run_id", "s.*")
    assert sorted(map(repr, last.collect())) == sorted(map(repr, table.collect()))
