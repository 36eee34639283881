from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.sources import exports, files
from corpusloom.streaming import jobs


def envelope(*hits):
    return json.dumps({"hits": {"hits": [{"_id": i, "_source": s} for i, s in hits]}})


def test_exports_are_read_cleaned_and_merged(spark, tmp_path):
    a = tmp_path / "a.json"
    a.write_bytes(b"\xff\xfe" + envelope(("1", {"s365:title": "", "dc:title": "X", "og:description": "d", "collector.depth": "2"}), ("2", {"Content-Location": "http://u", "content": "c"})).encode("utf-16-le"))
    b = tmp_path / "b.json"
    b.write_bytes(envelope(("1", {"s365:title": "newer"})).encode("utf-16-le"))
    bad = tmp_path / "bad.json"
    bad.write_bytes("no json".encode("utf-16-le"))
    hits, errors = exports.read_exports(spark, [str(p) for p in (a, bad, tmp_path / "missing.json", b)])
    assert errors.count() == 1
    clean = exports.clean(hits)
    rows = {(r["_id"], r["title"]): r for r in clean.collect()}
    first = rows["1", "X"]
    assert (first["url"], first["description"], first["content"], first["metadata"]["depth"]) == ("1", "d", "d", "2")
    assert rows["2", "Untitled"]["url"] == "http://u"
    assert {r["_id"]: r["title"] for r in exports.last_wins(clean).collect()} == {"1": "newer", "2": "Untitled"}
    path = str(tmp_path / "index")
    assert exports.create_index(spark, path) and not exports.create_index(spark, path)
    once = sorted(map(str, exports.commit_upserts(clean, path).collect()))
    assert len(once) == 2
    assert sorted(map(str, exports.commit_upserts(clean, path).collect())) == once, "an upsert repeated changes nothing"
    assert exports.read_exports(spark, [str(tmp_path / "none")])[0].count() == 0
    assert exports.health(spark, path) == {"name": spark.sparkContext.appName, "found": True, "version": 2} and not exports.health(spark, str(tmp_path / "none"))["found"]


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path / "index")
    exports.create_index(spark, path)
    schema = exports.read_index(spark, path).schema
    load = lambda i: spark.createDataFrame([{"_id": i, "title": i}], schema).withColumn("load_seq", F.lit(1))
    exports.commit_upserts(load("a"), path)
    reader = exports.read_index(spark, path)
    for n, i in enumerate("bc", 2):
        assert exports.commit_upserts(load(i), path).count() == n
        if n == 2:
            assert [r["_id"] for r in reader.collect()] == ["a"], "a commit changes nothing under a reader"
    (tmp_path / "index" / "version-9").mkdir()
    assert exports.read_index(spark, path).count() == 3, "files of a commit that failed are not read"


def test_reports_and_lines(spark):
    d = spark.createDataFrame([("1", "x", None), ("2", None, None)], "_id string, a string, b string")
    lines = [r["value"] for r in exports.bulk_lines(d, "i").collect()]
    assert lines == ['{"index":{"_index":"i","_id":"1"}}', '{"a":"x"}', '{"index":{"_index":"i","_id":"2"}}', "{}"]
    good, bad = exports.split_rejects(d, F.col("a") == "x")
    assert good.count() == 1 and bad.count() == 1
    assert [r["loaded"] for r in exports.load_report(d, F.col("a") == "x", F.col("_id")).orderBy("batch").collect()] == [1, 0]
    assert [r["load_seq"] for r in exports.numbered(d, "_id").collect()] == [0, 1]


def test_files(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("# c\nhttp://b\n\nhttp://a\n")
    s = files.start_urls(spark, ["http://a"], [str(tmp_path / "seeds.txt")], [lambda sp: sp.createDataFrame([("http://c",)], "url string")])
    assert sorted(r["url"] for r in s.collect()) == ["http://a", "http://b", "http://c"]
    d = spark.createDataFrame([("http://h/a", "x", 200, "c1"), ("http://k/b", "y", 404, "c2")], "url string, html string, status int, crawler_id string")
    files.write_xml(d, str(tmp_path / "xml"))
    assert spark.read.format("xml").option("rowTag", "doc").load(str(tmp_path / "xml")).count() == 2
    files.write_csv(d, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    files.keep_downloads(d, str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).where("host = 'h'").count() == 1
    assert files.url_status(d, "400-499", ["c2"]).count() == 1
    files.write_url_status(d, str(tmp_path), stamp="s")
    assert spark.read.option("header", True).csv(str(tmp_path / "urlstatus-s")).count() == 2
    page = tmp_path / "pages" / "d.https_58_" / "f.www.h_47_x"
    page.parent.mkdir(parents=True)
    page.write_text("<p>é")
    got = files.saved_pages(spark, str(tmp_path / "pages")).select("html", files.saved_url(F.col("path")).alias("u")).first()
    assert (got["html"], got["u"]) == ("<p>é", "https://www.h/x")
    named = spark.createDataFrame([("/c/d.https_www_example_org/f.about-us",), ("/c/d.http_a_b/d.intl/f.de_95_ALL",)], "p string").select(files.saved_url(F.col("p")).alias("u")).collect()
    assert [r["u"] for r in named] == ["https://www.example.org/about-us", "http://a.b/intl/de_ALL"]
    lines = spark.createDataFrame([("HEADER:Server=x",), ("STATUS:200",), ("other",)], "l string").select(files.rendered_header(F.col("l")).alias("h"))
    assert [r["h"] and tuple(r["h"]) for r in lines.collect()] == [("HEADER", "Server", "x"), ("STATUS", None, "200"), None]
    assert spark.range(1).select(files.as_json(F.struct(F.lit(1).alias("a"))).alias("j")).first()["j"] == '{"a":1}'
    assert d.select(urls.host(F.col("url")).alias("h")).distinct().count() == 2


PAGE = "page struct<id:string,path:string,title:string,type:string,size:long>"
EVENTS = f"run_id string, seq long, at double, kind string, target_url string, {PAGE}"


def events(spark):
    page = ("1", "/a", "A", "html", 5)
    rows = [("r1", 0, 5.0, "started", "http://site", None), *[("r1", i, 6.0, "page", None, page) for i in range(1, 11)], ("r1", 11, 9.0, "finished", None, None)]
    rows += [("r2", 0, 7.0, "started", "http://error", None), *[("r2", i, 8.0, "page", None, page) for i in range(1, 11)], ("r2", 11, 9.0, "finished", None, None)]
    rows += [("r3", 0, 8.0, "started", "http://x", None), ("r4", 0, 9.0, "started", "http://y", None), ("r4", 1, 9.5, "page", None, page)]
    return spark.createDataFrame(rows, EVENTS)


def test_job_states(spark):
    s = jobs.job_states(events(spark), with_results=True).cache()
    got = {r["run_id"]: (r["status"], r["progress"], r["num_pages_indexed"]) for r in s.collect()}
    assert got == {"r1": ("complete", 100, 10), "r2": ("failed", 100, 10), "r3": ("pending", 0, 0), "r4": ("running", 10, 1)}
    assert s.where(~jobs.valid_states(s)).count() == 0
    assert jobs.job_results(s, "r1").count() == 10 and jobs.job_results(s, "r4").first()["path"] == "/a"
    for run, error in (("r2", PermissionError), ("r3", PermissionError), ("none", LookupError)):
        with pytest.raises(error):
            jobs.job_results(s, run)
    assert [r["runId"] for r in jobs.recent_runs(s, 2).collect()] == ["r4", "r3"]
    new = jobs.started(spark.createDataFrame([("http://a",)], "target_url string")).first()
    assert new["status"] == "pending" and len(new["run_id"]) == 36


def test_a_run_with_many_pages_is_rows_over_tasks(spark, tmp_path):
    from corpusloom.plans.catalogue import QUERIES

    rows = [(i, 1 if i < 3000 else 2 + i % 7, "view", i) for i in range(4000)] + [(5000, 1, "signup", 0), (5001, 3, "signup", 0), (5002, 3, "purchase", 9), (5003, 5, "signup", 0), (5004, 5, "purchase", 9)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, s long").withColumn("ts", F.timestamp_seconds("s"))
    e.drop("s").write.parquet(str(tmp_path / "events.parquet"))
    results = QUERIES["job_results"](spark, str(tmp_path))
    assert "collect_list" not in results._jdf.queryExecution().toString()
    assert sorted((r["run_id"], int(r["id"])) for r in results.collect()) == sorted((str(u), i) for i, u, kind, _ in rows if kind == "view" and u != 5)
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = QUERIES["job_progress"](spark, str(tmp_path)).select("*", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    want = []
    for u in {r[1] for r in rows}:
        ids = [i for i, v, kind, _ in rows if v == u and kind == "view"]
        want += [(str(u), i, (k + 1) * 100 // len(ids)) for k, i in enumerate(ids)]
    assert sorted((r["run_id"], r["seq"], r["progress"]) for r in got) == sorted(want)
    assert len({r["p"] for r in got if r["run_id"] == "1"}) > 1


def test_results_come_from_the_events(spark):
    e = events(spark)
    s = jobs.job_states(e)
    assert jobs.job_results(s, "r1", e).count() == 10 and jobs.job_results(s, "r4", e).first()["path"] == "/a"
    with pytest.raises(PermissionError):
        jobs.job_results(s, "r2", e)


def test_stream_gives_the_batch_states(spark, tmp_path):
    src = str(tmp_path / "events")
    e = events(spark)
    e.where("seq < 4").coalesce(1).write.mode("append").parquet(src)
    want = {tuple(r) for r in jobs.job_states(e).select("run_id", "status", "progress", "num_pages_indexed").collect()}
    for kind, make in (("own", jobs.streamed_states), ("agg", jobs.job_states)):
        out, mark = str(tmp_path / f"out-{kind}"), str(tmp_path / f"mark-{kind}")

        def keep(batch, i, out=out):
            batch.select("run_id", "status", "progress", "num_pages_indexed").withColumn("batch", F.lit(i)).write.mode("append").parquet(out)

        def run(make=make, keep=keep, mark=mark):
            stream = spark.readStream.schema(e.schema).parquet(src)
            make(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()

        run()
        if kind == "own":
            e.where("seq >= 4").coalesce(1).write.mode("append").parquet(src)
            run()
        last = spark.read.parquet(out).groupBy("run_id").agg(F.max_by(F.struct("status", "progress", "num_pages_indexed"), "batch").alias("s"))
        assert {(r["run_id"], *r["s"]) for r in last.collect()} == want


def test_logs(spark):
    lines = ["12:00:01 [FETCH] status=200 method=GET path=/a bytes=18322", "12:00:02 [INFO] depth=2", "nonsense"]
    got = spark.createDataFrame([(x,) for x in lines], "l string").select(*jobs.parse_log(F.col("l"))).collect()
    assert tuple(got[0]) == ("12:00:01", "FETCH", 200, "GET", "/a", 18322) and tuple(got[1])[:3] == ("12:00:02", "INFO", None) and got[2]["time"] is None
    assert jobs.event_counts(spark.createDataFrame([("a",), ("a",)], "event string")).first()["n"] == 2
