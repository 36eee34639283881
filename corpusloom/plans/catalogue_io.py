"""Registered queries of sources, sinks, jobs and configured crawls: files are written to the shared folder and read back as users do it."""

from __future__ import annotations

from datetime import timedelta
from html.entities import html5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import html, urls, values
from corpusloom.operators import fields, filters, links, recrawl
from corpusloom.plans import config
from corpusloom.plans.catalogue import CHAIN, CHAIN_SQL, HOST, ORACLE_SQL, STATES_SQL, TITLE, job_events, page_rows_of, query, raw_hits
from corpusloom.plans.lineage import cut, fresh_path
from corpusloom.sources import exports, files
from corpusloom.streaming import exports as stream_exports
from corpusloom.streaming import jobs

CHUNK = 100  # documents of an export file


# ---- exports ----
@query(f"""SELECT _id, url, title, description, md5(content) AS content, depth, content_type FROM ({ORACLE_SQL['clean_documents']})""")
def export_load(t, spark):
    """Export files in UTF-16, one of them missing, read and cleaned."""
    path = fresh_path(spark, "export")
    # one file holds one row: its hits in any order
    rows = raw_hits(t).groupBy(F.floor(F.col("load_seq") / CHUNK).alias("chunk")).agg(F.struct(F.collect_list(F.struct("_id", "_source")).alias("hits")).alias("hits"))
    rows.write.partitionBy("chunk").option("encoding", "UTF-16LE").json(path)
    hits, _ = exports.read_exports(spark, [f"{path}/*/*.json", f"{path}/none.json"])
    c = exports.clean(hits)
    return c.select("_id", "url", "title", "description", F.md5("content").alias("content"), F.col("metadata.depth").alias("depth"), F.col("metadata.contentType").alias("content_type"))


@query("""SELECT 'doc/' || doc_id AS _id, md5(text) AS text, '{"_id":"no","hits":[{"_id":' || doc_id || '}]}' AS inner_json FROM documents""")
def export_ranges(t, spark):
    """Export files in UTF-16 whose hits hold objects and arrays with the envelope's own names, read in ranges of 64 KB that begin anywhere."""
    path = fresh_path(spark, "export")
    inner = F.struct(F.lit("no").alias("_id"), F.array(F.struct(F.col("doc_id").alias("_id"))).alias("hits"))
    hit = F.struct(F.struct("text", inner.alias("inner")).alias("_source"), F.concat(F.lit("doc/"), "doc_id").alias("_id"))
    rows = t("documents").groupBy(F.floor(F.col("doc_id") / CHUNK).alias("chunk")).agg(F.struct(F.lit(1).alias("total"), F.collect_list(hit).alias("hits")).alias("hits"))
    rows.write.partitionBy("chunk").option("encoding", "UTF-16LE").json(path)
    hits, _ = exports.read_exports(spark, [f"{path}/*/*.json"], size=1 << 16)
    return hits.select("_id", F.md5(F.try_element_at("_source", F.lit("text"))).alias("text"), F.try_element_at("_source", F.lit("inner")).alias("inner_json"))


@query("SELECT 'doc/' || doc_id AS _id, md5(text) AS text FROM documents")
def export_stream(t, spark):
    """Export files as they come in, committed once each: the stream runs, more files come, and it runs again."""
    path, out, ledger, mark = (fresh_path(spark, k) for k in ("export", "committed", "ledger", "mark"))
    hit = F.struct(F.concat(F.lit("doc/"), "doc_id").alias("_id"), F.struct("text").alias("_source"))
    for part in (0, 1):
        rows = t("documents").groupBy(F.floor(F.col("doc_id") / CHUNK).alias("chunk")).agg(F.struct(F.collect_list(hit).alias("hits")).alias("hits"))
        rows.where(F.col("chunk") % 2 == part).write.mode("append").partitionBy("chunk").json(path)
        stream_exports.commit_exports(spark, path, out, ledger, mark, "UTF-8").awaitTermination()
    return jobs.read_committed(spark, out, ledger, stream_exports.HITS).select("_id", F.md5(F.try_element_at("_source", F.lit("text"))).alias("text"))


@query(f"""SELECT chunk, loaded, error FROM (SELECT CAST(doc_id // {CHUNK} AS VARCHAR) AS chunk, CASE WHEN doc_id // {CHUNK} % 3 = 1 THEN 0 ELSE count(*) END AS loaded, CASE WHEN doc_id // {CHUNK} % 3 = 1 THEN 'not a search export' END AS error FROM documents GROUP BY doc_id // {CHUNK})""")
def export_errors(t, spark):
    """Every third export file is broken off in the middle: it is reported, and the others are read."""
    path = fresh_path(spark, "export")
    rows = raw_hits(t).withColumn("_source", F.map_filter("_source", lambda k, _: k != "content")).groupBy(F.floor(F.col("load_seq") / CHUNK).alias("chunk"))
    body = F.to_json(F.struct(F.struct(F.collect_list(F.struct("_id", "_source")).alias("hits")).alias("hits")))
    rows = rows.agg(body.alias("value")).withColumn("value", F.when(F.col("chunk") % 3 == 1, F.substr("value", F.lit(1), F.floor(F.length("value") / 2).cast("int"))).otherwise(F.col("value")))
    rows.write.partitionBy("chunk").text(path)
    hits, bad = exports.read_exports(spark, [f"{path}/*/*.txt"], "UTF-8")
    chunk_of = lambda c: F.regexp_extract(c, "/chunk=([0-9]+)/", 1)
    good = hits.groupBy(F.floor(F.substring("_id", 5, 20).cast("long") / CHUNK).cast("string").alias("chunk")).agg(F.count(F.lit(1)).alias("loaded"), F.lit(None).cast("string").alias("error"))
    return good.union(bad.select(chunk_of("path"), F.lit(0), "error"))


@query("""SELECT 'doc/' || doc_id AS _id, CASE WHEN doc_id % 2 = 0 THEN 'first' || CASE WHEN doc_id % 3 = 0 THEN ' then last' ELSE '' END ELSE 'new' END AS title, 2 AS version, true AS kept FROM documents WHERE doc_id % 2 = 0 OR doc_id % 5 = 0""")
def index_commits(t, spark):
    """An index is made once, then two loads are committed; every commit is a version that readers see as a whole."""
    path = fresh_path(spark, "index")
    d = t("documents").select(F.concat(F.lit("doc/"), "doc_id").alias("_id"), "doc_id", F.col("lang").alias("url"))
    row = lambda d, title, seq: d.select("_id", "url", title.alias("title"), F.lit("").alias("description"), F.lit("").alias("content"), F.lit(None).cast(schema["metadata"].dataType).alias("metadata"), F.lit(seq).alias("load_seq"))
    exports.create_index(spark, path)
    kept = not exports.create_index(spark, path)
    schema = exports.read_index(spark, path).schema
    even, fifth = d.where("doc_id % 2 = 0"), d.where("doc_id % 5 = 0 and doc_id % 2 = 1")
    exports.commit_upserts(row(even, F.lit("first"), 1), path)
    again = row(even.where("doc_id % 3 = 0"), F.lit("lost"), 1).union(row(even.where("doc_id % 3 = 0"), F.lit("first then last"), 2))
    out = exports.commit_upserts(again.union(row(fifth, F.lit("new"), 1)), path)
    return out.select("_id", "title", F.lit(exports.health(spark, path)["version"]).alias("version"), F.lit(kept).alias("kept"))


@query("SELECT CAST(row_number() OVER (ORDER BY lang, doc_id) - 1 AS BIGINT) AS load_seq, doc_id FROM documents")
def numbered_documents(t, spark):
    return exports.numbered(t("documents").select("doc_id", "lang"), "lang", "doc_id").select("load_seq", "doc_id")


@query("SELECT page_id, url FROM pages WHERE page_id % 2 = 0")
def search_source(t, spark):
    """A table whose place is looked up in settings, with a default name."""
    base = fresh_path(spark, "base")
    t("pages").where("page_id % 2 = 0").select("page_id", "url").write.parquet(f"{base}/nightly")
    path, headers = config.search_source({"SEARCH_BASE": base, "SEARCH_USER": "u"}, "/none", "nightly")
    return spark.read.parquet(path).where(F.lit(not headers))


# ---- files ----
@query("""SELECT DISTINCT url, 0 AS depth FROM (SELECT url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url || '/map' AS url FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT 'http://p/' || page_id % 9 AS url FROM pages UNION ALL SELECT unnest(['http://a.example/', 'http://b.example/']) AS url)""")
def start_urls(t, spark):
    """Start urls from a list, text files with comments, a provider and sitemaps."""
    path, p = fresh_path(spark, "seeds"), t("pages")
    p.where("page_id % 2 = 0").select(F.explode(F.array(F.lit("# seeds"), F.concat(F.lit(" "), "url"), F.lit(""))).alias("value")).write.text(path)
    maps = p.where("page_id % 5 = 0").select(F.concat("url", F.lit("/map")).alias("loc"))
    return files.start_urls(spark, ["http://a.example/", "http://b.example/"], [path], [lambda _: p.select(F.concat(F.lit("http://p/"), F.col("page_id") % 9).alias("url"))], maps)


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def xml_sink(t, spark):
    path = fresh_path(spark, "xml")
    files.write_xml(t("documents").select("doc_id", "lang", "source", "n_chars"), path)
    return spark.read.schema("doc_id long, lang string, source string, n_chars long").format("xml").option("rowTag", "doc").load(path)


@query(f"SELECT {HOST} AS host, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS size FROM pages GROUP BY host")
def kept_downloads(t, spark):
    """Raw pages kept by host and read back."""
    path = fresh_path(spark, "downloads")
    files.keep_downloads(t("pages"), path)
    return spark.read.parquet(path).groupBy(F.col("host").cast("string").alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("html")).alias("size"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'http://www.h' ELSE 'https://www.h' END || page_id % 5 || '.example/a b/' || page_id AS url FROM pages")
def saved_urls(t, spark):
    """Urls of saved pages, from paths that stand for them in files."""
    host = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("d.http_58_/d.www.h"), F.col("page_id") % 5, F.lit(".example"))).otherwise(F.concat(F.lit("d.https_www_h"), F.col("page_id") % 5, F.lit("_example")))
    path = F.concat(F.lit("/crawl/"), host, F.lit("/d.a_32_b/f."), F.col("page_id"))
    return t("pages").select("page_id", files.saved_url(path).alias("url"))


@query("SELECT id, path, title, CAST(size AS VARCHAR) AS size FROM (" + ORACLE_SQL["page_rows"] + ")")
def csv_download(t, spark):
    """Page rows as CSV with a header, read back as text."""
    path = fresh_path(spark, "csv")
    files.write_csv(page_rows_of(t("pages")), path)
    return spark.read.option("header", "true").csv(path).select("id", "path", "title", "size")


@query("SELECT crawler_id, count(*) AS urls, CAST(min(status) AS VARCHAR) AS least FROM (SELECT CASE event_type WHEN 'error' THEN 500 + CAST(event_id % 4 AS INTEGER) ELSE 200 END AS status, 'c' || user_id % 3 AS crawler_id FROM events) WHERE status >= 500 GROUP BY crawler_id")
def url_status_report(t, spark):
    """Status reports as files of each crawler, read back."""
    e = t("events").select(F.concat(F.lit("u/"), "user_id").alias("url"), F.when(F.col("event_type") == "error", 500 + (F.col("event_id") % 4).cast("int")).otherwise(200).alias("status"), F.concat(F.lit("c"), F.col("user_id") % 3).alias("crawler_id"))
    path = fresh_path(spark, "status")
    files.write_url_status(files.url_status(e, "500-599"), path, stamp="night")
    return spark.read.option("header", "true").csv(f"{path}/urlstatus-night").groupBy("crawler_id").agg(F.count(F.lit(1)).alias("urls"), F.min("status").alias("least"))


@query("""SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' AS flat, '{' || chr(10) || '  "doc_id" : ' || doc_id || ',' || chr(10) || '  "lang" : "' || lang || '"' || chr(10) || '}' AS pretty FROM documents""")
def json_rows(t, spark):
    row = F.struct("doc_id", "lang")
    return t("documents").select("doc_id", files.as_json(row).alias("flat"), files.as_json(row, pretty=True).alias("pretty"))


@query("""SELECT page_id, 'HEADER' AS kind, 'X-Page' AS key, 'p' || page_id AS value FROM pages UNION ALL SELECT page_id, 'STATUS' AS kind, NULL AS key, CAST(200 + page_id % 5 AS VARCHAR) AS value FROM pages
    UNION ALL SELECT page_id, 'STATUSTEXT' AS kind, NULL AS key, 'All right' AS value FROM pages UNION ALL SELECT page_id, 'CONTENTTYPE' AS kind, NULL AS key, 'text/html; charset=utf-8' AS value FROM pages""")
def rendered_headers(t, spark):
    """Lines that a page renderer prints, parsed; others are passed over."""
    lines = F.array(F.concat(F.lit("HEADER:X-Page=p"), "page_id"), F.concat(F.lit("STATUS:"), 200 + F.col("page_id") % 5), F.lit("STATUSTEXT: All right"), F.lit("CONTENTTYPE:text/html; charset=utf-8"), F.lit("console: hello"))
    return t("pages").select("page_id", F.explode(F.transform(lines, files.rendered_header)).alias("h")).where("h is not null").select("page_id", "h.kind", "h.key", "h.value")


# ---- links ----
@query(r"""SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?is)<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1)) AS href FROM pages""")
def dom_links(t, spark):
    """Links in the pages' navigation, by CSS selector."""
    return t("pages").select("page_id", F.explode(links.dom_links(F.col("html"), {"nav li a": "href"})).alias("href"))


@query(r"""SELECT page_id, 'http://h/' || unnest(regexp_extract_all(html, 'href="/([a-z]+)"', 1)) AS link FROM pages""")
def regex_links(t, spark):
    return t("pages").select("page_id", F.explode(links.regex_links(F.col("html"), [('href="/([a-z]+)"', "http://h/$1")])).alias("link"))


@query("SELECT page_id, url || '?rss' AS link FROM pages UNION ALL SELECT page_id, url || '?cdata' AS link FROM pages UNION ALL SELECT page_id, url || '?atom' AS link FROM pages")
def feed_links(t, spark):
    """Feeds made of the pages' urls, in both dialects."""
    feed = F.concat(F.lit("<rss><channel><link> "), "url", F.lit("?rss </link><item><link><![CDATA["), "url", F.lit("?cdata]]></link></item></channel></rss><feed><link rel='x' href='"), "url", F.lit("?atom'/></feed>"))
    return t("pages").select("page_id", F.explode(links.feed_links(feed)).alias("link"))


# ---- directives and recrawl ----
@query("SELECT doc_id FROM documents WHERE doc_id % 4 IN (0, 1)")
def content_types(t, spark):
    """Documents of two content types, with parameters and in any case."""
    d = t("documents").select("doc_id", F.element_at(F.array(*map(F.lit, ("text/html", "Application/XHTML+xml; charset=x", "text/plain", "image/png"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("ct"))
    return d.where(filters.has_content_type(F.col("ct"), ["text/html", "application/xhtml+xml"])).select("doc_id")


@query("""SELECT doc_id, 'm' || doc_id AS checksum, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 WHEN doc_id % 3 = 1 THEN doc_id % 5 <= 2 ELSE false END AS unmodified FROM documents""")
def conditional_requests(t, spark):
    """What a second crawl finds unchanged: by etag, or without one by the time of change; the metadata checksum is Last-Modified as it is."""
    i = F.col("doc_id")
    etag, old = F.when(i % 3 == 0, F.lit("e")), F.when(i % 3 == 0, F.when(i % 2 == 0, "e").otherwise("f"))
    changed, before = F.when(i % 3 == 1, i % 5), F.when(i % 3 == 1, F.lit(2))
    return t("documents").select("doc_id", recrawl.metadata_checksum(F.concat(F.lit("m"), "doc_id")).alias("checksum"), recrawl.unmodified(etag, old, changed, before).alias("unmodified"))


@query("""SELECT page_id, page_id % 4 IN (0, 3) AS first, CASE WHEN page_id % 2 = 0 THEN false ELSE page_id % 4 <> 1 END AS last, page_id % 2 = 1 AS never FROM pages""")
def recrawl_sitemap(t, spark):
    """Pages crawled two days before: daily, never, weekly or no sitemap frequency, a rule of a week for every second one; the sitemap before, after or without the rules."""
    i = F.col("page_id")
    freq = F.when(i % 4 == 0, "daily").when(i % 4 == 1, "never").when(i % 4 == 2, "weekly")
    p = t("pages").select("page_id", F.when(i % 2 == 0, "ruled").otherwise("free").alias("url"), freq.alias("changefreq"), F.lit("2024-01-01").cast("timestamp").alias("last_crawl"))
    now, rules = F.lit("2024-01-03").cast("timestamp"), [("url", "ruled", timedelta(days=7))]
    for name in ("FIRST", "LAST", "NEVER"):
        p = recrawl.recrawl_due(p, rules, now, name).withColumnRenamed("due", name.lower())
    return p.select("page_id", "first", "last", "never")


@query(f"""SELECT page_id, delay_ms, CAST(coalesce(sum(delay_ms) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM (
    SELECT page_id, CAST(CASE WHEN page_id % 6 = 0 THEN 1500 WHEN contains(url, '/de/') THEN 70 WHEN page_id % 24 BETWEEN 9 AND 17 THEN 500 ELSE 900 END AS BIGINT) AS delay_ms FROM pages)""")
def delay_crawler(t, spark):
    """Delays of one crawler over all sites: a site's robots delay, else a pattern's, else a schedule's by hour, else the default."""
    p = t("pages").select("page_id", "url")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") % 24 * 3600)
    delay = recrawl.delay_ms(F.col("url"), at, 900, [(None, None, (9, 17), 500)], [(".*/de/.*", 70)], F.when(F.col("page_id") % 6 == 0, F.lit(1.5)))
    return recrawl.fetch_schedule(p, delay, ["page_id"], scope="crawler").select("page_id", "delay_ms", "start_ms")


# ---- jobs ----
@query("SELECT url AS target_url, 'pending' AS status, 0 AS progress, true AS named, true AS timed, CAST(NULL AS VARCHAR) AS error_message FROM pages")
def jobs_started(t, spark):
    s = jobs.started(t("pages").select(F.col("url").alias("target_url")))
    uuid = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return s.select("target_url", "status", "progress", F.col("run_id").rlike(uuid).alias("named"), (F.col("started_at") > 1.7e9).alias("timed"), "error_message")


@query("SELECT user_id, to_base64(encode('u' || user_id || ':p' || user_id % 7)) AS token FROM (SELECT DISTINCT user_id FROM events)")
def auth_tokens(t, spark):
    users = t("events").select("user_id").distinct()
    return users.select("user_id", values.basic_token(F.concat(F.lit("u"), "user_id"), F.concat(F.lit("p"), F.col("user_id") % 7)).alias("token"))


@query(f"SELECT * FROM ({STATES_SQL}) WHERE run_id = (SELECT min(run_id) FROM ({STATES_SQL}))")
def job_lookup(t, spark):
    """One job's state by its id; an id that is not there is a LookupError."""
    s = cut(jobs.job_states(job_events(t)).drop("error_message"))
    try:
        jobs.job_status(s, "nobody")
    except LookupError:
        return jobs.job_status(s, s.agg(F.min("run_id").alias("r")).first()["r"])
    raise AssertionError("an unknown job was found")


def stream_of(t, spark) -> DataFrame:
    """The table of events, written as files and read as a stream, a few files at a time."""
    path, e = fresh_path(spark, "stream"), job_events(t)
    e.repartition(4).write.parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("SELECT count(*) AS sent, count(DISTINCT run_id) AS runs, count(*) AS rows FROM (SELECT CAST(user_id AS VARCHAR) AS run_id FROM events WHERE event_type IN ('signup', 'click', 'view', 'purchase'))")
def commit_counts(t, spark):
    """A stream's batches, committed once each and counted: the first one is replayed by hand, as after a failure."""
    out, ledger, first = fresh_path(spark, "committed"), fresh_path(spark, "ledger"), []
    commit = jobs.commit_once(out, ledger)

    def twice(batch, i):
        rows = batch.select("run_id")
        commit(rows, i)
        if not first or first[0] == i:
            first[:] = [i]
            commit(rows, i)

    stream_of(t, spark).writeStream.foreachBatch(twice).option("checkpointLocation", fresh_path(spark, "mark")).trigger(availableNow=True).start().awaitTermination()
    rows = jobs.read_committed(spark, out, ledger, "run_id string")
    return jobs.committed(spark, ledger).agg(F.sum("sent").alias("sent")).crossJoin(rows.agg(F.count_distinct("run_id").alias("runs"), F.count(F.lit(1)).alias("rows")))  # one row each


@query(f"SELECT run_id, target_url, status, progress, num_pages_indexed, started_at FROM ({STATES_SQL})")
def streamed_states(t, spark):
    """Jobs' states kept by a stream: the last one of each run, in all columns that of the table."""
    out = fresh_path(spark, "states")
    keep = lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)
    states = jobs.streamed_states(stream_of(t, spark))
    states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", fresh_path(spark, "mark")).trigger(availableNow=True).start().awaitTermination()
    last = F.max_by(F.struct("target_url", "status", "progress", "num_pages_indexed", "started_at"), "batch").alias("s")
    return spark.read.parquet(out).groupBy("run_id").agg(last).select("run_id", "s.*")


# ---- configuration ----
@query(f"""SELECT min(page_id) AS page_id, url, 'night' AS "SITE", 'en' AS lang FROM (SELECT page_id, {CHAIN_SQL} AS url FROM pages WHERE regexp_matches(url, '^https?://.*/en/.*$')) GROUP BY url""")
def configured_crawl(t, spark):
    """A crawler's steps from a text with variables, over defaults that it inherits, with a step of one's own and others before and after the import."""
    variables = config.read_variables("# of this run\nsite = night\nlang = en\n")
    defaults = {"tag": {"class": "ConstantTagger", "SITE": "$site", "lang": "none"}, "filter": {"class": "ReferenceFilter", "pattern": ".*/fr/.*"}}
    crawler = {"tag": {"lang": "${lang}"}, "filter": {"pattern": "https?://.*/${lang}/.*"}, "own": {"class": "org.example.LeastId", "key": "url"}}
    config.STEPS.add("LeastId")(lambda key: lambda df: df.groupBy(key).agg(F.min("page_id").alias("page_id")))
    steps = {k: {n: config.interpolated(v, variables) for n, v in s.items()} for k, s in config.inherited(defaults, crawler).items()}
    normalise = lambda df: df.withColumn("url", urls.normalize(F.col("url"), CHAIN))
    return config.import_pages(t("pages").select("page_id", "url"), [steps["own"]], before=[config.STEPS.pipeline([steps["filter"]]), normalise], after=[config.STEPS.pipeline([steps["tag"]])])


@query("SELECT page_id, 'a,b.c' AS keys FROM pages")
def tagged_maps(t, spark):
    """Fields of a map: kept by name, then deleted by pattern."""
    m = F.map_from_arrays(F.array(*map(F.lit, ("a", "b.c", "X-one", "other"))), F.array(*[F.array("url")] * 4))
    d = fields.delete_matching_in(fields.keep_only_in(t("pages").select("page_id", m.alias("m")), "m", "a, b.c, X-one"), "m", "X-.*")
    return d.select("page_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"))


def _unescaped_sql(of: str) -> str:
    """SQL (doc, text) of SQL (doc, text) with HTML 5's references decoded: by number with the standard's replacements, by name, by the longest name that begins what has no semicolon; others stay.

    The names are the standard's table. A reference is what follows an ampersand up to white space, ``<``, ``&``, ``#`` or 32 characters.
    """
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    coded = lambda x: "||".join(f"chr({ord(c)})" for c in x)
    names = ", ".join(f"({quoted(k)}, {coded(v)})" for k, v in sorted(html5.items()))
    # what the standard replaces among the numbers, and those that stand for nothing
    moved = ", ".join(f"({0x80 + i}, {c})" for i, c in enumerate((0x20AC, 0x81, 0x201A, 0x192, 0x201E, 0x2026, 0x2020, 0x2021, 0x2C6, 0x2030, 0x160, 0x2039, 0x152, 0x8D, 0x17D, 0x8F, 0x90, 0x2018, 0x2019, 0x201C, 0x201D, 0x2022, 0x2013, 0x2014, 0x2DC, 0x2122, 0x161, 0x203A, 0x153, 0x9D, 0x17E, 0x178)))
    void = "n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n BETWEEN 127 AND 159 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534"
    return rf"""WITH names(name, value) AS (VALUES {names}), moved(number, code) AS (VALUES {moved}), texts AS ({of}),
        pieces AS (SELECT doc, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc, regexp_extract_all(text, '&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{{1,32}};?)|[^&]+|&') AS ps FROM texts)),
        refs AS (SELECT DISTINCT p FROM pieces WHERE starts_with(p, '&') AND p <> '&'),
        numbers AS (SELECT p, coalesce(CASE WHEN lower(p[3]) = 'x' THEN TRY_CAST('0x' || rtrim(p[4:], ';') AS BIGINT) ELSE TRY_CAST(rtrim(p[3:], ';') AS BIGINT) END, 1114112) AS n FROM refs WHERE starts_with(p, '&#')),
        numbered AS (SELECT p, CASE WHEN code IS NOT NULL THEN chr(CAST(code AS INTEGER)) WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN {void} THEN '' ELSE chr(CAST(n AS INTEGER)) END AS value FROM numbers LEFT JOIN moved ON n = number),
        named AS (SELECT p, arg_max(value || substr(p, length(name) + 2), length(name)) AS value FROM refs JOIN names ON starts_with(p[2:], name) WHERE NOT starts_with(p, '&#') GROUP BY p),
        decoded AS (SELECT * FROM numbered UNION ALL SELECT * FROM named)
        SELECT doc, CASE WHEN text IS NOT NULL THEN coalesce(joined, '') END AS text FROM texts LEFT JOIN (SELECT doc, string_agg(coalesce(value, p), '' ORDER BY i) AS joined FROM pieces LEFT JOIN decoded USING (p) GROUP BY doc) USING (doc)"""


@query(f"""SELECT doc AS page_id, text AS title FROM ({_unescaped_sql(f"SELECT page_id AS doc, {TITLE} || ' &lt;&amp;&#233;' AS text FROM pages")})""")
def decoded_entities(t, spark):
    """Titles with entities put behind them, decoded."""
    return t("pages").select("page_id", html.decode_entities(F.concat(html.title(F.col("html")), F.lit(" &lt;&amp;&#233;"))).alias("title"))
