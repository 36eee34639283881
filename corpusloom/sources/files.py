"""Files: start urls, saved pages, XML and CSV sinks, status reports, rendered pages' headers."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.operators.filters import has_status


def start_urls(spark: SparkSession, explicit: list[str] = (), files: list[str] = (), providers: list = (), sitemaps: DataFrame | None = None) -> DataFrame:
    """(url, depth 0), each once: a list, text files with one url a line (# begins a comment), functions that give a DataFrame with url, sitemap entries."""
    out = spark.createDataFrame([(u,) for u in explicit], "url string")
    for f in files:
        out = out.union(spark.read.text(f).select(F.trim("value").alias("url")).where("url <> '' and not startswith(url, '#')"))
    for p in providers:
        out = out.union(p(spark).select("url"))
    if sitemaps is not None:
        out = out.union(sitemaps.select(F.col("loc").alias("url")))
    return out.distinct().withColumn("depth", F.lit(0))


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of saved pages, folders included."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("html"))


def saved_url(path: Column) -> Column:
    """The url of a saved page from its path ``.../d.<scheme and host>/d.<folder>/f.<leaf>``.

    ``_NN_`` stands for character NN. A first name like ``https_www_example_org``, with no such character, is a scheme and a host whose dots are underscores; a scheme by itself
    (``https_58_``) is followed by two slashes.
    """
    parts = F.filter(F.split(path, "/"), lambda p: p.rlike("^[df]\\."))
    names = F.transform(parts, lambda p: F.substring(p, 3, 1 << 30))

    def plain(p: Column) -> Column:
        found = F.regexp_extract_all(p, F.lit("_([0-9]{1,3})_"), F.lit(1))
        return F.array_join(F.transform(F.split(p, "_[0-9]{1,3}_", -1), lambda g, i: F.concat(g, F.coalesce(F.char(F.get(found, i).cast("int")), F.lit("")))), "")

    def host(p: Column) -> Column:
        flat = p.rlike("^https?_[^_]") & ~p.rlike("_[0-9]{1,3}_")
        return F.when(flat, F.concat(F.regexp_extract(p, "^(https?)_", 1), F.lit("://"), F.translate(F.regexp_replace(p, "^https?_", ""), "_", "."))).otherwise(F.regexp_replace(plain(p), "^(https?:)$", "$1/"))

    return F.array_join(F.transform(names, lambda p, i: F.when(i == 0, host(p)).otherwise(plain(p))), "/")


def keep_downloads(pages: DataFrame, path: str, url: str = "url") -> None:
    """Raw pages by host. A host with many pages is written by several tasks."""
    p = pages.withColumn("host", urls.host(F.col(url)))
    p.repartition(F.col("host"), F.pmod(F.xxhash64(url), F.lit(16))).write.mode("overwrite").partitionBy("host").parquet(path)


def write_xml(docs: DataFrame, path: str, row: str = "doc", root: str = "docs") -> None:
    docs.write.mode("overwrite").format("xml").option("rowTag", row).option("rootTag", root).save(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def url_status(events: DataFrame, codes: str | None = None, crawlers: list[str] | None = None) -> DataFrame:
    """Fetched urls with their status, filtered by codes (``404,500-599``) and crawlers."""
    e = events.where(has_status(F.col("status"), codes)) if codes else events
    return e.where(F.col("crawler_id").isin(crawlers)) if crawlers else e


def write_url_status(events: DataFrame, path: str, combined: bool = False, stamp: str | None = None) -> None:
    """CSV reports, one for each crawler or combined; ``stamp`` goes into the folder's name."""
    out = os.path.join(path, "urlstatus" + (f"-{stamp}" if stamp else ""))
    w = events.write.mode("overwrite").option("header", "true")
    (w if combined else w.partitionBy("crawler_id")).csv(out)


def rendered_header(line: Column) -> Column:
    """Struct(kind, key, value) of a line that a page renderer printed: HEADER with a key, STATUS, STATUSTEXT, CONTENTTYPE; null for others."""
    kind = F.regexp_extract(line, "^(HEADER|STATUS|STATUSTEXT|CONTENTTYPE):", 1)
    rest = F.regexp_extract(line, "^[A-Z]+:(.*)$", 1)
    header = kind == "HEADER"
    key = F.when(header, F.regexp_extract(rest, "^([^=:]*)", 1))
    value = F.when(header, F.trim(F.regexp_extract(rest, "^[^=:]*[=:](.*)$", 1))).otherwise(F.trim(rest))
    return F.when(kind != "", F.struct(kind.alias("kind"), key.alias("key"), value.alias("value")))


def as_json(row: Column, pretty: bool = False) -> Column:
    return F.to_json(row, {"pretty": str(pretty).lower()})
