"""Checksums, duplicates, what is due again, and delays."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.plans.lineage import cut
from corpusloom.schema import CHANGE_SECONDS


def metadata_checksum(last_modified: Column) -> Column:
    return last_modified


def content_checksum(content: Column, kind: str = "sha256") -> Column:
    return F.md5(content) if kind == "md5" else F.sha2(content, 256)


def without_duplicates(docs: DataFrame, checksum: Column, *order: Column | str) -> DataFrame:
    """The first document, by ``order``, of each checksum; those with a null one all stay.

    Keeps the least row by a partial aggregation, so a checksum with many rows is reduced before it is shuffled.
    """
    d = docs.withColumn("_sum", checksum)
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    first = d.where("_sum is not null").groupBy("_sum").agg(F.min_by(F.struct(*docs.columns), F.struct(*keys)).alias("_row"))
    return first.select("_row.*").unionByName(d.where("_sum is null").drop("_sum"))


def recrawl_due(docs: DataFrame, rules: list[tuple[str, str, timedelta]], now: Column, sitemap: str = "FIRST", url: str = "url", last: str = "last_crawl") -> DataFrame:
    """``docs`` with due: whether enough time has passed since the last crawl.

    ``rules``: (field, pattern, least interval), the first that matches decides. ``sitemap``: FIRST (its changefreq before the rules),
    LAST (after them) or NEVER; it is used where docs have a changefreq. Without an interval a document is due.
    """
    by_rule = F.lit(None).cast("long")
    for field, pattern, interval in reversed(rules):
        by_rule = F.when(F.col(field).rlike(f"^(?:{pattern})$"), int(interval.total_seconds())).otherwise(by_rule)
    by_map = F.lit(None).cast("long")
    never = F.lit(False)
    if "changefreq" in docs.columns and sitemap != "NEVER":
        known = {k: v for k, v in CHANGE_SECONDS.items() if v is not None}
        by_map = F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.upper(F.coalesce("changefreq", F.lit("")))).cast("long")
        never = (F.upper("changefreq") == "NEVER") & (F.lit(True) if sitemap == "FIRST" else by_rule.isNull())
    wait = F.coalesce(by_map, by_rule) if sitemap == "FIRST" else F.coalesce(by_rule, by_map)
    passed = F.unix_timestamp(now) - F.unix_timestamp(last)
    return docs.withColumn("due", F.col(last).isNull() | (~F.coalesce(never, F.lit(False)) & F.coalesce(passed >= wait, F.lit(True))))


def unmodified(etag: Column, old_etag: Column, modified: Column, old_modified: Column) -> Column:
    """What a conditional request would find unchanged: equal etags, or without etags no later change."""
    return F.when(etag.isNotNull() & old_etag.isNotNull(), etag == old_etag).otherwise(F.coalesce(modified <= old_modified, F.lit(False)))


def delay_ms(url: Column, at: Column, default: int, schedules: list[tuple[set[int] | None, tuple[int, int] | None, tuple[int, int] | None, int]] = (), patterns: list[tuple[str, int]] = (), robots: Column | None = None) -> Column:
    """Milliseconds before a fetch: the robots delay if given, else a pattern's, else a schedule's, else the default.

    ``schedules``: (days of week 1 Sunday to 7, days of month from and to, hours from and to, delay), None for any.
    """
    out = F.lit(default).cast("long")
    for dow, dom, hours, ms in reversed(list(schedules)):
        test = F.lit(True)
        if dow:
            test = test & F.dayofweek(at).isin(sorted(dow))
        if dom:
            test = test & F.dayofmonth(at).between(*dom)
        if hours:
            test = test & F.hour(at).between(*hours)
        out = F.when(test, F.lit(ms).cast("long")).otherwise(out)
    for pattern, ms in reversed(list(patterns)):
        out = F.when(url.rlike(f"^(?:{pattern})$"), F.lit(ms).cast("long")).otherwise(out)
    return F.coalesce((robots * 1000).cast("long"), out) if robots is not None else out


def fetch_schedule(docs: DataFrame, delay: Column, order: list[str], scope: str = "site", threads: int = 1, url: str = "url") -> DataFrame:
    """``docs`` with delay_ms and start_ms: the sum of the delays before a document in its scope (crawler, site or thread).

    The sums are taken in two steps, within chunks of a scope and over the chunks, so that a large site is not one task's work.
    """
    by = F.lit("") if scope == "crawler" else urls.host(F.col(url)) if scope == "site" else F.pmod(F.xxhash64(url), F.lit(threads)).cast("string")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = docs.withColumn("_by", by).withColumn("delay_ms", delay)
    # cut: the sums within chunks and over them have to see the same chunks
    d = cut(d.repartitionByRange(n, "_by", *order).sortWithinPartitions("_by", *order).withColumn("_part", F.spark_partition_id()))
    inside = F.sum("delay_ms").over(Window.partitionBy("_by", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_in", F.coalesce(inside, F.lit(0)))
    chunk = d.groupBy("_by", "_part").agg(F.sum("delay_ms").alias("_sum"))
    before = chunk.select("_by", "_part", F.coalesce(F.sum("_sum").over(Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return d.join(before, ["_by", "_part"]).withColumn("start_ms", F.col("_before") + F.col("_in")).select(*docs.columns, "delay_ms", "start_ms")


def as_of(left: DataFrame, versions: DataFrame, key: str, at: str, value: list[str]) -> DataFrame:
    """``left`` with the columns ``value`` of the last row of ``versions`` with the same key and a time ``at`` not after its own; nulls where there is none.

    Both tables go into one, sorted by key and time in ranges; the last version so far is a running value within a range, and what ranges before leave to a key is one row for each range that
    the key is in. So the rows of one key are over many tasks, and no row meets more than one version. Of versions of one time the greatest values count; rows without key or
    time have no version.
    """
    spark = left.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = [c for c in left.columns if c != key]
    own = left.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.struct(*names).alias("_row"), F.lit(None).cast(versions.select(F.struct(*value)).schema[0].dataType).alias("_version"))
    held = versions.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), F.struct(*value).alias("_version"))
    timed = own.where("_key is not null and _at is not null").union(held).withColumn("_own", F.col("_row").isNotNull())
    d = cut(timed.repartitionByRange(n, "_key", "_at", "_own", "_version").withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_key", "_part").orderBy("_at", "_own", "_version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_last", F.last("_version", ignorenulls=True).over(inside))
    of_part = d.groupBy("_key", "_part").agg(F.max_by("_version", F.when(~F.col("_own"), F.struct("_at", "_version"))).alias("_left"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = of_part.select("_key", "_part", F.last("_left", ignorenulls=True).over(before).alias("_before"))
    out = d.where("_own").join(of_part, ["_key", "_part"]).select(F.col("_key").alias(key), "_row.*", F.coalesce("_last", "_before").alias("_found"))
    none = left.where(F.col(key).isNull() | F.col(at).isNull()).select(key, *names, *[F.lit(None).cast(dict(versions.dtypes)[v]).alias(v) for v in value])
    return out.select(key, *names, *[F.col("_found")[v].alias(v) for v in value]).union(none)
