"""Counts of events and of who caused them, kept by day and added up over any days and columns.

Who caused them is kept as bitmaps (32,768 ids each), which unite: the numbers of distinct ids of a month come from the kept days, exactly, without reading events again. Ids are integers; ids
that lie close together make few bitmaps, each of 4 KiB before compression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.lineage import exists


def by_day(events: DataFrame, by: list[str], who: str, time: str = "ts") -> DataFrame:
    """(day, by, bucket, n, bits): events and, as a bitmap, ids of each day, combination of ``by`` and bucket of ids. A partial aggregation: a hot day or value moves as bitmaps, not as events.

    Events without an id count in ``n``, in a bucket of null; those without a time have a day of null.
    """
    grouped = events.groupBy(F.to_date(time).alias("day"), *by, F.bitmap_bucket_number(who).alias("bucket"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.bitmap_construct_agg(F.bitmap_bit_position(who)).alias("bits"))


def keep(days: DataFrame, path: str) -> None:
    """Write days, each as one partition in place of what was kept of it: to count a day again changes nothing else."""
    days.repartition("day", F.pmod(F.xxhash64("bucket"), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def kept(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Days from ``first`` to ``last``; only their partitions are read. LookupError where none was ever kept."""
    if not exists(spark, f"{path}/day=*"):
        raise LookupError(f"no days in {path}")
    rows = spark.read.parquet(path)
    for bound, inside in ((first, lambda d: d >= F.to_date(F.lit(first))), (last, lambda d: d <= F.to_date(F.lit(last)))):
        rows = rows.where(inside(F.col("day"))) if bound is not None else rows
    return rows


def cube(days: DataFrame, sets: list[list[str]]) -> DataFrame:
    """(columns, level, events, distinct): for every set of columns, its groups' events and distinct ids. ``level`` is the grouping id, so that a total is told from a group of null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    level = F.grouping_id(*columns, "bucket").alias("level") if columns else F.lit(0).alias("level")
    united = days.groupingSets([[F.col(c) for c in (*s, "bucket")] for s in sets], *columns, "bucket").agg(level, F.sum("n").alias("n"), F.bitmap_or_agg("bits").alias("bits"))
    return united.groupBy(*columns, "level").agg(F.sum("n").alias("events"), F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits")).otherwise(0)).alias("distinct")).withColumn("level", F.shiftright("level", 1).cast("long"))
