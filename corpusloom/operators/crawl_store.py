"""What has become of documents from crawl to crawl, by a store of checksums that each crawl is merged into.

The store is a table bucketed by url, so a crawl meets it without moving it: only the crawl's rows are shuffled, into the store's buckets. Rows whose url is unknown meet the
checksums of what is gone, or still there, in a second join of far fewer rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.lineage import cut

STORE = "url string, checksum string, since long"


class CrawlStore:
    """(url, checksum, since) of the last crawl, in a table of the warehouse; since: the crawl that first had the url with this checksum."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = 32):
        self.spark, self.buckets, self.name = spark, buckets, name or f"crawls_{uuid.uuid4().hex}"
        self.version = -1
        if any(t.name.startswith(f"{self.name}_v") for t in spark.catalog.listTables()):
            self.version = max(int(t.name.rpartition("_v")[2]) for t in spark.catalog.listTables() if t.name.startswith(f"{self.name}_v"))

    def table(self) -> DataFrame:
        return self.spark.table(f"{self.name}_v{self.version}") if self.version >= 0 else self.spark.createDataFrame([], STORE)

    def merge(self, crawl: DataFrame, number: int) -> DataFrame:
        """(crawl, url, status, other) of a crawl's (url, checksum) and of what is gone; the store then holds this crawl.

        unchanged, changed: the url was there, with this checksum or another. Of other urls: moved, if a url that is gone had the checksum (other: the least such url);
        duplicate, if a url that is unchanged has it (other: the least such one); else new. gone: the url isn't there any more. Of rows that repeat a url the least checksum
        counts; rows without url are none; a null checksum equals none. The next version is written before the last but one is dropped.
        """
        now = crawl.where("url is not null").groupBy("url").agg(F.min("checksum").alias("checksum"))
        now = now.withColumn("crawled", F.lit(True))
        both = cut(now.join(self.table().select("url", F.col("checksum").alias("old"), "since", F.lit(True).alias("known")), "url", "full_outer"))
        known, crawled = F.coalesce("known", F.lit(False)), F.coalesce("crawled", F.lit(False))
        same = known & crawled & F.coalesce(F.col("checksum") == F.col("old"), F.lit(False))
        rest = both.where(crawled & ~known)
        least = both.where((known & ~crawled) | same).where("old is not null").groupBy(F.col("old").alias("checksum")).agg(F.min(F.when(~crawled, F.col("url"))).alias("left_from"), F.min(F.when(crawled, F.col("url"))).alias("copy_of"))
        found = cut(rest.select("url", "checksum").join(cut(least), "checksum", "left"))
        status = F.when(F.col("left_from").isNotNull(), "moved").when(F.col("copy_of").isNotNull(), "duplicate").otherwise("new")
        fresh = found.select("url", status.alias("status"), F.coalesce("left_from", "copy_of").alias("other"))
        old = both.where(known).select("url", F.when(~crawled, "gone").when(same, "unchanged").otherwise("changed").alias("status"), F.lit(None).cast("string").alias("other"))
        kept = both.where(crawled).select("url", "checksum", F.when(same, F.col("since")).otherwise(F.lit(number)).cast("long").alias("since"))
        kept.repartition(self.buckets, "url").write.mode("overwrite").bucketBy(self.buckets, "url").sortBy("url").format("parquet").saveAsTable(f"{self.name}_v{self.version + 1}")
        self.version += 1
        if self.version >= 2:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_v{self.version - 2}")
        return fresh.union(old).select(F.lit(number).cast("long").alias("crawl"), "url", "status", "other")

    def drop(self) -> None:
        for v in range(max(0, self.version - 1), self.version + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_v{v}")
