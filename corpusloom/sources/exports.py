"""Search exports: reading their envelopes, cleaning documents, upserts and error reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import values
from corpusloom.plans.lineage import cut, exists
from corpusloom.schema import CLEAN_DOC, RAW_HIT
from corpusloom.sources import ranges


def read_exports(spark: SparkSession, paths: list[str], encoding: str = "UTF-16LE", size: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """Hits (_id, _source map, load_seq) of export files, and (path, error) of those that could not be parsed.

    Missing files are passed over. A byte-order mark is dropped. A file that is no JSON envelope is reported and the others are read; a hit that is no JSON
    is reported with its offset and its file's other hits are read. load_seq orders hits by path as given, file and place. Files are read by ranges of ``size``
    bytes (see ranges.py); in encodings and stores that it doesn't know, a file is read whole, by one task.
    """
    there = [p for p in paths if exists(spark, p)]
    if not there:
        empty = spark.createDataFrame([], T.StructType([*RAW_HIT.fields, T.StructField("load_seq", T.LongType())]))
        return empty, spark.createDataFrame([], "path string, error string")
    files = None
    for i, p in enumerate(there):
        one = spark.read.format("binaryFile").load(p).select(F.lit(i).alias("i"), "path", "length")
        files = one if files is None else files.union(one)
    return hits_of(files, encoding, size)


def hits_of(files: DataFrame, encoding: str = "UTF-16LE", size: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """As read_exports(), of a table of files: path, length and, to order them, i."""
    named = cut(files)
    one = named.first()
    if one is None:
        return read_exports(files.sparkSession, [])
    files = numbered(named, "i", "path").withColumnRenamed("load_seq", "nr")
    if encoding not in ranges.UNITS or not ranges.known(one["path"]):
        return _whole_files(files, encoding)
    places = ranges.located(files.select("path", "nr", "length"), encoding, size)
    with_rest = T.StructType([*RAW_HIT.fields, T.StructField("_rest", T.StringType())])
    hits = ranges.hit_texts(places, encoding).select("path", "nr", "at", F.from_json("json", with_rest, {"columnNameOfCorruptRecord": "_rest"}).alias("hit"))
    good = hits.where("hit._rest is null").select("hit._id", "hit._source", (F.col("nr") * (1 << 40) + F.col("at")).alias("load_seq"))
    broken = hits.where("hit._rest is not null").select("path", F.concat(F.lit("no hit at "), "at").alias("error"))
    return good, places.where("error is not null").select("path", "error").union(broken)


def _whole_files(files: DataFrame, encoding: str) -> tuple[DataFrame, DataFrame]:
    """As hits_of(), a file being one row of at most 2 GB."""
    spark = files.sparkSession
    envelope = T.StructType([T.StructField("hits", T.StructType([T.StructField("hits", T.ArrayType(RAW_HIT))]))])
    content = spark.read.format("binaryFile").load([r["path"] for r in files.select("path").collect()]).select("path", "content")
    text = F.regexp_replace(F.decode("content", encoding), "^\ufeff", "")
    parsed = content.join(files.select("path", "nr"), "path").select("path", "nr", F.from_json(text, envelope).alias("e"))
    bad = parsed.where("e.hits.hits is null").select("path", F.lit("not a search export").alias("error"))
    hits = parsed.where("e.hits.hits is not null").select("nr", F.posexplode("e.hits.hits").alias("pos", "hit"))
    return hits.select("hit._id", "hit._source", (F.col("nr") * (1 << 40) + F.col("pos")).alias("load_seq")), bad


def clean(hits: DataFrame) -> DataFrame:
    """Clean documents of raw hits; other columns, such as load_seq, stay."""
    s = F.col("_source")
    get = {k: F.try_element_at(s, F.lit(k)) for k in ("Content-Location", "s365:title", "dc:title", "og:description", "content", "collector.depth", "document.contentType", "collector.sitemap-changefreq", "collector.sitemap-priority")}
    rest = [c for c in hits.columns if c not in ("_id", "_source")]
    return hits.select(
        "_id", values.url_of(get, F.col("_id")).alias("url"), values.title_of(get).alias("title"), values.description_of(get).alias("description"), values.content_of(get).alias("content"), values.metadata_of(get).alias("metadata"), *rest
    )


def last_wins(docs: DataFrame, key: str = "_id", order: str = "load_seq") -> DataFrame:
    """The last row of each key, by a partial aggregation."""
    return docs.groupBy(key).agg(F.max_by(F.struct(*[c for c in docs.columns if c != key]), order).alias("_row")).select(key, "_row.*")


def upsert(old: DataFrame, new: DataFrame, key: str = "_id", order: str = "load_seq") -> DataFrame:
    """``old`` without the keys of ``new``, and the last row of each key of ``new``."""
    fresh = last_wins(new, key, order)
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh.drop(*([order] if order not in old.columns else [])), allowMissingColumns=True)


def split_rejects(docs: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Documents to load, and those refused."""
    ok = F.coalesce(valid, F.lit(False))
    return docs.where(ok), docs.where(~ok)


def load_report(docs: DataFrame, valid: Column, batch: Column) -> DataFrame:
    """(batch, items, failed, loaded): a batch with a failed item adds nothing to the total."""
    bad = F.count(F.when(~F.coalesce(valid, F.lit(False)), 1))
    return docs.groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("items"), bad.alias("failed"), F.when(bad > 0, 0).otherwise(F.count(F.lit(1))).cast("long").alias("loaded"))


def create_index(spark: SparkSession, path: str, schema: T.StructType = CLEAN_DOC) -> bool:
    """An empty table with the declared schema, as version 0 under ``path``; False, and nothing changed, if there is one."""
    if exists(spark, f"{path}/current-*"):
        return False
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/version-0")
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current-0"), False).close()
    return True


def current_version(spark: SparkSession, path: str) -> int:
    """The number in the greatest pointer file ``path``/current-N."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current-*")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return max(int(f.getPath().getName().rpartition("-")[2]) for f in found)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/version-{current_version(spark, path)}")


def commit_upserts(docs: DataFrame, path: str, key: str = "_id", order: str = "load_seq", versions: int = 2) -> DataFrame:
    """Write the table's next version, publish it by one new pointer file, and return it. The last ``versions`` versions stay for readers that have begun.

    Until the pointer is there, everyone reads the version before; a commit that fails on the way leaves only files that the next one overwrites. Of
    two commits at once, the later one fails on its pointer.
    """
    spark = docs.sparkSession
    at = current_version(spark, path)
    old = spark.read.parquet(f"{path}/version-{at}")
    upsert(old, docs, key, order).select(*old.columns).write.mode("overwrite").parquet(f"{path}/version-{at + 1}")
    hp = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = hp(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.create(hp(f"{path}/current-{at + 1}"), False).close()
    for n in range(max(0, at + 2 - 2 * versions), at + 2 - versions):
        fs.delete(hp(f"{path}/current-{n}"), False)
        fs.delete(hp(f"{path}/version-{n}"), True)
    return read_index(spark, path)


def bulk_lines(docs: DataFrame, index: str, key: str = "_id") -> DataFrame:
    """The lines of a bulk request: for each document its action and its source, without null fields."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col(key).alias("_id")).alias("index")))
    source = F.to_json(F.struct(*[c for c in docs.columns if c != key]), {"ignoreNullFields": "true"})
    return docs.select(F.explode(F.array(action, source)).alias("value"))


def numbered(docs: DataFrame, *order: str) -> DataFrame:
    """``docs`` with load_seq from 0 in a total order, for sources without one of their own: places in sorted ranges and the counts of the ranges before."""
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = cut(docs.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_row")))
    before = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a range
    return d.join(F.broadcast(before), "_part").select(*docs.columns, (F.col("_row") + F.col("_before")).alias("load_seq"))


def health(spark: SparkSession, path: str) -> dict:
    """What answers at ``path``: name of the application, whether there is an index, its version."""
    there = exists(spark, f"{path}/current-*")
    return {"name": spark.sparkContext.appName, "found": there, "version": current_version(spark, path) if there else None}
