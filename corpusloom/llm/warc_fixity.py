"""WARC records and a Merkle audit of replicas.

Records lie in files in an order; their digests are hashed, by ranges of offsets, into a tree per file. Two
replicas are compared from the roots: only branches that differ are followed down, so the comparison moves a few
digests unless much is damaged. The records of differing ranges are then matched by their ids, so that a record whose length has
changed is one damaged record, although all behind it have moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import hinted
from corpusloom.plans.lineage import cut

END, FIRST_LINE = "\r\n\r\n", "WARC/1.1\r\n"
SHIFTS = (16, 20)  # offset ranges of 64 KiB and 1 MiB under the root of a file
DATE = "2020-01-01T00:00:00Z"


def record_id(page_id: Column, url: Column) -> Column:
    """A urn:uuid made of the page's id and url, so that replicas name a record alike whatever has become of its body."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def record(page_id: Column, url: Column, body: Column, date: str = DATE) -> Column:
    """A resource record as text, without the empty lines that end it. Null urls and bodies count as empty."""
    named = record_id(page_id, url)
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    head = (FIRST_LINE + "WARC-Type: resource\r\nWARC-Record-ID: <", named, ">\r\nWARC-Target-URI: ", url, f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha256:", F.sha2(body, 256), "\r\nContent-Type: text/html\r\nContent-Length: ", F.octet_length(body).cast("string"), "\r\n\r\n", body)
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in head])


def placed(pages: DataFrame, records_per_file: int, *extra: Column) -> DataFrame:
    """page_id, record_id, length, sha256, ``extra``, file and place ``at`` of every page's record, in the order of page_id, url and record digest.

    Places come from sorted ranges and the counts of the ranges before.
    """
    r = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), record_id(F.col("page_id"), F.col("url")).alias("record_id"), (F.octet_length(r) + len(END)).cast("long").alias("length"), F.sha2(r, 256).alias("sha256"), *extra)
    order = [F.asc_nulls_first("page_id"), F.asc("url"), F.asc("sha256")]
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row")))
    before = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a range
    rows = rows.join(F.broadcast(before), "part").withColumn("at", F.col("row") + F.col("before"))
    return rows.withColumn("file", F.floor(F.col("at") / records_per_file).cast("string"))


def laid_out(pages: DataFrame, records_per_file: int = 1024) -> DataFrame:
    """page_id, file, offset, length, record_id, sha256 of every page's record, as write_warc() puts them.

    Offsets are summed within a file, whose records are bounded.
    """
    offset = F.sum("length").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return placed(pages, records_per_file).select("page_id", "file", F.coalesce(offset, F.lit(0)).alias("offset"), "length", "record_id", "sha256")


def write_warc(pages: DataFrame, path: str, records_per_file: int = 1024) -> None:
    """WARC files of the pages' records, one in each folder ``path``/file=N, in the layout of laid_out()."""
    rows = placed(pages, records_per_file, record(F.col("page_id"), F.col("url"), F.col("html")).alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "at").select("file", "value").write.partitionBy("file").option("lineSep", END).text(path)


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """The files under ``path`` parted before every WARC/1.1 line that follows an empty one: file (its name below ``path``), block and nr (their order), raw.

    Files are read in splits, so a task holds no whole file; compressed ones are read whole, as a stream. Mostly a part is a record, but a body may hold such lines, too.
    """
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jpath).toString()
    lines = spark.read.option("lineSep", END + FIRST_LINE).option("recursiveFileLookup", "true").text(path)
    name = F.regexp_replace(F.substring("_metadata.file_path", F.length(F.lit(root)) + 2, F.lit(1 << 20)), "^file=([^/]*)/part-[^/]*$", "$1")
    return lines.select(name.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nr"), F.col("value").cast("binary").alias("raw"))


def _whole(raw: bytes) -> bytes:
    first = FIRST_LINE.encode()
    return raw if raw.startswith(first) else first + raw


def _head(whole: bytes) -> tuple[int | None, str | None, str | None, int]:
    """What a record's head says: its length without the empty lines behind it, id, url; and where its body begins."""
    end = whole.find(END.encode())
    fields = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(b":") for x in whole[:end].split(b"\r\n")[1:]) if colon} if end >= 0 else {}
    text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
    size = fields.get(b"content-length", b"")
    return end + 4 + int(size) if size.isdigit() else None, (text(b"warc-record-id") or "").strip("<>") or None, text(b"warc-target-uri"), end + 4


def read_warc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """file, offset, length (with the empty lines behind it), record_id, url, sha256 (without them) and, with ``bodies``, body of every record under ``path``.

    A record takes its Content-Length, whatever its body holds. A part without a readable head is a record without an id. Bodies are binary
    and travel only if asked for. A file's table of parts, without their bytes, is walked in order by one task.
    """
    kept = "record_id string, url string, sha256 string, body binary"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file, block, nr, raw in zip(b["file"], b["block"], b["nr"], b["raw"]):
                whole = _whole(raw)
                need, named, url, at = _head(whole)
                body = whole[at:need] if bodies and need is not None else None
                out.append((file, block, nr, len(whole), need, named, url, hashlib.sha256(whole[:need]).hexdigest(), body))
            yield pd.DataFrame(out, columns=["file", "block", "nr", "size", "need", "record_id", "url", "sha256", "body"]).astype({"need": "Int64"})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out, offset, until, start, length = [], 0, 0, 0, 0
        for file, block, nr, size, need in pdf.sort_values(["block", "nr"])[["file", "block", "nr", "size", "need"]].itertuples(index=False):
            first = offset >= until
            if first:
                start, length = offset, (size if pd.isna(need) else int(need)) + len(END)
                until = start + length
            out.append((file, block, nr, start, length, first, first and length <= size + len(END)))
            offset += size + len(END)
        return pd.DataFrame(out, columns=["file", "block", "nr", "offset", "length", "first", "alone"])

    def put_together(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "nr"])
        whole = END.encode().join(map(_whole, pdf["raw"]))
        need, named, url, at = _head(whole)
        whole = whole[:need]
        return pd.DataFrame({"file": pdf["file"].iloc[:1], "offset": pdf["offset"].iloc[:1], "length": pdf["length"].iloc[:1], "record_id": [named], "url": [url], "sha256": [hashlib.sha256(whole).hexdigest()], "body": [whole[at:] if bodies else None]})

    key, raw = ["file", "block", "nr"], fragments(spark, path)
    parts = raw.mapInPandas(parse, f"file string, block long, nr long, size long, need long, {kept}")
    light = cut(parts.drop("body"))
    walked = cut(light.groupBy("file").applyInPandas(walk, "file string, block long, nr long, offset long, length long, first boolean, alone boolean"))
    rows = (parts if bodies else light.withColumn("body", F.lit(None).cast("binary"))).join(walked.where("alone").select(*key, "offset", "length"), key)
    rows = rows.select("file", "offset", "length", "record_id", "url", "sha256", "body")
    broken = walked.where("not alone")
    if not broken.isEmpty():
        rows = rows.union(raw.join(hinted(broken), key).groupBy("file", "offset").applyInPandas(put_together, f"file string, offset long, length long, {kept}"))
    return rows if bodies else rows.drop("body")


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels from the leaves (file, range, digest) to the roots; a digest covers its children's with their places, in order."""
    levels = [leaves.select("file", F.col("offset").alias("range"), F.sha2(F.concat_ws(":", "length", "record_id", "sha256"), 256).alias("digest"))]
    for k, shift in enumerate((*SHIFTS, 62)):
        below = levels[-1].withColumn("up", F.shiftright("range", shift - (SHIFTS[k - 1] if k else 0)))
        children = F.transform(F.array_sort(F.collect_list(F.struct("range", "digest"))), lambda x: F.concat_ws(":", x["range"], x["digest"]))
        levels.append(below.groupBy("file", "up").agg(F.sha2(F.array_join(children, ","), 256).alias("digest")).withColumnRenamed("up", "range"))
    return levels


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, offset, here, there) of the places at which two replicas differ, found from the roots down; whether ``left`` and ``right`` have a record there."""
    a, b = [[cut(x) for x in tree(t)] for t in (left, right)]
    shifts = (*SHIFTS, 62)
    follow = None
    for level in range(len(a) - 1, -1, -1):
        x, y = a[level], b[level]
        if follow is not None:
            up = F.shiftright("range", shifts[level] - (shifts[level - 1] if level else 0))
            marked = hinted(follow)
            x, y = (t.withColumn("up", up).join(marked, ["file", "up"], "left_semi").drop("up") for t in (x, y))
        both = x.withColumnRenamed("digest", "l").join(y.withColumnRenamed("digest", "r"), ["file", "range"], "full").where("not l <=> r")
        follow = cut(both.select("file", F.col("range").alias("up"), F.col("l").isNotNull().alias("here"), F.col("r").isNotNull().alias("there")))
        if level:
            follow = follow.select("file", "up")
    return follow.withColumnRenamed("up", "offset")


def damage(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, offset, of_left, status): the records of ``left`` that are altered or missing in ``right``, and the extra ones of ``right``.

    Within a file the records at differing places are matched by id and digest, in order: these have only moved; then by id alone: these are altered.
    """
    places = hinted(differing(left, right))
    pick = lambda t, side: t.join(places.where(side).select("file", "offset"), ["file", "offset"], "left_semi").select("file", "offset", F.coalesce("record_id", F.lit("")).alias("record_id"), "sha256")
    a, b = pick(left, "here"), pick(right, "there")

    def matched(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
        nth = lambda t, side: t.select("*", F.row_number().over(Window.partitionBy(*by).orderBy("offset")).alias("nth"), F.lit(True).alias(side))
        x = nth(a, "in_left").withColumnRenamed("offset", "offset_left").select(*by, "nth", "offset_left", "in_left", *(c for c in ("sha256",) if c not in by))
        y = nth(b, "in_right").withColumnRenamed("offset", "offset_right").select(*by, "nth", "offset_right", "in_right", *(F.col(c).alias(f"{c}_right") for c in ("sha256",) if c not in by))
        return x.join(y, [*by, "nth"], "full")

    moved = cut(matched(a, b, "file", "record_id", "sha256"))
    rest_a = moved.where("in_right is null").select("file", F.col("offset_left").alias("offset"), "record_id", "sha256")
    rest_b = moved.where("in_left is null").select("file", F.col("offset_right").alias("offset"), "record_id", "sha256")
    m = matched(rest_a, rest_b, "file", "record_id")
    return m.select("file", F.coalesce("offset_left", "offset_right").alias("offset"), F.col("in_left").isNotNull().alias("of_left"), F.when(F.col("in_left").isNull(), "extra").when(F.col("in_right").isNull(), "missing").otherwise("altered").alias("status"))


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every record of ``left`` with status: intact (also at another offset), altered or missing in the replica ``right``; and the extra ones of ``right``.

    Both have file, offset, length, record_id, sha256, as laid_out() and read_warc() give them; other columns of ``left`` stay and are null for extra
    records where ``right`` lacks them. Both are read more than once. Empty tables give an empty result; equal records are matched in order.
    """
    found = hinted(cut(damage(left, right)))
    mine = left.join(found.where("of_left").select("file", "offset", "status"), ["file", "offset"], "left").withColumn("status", F.coalesce("status", F.lit("intact")))
    extra = right.join(found.where("not of_left").select("file", "offset", "status"), ["file", "offset"])
    columns = [*left.columns, "status"]
    return mine.select(*columns).unionByName(extra.select(*[c for c in columns if c in extra.columns]), allowMissingColumns=True)


def fixity_audit(pages: DataFrame, replica: DataFrame, lost: Column) -> DataFrame:
    """Audit of the records of ``replica`` (pages of its own), without those where ``lost`` holds on its layout, against the records of ``pages``.

    Null urls and bodies count as empty; repeated rows are records of their own; very long bodies are hashed where they lie and don't travel;
    other columns are not read, whatever their names; an empty table gives an empty result.
    """
    right = laid_out(replica).where(~F.coalesce(lost, F.lit(False)))
    return audit(cut(laid_out(pages)), cut(right))
