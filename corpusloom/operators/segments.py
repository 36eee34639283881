"""A search index of immutable segments, with deletions, merging by size, and pruned queries.

A commit writes one segment and, for rows that it replaces or deletes, marks in those before; a manifest file publishes it. A segment has the documents' words
(``forward``, by ranges of the id) and their postings in blocks (``blocks``, by bucket of the token): those of one token in one cell, a run of CELL documents by id, or fewer if they have more
than LONG words. A block's head has its greatest frequency and its least length, which bound what it can add to a score; heads are columns of their own, so a query reads them without the postings.

Texts are dealt into ranges of the id before they are split into words, so they are split once. Words of a batch are counted together. A task inverts the words of the ranges that it reads by AT_ONCE bytes, many cells together, and so holds no more of them; neither words nor postings are shuffled.

The blocks of a query's terms meet by cell, so the sum of their bounds bounds the scores of the cell. A query scores the cells of the greatest bounds first, and so knows a score that
the last hit has at least. Blocks of cells whose bound stays below it are not read. Hits are the same as without pruning.

Numbers of documents, lengths and document frequencies leave deleted documents out, so scores are those of an index made anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.search import B, K1, best_fields, field_tokens, top
from corpusloom.plans.lineage import bounded, cut, delete, exists, list_paths, read_text, setting, write_text

CELL, LONG, AT_ONCE = 128, 1 << 20, 32 << 20
WORDS = "array<struct<token:string,tf:bigint>>"
FORWARD = f"doc_id long, field string, length long, words {WORDS}, slot int"
BLOCKS = "field string, token string, cell long, n int, most_tf long, least_length long, ids array<bigint>, tfs array<bigint>, lengths array<bigint>, bucket int"
MARKS = "segment string, doc_id long"
MINUS = "segment string, field string, token string, df long, bucket int"


def few(rows: DataFrame, n: int) -> DataFrame:
    """A hint for the ``n`` keys of a join: sent to all tasks if they are few; else hashed in their partition, so that the other side's words are not sorted."""
    return bounded(rows, n, 200_000) if n <= 200_000 else rows.hint("shuffle_hash")


def ranks(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in order, and the place there of each word."""
    found = words.dictionary_encode()
    order = pc.sort_indices(found.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return found.dictionary.take(order), rank[found.indices.to_numpy(zero_copy_only=False)]


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, field, length, words) of rows (doc_id, field, tokens): what search.counted() gives, for all rows of a batch at once."""
    for batch in batches:
        sizes = pc.list_value_length(batch["tokens"]).to_numpy(zero_copy_only=False).astype(np.int64)
        tokens, codes = ranks(batch["tokens"].flatten())
        n = max(1, len(tokens))
        found, tfs = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + codes, return_counts=True)
        ends = np.concatenate([[0], np.cumsum(np.bincount(found // n, minlength=len(sizes)))]).astype(np.int32)
        words = pa.StructArray.from_arrays([tokens.take(pa.array(found % n)), pa.array(tfs.astype(np.int64))], ["token", "tf"])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["field"], pa.array(sizes), pa.ListArray.from_arrays(ends, words)], ["doc_id", "field", "length", "words"])


def cell_ends(lengths: list[int], most: int, last: bool) -> list[int]:
    """Where the full cells of a field's rows end, and with ``last`` that of the rest, too."""
    ends, at, words = [], 0, 0
    for i, n in enumerate(lengths):
        if i > at and (i - at == CELL or words + n > most):
            ends.append(i)
            at, words = i, 0
        words += n
    return [*ends, len(lengths)] if last and at < len(lengths) else ends


def blocks_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's rows (doc_id, field, length, words); a cell is a run of rows of one field as they come, with ``most`` words if they are several. Cells of differing tasks have differing numbers.

    Blocks come by field, token and cell for every AT_ONCE bytes of words; rows that fill no cell wait for the next ones.
    """
    number, waiting, size = TaskContext.get().partitionId() << 33, [], 0

    def full(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal number, waiting
        rows, waiting = pa.concat_tables(waiting), []
        for f in sorted(pc.unique(rows["field"]).to_pylist()):
            own = rows.filter(pc.equal(rows["field"], f))
            ends = cell_ends(own["length"].to_pylist(), most, last)
            end = ends[-1] if ends else 0
            waiting += [own.slice(end)] if end < len(own) else []
            if ends:
                yield from inverted(own.slice(0, end), ends, number)
                number += len(ends)

    for batch in batches:
        waiting.append(pa.Table.from_batches([batch]))
        size += batch.nbytes
        if size >= AT_ONCE:
            yield from full(False)
            size = 0
    if waiting:
        yield from full(True)


def inverted(rows: pa.Table, ends: list[int], first: int) -> list[pa.RecordBatch]:
    """Blocks of the cells of one field's rows, which end at ``ends`` and are numbered from ``first``: one for each token and cell, in this order; postings by id."""
    words = rows["words"].combine_chunks()
    each, sizes = words.flatten(), pc.list_value_length(words).to_numpy(zero_copy_only=False)
    if not len(each):
        return []
    ids, lengths, cell = rows["doc_id"].to_numpy(), rows["length"].to_numpy(), np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
    place = np.empty(len(ids), np.int64)
    place[np.lexsort((ids, cell))] = np.arange(len(ids))
    tokens, codes = ranks(pc.struct_field(each, "token"))
    row = np.repeat(np.arange(len(ids)), sizes)
    at = np.argsort(codes * len(ids) + place[row])  # by token, cell and id
    codes, row = codes[at], row[at]
    of = cell[row]
    starts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])]))
    bounds = np.append(starts, len(at)).astype(np.int32)
    tfs, ids, lengths = pc.struct_field(each, "tf").to_numpy(zero_copy_only=False)[at], ids[row], lengths[row]
    heads = [pa.array(np.diff(bounds)), pa.array(np.maximum.reduceat(tfs, starts)), pa.array(np.minimum.reduceat(lengths, starts))]
    lists = [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (ids, tfs, lengths)]
    columns = [pa.repeat(rows["field"][0], len(starts)), tokens.take(pa.array(codes[starts])), pa.array(first + of[starts]), *heads, *lists]
    return pa.table(columns, [c.split()[0] for c in BLOCKS.split(", ")[:-1]]).to_batches(1 << 16)


@dataclass
class Segment:
    """What the manifest knows of a segment: numbers by field, of all its documents and of the deleted ones, and the tables of its deletions."""

    name: str
    docs: int
    fields: dict[str, list[int]]  # documents and their length
    deleted: int = 0
    gone: dict[str, list[int]] = field(default_factory=dict)
    marks: list[str] = field(default_factory=list)

    @property
    def live(self) -> int:
        return self.docs - self.deleted


@dataclass
class Plan:
    """What a query has found out before it reads postings: heads with their bound, and the score that the last hit has at least."""

    heads: DataFrame
    at_least: float
    segments: list[Segment]

    def read(self) -> DataFrame:
        return self.heads.where(F.col("bound") >= self.at_least - 1e-9 * max(1.0, abs(self.at_least)))

    def counts(self) -> dict[str, int]:
        """Blocks of the query's terms, and those that have to be read."""
        return {"blocks": self.heads.count(), "read": self.read().count()}


class SegmentedIndex:
    """An index under ``path``. One writer at a time; of two commits at once the later one fails on its manifest. Readers keep the version they opened."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, slots: int = 16):
        self.spark, self.path, self.buckets, self.slots = spark, path, buckets, slots
        self.version, self.segments = 0, []
        found = [int(p.rpartition("-")[2]) for p in list_paths(spark, f"{path}/commit-*")]
        if found:
            self.version = max(found)
            state = json.loads(read_text(spark, f"{path}/commit-{self.version}"))
            self.buckets, self.slots, self.segments = state["buckets"], state["slots"], [Segment(**s) for s in state["segments"]]

    # ---- writing ----
    def commit(self, docs: DataFrame | None, fields: list[str] = (), key: str = "doc_id", deletes: DataFrame | None = None, order: str | None = None) -> SegmentedIndex:
        """The next version: ``docs`` in place of those with the same key, without the keys of ``deletes`` (a column doc_id). Keys of ``docs`` are unique, or their last by ``order`` counts.

        Null texts have no words. Rows without a key can't be found again and are refused. The new version is not there before its manifest is.
        """
        name = f"segment-{uuid.uuid4().hex}"
        if docs is not None:
            if order is not None:
                docs = docs.groupBy(key).agg(F.max_by(F.struct(*[c for c in docs.columns if c != key]), order).alias("_row")).select(key, "_row.*")
            texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), *fields)
            words = field_tokens(self._ranges(texts), list(fields))
            new = self._write(name, words.mapInArrow(counted_words, FORWARD.rpartition(",")[0]))
        else:
            new = None
        keys = None
        if new is not None:
            keys = self._forward([new]).select("doc_id").distinct()
        if deletes is not None:
            gone = deletes.select(F.col("doc_id").cast("long").alias("doc_id"))
            keys = gone if keys is None else keys.union(gone)
        old = self._mark(keys) if keys is not None else self.segments
        return self._publish([*old, *([new] if new and new.docs else [])])

    def merge(self, fan: int = 4, into_one: bool = False) -> SegmentedIndex:
        """The next version, with ``fan`` or more segments of one size class (powers of ``fan``) made one, or all of them, their deleted documents dropped. Texts are not split again."""
        classes: dict[int, list[Segment]] = {}
        for s in self.segments:
            size, k = max(1, s.live), 0
            while size >= fan:
                size, k = size // fan, k + 1
            classes.setdefault(0 if into_one else k, []).append(s)
        least = 1 if into_one else fan
        kept = [s for c in classes.values() if len(c) < least for s in c]
        made = []
        for group in (c for c in classes.values() if len(c) >= least):
            new = self._write(f"segment-{uuid.uuid4().hex}", self._ranges(self.live_words(group).drop("segment")))
            made += [new] if new.docs else []
        return self._publish([*kept, *made]) if made or len(kept) < len(self.segments) else self

    def vacuum(self) -> None:
        """Delete files of versions before this one; readers of those can't go on."""
        keep = {s.name for s in self.segments} | {m for s in self.segments for m in s.marks}
        for p in list_paths(self.spark, f"{self.path}/*"):
            name = p.rpartition("/")[2]
            if name not in keep and name != f"commit-{self.version}":
                delete(self.spark, p)

    def _ranges(self, rows: DataFrame) -> DataFrame:
        """Rows in ranges of doc_id, each by doc_id."""
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")

    def _write(self, name: str, rows: DataFrame) -> Segment:
        """A segment of ``rows`` (doc_id, field, length, words) of _ranges(): forward first, each range in one slot, and postings from what was written."""
        at = f"{self.path}/{name}"
        rows.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(self.slots))).write.partitionBy("slot").parquet(f"{at}/forward")
        found = self._table(f"{name}/forward", "slot", FORWARD)
        totals = found.groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.sum("length").alias("length")).collect()  # a row for each field
        most = LONG
        b = found.select("doc_id", "field", "length", "words").mapInArrow(lambda batches: blocks_of(batches, most), BLOCKS.rpartition(",")[0])
        b = b.withColumn("bucket", self._bucket()).sortWithinPartitions("bucket")  # which leaves blocks of a bucket in their order
        with setting(self.spark, "spark.sql.files.maxPartitionBytes", "16m"):  # of compressed words, so that a task sorts its blocks in memory
            b.write.partitionBy("bucket").option("parquet.block.size", 8 << 20).parquet(f"{at}/blocks")
        return Segment(name, max([r["docs"] for r in totals], default=0), {r["field"]: [r["docs"], r["length"]] for r in totals})

    def _bucket(self) -> Column:
        return F.pmod(F.hash("token"), F.lit(self.buckets)).cast("int")

    def _mark(self, keys: DataFrame) -> list[Segment]:
        """The segments with the live documents among ``keys`` marked as deleted; only the words of these are read again, to take them off the counts."""
        if not self.segments:
            return []
        name = f"marks-{uuid.uuid4().hex}"
        ids = self._live(self._forward(self.segments).select("segment", "doc_id")).distinct()
        found = cut(ids.join(keys.distinct(), "doc_id", "left_semi").select("segment", "doc_id"))
        hit = cut(self.live_words(self.segments).join(few(found, found.count()), ["segment", "doc_id"], "left_semi"))
        totals = hit.groupBy("segment", "field").agg(F.count(F.lit(1)).alias("docs"), F.sum("length").alias("length")).collect()  # a row for each segment and field
        if not totals:
            return self.segments
        found.write.parquet(f"{self.path}/{name}/docs")
        minus = hit.select("segment", "field", F.explode("words.token").alias("token")).groupBy("segment", "field", "token").agg(F.count(F.lit(1)).alias("df"))
        minus.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/minus")
        out = []
        for s in self.segments:
            own = {r["field"]: (r["docs"], r["length"]) for r in totals if r["segment"] == s.name}
            if own:
                gone = {f: [a + b for a, b in zip(s.gone.get(f, [0, 0]), own.get(f, (0, 0)))] for f in s.fields}
                s = Segment(s.name, s.docs, s.fields, s.deleted + max(d for d, _ in own.values()), gone, [*s.marks, name])
            out.append(s)
        return [s for s in out if s.live]

    def _publish(self, segments: list[Segment]) -> SegmentedIndex:
        state = {"buckets": self.buckets, "slots": self.slots, "segments": [vars(s) for s in segments]}
        write_text(self.spark, f"{self.path}/commit-{self.version + 1}", json.dumps(state))
        return SegmentedIndex(self.spark, self.path)

    # ---- reading ----
    def _table(self, name: str, by: str, schema: str) -> DataFrame:
        """A table written in parts; one of no rows has none."""
        there = exists(self.spark, f"{self.path}/{name}/{by}=*")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def _all(self, segments: list[Segment], name: str, by: str, schema: str) -> DataFrame:
        out = None
        for s in segments:
            one = self._table(f"{s.name}/{name}", by, schema).withColumn("segment", F.lit(s.name))
            out = one if out is None else out.union(one)
        return out if out is not None else self.spark.createDataFrame([], schema).withColumn("segment", F.lit(""))

    def _forward(self, segments: list[Segment]) -> DataFrame:
        return self._all(segments, "forward", "slot", FORWARD).drop("slot")

    def _marks(self, segments: list[Segment]) -> DataFrame:
        """(segment, doc_id) of deleted documents, as a hint to send them to all tasks where they are few."""
        names = sorted({m for s in segments for m in s.marks})
        found = self.spark.read.schema(MARKS).parquet(*[f"{self.path}/{m}/docs" for m in names]) if names else self.spark.createDataFrame([], MARKS)
        return few(found.where(F.col("segment").isin([s.name for s in segments])), sum(s.deleted for s in segments))

    def live_words(self, segments: list[Segment] | None = None) -> DataFrame:
        """(doc_id, field, length, words, segment) of the documents that are not deleted."""
        segments = self.segments if segments is None else segments
        return self._live(self._forward(segments), segments).select("doc_id", "field", "length", "words", "segment")

    def _live(self, rows: DataFrame, segments: list[Segment] | None = None) -> DataFrame:
        """Rows (segment, doc_id, ...) of documents that are not deleted; nothing is joined where no segment has a deletion."""
        segments = self.segments if segments is None else segments
        return rows.join(self._marks(segments), ["segment", "doc_id"], "left_anti") if any(s.marks for s in segments) else rows

    def stats(self) -> dict[str, int]:
        return {"version": self.version, "segments": len(self.segments), "docs": sum(s.live for s in self.segments), "deleted": sum(s.deleted for s in self.segments)}

    def frequencies(self, pairs: DataFrame) -> DataFrame:
        """(field, token, df) of a bounded table of (field, token), deleted documents left out."""
        heads = self._heads(pairs).groupBy("field", "token").agg(F.sum("n").alias("n"))
        names = sorted({m for s in self.segments for m in s.marks})
        minus = None
        for m in names:
            one = self._table(f"{m}/minus", "bucket", MINUS)
            minus = one if minus is None else minus.union(one)
        if minus is None:
            return heads.select("field", "token", F.col("n").alias("df"))
        live = [s.name for s in self.segments]
        minus = minus.where(F.col("segment").isin(live)).join(F.broadcast(pairs), ["field", "token"], "left_semi").groupBy("field", "token").agg(F.sum("df").alias("minus"))
        return heads.join(F.broadcast(minus), ["field", "token"], "left").select("field", "token", (F.col("n") - F.coalesce("minus", F.lit(0))).alias("df"))

    def _heads(self, pairs: DataFrame) -> DataFrame:
        """Heads of the blocks of a bounded table (field, token); the postings are not among the columns."""
        words = [r["token"] for r in pairs.select("token").distinct().collect()]  # a query's terms, with their typos
        of = sorted({r["b"] for r in self.spark.createDataFrame([(w,) for w in words], "token string").select(self._bucket().alias("b")).collect()})
        rows = self._all(self.segments, "blocks", "bucket", BLOCKS).where(F.col("bucket").isin(of) & F.col("token").isin(words))
        return rows.select("segment", "bucket", "field", "token", "cell", "n", "most_tf", "least_length").join(F.broadcast(pairs), ["field", "token"], "left_semi")

    def _totals(self) -> dict[str, tuple[int, float]]:
        """Documents and mean length of each field."""
        out = {}
        for f in sorted({f for s in self.segments for f in s.fields}):
            docs, length = (sum(s.fields.get(f, [0, 0])[k] - s.gone.get(f, [0, 0])[k] for s in self.segments) for k in (0, 1))
            out[f] = (docs, length / docs if docs else 0.0)
        return out

    def plan(self, pairs: DataFrame, boosts: dict[str, float], size: int, k1: float = K1, b: float = B) -> Plan:
        """Bounds of all blocks of the terms ``pairs`` (field, token; bounded), and a score that ``size`` live documents reach."""
        pairs = cut(pairs.select("field", "token").distinct())
        totals = [(f, n, m, float(boosts[f])) for f, (n, m) in self._totals().items() if f in boosts]
        fields = self.spark.createDataFrame(totals, "field string, docs long, mean double, boost double")
        weights = self.frequencies(pairs).join(F.broadcast(fields), "field").where("df > 0")
        weights = cut(weights.select("field", "token", "mean", (F.col("boost") * F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("weight")))
        part = lambda tf, length: F.col("weight") * tf / (tf + k1 * (1 - b + b * length / F.col("mean")))
        heads = self._heads(pairs).join(F.broadcast(weights), ["field", "token"]).withColumn("own", part(F.col("most_tf"), F.col("least_length")))
        heads = cut(heads.withColumn("bound", F.sum("own").over(Window.partitionBy("segment", "field", "cell"))))  # of a cell as many rows as terms
        cells = heads.groupBy("segment", "field", "cell").agg(F.max("bound").alias("top"), F.max("n").alias("n")).orderBy(F.desc("top"), "segment", "field", "cell").limit(8 + 2 * size)
        seeds = cut(heads.join(F.broadcast(cells.select("segment", "field", "cell")), ["segment", "field", "cell"], "left_semi"))
        known = top(best_fields(self._scores(seeds, k1, b), dict.fromkeys(boosts, 1.0)), size).select("_score").collect()  # of some fields alone, so they have as much at least
        return Plan(heads, min(r["_score"] for r in known) if len(known) == size else float("-inf"), self.segments)

    def _scores(self, heads: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
        """(doc_id, field, score), boosted, of the live documents in these blocks, which are cut: a semi-join by head, pushed down as the tokens and buckets they are of."""
        of = heads.select("bucket", "token").distinct().collect()  # a query's terms
        rows = self._all(self.segments, "blocks", "bucket", BLOCKS).where(F.col("bucket").isin(sorted({r["bucket"] for r in of})) & F.col("token").isin(sorted({r["token"] for r in of})))
        on = ["segment", "field", "token", "cell"]
        wanted = bounded(heads.select(*on, "weight", "mean"), heads.count(), 200_000)
        rows = rows.select(*on, "ids", "tfs", "lengths").join(wanted, on)
        p = rows.select("segment", "field", "weight", "mean", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("x")).select("segment", "field", "weight", "mean", F.col("x.ids").alias("doc_id"), F.col("x.tfs").alias("tf"), F.col("x.lengths").alias("length"))
        p = self._live(p)
        part = F.col("weight") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        return p.groupBy("doc_id", "field").agg(F.sum(part).alias("score"))

    def search(self, terms: list[str] | DataFrame, boosts: dict[str, float], size: int = 50) -> DataFrame:
        """(doc_id, _score): the ``size`` best by their best boosted field, then by id; blocks that can't hold one of them are not scored.

        ``terms``: tokens, or a bounded table (field, token). An index without documents, and terms that none has, give no hits.
        """
        if isinstance(terms, list):
            terms = self.spark.createDataFrame([(f, t) for f in boosts for t in dict.fromkeys(terms)], "field string, token string")
        p = self.plan(terms, boosts, size)
        return top(best_fields(self._scores(cut(p.read())), dict.fromkeys(boosts, 1.0)), size)
