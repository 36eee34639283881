"""Words and blocks of a segment are made for many rows at once, as search.counted() and a plain inversion give them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.operators import search, segments


def test_words_are_counted_by_batches(spark, tmp_path):
    texts = ["b a b", "", None, "ß Straße straße 日本 日本", "x" * 100_000, "?!", " ".join(f"w{i % 7}" for i in range(5000)), "É é \U0001d4d0  z"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, title string, body string")
    index = segments.SegmentedIndex(spark, str(tmp_path), 2, 2).commit(docs, ["title", "body"])
    words = search.field_tokens(docs, ["title", "body"])
    plan = index.live_words().drop("segment")
    want = words.select("doc_id", "field", F.size("tokens").cast("long").alias("length"), search.counted(F.col("tokens")).alias("words"))
    assert sorted(map(repr, plan.collect())) == sorted(map(repr, want.collect()))
    assert segments.SegmentedIndex(spark, str(tmp_path / "n"), 2, 2).commit(docs.where("doc_id in (1, 2, 5)"), ["title"]).stats()["docs"] == 3


def sizes_and_heads(spark, rows, at_once):
    """Rows of each batch of blocks, and their (field, token, cell) as they come, of one task."""

    def run(batches):
        before, segments.AT_ONCE = segments.AT_ONCE, at_once  # of a worker, which other tests use, too
        blocks = list(segments.blocks_of(batches, 1 << 20))
        segments.AT_ONCE = before
        for b in blocks:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "heads": [[f"{f} {t} {c:05}" for f, t, c in zip(*(b[k].to_pylist() for k in ("field", "token", "cell")))]]})

    found = rows.coalesce(1).mapInArrow(run, "rows long, heads array<string>").collect()
    return [r["rows"] for r in found], [h for r in found for h in r["heads"]]


def test_cells_are_inverted_together(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(F.concat(F.lit("w"), (F.col("id") * 7 + i) % 50).alias("token"), (i + 1).alias("tf")))
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("field"), F.lit(55).cast("long").alias("length"), words.cast(segments.WORDS).alias("words"))
    sizes, heads = sizes_and_heads(spark, rows, 32 << 20)
    assert len(heads) == 50 * 40 and len(sizes) <= 2, "a batch for each of two fields, not for each of 40 cells"
    assert heads == sorted(heads), "so that only the bucket is sorted by"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        many, again = sizes_and_heads(spark, rows, 1 << 14)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(many) > 10 and len(again) == len(set(again)) == len(heads), "what is held is bounded by bytes; cells are as many"
