"""The pipeline's stages, each on what the one before it kept, against plain versions."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from corpusloom.llm import quality_gbdt  # noqa: E402
from plain import all_spans, joined, redacted  # noqa: E402

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
CLASHES = "score predicted row kept text_ _key _spans spans key block node rep signature cls salt rank doc_tokens offset sequence_id".split()


def good_by_hand(docs, labels):
    """doc_ids that the trees, walked one by one, give 0.3 or more."""
    learnt = {d: y for d, y in labels.items() if zlib.crc32(str(d).encode()) % 5 and d in docs}
    ids = sorted(learnt)
    trees = quality_gbdt.fit(np.array([quality_gbdt.statistics(docs[i]) for i in ids], float).reshape(len(ids), -1), np.array([learnt[i] for i in ids], float))

    def score(text):
        x, z = quality_gbdt.statistics(text), trees.base
        for f, c, v in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if x[f[node]] > c[node] else 1)
            z += v[node - len(f)]
        return 1 / (1 + np.exp(-z))

    return {i for i, t in docs.items() if score(t) >= 0.3}


def test_run_equals_the_stages_by_hand(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in table.collect()]
    copy = max(rows, key=lambda r: len(r[1]))
    words = copy[1].split(" ")
    words[len(words) // 2] = "changed"
    rows += [(9001, copy[1], "en", "s", len(copy[1])), (9002, " ".join(words), "en", "s", 1), (9003, None, None, None, None), (9004, "", "en", "s", 0)]
    spark.createDataFrame(rows, table.schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = {r[0]: r[1] for r in rows}
    docs = {i: docs[i] for i in good_by_hand(docs, {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] is not None})}
    _, component, _ = joined(docs, 5, 80, 100)
    docs = {i: t for i, t in docs.items() if component[i] == i}
    assert copy[0] not in docs or not {9001, 9002} & set(docs)
    spans = all_spans(docs.values())
    docs = {i: t if t is None else redacted(t, base + added) for (i, t), (base, added) in zip(docs.items(), spans)}
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, t in docs.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, at, len(p := ids[at : at + 2048]), zlib.crc32(p.tobytes()), len(ids)) for at in range(0, len(ids), 2048)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got} == want and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1].tolist() and sum(n for _, n in parts) <= 2048


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_a_stage_keeps_columns_of_any_name(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    wide = docs.select("*", *[F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in CLASHES], F.lit(1).alias("a.b"))
    plain, got = STAGES[name](spark, docs, SF), STAGES[name](spark, wide, SF)
    if name == "packing":
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
        return
    assert got.columns == wide.columns and got.where(" or ".join(f"`{c}` <> concat('{c}-', doc_id)" for c in CLASHES)).count() == 0
    assert sorted(map(str, got.select(docs.columns).collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_a_stage_takes_nulls_repeats_and_nothing(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "no id at all", "en", "s", 12), (7001, None, "en", "s", 0), (7002, "", "en", "s", 0), (7003, "same words in a row", "en", "s", 19), (7003, "same words in a row", "en", "s", 19), (7004, "long words " * 20000, "en", "s", 1)], docs.schema)
    got = STAGES[name](spark, docs.union(odd), SF).collect()
    ids = [r["doc_id"] for r in got]
    if name == "packing":
        assert ids.count(None) == 2 and ids.count(7001) == ids.count(7002) == 1 and ids.count(7003) == 2 and ids.count(7004) > 10
    elif name != "quality":
        assert ids.count(None) == 2 and all(ids.count(i) == n for i, n in ((7001, 1), (7002, 1), (7003, 2), (7004, 1)))
    assert STAGES[name](spark, docs.limit(0), SF).count() == 0


def test_stages_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, kept = docs.count(), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        kept[name] = docs.count()
    assert n > kept["quality"] > kept["near_duplicates"] == kept["personal_data"] > 0.5 * n
    assert docs.where("text like '%@mail_.example.com%'").count() == 0


def test_clean_labelled_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    assert docs.join(good, "doc_id", "left_semi").join(kept.select("doc_id"), "doc_id", "left_anti").count() <= 0.03 * good.count()
