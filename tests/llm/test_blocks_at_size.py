"""Near duplicates of a large corpus: blocks don't grow by chance, texts that meet nothing stay where they are."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from corpusloom.llm import common, jaccard_join  # noqa: E402
from corpusloom.plans.lineage import cut  # noqa: E402
from plain import joined as brute, leaders  # noqa: E402


@pytest.fixture
def nothing_is_small(monkeypatch):
    for module in (common, jaccard_join):
        monkeypatch.setattr(module, "hinted", lambda df: df)


def chained(seed, n=60):
    """Texts of which each has a passage from the one before, a fifth of it, and near copies of some."""
    r = random.Random(seed)
    texts, last = [], []
    for i in range(n):
        words = [*last[-30:], *(f"w{i}x{j}" for j in range(r.randint(100, 140)))]
        texts.append(" ".join(words))
        if i % 7 == 0:
            texts.append(" ".join(words[:-2]))
        last = words
    return dict(enumerate(texts))


def blocks_of(monkeypatch):
    seen, own = [], jaccard_join.tile_links
    monkeypatch.setattr(jaccard_join, "tile_links", lambda blocks, *a: (seen.append(blocks.groupBy("block").count().select("count").toPandas()["count"].tolist()), own(blocks, *a))[1])
    return seen


def test_passages_do_not_chain_texts_into_one_block(spark, monkeypatch):
    texts, seen = chained(1), blocks_of(monkeypatch)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    _, component, _ = brute(texts, 5, 80, 100)
    got = jaccard_join.jaccard_components(docs, 5, 80, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == component
    assert seen == [[2] * 9]  # nine texts have a near copy


def test_many_sets_of_one_signature_lose_no_link(spark, monkeypatch):
    texts = chained(2, 20) | {100 + i: " ".join(["same"] * 3 + [f"v{i // 2}y{j}" for j in range(9)]) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    _, component, _ = brute(texts, 5, 80, 100)
    for most in (1, 3, 32):
        monkeypatch.setattr(jaccard_join.plausible_edges, "__defaults__", (most,))
        got = jaccard_join.jaccard_components(docs, 5, 80, 100).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == component


def test_of_nodes_with_a_signature_all_that_may_be_similar_are_connected(spark, monkeypatch):
    """The first is like none of the others; these are alike in pairs."""
    r = np.random.default_rng(3)
    sets = {1: np.unique(r.integers(0, 1 << 63, 100).astype(np.uint64))}
    for i in range(2, 12, 2):
        sets[i] = np.unique(r.integers(0, 1 << 63, 100).astype(np.uint64))
        sets[i + 1] = sets[i][2:]
    named = cut(spark.createDataFrame([(k, len(h), jaccard_join.sketch(h)) for k, h in sets.items()], "node long, n_shingles long, sketch binary"))
    met = cut(spark.createDataFrame([(s, k, 1) for s in (7, 8) for k in sets if k > 1], "signature long, node long, first long"))
    pairs = {(i + 1, i) for i in range(2, 12, 2)}
    for most in (32, 10, 9):
        got = {tuple(x) for x in jaccard_join.plausible_edges(met, named, 80, 100, most).collect()}
        assert got == (pairs if most >= 10 else {(k, 1) for k in sets if k > 1})


def test_sketches_never_rule_out_similar_sets():
    r = np.random.default_rng(5)
    told = 0
    for _ in range(2000):
        a = np.unique(common.mix(r.integers(0, 1 << 63, int(r.integers(1, 600))).astype(np.uint64)))
        b = np.unique(np.concatenate([a[r.random(len(a)) < r.random() ** 0.2], common.mix(r.integers(0, 1 << 63, int(r.integers(0, 1 + len(a) // 4))).astype(np.uint64))]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        x, y = jaccard_join.sketch(a, 256 if r.random() < 0.3 else 1 << 16), jaccard_join.sketch(b)
        assert jaccard_join.differing(x, y) == jaccard_join.differing(y, x) <= len(a) + len(b) - 2 * both
        similar = 100 * both >= 80 * (len(a) + len(b) - both)
        assert jaccard_join.may_be_similar(len(a), x, len(b), y, 80, 100) or not similar
        told += similar
    assert 200 < told < 1900


def test_large_joins_leave_rows_without_a_match_in_place(spark, nothing_is_small):
    rows = spark.range(-5000, 45_000).select(F.col("id").alias("doc id"), F.col("id").cast("string").alias("bits")).union(spark.sql("select null, 'null'"))
    ids = cut(spark.range(-100, 60_000, 40).withColumnRenamed("id", "one"))
    want = {i for i in range(-100, 45_000, 40)}
    for how, out in (("left_semi", want), ("left_anti", {None, *range(-5000, 45_000)} - want), ("inner", want)):
        got = [r["doc id"] for r in common.joined(rows, "doc id", ids, how).collect()]
        assert len(got) == len(out) and set(got) == out
    near = common.sifted(rows, "doc id", ids, "left_semi")
    assert len(want) <= near.count() < 0.15 * 50_000
    assert near.count() + common.sifted(rows, "doc id", ids, "left_anti").count() == 50_001
    assert "Exchange hashpartitioning(doc id" not in near._jdf.queryExecution().executedPlan().toString()
    crowded = common.joined(rows, "doc id", cut(spark.range(0, 45_000).withColumnRenamed("id", "one")), "left_anti")
    assert crowded.count() == 5001


@pytest.mark.parametrize("copies", [1, 6])
def test_deduplicate_shuffles_only_rows_that_may_be_gone(spark, nothing_is_small, copies):
    texts = {k * 1000 + i: t for k in range(copies) for i, t in chained(4).items()} | {None: "a b", 7001: None, 7002: ""}
    docs = cut(spark.createDataFrame([(i, t, "de") for i, t in texts.items()], "doc_id long, text string, lang string"))
    kept = jaccard_join.deduplicate(docs)
    assert kept.columns == docs.columns
    _, _, links = brute({i: t for i, t in texts.items() if i is not None}, 5, 80, 100)
    first = leaders([i for i in texts if i is not None], links)
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(got, key=str) == sorted([None, *(i for i in texts if i is not None and first[i] == i)], key=str)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan and "Union" in plan
