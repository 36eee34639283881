"""Forms of halves, by which misspellings are found."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusloom.functions.text import halved, halves
from corpusloom.operators import search


def edited(w: str, rnd: random.Random) -> str:
    i, k = rnd.randrange(len(w) + 1), rnd.randrange(4)
    if k == 0 or not w:
        return w[:i] + rnd.choice("abcé") + w[i:]
    i = min(i, len(w) - 1)
    if k == 1:
        return w[:i] + w[i + 1 :]
    if k == 2 or len(w) < 2:
        return w[:i] + rnd.choice("abcé") + w[i + 1 :]
    i = min(i, len(w) - 2)
    return w[:i] + w[i + 1] + w[i] + w[i + 2 :]


def test_words_within_two_edits_share_a_form(spark):
    rnd = random.Random(5)
    pairs = []
    for _ in range(6000):
        w = "".join(rnd.choice("abcé") for _ in range(rnd.randrange(14)))
        one = edited(w, rnd)
        pairs += [(w, one, 1), (w, edited(one, rnd), 2), (w, w, 0)]
    df = spark.createDataFrame(pairs, "term string, token string, edits int").select("*", halved(F.col("token")).alias("forms"))
    for r in df.collect():
        assert set(halves(r["term"], r["edits"])) & set(r["forms"]), r
        assert len(r["forms"]) <= 11


def test_forms_are_made_once_for_each_token(spark):
    """The same words in many documents: the join's rows follow the vocabulary, not the documents."""
    once = spark.createDataFrame([("text", w) for w in ("licence", "licenes", "far", "lisence")], "field string, token string")
    many = once.crossJoin(spark.range(500).select()).select("field", "token")
    plan = search.fuzzy_terms(many, ["licence"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.index("Generate"), "tokens are counted before they are taken apart"
    a, b = (sorted(map(tuple, search.fuzzy_terms(v, ["licence"]).collect())) for v in (once, many))
    assert a == b and [r[2] for r in a] == ["licence", "licenes", "lisence"]
