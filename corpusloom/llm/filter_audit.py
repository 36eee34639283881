"""How filters interact: what each removes in every order, from one pass over the texts.

Every document is reduced to the set of filters that it fails, a mask. Documents are counted by part and mask, at most 32 cells a part. A walk over the
subsets of filters in Gray-code order switches one filter at a time: each cell counts its active failures, and the running number of survivors
changes by the cells that go from none to one, or back. The 32 states of a part then give every step of every order as a difference of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.values import let
from corpusloom.plans.lineage import cut

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at one text: 1 under 100 words, 2 few distinct words, 4 many capitals, 8 odd characters."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    counts = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    of_words = let(counts, lambda c: F.when(c["n"] < 100, 1).otherwise(0) + F.when(100 * c["distinct"] < 80 * c["n"], 2).otherwise(0))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return of_words + F.when(100 * capitals > 10 * F.length(text), 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of every row: text_failures(), and 16 if a smaller doc_id has the same text anywhere in the table.

    Texts stay where they are; their digests travel. A text with any number of copies is reduced to its least doc_id before it is shuffled, and rows
    meet that by doc_id and digest, so the copies are not gathered. Rows without a doc_id fail no such comparison.
    """
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")))
    named = rows.where("doc_id is not null")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    seen = named.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(16)).alias("mask"))
    return seen.union(rows.where("doc_id is null").select("doc_id", "part", "mask"))


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask, those of good quality and the toxic ones. A doc_id with several labels is good, or toxic, if any says so."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    named = failed.where("doc_id is not null").join(marks, F.col("doc_id") == F.col("_labelled"), "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rows = named.union(failed.where("doc_id is null").select("part", "mask", F.lit(0), F.lit(0)))
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))


def walk(masks: np.ndarray, counts: np.ndarray, filters: int = len(FILTERS)) -> np.ndarray:
    """Survivors of every subset of filters: row s of the result has the sums of ``counts`` over the cells that fail none of s.

    Subsets come in Gray-code order, one filter switched at a time.
    """
    active = np.zeros(len(masks), np.int64)  # of each cell, how many of the filters that are on it fails
    alive = counts.sum(0)
    states = np.zeros((1 << filters, counts.shape[1]), np.int64)
    states[0] = alive
    on = 0
    for step in range(1, 1 << filters):
        f = (step & -step).bit_length() - 1
        fails = (masks >> f & 1).astype(bool)
        on ^= 1 << f
        if on >> f & 1:
            alive = alive - counts[fails & (active == 0)].sum(0)
            active[fails] += 1
        else:
            active[fails] -= 1
            alive = alive + counts[fails & (active == 0)].sum(0)
        states[on] = alive
    return states


def steps(part: str, states: np.ndarray, masks: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Rows of AUDIT: all steps of all orders of a part, as differences of its states."""
    n = len(FILTERS)
    fails = [int(counts[masks >> f & 1 == 1, 0].sum()) for f in range(n)]
    alone = [int(counts[masks == 1 << f, 0].sum()) for f in range(n)]
    lost = lambda s, f: states[s] - states[s | 1 << f]
    # over all orders, f comes right after the filters of s in |s|! (n - 1 - |s|)! of them
    shapley = [sum(factorial(k := s.bit_count()) * factorial(n - 1 - k) * int(lost(s, f)[0]) for s in range(1 << n) if not s >> f & 1) for f in range(n)]
    out = []
    for order in permutations(range(n)):
        s, name = 0, "".join(FILTERS[f] for f in order)
        for k, f in enumerate(order, 1):
            gone = lost(s, f).tolist()
            s |= 1 << f
            out.append((part, name, k, int(states[s][0]), gone[0], fails[f] - gone[0], alone[f], gone[1], gone[2], shapley[f]))
    return out


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Rows of AUDIT for every value of ``part`` among ``docs``, with 120 orders of 5 steps each.

    Null texts count as empty, null parts as an empty string; repeated rows count each, and rows that repeat a doc_id are not copies of a smaller one. An empty
    table gives an empty result; other columns are not read, whatever their names. Very long texts are one row each. A part's cells are 32 at most.
    """
    of_part = cells(failures(docs, part), labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in AUDIT.split(", ")]
        for b in batches:
            for name, found in zip(b["part"], b["cells"]):
                table = np.array([[c["mask"], c["n"], c["good"], c["toxic"]] for c in found], np.int64)
                masks, counts = table[:, 0], table[:, 1:]
                yield pd.DataFrame(steps(name, walk(masks, counts), masks, counts), columns=names)

    return of_part.mapInPandas(run, AUDIT)
