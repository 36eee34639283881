"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics are computed where the text lies. The trees are fitted with numpy on a bounded sample of labelled rows
(``most_rows``, chosen by a hash of the id, so the choice doesn't depend on partitions), flattened into arrays and
applied to whole batches: every tree level is one vectorised gather.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import release, tidy

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "punct", "symbol", "space", "non_ascii", "distinct_words", "top_word",
    "repeats", "distinct_pairs", "lines", "line_length", "distinct_lines", "symbol_ends", "lone_symbols", "entropy", "shouts", "stops", "longest_word",
)
PUNCT, SYMBOLS = b".,;:?'\"()-", b"!#$%&*+/<=>@[\\]^_`{|}~"


def statistics(text: str | None) -> list[float]:
    """The values named in FEATURES; zeros for a null or empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    n, by = len(raw), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    m = max(len(words), 1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = by[by > 0] / n
    repeats = sum(map(bytes.__eq__, words[1:], words[:-1]))
    ends = sum(w[-1] in SYMBOLS for w in words)
    upper = int(by[65:91].sum())
    return [
        np.log1p(n), np.log1p(len(words)), (n - by[32]) / m, upper / n, by[48:58].sum() / n, by[list(PUNCT)].sum() / n, by[list(SYMBOLS)].sum() / n, (by[32] + by[9:14].sum()) / n, by[128:].sum() / n,
        len(counts) / m, max(counts.values(), default=0) / m, repeats / m, len(set(zip(words[1:], words[:-1]))) / m, np.log1p(len(lines)), np.log1p(n / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1),
        ends / m, sum(counts.get(bytes([c]), 0) for c in SYMBOLS) / m, float(-(p * np.log2(p)).sum()), upper / max(1, by[97:123].sum() + upper), by[46] / m, np.log1p(max(map(len, words), default=0)),
    ]


@dataclass
class Trees:
    """Complete binary trees in arrays: inner node i has children 2i+1 and 2i+2; value holds the leaves of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 48, rate: float = 0.15, l2: float = 2.0, least: int = 10) -> Trees:
    """Boosting with logistic loss; splits are sought on histograms of gradients over quantile bins. Without rows of both labels the score is constant."""
    n, d = x.shape
    base = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    raw = np.full(n, np.log(base / (1 - base)))
    out = Trees(np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)), float(np.log(base / (1 - base))), depth)
    if not n or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    for k in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h, node = p - y, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            best, cut_at = np.full(width, 1e-6), np.full(width, -1)
            which = np.zeros(width, np.int64)
            for j in range(d):
                key = node * (bins + 1) + b[j]
                size = width * (bins + 1)
                gs, hs, cs = (np.bincount(key, w, size).reshape(width, -1).cumsum(1) for w in (g, h, None))
                gl, hl, cl, gt, ht, ct = gs, hs, cs, gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain = np.where((cl >= least) & (ct - cl >= least), gain, 0)[:, : len(edges[j])]
                if gain.shape[1]:
                    at = gain.argmax(1)
                    won = gain[np.arange(width), at]
                    better = won > best
                    best, which, cut_at = np.where(better, won, best), np.where(better, j, which), np.where(better, at, cut_at)
            for i in range(width):
                if cut_at[i] >= 0:
                    out.feature[k, first + i], out.threshold[k, first + i] = which[i], edges[which[i]][cut_at[i]]
            node = 2 * node + ((cut_at[node] >= 0) & (b[which[node], np.arange(n)] > cut_at[node]))
        gs, hs = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
        out.value[k] = -rate * gs / (hs + l2)
        raw += out.value[k][node]
    return out


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; fold 0 is held out from learning."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 12_000) -> Trees:
    """Fit on at most ``most_rows`` labelled documents outside fold 0. Their ids are few by that bound, so they are broadcast.

    Rows that repeat a doc_id count once, by the least of their statistics, before anything comes to the driver.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(fold() != 0).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": pd.Series([statistics(t) for t in b["text"]], index=b.index, dtype=object)})

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInPandas(tidy(run), "doc_id long, y double, x array<double>")
    rows = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("x").alias("x")).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit(x, rows["y"].to_numpy(float))


def score(docs: DataFrame, trees: Trees, at_least: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= at_least). Columns of these names are replaced; keep() leaves them alone.

    Null and empty texts get the score of all-zero statistics. Equal texts have equal scores.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(trees.score(np.array([statistics(t) for t in b], float).reshape(len(b), len(FEATURES))))
        release()

    return docs.withColumn("score", run("text")).withColumn("predicted", (F.col("score") >= at_least).cast("int"))


def keep(docs: DataFrame, trees: Trees, at_least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text has a score of ``at_least``, with all columns as they are, whatever their names."""
    whole = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = score(whole, trees, at_least).where("predicted = 1")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def quality_scores(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null and empty texts have the score of all-zero statistics; repeated rows give repeated results, equal texts equal scores; empty tables give
    an empty result; other columns are not read, whatever their names. A text's statistics are those of all of it, however long.
    """
    trees = train(docs, labels, most_rows=most_rows)
    return score(docs.select("doc_id", "text"), trees).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")
