"""Packing of tokenised documents into sequences by cutting-stock column generation.

Documents longer than a sequence give whole sequences and one remainder. The remainders' length histogram (at most
``capacity / grid`` classes, whatever the input) goes to the driver, where a linear program over packing patterns is
solved: a knapsack dynamic program prices new patterns with the dual values until none improves. The solution is
rounded down, what is left is packed best-fit, and documents, ranked in their class, are dealt to the patterns' places.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import tidy
from corpusloom.plans.lineage import cut


@lru_cache(maxsize=2)
def byte_level_encoder(tokenizer_json: str):
    """The byte-level BPE of a tokenizer file, as an encoder of ordinary text, and its special tokens' ids."""
    import public_tokenizers

    spec = json.load(open(tokenizer_json, encoding="utf-8"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding("byte level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


#: White space so long that the encoder's own pattern would run out of stack on it.
LONG_SPACE = regex.compile(r"\p{White_Space}{2000,}+")


def encode(encoder: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a whole text. Very long white space is one pre-token, but for its last character where more text follows: it goes to the encoder by itself."""
    ids, done = [], 0
    for gap in LONG_SPACE.finditer(text):
        end = gap.end()
        if end < len(text) and not any(text.startswith(s, end) for s in encoder.special_tokens_set):
            end -= 1
        ids += encoder.encode(text[done : gap.start()], allowed_special="all")
        ids += encoder._encode_single_piece(text[gap.start() : end])
        done = end
    return ids + encoder.encode(text[done:], allowed_special="all")


def pieces(docs: DataFrame, tokenizer_json: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """Token pieces of every document: doc_id, start, length, ids_crc32, doc_tokens. Null texts count as empty; a document has at least its end id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_level_encoder(tokenizer_json)
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = np.array([*encode(encoder, text or ""), end_id], "<u4")
                out += [(doc_id, at, len(x := ids[at : at + capacity]), zlib.crc32(x.tobytes()), len(ids)) for at in range(0, len(ids), capacity)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming over the capacity: the most valuable pattern."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, v = sizes[order], value[order]
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = np.searchsorted(s, c, side="right")
        if k:
            x = best[c - s[:k]] + v[:k]
            if x[i := int(x.argmax())] > best[c] + 1e-12:
                best[c], took[c] = x[i], i
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[order[took[c]]] += 1
            c -= s[took[c]]
    return float(best[capacity]), counts


def inverted(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots. Plain loops of numpy: a threaded BLAS in the driver's process can stall after forks."""
    a, b = a.copy(), np.eye(len(a))
    for i in range(len(a)):
        j = i + int(np.abs(a[i:, i]).argmax())
        for x in (a, b):
            x[[i, j]] = x[[j, i]]
        by = a[i, i]
        a[i], b[i] = a[i] / by, b[i] / by
        f = a[:, i].copy()
        f[i] = 0
        b -= f[:, None] * b[i]
        a -= f[:, None] * a[i]
    return b


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-3, most_rounds: int = 4000) -> list[tuple[int, np.ndarray]]:
    """Patterns and how often each is used; together they hold exactly ``demand`` items of each size.

    The linear program ends within ``gap`` of the best bound: duals over the worth of the best column they find are feasible.
    """
    m = len(sizes)
    if not m:
        return []
    basis = [np.eye(m, dtype=np.int64)[i] * (capacity // sizes[i]) for i in range(m)]
    inverse = np.diag(1.0 / np.array([capacity // s for s in sizes], float))
    x = np.einsum("ij,j->i", inverse, demand)
    best, centre = 0.0, np.zeros(m)
    for k in range(most_rounds):
        dual = inverse.sum(0)
        for toward in (0.8, 0.0):  # pricing near the best duals so far steadies them; the plain ones when that finds no column
            value = toward * centre + (1 - toward) * dual if k else dual
            worth, column = best_pattern(sizes, np.maximum(value, 0), capacity)
            bound = float(demand @ np.maximum(value, 0)) / max(worth, 1.0)
            if bound > best:
                best, centre = bound, np.maximum(value, 0) / max(worth, 1.0)
            gain = float(column @ dual) - 1
            if gain > 1e-7:
                break
        if gain <= 1e-7 or x.sum() <= best * (1 + gap):
            break
        step = np.einsum("ij,j->i", inverse, column)
        ok = step > 1e-9
        ratio = np.where(ok, x / np.where(ok, step, 1), np.inf)
        leave = int(ratio.argmin())
        basis[leave] = column
        x = np.maximum(x - ratio[leave] * step, 0)
        x[leave] = ratio[leave]
        row = inverse[leave] / step[leave]
        inverse -= np.outer(step, row)
        inverse[leave] = row
        if k % 100 == 99:
            inverse = inverted(np.array(basis, float).T)
            x = np.maximum(np.einsum("ij,j->i", inverse, demand), 0)
    left, found = demand.astype(np.int64).copy(), []
    for p, times in sorted(zip(basis, x), key=lambda a: -a[1]):
        n = int(times + 1e-6)
        used = p > 0
        n = min(n, int((left[used] // p[used]).min()))
        if n > 0:
            found.append((n, p.copy()))
            left -= n * p
    order = np.argsort(-sizes)
    while left.any():  # fewer than one of each pattern is left
        p, room = np.zeros(m, np.int64), capacity
        for i in order:
            n = min(int(left[i]), room // int(sizes[i]))
            p[i], room = n, room - n * int(sizes[i])
        used = p > 0
        n = int((left[used] // p[used]).min())
        found.append((n, p))
        left -= n * p
    return found


def assign(found: DataFrame, capacity: int = 2048, grid: int = 8) -> DataFrame:
    """``found`` (rows with doc_id, start, length up to ``capacity``) with sequence_id and offset; its rows are read more than once.

    Ranks are counted within (class, salt) and shifted by the counts of the salts before, so no class is sorted by one task.
    Equal rows are interchangeable. An empty input gives an empty result.
    """
    spark = found.sparkSession
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    full = -(-capacity // grid) + 1
    cls = F.when(F.col("length") == capacity, full).otherwise(F.ceil(F.col("length") / grid)).cast("int")
    ties = [c for c in ("ids_crc32", "doc_tokens") if c in found.columns]  # repeated ids of different texts have one order, too
    rows = found.withColumn("cls", cls).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    counts = rows.groupBy("cls", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["cls"]: r["n"] for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}  # capacity / grid + 1 rows at most
    kinds = np.array(sorted(k for k in histogram if k != full), np.int64)
    patterns = cutting_stock(kinds, np.array([histogram[k] for k in kinds], np.int64), full - 1)
    places, first, at = [], 0, dict.fromkeys(map(int, kinds), 0)
    for times, p in patterns:
        for kind, a in zip(map(int, kinds), map(int, p)):
            if a:
                places.append((kind, at[kind], at[kind] + times * a, a, first))
                at[kind] += times * a
        first += times
    places.append((full, 0, histogram.get(full, 0), 1, first))
    places = spark.createDataFrame(places, "cls int, low long, high long, each long, first long")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("cls").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("cls", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cls", "salt").orderBy("doc_id", "start", *ties)) - 1).join(before, ["cls", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    # the places are bounded by classes times patterns, both at most capacity / grid
    placed = ranked.join(F.broadcast(places), "cls").where("rank >= low and rank < high").withColumn("sequence_id", F.expr("first + (rank - low) div each"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", *ties, "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select(*found.columns, "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = 2048, grid: int = 8) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences hold at most ``capacity`` tokens. Null texts count as empty; an empty table gives an empty result; other columns are not read,
    whatever their names. Repeated rows are packed each; pieces that are equal in all columns are interchangeable. A very long text gives
    as many whole sequences as it fills, and one remainder.
    """
    return assign(cut(pieces(docs, tokenizer_json, capacity=capacity)), capacity, grid)
