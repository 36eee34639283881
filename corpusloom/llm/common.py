"""Helpers shared by the training-data operators: connected components, bounded broadcasts, word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.lineage import cut, discard


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of at most about ``size``, so that a worker holds few of the long documents at once.

    Results are lazy, so the setting has to outlive the call: it stays for the session. One that the user has made is kept.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("67108864b", None):  # the default
        spark.conf.set(key, size)


def tidy(run: Callable) -> Callable:
    """A partition function that gives freed memory back to the system when a partition ends: workers live on beside the next stage's."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_name(wanted: str, *tables: DataFrame) -> str:
    """``wanted``, with underscores before it until no column of ``tables`` has that name in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """Connected components of undirected ``edges`` (src, dst long): rows (node, component), component the least node.

    Alternating large-star and small-star rounds; every round is a few partial aggregations and equi-joins, so no
    neighbour list is ever gathered. Each round is cut, the tables of the one before are deleted, and the loop ends when all edges
    point at a root. Nodes without an edge are absent; an empty input gives an empty result; null ends are no edges. Rounds grow with the
    logarithm of the nodes; with ``most_rounds`` a RuntimeError tells that they were not enough, unfinished labels are never returned.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u > v").distinct()
    e = cut(e)
    for done in count():
        inner = e.join(e.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        many = inner or e.groupBy("u").count().where("count > 1").limit(1).count()
        if not many:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        if done == most_rounds:
            raise RuntimeError(f"components are not complete after {most_rounds} rounds")
        both = e.union(e.select("v", "u"))
        # from a table, so that the join can split the rows of a root that many nodes point at
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        discard(e, low)
        e = new


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered up to a bound."""

    most = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of ``text`` (A-Z lower-cased, split at ASCII white space) in order."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of hashes don't keep their structure."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; with fewer words the whole sequence is one; none without words."""
    if not len(words):
        return np.empty(0, np.uint64)
    k = min(n, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + words[i : len(words) - k + 1 + i])
    return np.unique(h)


def hinted(df: DataFrame, most_rows: int = 200_000, most_bytes: int = 16 << 20) -> DataFrame:
    """A broadcast hint if ``df``, which should be cut, has at most ``most_rows`` rows and ``most_bytes`` bytes; otherwise ``df``, for a shuffled join."""
    if df.count() > most_rows:
        return df
    size = df.agg(F.sum(32 + F.length(F.to_json(F.struct(*df.columns)))).alias("n")).first()["n"]
    return F.broadcast(df) if (size or 0) <= most_bytes else df


def sifted(rows: DataFrame, key: str, ids: DataFrame, how: str, most: int = 16_384) -> DataFrame:
    """``rows`` whose ``key`` (long) may be among the ``ids`` (one column; left_semi) or is surely not (left_anti), without shuffling rows.

    A bit for each of as many values of the key's hash as 16 times the ids, in bitmaps of 4 KB, ``most`` of them, is sent to all tasks; about one key in 16 that
    isn't among the ids finds its bit set, more beyond ``most``.
    """
    many = min(most, ids.count() // 2048 + 1)
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(many * 32_768))
    low, at, bits = free_name("low", rows), free_name("at", rows), free_name("bits", rows)
    place = bit(F.col(f"`{ids.columns[0]}`"))
    maps = ids.select(F.floor(place / 32_768).cast("int").alias(at), (place % 32_768).alias(low)).groupBy(at).agg(F.bitmap_construct_agg(low).alias(bits))
    place = bit(F.col(f"`{key}`"))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(place % 32_768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (place % 8).cast("int")) == 1
    return rows.join(F.broadcast(maps), (F.floor(place / 32_768).cast("int") == F.col(at)) & is_set, how)


def joined(rows: DataFrame, key: str, by: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner, left_semi or left_anti) on ``key`` (long) with ``by``, a cut whose first column is the key's counterpart; no row with a null key has one.

    A ``by`` that is too large to broadcast moves only those rows that its bitmaps don't rule out; texts of all others stay where they are.
    """
    first = by.columns[0]
    on = key if key == first else F.col(f"`{key}`") == F.col(f"`{first}`")
    sent = hinted(by)
    if sent is not by:
        return rows.join(sent, on, how)
    ids = by.select(F.col(f"`{first}`"))
    near = sifted(rows, key, ids, "left_semi").join(by.hint("shuffle_hash"), on, how)
    return sifted(rows, key, ids, "left_anti").union(near) if how == "left_anti" else near


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the symmetric boolean matrix ``links``: fewer than its rows, whatever the number of links."""
    left, out = links.any(1), []
    while left.any():
        root = int(left.argmax())
        left[root] = False
        todo = [root]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(links[at] & left)
            left[new] = False
            out += [(at, int(i)) for i in new]
            todo += new.tolist()
    return out
