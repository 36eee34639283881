"""SimHash document fingerprints and an exact search within a Hamming radius.

Terms are the words and word triples of a text and, the fewer its words the heavier, its runs of four bytes; each votes with its weight for or against every bit. A search within
radius r cuts the bits into blocks and lets each differ in so many bits that two fingerprints within r keep to that in one
block at least: one table per block, probed with every such change of the block's bits, finds all of them.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WordHashes, hinted, mix
from corpusloom.plans.lineage import cut

BITS = 128
SIZES = ((1, 1.0), (3, 3.0))
FEW_WORDS = 24
NEAR = 20  # texts with five-word Jaccard of 0.8 differ in up to so many bits
SLICE, PORTION, MOST_KEY = 1 << 14, 1 << 19, 22


def fingerprint(text: str | None, hashes: WordHashes, sizes: tuple[tuple[int, float], ...] = SIZES) -> np.ndarray:
    """BITS / 8 bytes. A text of fewer than four bytes and no words has all bits unset; so have bits with equal votes."""
    words = hashes.of(text)
    terms, weights = [], []
    for n, weight in sizes:
        if len(words) >= n:
            h = np.full(len(words) - n + 1, n, np.uint64)
            for i in range(n):
                h = mix(h * np.uint64(0x2545F4914F6CDD1D) + words[i : len(words) - n + 1 + i])
            u, times = np.unique(h, return_counts=True)
            terms.append(u)
            weights.append((weight * (1 + np.log(times))).astype(np.float32))
    few = max(0.0, 1 - len(words) / FEW_WORDS)  # fades out: a word more or less doesn't change the terms at once
    if few and len(raw := (text or "").encode("utf-8", "surrogatepass")) >= 4:
        u, times = np.unique(np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), 4) @ (256 ** np.arange(4, dtype=np.uint64)), return_counts=True)
        terms.append(mix(u))
        weights.append((few * (1 + np.log(times))).astype(np.float32))
    if not terms:
        return np.zeros(BITS // 8, np.uint8)
    h, w = np.concatenate(terms), np.concatenate(weights)
    votes = np.zeros(BITS, np.float64)
    for i in range(0, len(h), 4096):
        part = h[i : i + 4096]
        both = np.stack([mix(part + np.uint64(j)) for j in range(BITS // 64)], axis=1)
        votes += w[i : i + 4096] @ np.unpackbits(both.view(np.uint8).reshape(len(part), -1), axis=1).astype(np.float32)
    return np.packbits(votes * 2 > w.sum(dtype=np.float64) + 1e-6 * len(w))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1 - int(np.bitwise_count(a ^ b).sum()) / BITS


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def in_descending_order(docs: DataFrame, range_bytes: int = 64 << 20) -> DataFrame:
    """(part, copied, doc_id, text): rows dealt into ranges of doc_id, each sorted downwards, with a copy of the next range's first row at its end.

    Ranges hold about ``range_bytes`` of text, whatever the table's size. The range after the last is the first, so the last row is followed
    by the first one. Null ids come last.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = d.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    ends = sorted({float(x) for x in d.approxQuantile("doc_id", [i / parts for i in range(1, parts)], max(1 / (4 * parts), 1e-5))}) or [0.0]
    # the number of ends up to an id, by binary search; as doubles ids keep their order, equal ones share a range
    key = d.withColumn("key", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    ranged = Bucketizer(splits=[float("-inf"), *ends, float("inf")], inputCol="key", outputCol="range").transform(key)
    d = ranged.select(F.lit(len(ends)).cast("int").alias("last"), "doc_id", "text", "range").select((F.col("last") - F.col("range")).cast("int").alias("part"), "doc_id", "text")
    heads = cut(d.groupBy("part").agg(F.max("doc_id").alias("head")).where("head is not null"))  # one row a range
    order = Window.orderBy("part")
    turn = F.coalesce(F.lag("part").over(order), F.last("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    before = hinted(cut(heads.select(F.col("head").alias("doc_id"), turn.alias("before"))))
    to = F.concat(F.array(F.struct("part", F.lit(0).alias("copied"))), F.when(F.col("before").isNotNull(), F.array(F.struct(F.col("before").alias("part"), F.lit(1).alias("copied")))).otherwise(F.array().cast("array<struct<part:int,copied:int>>")))
    d = d.join(before, "doc_id", "left").select(F.explode(to).alias("to"), "doc_id", "text").select("to.part", "to.copied", "doc_id", "text")
    return d.repartition(len(ends) + 1, "part").sortWithinPartitions("part", "copied", F.desc_nulls_last("doc_id"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    The edited text has its last third replaced by the beginning of the next document's, by descending doc_id. Null texts
    count as empty (likeness of two texts without words is 1); a single document follows itself. Repeated ids give
    repeated results, in any order among themselves; other columns are not read, whatever their names; an empty table gives an empty
    result. A very long text's votes are added up in runs of terms.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, last = WordHashes(), None
        for b in batches:
            out = []
            for part, copied, doc_id, text in zip(b["part"], b["copied"], b["doc_id"], b["text"]):
                fp = fingerprint(text, hashes)
                if last and last[0] == part:
                    out.append(result(*last[1:], text, fp, hashes))
                last = None if copied else (part, doc_id, text, fp)
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def result(doc_id, text, fp, following, next_fp, hashes) -> tuple:
        changed = edited(text, following)
        efp = fingerprint(changed, hashes)
        return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), fp.tobytes().hex(), efp.tobytes().hex(), likeness(fp, efp), likeness(fp, next_fp)

    return in_descending_order(docs).mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def plan(radius: int, rows: int, cols: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, most differing bits) of the blocks with the least expected work; empty if comparing all pairs is less.

    If the bits allowed in the blocks, each plus one, sum to radius + 1, two fingerprints within ``radius`` keep to them in one block at least.
    """
    best, least = [], 4.0 * cols
    for m in range(1, min(radius + 1, BITS) + 1):
        blocks = split(radius, m)
        cost = sum(math.comb(w, k) * (14 + 40 * cols / 2**w + 20_000 / min(rows, SLICE)) for _, w, t in blocks for k in range(t + 1)) + sum(4 * 2**w / rows for _, w, _ in blocks)
        if cost < least:
            best, least = blocks, cost
    return best


def split(radius: int, m: int) -> list[tuple[int, int, int]]:
    widths = [BITS // m + (k < BITS % m) for k in range(m)]
    starts = np.cumsum([0, *widths]).tolist()
    # a block's first MOST_KEY bits differ in no more places than the block does, so shorter keys lose nothing
    return [(at, min(w, MOST_KEY), (radius + 1 - m) // m + (k < (radius + 1 - m) % m)) for k, (at, w) in enumerate(zip(starts, widths))]


def bits_of(prints: np.ndarray, at: int, width: int) -> np.ndarray:
    """Bits ``at`` to ``at + width`` (fewer than 64), from the first, of rows of two 64-bit halves."""
    end, keep = at + width, np.uint64((1 << width) - 1)
    if end <= 64:
        return (prints[:, 0] >> np.uint64(64 - end)) & keep
    if at >= 64:
        return (prints[:, 1] >> np.uint64(128 - end)) & keep
    return ((prints[:, 0] << np.uint64(end - 64)) | (prints[:, 1] >> np.uint64(128 - end))) & keep


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, blocks: list[tuple[int, int, int]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and of ``b`` (two 64-bit halves each) within ``radius`` bits, every pair once, in portions of bounded size."""
    if not len(a) or not len(b):
        return
    blocks = plan(radius, len(a), len(b)) if blocks is None else blocks
    if not blocks:
        step = max(1, PORTION // len(b))
        for at in range(0, len(a), step):
            part = a[at : at + step]
            apart = np.bitwise_count(part[:, :1] ^ b[None, :, 0]) + np.bitwise_count(part[:, 1:] ^ b[None, :, 1])
            i, j = np.nonzero(apart <= radius)
            yield i + at, j
        return
    for k, (first, width, most) in enumerate(blocks):
        key_a, key_b = bits_of(a, first, width).astype(np.int32), bits_of(b, first, width).astype(np.int32)
        order_a, order_b = np.argsort(key_a), np.argsort(key_b)  # sorted, so that probes with one mask lie side by side
        key_a, (high, low) = key_a[order_a], np.ascontiguousarray(b[order_b].T)
        starts = np.zeros(2**width + 1, np.int32)
        np.cumsum(np.bincount(key_b, minlength=2**width), out=starts[1:])
        masks = [sum(1 << i for i in c) for n in range(most + 1) for c in itertools.combinations(range(width), n)]
        for at in range(0, len(a), SLICE):
            keys, ids = key_a[at : at + SLICE], order_a[at : at + SLICE]
            my_high, my_low = np.ascontiguousarray(a[ids].T)
            for mask in masks:
                probe = keys ^ np.int32(mask)
                from_ = starts.take(probe)
                probe += 1
                times = starts.take(probe) - from_
                met = np.flatnonzero(times)
                times = times.take(met)
                ends = np.cumsum(times, dtype=np.int64)
                shift = from_.take(met) + times - ends  # place in b less place among the candidates
                done = i = 0
                while i < len(met):
                    to = max(i + 1, int(np.searchsorted(ends, done + PORTION, "right")))
                    rows = np.repeat(met[i:to], times[i:to])
                    cols = np.arange(done, int(ends[to - 1])) + np.repeat(shift[i:to], times[i:to])
                    done, i = int(ends[to - 1]), to
                    x = my_high.take(rows) ^ high.take(cols)
                    ok = np.flatnonzero(np.bitwise_count(x) <= radius)
                    rows, cols = rows.take(ok), cols.take(ok)
                    x = np.stack([x.take(ok), my_low.take(rows) ^ low.take(cols)], axis=1)
                    new = np.bitwise_count(x[:, 0]) + np.bitwise_count(x[:, 1]) <= radius
                    rows, cols, x = rows[new], cols[new], x[new]
                    for f, w, m in blocks[:k] if len(x) else ():  # found in an earlier table already
                        new = np.bitwise_count(bits_of(x, f, w)) > m
                        rows, cols, x = rows[new], cols[new], x[new]
                    if len(x):
                        yield ids[rows], order_b[cols]


def within_radius(prints: DataFrame, radius: int, tile: int = 1 << 20) -> DataFrame:
    """(fingerprint, n_near): for each distinct fingerprint, how many rows have another fingerprint within ``radius``.

    ``prints``: fingerprint (hex string), n (rows that have it), one row each. Fingerprints without such rows are absent.
    Fingerprints are dealt out by hash in parts of about ``tile``, and each pair of parts is one group, searched by close_pairs();
    groups are of equal size whatever the fingerprints, and return sums, not pairs.
    """
    known = prints.where("fingerprint is not null")
    total = known.count()
    q = max(-(-total // tile), min(6, -(-total // 8192)), 1)
    pairs = q * (q + 1) // 2
    word = lambda at: F.conv(F.substring("fingerprint", at, 8), 16, 10).cast("long")
    half = lambda at: F.shiftleft(word(at), 32).bitwiseOR(word(at + 8))
    dealt = known.select(half(1).alias("high"), half(17).alias("low"), "n", F.pmod(F.xxhash64("fingerprint"), F.lit(q)).cast("int").alias("mine")).select("*", F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("other"))
    dealt = dealt.select(F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "high", "low", "n")

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        raw = np.stack([pdf["high"].to_numpy(), pdf["low"].to_numpy()], axis=1).view(np.uint64)
        n, side, total = pdf["n"].to_numpy(), pdf["mine"].to_numpy(), np.zeros(len(pdf), np.int64)
        rows, cols = np.flatnonzero(side == i), np.flatnonzero(side == j)
        for r, c in close_pairs(raw[rows], raw[cols], radius):
            r, c = rows[r], cols[c]
            if i == j:
                r, c = r[r != c], c[r != c]
            np.add.at(total, r, n[c])
            if i != j:
                np.add.at(total, c, n[r])
        return pdf.loc[total > 0, ["high", "low"]].assign(n_near=total[total > 0])

    # a number of partitions of its own, so that small groups are not put into one task
    found = dealt.repartition(max(pairs, min(4 * pairs, 200)), "i", "j").groupBy("i", "j").applyInPandas(near, "high long, low long, n_near long")
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return found.groupBy("high", "low").agg(F.sum("n_near").alias("n_near")).select(F.concat(digits("high"), digits("low")).alias("fingerprint"), "n_near")


def fingerprint_report(docs: DataFrame, radius: int = 3) -> DataFrame:
    """fingerprints(), n_same (other documents with the same fingerprint) and n_near (those with another one within ``radius`` bits)."""
    found = cut(fingerprints(docs))
    prints = cut(found.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")))
    near = prints.join(within_radius(prints, radius), "fingerprint", "left").select("fingerprint", (F.col("n") - 1).alias("n_same"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
    return found.join(cut(near), "fingerprint").select(*found.columns, "n_same", "n_near")
