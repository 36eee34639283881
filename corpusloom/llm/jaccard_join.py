"""Exact similarity join of documents on word shingles: size-aware, heavy and light sets apart.

Light sets (small) enumerate all their subsets of the fixed sizes that a similar partner must share and meet in equal
subsets. Heavy sets (large) cut the hash space into more ranges than a similar partner can differ in and meet in an
equal range; shingles that many documents share are left out of it. The boundary is the size up to which enumeration costs less than the ranges. Of the sets
that meet, those stay together whose sketches (a bit or two for each shingle) don't rule out that they are similar; they, directly or by others, form
a block, so sets that share a passage don't chain a growing corpus into one. In a large block all sets are compared with one pivot first: those linked to it need not be compared with one
another. Then the inverted lists of all shingles are scanned, in tiles of bounded size, and exact overlaps decide. A tile returns a spanning
forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WordHashes, components, forest, free_name, hinted, joined, mix, release, shingles, sifted, tidy
from corpusloom.plans.lineage import cut, setting


def needed(r: int, s: int, num: int, den: int) -> int:
    """The least overlap of sets of sizes r and s with Jaccard similarity of num / den or more."""
    return -(-num * (r + s) // (num + den))


@lru_cache(maxsize=100_000)
def subset_sizes(r: int, num: int, den: int) -> tuple[int, ...]:
    """Sizes of the subsets that a set of r elements shares with similar sets."""
    return tuple(sorted({c for s in range(-(-num * r // den), den * r // num + 1) if (c := needed(r, s, num, den)) <= min(r, s)}))


def least_tokens(num: int, den: int) -> int:
    """Ranges with fewer elements are void: they'd be equal by chance too often. Below 0.84 there is no room for more than 1."""
    return 2 if 100 * num >= 84 * den else 1


@lru_cache(maxsize=100_000)
def ranges(bucket: int, num: int, den: int) -> tuple[int, int, int, np.ndarray]:
    """Least and greatest size of a bucket, how many void ranges a set may have, and the inner bounds of its ranges.

    Similar sets lie in the same or adjacent buckets. Two of them, none larger than the bucket's greatest size, differ in at most k
    elements, so of k + 1 + spare ranges 1 + spare agree at least.
    """
    low = 1
    for _ in range(bucket):
        low = den * low // num + 1
    high = den * low // num
    k = 2 * high * (den - num) // (num + den)
    spare = 2 + (k + 1) * (25 if least_tokens(num, den) > 1 else 18) // 100
    n = k + 1 + spare
    return low, high, spare, np.array([(i << 64) // n for i in range(1, n)], np.uint64)


@lru_cache(maxsize=100_000)
def bucket_of(r: int, num: int, den: int) -> int:
    b, low = 0, 1
    while r > den * low // num:
        low, b = den * low // num + 1, b + 1
    return b


@lru_cache(maxsize=16)
def boundary(num: int, den: int) -> int:
    """The largest size up to which enumerating subsets costs no more than twice the ranges."""
    r = 1
    while True:
        light = sum(comb(r + 1, c) for c in subset_sizes(r + 1, num, den))
        b = bucket_of(r + 1, num, den)
        heavy = sum(len(ranges(i, num, den)[3]) + 1 for i in (b, b + 1))
        if light > 2 * heavy or r >= 24:
            return r
        r += 1


def signatures(h: np.ndarray, num: int, den: int, common: np.ndarray | None = None) -> np.ndarray:
    """Hashes in which any two similar sets have one in common. ``h``: sorted distinct hashes; ``common``: sorted hashes of frequent elements.

    Leaving out the same elements everywhere never adds differences, so ranges are compared without the frequent ones. Of two similar
    sets of which one has at most ``spare`` void ranges, one range that isn't void agrees. Sets with more, made of frequent elements for
    the most part, give their whole ranges as well, and if too many of these are void, the void ones too.
    """
    r, light = len(h), boundary(num, den)
    out = []
    if r <= light:
        mixed = mix(h)
        total = mixed.sum(dtype=np.uint64)
        for c in subset_sizes(r, num, den):
            gone = list(combinations(range(r), r - c))
            left = np.full(len(gone), total) - (mixed[np.array(gone, np.int64)].sum(1, dtype=np.uint64) if r > c else np.zeros(1, np.uint64))
            out.append(mix(left + np.uint64(c)))
    if den * r // num > light:
        least, b = least_tokens(num, den), bucket_of(r, num, den)
        rare = h
        if common is not None and len(common):
            rare = h[common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h]
        for i in (b, b + 1):
            spare = ranges(i, num, den)[2]
            sig, n = _of_ranges(rare, i, num, den, 0)
            void = n < least
            out.append(sig[~void])
            if void.sum() > spare:
                sig, n = _of_ranges(h, i, num, den, 1)
                void = n < least
                out.append(sig if void.sum() > spare else sig[~void])
    return np.concatenate(out)


def _of_ranges(h: np.ndarray, bucket: int, num: int, den: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    bounds = ranges(bucket, num, den)[3]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h), dtype=np.uint64)])
    at = np.concatenate([[0], np.searchsorted(h, bounds), [len(h)]])
    n = at[1:] - at[:-1]
    return mix(sums[at[1:]] - sums[at[:-1]] + mix(np.arange(len(n), dtype=np.uint64) + np.uint64((2 * bucket + kind + 2) << 32))), n


def set_key(h: np.ndarray) -> int:
    return int(mix(np.array([mix(h).sum(dtype=np.uint64) + np.uint64(len(h))])).view(np.int64)[0])


def sketch(h: np.ndarray, most: int = 1 << 16) -> bytes:
    """For each value of the hashes' last bits, whether a set has an odd number of elements with it: a power of two of bits, as many as elements if ``most`` allows.

    Bits in which the sketches of two sets differ are never more than the elements in which the sets do.
    """
    bits = min(most, max(64, 1 << (len(h) - 1).bit_length()))
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ; the longer one is folded to the other's length."""
    if len(a) > len(b):
        a, b = b, a
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    while bits > 8 * len(a):
        bits //= 2
        y = (y >> bits) ^ (y & ((1 << bits) - 1))
    return (x ^ y).bit_count()


def may_be_similar(r: int, a: bytes, s: int, b: bytes, num: int, den: int) -> bool:
    """False only if sets of sizes r and s with sketches a and b have a Jaccard similarity below num / den."""
    return den * min(r, s) >= num * max(r, s) and (num + den) * differing(a, b) <= (den - num) * (r + s)


def signature_rows(docs: DataFrame, n: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """(signature, node), a node for each distinct set; copies within a partition give their rows once."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, seen = WordHashes(), set()
        for b in batches:
            keys, sigs = [], []
            for text in b["text"]:
                h = shingles(hashes.of(text), n)
                if len(h) and (k := set_key(h)) not in seen:
                    if len(seen) >= 300_000:
                        seen.clear()
                    seen.add(k)
                    keys.append(k)
                    sigs.append(signatures(h, num, den, sent.value).view(np.int64))
            yield pd.DataFrame({"node": np.array(keys, np.int64), "signatures": pd.Series(sigs, dtype=object)})

    return docs.where("doc_id is not null").select("text").mapInPandas(tidy(run), "node long, signatures array<long>").select("node", F.explode("signatures").alias("signature"))


def profile(docs: DataFrame, n: int, most: int = 2_500_000) -> DataFrame:
    """One pass over all texts: (doc_id, n_shingles, node, sketch) of every document, node and sketch null for an empty set, and (token, n) of shingles
    that ``n`` > 1 different sets of a run of about ``most`` shingles hold (lossy counting)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, seen, kept, size = WordHashes(), set(), [], 0

        def counted() -> pd.DataFrame:
            token, times = np.unique(np.concatenate(kept), return_counts=True)
            token, times = token[times > 1], times[times > 1]
            none = pd.array([None] * len(token), "Int64")
            return pd.DataFrame({"doc_id": none, "n_shingles": none, "node": none, "sketch": None, "token": token.view(np.int64), "n": times})

        for b in batches:
            sets = [shingles(hashes.of(text), n) for text in b["text"]]
            keys = [set_key(h) if len(h) else None for h in sets]
            none = pd.array([None] * len(sets), "Int64")
            sketches = pd.Series([sketch(h) if len(h) else None for h in sets], dtype=object)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64").array, "n_shingles": [len(h) for h in sets], "node": pd.array(keys, "Int64"), "sketch": sketches, "token": none, "n": none})
            for k, h in zip(keys, sets):
                if k is not None and k not in seen:
                    seen.add(k)
                    kept.append(h)
                    size += len(h)
                if size > most:
                    yield counted()
                    kept, size = [], 0
                    seen.clear()
        if kept:
            yield counted()

    return docs.select("doc_id", "text").mapInPandas(tidy(run), "doc_id long, n_shingles long, node long, sketch binary, token long, n long")


def common_shingles(counts: DataFrame, at_least: int = 16, most: int = 1_000_000) -> np.ndarray:
    """The most frequent shingles, sorted, at most ``most`` (8 bytes each). Which ones they are changes the work, never the result."""
    top = counts.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least).orderBy(F.desc("n"), "token").limit(most)
    return np.sort(top.select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64))


def compared(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v, ok) of ``pairs`` (u, v) of nodes: whether they may be similar by ``sketches`` (node, size, sketch)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [may_be_similar(*x, num, den) for x in zip(b["u_size"], b["u_sketch"], b["v_size"], b["v_sketch"])]
            yield pd.DataFrame({"u": b["u"], "v": b["v"], "ok": np.array(ok, bool)})

    sketches = hinted(sketches)
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("sketch").alias(f"{x}_sketch"))
    return pairs.join(side("u"), "u").join(side("v"), "v").mapInPandas(tidy(run), "u long, v long, ok boolean")


def plausible_edges(met: DataFrame, named: DataFrame, num: int, den: int, most: int = 32) -> DataFrame:
    """(src, dst) that connect all nodes that share a signature and may be similar. ``met`` (cut): (signature, node, first), first the least node that has the signature.

    Nodes are compared with the first of their signature. One that can't be similar to it is compared with the others that have the signature; if more
    than ``most`` have it, it stays with the first uncompared, so that pairs are never more than ``most`` times the rows: that makes a block larger, and loses nothing.
    """
    star = cut(met.select(F.col("node").alias("u"), F.col("first").alias("v")).distinct())
    nodes = cut(star.select(F.col("u").alias("node")).union(star.select("v")).distinct())
    sketches = named.join(hinted(nodes), "node", "left_semi").groupBy("node").agg(F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    sketches = cut(sketches)
    star = cut(compared(star, sketches, num, den))
    other = hinted(cut(star.where("not ok").select("u", "v")))
    apart = met.join(other, (met["node"] == other["u"]) & (met["first"] == other["v"]), "left").select("signature", "node", "first", F.col("u").isNotNull().alias("apart"))
    of = Window.partitionBy("signature")
    apart = cut(apart.withColumns({"n": F.count(F.lit(1)).over(of), "mixed": F.max("apart").over(of)}).where("mixed"))
    few = apart.where(F.col("n") <= most).groupBy("signature").agg(F.collect_list("node").alias("nodes"), F.collect_list(F.when(F.col("apart"), F.col("node"))).alias("rest"))
    pairs = few.select(F.explode("rest").alias("a"), "nodes").select("a", F.explode("nodes").alias("b")).where("a <> b")
    pairs = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    more = apart.where((F.col("n") > most) & F.col("apart")).select("node", "first")
    return star.where("ok").select("u", "v").union(compared(pairs, sketches, num, den).where("ok").select("u", "v")).union(more).toDF("src", "dst")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of ``left`` with ``right``, by scanning the inverted lists of the elements in blocks."""
    sets, n = [*left, *right], len(left)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[token] > 1  # the list of an element that one set alone has holds no pair
    owner, token = owner[shared], token[shared]
    out = np.zeros((n, len(right)), np.float32)
    if len(token):
        _, token = np.unique(token, return_inverse=True)
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], token[order]
        width = max(64, min(4096, 4_000_000 // len(sets)))
        for low in range(0, int(token[-1]) + 1, width):
            a, b = np.searchsorted(token, (low, low + width))
            lists = np.zeros((len(sets), width), np.float32)
            lists[owner[a:b], token[a:b] - low] = 1
            out += lists[:n] @ lists[n:].T
    return out


def pivot_links(large: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(rep, block, pivot) of the sets linked to their block's pivot, itself included. ``large``: (rep, block, copies); the pivot is the rep with most copies, then the least."""
    pivots = cut(large.groupBy("block").agg(F.max_by("rep", F.struct("copies", -F.col("rep"))).alias("pivot")))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            yield pd.DataFrame({"block": b["block"], "pivot": b["pivot"], "raw": [shingles(hashes.of(t), n).tobytes() for t in b["text"]]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            ok = []
            for text, raw in zip(b["text"], b["raw"]):
                x, y = shingles(hashes.of(text), n), np.frombuffer(raw, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both) and both > 0)
            yield b.loc[ok, ["rep", "block", "pivot"]]

    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    of_pivots = texts.withColumnRenamed("rep", "pivot").join(hinted(pivots), "pivot").mapInPandas(tidy(sets), "block long, pivot long, raw binary")
    of_pivots = cut(of_pivots.groupBy("block").agg(F.first("pivot").alias("pivot"), F.first("raw").alias("raw")))
    members = joined(texts, "rep", cut(large.select("rep", "block"))).join(hinted(of_pivots), "block")
    return members.mapInPandas(tidy(compare), "rep long, block long, pivot long").distinct()


def tile_links(blocks: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Forest edges (src, dst) of the links in every block. ``blocks``: (rep, block, linked, q, r): whether the set is linked to the block's pivot;
    q chunks to deal the others into, r for the linked ones. Chunks of linked sets are compared with those of the others only."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, seen = WordHashes(), set()
        columns = ["block", "i", "j", "second", "rep", "raw"]
        for b in batches:
            out = []
            for rep, block, linked, q, r, text in zip(b["rep"], b["block"], b["linked"], b["q"], b["r"], b["text"]):
                h = shingles(hashes.of(text), n)
                one = hash((rep, set_key(h)))  # rows that repeat a document go on once
                if not len(h) or one in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(one)
                raw, by = h.tobytes(), int(mix(np.array([rep], np.int64).view(np.uint64))[0])
                mine = q + by % r if linked else by % q
                out += [(block, min(mine, j), max(mine, j), mine > j, rep, raw) for j in range(q if linked else q + r)]
                if len(out) >= 256:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["rep", "raw"]).sort_values(["second", "rep"], kind="stable")
        sets = [np.frombuffer(x, np.uint64) for x in pdf["raw"]]
        sizes, alone = np.array([len(s) for s in sets], np.float32), pdf["i"].iloc[0] == pdf["j"].iloc[0]
        n = len(sets) if alone else int((~pdf["second"]).sum())
        left, right = slice(0, n), slice(0 if alone else n, len(sets))
        both = overlaps(sets[left], sets[right])
        ok = np.zeros((len(sets), len(sets)), bool)
        # exact: all numbers are far below 2 ** 53
        ok[left, right] = den * both.astype(float) >= num * (sizes[left, None].astype(float) + sizes[None, right] - both)
        ok |= ok.T
        np.fill_diagonal(ok, False)
        rep, edges = pdf["rep"].to_numpy(), forest(ok)
        if len(sets) > 200:
            del both, ok
            release()
        return pd.DataFrame({"src": [rep[a] for a, _ in edges], "dst": [rep[b] for _, b in edges]}, dtype="int64")

    # without a doc_id that is unique, any of its rows would do for another: the set decides
    texts = joined(docs.select(F.col("doc_id").alias("rep"), "text"), "rep", blocks.where("not linked or q > 0"))
    dealt = texts.mapInPandas(tidy(deal), "block long, i int, j int, second boolean, rep long, raw binary")
    return dealt.groupBy("block", "i", "j").applyInPandas(link, "src long, dst long")


def jaccard_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, most_rows: int = 1024, most_shingles: int = 600_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document: sets of ``n``-word shingles, linked where num / den of the union is shared.

    Words are A-Z lower-cased runs without ASCII white space; with fewer than ``n`` words the whole sequence is one shingle.
    Null texts and texts without words have an empty set and are linked with nothing; so are rows with a null doc_id.
    Equal texts are linked. component_id is the smallest doc_id reachable. An empty table gives an empty result; other columns are not
    read, whatever their names. Very long texts are one set each; a tile that holds them has fewer sets.
    """
    seen = cut(profile(docs, n))
    named = seen.where("token is null").select("doc_id", "n_shingles", "node")
    reps = cut(named.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.count(F.lit(1)).alias("copies")))
    once = joined(docs, "doc_id", reps.select(F.col("rep").alias("doc_id"))) if 4 * reps.count() < 3 * named.count() else docs
    signed = signature_rows(once, n, num, den, common_shingles(seen.where("token is not null")))
    first = F.first("node").over(Window.partitionBy("signature").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    with setting(docs.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):  # the signatures are the most that is shuffled
        met = cut(signed.select("signature", "node", first.alias("first")).where("node <> first").distinct())
    block = cut(components(plausible_edges(met, seen.where("node is not null"), num, den)))
    placed = cut(reps.join(hinted(block), "node").select("rep", "size", "copies", F.col("component").alias("block")))
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / most_rows), F.ceil(F.sum("size") / most_shingles)).cast("int")
    large = hinted(cut(placed.groupBy("block").agg(chunks.alias("q")).where("q > 1").select("block")))
    to_pivot = cut(pivot_links(cut(placed.join(large, "block", "left_semi").select("rep", "block", "copies")), docs, n, num, den))
    of_block = placed.join(hinted(to_pivot.select("rep", F.lit(True).alias("linked"))), "rep", "left").select("rep", "block", "size", F.coalesce("linked", F.lit(False)).alias("linked"))
    count = of_block.groupBy("block", "linked").agg(chunks.alias("n"))
    deals = cut(count.groupBy("block").agg(F.coalesce(F.max(F.when(~F.col("linked"), F.col("n"))), F.lit(0)).alias("q"), F.coalesce(F.max(F.when(F.col("linked"), F.col("n"))), F.lit(0)).alias("r")))
    blocks = cut(of_block.join(hinted(deals), "block").select("rep", "block", "linked", "q", "r"))
    edges = tile_links(blocks, docs, n, num, den).union(to_pivot.select(F.col("rep").alias("src"), F.col("pivot").alias("dst")))
    linked = components(edges)
    known = reps.join(linked, reps["rep"] == linked["node"], "left").where("component is not null or copies > 1")
    known = cut(known.select(reps["node"], F.coalesce("component", "rep").alias("component_id")))
    out = named.join(known, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without the documents that are linked to one of smaller doc_id, directly or by others; all columns stay.

    Rows that repeat a doc_id are one document and stay together.
    """
    one = free_name("one", docs)
    ids = jaccard_components(docs, n, num, den).where("doc_id is not null")
    groups = cut(ids.groupBy(F.col("doc_id").alias(one)).agg(F.max(F.col("doc_id") != F.col("component_id")).alias("gone")))
    gone, kept = (cut(groups.where(x).select(one)) for x in ("gone", "not gone"))
    if gone.count() > kept.count():
        return joined(docs, "doc_id", kept, "left_semi").union(docs.where("doc_id is null"))
    return joined(docs, "doc_id", gone, "left_anti")
