"""The trie of conversations' beginnings, by vertical bitmaps.

Turns are numbered, and a conversation is cut into segments of at most ``segment`` turns, so that none has to be held whole. A shard takes a bounded number of
segments in order of their ids and keeps, for every (position, turn), a bitset of the segments that have it. Depth first, a node's bitset meets the
postings of the next position: what they share is a child, a popcount its size, and what it shares with the bitset of those that end there its list of ends.
Nodes of different shards are one if their paths are, which a 128-bit hash tells; sums over members add up over shards.

A node belongs to its least member. What a conversation owns is the end of its path from some depth on, so a node's subtree is known from its
members alone: a child is owned by one of them, a leaf too, and what is shared is what members have before the depth they own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.lineage import cut

NEVER = (1 << 62) - 1  # deeper than any conversation
NODE = ["p1", "p2", "depth"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_key(role: Column, text: Column) -> Column:
    """A digest that equals another's if role and text do."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, at, key, words) in sorted ranges, and (conv_id, part, first, before, size) of a conversation's share in a range.

    A turn's number is at - first + before, from 0; size is all the conversation's. Turns of one number come in the order of their digests. Long conversations go over
    several ranges.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_key(role, text).alias("key"), word_count(text).alias("words"))
    n = max(1, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "key"]
    rows = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "key", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    share = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("conv_id")
    return rows, share.select("conv_id", "part", "first", (F.sum("n").over(own.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(own).alias("size"))


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, key, words) of rebuilt conversations, pos from 1, and (conv_id, size) of all, with a size of 0, too.

    A conversation c begins with the first h turns of c - c % every, h being its id's CRC-32 modulo ``most``, and goes on with its own turns after its first h.
    """
    rows, share = numbered_turns(conversations)
    share = cut(share)
    all_ = share.groupBy("conv_id").agg(F.first("size").alias("own"))
    heads_of = all_.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("base_size"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = all_.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base")).join(heads_of, "base", "left")
    convs = cut(convs.select("conv_id", "base", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("k"), "own"))
    numbered = rows.join(share.join(convs.select("conv_id", "h", "k"), "conv_id"), ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("nr"), "key", "words", "h", "k")
    tails = numbered.where("nr >= h").select("conv_id", (F.col("k") + F.col("nr") - F.col("h") + 1).alias("pos"), "key", "words")
    first = cut(numbered.where((F.col("conv_id") % every == 0) & (F.col("nr") < most - 1)).select(F.col("conv_id").alias("base"), "nr", "key", "words"))
    begins = convs.where("k > 0").join(first, "base").where("nr < h").select("conv_id", (F.col("nr") + 1).alias("pos"), "key", "words")
    return tails.union(begins), convs.select("conv_id", (F.col("k") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("size"))


def segments(turns: DataFrame, sizes: DataFrame, segment: int) -> DataFrame:
    """Segments: conv_id, w, p1, p2 (the path before it), q (words before it), last, total (words of all), x1, x2, words (arrays).

    A path's hash is the exclusive or of the hashes of (position, turn), so a segment's beginning comes from running sums over the segments before.
    """
    t = turns.select("conv_id", F.expr(f"(pos - 1) div {segment}").alias("w"), "pos", F.xxhash64("pos", "key").alias("x1"), F.xxhash64(F.lit(1), "key", "pos").alias("x2"), "words")
    s = t.groupBy("conv_id", "w").agg(F.array_sort(F.collect_list(F.struct("pos", "x1", "x2", "words"))).alias("t"), F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"), F.sum("words").alias("n"))
    run = Window.partitionBy("conv_id").orderBy("w")
    before, zero = run.rowsBetween(Window.unboundedPreceding, -1), F.lit(0).cast("long")
    so_far = lambda c: F.coalesce(c.over(before), zero)
    s = s.select("conv_id", "w", so_far(F.bit_xor("b1")).alias("p1"), so_far(F.bit_xor("b2")).alias("p2"), so_far(F.sum("n")).alias("q"), F.lead("w").over(run).isNull().alias("last"), F.sum("n").over(Window.partitionBy("conv_id")).alias("total"), F.col("t.x1").alias("x1"), F.col("t.x2").alias("x2"), F.col("t.words").alias("words"))
    none = F.array().cast("array<bigint>")
    empty = sizes.where("size = 0").select("conv_id", zero.alias("w"), zero.alias("p1"), zero.alias("p2"), zero.alias("q"), F.lit(True).alias("last"), zero.alias("total"), none.alias("x1"), none.alias("x2"), none.alias("words"))
    return s.union(empty)


def shards(batches: Iterator[pd.DataFrame], most: int, most_turns: int = 100_000) -> Iterator[pd.DataFrame]:
    """A partition's rows in order, in tables of at most ``most`` rows and about ``most_turns`` turns."""
    kept, rows, turns = [], 0, 0
    for b in batches:
        at = 0
        sizes = b["x1"].map(len).to_numpy()
        for i in range(len(b)):
            if rows + i - at >= most or turns + sizes[at : i + 1].sum() > most_turns and rows + i - at:
                yield pd.concat([*kept, b.iloc[at:i]], ignore_index=True)
                kept, rows, turns, at = [], 0, 0, i
        kept.append(b.iloc[at:])
        rows, turns = rows + len(b) - at, turns + sizes[at:].sum()
    if rows:
        yield pd.concat(kept, ignore_index=True)


def bits(mask: int) -> np.ndarray:
    """Places of the bits that are set."""
    if mask & (mask - 1) == 0:
        return np.array([mask.bit_length() - 1] if mask else [], np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(mask.to_bytes((mask.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little"))


def visit(s: pd.DataFrame, segment: int) -> Iterator[tuple[int, int, int, int, int, int, int, int, int]]:
    """(mask, ends, depth, p1, p2, parent's p1, parent's p2, q, words) of every node of a shard, depth first; q: words of the path before the node's own turn."""
    x1, x2, words = s["x1"].tolist(), s["x2"].tolist(), s["words"].tolist()
    starts = (s["w"] * segment).tolist()
    postings: dict[tuple[int, int, int], int] = {}
    ends: dict[int, int] = {}
    roots: dict[tuple[int, int, int], int] = {}
    for i, (start, a, b, last) in enumerate(zip(starts, x1, x2, s["last"])):
        bit = 1 << i
        roots[start, int(s["p1"].iat[i]), int(s["p2"].iat[i])] = roots.get((start, int(s["p1"].iat[i]), int(s["p2"].iat[i])), 0) | bit
        for d, key in enumerate(zip(a, b), start + 1):
            key = (d, int(key[0]), int(key[1]))
            postings[key] = postings.get(key, 0) | bit
        if last:
            ends[start + len(a)] = ends.get(start + len(a), 0) | bit
    going: dict[int, int] = {}  # depth -> segments that have a turn there
    for (d, _, _), mask in postings.items():
        going[d] = going.get(d, 0) | mask
    for (start, p1, p2), mask in roots.items():
        low = (mask & -mask).bit_length() - 1
        if start == 0:
            yield mask, mask & ends.get(0, 0), 0, 0, 0, 0, 0, 0, 0
        todo = [(mask, start, p1, p2, int(s["q"].iat[low]))]
        while todo:
            mask, depth, p1, p2, q = todo.pop()
            rest = mask & going.get(depth + 1, 0)
            while rest:
                i = (rest & -rest).bit_length() - 1
                j = depth - starts[i]
                a, b, n = int(x1[i][j]), int(x2[i][j]), int(words[i][j])
                child = mask & postings[depth + 1, a, b]
                rest ^= child
                c1, c2 = p1 ^ a, p2 ^ b
                yield child, child & ends.get(depth + 1, 0), depth + 1, c1, c2, p1, p2, q, n
                todo.append((child, depth + 1, c1, c2, q + n))


def shard_nodes(segs: DataFrame, segment: int, shard: int) -> DataFrame:
    """(p1, p2, depth, conv_id, n_convs, n_ends, q, ends): the nodes of each shard, a run of segments in order of their ids; ends has the ids of the members that end there, ascending, as 64-bit numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for s in shards(batches, shard):
            ids, out = s["conv_id"].to_numpy(np.int64), []
            for mask, end, depth, p1, p2, _, _, q, _ in visit(s, segment):
                low = (mask & -mask).bit_length() - 1
                out.append((p1, p2, depth, int(ids[low]), mask.bit_count(), end.bit_count(), q, ids[bits(end)].astype("<i8").tobytes() if end else None))
            yield pd.DataFrame(out, columns=[*NODE, "conv_id", "n_convs", "n_ends", "q", "ends"])

    n = max(1, int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    in_order = segs.repartitionByRange(n, "conv_id", "w").sortWithinPartitions("conv_id", "w")
    return in_order.mapInPandas(run, "p1 long, p2 long, depth long, conv_id long, n_convs long, n_ends long, q long, ends binary")


def ends_digests(nodes: DataFrame) -> DataFrame:
    """(p1, p2, depth, ends_sha256) of the nodes where conversations end.

    A digest needs its ids in order, so a node's lists, one a shard, meet in one task; they come sorted and pass through one by one, and only the digest's state is held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, hashlib.sha256()
        for b in batches:
            out = []
            for p1, p2, depth, ends in zip(b["p1"], b["p2"], b["depth"], b["ends"]):
                if (p1, p2, depth) != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (p1, p2, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, np.frombuffer(ends, "<i8").tolist())).encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    lists = nodes.where("ends is not null").select(*NODE, F.col("conv_id").alias("at"), "ends")
    return lists.repartition(*NODE).sortWithinPartitions(*NODE, "at").mapInPandas(run, "p1 long, p2 long, depth long, ends_sha256 string")


def shard_sums(segs: DataFrame, segment: int, shard: int) -> DataFrame:
    """(p1, p2, depth, up1, up2, conv_id, inner, n_convs, n_children, n_leaves, saved_tokens) of each shard's members. Segments have owns (the depth from which
    a conversation owns its path, or NEVER), shared (its words before that) and leaf (whether it ends in a leaf that it owns)."""
    names = [*NODE, "up1", "up2", "conv_id", "inner", "n_convs", "n_children", "n_leaves", "saved_tokens"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for s in shards(batches, shard):
            ids, owns, shared, leaf = (s[c].to_numpy(np.int64) for c in ("conv_id", "owns", "shared", "leaf"))
            out = []
            for mask, end, depth, p1, p2, up1, up2, q, _ in visit(s, segment):
                m = bits(mask)
                mine = owns[m]
                others = m[mine > depth]
                on = bits(mask & ~end)
                out.append((p1, p2, depth, up1, up2, int(ids[m].min()), bool((mine < depth).any()), len(m), int((owns[on] <= depth + 1).sum()), int(leaf[m].sum()), int(shared[others].sum()) - q * len(others)))
            yield pd.DataFrame(out, columns=names)

    return segs.mapInPandas(run, "p1 long, p2 long, depth long, up1 long, up2 long, conv_id long, inner boolean, n_convs long, n_children long, n_leaves long, saved_tokens long")


def prefix_trie(conversations: DataFrame, segment: int = 512, shard: int = 2048) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts count as empty; null turns come first, turns of one number in the order of their digests, so repeated rows are turns of their own.
    Rows without a conv_id are of no conversation. An empty table has no node, not even a root; other columns are not read, whatever their names. Very long texts
    are digests and word counts; very long conversations are segments. Ids are 64-bit; paths meet by 128-bit hashes, so among n nodes two differing ones
    would be taken for one with a chance of about n² / 2^129.
    """
    turns, sizes = rebuilt(conversations)
    segs = cut(segments(turns, sizes, segment))
    found = cut(shard_nodes(segs, segment, shard))
    merged = found.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n"), F.sum("n_ends").alias("n_ends"), F.min("q").alias("q"))
    owners = merged.groupBy(F.col("conv_id").alias("owner")).agg(F.min("depth").alias("owns"), F.min_by("q", "depth").alias("shared"), F.max((F.col("n") == F.col("n_ends")).cast("long")).alias("leaf"))
    with_owned = segs.join(owners, segs["conv_id"] == owners["owner"], "left").drop("owner")
    with_owned = with_owned.withColumns({"owns": F.coalesce("owns", F.lit(NEVER)), "shared": F.coalesce("shared", "total"), "leaf": F.coalesce("leaf", F.lit(0).cast("long"))})
    sums = shard_sums(with_owned, segment, shard)
    total = {c: F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
    nodes = cut(sums.groupBy(*NODE).agg(F.first("up1").alias("up1"), F.first("up2").alias("up2"), F.min("conv_id").alias("conv_id"), F.bool_or("inner").alias("inner"), *total.values()))
    root = nodes.where("depth = 0").select("conv_id").first()  # of one row at most
    of_root = F.lit(root["conv_id"] if root else None).cast("long")
    # the first node that a conversation owns hangs on another's; below it they are its own
    near = nodes.where("inner or depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 0, None).when(F.col("inner"), F.col("conv_id")).otherwise(of_root))
    up = nodes.select(F.col("p1").alias("up1"), F.col("p2").alias("up2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    far = nodes.where("not inner and depth > 1").join(up, ["up1", "up2", "depth"])
    out = near.unionByName(far).join(ends_digests(found), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
