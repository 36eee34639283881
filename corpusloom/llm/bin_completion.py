"""Packing of tokenised documents into as few sequences as can be found, by bin completion.

Pieces are dealt evenly into shards of bounded size. In a shard best-fit decreasing gives the first packing. A depth-first
search then tries for fewer sequences: it takes the largest piece that is left, enumerates undominated fillings of the room beside it, fullest
first, and turns back when the waste so far would not leave room for a better packing. The emptiest sequences of all shards are pooled and
packed again, until one shard is left, so that shards cost no sequences.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import tidy
from corpusloom.plans.lineage import cut

PIECES = "doc_id long, named boolean, piece int, start long, length long, ids_crc32 long, row long"
#: Texts of these characters alone are NFC as they are, lower-case to one character each, and are split by WORDS as the tokenizer does.
PLAIN = re.compile(r"[\t-\r\x20-\x7e¡«»¿À-ÿ]*")
WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class WordIds(dict):
    """Lower-cased pre-token -> its ids as little-endian bytes, remembered up to a bound; other texts by runs between white space."""

    def __init__(self, tokenizer_json: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_json)
        self.model, self.most = self.library.model, most
        self.marks = [t.content for t in self.library.get_added_tokens_decoder().values()]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the printable alphabet of byte-level vocabularies
        rest = [b for b in range(256) if b not in set(shown)]
        self.shown = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}

    def __missing__(self, word: str) -> bytes:
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.shown))
        ids = np.array([t.id for t in tokens], "<u4").tobytes()
        if len(word) < 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        """Ids of a whole text, as the library gives them.

        Neither the normalisation nor the split into words looks across ASCII white space, so a text that isn't plain is encoded run by run.
        """
        if PLAIN.fullmatch(text) and not any(m in text for m in self.marks):
            return b"".join(map(self.__getitem__, WORDS.findall(text.lower())))
        runs = text.encode("utf-8", "surrogatepass").split()
        kinds = list(dict.fromkeys(runs))
        found = {r: np.array(e.ids, "<u4").tobytes() for r, e in zip(kinds, self.library.encode_batch([r.decode() for r in kinds], add_special_tokens=False))}
        return b"".join(map(found.__getitem__, runs))


@lru_cache(maxsize=2)
def word_ids(tokenizer_json: str) -> WordIds:
    return WordIds(tokenizer_json)


def pieces(docs: DataFrame, tokenizer_json: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Pieces of every document: doc_id (0 if not ``named``: tasks get no nulls), piece, start, length, ids_crc32 and a number of the row. Null texts count as empty; a document
    has at least its end id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, end, width = word_ids(tokenizer_json), np.array([end_id], "<u4").tobytes(), 4 * capacity
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            out = []
            for doc_id, named, text in zip(b["doc_id"], b["named"], b["text"]):
                ids = ids_of.of(text or "") + end
                for k, at in enumerate(range(0, len(ids), width)):
                    x = ids[at : at + width]
                    out.append((doc_id, named, k, at // 4, len(x) // 4, zlib.crc32(x), row))
                    row += 1
            yield pd.DataFrame(out, columns=["doc_id", "named", "piece", "start", "length", "ids_crc32", "row"])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), "text").mapInPandas(tidy(run), PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each length goes where least room is left."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for x in sorted(lengths, reverse=True):
        at = bisect_left(rooms, (x, -1))
        if at < len(rooms):
            room, k = rooms.pop(at)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(x)
        insort(rooms, (room - x, k))
    return bins


def least_bins(lengths: list[int], capacity: int) -> int:
    """A lower bound on the number of bins: by the sum, and by lengths over a half, beside which only so much of the shorter ones has room."""
    x = np.sort(np.asarray(lengths, np.int64))
    if not len(x):
        return 0
    total, bound = np.concatenate([[0], x.cumsum()]), -(-int(x.sum()) // capacity)
    below = lambda v: int(np.searchsorted(x, v, "left"))
    half = below(capacity // 2 + 1)
    for k in {0, *x[: half].tolist()}:
        over, low = below(capacity - k + 1), below(k)  # longer than capacity - k: alone among those of k and more
        large, middle = len(x) - over, over - half
        free = middle * capacity - int(total[over] - total[half])
        bound = max(bound, large + middle + max(0, -(-(int(total[half] - total[low]) - free) // capacity)))
    return bound


class Search:
    """Depth-first bin completion over a bounded number of lengths; at most ``most_steps`` steps, after which the best packing so far holds."""

    BANDS = (0, 4, 32, 256)  # fillings are tried by waste: none, then up to each of these, then up to what is allowed

    def __init__(self, lengths: list[int], capacity: int, most_steps: int = 200_000, steps_a_band: int = 1500):
        self.capacity, self.left, self.a_band = capacity, most_steps, steps_a_band
        self.count = Counter(lengths)
        self.sizes = sorted(self.count)
        self.total = sum(lengths)
        self.best = best_fit(lengths, capacity)
        self.bound = least_bins(lengths, capacity)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        self.total -= n * size
        if not self.count[size]:
            self.sizes.pop(bisect_left(self.sizes, size))

    def give(self, size: int, n: int) -> None:
        if not self.count[size]:
            insort(self.sizes, size)
        self.count[size] += n
        self.total += n * size

    def fillings(self, room: int, allowed: int) -> Iterator[list[tuple[int, int]]]:
        """Undominated fillings (length, copies) of ``room`` that waste at most ``allowed``, by bands of waste, longer lengths first.

        A filling is dominated if a length outside it could take the place of nothing, or of one or two lengths in it that are not longer, and still fit.
        """
        sizes, count = list(self.sizes), dict(self.count)
        reach = list(accumulate(s * count[s] for s in sizes))  # all of these lengths and shorter ones
        tries = 0

        def dominated(filling: list[tuple[int, int]], waste: int) -> bool:
            used = dict(filling)
            outside = lambda low, high: any(count[s] > used.get(s, 0) for s in sizes[bisect_left(sizes, low) : bisect_right(sizes, high)])
            if waste and (outside(1, waste) or any(outside(s + 1, s + waste) for s in used)):
                return True
            own = list(used)
            return any(outside(a + b, a + b + waste) for i, a in enumerate(own) for b in own[i + (used[a] < 2) :])

        def go(room: int, top: int, low: int, high: int) -> Iterator[list[tuple[int, int]]]:
            nonlocal tries
            if low <= room <= high:
                yield []
            for i in range(min(top, bisect_right(sizes, room) - 1), -1, -1):
                if room - reach[i] > high or tries > self.a_band or self.left <= 0:
                    return
                s = sizes[i]
                for k in range(min(count[s], room // s), 0, -1):
                    tries += 1
                    self.left -= 1
                    for rest in go(room - k * s, i - 1, low, high):
                        yield [(s, k), *rest]

        low = 0
        for high in (*(b for b in self.BANDS if b < allowed), allowed):
            tries = 0
            for f in go(room, len(sizes) - 1, low, high):
                if not dominated(f, room - sum(s * k for s, k in f)):
                    yield f
            low = high + 1

    def around(self, large: int, allowed: int) -> Iterator[list[tuple[int, int]]]:
        """Fillings of a sequence that has ``large``. They are made as they are asked for, always in the state of their node."""
        room = self.capacity - large
        self.take(large, 1)
        found = self.fillings(room, min(allowed, room))
        f = next(found, None)  # has copied what is left
        self.give(large, 1)
        while f is not None:
            yield [(large, 1), *f]
            f = next(found, None)

    def run(self) -> list[list[int]]:
        """The best packing, as lists of lengths."""
        path: list[list[tuple[int, int]]] = []
        open_: list[Iterator] = []
        used = 0  # of the sequences in path, all they could hold
        whole = self.total
        while len(self.best) > self.bound and self.left > 0:
            if len(open_) == len(path):  # a new node: the largest length that is left
                allowed = (len(self.best) - 1) * self.capacity - whole - (used - (whole - self.total))
                if allowed < 0 or not self.sizes:
                    open_.append(iter(()))
                else:
                    large = self.sizes[-1]
                    open_.append(self.around(large, allowed))
            found = next(open_[-1], None)
            if found is None:
                open_.pop()
                if not path:
                    break
                for s, n in path.pop():
                    self.give(s, n)
                used -= self.capacity
                continue
            for s, n in found:
                self.take(s, n)
            path.append(found)
            used += self.capacity
            if self.total <= self.capacity:
                bins = [[s for s, n in f for _ in range(n)] for f in path] + ([[s for s in self.sizes for _ in range(self.count[s])]] if self.total else [])
                if len(bins) < len(self.best):
                    self.best = bins
                for s, n in path.pop():
                    self.give(s, n)
                used -= self.capacity
        return self.best


def packed(pdf: pd.DataFrame, capacity: int, level: int, shard: int, most_steps: int, reopen: int) -> pd.DataFrame:
    """A shard's rows with sequence_id, offset and whether they are of its ``reopen`` emptiest sequences."""
    pdf = pdf.sort_values(["length", "row"], kind="stable", ascending=[False, True])
    lengths = pdf["length"].tolist()
    bins = Search(lengths, capacity, most_steps).run()
    waste = [capacity - sum(b) for b in bins]
    loose = {k for k in sorted(range(len(bins)), key=lambda k: (-waste[k], k))[:reopen] if waste[k]}
    places: dict[int, list[tuple[int, int]]] = {}
    for k, b in enumerate(bins):
        at = 0
        for x in sorted(b, reverse=True):
            places.setdefault(x, []).append((k, at))
            at += x
    taken = [places[x].pop() for x in lengths]
    number = (level << 56) + (shard << 20)
    return pdf.assign(sequence_id=[number + k for k, _ in taken], offset=[at for _, at in taken], loose=[k in loose for k, _ in taken])


def of_shards(capacity: int, level: int, most_steps: int, reopen: int) -> Callable:
    return lambda key, pdf: packed(pdf, capacity, level, int(key[0]), most_steps, reopen)


def of_last(capacity: int, level: int, most_steps: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if rows:
            yield packed(pd.concat(rows), capacity, level, 0, most_steps, 0)

    return run


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = 4096, shard_rows: int = 2000, shard_bins: int = 64, most_steps: int = 200_000, reopen: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, row.

    Documents longer than ``capacity`` are cut into whole sequences and one rest. Null texts count as empty: one end id. Repeated rows are packed each;
    an empty table gives an empty result; other columns are not read, whatever their names. A very long text gives as many whole
    sequences as it fills. Pieces of equal length are dealt by their number of row, so ties are of no matter.

    A shard has about ``shard_rows`` rows, more where they are so short that these don't fill ``shard_bins`` sequences. Rows are dealt by the number of
    the row, so a document that repeats goes to all shards. Every level pools ``reopen`` sequences of a shard at most: at most reopen / shard_bins of
    the tokens before. ``most_steps`` bounds the search of a shard; the packing found by then is complete.
    """
    found = cut(pieces(docs, tokenizer_json, capacity=capacity))
    whole = found.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    out, todo, level = whole, found.where(F.col("length") < capacity), 0
    schema = PIECES + ", sequence_id long, offset long, loose boolean"
    while True:
        size = todo.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
        shards = max(1, min(size["rows"] // shard_rows, size["tokens"] // (shard_bins * capacity)))
        if shards > 1:
            solved = todo.groupBy(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")).applyInPandas(of_shards(capacity, level, most_steps, reopen), schema)
        else:
            solved = todo.repartition(1).mapInPandas(of_last(capacity, level, 10 * most_steps), schema)  # a last shard of bounded size
        solved = cut(solved)
        out = out.unionByName(solved.where("not loose").drop("loose"))
        if shards == 1:
            return out.withColumn("doc_id", F.when(F.col("named"), F.col("doc_id"))).drop("named")
        todo, level = solved.where("loose").drop("loose", "sequence_id", "offset"), level + 1
