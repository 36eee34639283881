"""Large search exports, one JSON document a file, read by byte ranges: a file is work for as many tasks as it has ranges.

A range can't be parsed by itself, since it may begin in a string and at any depth. Its shape is found first: for both cases, whether it begins in a string
or not, how it changes the depth of brackets and where keys named hits open. The shapes of a file, a small row each, are then walked in order, which says how
every range begins and where the array ``hits.hits`` lies. At last every range gives the elements that begin in it; the last one is read on to its end.
Texts are read twice and never shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.lineage import cut

#: Encodings in which a code unit of a bracket, quote or backslash never is a part of another character.
UNITS = {"UTF-16LE": "<u2", "UTF-16BE": ">u2", "UTF-8": "u1", "US-ASCII": "u1", "ISO-8859-1": "u1"}
QUOTE, OPEN_OBJECT, OPEN_ARRAY, CLOSE_OBJECT, CLOSE_ARRAY, BACKSLASH = range(1, 7)
KIND = np.zeros(1 << 16, np.int8)
for _kind, _c in enumerate('"{[}]\\', 1):
    KIND[ord(_c)] = _kind
BEFORE = 4096  # bytes before a range in which a key of a bracket in it is looked for


def open_path(path: str) -> fs.NativeFile:
    """A file opened at random places, by its scheme: local ones, and what pyarrow knows of stores."""
    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/+", "/", path))
    system, inner = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return system.open_input_file(inner)


def known(path: str) -> bool:
    """Whether open_path() can read ``path``."""
    try:
        open_path(path).close()
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def brackets(u: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and kinds of the brackets in code units ``u``, and the places of its quotes; ``escaped``: a backslash before ``u`` holds for its first unit."""
    kinds = KIND[u]
    at = np.flatnonzero(kinds)
    kinds = kinds[at]
    slashes, quotes = at[kinds == BACKSLASH], at[kinds == QUOTE]
    held = np.array([0] if escaped and not (len(slashes) and slashes[0] == 0) else [], np.int64)
    if len(slashes):
        first = np.r_[True, np.diff(slashes) != 1]
        runs = np.diff(np.r_[np.flatnonzero(first), len(slashes)]) + (escaped & (slashes[first] == 0))
        held = np.r_[held, slashes[first][runs % 2 == 1] + runs[runs % 2 == 1] - (escaped & (slashes[first][runs % 2 == 1] == 0))]
    quotes = quotes[~np.isin(quotes, held)]
    plain = (kinds != BACKSLASH) & (kinds != QUOTE)
    return at[plain], kinds[plain], quotes


def outside(u: np.ndarray, escaped: bool, in_string: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and kinds of the brackets that are in no string, and the depth behind each, from 0."""
    at, kinds, quotes = brackets(u, escaped)
    out = (np.searchsorted(quotes, at) + in_string) % 2 == 0
    at, kinds = at[out], kinds[out]
    return at, kinds, np.cumsum(np.where(kinds <= OPEN_ARRAY, 1, -1))


def ends_escaped(raw: bytes, unit: str) -> bool:
    """Whether the text ends with an odd number of backslashes."""
    u = np.frombuffer(raw, unit)
    other = np.flatnonzero(u != ord("\\"))
    return (len(u) - (other[-1] + 1 if len(other) else 0)) % 2 == 1


def escaped_at(file: fs.NativeFile, start: int, unit: str) -> bool:
    """Whether a backslash before offset ``start`` holds for the character there."""
    size = BEFORE
    while True:
        from_ = max(0, start - size)
        raw = file.read_at(start - from_, from_)
        if from_ == 0 or (np.frombuffer(raw, unit) != ord("\\")).any():
            return ends_escaped(raw, unit)
        size *= 2


def hits_key(encoding: str) -> re.Pattern:
    """``"hits":`` and an opening bracket, at any byte."""
    one = lambda c: re.escape(c.encode(encoding))
    space = b"(?:" + b"|".join(map(one, " \t\r\n")) + b")*"
    return re.compile(b"(?=(" + b"".join(map(one, '"hits"')) + space + one(":") + space + b")(?:" + one("{") + b"|" + one("[") + b"))")


def shape(file: fs.NativeFile, start: int, end: int, encoding: str) -> dict:
    """What a range does: ``odd`` quotes, and for both beginnings the ``net`` depth, [offset, is array, depth before, least depth since the one before] of its hits keys, and ``low``, the least depth after the last."""
    unit = UNITS[encoding]
    wide = np.dtype(unit).itemsize
    raw = file.read_at(end - start, start)
    u = np.frombuffer(raw[: len(raw) // wide * wide], unit)
    escaped = escaped_at(file, start, unit)
    ahead = max(0, start - BEFORE)
    near = file.read_at(start - ahead, ahead) + raw
    keys = [(ahead + m.end(1) - start) // wide for m in hits_key(encoding).finditer(near) if m.start() % wide == 0 and m.end(1) >= start - ahead and not ends_escaped(near[max(0, m.start() - BEFORE) : m.start()], unit)]
    out = {"odd": bool(len(brackets(u, escaped)[2]) % 2), "cases": []}
    for in_string in (False, True):
        at, kinds, depth = outside(u, escaped, in_string)
        level = np.r_[0, depth]  # before the bracket of the same number
        found, last = [], 0
        for i in np.flatnonzero(np.isin(at, keys)).tolist():
            found.append([start + int(at[i]) * wide, bool(kinds[i] == OPEN_ARRAY), int(level[i]), int(level[last : i + 1].min())])
            last = i + 1
        out["cases"].append({"net": int(level[-1]), "keys": found, "low": int(level[last:].min())})
    return out


def walk(shapes: pd.DataFrame) -> pd.DataFrame:
    """How each range of a file begins: from, in_string, depth, for those in the array hits.hits; or one row with an error."""
    out, in_string, depth, state = [], False, 0, 0  # 0: before hits, 1: in hits, 2: in its array, 3: behind it
    for path, nr, start, end, text in shapes.sort_values("start")[["path", "nr", "start", "end", "shape"]].itertuples(index=False):
        case, odd = json.loads(text), None
        odd, case = case["odd"], case["cases"][int(in_string)]
        begins = (start, in_string, depth) if state == 2 else None
        for at, array, before, low in [*case["keys"], (end, None, case["net"], case["low"])]:
            if state in (1, 2) and depth + low < state + 1:
                state = 3 if state == 2 else 0
            if state == 0 and array is False and depth + before == 1:
                state = 1
            elif state == 1 and array and depth + before == 2:
                state, begins = 2, (at, False, 2)
        if begins:
            out.append((path, nr, *begins, end, None))
        in_string, depth = in_string ^ odd, depth + case["net"]
    if state != 3 or depth or in_string:
        out = [(path, nr, 0, False, 0, 0, "not a search export")]
    return pd.DataFrame(out, columns=["path", "nr", "from", "in_string", "depth", "end", "error"])


def elements(file: fs.NativeFile, start: int, end: int, in_string: bool, depth: int, encoding: str) -> Iterator[tuple[int, str]]:
    """Offset and text of the objects that begin in a range, directly in the array hits.hits."""
    unit = UNITS[encoding]
    wide = np.dtype(unit).itemsize
    raw = file.read_at(end - start, start)
    u = np.frombuffer(raw[: len(raw) // wide * wide], unit)
    at, kinds, behind = outside(u, escaped_at(file, start, unit), in_string)
    behind = behind + depth
    over = np.flatnonzero((behind < 3) & (np.arange(len(at)) > 0 if depth == 2 else True))
    n = over[0] if len(over) else len(at)
    at, kinds, behind = at[:n], kinds[:n], behind[:n]
    opens, closes = at[(kinds == OPEN_OBJECT) & (behind == 4)], at[(kinds == CLOSE_OBJECT) & (behind == 3)]
    closes = closes[closes > opens[0]] if len(opens) else closes[:0]
    for a, b in zip(opens.tolist(), closes.tolist()):
        yield start + a * wide, raw[a * wide : (b + 1) * wide].decode(encoding, "replace")
    if len(opens) > len(closes):
        first, more = start + int(opens[-1]) * wide, 1 << 16
        while True:
            tail = file.read_at(end - first + more, first)
            places, _, behind = outside(np.frombuffer(tail[: len(tail) // wide * wide], unit), False, False)
            closed = np.flatnonzero(behind == 0)
            if len(closed):
                yield first, tail[: (int(places[closed[0]]) + 1) * wide].decode(encoding, "replace")
                return
            if first + len(tail) >= file.size():
                return
            more *= 2


def located(files: DataFrame, encoding: str, size: int) -> DataFrame:
    """(path, nr, from, in_string, depth, end, error) of the ranges of ``files`` (path, nr, length) in which hits may begin, and of files that are no exports."""
    step = size // 4 * 4
    ranges = cut(files.select("path", "nr", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(step).cast("long"))).alias("start")).select("path", "nr", "start", F.least(F.col("start") + step, "length").alias("end")))

    def shaped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for path, _, start, end in b.itertuples(index=False):
                with open_path(path) as f:
                    texts.append(json.dumps(shape(f, start, end, encoding)))
            yield b.assign(shape=pd.Series(texts, b.index, dtype=object))

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # ranges of the file that goes on in the next batch
        for b in batches:
            files = [f for _, f in b.groupby("path", sort=False)]
            if held and files and files[0]["path"].iloc[0] == held[0]["path"].iloc[0]:
                held.append(files.pop(0))
                if not files:
                    continue
            done = [pd.concat(held)] if held else []
            held = files[-1:]
            done = [w for w in map(walk, [*done, *files[:-1]]) if len(w)]
            if done:
                yield pd.concat(done)
        if held:
            yield walk(pd.concat(held))

    n = dealings(ranges, "start")
    shapes = ranges.repartition(n, "path", "start").mapInPandas(shaped, "path string, nr long, start long, end long, shape string")
    # the number is given here, too: shapes are a few bytes each, but walking those of many files is work for all cores
    in_order = shapes.repartition(n, "path").sortWithinPartitions("path", "start")
    return cut(in_order.mapInPandas(walked, "path string, nr long, from long, in_string boolean, depth int, end long, error string"))


def dealings(ranges: DataFrame, start: str) -> int:
    """Tasks for ``ranges``: one each, or of about 32 MB where they are small and many. The number is given, so that the few bytes of a table of ranges aren't taken for little work."""
    n = ranges.agg(F.count(F.lit(1)).alias("ranges"), F.sum(F.col("end") - F.col(start)).alias("bytes")).first()
    return max(1, min(n["ranges"], max(4 * ranges.sparkSession.sparkContext.defaultParallelism, (n["bytes"] or 0) >> 25)))


def hit_texts(places: DataFrame, encoding: str) -> DataFrame:
    """(path, nr, at, json) of the hits in the ranges ``places``, as located() gives them."""
    todo = places.where("error is null")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0  # of many small files in one batch
        for b in batches:
            for path, nr, start, in_string, depth, end in b.itertuples(index=False):
                with open_path(path) as f:
                    for at, text in elements(f, start, end, in_string, depth, encoding):
                        rows.append((path, nr, at, text))
                        held += len(text)
                        if held > 4 << 20:
                            yield pd.DataFrame(rows, columns=["path", "nr", "at", "json"])
                            rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["path", "nr", "at", "json"])

    columns = todo.select("path", "nr", "from", "in_string", "depth", "end")
    return columns.repartition(dealings(todo, "from"), "path", "from").mapInPandas(read, "path string, nr long, at long, json string")
