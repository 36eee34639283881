"""SentencePiece (merge-type) encoding and decoding with a table of last tokens per prefix.

For every prefix of a text the encoding ends in one unique token. An Aho-Corasick automaton lists the vocabulary
pieces that end at each position; a piece is the last token exactly if it is compatible with the last token of the
prefix before it, that is, if merging the two pieces' characters gives these two tokens again. Ids are then read
backwards along the table. Time is linear in the text, whatever its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"


class PrefixTable:
    """Encoder and decoder for one model file; text units are remembered up to ``most_units``."""

    def __init__(self, model_file: str, most_units: int = 800_000):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.score = {self.pieces[i]: sp.get_score(i) for i in range(n) if i not in self.special and i not in self.byte_of and not sp.is_unused(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if p in self.score}
        #: A piece whose own characters don't merge to it can never be produced.
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            if len(p) == 1 or self.merge(p) == [p]:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        #: Where no piece has a space mark after another character, a text splits there into independent units.
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score)
        self.inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.fits: dict[tuple[str, str], bool] = {}
        self.units: dict[str, tuple[str, str]] = {}
        self.most_units = most_units

    def merge(self, text: str) -> list[str]:
        """Merges by best score, leftmost first: the definition, used on the characters of at most two pieces."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            found = self.fits[key] = (left[-1] + right[0]) not in self.inside or self.merge(left + right) == [left, right]
        return found

    def last_tokens(self, text: str) -> list[str]:
        """At i, the last token of the encoding of text[: i + 1]."""
        last: list[str | None] = [None] * len(text)
        fits, compatible = self.fits, self.compatible
        for end, piece in self.automaton.iter(text):
            if last[end] is None:
                before = end - len(piece)
                if before < 0:
                    last[end] = piece
                else:
                    left = last[before] or text[before]
                    ok = fits.get((left, piece))
                    if ok or ok is None and compatible(left, piece):
                        last[end] = piece
        return [x or text[i] for i, x in enumerate(last)]

    def tokens(self, text: str) -> list[str]:
        last, out, i = self.last_tokens(text), [], len(text) - 1
        while i >= 0:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def to_ids(self, tokens: list[str]) -> list[int]:
        ids: list[int] = []
        for t in tokens:
            if t in self.ids:
                ids.append(self.ids[t])
            else:
                ids += [self.id_of_byte[b] for b in t.encode("utf-8", "surrogatepass")]
        return ids

    def cut(self, text: str) -> list[str]:
        marked = text.replace(" ", SPACE)
        if not marked:
            return []
        marked = SPACE + marked
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked) if self.splits else [marked]

    def unit(self, text: str) -> tuple[str, str]:
        """Comma-joined ids and decoded text of one unit; no piece spans a pair of characters that is inside none."""
        at = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.inside] if len(text) < 64 else []
        if at:
            parts = [text[i:j] for i, j in zip([0, *at], [*at, len(text)])]
            both = [self.units.get(p) or self.unit(p) for p in parts]
            found = ",".join([x[0] for x in both]), "".join([x[1] for x in both])
        else:
            ids = self.to_ids(self.tokens(text))
            found = ",".join(map(str, ids)), self.decode_unit(ids)
        if len(text) < 64:
            if len(self.units) >= self.most_units:
                self.units.clear()
            self.units[text] = found
        return found

    def encode(self, text: str) -> list[int]:
        return [i for u in self.cut(text) for i in self.to_ids(self.tokens(u))]

    def decode_unit(self, ids: list[int]) -> str:
        raw = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.special else self.pieces[i].replace(SPACE, " ").encode("utf-8", "surrogatepass") for i in ids)
        return raw.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        text = self.decode_unit(ids)
        return text[1:] if text.startswith(" ") else text

    def digests(self, text: str | None) -> tuple[int, str, str]:
        get, unit = self.units.get, self.unit
        found = [get(u) or unit(u) for u in self.cut(text or "")]
        ids = ",".join([x[0] for x in found])
        plain = "".join([x[1] for x in found])
        plain = plain[1:] if plain.startswith(" ") else plain
        return (ids.count(",") + 1 if ids else 0), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(plain.encode("utf-8", "surrogatepass")).hexdigest()


@lru_cache(maxsize=2)
def table(model_file: str) -> PrefixTable:
    return PrefixTable(model_file)


def encode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with an array column of ids. Null text gives no ids; an existing column named ``ids`` is replaced."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = table(model_file)
        for b in batches:
            yield pd.Series([t.encode(x or "") for x in b])

    return docs.withColumn(ids, run(F.col(text)))


def decode(docs: DataFrame, model_file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of an array column of ids; null ids give an empty text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = table(model_file)
        for b in batches:
            yield pd.Series([t.decode([int(i) for i in x]) if x is not None else "" for x in b])

    return docs.withColumn(text, run(F.col(ids)))


def encoding_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. A map over partitions; nothing is shuffled.

    Null texts count as empty (0 tokens, digests of the empty string); repeated rows give repeated results; other
    columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = table(model_file)
        for b in batches:
            rows = [t.digests(x) for x in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
