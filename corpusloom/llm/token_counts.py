"""Token counts that follow edits without encoding a document again.

A document's pre-tokens are the leaves of two segment trees, of characters and of tokens. An edit finds its leaves by
descending the character tree, splits the touched region and its context into pre-tokens again until a boundary of the
old split is met, counts these alone and updates the sums above them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOT_SPACE = regex.compile(r"\P{White_Space}")
CONTEXT = 2  # pre-tokens before an edit that may change with it: a split looks past its end, over white space


class Counter(dict):
    """pre-token -> number of tokens, remembered up to a bound."""

    def __init__(self, rank_file: str, most: int = 300_000):
        import base64

        import public_tokenizers
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.most = most

    def __missing__(self, word: str) -> int:
        n = len(self.encoder._encode_single_piece(word))  # not split again: its own pattern has no room for very long white space
        if len(word) < 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def counter(rank_file: str) -> Counter:
    return Counter(rank_file)


class Document:
    """A text and two trees over its pre-tokens, each a leaf, or none where an edit took it away. Trees are arrays: node k is over 2k and 2k + 1, the root is 1."""

    def __init__(self, text: str, count: Counter, chars: np.ndarray | None = None, tokens: np.ndarray | None = None):
        self.text, self.count = text, count
        self.encoded = 0  # pre-tokens that edits have made anew
        if chars is None:
            words = count.pattern.findall(text)
            self.grow(np.fromiter(map(len, words), np.int64, len(words)), np.fromiter(map(count.__getitem__, words), np.int64, len(words)))
        else:
            self.chars, self.tokens = np.array(chars, np.int64), np.array(tokens, np.int64)

    def grow(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        """Trees over these leaves."""
        size = 1 << (max(1, len(chars)) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * size, np.int64), np.zeros(2 * size, np.int64)
        for tree, leaves in ((self.chars, chars), (self.tokens, tokens)):
            tree[size : size + len(leaves)] = leaves
            step = size
            while step > 1:
                tree[step // 2 : step] = tree[step : 2 * step : 2] + tree[step + 1 : 2 * step : 2]
                step //= 2

    @property
    def size(self) -> int:
        return len(self.chars) // 2

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_pretokens(self) -> int:
        return int((self.chars[self.size :] > 0).sum())

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, a last one at the end, and the characters before it."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at >= before + self.chars[node] and (self.chars[node + 1] or at < self.n_chars):
                before += int(self.chars[node])
                node += 1
        return node - self.size, before

    def edit(self, at: int, delete: int, insert: str) -> None:
        """Replace ``delete`` characters from ``at`` by ``insert``; both are brought within the text."""
        at = min(max(at, 0), self.n_chars)
        delete = min(max(delete, 0), self.n_chars - at)
        if not delete and not insert:
            return
        leaves = self.chars[self.size :]
        first, before = self.find(at)
        back = CONTEXT
        while first > 0 and back > 0:
            first -= 1
            before -= int(leaves[first])
            back -= bool(leaves[first])
        last, start = self.find(at + delete)
        end = start + int(leaves[last])  # of the region in the old text
        moved = len(insert) - delete
        self.text = self.text[:at] + insert + self.text[at + delete :]
        safe = at + len(insert)
        while True:
            words = self.count.pattern.findall(self.text[before : end + moved])
            if end + moved >= len(self.text) or end + moved >= safe and self.meets(before, end + moved, words):
                break
            while last + 1 < self.size:  # a leaf more, white space with what stands behind it
                last += 1
                end += int(leaves[last])
                if leaves[last]:
                    break
        self.encoded += len(words)
        self.put(first, last + 1, words)

    def meets(self, start: int, end: int, words: list[str]) -> bool:
        """Whether a split of the whole text from ``start`` would part at ``end``, too, and have these words before.

        A split never looks back, so from there on it is the old one. It looks ahead over white space and one character.
        """
        ahead = NOT_SPACE.search(self.text, end)
        longer = self.count.pattern.findall(self.text[start : ahead.end() if ahead else len(self.text)])
        return longer[: len(words)] == words

    def put(self, low: int, high: int, words: list[str]) -> None:
        """``words`` in place of leaves low to high: their sums are updated up to the root, or where there are too few leaves all leaves move and none is counted again."""
        chars = np.fromiter(map(len, words), np.int64, len(words))
        tokens = np.fromiter(map(self.count.__getitem__, words), np.int64, len(words))
        if len(words) > high - low:
            old = slice(self.size, self.size + int(np.flatnonzero(self.chars[self.size :]).max(initial=-1)) + 1)
            both = [np.concatenate([tree[old][:low], new, tree[old][high:]]) for tree, new in ((self.chars, chars), (self.tokens, tokens))]
            self.grow(*[x[both[0] > 0] for x in both])
            return
        for tree, new in ((self.chars, chars), (self.tokens, tokens)):
            a, b = self.size + low, self.size + high
            tree[a:b] = 0
            tree[a : a + len(new)] = new
            while a > 1:
                a, b = a // 2, (b - 1) // 2 + 1
                tree[a:b] = tree[2 * a : 2 * b : 2] + tree[2 * a + 1 : 2 * b : 2]


def edit_all(doc: Document, edits) -> None:
    for e in edits if edits is not None else ():
        if e is not None:
            doc.edit(int(e["at"] or 0), int(e["delete"] or 0), e["insert"] or "")


TREES = "doc_id long, text string, chars array<int>, tokens array<int>"


def build(docs: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, text, chars, tokens): every document with its two trees, to be written as a table and kept. n_tokens is tokens[1].

    Null texts count as empty; columns besides doc_id and text are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(rank_file)
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                doc = Document(text or "", count)
                yield pd.DataFrame({"doc_id": pd.array([doc_id], "Int64"), "text": [doc.text], "chars": [doc.chars], "tokens": [doc.tokens]})

    return docs.select("doc_id", "text").mapInPandas(run, TREES)


def apply(trees: DataFrame, edits: DataFrame, rank_file: str) -> DataFrame:
    """The table of build() after ``edits`` (doc_id, edits as for edited_counts()), and n_reencoded: how many pre-tokens were encoded again.

    A document without edits stays as it is. Documents meet their edits by doc_id, of which ``edits`` has one row each; nothing else is encoded.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(rank_file)
        for b in batches:
            for doc_id, text, chars, tokens, todo in zip(b["doc_id"], b["text"], b["chars"], b["tokens"], b["todo"]):
                doc = Document(text, count, chars, tokens)
                edit_all(doc, todo)
                yield pd.DataFrame({"doc_id": pd.array([doc_id], "Int64"), "text": [doc.text], "chars": [doc.chars], "tokens": [doc.tokens], "n_reencoded": [doc.encoded]})

    with_edits = trees.join(edits.select("doc_id", F.col("edits").alias("todo")), "doc_id", "left")
    return with_edits.mapInPandas(run, TREES + ", n_reencoded long")


def edited_counts(docs: DataFrame, rank_file: str, edits: str = "edits") -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_chars_edited, n_pretokens, n_reencoded of documents with a column of edits.

    ``edits``: array of struct(at, delete, insert), applied in order to the text as it is then. Null texts count as empty,
    null edits as none, nulls within an edit as 0 or ''. Repeated rows give repeated results; an empty table gives an empty one; columns besides
    doc_id, text and the one named by ``edits`` are not read. A very long text costs one encoding, whatever the number of its edits; so does very long white space.
    For edits that come later keep the trees: build() and apply(). A map over partitions; nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(rank_file)
        for b in batches:
            out = []
            for doc_id, text, todo in zip(b["doc_id"], b["text"], b["edits"]):
                doc = Document(text or "", count)
                n, words = doc.n_tokens, doc.n_pretokens
                edit_all(doc, todo)
                out.append((doc_id, n, doc.n_tokens, doc.n_chars, words, doc.encoded))
            yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_pretokens", "n_reencoded"]).astype({"doc_id": "Int64"})

    rows = docs.select("doc_id", "text", F.col(edits).alias("edits"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long, n_tokens_edited long, n_chars_edited long, n_pretokens long, n_reencoded long")


def sample_edits(text: str = "text"):
    """Three edits spread over a text: an insertion at a quarter, a deletion at the middle, a replacement at three quarters."""
    n = F.coalesce(F.length(text), F.lit(0))
    edit = lambda at, delete, insert: F.struct(at.cast("long").alias("at"), F.lit(delete).cast("long").alias("delete"), insert.alias("insert"))
    return F.array(edit(F.floor(n / 4), 0, F.lit(" (sic) ")), edit(F.floor(n / 2), 20, F.lit("")), edit(F.floor(n * 3 / 4), 5, F.concat(F.lit("don't  "), F.coalesce(F.substring(text, 1, 12), F.lit("")), F.lit("\n\n"))))
