"""Tokens, edit distances and highlights."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.values import let

WORD = r"[\p{L}\p{N}]"
WORD_BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column, word_break: str = WORD_BREAK) -> Column:
    """Lower-cased words in order, without empty ones."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), word_break), lambda t: t != "")


def query_tokens(query: str) -> list[str]:
    """What tokens() gives for a query, for the driver's side."""
    return [t for t in re.split(r"[\W_]+", query.lower()) if t]


def auto_edits(term: str) -> int:
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def swaps(word: str) -> list[str]:
    """``word`` with two adjacent characters exchanged, in every way."""
    return [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)]


def swapped(word: Column) -> Column:
    """What swaps() gives, of a column."""
    at = F.sequence(F.lit(1), F.length(word) - 1)
    one = lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, F.lit(1)), F.substr(word, i, F.lit(1)), F.substr(word, i + 2, F.length(word)))
    return F.when(F.length(word) > 1, F.transform(at, one)).otherwise(F.array().cast("array<string>"))


SHORTENED, MOST_EDITS = 10, 2


def shortened(word: str) -> list[str]:
    """``word`` without up to MOST_EDITS of its first SHORTENED characters, each cut to SHORTENED - MOST_EDITS.

    Words within that many edits have one of these in common: what both keep in common loses at most so many characters of either.
    """
    found = last = {word[:SHORTENED]}
    for _ in range(MOST_EDITS):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found = found | last
    return sorted({w[: SHORTENED - MOST_EDITS] for w in found})


def shortenings(word: Column) -> Column:
    """What shortened() gives, of a column, in any order."""
    without = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    words = F.array(F.left(word, F.lit(SHORTENED)))
    once = let(words, lambda w: F.array_distinct(F.flatten(F.transform(w, without))))
    all_ = let(once, lambda a: F.concat(words, a, F.flatten(F.transform(a, without))))
    return F.array_distinct(F.transform(all_, lambda w: F.left(w, F.lit(SHORTENED - MOST_EDITS))))


HALF = 5


def halves(word: str, edits: int = MOST_EDITS) -> list[str]:
    """Forms of ``word`` of which halved() gives one, too, for every word within ``edits`` (at most 2; an exchange of neighbours is one).

    Of two edits one lies in either half, or they lie in the same, so a half has one at most; an exchange across the cut changes one character of each. Halves with one edit
    between them are equal without one character of each. The cut is where the other word has it, and may be moved by one.
    """
    found = set()
    for size in range(max(0, len(word) - edits), len(word) + edits + 1):
        cut = min(HALF, size // 2)
        for at in range(max(0, cut - 1), min(len(word), cut + 1) + 1):
            one = lambda w: [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))]
            found |= {f"{cut}<{f}" for f in one(word[:at])} | {f"{cut}>{f[: HALF - 1]}" for f in one(word[at : at + HALF])}
    return sorted(found)


def halved(word: Column) -> Column:
    """Forms of a column's words, 11 each at most: the first half, or HALF characters, and as many after it, whole and without each character."""
    one = lambda w: F.concat(F.array(w), F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))).otherwise(F.array().cast("array<string>")))
    first = lambda h: F.transform(one(F.left(word, h)), lambda f: F.concat(h.cast("string"), F.lit("<"), f))
    last = lambda h: F.transform(one(F.substr(word, h + 1, F.lit(HALF))), lambda f: F.concat(h.cast("string"), F.lit(">"), F.left(f, F.lit(HALF - 1))))
    return let(F.least(F.lit(HALF), F.floor(F.length(word) / 2).cast("int")), lambda h: F.array_distinct(F.concat(first(h), last(h))))


def near_edits(token: Column, term: Column, term_swaps: Column) -> Column:
    """Edits between a token and a term up to 2, else 3; the exchange of adjacent characters is one edit. ``term_swaps``: swaps() of the term.

    With an exchange among two edits, one of the words or both are exchanged once, and at most one plain edit is left.
    """
    plain = F.levenshtein(token, term, 2)  # -1 beyond 2
    one = F.array_contains(term_swaps, token)
    far = F.abs(F.length(token) - F.length(term)) > 1  # two edits with an exchange change the length by one at most
    two = F.exists(term_swaps, lambda s: F.levenshtein(token, s, 1) >= 0) | let(swapped(token), lambda ts: F.exists(ts, lambda t: (F.levenshtein(t, term, 1) >= 0) | F.array_contains(term_swaps, t)))
    return F.when((plain == 0) | (plain == 1), plain).when(one, 1).when(plain == 2, 2).when(far, 3).when(F.levenshtein(token, term, 4) < 0, 3).when(two, 2).otherwise(3)


def whole_words(terms: list[str]) -> str:
    """A pattern of whole words out of ``terms``, in any case (A-Z). A word ends where tokens() ends it, not at Java's or another engine's ``\\b``, of which some know ASCII alone."""
    words = "|".join(sorted(map(re.escape, set(terms)), key=lambda t: (-len(t), t)))
    return rf"(?i)(?<!{WORD})({words})(?!{WORD})"


def highlight(text: Column, terms: list[str], before: str = "<em>", after: str = "</em>") -> Column:
    """``text`` with whole words out of ``terms`` marked, in any case."""
    return F.regexp_replace(text, whole_words(terms), f"{before}$1{after}") if terms else text


def fragments(text: Column, terms: list[str], size: int = 150, number: int = 2) -> Column:
    """Up to ``number`` pieces of about ``size`` characters that hold a term, best first, highlighted.

    Pieces are cut at white space; the most terms win, earlier ones among equals.
    """
    if not terms:
        return F.array().cast("array<string>")
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)\S.{{0,{size - 1}}}(?=\s|$)|\S{{1,{size}}}"), F.lit(0))
    rated = F.transform(pieces, lambda p, i: F.struct((-F.regexp_count(p, F.lit(whole_words(terms)))).alias("n"), i.alias("i"), p.alias("p")))
    best = F.slice(F.array_sort(F.filter(rated, lambda r: r["n"] < 0)), 1, number)
    return F.transform(best, lambda r: highlight(r["p"], terms))
