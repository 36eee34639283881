"""Bin completion, filter audit and conversation trie against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import bin_completion, conversation_trie, filter_audit

MODEL = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "Don't we'll THEY'RE 'sx ''s !'s", "naïve Übung ÉTÉ ß ÿ ¿qué? «oui»", "a b c\x1cd\x85e", "é É ẖ H̱", "ΣΑΣ σας İ ﬁ ½ ² ª", "日本語 のテキスト", "🤦🏼‍♂️ x", "<|endoftext|>a <|startoftext|>",
    "A<|endoftext|>B", "<|ENDOFTEXT|>", "12345 3.14 x1y2", "\x00a\x7fb\x01", "a_b--c...d", "word" * 3000, "̀̀ a", "ÀÖ×÷Øß",
]


def of_library(texts):
    return [np.array([*e.ids, 1], "<u4") for e in Tokenizer.from_file(MODEL).encode_batch(texts, add_special_tokens=False)]


def test_word_ids_are_the_librarys():
    ids = bin_completion.WordIds(MODEL, most=5)
    r = random.Random(3)
    texts = ODD + ["".join(r.choice(ODD[r.randrange(2, len(ODD))] or "x") for _ in range(40)) for _ in range(300)] + ["".join(chr(r.randrange(32, 1400)) for _ in range(30)) for _ in range(200)]
    for text, known in zip(texts, of_library(texts)):
        assert ids.of(text) == known[:-1].tobytes(), repr(text)


@pytest.mark.parametrize("gap", [" ", "\n", "\t", " \t"])
def test_word_ids_of_very_long_white_space(gap):
    text = "x" + gap * (2_000_000 // len(gap)) + "Yes"
    assert bin_completion.WordIds(MODEL).of(text) == of_library([text])[0][:-1].tobytes()


def fewest(lengths, capacity):
    """By trying all ways of putting each length in a bin that is open, or a new one."""
    best = [len(lengths)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            put(i + 1, [r - lengths[i] * (j == k) for j, r in enumerate(rooms)])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best[0]


def test_search_finds_the_fewest_bins():
    r, better = random.Random(5), 0
    for _ in range(120):
        capacity = r.choice([20, 50, 100])
        lengths = [r.randint(1, capacity - 1) for _ in range(r.randint(0, 10))]
        bins = bin_completion.Search(lengths, capacity, steps_a_band=10_000).run()
        assert sorted(x for b in bins for x in b) == sorted(lengths) and all(sum(b) <= capacity for b in bins)
        assert len(bins) == fewest(sorted(lengths, reverse=True), capacity) >= bin_completion.least_bins(lengths, capacity)
    for _ in range(40):  # where best fit alone does worse
        parts = [x for _ in range(8) for x in (lambda a, b: (a, b - a, 100 - b))(*sorted(r.sample(range(5, 95), 2)))]
        bins = bin_completion.Search(parts, 100).run()
        better += len(bins) < len(bin_completion.best_fit(parts, 100))
        assert 8 <= len(bins) <= len(bin_completion.best_fit(parts, 100))
    assert better


def test_best_fit_and_bound():
    assert bin_completion.best_fit([5, 5, 5, 3, 2], 10) == [[5, 5], [5, 3, 2]]
    assert bin_completion.least_bins([6, 6, 6, 6], 10) == 4 and bin_completion.least_bins([], 10) == 0 and bin_completion.least_bins([7, 4, 4], 10) == 2


def packs(spark, rows, schema="doc_id long, text string", **options):
    out = bin_completion.pack(spark.createDataFrame(rows, schema), MODEL, **options).toPandas()
    by = defaultdict(list)
    for p in out.itertuples():
        by[p.sequence_id].append((p.offset, p.length))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
    return out, by


@pytest.mark.parametrize("shard_rows", [40, 2000])
def test_packs_every_piece_once(spark, shard_rows):
    r = random.Random(7)
    texts = ODD + [" ".join(r.choice(["alpha", "Beta,", "gamma!", "été"]) for _ in range(r.randint(0, 90))) for _ in range(500)] + ["word " * 700]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 200 + [(None, "null id"), (1 << 61, None)]
    out, by = packs(spark, rows, capacity=128, shard_rows=shard_rows, shard_bins=4)
    assert all(sum(n for _, n in s) <= 128 for s in by.values())
    known = of_library([t or "" for _, t in rows])
    want = sorted((-1 if i is None else i, k, 128 * k, len(x), zlib.crc32(x.tobytes())) for (i, _), ids in zip(rows, known) for k in range(-(-len(ids) // 128)) for x in [ids[128 * k : 128 * k + 128]])
    got = sorted((-1 if p.doc_id != p.doc_id else int(p.doc_id), p.piece, p.start, p.length, p.ids_crc32) for p in out.astype({"doc_id": "float64"}).itertuples())
    assert got == [(float(a) if a == 1 << 61 else a, *b) for a, *b in want]
    assert len(by) <= (1.02 if shard_rows == 40 else 1) * -(-sum(map(len, known)) // 128) + 2  # shards of 40 rows have little choice


def test_packs_odd_tables(spark):
    assert len(packs(spark, [])[0]) == 0
    out, by = packs(spark, [(1, "a", 5, "x"), (1, "a", 5, "x")], "doc_id long, text string, length int, ROW string")
    assert len(out) == 2 and len(by) == 1
    out, by = packs(spark, [(i, "a b") for i in range(3000)], capacity=3, shard_rows=10, shard_bins=4)  # each fills a sequence
    assert len(by) == 3000
    out, by = packs(spark, [(i, "a") for i in range(5000)], capacity=3, shard_rows=10, shard_bins=4)  # each leaves room for none
    assert len(by) == 5000


# ---- filters ----
def failed(text):
    w = [x for x in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    return [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text)]


def plain_audit(docs, labels):
    rows = []
    for i, text, lang in docs:
        text = text or ""
        smaller = any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in docs)
        rows.append((lang or "", [*failed(text), smaller], any(d == i and q == 1 for d, q, _ in labels), any(d == i and x == 1 for d, _, x in labels)))
    out, removed_by = {}, defaultdict(int)
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            gone: list = []
            for k, f in enumerate(order, 1):
                fails = lambda r, f=f: r[1]["ABCDE".index(f)]
                lost = [r for r in left if fails(r)]
                redundant = sum(map(fails, gone))
                left, gone = [r for r in left if not fails(r)], gone + lost
                removed_by[part, f] += len(lost)
                out[part, "".join(order), k] = [len(left), len(lost), redundant, sum(fails(r) and sum(r[1]) == 1 for r in rows if r[0] == part), sum(r[2] for r in lost), sum(r[3] for r in lost)]
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_plain(spark):
    r = random.Random(11)
    good = " ".join(f"w{i}" for i in range(120))
    texts = [good, good.upper(), good + " #", "short", "a " * 150, "A B C", "", None, "x y " * 130, "é" * 50, good + "　" + "Z" * 100, "\x1c " + good]
    docs = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(120)] + [(None, good, "en"), (None, good, "en"), (5, good, "fr"), (5, good, "fr"), (5, "other", "fr")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 100, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, mask int, digest string")
    out = filter_audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    got = {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in out.itertuples()}
    assert got == plain_audit(docs, labels) and len(out) == len(got)


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, "x " * 5_000_00, "en")], docs.schema), labels)
    assert one.count() == 600 and one.agg({"removed": "sum"}).first()[0] == 120


def test_walk_keeps_running_survivors():
    masks, counts = np.array([0, 1, 3, 4, 7]), np.array([[5], [1], [2], [3], [4]])
    states = filter_audit.walk(masks, counts, 3)
    assert [int(s[0]) for s in states] == [sum(int(c[0]) for m, c in zip(masks, counts) if not m & s) for s in range(8)]


# ---- trie ----
def plain_trie(rows):
    of = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            of[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    of = {c: [x[-1] for x in sorted(v)] for c, v in of.items()}
    new = {}
    for c, own in of.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = of.get(c - c % 20, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, cs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        kids = {p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in under}
        saved = sum((len(members[p]) - 1) * len(p[-1][1].split()) for p in under if p)
        ends = ",".join(map(str, sorted(c for c in cs if len(new[c]) == len(path))))
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), kids[path], sum(not n for n in kids.values()), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("segment", "shard"), [(512, 2048), (2, 3), (1, 1), (3, 50)])
def test_trie_equals_plain(spark, segment, shard):
    r = random.Random(segment)
    says = ["hi there", "", None, "a b  c", "same words again", "x"]
    rows = [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(says)) for c in [*range(0, 45), 60, 61, 79, 107, 400] for t in range(r.randint(1, 7))]
    rows += [(500 + i, t, "user", "hi there") for i in range(25) for t in range(3)] + [(None, 0, "user", "none"), (3, 0, "user", "hi there"), (3, 0, "user", "hi there"), (900, 0, "user", "only one")]
    table = spark.createDataFrame([(*x, 1, 2) for x in rows], TURNS + ", depth int, P1 int")
    out = conversation_trie.prefix_trie(table, segment, shard).toPandas()
    got = sorted(((int(x.conv_id), int(x.depth), None if x.parent_conv_id != x.parent_conv_id else int(x.parent_conv_id), *map(int, (x.n_convs, x.n_children, x.n_leaves, x.saved_tokens)), x.ends_sha256) for x in out.itertuples()), key=repr)
    assert got == plain_trie(rows)


def test_trie_of_nothing_and_of_a_long_conversation(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(20, t, "user", f"{t} " * 3) for t in range(1500)] + [(21, t, "user", f"{t} " * 3) for t in range(700)]
    out = conversation_trie.prefix_trie(spark.createDataFrame(rows, TURNS), segment=64).toPandas()
    root = out[out["depth"] == 0].iloc[0]
    assert len(out) == 1501 and root["n_leaves"] == 1 and root["saved_tokens"] == 3 * 700 and root["n_convs"] == 2


def test_a_conversation_may_be_left_without_turns(spark):
    c = next(c for c in range(1, 2000) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    out = conversation_trie.prefix_trie(spark.createDataFrame([(c, 0, "user", "gone")], TURNS)).collect()
    assert [(x["conv_id"], x["depth"], x["n_convs"], x["n_leaves"], x["ends_sha256"]) for x in out] == [(c, 0, 1, 1, hashlib.sha256(str(c).encode()).hexdigest())]
