"""Segmented index, typo forms, commits of a stream, crawl store, canonical groups and as-of joins against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import auto_edits, shortened, shortenings
from corpusloom.operators import crawl_store, frontier, recrawl, search, segments
from corpusloom.streaming import jobs

FIELDS = {"title": 2.0, "body": 1.0}
DOC = "doc_id long, title string, body string, token string"
WORDS = [f"w{i}" for i in range(40)]


def documents(seed, ids):
    r = random.Random(seed)
    word = lambda: r.choice(WORDS[: r.choice([3, 10, 40])])
    return {i: (i, None if i % 11 == 0 else " ".join(word() for _ in range(r.randint(0, 4))), " ".join(word() for _ in range(r.randint(0, 60))), "x") for i in ids}


def hits(rows):
    return [(r["doc_id"], round(r["_score"], 9)) for r in rows.collect()]


def anew(spark, docs, terms, size):
    index = search.index_of(spark.createDataFrame(list(docs.values()), DOC), list(FIELDS))
    return hits(search.top(search.best_fields(search.field_scores(index, terms), FIELDS), size))


# ---- segments ----
def test_segments_equal_an_index_made_anew(spark, tmp_path):
    index = segments.SegmentedIndex(spark, str(tmp_path / "i"), 4, 4)
    live: dict = {}
    for k, (ids, gone) in enumerate([(range(400), []), (range(300, 500), [1, 2, 3, 999]), (range(0, 60, 3), range(450, 470))]):
        new = documents(k, ids)
        index = index.commit(spark.createDataFrame(list(new.values()), DOC), list(FIELDS), deletes=spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        live = {i: d for i, d in {**live, **new}.items() if i not in gone or i in new}
    assert index.stats() == {"version": 3, "segments": 3, "docs": len(live), "deleted": 100 + 3 + 20 + 20 - sum(i in (3,) for i in range(0, 60, 3))}
    want = anew(spark, live, ["w1", "w7", "w30", "none"], 15)
    assert hits(index.search(["w1", "w7", "w30", "none"], FIELDS, 15)) == want
    assert index.merge(2).version == 3, "no two are of one size class"
    one = index.merge(into_one=True)
    assert one.stats()["segments"] == 1 and one.stats()["deleted"] == 0 and one.stats()["docs"] == len(live)
    assert hits(one.search(["w1", "w7", "w30", "none"], FIELDS, 15)) == want
    assert hits(index.search(["w1", "w7", "w30", "none"], FIELDS, 15)) == want, "readers keep their version"
    one.vacuum()
    again = segments.SegmentedIndex(spark, str(tmp_path / "i"))
    assert (again.version, again.buckets) == (4, 4) and hits(again.search(["w1"], FIELDS, 5)) == anew(spark, live, ["w1"], 5)
    words = sorted((r["doc_id"], r["field"], r["length"]) for r in again.live_words().collect())
    assert words == sorted((i, f, len((d[k] or "").split())) for i, d in live.items() for k, f in ((1, "title"), (2, "body")))


def test_a_query_reads_few_blocks(spark, tmp_path):
    docs = [(i, None, ("rare " * 30 if i == 777 or i % 2000 == 5 else "") + "common " * (1 + i % 3) + "filler " * (200 - i // 400), "x") for i in range(20_000)]
    index = segments.SegmentedIndex(spark, str(tmp_path / "i"), 4, 4).commit(spark.createDataFrame(docs, DOC), list(FIELDS))
    pairs = spark.createDataFrame([("body", "rare"), ("body", "common")], "field string, token string")
    plan = index.plan(pairs, FIELDS, 5)
    n = plan.counts()
    assert n["blocks"] > 150 and n["read"] < n["blocks"] / 5, n
    assert hits(index.search(["rare", "common"], FIELDS, 5)) == anew(spark, {d[0]: d for d in docs}, ["rare", "common"], 5)


def test_odd_indexes(spark, tmp_path):
    index = segments.SegmentedIndex(spark, str(tmp_path / "i"))
    assert index.search(["a"], FIELDS).count() == 0 and index.stats()["docs"] == 0
    index = index.commit(spark.createDataFrame([], DOC), list(FIELDS))
    index = index.commit(spark.createDataFrame([(None, "a", "a", ""), (1, None, None, ""), (2, "a", "", "")], DOC), list(FIELDS))
    assert [r[0] for r in hits(index.search(["a"], FIELDS))] == [2] and index.stats()["docs"] == 2
    index = index.commit(spark.createDataFrame([(2, "old", "", "1"), (2, "b", "", "2")], DOC), list(FIELDS), order="token")
    assert index.search(["a"], FIELDS).count() == 0 and index.search(["old"], FIELDS).count() == 0 and [r[0] for r in hits(index.search(["b"], FIELDS))] == [2]
    late = segments.SegmentedIndex(spark, str(tmp_path / "i"))
    index.commit(None, deletes=spark.createDataFrame([(1,), (2,)], "doc_id long"))
    with pytest.raises(FileExistsError):
        late.commit(None, deletes=spark.createDataFrame([(1,)], "doc_id long"))
    assert segments.SegmentedIndex(spark, str(tmp_path / "i")).stats()["docs"] == 0


def blocks_and_words(spark, path):
    """A segment's blocks, and its postings by (field, token, doc_id) from the words."""
    (at,) = [str(p) for p in path.glob("segment-*")]
    words = {(r["field"], w["token"], r["doc_id"]): (w["tf"], r["length"]) for r in spark.read.parquet(f"{at}/forward").collect() for w in r["words"]}
    return spark.read.parquet(f"{at}/blocks").collect(), words


@pytest.mark.parametrize("most", [1 << 20, 500])
def test_blocks_hold_all_postings_once(spark, tmp_path, monkeypatch, most):
    """Cells are cut in the tasks that read the words: at 128 documents, or at their words."""
    monkeypatch.setattr(segments, "LONG", most)
    docs = documents(5, range(-3000, 3000, 2))
    segments.SegmentedIndex(spark, str(tmp_path), 2, 3).commit(spark.createDataFrame(list(docs.values()), DOC), list(FIELDS))
    blocks, words = blocks_and_words(spark, tmp_path)
    assert len({(b["field"], b["token"], b["cell"]) for b in blocks}) == len(blocks)
    assert all(b["n"] == len(b["ids"]) and b["most_tf"] == max(b["tfs"]) and b["least_length"] == min(b["lengths"]) and b["ids"] == sorted(b["ids"]) for b in blocks)
    found = [(b["field"], b["token"], i, tf, n) for b in blocks for i, tf, n in zip(b["ids"], b["tfs"], b["lengths"])]
    assert sorted(found) == sorted((*k, *v) for k, v in words.items())
    cells = {}
    for b in blocks:
        cells.setdefault((b["field"], b["cell"]), {}).update(zip(b["ids"], b["lengths"]))
    assert max(map(len, cells.values())) <= 128 and all(len(c) == 1 or sum(c.values()) <= most for c in cells.values())


def test_words_are_written_by_as_many_tasks_as_ranges(spark, tmp_path):
    index = segments.SegmentedIndex(spark, str(tmp_path), 1, 1).commit(spark.createDataFrame(list(documents(6, range(2000)).values()), DOC), list(FIELDS))
    index = index.merge(into_one=True)
    for s in tmp_path.glob("segment-*"):
        spans = sorted((r["a"], r["b"]) for r in spark.read.parquet(f"{s}/forward").groupBy(F.input_file_name()).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).collect())
        assert len(spans) == 4 and all(x[1] < y[0] for x, y in zip(spans, spans[1:])), "one slot bounds neither tasks nor files"


def test_many_keys_are_hashed_and_not_sorted(spark, tmp_path):
    rows = spark.range(10).select(F.lit("s").alias("segment"), F.col("id").alias("doc_id"))
    assert "shuffle_hash" in segments.few(rows, 200_001)._jdf.queryExecution().toString().lower()
    assert "broadcast" in segments.few(rows, 200_000)._jdf.queryExecution().toString().lower()


# ---- typos ----
def distance(a, b):
    """Unrestricted Damerau-Levenshtein."""
    last, d = {}, {(-1, -1): len(a) + len(b)}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = len(a) + len(b), i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = len(a) + len(b), j
    for i in range(1, len(a) + 1):
        at = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), at
            cost = a[i - 1] != b[j - 1]
            if not cost:
                at = j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_near_words_share_a_shortened_form(spark):
    r = random.Random(9)
    pairs = []
    for _ in range(3000):
        a = "".join(r.choice("abcd") for _ in range(r.randint(1, 24)))
        b = list(a)
        for _ in range(2):
            i, kind = r.randrange(len(b) + 1), r.randrange(4)
            if kind == 0:
                b.insert(i, r.choice("abcd"))
            elif kind == 1 and i < len(b):
                del b[i]
            elif kind == 2 and i < len(b):
                b[i] = r.choice("abcd")
            elif i + 1 < len(b):
                b[i], b[i + 1] = b[i + 1], b[i]
        pairs.append((a, "".join(b)))
    assert all(set(shortened(a)) & set(shortened(b)) for a, b in pairs if distance(a, b) <= 2)
    words = ["", "a", "ab", "añb", "abcdefghijklmnop", "x" * 100_000]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", shortenings(F.col("w")).alias("f")).collect()
    assert all(sorted(r["f"]) == shortened(r["w"]) for r in got)


def test_typos_meet_by_an_equi_join(spark, tmp_path):
    r = random.Random(3)
    tokens = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 8))) for _ in range(1500)})
    terms = ["abcab", "ab", "cab", "bacabc", "aaaaaaa", "none"]
    docs = spark.createDataFrame([(i, t, t, "") for i, t in enumerate(tokens)], DOC)
    vocabulary = spark.createDataFrame([("body", t) for t in tokens], "field string, token string")
    want = sorted((t, "body", w, distance(t, w)) for t in terms for w in sorted((w for w in tokens if distance(t, w) <= auto_edits(t)), key=lambda w, t=t: (distance(t, w), w))[:50])
    found = search.fuzzy_terms(vocabulary, terms)
    assert sorted(map(tuple, found.collect())) == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    search.write_index(docs, ["body"], str(tmp_path / "i"), buckets=8)
    index = search.Index.read(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, search.fuzzy_terms(index.vocabulary(terms), terms).collect())) == want
    assert sorted(map(tuple, index.vocabulary().collect())) == sorted(("body", t, 1) for t in tokens)


# ---- commits ----
def test_a_replayed_batch_is_committed_once(spark, tmp_path):
    out, ledger = str(tmp_path / "o"), str(tmp_path / "l")
    commit = jobs.commit_once(out, ledger)
    assert jobs.read_committed(spark, out, ledger, "a long").count() == 0 and jobs.committed(spark, ledger).count() == 0
    commit(spark.range(5).toDF("a"), 0)
    commit(spark.range(5).toDF("a"), 0)
    spark.range(99).toDF("a").write.parquet(f"{out}/batch_id=1")  # an attempt that failed before its line
    assert jobs.read_committed(spark, out, ledger, "a long").count() == 5
    commit(spark.range(7).toDF("a"), 1)
    commit(spark.range(0).toDF("a"), 2)
    assert sorted(map(tuple, jobs.committed(spark, ledger).collect())) == [(0, 5), (1, 7), (2, 0)]
    assert sorted(map(tuple, jobs.read_committed(spark, out, ledger, "a long").groupBy("batch_id").count().collect())) == [(0, 5), (1, 7)]


# ---- crawls ----
def test_crawls_are_merged_one_by_one(spark):
    store = crawl_store.CrawlStore(spark, buckets=4)
    crawl = lambda *rows: spark.createDataFrame(rows, "url string, checksum string")
    told = lambda df: sorted(tuple(r)[1:] for r in df.collect())
    assert told(store.merge(crawl(("a", "1"), ("b", "2"), ("c", "2"), ("a", "0"), (None, "9"), ("n", None)), 1)) == [("a", "new", None), ("b", "new", None), ("c", "new", None), ("n", "new", None)]
    second = store.merge(crawl(("a", "0"), ("d", "2"), ("e", "0"), ("c", "3"), ("n", None), ("f", None)), 2)
    assert told(second) == [("a", "unchanged", None), ("b", "gone", None), ("c", "changed", None), ("d", "moved", "b"), ("e", "duplicate", "a"), ("f", "new", None), ("n", "changed", None)]
    assert sorted(map(tuple, store.table().where("checksum is not null").collect())) == [("a", "0", 1), ("c", "3", 2), ("d", "2", 2), ("e", "0", 2)]
    again = crawl_store.CrawlStore(spark, store.name, buckets=4)
    assert again.version == 1 and told(again.merge(crawl(), 3)) == [(u, "gone", None) for u in "acdefn"]
    plan = again.table().join(again.table().select("url"), "url")._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan, "the store is bucketed"
    again.drop()


# ---- canonical groups ----
def test_chains_and_loops_end(spark):
    links = [(f"c{i}", f"c{i + 1}") for i in range(200)] + [("x", "y"), ("y", "z"), ("z", "x"), ("tail", "t2"), ("t2", "y"), ("self", "self"), ("two", "b"), ("two", "a"), (None, "q"), ("end", None), ("l1", "l2"), ("l2", "l1")]
    got = {r["url"]: (r["canonical"], r["hops"], r["loop"]) for r in frontier.canonical_groups(spark.createDataFrame(links, "url string, target string")).collect()}
    want = {f"c{i}": ("c200", 200 - i, False) for i in range(201)}
    want |= {u: ("x", None, True) for u in ("x", "y", "z", "tail", "t2")} | {u: ("l1", None, True) for u in ("l1", "l2")}
    want |= {"self": ("self", 0, False), "two": ("a", 1, False), "a": ("a", 0, False), "end": ("end", 0, False)}
    assert got == want
    assert frontier.canonical_groups(spark.createDataFrame([], "url string, target string")).count() == 0


# ---- as-of ----
def test_as_of_takes_the_last_version(spark):
    r = random.Random(2)
    left = [(i, r.choice(["hot", "hot", "b", "c", None]), r.choice([None, *range(50)])) for i in range(600)]
    held = [(r.choice(["hot", "b", None]), r.choice([None, *range(0, 50, 3)]), r.choice([None, *range(9)]), r.randrange(9)) for _ in range(300)]
    out = recrawl.as_of(spark.createDataFrame(left, "id long, site string, at long"), spark.createDataFrame(held, "site string, at long, delay long, n long"), "site", "at", ["delay", "n"])
    rank = lambda v: (v[1], v[2] is not None, v[2] or 0, v[3])
    got = sorted(map(tuple, out.select("id", "site", "at", "delay", "n").collect()), key=repr)
    want = []
    for i, site, at in left:
        known = [v for v in held if site is not None and at is not None and v[0] == site and v[1] is not None and v[1] <= at]
        best = max(known, key=rank) if known else (None, None, None, None)
        want.append((i, site, at, best[2], best[3]))
    assert got == sorted(want, key=repr)
