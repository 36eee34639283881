"""Operators over many documents, against brute force."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from corpusloom.llm import embedding_dedup, jaccard_join, url_templates, warc_fixity  # noqa: E402
from corpusloom.llm.common import components, forest, free_name, hinted  # noqa: E402
from plain import joined, leaders  # noqa: E402

def near_copies(seed, groups=8, each=9, sizes=(1, 90)):
    r = random.Random(seed)
    texts, passage = [], [f"p{i}" for i in range(25)]
    for _ in range(groups):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.randint(*sizes))]
        if r.random() < 0.5:
            words += passage
        for _ in range(each):
            w = list(words)
            for _ in range(r.randint(0, 3)):
                at = r.randint(0, len(w))
                w[at : at + r.randint(0, 1)] = [f"x{r.randint(0, 9)}"] * r.randint(0, 2)
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("seed, n, num, common_from, rows", [(1, 4, 85, 16, 1024), (2, 4, 85, 2, 6), (3, 5, 80, 16, 1024), (4, 5, 80, 3, 5), (5, 1, 85, 2, 8)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, seed, n, num, common_from, rows):
    texts = dict(enumerate(near_copies(seed) + near_copies(seed + 50, sizes=(1, 12)) + [None, "", "  \n", "one", "ONE", "one two", "One\tTwo"]))
    monkeypatch.setattr(jaccard_join.common_shingles, "__defaults__", (common_from, 1_000_000))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    sizes, component, links = joined(texts, n, num, 100)
    assert len(links) > 50
    got = jaccard_join.jaccard_components(docs, n, num, 100, most_rows=rows).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (sizes[i], component[i]) for i in texts}


@pytest.mark.parametrize("num", [85, 80, 90])
def test_similar_sets_share_a_signature(num):
    r = np.random.default_rng(num)
    for _ in range(300):
        size = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
        b = a.copy()
        for _ in range(int(r.integers(0, 1 + size // 8))):
            if r.random() < 0.5 and len(b) > 1:
                b = np.delete(b, r.integers(0, len(b)))
            else:
                b = np.unique(np.append(b, r.integers(0, 1 << 63, 1).astype(np.uint64)))
        o = len(np.intersect1d(a, b))
        if 100 * o >= num * (len(a) + len(b) - o):
            for share in (0, 0.3, 0.7, 1):
                common = np.sort(a[r.random(len(a)) < share])
                assert len(np.intersect1d(jaccard_join.signatures(a, num, 100, common), jaccard_join.signatures(b, num, 100, common)))


def test_jaccard_of_odd_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (2, None, None)], "doc_id long, text string, node string")
    rows = jaccard_join.jaccard_components(d).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in rows) == [(0, 3, 0), (1, 3, 1), (1, 3, 1), (2, 0, 2)]
    assert jaccard_join.jaccard_components(d.limit(0)).count() == 0
    kept = jaccard_join.deduplicate(spark.createDataFrame([(1, "a b c d e f", 6), (2, "A b c d e f", 6), (3, "z", 1), (4, None, None)], "doc_id long, text string, n_chars long"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4] and kept.columns == ["doc_id", "text", "n_chars"]


def test_a_large_group_meets_its_pivot_first(spark):
    """Blocks far larger than a tile: most sets are linked to the pivot, some only to others, some to nothing; rows that repeat an id with one text or several."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] * 3
    for i in range(60):
        w = list(base)
        w[i % 60] = f"y{i}"
        texts.append(" ".join(w))
    for i in range(12):  # a chain that leaves the pivot step by step
        w = [f"z{k}" if k < 3 * i else x for k, x in enumerate(base)]
        texts.append(" ".join(w))
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string").repartition(3)
    sizes, component, links = joined(dict(enumerate(texts)), 4, 85, 100)
    assert len(set(component.values())) > 1
    got = jaccard_join.jaccard_components(docs, most_rows=6).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (sizes[i], component[i]) for i in sizes}
    many = docs.union(docs.where("doc_id = 0").crossJoin(spark.range(200)).select("doc_id", "text", "block")).union(spark.createDataFrame([(0, "quite another text", "x"), (0, None, "x")], docs.schema))
    again = jaccard_join.jaccard_components(many, most_rows=6).where("doc_id <> 0").collect()
    assert {r["doc_id"]: r["component_id"] for r in again} == {i: component[i] for i in sizes if i}
    assert dict(jaccard_join.jaccard_components(docs).dtypes)["n_shingles"] == "bigint"


def test_components_end_or_raise(spark):
    path = spark.range(2000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    with pytest.raises(RuntimeError):
        components(path, most_rounds=2)
    assert components(path).where("component <> 0").count() == 0
    nulls = spark.createDataFrame([(1, None), (None, 2), (3, 4)], "src long, dst long")
    assert sorted(map(tuple, components(nulls).collect())) == [(3, 3), (4, 3)]


def test_small_helpers(spark):
    d = spark.createDataFrame([(1, "x" * 500)], "a long, _A string")
    assert free_name("a", d) == "__a" and free_name("b", d) == "b"
    assert "broadcast" in hinted(d)._jdf.queryExecution().logical().toString() and "broadcast" not in hinted(d, most_bytes=300)._jdf.queryExecution().logical().toString()


def test_components_and_forest(spark):
    r = random.Random(1)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(5, 5)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    want = leaders({n for e in links for n in e}, links)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
    m = np.zeros((6, 6), bool)
    for a, b in ((0, 1), (1, 2), (0, 2), (4, 5)):
        m[a, b] = m[b, a] = True
    assert len(forest(m)) == 3


# ---- embeddings ----
@pytest.mark.parametrize("seed, chunk, axes", [(1, 2048, 1), (2, 7, 1), (3, 7, 2)])
def test_embedding_links_equal_brute_force(spark, seed, chunk, axes):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, 24))
    x = [centres[i % 6] + r.normal(size=24) * (0.02 + 0.3 * r.random()) for i in range(150)] + [centres[0], centres[0]]
    rows = [(i, [float(np.float32(c)) for c in v], i % 2) for i, v in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] + [1.0] * 23, 0), (903, [1.0] * 23 + [None], 0), (904, rows[0][1], None), (905, [float("inf")] * 24, 1), (906, [1.0, 2.0], 0), (907, [1.0, 2.0], 0), (908, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1))
    got = {g["vec_id"]: tuple(g)[1:] for g in embedding_dedup.near_duplicates(table, chunk=chunk, axes=axes).collect()}
    u = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: k for i, _, k in rows}
    ids = list(label)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if a in u and b in u and label[a] is not None and label[a] == label[b] and len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.93]
    component = leaders(ids, links)
    assert len(links) > 100
    assert got == {i: (sum(i in e for e in links), component[i], component[i] == i) for i in ids}
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(table.where("vec_id >= 900 and vec_id < 905")).count() == 5


def test_pairs_at_the_bound_are_decided_by_the_vectors_as_they_are(spark):
    """Cosines of exactly the bound and of the next number below it, and vectors of many dimensions."""
    x = np.zeros(64)
    x[0] = 1
    pairs = []
    for c in (0.93, np.nextafter(0.93, 0), np.nextafter(0.93, 1)):
        y = np.zeros(64)
        y[0], y[1] = c, np.sqrt(1 - c * c)
        pairs.append(y)
    rows = [(0, x.tolist(), 0), *((i, y.tolist(), 0) for i, y in enumerate(pairs, 1))]
    cosine = lambda y: float((x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()))
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got[0] == sum(cosine(y) >= 0.93 for y in pairs)
    wide = np.random.default_rng(5).normal(size=(12, 300))
    wide[7] = wide[3] * 2
    table = spark.createDataFrame([(i, v.tolist(), 1, "cell") for i, v in enumerate(wide)], "vec_id long, embedding array<double>, label int, cx string")
    assert {r["vec_id"] for r in embedding_dedup.near_duplicates(table).where("n_links = 1").collect()} == {3, 7}


def test_principal_axes_and_tiles(spark):
    r = np.random.default_rng(4)
    for width, rows in ((12, 300), (1, 5), (256, 40)):
        x = r.normal(size=(rows, width))
        v = embedding_dedup.fit_axes(spark.createDataFrame([(y.tolist(),) for y in x], "embedding array<double>"), width)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert np.allclose(v.T @ v, np.eye(width)) and np.all(np.diff(np.diag(v.T @ (u.T @ u) @ v)) <= 1e-9)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (r.normal(size=(40, 40)), r.normal(size=(50, 40))))
    b[:5] = a[:5]
    assert (embedding_dedup.tile_products(a, b, 0.93) == (a @ b.T >= 0.93)).all()


# ---- urls ----
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def test_rules_and_parts(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x", "http://example.com/en/8#f", "http://com/en/", "http://xcom/en/", "https://x.example.net/de/81", "http://net/de/9", "http://a.org/es", "http://É.org/es/x", "a://b://c/en/"]
    rows = url_templates.judge_urls(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string"), RULES).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[5] == ("example.com", "/en/8", "com/en/", "block") and got[6][2] == "com/en/" and got[7][2] is None
    assert got[8][2:] == ("example.net/de/8", "block") and got[9][2:] == ("net/de/", "allow")
    assert got[10][2] is None and got[11][:3] == ("É.org", "/es/x", "org/es/") and got[12][:2] == ("b:", "//c/en/")
    assert url_templates.judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_templates_carry_labels_to_other_urls(spark):
    urls = [f"http://h.com/spam/{w}/{i}" for i in range(60) for w in ("a", "b")] + [f"http://h.com/blog/2024-01-{i % 28 + 1:02d}/post{i}" for i in range(60)] + [f"http://h.com/u{chr(97 + i % 26)}{chr(97 + i // 26)}/home" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("block", f"h.com/spam/a/{i}") for i in range(10, 16)]
    rows = url_templates.judge_urls(pages, rules).collect()
    by = {r["path"]: r for r in rows}
    assert by["/spam/a/33"]["verdict"] == "block" and by["/spam/a/33"]["rule"] is None, "the template's purity is low"
    assert by["/blog/2024-01-05/post4"]["verdict"] == "allow" and by["/blog/2024-01-05/post4"]["template"] == "/blog/<date>/<id>"
    assert by["/uaa/home"]["template"] == "/*/home", "many rare siblings become a wildcard"


def test_branches_that_share_nothing_stay_apart(spark):
    urls = [f"http://h.com/news/sport/{w}{i}x" for i in range(40) for w in ("a", "b")] + [f"http://h.com/shop/cart/{i}" for i in range(80)]
    urls += [f"http://k.com/a/{s}/{chr(97 + i % 26)}{chr(97 + i // 26)}" for s in "xy" for i in range(50)]
    urls += [f"http://m.com/{s}/list/{i}" for s in ("red", "blue", "green") for i in range(30)] + ["http://m.com/odd/thing"]
    urls += ["http://long.com/" + "s/" * 30000 + "end", "http://long.com/" + "q" * 100000]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] * 2, "page_id long, url string, template string")
    rules = [("block", f"m.com/red/list/{i}") for i in range(10, 20)] + [("block", f"m.com/blue/list/{i}") for i in range(10, 20)]
    rows = url_templates.judge_urls(pages, rules).collect()
    assert len(rows) == 2 * len(urls), "repeated rows are judged each"
    by = {r["path"]: r for r in rows}
    assert by["/news/sport/a3x"]["template"] == "/news/sport/<id>" or by["/news/sport/a3x"]["template"].startswith("/news/sport/")
    assert by["/shop/cart/3"]["template"] == "/shop/cart/<n>"
    assert {r["template"].split("/")[2] for r in rows if r["host"] == "k.com"} == {"x", "y"}, "rare segments say nothing of likeness"
    assert by["/red/list/25"]["template"] == "/{blue|green|red}/list/<n>" and by["/red/list/25"]["verdict"] == "block" and by["/red/list/25"]["rule"] is None
    assert by["/green/list/5"]["verdict"] == "block" and by["/green/list/5"]["rule"] is None, "no labels of its own, alike otherwise"
    assert by["/" + "s/" * 30000 + "end"]["template"] == "/" + "/".join(["s"] * 16) + "/**" and by["/" + "q" * 100000]["template"] == "/<id>"


# ---- fixity ----
def test_audit_finds_exactly_the_damage(spark, tmp_path):
    pages = spark.createDataFrame([(i // 2, f"http://h/{i}", f"<p>{'é' * (i % 50)}\r\n\r\n{i}") for i in range(600)] + [(None, None, None), (7, "http://h/14", "<p>" + "é" * 14 + "\r\n\r\n14")], "page_id long, url string, html string")
    hurt = pages.withColumn("html", F.when(F.col("url").isin("http://h/10", "http://h/599"), F.overlay("html", F.lit("X"), F.lit(1))).otherwise(F.col("html")))
    a = warc_fixity.laid_out(pages, 50).cache()
    assert a.groupBy("file").agg((F.sum("length") == F.max(F.col("offset") + F.col("length"))).alias("ok")).where("not ok").count() == 0, "records lie without gaps"
    got = warc_fixity.audit(a, warc_fixity.laid_out(hurt, 50).where("page_id is null or page_id <> 200"))
    count = {r["status"]: r["count"] for r in got.groupBy("status").count().collect()}
    assert count == {"intact": 598, "altered": 2, "missing": 2}
    assert got.where("status = 'altered'").select("page_id").distinct().count() == 2
    back = warc_fixity.audit(a.where("page_id <> 3"), a)
    assert {r["status"]: r["count"] for r in back.groupBy("status").count().collect()}["extra"] == 3
    assert warc_fixity.audit(a, a).where("status <> 'intact'").count() == 0
    empty = pages.limit(0)
    assert warc_fixity.fixity_audit(empty, empty, F.lit(False)).count() == 0


def test_files_are_read_in_splits_and_audited(spark, tmp_path):
    """Bodies that hold records, files cut into many splits, a body made longer, a record that is gone, one that came."""
    quoted = "WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nfoo"
    rows = [(i // 2, f"http://h/{i}", f"<p>{'é' * (i % 50)}\r\n\r\n{i}" + (f"\r\n\r\n{quoted}" if i % 100 == 3 else ""), "x") for i in range(300)] + [(None, None, None, "y"), (7, "http://h/14", "again", "z"), (500, "http://long", "long " * 60000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha256 string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        warc_fixity.write_warc(pages, str(tmp_path / "a"), 50)
        columns = ["file", "offset", "length", "record_id", "sha256"]
        read = warc_fixity.read_warc(spark, str(tmp_path / "a")).cache()
        assert sorted(map(tuple, read.select(columns).collect())) == sorted(map(tuple, warc_fixity.laid_out(pages, 50).select(columns).collect()))
        bodies = {r["url"]: bytes(r["body"]).decode() for r in read.collect()}
        assert bodies["http://h/103"] == rows[103][2] and bodies["http://long"] == rows[-1][2] and bodies[""] == ""
        longer = pages.withColumn("html", F.when(F.col("url") == "http://h/10", F.concat("html", F.lit("zz"))).otherwise(F.col("html")))
        warc_fixity.write_warc(longer, str(tmp_path / "b"), 50)
        a, b = (warc_fixity.read_warc(spark, str(tmp_path / n), bodies=False) for n in "ab")
        got = warc_fixity.audit(a, b).cache()
        assert {r["status"]: r["count"] for r in got.groupBy("status").count().collect()} == {"intact": len(rows) - 1, "altered": 1}
        assert got.where("status = 'altered'").first()["url"] == "http://h/10"
        other = warc_fixity.audit(a.where("url <> 'http://h/20'"), b.where("url <> 'http://h/200'"))
        assert {(r["status"], r["url"]) for r in other.where("status <> 'intact'").collect()} == {("altered", "http://h/10"), ("missing", "http://h/200"), ("extra", "http://h/20")}
        (tmp_path / "c").mkdir()
        (tmp_path / "c" / "broken.warc").write_bytes(b"no head at all\r\n\r\nWARC/1.1\r\nContent-Length: x\r\n\r\n")
        assert warc_fixity.read_warc(spark, str(tmp_path / "c")).where("record_id is null").count() == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def random_words(seed):
    r = random.Random(seed)
    return lambda: "".join(r.choice("abcdefghij") for _ in range(6))


def verdicts(spark, urls, rules):
    rows = url_templates.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    return {r["path"]: r for r in rows}


def test_a_tree_goes_on_below_wildcards(spark):
    w = random_words(1)
    by = verdicts(spark, [f"http://h.com/user/{w()}/post/{w()}" for _ in range(300)], [])
    assert {r["template"] for r in by.values()} == {"/user/*/post/*"}


def test_merged_branches_are_one_below(spark):
    w = random_words(2)
    urls = [f"http://h.com/ads/{w()}/track/{w()}" for _ in range(200)] + [f"http://h.com/adz/{w()}/track/{w()}" for _ in range(50)] + [f"http://h.com/news/{w()}" for _ in range(50)] + [f"http://h.com/shop/{w()}/item/{w()}" for _ in range(50)]
    by = verdicts(spark, urls, [("block", "h.com/ads/")])
    assert {r["template"] for r in by.values()} == {"/{ads|adz}/*/track/*", "/news/*", "/shop/*/item/*"}
    assert all(r["verdict"] == ("block" if p.startswith("/ad") else "allow") for p, r in by.items())
    assert all(r["rule"] is None for p, r in by.items() if p.startswith("/adz"))


def test_labels_that_contradict_keep_branches_apart(spark):
    w = random_words(3)
    urls = [f"http://h.com/{x}/{w()}/track/{w()}" for x in ("good", "bad") for _ in range(60)]
    by = verdicts(spark, urls, [("block", "h.com/bad/"), ("allow", "h.com/good/")])
    assert {r["template"] for r in by.values()} == {"/good/*/track/*", "/bad/*/track/*"}


def test_purity_leans_on_the_branch_above(spark):
    rules = [("block", f"h.com/{x}/") for x in "ab"]
    two, one = [f"http://h.com/{x}/{i}" for x in "abc" for i in range(30)], [f"http://h.com/{x}/{i}" for x in "ac" for i in range(30)]
    # of labelled siblings each counts once, with 2 of 0.5: (0 + 0 + 1) / (2 + 2) and (0 + 1) / (1 + 2)
    by = verdicts(spark, two, rules)
    assert round(by["/c/1"]["purity"], 9) == 0.25 and by["/c/1"]["verdict"] == "block", "two bad siblings"
    by = verdicts(spark, one, rules)
    assert round(by["/c/1"]["purity"], 6) == 0.333333 and by["/c/1"]["verdict"] == "allow", "one bad sibling says little"
