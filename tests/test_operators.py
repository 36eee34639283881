from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import fields, filters, frontier, links, recrawl, search
from corpusloom.plans import config

MOCK = [("/", "Home", "html"), ("/about", "About", "html"), ("/privacy-policy.pdf", "Privacy", "pdf"), ("/Zed", "zed", "doc"), ("/an", "Élan", "html")]


def urls_where(spark, test, *urls):
    return [r["u"] for r in spark.createDataFrame([(u,) for u in urls], "u string").where(test).collect()]


def test_quick_filter_and_sort(spark):
    rows = spark.createDataFrame([(str(i), *r, len(r[0])) for i, r in enumerate(MOCK)], "id string, path string, title string, type string, size long")
    assert [r["path"] for r in search.table_view(rows, " PDF ").collect()] == ["/privacy-policy.pdf"]
    assert search.table_view(rows, "").count() == len(MOCK)
    assert [r["title"] for r in search.table_view(rows, "", ("title", "asc"), "id").collect()] == ["About", "Élan", "Home", "Privacy", "zed"]
    assert [r["type"] for r in search.table_view(rows, "", ("type", "desc"), "id").collect()] == ["pdf", "html", "html", "html", "doc"]
    assert [r["id"] for r in search.table_view(rows, "", ("type", "desc"), "id").collect()][1:4] == ["0", "1", "4"], "equal rows keep their order"
    assert search.toggled(("path", "asc"), "path") == ("path", "desc") and search.toggled(("path", "desc"), "size") == ("size", "asc")


def test_request_guard():
    for bad in ("", None, 3):
        with pytest.raises(ValueError):
            filters.require_query(bad)
    filters.require_query("", match_all=True)


def test_extension_and_matchers(spark):
    u = F.col("u")
    ok = filters.accepted([filters.Filter(filters.has_extension(u, "zip, RAR,exe"), "exclude")])
    assert urls_where(spark, ok, "http://h/a.zip", "http://h/a.html", "http://h/x.rar?y=1", "http://h.zip", "http://h/zip") == ["http://h/a.html", "http://h.zip", "http://h/zip"]
    assert urls_where(spark, filters.matches(u, "ab", "regex"), "ab", "xab", "abx") == ["ab"]
    assert urls_where(spark, filters.matches(u, "A?*", "wildcard", True), "abc", "a") == ["abc"]
    assert urls_where(spark, filters.matches(u, "a, b", "csv"), "a", "c", "b") == ["a", "b"]
    both = filters.accepted([filters.Filter(u.contains("a")), filters.Filter(u.contains("b")), filters.Filter(u.contains("c"), "exclude")])
    assert urls_where(spark, both, "a", "b", "ac", "d") == ["a", "b"]
    assert urls_where(spark, filters.accepted([]), "a") == ["a"]


def test_segments_and_scope(spark):
    u = F.col("u")
    assert urls_where(spark, filters.segment_count(u, 3), "http://h/a/b/c", "http://h/a//b") == ["http://h/a/b/c"]
    assert urls_where(spark, filters.segment_count(u, 2, duplicates=True), "http://h/a/b/a", "http://h/a/b/c") == ["http://h/a/b/a"]
    start = F.lit("https://ex.com/")
    found = ("https://ex.com/x", "https://a.ex.com/x", "http://ex.com/x", "https://ex.com:8443/x", "https://notex.com/")
    assert urls_where(spark, filters.in_scope(start, u, protocol=True, port=True), *found) == ["https://ex.com/x"]
    assert urls_where(spark, filters.in_scope(start, u, subdomains=True, protocol=True, port=True), *found) == ["https://ex.com/x", "https://a.ex.com/x"]
    assert len(urls_where(spark, filters.in_scope(start, u, domain=False), *found)) == 5
    assert urls_where(spark, filters.prefixes(u, ["/a"], ["/ab"]), "/a", "/abc", "/b") == ["/a"]
    assert urls_where(spark, filters.has_status(F.col("u").cast("int"), "200,301-303"), "200", "302", "404") == ["200", "302"]
    assert urls_where(spark, filters.has_content_type(u, ["text/html"]), "Text/HTML; charset=x", "text/plain") == ["Text/HTML; charset=x"]


def test_robots_longest_match(spark):
    rules = spark.createDataFrame([("h", "*", "disallow", "/"), ("h", "*", "allow", "/a"), ("h", "*", "disallow", "/a/*.gif$"), ("h", "bot", "disallow", "/z"), ("k", "*", "disallow", "/x"), ("k", "*", "disallow", "")], "host string, agent string, kind string, pattern string")
    pages = spark.createDataFrame([(u,) for u in ("http://h/a/b", "http://h/q", "http://h/a/i.gif", "http://h/a/i.gif?x", "http://other/", "http://k/x+y")], "url string")
    got = {r["url"]: r["allowed"] for r in filters.robots_allowed(pages, rules, "loom").collect()}
    assert got == {"http://h/a/b": True, "http://h/q": False, "http://h/a/i.gif": False, "http://h/a/i.gif?x": True, "http://other/": True, "http://k/x+y": False}
    named = {r["url"]: r["allowed"] for r in filters.robots_allowed(pages, rules, "BOT").collect()}
    assert named["http://h/q"] and named["http://h/a/b"]


def test_canonical_and_restriction(spark):
    h = "<link rel=canonical href='http://A/x/'>"
    row = spark.createDataFrame([("http://a/x#f", h), ("http://a/y", h), ("http://a/z", "<p>")], "url string, html string")
    test = filters.is_canonical(F.col("url"), F.col("html"))
    assert [r["k"] for r in row.select(test.alias("k")).collect()] == [True, False, True]
    assert row.where(filters.is_canonical(F.col("url"), F.col("html"), ignore=True)).count() == 3
    m = spark.createDataFrame([({"k": ["a", "b"]},), ({"j": ["b"]},), (None,)], "m map<string, array<string>>")
    assert m.where(filters.restricted(F.col("m"), "k", "B", "basic", True)).count() == 1


def test_taggers(spark):
    d = spark.createDataFrame([(1, "a", {"X-a": ["1"], "b": ["2"]})], "id int, title string, m map<string, array<string>>")
    assert fields.keep_only(d, "title, none").columns == ["title"]
    assert fields.delete_matching(d, "t.*").columns == ["id", "m"]
    assert fields.add_constant(d, SITE="s").first()["SITE"] == "s"
    assert fields.keep_only_in(d, "m", "b,c").first()["m"] == {"b": ["2"]}
    assert fields.delete_matching_in(d, "m", "X-.*").first()["m"] == {"b": ["2"]}


def docs(spark):
    return spark.createDataFrame([(1, "red fox", "quick", "the fox runs home"), (2, "home", "", "a fox fox fox"), (3, None, None, None), (4, "fxo den", "x", "nothing")], "doc_id long, title string, description string, content string")


BOOSTS = {"title": 3.0, "description": 2.0, "content": 1.0}


def test_search_takes_the_best_field(spark):
    hits = search.search(docs(spark), "fox", BOOSTS, fuzzy=False).collect()
    assert [h["doc_id"] for h in hits] == [1, 2]
    per = {(r["doc_id"], r["field"]): r["score"] for r in search.field_scores(search.index_of(docs(spark), list(BOOSTS), ["fox"]), ["fox"]).collect()}
    assert hits[0]["_score"] == pytest.approx(max(3 * per[1, "title"], per[1, "content"]))
    assert hits[0]["title_highlight"] == "red <em>fox</em>" and hits[0]["content_highlight"] == ["the <em>fox</em> runs home"]


def test_search_with_typos(spark):
    assert {h["doc_id"] for h in search.search(docs(spark), "fox", BOOSTS).collect()} == {1, 2, 4}, "a transposition is one edit"
    assert search.search(docs(spark), "fox", BOOSTS, size=1).count() == 1
    with pytest.raises(ValueError):
        search.search(docs(spark), "", BOOSTS)
    assert search.match_all(docs(spark), 2).count() == 2
    assert {h["doc_id"] for h in search.uri_search(docs(spark), "home", list(BOOSTS)).collect()} == {1, 2}


def test_response(spark):
    r = search.response(docs(spark), "fox", BOOSTS, 2)
    assert r["total"] == 3 and len(r["hits"]) == 2 and r["took"] >= 0 and r["hits"][0]["doc_id"] == 1
    assert search.response(docs(spark), None, BOOSTS, 2)["total"] == 4


def test_written_index_gives_the_same(spark, tmp_path):
    search.write_index(docs(spark), list(BOOSTS), str(tmp_path / "i"))
    index = search.Index.read(spark, str(tmp_path / "i"))
    a = search.search(docs(spark), "fox home", BOOSTS, fuzzy=False, marked=False).collect()
    b = search.search(docs(spark), "fox home", BOOSTS, fuzzy=False, marked=False, index=index).collect()
    assert [(r["doc_id"], round(r["_score"], 9)) for r in a] == [(r["doc_id"], round(r["_score"], 9)) for r in b]
    assert search.total_hits(index, ["fox"]).first()["total"] == 2
    c, d = (search.search(docs(spark), "fxo hmoe", BOOSTS, index=i).collect() for i in (None, index))
    assert [(r["doc_id"], round(r["_score"], 9), r["title_highlight"]) for r in c] == [(r["doc_id"], round(r["_score"], 9), r["title_highlight"]) for r in d] and len(c) == 3
    assert c[0]["title_highlight"] in ("red <em>fox</em>", "<em>home</em>", "<em>fxo</em> den"), "tokens reached by typos are marked"
    few = search.Index.read(spark, str(tmp_path / "i")).vocabulary(["fox"])
    assert "fox" in {r["token"] for r in few.collect()} and few.count() < index.words.count() / 2
    search.write_index(docs(spark).limit(0), list(BOOSTS), str(tmp_path / "none"), buckets=3)
    assert search.search(docs(spark), "fox", BOOSTS, index=search.Index.read(spark, str(tmp_path / "none"))).count() == 0
    assert search.index_stats(docs(spark), "n", ["title"]).first()["docs_count"] == 4


def test_words_are_counted_in_their_row(spark):
    rows = [(1, "a b a c a"), (2, ""), (3, None), (4, "x " * 5000 + "y")]
    got = {(r["doc_id"], r["token"]): (r["tf"], r["length"]) for r in search.postings(spark.createDataFrame(rows, "doc_id long, t string"), ["t"]).collect()}
    assert got == {(1, "a"): (3, 5), (1, "b"): (1, 5), (1, "c"): (1, 5), (4, "x"): (5000, 5001), (4, "y"): (1, 5001)}
    assert "Exchange" not in search.postings(spark.range(1).selectExpr("id AS doc_id", "'a' AS t"), ["t"])._jdf.queryExecution().executedPlan().toString()


def test_top_is_a_prefix_of_the_sort(spark):
    scores = spark.createDataFrame([(i, float(i % 3)) for i in range(20)], "doc_id long, _score double")
    full = [r["doc_id"] for r in scores.orderBy(F.desc("_score"), "doc_id").collect()]
    assert [r["doc_id"] for r in search.top(scores, 7).collect()] == full[:7]


def test_links(spark):
    page = "<!--<a href='c'>--><a href=\"/x\">A</a> <a rel='nofollow' href=y>B</a><div id=n><a href=z#t>C</a></div><img src=i.png><a href='mailto:q'>M</a>"
    p = spark.createDataFrame([("http://h/d/", page)], "url string, html string")
    assert [r["dst"] for r in links.edges(p).collect()] == ["http://h/x", "http://h/d/z"]
    assert [r["text"] for r in links.edges(p).collect()] == ["A", "C"]
    assert [r["dst"] for r in links.edges(p, nofollow=False, tags={"a": "href", "img": "src"}).collect()] == ["http://h/x", "http://h/d/y", "http://h/d/z", "http://h/d/i.png"]
    assert [r["dst"] for r in links.edges(p, outside=[("<div id=n>", "</div>")]).collect()] == ["http://h/x"]
    assert [r["dst"] for r in links.edges(p, between=[("<div id=n>", "</div>")]).collect()] == ["http://h/d/z"]
    assert len(links.edges(p, comments=True).collect()) == 3
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(links.regex_links(F.lit("see id:12 id:7"), [(r"id:(\d+)", "http://h/$1")])) == ["http://h/12", "http://h/7"]
    assert one(links.feed_links(F.lit("<rss><link> http://a/1 </link><item><link><![CDATA[http://a/2]]></link></item></rss>"))) == ["http://a/1", "http://a/2"]
    assert one(links.feed_links(F.lit("<feed><link href='http://a/3'/></feed>"))) == ["http://a/3"]
    assert one(links.dom_links(F.lit(page), {"#n a": "href"})) == ["z#t"]


def test_frontier_is_minimal(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f")], "src string, dst string")
    s = spark.createDataFrame([("a",)], "url string")
    got = {r["url"]: (r["depth"], r["referrer"]) for r in frontier.breadth_first(s, e, 3).collect()}
    assert got == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "b"), "e": (3, "d")}
    assert frontier.breadth_first(s, e, 9, lambda u: u != "d").count() == 3
    prev, cur = spark.createDataFrame([("a",), ("b",)], "url string"), s
    assert [r["url"] for r in frontier.orphans(prev, cur).collect()] == ["b"]
    assert spark.range(1).select(frontier.depth_state(F.lit(3), 2).alias("x")).first()["x"] == "TOO_DEEP"


def test_redirects(spark):
    r = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "url string, target string")
    got = {x["url"]: (x["target"], x["trail"]) for x in frontier.redirect_trails(r).collect()}
    assert got["a"] == ("c", ["a", "b"]) and got["b"] == ("c", ["b"]) and got["x"][1] == ["x", "y"]
    long = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)], "url string, target string")
    cut_off = {x["url"]: (x["target"], x["complete"]) for x in frontier.redirect_trails(long, most_hops=2).collect()}
    assert cut_off["0"] == ("3", False) and cut_off["2"] == ("5", False) and cut_off["3"] == ("6", True) and cut_off["5"] == ("6", True)


def test_sitemap_and_crawlers(spark):
    xml = "<urlset><url><loc> http://a </loc><lastmod>2024-01-01</lastmod><changefreq>daily</changefreq><priority>0.5</priority></url><url><loc></loc></url></urlset>"
    e = spark.range(1).select(F.explode(frontier.sitemap_entries(F.lit(xml))).alias("e")).collect()
    assert len(e) == 1 and e[0]["e"]["loc"] == "http://a" and e[0]["e"]["changefreq"] == "DAILY" and e[0]["e"]["priority"] == 0.5
    d = spark.range(2)
    assert {r["crawler_id"] for r in frontier.with_crawler(a=d, b=d).collect()} == {"a", "b"}


def test_checksums_and_recrawl(spark):
    d = spark.createDataFrame([(2, "x"), (1, "x"), (3, None), (4, None)], "id int, c string")
    assert sorted(r["id"] for r in recrawl.without_duplicates(d, recrawl.content_checksum(F.col("c")), "id").collect()) == [1, 3, 4]
    c = spark.createDataFrame([("http://a/news", "2024-01-01 00:00:00", "NEVER"), ("http://a/x", "2024-01-01 00:00:00", "DAILY"), ("http://a/y", None, None), ("http://a/news2", "2024-01-01 00:00:00", None)], "url string, last_crawl string, changefreq string").withColumn("last_crawl", F.col("last_crawl").cast("timestamp"))
    rules = [("url", ".*news.*", timedelta(days=7))]
    due = lambda **k: [r["due"] for r in recrawl.recrawl_due(c, rules, F.lit("2024-01-03").cast("timestamp"), **k).orderBy("url").collect()]
    assert due() == [False, False, True, True]
    assert due(sitemap="LAST") == [False, False, True, True]
    assert due(sitemap="NEVER") == [False, False, True, True]
    row = lambda *v: spark.range(1).select(recrawl.unmodified(*[F.lit(x) for x in v]).alias("x")).first()["x"]
    assert row("e", "e", None, None) and not row("e", "f", None, None) and row(None, "f", 1, 2) and not row(None, None, 3, 2)


def test_delays(spark):
    d = spark.createDataFrame([(i, f"http://h{i % 2}/{'s' if i > 3 else 'f'}") for i in range(6)], "id int, url string")
    at = F.lit("2024-01-01 10:00:00").cast("timestamp")  # a Monday
    delay = recrawl.delay_ms(F.col("url"), at, 1000, [({2}, None, (9, 17), 500)], [(".*/s", 50)])
    got = [(r["delay_ms"], r["start_ms"]) for r in recrawl.fetch_schedule(d, delay, ["id"]).orderBy("id").collect()]
    assert got == [(500, 0), (500, 0), (500, 500), (500, 500), (50, 1000), (50, 1000)]
    whole = [r["start_ms"] for r in recrawl.fetch_schedule(d, delay, ["id"], scope="crawler").orderBy("id").collect()]
    assert whole == [0, 500, 1000, 1500, 2000, 2050]


def test_config(spark, tmp_path):
    (tmp_path / "inc.txt").write_text("x=$a")
    assert config.interpolated('#parse("inc.txt") ${b} $c', {"a": "1", "b": "2"}, str(tmp_path)) == "x=1 2 $c"
    assert config.read_variables("# c\nk = v\n") == {"k": "v"}
    assert config.inherited({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}, "b": 1}
    with pytest.raises(LookupError):
        config.STEPS.make("Nothing")
    assert config.search_source({}, "/base", "docs") == ("/base/docs", {})
    assert config.search_source({"SEARCH_BASE": "/b", "SEARCH_INDEX": "i", "SEARCH_USER": "u", "SEARCH_PASSWORD": "p"}, "/base", "docs") == ("/b/i", {"Authorization": "Basic dTpw"})
    assert '"seed_url": "http://a"' in config.CrawlConfig("http://a").to_json()
    p = spark.createDataFrame([("http://a/1", "<title>t</title>x"), ("http://a/2", "<title>t</title>x"), ("http://a/3", "<meta name=robots content=noindex>")], "url string, html string")
    assert [r["url"] for r in config.import_pages(p, before=[lambda df: df], after=[lambda df: df]).collect()] == ["http://a/1"]


def test_cuts_are_deleted_and_small_tables_are_dealt_out(spark, tmp_path):
    import os

    from corpusloom.plans import lineage

    a, b = lineage.cut(spark.range(5)), lineage.cut(spark.range(7))
    lineage.discard(a)
    assert not os.path.exists(a.cut_path) and b.count() == 7
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert lineage.spread(t).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    d = spark.range(3)
    assert lineage.spread(d) is d
