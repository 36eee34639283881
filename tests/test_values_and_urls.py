from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import html, text, urls, values


def one(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs)) if inputs else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url, path",
    [("http://x.com", "/"), ("not a url", "/"), ("https://x.com/a/b?q#f", "/a/b"), (None, "/"), ("http://x.com?q=/z", "/"), ("HTTPS://X.com/A b", "/A b")],
)
def test_url_path(spark, url, path):
    assert one(spark, values.url_path(F.col("u")), u=url) == path


@pytest.mark.parametrize("ct, url, kind", [("application/pdf", "", "pdf"), (None, "/privacy-policy.PDF", "pdf"), ("text/plain", "/x", "html"), ("application/xhtml+xml", "/x", "html"), (None, "/about", "doc"), (None, None, "doc")])
def test_page_type(spark, ct, url, kind):
    assert one(spark, values.page_type(F.col("c"), F.col("u")), c=ct, u=url) == kind


def test_sizes(spark):
    sizes = spark.createDataFrame([(18322,), (1,), (1536,), (0,)], "n long").select(values.format_kb(F.col("n")).alias("x"))
    assert [r["x"] for r in sizes.collect()] == ["18 KB", "1 KB", "2 KB", "1 KB"]
    assert one(spark, values.text_size(F.col("t")), t="a😀") == 2
    assert one(spark, values.text_size(F.col("t"), utf16=True), t="a😀") == 3
    assert one(spark, values.text_size(F.col("t")), t=None) == 0


def test_or_else_takes_empty_for_missing(spark):
    assert one(spark, values.or_else(F.col("a"), F.col("b"), "Untitled"), a="", b="X") == "X"
    assert one(spark, values.or_else(F.col("a"), F.col("b"), "Untitled"), a="", b=None) == "Untitled"


def test_small_values(spark):
    assert one(spark, values.percent(F.lit(1), F.lit(3))) == 33
    assert one(spark, values.percent(F.lit(1), F.lit(0))) is None
    assert one(spark, values.basic_token(F.lit("a"), F.lit("b"))) == "YTpi"
    assert one(spark, values.folded(F.lit("  Ab "))) == "ab"


@pytest.mark.parametrize(
    "rule, url, expected",
    [
        ("lower_case_scheme_host", "HTTP://U:P@EX.Com:80/Ab", "http://U:P@ex.com:80/Ab"),
        ("upper_case_escape_sequence", "http://a/%c2%b1x%zz", "http://a/%C2%B1x%zz"),
        ("decode_unreserved_characters", "http://a/%7Eb%2d%2F", "http://a/~b-%2F"),
        ("encode_non_uri_characters", "http://a/^[x] é", "http://a/%5E[x]%20%C3%A9"),
        ("encode_spaces", "http://a/b c", "http://a/b%20c"),
        ("remove_default_port", "http://a:80/b", "http://a/b"),
        ("remove_default_port", "https://a:443", "https://a"),
        ("remove_default_port", "http://a:8080/b", "http://a:8080/b"),
        ("remove_fragment", "http://a/b#c/d", "http://a/b"),
        ("remove_trailing_fragment", "http://a/#!/b#c", "http://a/#!/b"),
        ("remove_trailing_fragment", "http://a/#b/c", "http://a/#b/c"),
        ("remove_trailing_hash", "http://a/b#", "http://a/b"),
        ("remove_trailing_question_mark", "http://a/b?", "http://a/b"),
        ("remove_query_string", "http://a/b?c=d", "http://a/b"),
        ("remove_empty_parameters", "http://a/b?a=b&a=&c=d&e=&f=g#x", "http://a/b?a=b&c=d&f=g#x"),
        ("remove_empty_parameters", "http://a/b?a=", "http://a/b"),
        ("sort_query_parameters", "http://a/b?z=1&a=2", "http://a/b?a=2&z=1"),
        ("remove_session_ids", "http://a/b;jsessionid=1E6FEC0D14D044541DD84D2D013D29ED", "http://a/b"),
        ("remove_session_ids", "http://a/b?x=1&PHPSESSID=f9f2770d591366bc&y=2", "http://a/b?x=1&y=2"),
        ("remove_session_ids", "http://a/b?PHPSESSID=f9", "http://a/b"),
        ("remove_dot_segments", "http://a/../a/b/../c/./d.html", "http://a/a/c/d.html"),
        ("remove_dot_segments", "http://a/b/..", "http://a/"),
        ("remove_dot_segments", "http://a", "http://a"),
        ("remove_duplicate_slashes", "http://a//b///c?d=//e", "http://a/b/c?d=//e"),
        ("remove_directory_index", "http://a/b/index.html", "http://a/b/"),
        ("add_directory_trailing_slash", "http://a/b", "http://a/b/"),
        ("add_directory_trailing_slash", "http://a/b.html", "http://a/b.html"),
        ("add_domain_trailing_slash", "http://a?b", "http://a/?b"),
        ("remove_trailing_slash", "http://a/b/", "http://a/b"),
        ("add_www", "http://a/b", "http://www.a/b"),
        ("remove_www", "http://www.a/b", "http://a/b"),
        ("secure_scheme", "http://a/b", "https://a/b"),
        ("unsecure_scheme", "https://a/b", "http://a/b"),
        ("lower_case", "HTTP://A/B?C", "http://a/b?c"),
        ("lower_case_path", "HTTP://A/B?C", "HTTP://A/b?C"),
        ("lower_case_query", "HTTP://A/B?C=D", "HTTP://A/B?c=d"),
        ("lower_case_query_parameter_names", "http://a/?Ab=Cd&E=F", "http://a/?ab=Cd&e=F"),
        ("lower_case_query_parameter_values", "http://a/?Ab=Cd&E=F", "http://a/?Ab=cd&E=f"),
    ],
)
def test_rules(spark, rule, url, expected):
    got = one(spark, urls.RULES[rule](F.col("u")), u=url)
    assert got == expected
    if rule not in ("remove_trailing_hash", "remove_trailing_question_mark", "remove_trailing_slash", "remove_trailing_fragment"):
        assert one(spark, urls.RULES[rule](F.col("u")), u=got) == got, "a rule applied twice changes nothing more"


def test_rules_leave_others_alone(spark):
    for rule, f in urls.RULES.items():
        assert one(spark, f(F.col("u")), u=None) is None, rule
        assert one(spark, f(F.col("u")), u="") == "", rule


def test_chain(spark):
    got = urls.normalize(F.col("u"), ["lower_case_scheme_host", "remove_fragment", urls.replacing("/x/", "/y/")])
    assert one(spark, got, u="HTTP://A.b/x/C#d") == "http://a.b/y/C"


@pytest.mark.parametrize(
    "base, href, expected",
    [
        ("http://a/b/c?q", "d", "http://a/b/d"), ("http://a/b/c", "/d", "http://a/d"), ("https://a/b", "//x/y", "https://x/y"), ("http://a", "d", "http://a/d"), ("http://a/b/c", "../d", "http://a/d"),
        ("http://a/b", "?x", "http://a/b?x"), ("http://a/b?q", "#f", "http://a/b?q#f"), ("http://a/b", "mailto:x@y", None), ("http://a/b", "", None), ("http://a/b", "https://z/", "https://z/"),
    ],
)
def test_absolute(spark, base, href, expected):
    assert one(spark, urls.absolute(F.col("b"), F.col("h")), b=base, h=href) == expected


PAGE = """<html><head><title> T &amp; x </title><META NAME="Robots" content='noindex, follow'><meta property="og:image" content="i.png"><meta name=description content=d1>
<link rel="canonical" href="/c"><style>p{}</style></head><body><!-- no --><h1>Head <b>one</b></h1><script>var a="<p>";</script><p class="k">Par &eacute;</p><a rel=nofollow href="/n">n</a><a class=x href='u?v'>Go <i>on</i></a><img src=z.png></body></html>"""


def test_html(spark):
    h = F.col("h")
    assert one(spark, html.title(h), h=PAGE) == "T &amp; x"
    assert one(spark, html.decode_entities(html.title(h)), h=PAGE) == "T & x"
    assert one(spark, html.plain_text(h), h=PAGE) == "T &amp; x Head one Par &eacute; n Go on"
    assert one(spark, html.heading(h), h=PAGE) == "Head one"
    assert one(spark, html.meta(h, "description"), h=PAGE) == "d1"
    assert one(spark, html.meta(h, "absent"), h=PAGE) is None
    assert one(spark, html.robots_meta(h), h=PAGE).asDict() == {"noindex": True, "nofollow": False}
    assert one(spark, html.robots_meta(h, F.lit("NONE")), h="<p>").asDict() == {"noindex": True, "nofollow": True}
    assert one(spark, html.canonical(h), h=PAGE) == "/c"
    assert one(spark, html.canonical(h, F.lit('<http://z/>; rel="canonical"')), h=PAGE) == "http://z/"
    assert one(spark, html.featured_image(h), h=PAGE) == "i.png"
    assert one(spark, html.featured_image(h), h="<img src='a.gif'>") == "a.gif"
    assert one(spark, html.select(h, "body a.x", "href"), h=PAGE) == ["u?v"]
    assert one(spark, html.select(h, "p.k"), h=PAGE) == ["Par é"]


def test_text(spark):
    assert one(spark, text.tokens(F.col("t")), t="Don't STOP, é1!") == ["don", "t", "stop", "é1"]
    assert [text.auto_edits(t) for t in ("ab", "abcde", "abcdef")] == [0, 1, 2]
    assert text.swaps("abc") == ["bac", "acb"] and text.swaps("a") == []
    assert one(spark, text.highlight(F.col("t"), ["a", "ab"]), t="Ab a abc") == "<em>Ab</em> <em>a</em> abc"
    found = one(spark, text.fragments(F.col("t"), ["fox"], 20, 2), t="one two three four five fox six seven fox fox eight nine ten")
    assert len(found) == 2 and "<em>fox</em>" in found[0]


def test_near_edits_count_exchanges_of_neighbours(spark):
    """Against an independent engine, on all pairs of short words."""
    duckdb = pytest.importorskip("duckdb")
    words = ["".join(w) for n in range(1, 5) for w in itertools.product("abc", repeat=n)] + ["licence", "ilcence", "licnece", "liecnec", "lciecne", "licenes"]
    pairs = [(a, b) for a in words[::2] + words[-8:] for b in words]
    rows = spark.createDataFrame([(a, b, text.swaps(b)) for a, b in pairs], "a string, b string, s array<string>")
    got = {(r["a"], r["b"]): r["n"] for r in rows.select("a", "b", text.near_edits(F.col("a"), F.col("b"), F.col("s")).alias("n")).collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE p (a VARCHAR, b VARCHAR)")
    c.executemany("INSERT INTO p VALUES (?, ?)", pairs[::37] + pairs[-8:])
    assert one(spark, text.near_edits(F.col("a"), F.lit("éa"), F.array(F.lit("aé"))), a="aé") == 1
    for a, b, n in c.sql("SELECT a, b, damerau_levenshtein(a, b) FROM p").fetchall():
        assert got[a, b] == min(n, 3), (a, b)
