"""Links of pages: extraction, resolution and the edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import html, urls

# Tags and attributes that hold links.
LINK_TAGS = {"a": "href", "frame": "src", "iframe": "src", "img": "src", "meta": "http-equiv", "base": "href", "form": "action", "area": "href", "link": "href"}


def tag_links(page: Column, tags: dict[str, str] | None = None, nofollow: bool = True, comments: bool = False, between: list[tuple[str, str]] | None = None, outside: list[tuple[str, str]] | None = None) -> Column:
    """Array of struct(tag, attr, href, text) in the page's order by tag.

    Links with rel=nofollow are left out unless ``nofollow`` is False; those in comments unless ``comments``. ``between``: only these
    regions, ``outside``: none of these, each as (start, end) patterns.
    """
    body = page if comments else F.regexp_replace(page, r"(?s)<!--.*?-->", "")
    for start, end in outside or []:
        body = F.regexp_replace(body, rf"(?is){start}.*?{end}", "")
    if between:
        body = F.concat_ws(" ", *[F.array_join(F.regexp_extract_all(body, F.lit(rf"(?is){s}(.*?){e}"), F.lit(1)), " ") for s, e in between])
    return F.concat(*[_links_of(body, tag, attr, nofollow) for tag, attr in (tags or {"a": "href"}).items()])


def _links_of(body: Column, tag: str, attr: str, nofollow: bool) -> Column:
    found = F.regexp_extract_all(body, F.lit(rf"(?is)<{tag}\s[^>]*>" + (r"(?:(?:(?!<a\s).)*?</a>)?" if tag == "a" else "")), F.lit(0))

    def link(t: Column) -> Column:
        start = F.regexp_extract(t, r"(?s)^<[^>]*>", 0)
        inside = html.plain_text(t) if tag == "a" else F.lit("")
        return F.struct(F.lit(tag).alias("tag"), F.lit(attr).alias("attr"), html.attribute(start, attr).alias("href"), inside.alias("text"), html.attribute(start, "rel").alias("rel"))

    kept = F.filter(F.transform(found, link), lambda x: x["href"] != "")
    return F.filter(kept, lambda x: ~F.lower(x["rel"]).contains("nofollow")) if nofollow else kept


def regex_links(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Links that patterns give through their replacement (with $1 and so on)."""
    def found(pattern: str, replacement: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.regexp_replace(m, pattern, replacement))

    return F.concat(*[found(*p) for p in patterns])


def feed_links(xml: Column) -> Column:
    """Links of RSS and Atom feeds."""
    rss = F.regexp_extract_all(xml, F.lit(r"(?is)<link>\s*(?:<!\[CDATA\[)?\s*([^<\]]+?)\s*(?:\]\]>)?\s*</link>"), F.lit(1))
    atom = F.filter(F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<link\s[^>]*>"), F.lit(0)), lambda t: html.attribute(t, "href")), lambda h: h != "")
    return F.concat(rss, atom)


def dom_links(page: Column, selectors: dict[str, str]) -> Column:
    """Links by CSS selector and attribute."""
    return F.concat(*[html.select(page, s, a) for s, a in selectors.items()])


def edges(pages: DataFrame, url: str = "url", page: str = "html", most_length: int = 2048, **options) -> DataFrame:
    """(src, dst, tag, attr, text): absolute links without fragment, no longer than ``most_length``."""
    e = pages.select(F.col(url).alias("src"), F.explode(tag_links(F.col(page), **options)).alias("l"))
    e = e.select("src", urls.remove_fragment(urls.absolute(F.col("src"), F.col("l.href"))).alias("dst"), "l.tag", "l.attr", "l.text")
    return e.where(F.col("dst").isNotNull() & (F.length("dst") <= most_length))


def referrers(edge: DataFrame, depths: DataFrame) -> DataFrame:
    """(url, referrer, text): of each link target the link from the shallowest page, then the least url. ``depths``: url, depth."""
    e = edge.join(depths.withColumnRenamed("url", "src"), "src")
    return e.groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("depth", "src", "text")).alias("m")).select("url", F.col("m.src").alias("referrer"), F.col("m.text").alias("text"))


def classified(edge: DataFrame, in_scope: Column, depths: DataFrame, most_depth: int) -> DataFrame:
    """Edges with class: OUTSCOPE, MAXDEPTH (from pages at the greatest depth) or INSCOPE."""
    e = edge.join(depths.withColumnRenamed("url", "src"), "src")
    return e.withColumn("class", F.when(~in_scope, "OUTSCOPE").when(F.col("depth") >= most_depth, "MAXDEPTH").otherwise("INSCOPE"))


def link_events(edge: DataFrame) -> DataFrame:
    return edge.groupBy(F.col("src").alias("url")).agg(F.lit("URLS_EXTRACTED").alias("event"), F.count(F.lit(1)).alias("links"))
