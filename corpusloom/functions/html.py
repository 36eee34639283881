"""Text, fields and directives of HTML pages, by regular expressions that stay within the JVM."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.values import let


def plain_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, runs of white space as one space. Entities stay (see decode_entities)."""
    x = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style[^>]*>.*?</style>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(x, r"[ \t\r\n\f]+", " "))


@F.pandas_udf(StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _html.unescape(t) if t is not None else None)


def title(html: Column) -> Column:
    """The first title's text, trimmed; empty if there is none."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def heading(html: Column, level: int = 1) -> Column:
    return plain_text(F.regexp_extract(html, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", 1))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a start tag, quoted or not; empty if it is not there."""
    value = r"\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)"
    return F.regexp_replace(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*({value})", 1), "^[\"']|[\"']$", "")


def meta_fields(html: Column) -> Column:
    """Map of the page's meta names and properties to the arrays of their contents, in order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))
    key = lambda t: let(attribute(t, "name"), lambda n: F.lower(F.when(n != "", n).otherwise(attribute(t, "property"))))
    pairs = F.filter(F.transform(tags, lambda t: F.struct(key(t).alias("key"), attribute(t, "content").alias("value"))), lambda p: p["key"] != "")

    def grouped(ps: Column) -> Column:
        keys = F.array_distinct(F.transform(ps, lambda p: p["key"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(ps, lambda p: p["key"] == k), lambda p: p["value"])))

    return let(pairs, grouped)


def meta(html: Column, name: str) -> Column:
    """The first content of a meta name or property; null if it is not there."""
    return F.get(F.try_element_at(meta_fields(html), F.lit(name.lower())), F.lit(0))


def robots_meta(html: Column, header: Column | None = None) -> Column:
    """Struct (noindex, nofollow) from the robots meta tag and, if given, the X-Robots-Tag header."""
    text = F.coalesce(F.array_join(F.try_element_at(meta_fields(html), F.lit("robots")), ","), F.lit(""))
    if header is not None:
        text = F.concat(text, F.lit(","), F.coalesce(header, F.lit("")))
    words = F.transform(F.split(F.lower(text), ","), lambda w: F.trim(w))
    has = lambda ws, w: F.array_contains(ws, w) | F.array_contains(ws, "none")
    return let(words, lambda ws: F.struct(has(ws, "noindex").alias("noindex"), has(ws, "nofollow").alias("nofollow")))


def canonical(html: Column, header: Column | None = None) -> Column:
    """The canonical url from the Link header or else the page; null if neither has one."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<link\s[^>]*>"), F.lit(0))
    found = F.nullif(attribute(F.get(F.filter(tags, lambda t: F.lower(attribute(t, "rel")) == "canonical"), F.lit(0)), "href"), F.lit(""))
    if header is None:
        return found
    return F.coalesce(F.nullif(F.regexp_extract(header, r"(?i)<([^>]*)>\s*;\s*rel=\"?canonical\"?", 1), F.lit("")), found)


def featured_image(html: Column) -> Column:
    """The address of the page's main image: og:image, else the first img; null if neither is there."""
    first = F.nullif(attribute(F.regexp_extract(html, r"(?is)<img\s[^>]*>", 0), "src"), F.lit(""))
    return F.coalesce(F.nullif(meta(html, "og:image"), F.lit("")), first)


class _Selected(HTMLParser):
    """Values of an attribute, or texts, of the elements that match a selector ``tag.class#id[attribute]``, under others if spaced."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, selector: str, attr: str | None):
        super().__init__(convert_charrefs=True)
        self.steps = [re.findall(r"[#.]?[\w-]+|\[[\w-]+\]|\*", s) for s in selector.split()]
        self.attr, self.stack, self.out, self.open = attr, [], [], []

    @staticmethod
    def fits(step: list[str], tag: str, attrs: dict) -> bool:
        return all(
            p == "*" or (p[1:] in (attrs.get("class") or "").split() if p[0] == "." else attrs.get("id") == p[1:] if p[0] == "#" else p[1:-1] in attrs if p[0] == "[" else p == tag) for p in step
        )

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        found = self.fits(self.steps[-1], tag, attrs)
        todo = len(self.steps) - 2
        for t, a in reversed(self.stack):
            if todo >= 0 and self.fits(self.steps[todo], t, a):
                todo -= 1
        if found and todo < 0:
            if self.attr:
                if attrs.get(self.attr):
                    self.out.append(attrs[self.attr])
            else:
                self.out.append("")
                self.open.append((len(self.stack), len(self.out) - 1))
        if tag not in self.VOID:
            self.stack.append((tag, attrs))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                self.open = [o for o in self.open if o[0] < i]
                break

    def handle_data(self, data):
        for _, i in self.open:
            self.out[i] += data


def select(html: Column, selector: str, attr: str | None = None) -> Column:
    """Array of attribute values (or texts) of the elements that a CSS selector picks. Runs in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = []
            for x in b:
                p = _Selected(selector, attr)
                p.feed(x or "")
                out.append(p.out)
            yield pd.Series(out)

    return run(html)
