"""Column functions that turn raw fields into those of a page row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it: nested rules would otherwise multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def or_else(*values: Column | str) -> Column:
    """The first value that is neither null nor an empty string; the last one as it is."""
    cols = [F.lit(v) if isinstance(v, str) else v for v in values]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def url_of(source: Column, doc_id: Column) -> Column:
    return or_else(source["Content-Location"], doc_id)


def title_of(source: Column) -> Column:
    return or_else(source["s365:title"], source["dc:title"], "Untitled")


def description_of(source: Column) -> Column:
    return or_else(source["og:description"], "")


def content_of(source: Column) -> Column:
    return or_else(source["content"], source["og:description"], "")


def metadata_of(source: Column) -> Column:
    sitemap = F.struct(source["collector.sitemap-changefreq"].alias("changefreq"), source["collector.sitemap-priority"].alias("priority"))
    return F.struct(source["collector.depth"].alias("depth"), source["document.contentType"].alias("contentType"), sitemap.alias("sitemap"))


def url_path(url: Column) -> Column:
    """The path of an absolute url; ``/`` if it is empty or there is none."""
    return or_else(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/")


def page_type(content_type: Column, url: Column) -> Column:
    ct, u = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    return F.when(ct.contains("pdf") | u.endswith(".pdf"), "pdf").when(ct.contains("html") | ct.contains("text/"), "html").otherwise("doc")


def text_size(content: Column, utf16: bool = False) -> Column:
    """Code points of a text, 0 for null; with ``utf16`` its UTF-16 units."""
    n = F.octet_length(F.encode(content, "UTF-16BE")) / 2 if utf16 else F.length(content)
    return F.coalesce(n, F.lit(0)).cast("long")


def format_kb(size: Column) -> Column:
    return F.concat(F.greatest(F.lit(1), F.floor(size / 1024 + 0.5)).cast("string"), F.lit(" KB"))


def folded(text: Column) -> Column:
    return F.lower(F.trim(text))


def percent(done: Column, total: Column) -> Column:
    """Whole percents, truncated; null for a total of 0."""
    return F.try_divide(done * 100, total).cast("int")


def basic_token(user: Column, password: Column) -> Column:
    return F.base64(F.concat(user, F.lit(":"), password).cast("binary"))


def page_row(doc_id: Column, url: Column, title: Column, content_type: Column, content: Column) -> list[Column]:
    """Columns id, path, title, type, size."""
    return [doc_id.cast("string").alias("id"), url_path(url).alias("path"), or_else(title, "Untitled").alias("title"), page_type(content_type, url).alias("type"), text_size(content).alias("size")]


def running_sums(numbers: Column) -> Column:
    """For each number of an array the sum of those before it. In chunks of about the cube root, so that n numbers cost n^(4/3) and not n^2 additions."""
    width = F.greatest(F.lit(1), F.ceil(F.cbrt(2 * F.size(numbers))).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def sums(a: Column, w: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / w).cast("int")), lambda c: F.slice(a, c * w + 1, w))
        within = lambda chunk, start: F.transform(chunk, lambda _, i: start + total(F.slice(chunk, 1, i)))
        with_starts = lambda cs: let(F.transform(cs, total), lambda ts: F.transform(cs, lambda chunk, c: let(total(F.slice(ts, 1, c)), lambda start: within(chunk, start))))
        return F.flatten(let(chunks, with_starts))

    return F.when(F.size(numbers) > 0, let(numbers, lambda a: let(width, lambda w: sums(a, w)))).otherwise(F.array().cast("array<int>"))
