"""Predicates on references, metadata and documents, and how include and exclude filters combine."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import html, urls
from corpusloom.functions.values import folded, let


def quick(query: str, *columns: Column) -> Column:
    """Rows that hold the trimmed query in a column, in any case; an empty query keeps all rows."""
    q = query.strip().lower()
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(q) for c in columns]) if q else F.lit(True)


def require_query(query: object, match_all: bool = False) -> None:
    if not match_all and (not isinstance(query, str) or not query):
        raise ValueError("query must be a non-empty string")


def simulated_failure(target_url: Column) -> Column:
    return target_url.contains("error")


def extension(url: Column) -> Column:
    """Lower-cased extension of the last path segment, empty if it has none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*/[^/?#]*\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))


def has_extension(url: Column, extensions: str) -> Column:
    """``extensions``: separated by commas, in any case."""
    return extension(url).isin([e.strip().lower() for e in extensions.split(",") if e.strip()])


def matches(value: Column, pattern: str, method: str = "regex", ignore_case: bool = False) -> Column:
    """Methods: regex (of the whole value), basic (equality), csv (equality with one of a list), wildcard (* and ?)."""
    v = F.lower(value) if ignore_case else value
    p = pattern.lower() if ignore_case and method != "regex" else pattern
    if method == "regex":
        return value.rlike(f"^(?:{'(?i)' if ignore_case else ''}{pattern})$")
    if method == "basic":
        return v == p
    if method == "csv":
        return v.isin([x.strip() for x in p.split(",")])
    if method == "wildcard":
        import re

        return v.rlike("^" + re.escape(p).replace(r"\*", ".*").replace(r"\?", ".") + "$")
    raise ValueError(f"unknown method {method}")


@dataclass(frozen=True)
class Filter:
    test: Column
    on_match: str = "include"


def accepted(filters: list[Filter]) -> Column:
    """No exclude filter matches, and some include filter does if there are any. Null tests don't match."""
    no = [F.coalesce(f.test, F.lit(False)) for f in filters if f.on_match == "exclude"]
    yes = [F.coalesce(f.test, F.lit(False)) for f in filters if f.on_match == "include"]
    keep = reduce(lambda a, b: a & ~b, no, F.lit(True))
    return keep & reduce(lambda a, b: a | b, yes) if yes else keep


def segments(url: Column, separator: str = "/") -> Column:
    return F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), separator), lambda s: s != "")


def segment_count(url: Column, at_least: int, duplicates: bool = False, separator: str = "/") -> Column:
    """URLs with ``at_least`` path segments; with ``duplicates``, in which one segment occurs that often."""
    s = segments(url, separator)
    if not duplicates:
        return F.size(s) >= at_least
    return F.exists(F.array_distinct(s), lambda x: F.size(F.filter(s, lambda y: y == x)) >= at_least)


def in_scope(start: Column, url: Column, domain: bool = True, port: bool = False, protocol: bool = False, subdomains: bool = False) -> Column:
    keep = F.lit(True)
    if domain:
        same = urls.host(start) == urls.host(url)
        keep = keep & (same | urls.host(url).endswith(F.concat(F.lit("."), urls.host(start))) if subdomains else same)
    if port:
        keep = keep & urls.port(start).eqNullSafe(urls.port(url))
    if protocol:
        keep = keep & (urls.scheme(start) == urls.scheme(url))
    return keep


def within_depth(depth: Column, most: int) -> Column:
    """A negative limit means none."""
    return depth <= most if most >= 0 else F.lit(True)


def most_documents(docs: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """The first ``most`` documents of an order; all for a negative limit."""
    return docs.orderBy(*order).limit(most) if most >= 0 else docs


def prefixes(path: Column, include: list[str], exclude: list[str]) -> Column:
    starts = lambda ps: reduce(lambda a, b: a | b, [path.startswith(p) for p in ps])
    return accepted([*([Filter(starts(include))] if include else []), *([Filter(starts(exclude), "exclude")] if exclude else [])])


def robots_allowed(pages: DataFrame, rules: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """``pages`` with robots_rule and allowed: of the host's rules whose pattern begins the path, the longest decides, allow at equal length.

    ``rules``: host, agent, kind (allow or disallow), pattern with ``*`` and a final ``$``. Rules meet pages on their host only; where
    rules name the agent, those for ``*`` don't count. A page without rules is allowed.
    """
    asked = F.lower("agent") == agent.lower()
    named = rules.where(asked).select("host").distinct().withColumn("_named", F.lit(True))
    r = rules.where(asked | (F.col("agent") == "*")).join(named, "host", "left").where(F.col("_named").isNull() | asked)
    # every character but * and the final $ stands for itself
    quoted = F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"([\\.\[\]{}()+?^|])", r"\\$1"), r"\*", ".*"), r"\$(?!$)", r"\\\$")
    r = r.where(F.coalesce("pattern", F.lit("")) != "").select(F.lower("host").alias("_host"), (F.lower("kind") == "allow").alias("_allow"), "pattern", F.concat(F.lit("^"), quoted).alias("_regex"))
    many = r.groupBy("_host").agg(F.collect_list(F.struct((-F.length("pattern")).alias("n"), (~F.col("_allow")).alias("deny"), "pattern", "_regex")).alias("_rules"))  # a host's robots.txt
    _, _, path, query, _ = urls.parts(F.col(url))
    where = F.concat(F.when(path == "", "/").otherwise(path), query)
    fits = F.get(F.array_sort(F.filter("_rules", lambda x: F.regexp_like(F.col("_where"), x["_regex"]))), F.lit(0))
    out = pages.withColumn("_host", urls.host(F.col(url))).withColumn("_where", where).join(many, "_host", "left").withColumn("_rule", fits)
    return out.select(*pages.columns, F.col("_rule.pattern").alias("robots_rule"), F.coalesce(~F.col("_rule.deny"), F.lit(True)).alias("allowed"))


def indexable(page: Column, header: Column | None = None) -> Column:
    return ~html.robots_meta(page, header)["noindex"]


def is_canonical(url: Column, page: Column, header: Column | None = None, rules: list[str] | None = None, ignore: bool = False) -> Column:
    """Whether a page names no other canonical url; both are normalised by ``rules`` before they are compared."""
    if ignore:
        return F.lit(True)
    norm = lambda u: urls.normalize(u, rules or ["lower_case_scheme_host", "remove_fragment", "remove_trailing_slash"])
    found = urls.absolute(url, html.canonical(page, header))
    return let(found, lambda f: F.when(f.isNull(), True).otherwise(norm(f) == norm(url)))


def has_status(status: Column, codes: str) -> Column:
    """``codes``: numbers and ranges separated by commas, such as ``200,301-308``."""
    tests = []
    for c in codes.split(","):
        low, _, high = c.strip().partition("-")
        tests.append(status.between(int(low), int(high or low)))
    return reduce(lambda a, b: a | b, tests)


def restricted(metadata: Column, field: str, pattern: str, method: str = "regex", ignore_case: bool = False) -> Column:
    """Documents of which a value of a field (map of arrays) matches."""
    return F.coalesce(F.exists(F.try_element_at(metadata, F.lit(field)), lambda v: matches(v, pattern, method, ignore_case)), F.lit(False))


def has_content_type(content_type: Column, types: list[str]) -> Column:
    """By the type before any parameter, in any case."""
    return folded(F.split(content_type, ";")[0]).isin([t.lower() for t in types])
