"""The crawl frontier over stored pages: breadth-first, one join and one anti join for each depth."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.operators.filters import Filter, accepted
from corpusloom.plans.lineage import cut


def breadth_first(starts: DataFrame, edges: DataFrame, most_depth: int, accept: Callable[[Column], Column] | None = None) -> DataFrame:
    """(url, depth, referrer): every url once, at its least depth, with the least referrer of that depth.

    ``starts``: url. ``edges``: src, dst; they are cut, so that links are extracted once and not at every depth. ``accept`` decides on a target,
    before it is joined with anything. Ends when a depth is empty; a negative ``most_depth`` means no limit.
    """
    e = edges.select("src", "dst")
    if accept is not None:
        e = e.where(accept(F.col("dst")))
    e = cut(e.distinct())
    seen = front = cut(starts.select("url").distinct().select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("referrer")))
    for depth in count(1) if most_depth < 0 else range(1, most_depth + 1):
        new = front.join(e, front["url"] == e["src"]).groupBy(F.col("dst").alias("url")).agg(F.min("src").alias("referrer"))
        front = cut(new.join(seen, "url", "left_anti").select("url", F.lit(depth).alias("depth"), "referrer"))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def queue_pipeline(candidates: DataFrame, rules: list[str], scope: Column, filters: list[Filter], most_depth: int, url: str = "url") -> DataFrame:
    """Candidates in the fixed order normalise, scope, filters, depth, one row for each url; all but the last are one pass of column predicates."""
    out = candidates.withColumn(url, urls.normalize(F.col(url), rules)).where(scope).where(accepted(filters))
    out = out.where(F.col("depth") <= most_depth) if most_depth >= 0 else out
    return out.groupBy(url).agg(F.min("depth").alias("depth"))


def depth_state(depth: Column, most_depth: int) -> Column:
    return F.when(depth > most_depth, "TOO_DEEP").otherwise("NEW")


def redirect_trails(redirects: DataFrame, most_hops: int = 10) -> DataFrame:
    """(url, target, trail, complete): where a chain of redirects ends and what it passes, loops cut at the url that comes again.

    ``redirects``: url, target, one for each url. A chain of more than ``most_hops`` is not ``complete``: its target redirects further.
    """
    step = cut(redirects.select(F.col("url").alias("_from"), F.col("target").alias("_to")))
    out = cut(redirects.select("url", "target", F.array("url").alias("trail"), F.lit(True).alias("open")))
    on = F.col("_to").isNotNull() & ~F.array_contains("trail", F.col("target"))
    for _ in range(most_hops):
        far = out.join(step, (out["target"] == step["_from"]) & out["open"], "left")
        out = cut(far.select("url", F.when(on, F.col("_to")).otherwise(F.col("target")).alias("target"), F.when(on, F.array_append("trail", F.col("target"))).otherwise(F.col("trail")).alias("trail"), F.coalesce(on, F.lit(False)).alias("open")))
        if out.where("open").isEmpty():
            break
    more = out.join(step, (out["target"] == step["_from"]) & out["open"], "left")
    return more.select("url", "target", "trail", (~F.coalesce(on, F.lit(False))).alias("complete"))


def canonical_groups(links: DataFrame) -> DataFrame:
    """(url, canonical, hops, loop) of every url in ``links`` (url, target), redirects and canonical links alike: where following them ends.

    Pointer doubling: each round a url's pointer becomes that of what it points at, so a chain of n hops takes log2(n) rounds, each one join of the urls that have not
    arrived. What is left when pointers reach further than urls are left, and none has arrived in the last round, goes round in a loop, whose canonical is its least url, without a number of hops. A url
    with several targets has the least; null ends and links to oneself are none. Urls that are only targets are their own canonical, with 0 hops.
    Both sides of every join grow with the links, so they are shuffled: sent to all tasks, each round would pass them through the driver.
    """
    step = cut(links.where("url is not null and target is not null and url <> target").groupBy("url").agg(F.min("target").alias("to")))
    ends = step.select(F.col("to").alias("url")).union(links.where("url is not null and (target is null or target = url)").select("url")).distinct().join(step.select("url").hint("merge"), "url", "left_anti")
    done = cut(ends.select("url", F.col("url").alias("canonical"), F.lit(0).cast("long").alias("hops"), F.lit(False).alias("loop")))
    todo = cut(step.select("url", "to", F.lit(1).cast("long").alias("hops"), F.col("url").alias("least")))  # least: of the url and those its pointer has passed
    reach, before = 1, None
    while (left := todo.count()) and (reach <= 2 * left or left != before):  # after a round in which none arrived, none will
        before = left
        ahead = todo.select(F.col("url").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"), F.col("least").alias("low"), F.lit(False).alias("ended"))
        ahead = ahead.union(done.select("url", "canonical", "hops", "url", F.lit(True)))
        moved = cut(todo.join(ahead.hint("merge"), "to").select("url", "next", (F.col("hops") + F.col("more")).alias("hops"), F.least("least", "low").alias("least"), "ended"))
        done = done.union(moved.where("ended").select("url", F.col("next").alias("canonical"), "hops", F.lit(False).alias("loop")))
        todo = moved.where("not ended").select("url", F.col("next").alias("to"), "hops", "least")
        reach *= 2
    # pointers have gone further than there are urls: they are in their loop, and what they pass from there is all of it
    round_ = todo.join(todo.select(F.col("url").alias("to"), F.col("least").alias("canonical")).hint("merge"), "to")
    return done.union(round_.select("url", "canonical", F.lit(None).cast("long").alias("hops"), F.lit(True).alias("loop")))


def orphans(previous: DataFrame, current: DataFrame, key: str = "url") -> DataFrame:
    """What was there and is not any more: the rows to delete."""
    return previous.join(current.select(key), key, "left_anti")


def sitemap_entries(xml: Column) -> Column:
    """Array of struct(loc, lastmod, changefreq, priority) of a sitemap; of an index file, its sitemaps."""
    tag = lambda t, name: F.nullif(F.trim(F.regexp_extract(t, rf"(?is)<{name}>(.*?)</{name}>", 1)), F.lit(""))
    found = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), F.lit(1))
    entry = lambda t: F.struct(tag(t, "loc").alias("loc"), tag(t, "lastmod").alias("lastmod"), F.upper(tag(t, "changefreq")).alias("changefreq"), tag(t, "priority").try_cast("float").alias("priority"))
    return F.filter(F.transform(found, entry), lambda x: x["loc"].isNotNull())


def with_crawler(**crawls: DataFrame) -> DataFrame:
    """Results of several crawlers in one table, with crawler_id."""
    out = None
    for name, df in crawls.items():
        part = df.withColumn("crawler_id", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
