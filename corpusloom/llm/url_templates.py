"""URL filtering by path templates per host, with DataFrame functions only.

Every url is reduced to its host and the shape of its path, whose segments that vary by form (numbers, ids, dates) are
wildcards. A tree of these paths per host, far smaller than the urls, is then generalised level by level: segments that vary by count become
wildcards, and sibling branches that a test on the counts of what follows them finds alike are merged, each into one branch, before the next level is looked at. A
template is rated by its share of good labels, smoothed towards its parent branch. Templates of low purity are rejected; rules decide before.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.values import let
from corpusloom.llm.common import cut, hinted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ``://``."""
    at = F.locate("://", url) if isinstance(url, str) else F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. ``rules``: (verdict, host and path prefix)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def shape(path: Column, most_depth: int = 16) -> Column:
    """The path's segments, with those that vary by form as wildcards that keep their extension; all beyond ``most_depth`` are one ``**``."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")

    def one(s: Column) -> Column:
        ext = F.lower(F.regexp_extract(s, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1))
        stem = F.regexp_replace(s, r"\.[A-Za-z][A-Za-z0-9]{0,4}$", "")
        kind = (
            F.when(stem.rlike(r"^[0-9]{4}-[0-9]{1,2}(?:-[0-9]{1,2})?$"), "<date>")
            .when(stem.rlike(r"^[0-9]+$"), "<n>")
            .when(stem.rlike(r"^[0-9a-fA-F-]{16,}$"), "<hex>")
            .when(stem.rlike(r"[0-9]") & (F.length(stem) > 3) | (F.length(stem) > 40), "<id>")
        )
        return F.coalesce(F.concat(kind, ext), s)

    short = lambda s: F.concat(F.transform(F.slice(s, 1, most_depth), one), F.when(F.size(s) > most_depth, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>")))
    return let(segments, short)


def named(follow: Column) -> Column:
    """Whether one of two following segments, joined by a slash, is a word of its own: neither a wildcard nor an end."""
    return F.exists(F.split(follow, "/"), lambda s: (s != "") & (s != "*") & (s != "**") & ~s.startswith("<"))


def alike(x: Column, y: Column) -> Column:
    """Whether two branches, structs of total, good, bad and follows (map of what follows to its share), are samples of one distribution, as far as their counts can tell.

    The Jensen-Shannon divergence of two samples of one distribution of k outcomes is (k - 1) (1/n + 1/m) / (8 ln 2) bits on average; three times that, and a
    fiftieth of a bit, is allowed, but never more than a quarter. At least half of what follows has to be named, in both: that both go on with something variable
    says nothing. Where both have labels, their shares of good ones may differ by a fifth.
    """
    keys = F.array_union(F.map_keys(x["follows"]), F.map_keys(y["follows"]))
    share = lambda b, k: F.coalesce(F.try_element_at(b["follows"], k), F.lit(0.0))
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    bits = total(F.transform(keys, lambda k: (part(share(x, k), (share(x, k) + share(y, k)) / 2) + part(share(y, k), (share(x, k) + share(y, k)) / 2)) / 2))
    noise = 3 * (F.size(keys) - 1) * (1 / x["total"] + 1 / y["total"]) / (8 * log(2))
    known = lambda b: F.round(total(F.transform(F.map_keys(b["follows"]), lambda k: F.when(named(k), share(b, k)).otherwise(0.0))), 9) >= 0.5
    labels = (x["good"] + x["bad"] == 0) | (y["good"] + y["bad"] == 0) | (F.round(F.abs(F.try_divide(x["good"], x["good"] + x["bad"]) - F.try_divide(y["good"], y["good"] + y["bad"])), 9) <= 0.2)
    return (F.round(bits, 9) <= F.least(F.lit(0.25), F.round(0.02 + noise, 9))) & known(x) & known(y) & labels


def branch_segments(rows: DataFrame, most_children: int, least_share: float) -> DataFrame:
    """(host, prefix, token, seg): what each segment of a level becomes. ``rows``: (host, prefix, token, next, after, n, good, bad).

    A segment becomes ``*`` if its branch has more than ``most_children`` different ones and it less than ``least_share`` of the branch's urls. Of the others, at most
    most_children or 1 / least_share for each branch, every one joins the most frequent sibling that is alike(), itself included; those that join the same one
    are merged. What follows a segment is two segments; those that would be wildcards, or are too rare to be named, are ``*``.
    """
    node = ["host", "prefix", "token"]
    whole = rows.groupBy(*node).agg(F.sum("n").alias("total"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    kids = whole.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("kids"), F.sum("total").alias("among"))
    by_form = F.col("token").startswith("<") | (F.col("token") == "**")
    rare = (F.col("kids") > most_children) & (F.col("total") < least_share * F.col("among"))
    judged = cut(whole.join(kids, ["host", "prefix"]).withColumn("seg", F.when(by_form, F.col("token")).when(rare, "*")))
    plain = judged.where("seg is null").select(*node, "total", "good", "bad")
    nexts = rows.join(plain.select(*node, "total"), node).groupBy(*node, "next", "after").agg(F.sum("n").alias("n"), F.first("total").alias("total"))
    of_next = nexts.groupBy(*node, "next").agg(F.sum("n").alias("m"))
    many = of_next.groupBy(*node).agg(F.count(F.lit(1)).alias("kinds"))
    of_next = of_next.join(many, node)
    nexts = nexts.join(of_next, [*node, "next"]).withColumn("next", F.when((F.col("kinds") > most_children) & (F.col("m") < least_share * F.col("total")), "*").otherwise(F.col("next")))
    nexts = nexts.groupBy(*node, "next", "after").agg(F.sum("n").alias("n"), F.first("total").alias("total"))
    after = F.when(F.col("n") < least_share * F.col("total"), "*").otherwise(F.col("after"))
    follows = nexts.groupBy(*node, F.concat("next", F.lit("/"), after).alias("follow")).agg((F.sum("n") / F.first("total")).alias("share"))
    profile = plain.join(follows.groupBy(*node).agg(F.map_from_entries(F.collect_list(F.struct("follow", "share"))).alias("follows")), node)
    # siblings are few by the bound above, so a branch's are one row
    siblings = profile.groupBy("host", "prefix").agg(F.collect_list(F.struct("token", "total", "good", "bad", "follows")).alias("all"))
    leader = F.transform("all", lambda x: F.struct(x["token"].alias("token"), F.array_max(F.transform(F.filter("all", lambda y: (y["token"] == x["token"]) | alike(x, y)), lambda y: F.struct(y["total"].alias("n"), y["token"].alias("token"))))["token"].alias("leader")))
    led = siblings.select("host", "prefix", F.explode(leader).alias("x")).select("host", "prefix", "x.token", "x.leader")
    merged = led.groupBy("host", "prefix", "leader").agg(F.array_sort(F.collect_set("token")).alias("of"))
    merged = merged.select("host", "prefix", F.explode("of").alias("token"), F.when(F.size("of") > 1, F.concat(F.lit("{"), F.array_join("of", "|"), F.lit("}"))).otherwise(F.col("of")[0]).alias("seg"))
    return judged.where("seg is not null").select(*node, "seg").union(merged.select(*node, "seg"))


def path_templates(paths: DataFrame, most_children: int = 24, least_share: float = 0.05, strength: float = 2.0, prior: float = 0.5) -> DataFrame:
    """(host, key, template, purity) for rows (host, shape, n, good, bad), one for each host and shape; key is the shape, joined.

    Every level's segments are replaced, by branch_segments(), before the next level is grouped under the new branches. A branch's own mean is that of its
    labelled children, each counting once and ``strength`` times the mean of the branch above it, ``prior`` above the host; a template's purity is its share of good labels with
    ``strength`` times its branch's mean. So one bad sibling doesn't condemn a template without labels, several do.
    """
    start = paths.select("host", F.array_join("shape", "/").alias("key"), "shape", "n", "good", "bad", F.lit("").alias("prefix"), F.lit(prior).alias("mean"))
    found, todo, depth = start.where(F.size("shape") == 0).withColumn("prefix", F.lit("/")), cut(start.where(F.size("shape") > 0)), 0
    while not todo.isEmpty():  # as often as the longest shape has segments
        at = lambda k, depth=depth: F.coalesce(F.get("shape", F.lit(depth + k)), F.lit(""))
        rows = todo.select("host", "prefix", at(0).alias("token"), at(1).alias("next"), at(2).alias("after"), "n", "good", "bad")
        segs = cut(branch_segments(rows, most_children, least_share))
        placed = todo.withColumn("token", at(0)).join(segs, ["host", "prefix", "token"])
        child = placed.groupBy("host", "prefix", "seg").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.first("mean").alias("mean"))
        labelled = F.col("good") + F.col("bad") > 0
        means = child.groupBy("host", "prefix").agg(((F.coalesce(F.sum(F.when(labelled, F.try_divide("good", F.col("good") + F.col("bad")))), F.lit(0.0)) + strength * F.first("mean")) / (F.count(F.when(labelled, 1)) + strength)).alias("mean"))
        placed = placed.drop("mean").join(means, ["host", "prefix"])
        depth += 1
        placed = cut(placed.select("host", "key", "shape", "n", "good", "bad", F.concat("prefix", F.lit("/"), "seg").alias("prefix"), "mean"))
        found, todo = found.union(placed.where(F.size("shape") == depth)), placed.where(F.size("shape") > depth)
    rated = found.groupBy("host", "prefix").agg(((F.sum("good") + strength * F.first("mean")) / (F.sum("good") + F.sum("bad") + strength)).alias("purity"))
    return found.select("host", "key", "prefix").join(rated, ["host", "prefix"]).select("host", "key", F.col("prefix").alias("template"), "purity")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], reject_below: float = 0.3) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row. Rules label the urls they fit: allow good, block bad.

    Null urls and urls without ``://`` have an empty host and path. Repeated rows give repeated results and count as often; other columns are not
    read, whatever their names; an empty table gives an empty result. Very long urls are judged by their rules as they are; their template is
    that of their first 16 segments.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, what = matching_rule(F.col("host"), F.col("path"), rules)
    urls = cut(urls.select("*", rule.alias("rule"), what.alias("what"), shape(F.col("path")).alias("shape")))
    paths = urls.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("what") == "allow", 1)).alias("good"), F.count(F.when(F.col("what") == "block", 1)).alias("bad"))
    found = cut(path_templates(paths))
    out = urls.withColumn("key", F.array_join("shape", "/")).join(hinted(found, 100_000), ["host", "key"], "left")
    verdict = F.coalesce("what", F.when(F.col("purity") < reject_below, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
