"""Full-text search: index tables and ranked queries on them.

The index is a table of postings (doc_id, field, token, tf, length), a vocabulary (field, token, df) and totals of each field. Written with
write_index() postings are partitioned by a bucket of the token and the vocabulary by a bucket of the forms of the token's halves, so that a query reads the
buckets of its terms, and by these forms, by which a misspelling meets them in an equi-join. Made on the fly, all but the query's terms are dropped
before anything is shuffled.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import auto_edits, fragments, halved, halves, highlight, near_edits, query_tokens, swaps, tokens
from corpusloom.functions.values import let
from corpusloom.operators.filters import quick, require_query
from corpusloom.plans.lineage import cut, exists

K1, B, LONGEST = 1.2, 0.75, 32
POSTINGS = "doc_id long, field string, token string, tf long, length long, bucket int"


def field_tokens(docs: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """(doc_id, field, tokens), one row for each document and field; texts are read once."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("tokens")) for f in fields])
    return docs.select(F.col(key).alias("doc_id"), F.explode(each).alias("x")).select("doc_id", "x.field", "x.tokens")


def counted(words: Column) -> Column:
    """Array of struct(token, tf) of an array of words: sorted, so that equal ones are runs."""

    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        size = lambda s, i: F.coalesce(F.get(s, i + 1), F.size(w)) - F.get(s, i)
        return let(starts, lambda s: F.transform(s, lambda at, i: F.struct(F.get(w, at).alias("token"), size(s, i).cast("long").alias("tf"))))

    return let(F.sort_array(words), lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(F.array().cast("array<struct<token:string,tf:bigint>>")))


def postings_of(field_words: DataFrame) -> DataFrame:
    """(doc_id, field, token, tf, length) of field_tokens(): counted in each row, nothing is shuffled. Rows that repeat a key stay apart."""
    t = field_words.select("doc_id", "field", F.size("tokens").cast("long").alias("length"), F.explode(counted(F.col("tokens"))).alias("x"))
    return t.select("doc_id", "field", "x.token", "x.tf", "length")


def postings(docs: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """(doc_id, field, token, tf, length), one row for each document, field and distinct token."""
    return postings_of(field_tokens(docs, fields, key))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("field", "token").agg(F.count(F.lit(1)).alias("df"))


def document_lengths(docs: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    return field_tokens(docs, fields, key).select("doc_id", "field", F.size("tokens").cast("long").alias("length"))


def write_index(docs: DataFrame, fields: list[str], path: str, key: str = "doc_id", buckets: int = 64, tasks_a_bucket: int = 8) -> None:
    """Postings by bucket of the token, the vocabulary by bucket of the forms of its words' halves (11 a word at most) and the totals of each field. Buckets should grow with the corpus: one holds a
    part of the postings that a query reads as a whole, written by ``tasks_a_bucket`` tasks at least, and by as many as its bytes need."""
    p = postings(docs, fields, key).withColumn("bucket", F.pmod(F.hash("token"), F.lit(buckets)))
    p = p.withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(tasks_a_bucket))).hint("rebalance", F.col("bucket"), F.col("deal")).drop("deal")
    p.sortWithinPartitions("bucket", "field", "token", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    words = document_frequency(_read_parts(docs.sparkSession, f"{path}/postings", "bucket", POSTINGS))
    forms = words.select("field", "token", "df", F.explode(halved(F.col("token"))).alias("form")).withColumn("bucket", F.pmod(F.hash("form"), F.lit(buckets)))
    forms.hint("rebalance", F.col("bucket")).sortWithinPartitions("form").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/vocabulary")
    totals(docs, fields, key).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/totals")


def _read_parts(spark: SparkSession, path: str, by: str, schema: str) -> DataFrame:
    """A table written in parts; one of no rows has none."""
    return spark.read.parquet(path) if exists(spark, f"{path}/{by}=*") else spark.createDataFrame([], schema)


def totals(docs: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    return field_tokens(docs, fields, key).groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("tokens")).alias("mean"))


@dataclass
class Index:
    """Postings, totals of each field (docs, mean length) and, if written, the vocabulary (field, token, df, form) and number of buckets."""

    postings: DataFrame
    totals: DataFrame
    words: DataFrame | None = None
    buckets: int | None = None

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        totals = spark.read.parquet(f"{path}/totals")
        first = totals.select("buckets").first()
        words = _read_parts(spark, f"{path}/vocabulary", "bucket", "field string, token string, df long, form string, bucket int")
        return cls(_read_parts(spark, f"{path}/postings", "bucket", POSTINGS), totals.drop("buckets"), words, first["buckets"] if first else 1)

    def of_terms(self, terms: list[str]) -> DataFrame:
        rows = self.postings
        if self.buckets:
            spark = rows.sparkSession
            found = spark.createDataFrame([(t,) for t in terms], "token string").select(F.pmod(F.hash("token"), F.lit(self.buckets)).alias("b")).distinct().collect()
            rows = rows.where(F.col("bucket").isin([r["b"] for r in found]))
        return rows.where(F.col("token").isin(terms))

    def vocabulary(self, terms: list[str] | None = None) -> DataFrame:
        """(field, token, df[, form]); with ``terms`` at least the tokens within their typos. A written one has a row for each form, and only those of ``terms`` are read."""
        if self.words is None:
            rows = self.postings.withColumn("size", F.length("token"))
            return document_frequency(_within_reach(rows, terms) if terms else rows)
        if not terms:
            return self.words.select("field", "token", "df").distinct()
        forms = sorted({f for t in terms for f in halves(t, auto_edits(t))})
        found = self.words.sparkSession.createDataFrame([(f,) for f in forms], "form string").select(F.pmod(F.hash("form"), F.lit(self.buckets)).alias("b")).distinct().collect()
        return self.words.where(F.col("bucket").isin([r["b"] for r in found]) & F.col("form").isin(forms))


def _within_reach(words: DataFrame, terms: list[str]) -> DataFrame:
    sizes = {min(n, LONGEST) for t in terms for n in range(len(t) - auto_edits(t), len(t) + auto_edits(t) + 1)}
    return words.where(F.least("size", F.lit(LONGEST)).isin(sorted(sizes)))


def index_of(docs: DataFrame, fields: list[str], terms: list[str] | None = None, key: str = "doc_id") -> Index:
    """An index made on the fly; with ``terms``, of these tokens only.

    The texts are read and split once, into a table that postings, totals and vocabulary come from; with ``terms`` it has a few
    bytes for each document and field. For repeated queries use write_index().
    """
    t = field_tokens(docs, fields, key).withColumn("length", F.size("tokens").cast("long"))
    if terms is not None:
        t = t.withColumn("tokens", F.filter("tokens", lambda x: x.isin(terms)))
    t = cut(t.select("doc_id", "field", "length", counted(F.col("tokens")).alias("words")))
    p = t.select("doc_id", "field", "length", F.explode("words").alias("x")).select("doc_id", "field", "x.token", "x.tf", "length")
    return Index(p, t.groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean")))


def fuzzy_terms(vocabulary: DataFrame, terms: list[str], most: int = 50) -> DataFrame:
    """(term, field, token, edits) of the vocabulary within the edits that a term's length allows, ``most`` for each term and field.

    A term and a token meet by a form of a half that both have, in an equi-join; how many edits they are apart is looked at only then. Terms are constants of the
    plan: their swaps and forms are made once. A vocabulary with a column form has a row for each; without it a token may come many times, its forms are made once.
    Nearer tokens come first, then by name.
    """
    spark = vocabulary.sparkSession
    rows = [(t, auto_edits(t), swaps(t), f) for t in dict.fromkeys(terms) for f in halves(t, auto_edits(t))]
    q = F.broadcast(spark.createDataFrame(rows, "term string, allowed int, swaps array<string>, form string"))  # a query's terms, about 100 forms each at most
    forms = vocabulary
    if "form" not in vocabulary.columns:
        sizes = [n for t in terms for n in (len(t) - auto_edits(t), len(t) + auto_edits(t))]
        words = vocabulary.select("field", "token").where(F.length("token").between(min(sizes, default=0), max(sizes, default=-1))).distinct()
        forms = words.select("field", "token", F.explode(halved(F.col("token"))).alias("form"))
    reach = F.abs(F.length("token") - F.length("term")) <= F.col("allowed")
    near = forms.join(q, "form").where(reach).groupBy("term", "field", "token").agg(F.first("allowed").alias("allowed"), F.first("swaps").alias("swaps"))
    edits = F.when(F.col("allowed") == 0, F.when(F.col("token") == F.col("term"), 0).otherwise(3)).otherwise(near_edits(F.col("token"), F.col("term"), F.col("swaps")))
    near = near.withColumn("edits", edits).where("edits <= allowed")
    rank = F.row_number().over(Window.partitionBy("term", "field").orderBy("edits", "token"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select("term", "field", "token", "edits")


def field_scores(index: Index, terms: DataFrame | list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, field, score): BM25 summed over the tokens that stand for the query's terms, each by its own document frequency.

    ``terms``: tokens, or a bounded table (field, token), of which a written index reads the buckets.
    """
    if isinstance(terms, list):
        p = index.of_terms(terms)
    else:
        pairs = terms.select("field", "token").distinct()
        p = index.postings
        if index.buckets:
            pairs = cut(pairs)
            p = index.of_terms([r["token"] for r in pairs.select("token").distinct().collect()])  # a query's terms with their typos
        p = p.join(F.broadcast(pairs), ["field", "token"])
    df = p.groupBy("field", "token").agg(F.count(F.lit(1)).alias("df"))  # at most a few for each term
    p = p.join(F.broadcast(df), ["field", "token"]).join(F.broadcast(index.totals), "field")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return p.groupBy("doc_id", "field").agg(F.sum(part).alias("score"))


def best_fields(scores: DataFrame, boosts: dict[str, float]) -> DataFrame:
    """(doc_id, _score): a document's best boosted field."""
    boost = F.element_at(F.create_map(*[F.lit(x) for kv in boosts.items() for x in (kv[0], float(kv[1]))]), F.col("field"))
    return scores.groupBy("doc_id").agg(F.max(boost * F.col("score")).alias("_score"))


def top(scores: DataFrame, size: int) -> DataFrame:
    """By score, then id; one bounded heap for each task."""
    return scores.orderBy(F.desc("_score"), "doc_id").limit(size)


def match_all(docs: DataFrame, size: int = 50, key: str = "doc_id") -> DataFrame:
    return top(docs.withColumn("doc_id", F.col(key)).withColumn("_score", F.lit(1.0)), size)


def search(docs: DataFrame, query: str, boosts: dict[str, float], size: int = 50, fuzzy: bool = True, index: Index | None = None, key: str = "doc_id", marked: bool = True) -> DataFrame:
    """Hits with _score, the documents' columns and, if ``marked``, highlights of every field, of tokens reached by typos, too."""
    require_query(query)
    terms = query_tokens(query)
    if index is None:
        index = index_of(docs, list(boosts), None if fuzzy else terms, key)
    found: DataFrame | list[str] = cut(fuzzy_terms(index.vocabulary(terms), terms)) if fuzzy else terms
    return shown(docs, top(best_fields(field_scores(index, found), boosts), size), found, list(boosts) if marked else [], key)


def shown(docs: DataFrame, hits: DataFrame, found: DataFrame | list[str], fields: list[str], key: str = "doc_id") -> DataFrame:
    """Documents of bounded ``hits`` (doc_id, _score) in their order, with highlights of ``fields``. Their ids go to the scan of ``docs``, so what is computed of a document is computed for hits alone."""
    rows = hits.collect()  # a page of hits
    scored = docs.sparkSession.createDataFrame([(r["doc_id"], r["_score"]) for r in rows], T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("_score", T.DoubleType())]))
    out = docs.where(F.col(key).isin([r["doc_id"] for r in rows])).join(F.broadcast(scored), key)
    if fields:
        words = found if isinstance(found, list) else sorted(r["token"] for r in found.select("token").distinct().collect())  # 50 for each term and field at most
        for f in fields:
            out = out.withColumn(f"{f}_highlight", fragments(F.col(f), words) if f == "content" else highlight(F.col(f), words))
    return out.orderBy(F.desc("_score"), key)


def uri_search(docs: DataFrame, q: str, fields: list[str], size: int = 10, key: str = "doc_id") -> DataFrame:
    """All fields alike, no typos."""
    return search(docs, q, dict.fromkeys(fields, 1.0), size, fuzzy=False, key=key, marked=False)


def total_hits(index: Index, terms: DataFrame | list[str]) -> DataFrame:
    return field_scores(index, terms).agg(F.count_distinct("doc_id").alias("total"))


def response(docs: DataFrame, query: str | None, boosts: dict[str, float], size: int = 50, key: str = "doc_id") -> dict:
    """What a search service answers: took (ms), total and at most ``size`` hits; a query of None matches everything."""
    began = time.monotonic()
    if query is None:
        hits, total = match_all(docs, size, key).collect(), docs.count()
    else:
        require_query(query)
        index, terms = index_of(docs, list(boosts), key=key), query_tokens(query)
        found = cut(fuzzy_terms(index.vocabulary(terms), terms))
        scores = cut(best_fields(field_scores(index, found), boosts))
        hits, total = shown(docs, top(scores, size), found, list(boosts), key).collect(), scores.count()
    return {"took": int(1000 * (time.monotonic() - began)), "total": total, "hits": [h.asDict(True) for h in hits]}


def index_stats(docs: DataFrame, name: str, texts: list[str], deleted: Column | None = None) -> DataFrame:
    """One row: health (green if anything can be read, else yellow), index, docs_count and docs_deleted (rows marked ``deleted``), store_size."""
    size = sum((F.coalesce(F.length(t), F.lit(0)) for t in texts), F.lit(0))
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    n = F.count(F.when(~gone, 1))
    return docs.groupBy().agg(F.when(n > 0, "green").otherwise("yellow").alias("health"), F.lit(name).alias("index"), n.alias("docs_count"), F.count(F.when(gone, 1)).alias("docs_deleted"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("store_size"))


def toggled(state: tuple[str, str], key: str) -> tuple[str, str]:
    """The sort that a click on a column gives: the same key turns its direction, another begins ascending."""
    return (key, "desc" if state[1] == "asc" else "asc") if key == state[0] else (key, "asc")


def table_view(rows: DataFrame, query: str = "", sort: tuple[str, str] = ("path", "asc"), rank: str | None = None, collation: str | None = "UNICODE") -> DataFrame:
    """Page rows filtered by a quick query and sorted; ``rank`` is the hits' order, kept among equals in either direction."""
    rows = rows.where(quick(query, F.col("path"), F.col("title"), F.col("type")))
    c = F.col(sort[0])
    if dict(rows.dtypes)[sort[0]] == "string":
        c = F.lower(c)
        c = F.collate(c, collation) if collation else c
    return rows.orderBy(c.desc() if sort[1] == "desc" else c.asc(), *([rank] if rank else []))
