"""Words with their places, and fragments chosen by them.

A table of places has a row for each occurrence: (doc_id, field, token, at, start, stop): the word's number and its offsets in characters, stop exclusive. Written, it is parted by a bucket of the
token and sorted, so a query reads the occurrences of its own terms and no text. Fragments are chosen from these offsets alone; texts are read for the hits that show them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.values import let, running_sums
from corpusloom.plans.lineage import cut, exists

PLACES = "doc_id long, field string, token string, at int, start int, stop int, bucket int"
WORD = r"[\p{L}\p{N}]"


def words_at(text: Column) -> Column:
    """Array of struct(token, at, start, stop) of a text's words; offsets are those of the text as it is. Null and texts without words give an empty array."""
    t = F.coalesce(text, F.lit(""))
    pieces = F.regexp_extract_all(t, F.lit(rf"{WORD}+[^\p{{L}}\p{{N}}]*"), F.lit(0))  # a word and what follows it
    first = F.length(F.regexp_extract(t, r"^[^\p{L}\p{N}]*", 0))
    one = lambda word, i, start: F.struct(F.lower(word).alias("token"), i.alias("at"), start.alias("start"), (start + F.length(word)).cast("int").alias("stop"))
    word = lambda p: F.regexp_extract(p, rf"^{WORD}+", 0)
    found = let(first, lambda f: let(pieces, lambda ps: let(running_sums(F.transform(ps, F.length)), lambda s: F.transform(ps, lambda p, i: one(word(p), i, (f + F.get(s, i)).cast("int"))))))
    return F.coalesce(found, F.array().cast("array<struct<token:string,at:int,start:int,stop:int>>"))


def places(docs: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """(doc_id, field, token, at, start, stop), a row for each occurrence; texts are read once and nothing is shuffled."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), words_at(F.col(f)).alias("words")) for f in fields])
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.explode(each).alias("x")).select("doc_id", "x.field", F.explode("x.words").alias("w"))
    return rows.select("doc_id", "field", "w.*")


def write_places(docs: DataFrame, fields: list[str], path: str, key: str = "doc_id", buckets: int = 64, tasks_a_bucket: int = 8) -> None:
    """Places by bucket of the token; buckets should grow with the corpus. A frequent word's are written by ``tasks_a_bucket`` tasks at least, and by as many as their bytes need."""
    rows = places(docs, fields, key).withColumn("bucket", F.pmod(F.hash("token"), F.lit(buckets)))
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(tasks_a_bucket))).hint("rebalance", F.col("bucket"), F.col("deal")).drop("deal").sortWithinPartitions("bucket", "field", "token", "doc_id", "at")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/places")
    docs.sparkSession.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}/shape")


def read_places(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """Occurrences of ``terms`` (lower-cased tokens): of their buckets and, within these, of their row groups."""
    buckets = spark.read.parquet(f"{path}/shape").first()["buckets"]
    if not terms or not exists(spark, f"{path}/places/bucket=*"):
        return spark.createDataFrame([], PLACES).drop("bucket")
    of = spark.createDataFrame([(t,) for t in terms], "token string").select(F.pmod(F.hash("token"), F.lit(buckets)).alias("b")).distinct().collect()
    return spark.read.schema(PLACES).parquet(f"{path}/places").where(F.col("bucket").isin(sorted(r["b"] for r in of)) & F.col("token").isin(terms)).drop("bucket")


def windows(found: DataFrame, size: int = 100, number: int = 5) -> DataFrame:
    """(doc_id, field, words, windows): the occurrences in order and up to ``number`` windows (first, last) of ``size`` characters, best first, that don't overlap.

    Each occurrence opens a window, which holds those after it that end within ``size`` characters of its start, and leaves as much room before them as after. More distinct tokens win, then more
    occurrences, then the earlier window. A word longer than ``size`` has a window of its length. One row holds the occurrences of one document and field, which its text bounds; an occurrence is
    compared with those of its own window only.
    """
    of = F.array_sort(F.collect_set(F.struct("start", "stop", "token")))

    def window(words: Column, w: Column, i: Column) -> Column:
        own = F.filter(F.slice(words, i + 1, size // 2 + 1), lambda x: x["stop"] <= F.greatest(w["start"] + size, w["stop"]))
        distinct, last = F.size(F.array_distinct(F.transform(own, lambda x: x["token"]))), F.array_max(F.transform(own, lambda x: x["stop"]))
        first = lambda end: F.greatest(F.lit(0), w["start"] - F.floor(F.greatest(F.lit(0), size - (end - w["start"])) / 2).cast("int"))
        return let(F.struct(distinct.alias("d"), F.size(own).alias("n"), last.alias("e")), lambda s: F.struct((-s["d"]).alias("d"), (-s["n"]).alias("n"), first(s["e"]).alias("first"), F.greatest(first(s["e"]) + size, s["e"]).alias("last")))

    rows = found.groupBy("doc_id", "field").agg(of.alias("words"))
    rows = rows.withColumn("all", F.transform("words", lambda w, i: window(F.col("words"), w, i)))
    picked = F.array().cast("array<struct<first:int,last:int>>")

    def pick(state: Column, _: Column) -> Column:
        best = F.array_min(state["all"])
        rest = lambda b: F.filter(state["all"], lambda c: (c["last"] <= b["first"]) | (c["first"] >= b["last"]))
        more = let(best, lambda b: F.struct(rest(b).alias("all"), F.concat(state["picked"], F.array(F.struct(b["first"].alias("first"), b["last"].alias("last")))).alias("picked")))
        return F.when(F.size(state["all"]) > 0, more).otherwise(state)

    state = F.struct(F.col("all"), picked.alias("picked"))
    return rows.select("doc_id", "field", "words", F.aggregate(F.sequence(F.lit(1), F.lit(number)), state, pick)["picked"].alias("windows"))


def marked(text: Column, words: Column, first: Column, last: Column, before: str = "<em>", after: str = "</em>") -> Column:
    """Characters ``first`` to ``last`` (exclusive) of a text without the words that the ends cut, trimmed, with the occurrences ``words`` (start, stop; in order) in it marked. Nothing is looked for in the text."""
    cut_word = rf"^{WORD}(?={WORD}){WORD}*"  # the character before belongs to the word that the window begins in
    lo = first + F.when(first > 0, F.greatest(F.lit(0), F.length(F.regexp_extract(F.substring(text, first, last - first + 1), cut_word, 0)) - 1)).otherwise(0)
    tail = F.regexp_extract(F.substring(text, first + 1, last - first + 1), rf"{WORD}+\z", 0)  # with the character after
    hi = F.least(F.length(text), F.when((F.length(tail) > 1) & (F.length(text) > last), last + 1 - F.length(tail)).otherwise(last))

    def run(lo: Column, hi: Column) -> Column:
        own = F.filter(words, lambda w: (w["start"] >= lo) & (w["stop"] <= hi))
        step = lambda s, w: F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, w["start"] - s["at"]), F.lit(before), F.substring(text, w["start"] + 1, w["stop"] - w["start"]), F.lit(after)).alias("out"), w["stop"].alias("at"))
        end = F.aggregate(own, F.struct(F.lit("").alias("out"), lo.cast("int").alias("at")), step)
        return let(end, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, hi - s["at"])))

    return F.btrim(let(F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")), lambda e: run(e["lo"], e["hi"])), F.lit(" \t\r\n"))


def field_fragments(docs: DataFrame, found: DataFrame, fields: list[str], size: int = 100, number: int = 5, key: str = "doc_id") -> DataFrame:
    """(doc_id, field, fragments) of the documents with an occurrence among ``found`` (places of a query's terms): up to ``number`` pieces of about ``size`` characters, best first.

    Pass the hits as ``docs`` where only these are shown; documents without an occurrence have no row. Keys are unique.
    """
    picked = windows(found.where(F.col("field").isin(fields)), size, number)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.explode(each).alias("x")).select("doc_id", "x.field", "x.text")
    out = F.transform("windows", lambda w: marked(F.col("text"), F.col("words"), w["first"], w["last"]))
    return picked.join(texts, ["doc_id", "field"]).select("doc_id", "field", out.alias("fragments"))


def hit_fragments(docs: DataFrame, hits: DataFrame, path: str, terms: list[str], fields: list[str], size: int = 100, number: int = 5, key: str = "doc_id") -> DataFrame:
    """field_fragments() of bounded ``hits`` (doc_id, ...) from written places: their ids go to both scans, so other documents' texts are not read."""
    ids = [r["doc_id"] for r in cut(hits.select("doc_id")).collect()]  # a page of hits
    found = read_places(docs.sparkSession, path, terms).where(F.col("doc_id").isin(ids))
    return field_fragments(docs.where(F.col(key).isin(ids)), found, fields, size, number, key)
