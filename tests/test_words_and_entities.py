"""Whole words, entities and the queries that show them against their SQL, on odd texts."""

from __future__ import annotations

import html as _html

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.functions import text

ODD = ["licensed under underüchte", "Licensed unteründer über_under under_x, the theß", "LICENSED äunder éthe the", "licensedü under", "licensed", "licensed undeŕ the²", "", None]


def against_sql(spark, tmp_path, name, table, df):
    duckdb = pytest.importorskip("duckdb")
    df.coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    entry.queries()[name](spark, str(tmp_path)).write.parquet(str(tmp_path / "o"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = c.execute(f"SELECT * FROM '{tmp_path}/o/*.parquet' ORDER BY ALL").fetchall()
    columns = ", ".join(d[0] for d in c.execute(f"SELECT * FROM '{tmp_path}/o/*.parquet' LIMIT 0").description)
    assert got == c.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]}) ORDER BY ALL").fetchall()
    return got


@pytest.mark.parametrize("name", ["content_fragments", "highlighted"])
def test_words_end_where_tokens_end(spark, tmp_path, name):
    got = dict(against_sql(spark, tmp_path, name, "documents", spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")))
    assert got[0] == "<em>licensed</em> <em>under</em> underüchte"
    assert got[4] == "<em>licensed</em>"


def test_marked_words_are_those_that_a_search_finds(spark):
    df = spark.createDataFrame([(t,) for t in ODD if t], "t string")
    rows = df.select(F.size(F.filter(text.tokens(F.col("t")), lambda w: w.isin("licensed", "under", "the"))).alias("n"), text.highlight(F.col("t"), ["licensed", "under", "the"]).alias("h")).collect()
    assert all(r["h"].count("<em>") == r["n"] for r in rows)


def test_every_kind_of_reference(spark, tmp_path):
    titles = ["a&amp;&amp;&amp", "b&quot;c&quo", "&notit; &notin;", "&#128;&#x80;&#0;&#11;&#x110000;&#55296;", "&#99999999999999999999;", "&#xg;&x;&", "&nbsp;&NotEqualTilde;", "", "'&apos;"]
    df = spark.createDataFrame([(i, "http://a/", f"<title>{t}</title>") for i, t in enumerate(titles)] + [(99, "http://a/", None)], "page_id long, url string, html string")
    got = dict(against_sql(spark, tmp_path, "decoded_entities", "pages", df))
    assert got == {i: _html.unescape(f"{t} &lt;&amp;&#233;") for i, t in enumerate(titles)} | {99: None}
