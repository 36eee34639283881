"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) and not math.isnan(v) else v for v in r]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name, tmp_path):
    entry.queries()[name](spark, str(SF)).write.parquet(str(tmp_path / "o"))  # compared as written: types as the files have them
    a = duck.sql(entry.oracle_sql()[name])
    b = duck.sql(f"SELECT * FROM '{tmp_path}/o/*.parquet'")
    columns = sorted(a.columns)
    assert sorted(b.columns) == columns
    pick = ", ".join(f'"{c}"' for c in columns)
    left = duck.sql(f"SELECT {pick} FROM ({entry.oracle_sql()[name]})").fetchall()
    right = duck.sql(f"SELECT {pick} FROM '{tmp_path}/o/*.parquet'").fetchall()
    assert canonical(left) == canonical(right)


def test_every_query_has_a_name_and_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not SF.exists(), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
