"""Taggers: operations on the fields of documents, as columns or as a map of arrays."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.filters import matches


def add_constant(docs: DataFrame, **values: str) -> DataFrame:
    return docs.withColumns({k: F.lit(v) for k, v in values.items()})


def keep_only(docs: DataFrame, fields: str) -> DataFrame:
    """``fields``: separated by commas; those that are not there are passed over."""
    return docs.select(*[c for c in (f.strip() for f in fields.split(",")) if c in docs.columns])


def delete_matching(docs: DataFrame, pattern: str) -> DataFrame:
    return docs.drop(*[c for c in docs.columns if re.fullmatch(pattern, c)])


def keep_only_in(docs: DataFrame, column: str, pattern: str, method: str = "csv") -> DataFrame:
    return docs.withColumn(column, F.map_filter(column, lambda k, _: matches(k, pattern, method)))


def delete_matching_in(docs: DataFrame, column: str, pattern: str, method: str = "regex") -> DataFrame:
    return docs.withColumn(column, F.map_filter(column, lambda k, _: ~matches(k, pattern, method)))
