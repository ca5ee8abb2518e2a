"""Columns that are computed once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns (no Python functions) that later steps name many times. Catalyst copies a column's expression to
    every place that names it, filters above all; what a generator gives is a value, so each is computed once a row."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))
