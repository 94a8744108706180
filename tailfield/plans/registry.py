"""The table of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` is the DuckDB form, with view names resolved later."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column; ``special`` overrides the digits of single columns."""

    def expr(field) -> Column:
        c = F.col(f"`{field.name}`")
        if field.dataType.typeName() not in ("double", "float"):
            return c
        return (F.round(c, special.get(field.name, digits)) + F.lit(0.0)).alias(field.name)

    return df.select(*[expr(f) for f in df.schema.fields])
