"""Intermediate tables of the operators, written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tailfield.session import scratch_dir


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again.

    Like a checkpoint it cuts the lineage and survives lost executors; unlike one it has the size of its files as
    statistics, where a checkpoint carries the product of all join sizes so far into every later round's plan.
    """
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
