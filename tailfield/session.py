"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tailfield", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume; ``conf`` uses ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint so that every reader sees the same rows.

    The folder is the one named by ``spark.checkpoint.dir``. Only a local master
    without that setting gets a temporary folder: executors of a cluster cannot
    share one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str = "pixel_id") -> DataFrame:
    """Rows dealt evenly before steps that cost much a row: a small table may lie in one file, and then in one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def small_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A parameter table as an inline relation; ``columns`` is a DDL string."""
    names = [c.strip().split()[0] for c in columns.split(",")]
    types = [c.strip().split()[1] for c in columns.split(",")]

    def literal(value, dtype):
        if value is None:
            return f"CAST(NULL AS {dtype})"
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(value, float):
            return f"CAST('{value!r}' AS {dtype})"
        return f"CAST({value} AS {dtype})"

    body = ", ".join(
        "(" + ", ".join(literal(v, t) for v, t in zip(row, types, strict=True)) + ")" for row in rows
    )
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(f'`{n}`' for n in names)})")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder for derived files: under ``spark.checkpoint.dir``, or /tmp for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"
