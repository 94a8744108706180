"""Reading the wide per-cell table and reading or writing derived tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailfield.constants import PIXEL_SCHEMA
from tailfield.functions.labels import domain_code
from tailfield.functions.numeric import coerce, finite, unit_fallback


class MissingColumns(ValueError):
    """The table lacks columns an analysis needs."""


def resolve_columns(
    available: list[str], required: list[str], optional: list[str] = (), any_of: list[str] = ()
) -> list[str]:
    """Columns to read, or an error before any job runs."""
    missing = [c for c in required if c not in available]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    alternatives = [c for c in any_of if c in available]
    if any_of and not alternatives:
        raise MissingColumns(f"none of: {', '.join(any_of)}")
    extra = [c for c in (*alternatives, *optional) if c in available and c not in required]
    return [*required, *dict.fromkeys(extra)]


def csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def read_cells_csv(
    spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType = PIXEL_SCHEMA
) -> DataFrame:
    """Scan the per-cell CSV with the types of ``schema``; unknown columns stay text.

    Unparsable numbers, NaN and infinities become NULL; column pruning limits parsing
    to the selected columns. Every file's header must name the columns in the same order;
    a file that differs is an error and never read by position.
    """
    types = {f.name: f.dataType for f in schema.fields}
    header = csv_header(spark, path)
    typed = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    df = spark.read.schema(typed).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").csv(path)
    chosen = [f for f in typed.fields if columns is None or f.name in columns]
    return df.select(*[
        finite(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in chosen
    ])


def normalise_cells(df: DataFrame) -> DataFrame:
    """Engine form of the per-cell table: coerced numbers, domain, per-km gradient."""
    numeric = {f.name for f in PIXEL_SCHEMA.fields if isinstance(f.dataType, T.DoubleType)}
    out = df.select(*[coerce(F.col(f"`{c}`")).alias(c) if c in numeric else F.col(f"`{c}`") for c in df.columns])
    per_km = F.col("grad_mag_km") if "grad_mag_km" in out.columns else F.lit(None).cast("double")
    per_m = F.col("grad_mag") if "grad_mag" in out.columns else F.lit(None).cast("double")
    return out.withColumn("grad_mag_km", unit_fallback(per_km, per_m)).withColumn(
        "domain", domain_code(F.col("Perma_Distr_map"))
    )


def write_cells(df: DataFrame, path: str, tile: int = 256, row: str = "row", col: str = "col") -> None:
    """Parquet partitioned by tile row, sorted by tile column, so that window reads prune files and row groups."""
    (
        df.withColumn("tile_row", F.floor(F.col(row) / tile).cast("int"))
        .withColumn("tile_col", F.floor(F.col(col) / tile).cast("int"))
        .repartitionByRange("tile_row", "tile_col", row)
        .sortWithinPartitions("tile_row", "tile_col", row, col)
        .write.mode("overwrite").partitionBy("tile_row").parquet(path)
    )


def read_cells(
    spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None,
    tile: int = 256, row: str = "row", col: str = "col",
) -> DataFrame:
    """Cells of an inclusive row and column range; the tile filters reach the scan."""
    df = spark.read.parquet(path)
    for span, name, part in ((rows, row, "tile_row"), (cols, col, "tile_col")):
        if span is not None:
            df = df.where(F.col(part).between(span[0] // tile, span[1] // tile) & F.col(name).between(*span))
    return df.drop("tile_row", "tile_col")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_if_complete(spark: SparkSession, path: str, required: list[str]) -> DataFrame | None:
    """A stored table when it is readable and has the required columns, else None."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    return df if set(required) <= set(df.columns) else None


def cached_sample(spark: SparkSession, path: str, required: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse a stored sample that was committed and has the required columns; otherwise build and store it."""
    found = read_if_complete(spark, path, required) if path_exists(spark, f"{path.rstrip('/')}/_SUCCESS") else None
    if found is not None:
        return found
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def first_readable(spark: SparkSession, paths: list[str], required: list[str] = ()) -> DataFrame:
    for path in paths:
        found = read_if_complete(spark, path, list(required))
        if found is not None:
            return found
    raise FileNotFoundError(f"no readable table with the required columns in {paths}")


def write_result(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_features(
    df: DataFrame, kind: str | None = None, kinds: list[str] | None = None, crs: str | None = None,
    expected_crs: str | None = None,
) -> DataFrame:
    """Edges or points of a layer with the wanted types, after a projection check."""
    if crs != expected_crs:
        raise ValueError(f"layer projection {crs!r} differs from {expected_crs!r}")
    if kind is None or kinds is None:
        return df
    return df.where(F.upper(F.trim(F.col(kind))).isin(*[k.strip().upper() for k in kinds]))


def raster_metadata(cells: DataFrame, value: str) -> DataFrame:
    """One row describing a layer: predictions, row and column range, value range."""
    return cells.where(F.col(value).isNotNull()).agg(
        F.count("*").alias("n_predictions"),
        F.min("row").alias("row_min"), F.max("row").alias("row_max"),
        F.min("col").alias("col_min"), F.max("col").alias("col_max"),
        F.min(value).alias("value_min"), F.max(value).alias("value_max"),
    )


def with_fallback(wanted: DataFrame, fits: DataFrame | None, keys: list[str], value: str, status: str) -> DataFrame:
    """Fitted values where a fit exists, the constants of ``wanted`` elsewhere, marked as fallback.

    ``wanted`` is a parameter table, hence broadcastable.
    """
    if fits is None:
        return wanted.withColumn(status, F.lit("constant_fallback"))
    fitted = fits.select(*keys, F.col(value).alias("_fit"), F.col(status).alias("_status"))
    return (
        wanted.join(fitted, keys, "left")
        .withColumn(value, F.coalesce("_fit", value))
        .withColumn(status, F.when(F.col("_fit").isNull(), "constant_fallback").otherwise(F.col("_status")))
        .drop("_fit", "_status")
    )
