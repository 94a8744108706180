"""Inputs that must be refused or repaired instead of giving wrong rows."""

import pytest
from pyspark.sql import functions as F

from tailfield.operators import models as mo
from tailfield.operators import windows as wi
from tailfield.operators.ordering import exact_quantiles
from tailfield.sources import tables


def test_files_with_other_column_order_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("easting,d_u\n100.0,1.0\n")
    (tmp_path / "b.csv").write_text("d_u,easting\n2.0,200.0\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_cells_csv(spark, str(tmp_path)).collect()


def test_uncommitted_sample_is_built_again(spark, tmp_path):
    path = str(tmp_path / "sample")
    spark.range(10).repartition(2).write.parquet(path)
    (tmp_path / "sample" / "_SUCCESS").unlink()
    next((tmp_path / "sample").glob("part-*.parquet")).unlink()
    assert tables.cached_sample(spark, path, ["id"], lambda: spark.range(10)).count() == 10
    assert tables.cached_sample(spark, path, ["id"], lambda: spark.range(3)).count() == 10


def test_feature_without_values_is_left_out(spark):
    df = spark.range(400).select(
        (F.col("id") % 7).cast("double").alias("a"), F.lit(None).cast("double").alias("b"),
        (F.xxhash64("id") % 3 == 0).cast("int").alias("label"))
    model = mo.fit_model(df, ["a", "b"], "linear")
    assert model.features == ["a"]
    with pytest.raises(mo.NoFeatures):
        mo.fit_model(df, ["b"], "linear")


def test_too_few_windows_is_an_error(spark):
    df = spark.createDataFrame([(-1904952.0, 4157520.0, 0.5, 1, 1.0)] * 200, "easting double, northing double, s double, hot int, t double")
    ask = dict(half=1904.0, spacing=5000.0, min_points=100, min_hotspots=10, score="s", hot="hot", second="t")
    assert wi.zoom_windows(df, n=1, **ask).count() == 1
    with pytest.raises(wi.TooFewWindows):
        wi.zoom_windows(df, n=3, **ask)


@pytest.mark.parametrize("n", [1, 2, 5, 30])
def test_quantiles_of_small_groups(spark, n):
    import numpy as np

    values = [float((k * 37) % 11) / 3 for k in range(n)]
    qs = [0.0, 0.1, 0.3, 0.5, 0.95, 1.0]
    got = exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", qs).first()
    assert got.quantiles == pytest.approx(list(np.quantile(values, qs)))


def test_one_split_serves_every_threshold(spark):
    df = spark.range(4000).select(
        F.col("id").cast("string").alias("pixel_id"), (F.col("id") % 40).cast("string").alias("block_id"),
        (F.xxhash64("id") % 1000 / 1000.0).cast("double").alias("a"), (F.abs(F.xxhash64("id")) % 977).cast("double").alias("t"))
    got = mo.threshold_sweep(df, "t", [0.5, 0.8], ["a"], "linear").collect()
    assert got[0].n == got[1].n
