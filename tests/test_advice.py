
import pytest
from pyspark.sql import functions as F

from tailfield.operators import models as mo


def test_only_named_reasons_skip_a_buffer(spark, monkeypatch):
    """A split without both classes is skipped; a fit that does not converge fails the query."""
    df = spark.range(3000).select(
        F.col("id").cast("string").alias("pixel_id"), (F.col("id") % 40).cast("string").alias("block_id"), (F.xxhash64("id") % 1000 / 1000.0).alias("a"),
        (F.xxhash64("id") % 3 == 0).cast("int").alias("label"), F.lit(9.0).alias("boundary_distance_km"))
    one = mo.buffer_sweep(df.withColumn("label", F.lit(1)), [0.0], ["a"], "linear", "a").collect()
    assert [r.status for r in one] == ["skipped"]
    monkeypatch.setattr(mo, "MAX_ITERATIONS", 1)
    with pytest.raises(mo.NotConverged):
        mo.buffer_sweep(df, [0.0], ["a"], "linear", "a").collect()
