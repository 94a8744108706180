"""The crop after a window search, by hand."""

import pytest

from tailfield.operators import windows as wi


def crop(spark, focus, points, nudge, lift=0.0, extent=(0.0, 100.0, 0.0, 200.0)):
    rows = spark.createDataFrame([(*map(float, focus), 1.0)], "xmin double, xmax double, ymin double, ymax double, score double")
    pts = spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double")
    out = wi.crop_after_search(rows, pts, extent, nudge, lift).collect()
    assert len(out) == 1
    return tuple(out[0])[:4]


def test_moves_towards_the_centre_of_the_points(spark):
    # the bounds' centre is (60, 100), whatever the number of points at a place; the one beyond the extent does not count
    assert crop(spark, (10, 30, 40, 80), [(50, 80), (50, 80), (70, 120), (1000, 1000)], 0.25) == pytest.approx((20, 40, 50, 90))
    assert crop(spark, (10, 30, 40, 80), [(50, 80), (70, 120)], 0.25, 0.5) == pytest.approx((20, 40, 70, 110))


def test_stays_within_the_extent(spark):
    assert crop(spark, (80, 100, 160, 200), [(100, 200)], 1.0, 1.0) == pytest.approx((80, 100, 160, 200))
    assert crop(spark, (0, 20, 0, 40), [(0, 0)], 1.0) == pytest.approx((0, 20, 0, 40))
    assert crop(spark, (-50, 150, 10, 20), [(50, 15)], 0.1) == pytest.approx((0, 100, 10, 20))  # wider than the extent


def test_without_points_or_window(spark):
    assert crop(spark, (10, 30, 40, 80), [], 0.25, 0.5) == pytest.approx((10, 30, 40, 80))
    none = spark.createDataFrame([], "xmin double, xmax double, ymin double, ymax double, score double")
    assert wi.crop_after_search(none, spark.createDataFrame([(1.0, 1.0)], "x double, y double"), (0, 1, 0, 1), 0.1).count() == 0
