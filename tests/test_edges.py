"""Hand-computed edge cases: bin rules, ties, missing values, borders."""

import math

import pytest
from pyspark.sql import functions as F

from tailfield.functions import geo, labels, numeric, text
from tailfield.operators import evaluate as ev
from tailfield.operators import fits
from tailfield.operators import grid as g
from tailfield.operators import profiles as pr
from tailfield.operators import spatial as sp
from tailfield.operators import stats as st
from tailfield.operators.relational import assign_families
from tailfield.session import small_table
from tailfield.sources import tables as src


def column(df, name):
    return [r[name] for r in df.collect()]


def frame(spark, ddl, rows):
    return spark.createDataFrame(rows, ddl)


def test_coercion_keeps_only_finite_numbers(spark):
    df = frame(spark, "t string", [("1.5",), ("abc",), ("",), ("NaN",), ("Infinity",), ("-Infinity",), (None,)])
    assert column(df.select(numeric.coerce("t").alias("v")), "v") == [1.5] + [None] * 6


def test_extremes_differ_at_the_threshold(spark):
    df = frame(spark, "domain string, d_u double", [("pf", -16.5), ("pf", -16.6), ("npf", None), ("other", -99.0)])
    out = df.select(labels.extreme_label("d_u").alias("s"), labels.extreme_flag("d_u").alias("i")).collect()
    assert [r["s"] for r in out] == [0, 1, None, None]
    assert [r["i"] for r in out] == [True, True, False, False]


def test_zone_edges(spark):
    rows = [("pf", 3.25, 1.0), ("pf", 3.24, 4.25), ("npf", 3.25, None), ("pf", 1.0, None), ("pf", -1.0, 1.0), (None, 1.0, 1.0)]
    df = frame(spark, "domain string, boundary_distance_km double, tlrts_distance_km double", rows)
    assert column(df.select(labels.process_zone("d_u").alias("z")), "z") == [
        "pf_interior_impacted", "pf_transition_background", "npf_interior", "other", "other", "other"]


def test_half_cells_go_to_the_even_index(spark):
    df = frame(spark, "x double, y double", [(1.0, 3.0), (3.0, 5.0), (-1.0, -3.0)])
    row, c = geo.cell_of("x", "y", {"res": 2.0, "gx0": 0, "gy1": 0})
    out = df.select(row.alias("r"), c.alias("c")).collect()
    assert [r["c"] for r in out] == [0, 2, 0]
    assert [r["r"] for r in out] == [-2, -2, 2]


def test_left_closed_profile_excludes_last_edge(spark):
    df = frame(spark, "x double, v double", [(0.0, 1.0), (0.5, 2.0), (0.99, 4.0), (1.0, 9.0)])
    out = pr.fixed_edge_profile(df, "x", "v", [0.0, 0.5, 1.0], min_count=1).orderBy("x").collect()
    assert [(r["x"], r["n"], r["mean"]) for r in out] == [(0.25, 1, 1.0), (0.75, 2, 3.0)]
    assert out[0]["std"] == 0.0


def test_edges_not_representable_in_binary(spark):
    edges = [0.1 * i for i in range(8)]
    df = frame(spark, "x double, v double", [(e, 1.0) for e in edges])
    out = pr.fixed_edge_profile(df, "x", "v", edges, min_count=1).collect()
    assert len(out) == 7 and all(r["n"] == 1 for r in out)


def test_right_closed_profile_includes_lowest(spark):
    df = frame(spark, "x double, v double", [(0.0, 1.0), (2.0, 3.0), (2.1, 5.0), (4.0, 7.0)])
    out = pr.along_profile(df, "x", ["v"], 2.0, 0.1).orderBy("bin_left_km").collect()
    assert [(r["bin_left_km"], r["n"], r["mean"]) for r in out] == [(0.0, 2, 2.0), (2.0, 2, 6.0)]


def test_open_last_bin(spark):
    df = frame(spark, "x double", [(0.0,), (1.0,), (5.0,), (1e9,), (-0.1,), (None,)])
    assert column(df.select(st.edge_bin("x", [0.0, 1.0, 5.0, math.inf]).alias("b")), "b") == [0, 1, 2, 2, None, None]


def test_histogram_closes_last_bin(spark):
    df = frame(spark, "x double", [(0.0,), (1.0,), (2.0,), (2.1,)])
    assert column(df.select(g.histogram_bin("x", 0.0, 2.0, 2).alias("b")), "b") == [0, 1, 1, None]


def test_rate_table_keeps_empty_bins(spark):
    df = frame(spark, "d double, label int", [(0.5, 1), (0.6, 0), (9.0, None)])
    out = st.rate_by_bin(df, "d", "label", [0.0, 1.0, 2.0]).orderBy("bin_index").collect()
    assert [(r["n"], r["positives"], r["rate"]) for r in out] == [(2, 1, 0.5), (0, 0, None)]


def test_single_class_has_no_area(spark):
    df = frame(spark, "label int, score double", [(0, 0.1), (0, 0.2)])
    row = ev.binary_metrics(df).first()
    assert row["roc_auc"] is None and row["average_precision"] is None and row["n"] == 2


def test_tied_scores_share_rank(spark):
    df = frame(spark, "label int, score double", [(0, 0.5), (1, 0.5), (1, 0.9), (0, 0.1)])
    row = ev.binary_metrics(df).first()
    assert row["roc_auc"] == pytest.approx(0.875)
    assert row["average_precision"] == pytest.approx(0.5 * 1.0 + 0.5 * 2 / 3)


def test_focal_corner_replicates_the_edge(spark):
    df = frame(spark, "row long, col long, v double", [(0, 0, 4.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 7.0)])
    out = {(r["row"], r["col"]): r for r in g.focal_stats(df, "v", 3, 2, 2).collect()}
    corner = out[(0, 0)]
    assert corner["n"] == 9
    assert corner["local_mean"] == pytest.approx((4 * 4 + 2 * 1 + 2 * 1 + 7) / 9)


def test_focal_fills_empty_centres_with_three_neighbours(spark):
    df = frame(spark, "row long, col long, v double", [(4, 4, 1.0), (4, 6, 2.0), (6, 5, 3.0)])
    out = {(r["row"], r["col"]): r for r in g.focal_stats(df, "v", 3, 11, 11).collect()}
    assert set(out) == {(5, 5)} and out[(5, 5)]["local_mean"] == pytest.approx(2.0)


def test_polygon_inside_outside_and_hole(spark):
    def ring(f, r, pts):
        return [(f, r, i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(pts, pts[1:] + pts[:1], strict=True))]
    rows = ring(1, 0, [(0, 0), (10, 0), (10, 10), (0, 10)]) + ring(1, 1, [(4, 4), (6, 4), (6, 6), (4, 6)])
    edges = frame(spark, "feature_id int, ring_id int, seq int, x1 double, y1 double, x2 double, y2 double", rows)
    pts = frame(spark, "easting double, northing double", [(2.0, 2.0), (5.0, 5.0), (13.0, 5.0), (None, 1.0)])
    out = {r["easting"]: r["distance_m"] for r in sp.distance_to_features(pts, edges, tile=3.0).collect()}
    assert out[2.0] == 0.0 and out[5.0] == pytest.approx(1.0) and out[13.0] == pytest.approx(3.0) and out[None] is None


def test_equally_near_segments_take_the_first(spark):
    edges = frame(spark, "line_id int, seq int, x1 double, y1 double, x2 double, y2 double",
                  [(0, 0, 0.0, 0.0, 10.0, 0.0), (0, 1, 10.0, 0.0, 10.0, 10.0)])
    pts = frame(spark, "easting double, northing double", [(8.0, 2.0), (12.0, -2.0)])
    out = {r["easting"]: r["along_km"] for r in sp.along_line(pts, edges, tile=4.0).collect()}
    assert out[8.0] == pytest.approx(0.008) and out[12.0] == pytest.approx(0.010)


def test_hinge_needs_six_points(spark):
    def run(n):
        df = frame(spark, "g int, x double, mean double, n long", [(1, float(i), abs(i - 3.0), 1) for i in range(n)])
        return fits.hinge_fit(df, 0.5, 10.0, ["g"]).first()
    assert run(5)["fitted_elbow_km"] is None
    six = run(7)
    assert six["fitted_elbow_km"] == 3.0 and six["slope_before"] == pytest.approx(-1.0) and six["slope_after"] == pytest.approx(1.0)


def test_two_segments_need_three_points(spark):
    two = frame(spark, "x double, y double", [(0.0, 1.0), (1.0, 2.0)])
    assert fits.two_segment_fit(two, "x", "y").first()["n_segments"] == 1
    vee = frame(spark, "x double, y double", [(float(i), abs(i - 4.0)) for i in range(9)])
    assert fits.two_segment_fit(vee, "x", "y").first()["break_x"] == 4.0


def test_line_of_one_point_is_constant(spark):
    row = fits.weighted_line(frame(spark, "x double, y double", [(2.0, 5.0)]), "x", "y").first()
    assert (row["slope"], row["intercept"]) == (0.0, 5.0)


def test_split_outside_range_leaves_one_part(spark):
    df = frame(spark, "x double, y double", [(0.0, 0.0), (1.0, 2.0)])
    assert set(column(pr.split_curve(df, -1.0, ["y"]), "part")) == {"tail"}
    assert set(column(pr.split_curve(df, 5.0, ["y"]), "part")) == {"core"}
    inside = pr.split_curve(df, 0.5, ["y"]).collect()
    assert sorted((r["part"], r["x"], r["y"]) for r in inside) == [
        ("core", 0.0, 0.0), ("core", 0.5, 1.0), ("tail", 0.5, 1.0), ("tail", 1.0, 2.0)]


def test_empty_limits_fall_back(spark):
    df = frame(spark, "v double", [(None,)])
    row = st.robust_limits(df, "v").first()
    assert (row["lo"], row["hi"]) == (0.0, 1.0)
    row = st.symmetric_limits(df, "v").first()
    assert (row["lo"], row["hi"]) == (-1.0, 1.0)


def test_missing_columns_fail_before_a_job():
    with pytest.raises(src.MissingColumns):
        src.resolve_columns(["a"], ["b"])
    with pytest.raises(src.MissingColumns):
        src.resolve_columns(["a"], ["a"], any_of=["x", "y"])
    assert src.resolve_columns(["a", "y", "z"], ["a"], ["z"], ["x", "y"]) == ["a", "y", "z"]


def test_feature_without_family_is_an_error(spark):
    df = frame(spark, "feature string", [("magt",), ("unknown",)])
    with pytest.raises(Exception, match="without a family"):
        assign_families(df, spark).collect()


def test_label_text(spark):
    df = frame(spark, "v double", [(None,), (0.0001,), (0.0625,)])
    assert column(df.select(text.p_value_text("v").alias("t")), "t") == ["NA", "<1e-3", "0.062"]
    names = frame(spark, "n string", [("a_20190304.x",), ("a120190304.x",), ("none",)])
    assert column(names.select(text.date_token("n").alias("t")), "t") == ["20190304", "", ""]


def test_small_table_types(spark):
    df = small_table(spark, "a string, b double", [("it's", None), ("x", 1.5)])
    assert [tuple(r) for r in df.collect()] == [("it's", None), ("x", 1.5)]


def test_constant_kendall_is_undefined(spark):
    df = frame(spark, "x double, y double", [(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)])
    assert st.kendall_tau(df, "x", "y").first()["tau"] is None


def test_wilson_bounds(spark):
    low, high = st.wilson(F.lit(0), F.lit(10))
    row = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert row["l"] == 0.0 and 0.0 < row["h"] < 0.35
