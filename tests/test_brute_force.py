"""Distributed algorithms against direct computation on small data, also with hot keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailfield.operators import sampling as sa
from tailfield.operators import spatial as sp
from tailfield.operators import stats as st
from tailfield.operators.ordering import exact_quantiles, global_row_number, running_totals

RNG = np.random.default_rng(5)


def points(spark, xy, names=("easting", "northing"), parts=4):
    rows = [(f"id{i:05d}", float(x), float(y)) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, f"pixel_id string, {names[0]} double, {names[1]} double").repartition(parts)


def clustered(n, hot):
    """A third of the rows at one position, a far group, the rest spread out."""
    xy = RNG.uniform(-5000, 5000, (n, 2))
    xy[:hot] = (123.0, -77.0)
    xy[hot:hot + 5] += 400_000
    return xy


def test_nearest_point_is_exact(spark):
    q, r = clustered(300, 100), np.vstack([RNG.normal(3000, 5, (60, 2)), RNG.uniform(-9000, 9000, (40, 2)), [[-300_000, 2]]])
    refs = points(spark, r, ("x", "y"))
    want = np.sqrt(((q[:, None] - r[None]) ** 2).sum(-1)).min(1) / 1000
    for tile in (50.0, 1000.0, 100_000.0):
        out = sp.nearest_point(points(spark, q), refs, tile=tile).orderBy("pixel_id").toPandas()
        np.testing.assert_allclose(out["boundary_km"], want, rtol=1e-12)


def test_nearest_on_sphere_crosses_the_date_line(spark):
    q = np.array([[179.9, 10.0], [-179.9, -5.0], [0.0, 89.9], [45.0, 0.0]])
    r = np.array([[-179.95, 10.0], [170.0, -5.0], [180.0, 89.8]])
    lon1, lat1, lon2, lat2 = (np.radians(v) for v in (q[:, None, 0], q[:, None, 1], r[None, :, 0], r[None, :, 1]))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    want = (2 * 6371 * np.arcsin(np.sqrt(a))).min(1)
    out = sp.nearest_point_sphere(points(spark, q, ("longitude", "latitude")), points(spark, r, ("lon", "lat")))
    np.testing.assert_allclose(out.orderBy("pixel_id").toPandas()["boundary_km"], want, rtol=1e-9)


def test_nearest_edge_is_exact_for_long_edges(spark):
    q, e = clustered(200, 60), RNG.uniform(-20000, 20000, (12, 4))
    edges = spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(e)],
                                  "line_id int, seq int, x1 double, y1 double, x2 double, y2 double")
    d = e[:, 2:] - e[:, :2]
    t = np.clip(((q[:, None] - e[None, :, :2]) * d[None]).sum(-1) / (d ** 2).sum(-1), 0, 1)
    want = np.sqrt(((q[:, None] - (e[None, :, :2] + t[..., None] * d[None])) ** 2).sum(-1))
    out = sp.distance_to_features(points(spark, q), edges, tile=700.0, polygons=False).orderBy("pixel_id").toPandas()
    np.testing.assert_allclose(out["distance_m"], want.min(1), rtol=1e-9)
    near = sp.within_distance(points(spark, q), edges, 900.0)
    assert near.count() == len({tuple(p) for p, w in zip(q, want.min(1), strict=True) if w <= 900.0})


@pytest.mark.parametrize("block_pieces", [sp.BLOCK_PIECES, 40])
def test_distances_to_sets_of_features_move_points_once(spark, monkeypatch, block_pieces):
    """Small and large polygons, a set of points, an empty set, far positions, rows without coordinates and blocks of many pieces."""
    monkeypatch.setattr(sp, "BLOCK_PIECES", block_pieces)
    q = np.vstack([clustered(300, 20), RNG.uniform(-5000, 5000, (300, 2))])
    low = RNG.uniform(-4500, 4500, (60, 2))
    high = low + np.where(np.arange(60)[:, None] < 3, 2500.0, RNG.uniform(20, 250, (60, 2)))
    rings = [(x0, y0, x1, y0, x1, y1, x0, y1) for (x0, y0), (x1, y1) in zip(low.tolist(), high.tolist(), strict=True)]
    rows = [(f, *r[2 * i:2 * i + 2], *(r + r)[2 * i + 2:2 * i + 4]) for f, r in enumerate(rings) for i in range(4)]
    names = "feature_id int, x1 double, y1 double, x2 double, y2 double"
    squares, spots = spark.createDataFrame(rows, names), RNG.uniform(-5000, 5000, (40, 2))
    dots = spark.createDataFrame([(0, *p, *p) for p in spots.tolist()], names)
    lost = spark.createDataFrame([("lost0", None, 3.0), ("lost1", None, None)], "pixel_id string, easting double, northing double")
    out = sp.feature_distances(points(spark, q).unionByName(lost), [
        sp.Features("box", squares, 300.0), sp.Features("dot", dots, 700.0, polygons=False), sp.Features("none", squares.limit(0), 300.0)])
    got = out.orderBy("pixel_id").toPandas()
    assert list(got["pixel_id"][-2:]) == ["lost0", "lost1"] and got[["box", "dot"]][-2:].isna().all(axis=None) and got["none"].isna().all()
    gap = np.maximum(np.maximum(low[None] - q[:, None], q[:, None] - high[None]), 0)
    np.testing.assert_allclose(got["box"][:-2], np.sqrt((gap ** 2).sum(-1)).min(1), rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(got["dot"][:-2], np.sqrt(((q[:, None] - spots[None]) ** 2).sum(-1)).min(1), rtol=1e-9)
    near = spark.createDataFrame([(f"p{i}", float(i % 20), float(i // 20)) for i in range(400)], "pixel_id string, easting double, northing double")
    one = sp.distance_to_features(near, spark.createDataFrame([(0, 1.0, 1.0, 9.0, 9.0)], names), tile=30.0, polygons=False)
    text = one._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Join" not in text


@pytest.mark.parametrize("hot", [0, 120])
def test_k_nearest_is_exact(spark, hot):
    xy = clustered(300, hot)
    ids = np.array([f"id{i:05d}" for i in range(len(xy))])
    nb = sp.k_neighbours(points(spark, xy), k=7, tile=300.0).toPandas()
    for (x, y), got in nb.groupby(["easting", "northing"]):
        d2 = (xy[:, 0] - x) ** 2 + (xy[:, 1] - y) ** 2
        want = np.lexsort((ids, d2))[:7]
        assert sorted(got["_rid"]) == sorted(ids[want])


def test_local_contrast_matches_direct_solution(spark):
    xy = RNG.uniform(0, 2000, (120, 2))
    z = RNG.normal(size=120)
    df = points(spark, xy).join(spark.createDataFrame([(f"id{i:05d}", float(v)) for i, v in enumerate(z)], "pixel_id string, z double"), "pixel_id")
    out = sp.local_contrast(df, ["z"], k=9, tile=200.0).orderBy("pixel_id").toPandas()
    for i in range(120):
        nb = np.argsort(((xy - xy[i]) ** 2).sum(1))[:9]
        d, dz = xy[nb] - xy[i], z[nb] - z[i]
        grad = np.linalg.solve(d.T @ d, d.T @ dz)
        assert out["z__lstd"][i] == pytest.approx(z[nb].std(), rel=1e-9)
        assert out["z__gmag"][i] == pytest.approx(np.hypot(*grad), rel=1e-6)


@pytest.mark.parametrize("accuracy", [50, 100_000])
def test_quantiles_are_exact_with_either_path(spark, accuracy):
    v = np.concatenate([np.full(3000, 1.25), RNG.normal(size=5000), RNG.exponential(1e6, 1000)])
    df = spark.createDataFrame([(float(x), int(i % 3)) for i, x in enumerate(v)], "v double, g int").repartition(6)
    qs = [0.0, 0.05, 0.5, 0.93, 1.0]
    row = exact_quantiles(df, "v", qs, accuracy=accuracy).first()
    np.testing.assert_allclose(row["quantiles"], np.quantile(v, qs), rtol=1e-12)
    for r in exact_quantiles(df, "v", qs, ["g"], accuracy=accuracy).collect():
        np.testing.assert_allclose(r["quantiles"], np.quantile(v[np.arange(len(v)) % 3 == r["g"]], qs), rtol=1e-12)


def test_global_ranks_and_totals_do_not_depend_on_partitions(spark):
    v = [float(x) for x in RNG.integers(0, 5, 500)]
    for parts in (1, 7):
        df = spark.createDataFrame([(x, f"k{i:04d}") for i, x in enumerate(v)], "v double, k string").repartition(parts)
        got = [r["k"] for r in global_row_number(df, ["v", "k"]).orderBy("rn").collect()]
        assert got == [k for _, k in sorted((x, f"k{i:04d}") for i, x in enumerate(v))]
        folded = df.groupBy("v").agg(F.count("*").alias("c"))
        total = {r["v"]: r["t"] for r in running_totals(folded, ["v"], {"t": "c"}).collect()}
        assert total == {x: sum(1 for u in v if u <= x) for x in set(v)}


@pytest.mark.parametrize("blocks", [2, 64])
def test_kendall_counts_every_discordant_pair(spark, blocks):
    x, y = RNG.integers(0, 40, 300).astype(float), RNG.normal(size=300).round(1)
    x[:100] = 7.0
    y[50:150] = 0.5
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    row = st.kendall_tau(df, "x", "y", blocks).first()
    dx, dy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    s, d = (dx * dy).sum() / 2, int((dx * dy < 0).sum() / 2)
    assert row["discordant"] == d
    assert row["tau"] == pytest.approx(s / np.sqrt((np.abs(dx).sum() / 2) * (np.abs(dy).sum() / 2)))


def test_sample_has_the_quota_and_repeats(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 10 == 0).alias("s"))
    a = sa.smallest_keys(df, 700, "k", ["s"], "1")
    assert {r["s"]: r["count"] for r in a.groupBy("s").count().collect()} == {True: 500, False: 700}
    b = sa.smallest_keys(df.repartition(13), 700, "k", ["s"], "1")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_single_class_downsample_is_evenly_spaced(spark):
    df = spark.range(1000).select(F.format_string("%05d", F.col("id")).alias("k"), "id")
    got = sorted(r["id"] for r in sa.downsample_by_label(df, F.lit(False), 100, "k").collect())
    assert got == sorted(set(np.linspace(0, 999, 100, dtype=int).tolist()))


def test_folds_balance_blocks(spark):
    rows = [("a", 50), ("b", 30), ("c", 20), ("d", 20), ("e", 10)]
    df = spark.createDataFrame([(b,) for b, n in rows for _ in range(n)], "block_id string")
    sizes = sa.group_folds(df, 2).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in sizes) == [60, 70]
