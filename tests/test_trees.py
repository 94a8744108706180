"""Extremely randomised trees: both ways to grow, the scoring walk, and their edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailfield.operators import evaluate as ev
from tailfield.operators import trees as tr

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = [(f"p{k}", float(rng.normal()), float(rng.integers(4)) if k % 7 else None, 1.0, int(rng.random() < 0.3)) for k in range(400)]
    rows = [(i, a, b, c, int(y or a > 1.2)) for i, a, b, c, y in rows]
    return spark.createDataFrame([*rows, ("q", 0.0, 0.0, 0.0, None)], "pixel_id string, a double, b double, c double, label int").repartition(3).cache()


def nodes_of(df):
    return sorted((r.tree, r.node, r.n, r.positives, r.feature, r.cut, None if r.after is None else round(r.after, 9)) for r in df.collect())


def key(rows):
    return [tuple(-1 if v is None else v for v in r) for r in rows]


def test_both_ways_grow_the_same_trees(table):
    rows = tr.fit_rows(table, FEATURES)
    bins = tr.Bins.fit(rows, FEATURES, 16)
    held, weights = tr.binned(rows, bins), (0.6, 2.5)
    one = key(nodes_of(tr.grow(held, bins, weights, trees=6, depth=5, tried=2)))
    two = key(nodes_of(tr.grow_dealt(held, bins, weights, trees=6, depth=5, tried=2)))
    assert one == two and max(r[1] for r in one) >= 16


def test_nodes_are_whole(table):
    """Children share out their parent's rows; every leaf has enough; leaves without a bound are pure, small or cannot be cut."""
    model = tr.ExtraTrees.fit(table, FEATURES, trees=9)
    nodes = {(r.tree, r.node): r for r in model.nodes.collect()}
    for (t, k), r in nodes.items():
        assert r.n >= 2
        if r.feature is not None:
            left, right = nodes[t, 2 * k], nodes[t, 2 * k + 1]
            assert left.n + right.n == r.n and left.positives + right.positives == r.positives
    assert {nodes[t, 1].n for t in range(9)} == {400}


def test_scores_equal_a_plain_walk(table, monkeypatch):
    monkeypatch.setattr(tr, "AT_ONCE", 300)  # several trees at a time, by several functions
    model = tr.ExtraTrees.fit(table, FEATURES, trees=12, depth=6)
    nodes = {(r.tree, r.node): r for r in model.nodes.collect()}
    zero, one = model.weights

    def plain(row):
        total = 0.0
        for t in range(12):
            k = 1
            while nodes[t, k].feature is not None:
                f = FEATURES[nodes[t, k].feature]
                value = row[f] if row[f] is not None else model.bins.medians[f]
                k = 2 * k + (sum(e <= value for e in model.bins.edges[f]) >= nodes[t, k].cut)
            r = nodes[t, k]
            total += r.positives * one / (r.positives * one + (r.n - r.positives) * zero)
        return total / 12

    got = model.predict(table).collect()
    assert len(got) == 401 and set(got[0].asDict()) == {"pixel_id", *FEATURES, "label", "prediction"}
    for r in got:
        assert abs(r.prediction - plain(r)) < 1e-6


def test_edges(spark, table):
    one = tr.ExtraTrees.fit(table.where("label = 1"), FEATURES, trees=2)
    assert {r.prediction for r in one.predict(table).collect()} == {1.0}
    held = tr.fit_rows(table, FEATURES, limit=50)
    assert held.count() == 50 and sorted(held.collect()) == sorted(tr.fit_rows(table.repartition(7), FEATURES, limit=50).collect())
    with pytest.raises(ValueError, match="no values"):
        tr.Bins.fit(table.withColumn("a", F.lit(None).cast("double")), ["a"])
    assert tr.Bins.fit(table.withColumn("a", F.lit(None).cast("double")), ["a", "b"]).features == ["b"]


@pytest.mark.parametrize(("features", "last"), [(3, 200), (11, 200), (5, 900)])
def test_packed_walk_equals_plain_steps(spark, features, last):
    """Bins of all rows in one word, in several, and of more than 8 bits."""
    rng = np.random.default_rng(features + last)
    depth, trees = 7, 4
    inner = 2 ** depth - 1
    feature = np.tile(np.append(rng.integers(0, features, inner), np.full(inner + 1, -1)), trees).astype(np.int16)
    cut = np.where(feature < 0, 0, rng.integers(1, last + 1, len(feature))).astype(np.int16)
    size = 2 * inner + 1
    place = np.arange(len(feature))
    left = np.where(feature < 0, 0, place // size * size + 2 * (place % size) + 1).astype(np.int32)
    value, roots = rng.random(len(feature)), (np.arange(trees) * size).astype(np.int32)
    bins = rng.integers(0, last + 1, (500, features)).astype(np.int16)
    want = {}
    for i, row in enumerate(bins):
        total = 0.0
        for at in roots:
            while feature[at] >= 0:
                at = left[at] + (row[feature[at]] >= cut[at])
            total += value[at]
        want[i] = float(total)
    shared = spark.sparkContext.broadcast(tr.walkable(feature, cut, left, value, roots))
    columns = [f"c{i}" for i in range(features)]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(bins.tolist())], "id int, " + ", ".join(f"{c} short" for c in columns))
    assert {r["id"]: r["s"] for r in df.select("id", tr.leaf_sum(shared, columns).alias("s")).collect()} == want


def test_metrics_score_each_row_once(table):
    """Null scores are left out without scoring the rows a second time."""
    model = tr.ExtraTrees.fit(table, FEATURES, trees=3, depth=3)
    scored = ev._counts(model.predict(table), "label", "prediction", [])
    assert str(scored._jdf.queryExecution().optimizedPlan()).count("walk(") == 1
