"""Bagged trees: a plain version, several folds at once, the scoring walk, stacks over one table of bins, and edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailfield.operators import bagging as ba
from tailfield.operators import boosting as bo
from tailfield.operators import models as mo
from tailfield.operators import trees as tr

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = [(f"p{k}", float(rng.normal()), float(rng.integers(4)) if k % 7 else None, 1.0, int(rng.random() < 0.2), k % 9) for k in range(360)]
    rows = [(i, a, b, c, int(y or a > 0.9), f"k{f}") for i, a, b, c, y, f in rows]
    return spark.createDataFrame(rows, "pixel_id string, a double, b double, c double, label int, block_id string").repartition(3).cache()


@pytest.fixture(scope="module")
def shared(table):
    rows = bo.draw_rows(table.withColumn("fold", F.expr("int(substr(block_id, 2)) % 3")), FEATURES, fold="fold")
    bins = tr.Bins.fit(rows, FEATURES, 16)
    return bo.binned(rows, bins).cache(), bins


def plain(tree, rows, depth, tried):
    """One tree in per-row code."""
    copies = ba.bag_copies(np.array([r["draw"] for r in rows]), tree).tolist()
    rows = [(r, c) for r, c in zip(rows, copies, strict=True) if c]
    weight = {y: sum(c for _, c in rows) / (2 * sum(c for r, c in rows if r["label"] == y)) for y in (0, 1)}

    def impurity(part):
        one, zero = (sum(c for r, c in part if r["label"] == y) * weight[y] for y in (1, 0))
        return 2 * one * zero / (one + zero), one / (one + zero)

    out, todo = {}, [(1, rows)]
    while todo:
        node, part = todo.pop()
        options = []
        if len(part) >= 4 and impurity(part)[0] > 0 and node.bit_length() <= depth:
            for j, f in enumerate(FEATURES):
                cuts = []
                for t in sorted({r[f"b{j}"] + 1 for r, _ in part}):
                    left, right = [x for x in part if x[0][f"b{j}"] < t], [x for x in part if x[0][f"b{j}"] >= t]
                    if min(len(left), len(right)) >= 2:
                        cuts.append((round(impurity(left)[0] + impurity(right)[0], 9), t, left, right))
                if cuts:
                    options.append((tr._draws(tree, [node], [f], "order")[0, 0], j, min(cuts, key=lambda c: c[:2])))
        if options:
            _, j, (_, t, left, right) = min(sorted(options, key=lambda o: o[0])[:tried], key=lambda o: (o[2][0], o[0]))
            out[node] = (len(part), j, t, None)
            todo += [(2 * node, left), (2 * node + 1, right)]
        else:
            out[node] = (len(part), None, None, round(impurity(part)[1], 9))
    return out


@pytest.mark.parametrize("depth,tried", [(3, 1), (40, 2)])
def test_trees_equal_the_plain_ones(shared, depth, tried):
    held, bins = shared
    rows = [r.asDict() for r in held.collect()]
    got = ba.bag_dealt(held, bins, 4, depth, tried, folds=(bo.EVERY_FOLD, 1)).collect()
    for fit, mine in ((0, rows), (1, [r for r in rows if r["fold"] != 1])):
        for tree in range(4):
            want = plain(tree, mine, depth, tried)
            assert {r.node: (r.n, r.feature, r.cut, r.value and round(r.value, 9)) for r in got if (r.fit, r.tree) == (fit, tree)} == {
                k: (*v[:3], v[3] and round(v[3], 9)) for k, v in want.items()}


def test_copies_follow_the_law():
    copies = ba.bag_copies(np.random.default_rng(1).integers(0, 1 << 32, 200_000), 3)
    assert abs(copies.mean() - 1) < 0.01 and abs(copies.var() - 1) < 0.02


def test_scores_equal_a_plain_walk(table, monkeypatch):
    monkeypatch.setattr(ba.Bagged, "AT_ONCE", 300)
    model = ba.Bagged.fit(table, FEATURES, trees=7)
    nodes = {(r.tree, r.node): r for r in model.nodes.collect()}

    def walk(row):
        total = 0.0
        for t in range(7):
            k = 1
            while nodes[t, k].feature is not None:
                f = FEATURES[nodes[t, k].feature]
                value = row[f] if row[f] is not None else model.bins.medians[f]
                k = 2 * k + (sum(e <= value for e in model.bins.edges[f]) >= nodes[t, k].cut)
            total += nodes[t, k].value
        return total / 7

    got = model.predict(table).collect()
    assert len(got) == 360 and all(abs(r.prediction - walk(r)) < 1e-9 for r in got)


def test_stack_scores_no_row_by_a_model_that_saw_it(table):
    """The models of a fold are those fitted on the rows of the other folds alone, with the bins of all."""
    rows = table.withColumn("fold", F.expr("int(substr(block_id, 2)) % 3"))
    models = mo.fits_over_bins(rows, FEATURES, list(mo.OVER_BINS), [bo.EVERY_FOLD, 0, 1, 2], trees=3, depth=4)
    assert len(models) == 16
    bins = models["extra", 0].bins
    for kind in mo.OVER_BINS:
        alone = mo.fit_model(rows.where("fold <> 1"), FEATURES, kind, trees=3, depth=4, **({} if kind in ("boosted", "sampled") else {"bins": bins}))
        one = {r.pixel_id: r.prediction for r in models[kind, 1].predict(rows.where("fold = 1")).collect()}
        assert len(one) == rows.where("fold = 1").count()
        if kind in ("bagged", "extra"):
            two = {r.pixel_id: r.prediction for r in alone.predict(rows.where("fold = 1")).collect()}
            assert all(abs(one[k] - two[k]) < 1e-6 for k in one)
        else:
            root = models[kind, 1].nodes.where("tree = 0 AND node = 1").first()
            assert root.n <= rows.where("fold <> 1").count()


def test_stack_predicts_every_row(table):
    model = mo.fit_stack(table, FEATURES, ["bagged", "boosted", "linear"], folds=3, trees=4, depth=3)
    got = model.predict(table).collect()
    assert len(got) == 360 and all(0 < r.prediction < 1 for r in got) and set(got[0].asDict()) == {*table.columns, "prediction"}


def test_edges(table):
    assert {r.prediction for r in ba.Bagged.fit(table.where("label = 1"), FEATURES, trees=2).predict(table).collect()} == {1.0}
    with pytest.raises(ValueError, match="no values"):
        ba.Bagged.fit(table.where("false"), FEATURES, trees=2)
