"""Steps that move each row a fixed number of times, whatever the number of pairs, copies or levels."""

import numpy as np
import pytest

from tailfield.operators import effects as ef
from tailfield.operators import grid as gr
from tailfield.operators import nearest as ne
from tailfield.operators import spatial as sp
from tailfield.operators import trees as tr

RNG = np.random.default_rng(11)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def spots(spark, xy):
    rows = [(f"id{i:05d}", float(x), float(y)) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "pixel_id string, easting double, northing double")


@pytest.mark.parametrize("block_rows", [ne.BLOCK_ROWS, 150])
def test_neighbours_of_blocks_and_of_the_rest(spark, monkeypatch, block_rows):
    """Positions inside blocks, on their margins, alone far away, and in blocks with too many rows."""
    monkeypatch.setattr(ne, "BLOCK_ROWS", block_rows)
    xy = np.concatenate([RNG.integers(0, 80, (400, 2)) * 10.0, np.repeat([[155.0, 155.0]], 12, 0), RNG.uniform(5000, 9000, (15, 2))])
    ids = np.array([f"id{i:05d}" for i in range(len(xy))])
    nb = sp.k_neighbours(spots(spark, xy), k=5, tile=50.0).toPandas()
    assert nb.groupby(["easting", "northing"]).size().eq(5).all()
    assert len(nb) == 5 * len(np.unique(xy, axis=0))
    for (x, y), got in nb.groupby(["easting", "northing"]):
        d2 = (xy[:, 0] - x) ** 2 + (xy[:, 1] - y) ** 2
        want = np.lexsort((ids, d2))[:5]
        assert list(got.sort_values("rank")["_rid"]) == list(ids[want])


def test_pairs_of_neighbours_are_not_moved(spark):
    grid = np.stack(np.meshgrid(np.arange(20.0), np.arange(20.0)), -1).reshape(-1, 2) * 10
    text = plan(sp.k_neighbours(spots(spark, grid), k=5, tile=20.0))
    after = text[:text.index("FlatMapGroupsInArrow")]
    assert "Exchange" not in after and "Window" not in after


@pytest.mark.parametrize("block_rows", [ne.BLOCK_ROWS, 150])
def test_lists_of_neighbours_are_not_grouped_again(spark, monkeypatch, block_rows):
    monkeypatch.setattr(ne, "BLOCK_ROWS", block_rows)
    df = spots(spark, np.concatenate([RNG.integers(0, 60, (400, 2)) * 10.0, RNG.uniform(5000, 9000, (15, 2))]))
    lists = sp.k_neighbours(df, k=5, tile=50.0, lists=True)
    got = {(r["easting"], r["northing"]): [tuple(n) for n in r["near"]] for r in lists.collect()}
    rows = sp.k_neighbours(df, k=5, tile=50.0).orderBy("rank").collect()
    want = {}
    for r in rows:
        want.setdefault((r["easting"], r["northing"]), []).append((r["_rx"], r["_ry"], r["_rid"], r["d2"]))
    assert got == want
    dense = sp.k_neighbours(spots(spark, np.stack(np.meshgrid(np.arange(8.0), np.arange(8.0)), -1).reshape(-1, 2)), k=5, tile=4.0, lists=True)
    assert plan(dense).count("Exchange") == 1 or block_rows == 150


def test_a_pair_of_boxes_is_not_moved(spark):
    """The best box of a window is chosen where pairs are made: no pair is held to find those met twice."""
    lo, size = RNG.uniform(-500, 500, (2, 60)), RNG.uniform(5, 400, (2, 60))
    boxes = [(f"t{i:02d}", *map(float, (*lo[:, i], *(lo + size)[:, i]))) for i in range(60)]
    names = "xmin double, ymin double, xmax double, ymax double"
    best = sp.best_cover(spark.createDataFrame(boxes[:30], f"w string, {names}"), spark.createDataFrame(boxes, f"tile string, {names}"), key="w", cell=150.0)
    moved = [line for line in plan(best).splitlines() if "Exchange hashpartitioning" in line]
    assert not any("xmin" in line for line in moved)
    for r in best.collect():
        x0, y0, x1, y1 = boxes[int(r["w"][1:])][1:]

        def rank(box):
            w, h = min(x1, box[3]) - max(x0, box[1]), min(y1, box[4]) - max(y0, box[2])
            centre = box[1] <= (x0 + x1) / 2 <= box[3] and box[2] <= (y0 + y1) / 2 <= box[4]
            return (w > 0 and h > 0) * w * h / ((x1 - x0) * (y1 - y0)), centre, -(box[3] - box[1]) * (box[4] - box[2]), box[0]

        want = max(boxes, key=rank)
        assert (r["tile"], r["cover"]) == (want[0], pytest.approx(rank(want)[0]))


def test_rows_of_effect_curves_are_not_dealt_by_group(spark):
    """Groups are few, so rows dealt by group and feature would meet in one task."""
    rows = [(f"g{i % 2}", float(v), float(w)) for i, (v, w) in enumerate(RNG.normal(size=(200, 2)))]
    seen = []

    def predict(df):
        seen.append(plan(df))
        return df.withColumn("prediction", df["a"] + df["b"])

    curves = ef.effect_curves(spark.createDataFrame(rows, "g string, a double, b double"), ["g"], ["a", "b"], predict, 4)
    assert curves.count() == 16
    assert len(seen) == 2 and not any("SortMergeJoin" in text or "Exchange hashpartitioning" in text for text in seen)


@pytest.mark.parametrize("edge", ["nearest", "zero"])
def test_window_sums_move_cells_not_copies(spark, edge):
    """Blocks and their margins against a padded array, with windows that reach over several edges."""
    nrows, ncols = 300, 21
    cells = {(int(r), int(c)): float(v) for r, c, v in zip(RNG.integers(0, nrows, 40), RNG.integers(0, ncols, 40), RNG.normal(size=40), strict=True)}
    rw, cw = [0.1, 0.2, 0.4, 0.2, 0.1], [1.0, 2.0, 3.0, 2.0, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "row long, col long, v double")
    out = gr.separable_sum(df, ["v"], nrows, ncols, rw, cw, edge)
    assert plan(out).count("Exchange") == 1
    table, mask = np.zeros((nrows, ncols)), np.zeros((nrows, ncols))
    for k, v in cells.items():
        table[k], mask[k] = v, 1
    padded = np.pad(table, ((2, 2), (3, 3)), mode="edge" if edge == "nearest" else "constant")
    near = np.pad(mask, ((2, 2), (3, 3)))
    views = [np.lib.stride_tricks.sliding_window_view(a, (5, 7)) for a in (padded, near)]
    want, reached = np.einsum("ijkl,k,l->ij", views[0], rw, cw), views[1].any(axis=(2, 3))
    got = {(r["row"], r["col"]): r["v"] for r in out.collect()}
    assert set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(reached)), strict=True))
    for k, v in got.items():
        assert v == pytest.approx(want[k], abs=1e-12)


def test_bins_of_many_rows_need_no_single_task(spark, monkeypatch):
    """The same edges and medians as from one task's list of values, without such a list."""
    rows = [(float(v) if i % 7 else None, float(i % 5), float(w), None) for i, (v, w) in enumerate(RNG.normal(size=(900, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    want = tr.Bins.fit(df, ["a", "b", "c", "d"])
    monkeypatch.setattr(tr, "FIT_ROWS", 100)
    monkeypatch.setattr(tr.F, "percentile", None)
    got = tr.Bins.fit(df, ["a", "b", "c", "d"])
    assert got.features == want.features == ["a", "b", "c"]
    assert got.edges == want.edges and got.medians == want.medians


def test_wall_to_wall_scores_read_and_move_rows_once(spark):
    from tailfield.operators import models as mo
    from tailfield.operators.grid import with_cell
    from tailfield.plans import model_queries as mq

    sf = "/root/testdata/sf0.001"
    out = mq.m09(spark, sf)
    assert plan(out).count("Exchange") == 1 and plan(out).count("Scan parquet") == 1
    df = mq.frame(spark, sf)
    models = {d: mo.fit_model(df.where(df["domain"] == d), mq.FEATURES, "linear") for d in ("pf", "npf")}
    own = mo.score_cells(with_cell(df), models, "own", ["row", "col"]).groupBy("row", "col").agg({"prob": "avg", "*": "count"})
    want = {(r["row"], r["col"]): (r["count(1)"], r["avg(prob)"]) for r in own.collect()}
    got = {(r["row"], r["col"]): (r["n"], r["prob"]) for r in out.collect()}
    assert set(got) == set(want)
    for k, (n, prob) in want.items():
        assert got[k] == (n, pytest.approx(prob, abs=1e-4))
