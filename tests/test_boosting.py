"""Second-order boosting: both ways to fit, a plain version, the scoring walk, and edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailfield.operators import boosting as bo
from tailfield.operators.trees import Bins

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    rows = [(f"p{k}", float(rng.normal()), float(rng.integers(4)) if k % 7 else None, 1.0, int(rng.random() < 0.2), k % 3) for k in range(400)]
    rows = [(i, a, b, c, int(y or a > 0.9), f) for i, a, b, c, y, f in rows]
    rows.append(("q", 0.0, 0.0, 0.0, None, 0))
    return spark.createDataFrame(rows, "pixel_id string, a double, b double, c double, label int, fold int").repartition(3).cache()


@pytest.fixture(scope="module")
def shared(table):
    rows = bo.draw_rows(table, FEATURES, fold="fold")
    bins = Bins.fit(rows, FEATURES, 16)
    return bo.binned(rows, bins).cache(), bins


KINDS = [bo.Settings(rounds=4, rate=0.3, depth=3, leaves=5, leaf_rows=8), bo.Settings(**vars(bo.DRAWN) | {"rounds": 4, "depth": 3})]


def nodes_of(df):
    return sorted((r.tree, r.node, r.n, -1 if r.feature is None else r.feature, r.cut or 0, r.gain and round(r.gain, 9), r.value and round(r.value, 9)) for r in df.collect())


def plain(rows, s):
    """Trees by growing the leaf of greatest gain, in per-row code."""
    n, p = len(rows), sum(r["label"] for r in rows)
    raw, weight = ([0.0] * n, (n - p) / p) if s.weighted else ([math.log(p / (n - p))] * n, 1.0)
    out = []
    for tree in range(s.rounds):
        used = bo.round_features(FEATURES, tree, s.column_share)
        g, h = [], []
        for r, z in zip(rows, raw, strict=True):
            w, q = (weight if r["label"] else 1.0), 1 / (1 + math.exp(-z))
            g.append(math.floor((q - r["label"]) * w * bo.UNIT + 0.5) / bo.UNIT)
            h.append(math.floor(q * (1 - q) * w * bo.UNIT + 0.5) / bo.UNIT)
        drawn = [k for k, r in enumerate(rows) if s.row_share >= 1 or (r["draw"] * bo.factor(tree) >> 24) % bo.UNIT < round(s.row_share * bo.UNIT)]
        score = lambda ks: sum(g[k] for k in ks) ** 2 / (sum(h[k] for k in ks) + s.ridge)

        def best(ks, node):
            found = None
            if node.bit_length() <= s.depth:
                for f in used:
                    for cut in sorted({rows[k][f"b{f}"] + 1 for k in ks}):
                        parts = [[k for k in ks if (rows[k][f"b{f}"] < cut) is side] for side in (True, False)]
                        if all(len(x) >= s.leaf_rows and sum(h[k] for k in x) >= s.leaf_hessian for x in parts):
                            gain = score(parts[0]) + score(parts[1]) - score(ks)
                            if gain > 1e-12 and (found is None or gain > found[0] + 1e-12):
                                found = gain, f, cut
            return found

        leaves, inner = {1: (drawn, best(drawn, 1))}, {}
        while any(b for _, b in leaves.values()) and (s.leaves is None or len(leaves) < s.leaves):
            node = max((k for k in leaves if leaves[k][1]), key=lambda k: (leaves[k][1][0], -k))
            ks, (gain, f, cut) = leaves.pop(node)
            inner[node] = (len(ks), f, cut, gain)
            for child, side in ((2 * node, True), (2 * node + 1, False)):
                part = [k for k in ks if (rows[k][f"b{f}"] < cut) is side]
                leaves[child] = (part, best(part, child))
        values = {k: -s.rate * sum(g[i] for i in ks) / (sum(h[i] for i in ks) + s.ridge) for k, (ks, _) in leaves.items()}
        out += [(tree, k, n_, f, c, round(v, 9), None) for k, (n_, f, c, v) in inner.items()]
        out += [(tree, k, len(ks), -1, 0, None, round(values[k], 9)) for k, (ks, _) in leaves.items()]
        for k, r in enumerate(rows):
            node = 1
            while node in inner:
                node = 2 * node + (r[f"b{inner[node][1]}"] >= inner[node][2])
            raw[k] += values[node]
    return sorted(out)


@pytest.mark.parametrize("kind", [0, 1])
def test_both_ways_fit_the_plain_trees(shared, kind):
    held, bins = shared
    s = KINDS[kind]
    want = plain([r.asDict() for r in held.collect()], s)
    one, two = nodes_of(bo.boost(held, bins, s)), nodes_of(bo.boost_dealt(held, bins, [(s, bo.EVERY_FOLD)]))
    assert one == two
    assert [r[:5] for r in one] == [r[:5] for r in want]
    for a, b in zip(one, want, strict=True):
        for x, y in zip(a[5:], b[5:], strict=True):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-7)


def test_fits_side_by_side_leave_their_fold_out(shared):
    held, bins = shared
    fits = [(s, f) for f in (bo.EVERY_FOLD, 0, 1, 2) for s in KINDS]
    nodes = bo.boost_dealt(held, bins, fits).cache()
    for i in (3, 4):
        assert nodes_of(nodes.where(F.col("fit") == i)) == nodes_of(bo.boost(held, bins, fits[i][0], without=fits[i][1]))
    rows = {f: held.where(F.col("fold") != f).count() for f in (0, 1, 2)}
    assert {r.fit: r.n for r in nodes.where("tree = 0 AND node = 1").collect() if r.fit in (2, 4, 6)} == {2: rows[0], 4: rows[1], 6: rows[2]}


def test_a_held_out_tenth_ends_a_fit(shared, monkeypatch):
    monkeypatch.setattr(bo, "STOP_ROWS", 100)
    held, bins = shared
    s = bo.Settings(rounds=60, rate=0.8, depth=3, leaves=8, leaf_rows=2, patience=3)
    one = nodes_of(bo.boost(held, bins, s))
    assert 3 < max(r[0] for r in one) < 59
    assert one[0][2] == held.where("draw % 10 <> 0").count()
    # the dealt rounds run in workers, which do not see the changed limit; the rounds themselves are called here
    t = held.toPandas()
    args = (t[bins.columns].to_numpy().astype(np.int16), t["label"].to_numpy().astype(np.int64), t["draw"].to_numpy())
    two = [(k, *r) for k, rows in enumerate(bo._rounds(*args, FEATURES, s)) for r in rows]
    assert [r[:3] for r in one] == [r[:3] for r in sorted(two, key=lambda r: r[:2])]


def test_scores_equal_a_plain_walk(table):
    model = bo.Boosted.fit(table, FEATURES, KINDS[0])
    nodes = {(r.tree, r.node): r for r in model.nodes.collect()}

    def walk(row):
        raw = model.base
        for t in range(4):
            k = 1
            while nodes[t, k].feature is not None:
                f = FEATURES[nodes[t, k].feature]
                value = row[f] if row[f] is not None else model.bins.medians[f]
                k = 2 * k + (sum(e <= value for e in model.bins.edges[f]) >= nodes[t, k].cut)
            raw += nodes[t, k].value
        return 1 / (1 + math.exp(-raw))

    got = model.predict(table).collect()
    assert len(got) == 401 and set(got[0].asDict()) == {"pixel_id", *FEATURES, "label", "fold", "prediction"}
    assert all(abs(r.prediction - walk(r)) < 1e-9 for r in got)


def test_loss_falls_with_rounds(table):
    def loss(rounds):
        m = bo.Boosted.fit(table, FEATURES, bo.Settings(rounds=rounds, rate=0.2, depth=3, leaf_rows=5))
        return m.predict(table.where("label IS NOT NULL")).agg(F.avg(-F.log(F.when(F.col("label") == 1, F.col("prediction")).otherwise(1 - F.col("prediction"))))).first()[0]
    assert loss(1) > loss(5) > loss(20)


def test_edges(shared, table):
    held, bins = shared
    with pytest.raises(ValueError, match="both classes"):
        bo.boost(held.where("label = 1"), bins, KINDS[0])
    with pytest.raises(ValueError, match="both classes"):
        bo.boost(held.where("false"), bins, KINDS[0])
    stump = bo.Boosted.fit(table, ["c"], bo.Settings(rounds=2))  # one value: nothing to cut
    assert nodes_of(stump.nodes)[0][1:4] == (1, 400, -1)
    share = table.where("label IS NOT NULL").agg(F.avg("label")).first()[0]
    assert all(abs(r.prediction - share) < 1e-5 for r in stump.predict(table).collect())
