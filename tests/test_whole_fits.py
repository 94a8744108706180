"""Fits take all their rows, and give the same trees whether one task holds the rows or they are spread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tailfield.operators import bagging as ba
from tailfield.operators import boosting as bo
from tailfield.operators import models as mo
from tailfield.operators import subtrees as sub
from tailfield.operators import trees as tr

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = [(f"p{k}", float(rng.normal()), float(rng.integers(5)) if k % 7 else None, 1.0, int(rng.random() < 0.25), k % 3) for k in range(700)]
    rows = [(i, a, b, c, int(y or a > 1.1), f) for i, a, b, c, y, f in rows]
    return spark.createDataFrame(rows, "pixel_id string, a double, b double, c double, label int, fold int").repartition(4).cache()


def rows_of(df):
    return sorted(tuple(-1 if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize(("held", "copies", "depth"), [(90, 50_000_000, 60), (300, 1500, 60), (90, 1500, 3)])
def test_spread_trees_equal_held_ones(table, monkeypatch, held, copies, depth):
    """Nodes near the root by histograms and subtrees in tasks, in one pass and in several."""
    rows = tr.fit_rows(table, FEATURES)
    bins = tr.Bins.fit(rows, FEATURES, 24)
    shared, weights = tr.binned(rows, bins), tr.class_weights(rows)
    want = rows_of(tr.grow_dealt(shared, bins, weights, 5, depth))
    monkeypatch.setattr(tr, "HELD_ROWS", held)
    monkeypatch.setattr(sub, "COPIES_A_PASS", copies)
    got = rows_of(tr.grow_parts(shared, bins, weights, 5, depth))
    assert got == want and (depth < 60 or len(want) > 500)
    assert rows_of(tr.grow_any(shared, bins, weights, 5, depth)) == want


@pytest.mark.parametrize(("held", "copies", "depth"), [(60, 50_000_000, 60), (200, 1500, 60), (60, 1500, 3)])
def test_spread_bags_equal_held_ones(table, monkeypatch, held, copies, depth):
    rows = bo.draw_rows(table, FEATURES, fold="fold")
    bins = tr.Bins.fit(rows, FEATURES, 24)
    shared, folds = bo.binned(rows, bins), (bo.EVERY_FOLD, 1)
    want = rows_of(ba.bag_dealt(shared, bins, 4, depth, folds=folds))
    monkeypatch.setattr(ba, "HELD_ROWS", held)
    monkeypatch.setattr(sub, "COPIES_A_PASS", copies)
    assert rows_of(ba.bag_parts(shared, bins, 4, depth, folds=folds)) == want
    assert [rows_of(m.nodes) for m in ba.Bagged.fit_all(shared, bins, folds, 4, depth)] == [[r for r in want if r[0] == i] for i in (0, 1)]


def test_spread_boosting_equals_held(table, monkeypatch):
    rows = bo.draw_rows(table, FEATURES, fold="fold")
    bins = tr.Bins.fit(rows, FEATURES, 24)
    shared, fits = bo.binned(rows, bins), [(bo.Settings(rounds=2, depth=3), bo.EVERY_FOLD), (bo.Settings(**vars(bo.DRAWN) | {"rounds": 2, "depth": 2}), 1)]
    want = [m.predict(table).select("pixel_id", "prediction") for m in bo.Boosted.fit_all(shared, bins, fits)]
    monkeypatch.setattr(bo, "HELD_ROWS", 100)
    assert [rows_of(m.predict(table).select("pixel_id", "prediction")) for m in bo.Boosted.fit_all(shared, bins, fits)] == [rows_of(w) for w in want]


@pytest.mark.parametrize("kind", ["extra", "bagged"])
def test_scores_in_passes_equal_scores_at_once(table, monkeypatch, kind):
    model = mo.fit_model(table, FEATURES, kind, trees=7)
    want = rows_of(model.predict(table))
    again = mo.fit_model(table, FEATURES, kind, trees=7)
    monkeypatch.setattr(tr, "AT_ONCE", 300)
    monkeypatch.setattr(ba.Bagged, "AT_ONCE", 300)
    monkeypatch.setattr(tr, "ALL_NODES", 700)
    assert rows_of(again.predict(table)) == want


def test_quantiles_of_held_and_of_spread_values_are_equal(table, monkeypatch):
    df = table.withColumn("none", F.lit(None).cast("double"))
    shares = [i / 255 for i in range(256)]
    monkeypatch.setattr(tr.F, "percentile", None)
    assert tr.held_quantiles(df, [*FEATURES, "none"], shares) == tr.sorted_quantiles(df, [*FEATURES, "none"], shares)


def test_digests_side_by_side_equal_single_ones():
    rng = np.random.default_rng(1)
    node = np.concatenate([2 ** np.arange(61), rng.integers(1, 1 << 61, 9000), 10 ** np.arange(1, 19), 10 ** np.arange(1, 19) - 1]).astype(np.int64)
    feature = rng.integers(0, 3, len(node))
    one_by_one = [tr._numbers(317, node[a:a + 100], feature[a:a + 100], FEATURES, "cut") for a in range(0, len(node), 100)]
    assert (tr._numbers(317, node, feature, FEATURES, "cut") == np.concatenate(one_by_one)).all()


def test_zones_are_scored_one_model_after_the_other(spark):
    """A dict of functions gives the curves of ``predict_by`` and holds no two models at a time; fits and scores use several tasks."""
    from tailfield.operators import effects as ef
    from tailfield.session import spread

    rng = np.random.default_rng(2)
    rows = [(f"p{i}", f"g{i % 3}", float(v), float(w)) for i, (v, w) in enumerate(rng.normal(size=(300, 2)))]
    df = spread(spark.createDataFrame(rows, "pixel_id string, g string, a double, b double").coalesce(1))
    assert df.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    order = []

    class Scores:
        def __init__(self, factor):
            self.factor = factor

        def predict(self, rows):
            order.append(self.factor)
            return rows.withColumn("prediction", F.col("a") * self.factor + F.col("b"))

    models = {f"g{i}": Scores(i + 1.0) for i in range(3)}
    want = rows_of(ef.effect_curves(df, ["g"], ["a", "b"], ef.predict_by(models, "g"), 4))
    order.clear()
    assert rows_of(ef.effect_curves(df, ["g"], ["a", "b"], {g: lambda m=m: m.predict for g, m in models.items()}, 4)) == want
    assert order == [1.0, 1.0, 2.0, 2.0, 3.0, 3.0]


class Seen(Exception):
    pass


def seen_by(monkeypatch, names):
    """Ends a query at its first fit; tells the rows given to the fit and the rows it takes."""
    def spy(plain):
        def taken(df, *args, **kw):
            rows = plain(df, *args, **kw)
            raise Seen(df.where("label IS NOT NULL").count(), rows.count())
        return taken

    for module, name in names:
        monkeypatch.setattr(module, name, spy(getattr(module, name)))


FITS = [(tr, "fit_rows"), (bo, "draw_rows"), (ba, "draw_rows"), (mo, "draw_rows")]


@pytest.mark.parametrize("name", [
    "e4_calibration_study", "m03_bagged_trees", "m03_extra_trees", "m04_boosted_trees", "m06_stacking",
    "m08_domain_suite", "m12_fitted_importance", "m14_fitted_zone_effects", "m18_threshold_sweep", "m20_buffer_sweep"])
def test_fits_of_queries_take_all_rows(spark, monkeypatch, name):
    """sf0.1 has more rows than the 90,000 that fits once drew."""
    seen_by(monkeypatch, FITS)
    with pytest.raises(Seen) as found:
        entry_point.queries()[name](spark, "/root/testdata/sf0.1")
    given, taken = found.value.args
    assert given == taken and given > 90_000


def test_susceptibility_study_takes_all_rows_below_zero(spark, monkeypatch):
    from tailfield.plans.inputs import pixels

    def fit_domain(df, target, domain, *args, **kw):
        raise Seen(domain, df.where(F.col("domain") == domain).count())

    monkeypatch.setattr(mo, "fit_domain", fit_domain)
    with pytest.raises(Seen) as found:
        entry_point.queries()["e1_susceptibility_study"](spark, "/root/testdata/sf0.1")
    domain, taken = found.value.args
    assert taken == pixels(spark, "/root/testdata/sf0.1").where(f"domain = '{domain}' AND d_u < 0").count() and taken > 90_000
