"""Queries over model pipelines, their scores and their interpretation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailfield.functions.geo import block_id
from tailfield.functions.labels import extreme_label
from tailfield.operators import bagging as ba
from tailfield.operators import boosting as bo
from tailfield.operators import evaluate as ev
from tailfield.operators import models as mo
from tailfield.operators import trees as tr
from tailfield.operators.sampling import blocked_holdout, random_split
from tailfield.plans.inputs import basin_pixels, pixels
from tailfield.plans.registry import query, rounded
from tailfield.session import materialise, scratch_dir, spread
from tailfield.sources import artefacts
from tailfield.sources.tables import stack

FEATURES = ["magt", "slope", "dem", "soc", "ndvi", "vwc35"]
BLOCK = 2500.0


def frame(spark, sf, domain: str | None = None):
    df = pixels(spark, sf).where("domain IN ('pf', 'npf')" if domain is None else f"domain = '{domain}'")
    return df.select("pixel_id", "domain", "easting", "northing", "d_u", "grad_mag_km", *FEATURES, "pf_expert", "npf_expert", "boundary_distance_km",
                     block_id("easting", "northing", BLOCK).alias("block_id"), extreme_label("d_u").alias("label")).where("label IS NOT NULL")


def fixed_score(df):
    """A fixed rational score of two features, in the place of a fitted model."""
    z = F.coalesce("soc", F.lit(0.0)) / 50.0 + F.coalesce("slope", F.lit(0.0)) / 10.0
    return df.withColumn("prediction", z / (z + 1.5))


SCORE = "(coalesce({0}soc, 0) / 50 + coalesce({1}slope, 0) / 10) / (coalesce({0}soc, 0) / 50 + coalesce({1}slope, 0) / 10 + 1.5)"


def held_out(spark, sf, domain="pf"):
    return materialise(spread(blocked_holdout(frame(spark, sf, domain), test=0.25)))


def metric_rows(df):
    return rounded(df, 4)


@query("s10_model_store")
def s10(spark, sf):
    root, inputs = scratch_dir(spark) + "/models", [f"{sf}/lineitem.parquet"]
    df = frame(spark, sf, "pf")

    def fit():
        m = mo.fit_model(df, FEATURES, "linear")
        return m.pipeline, {"medians": m.medians, "features": FEATURES}

    need = ["medians", "features"]
    artefacts.stored_model(spark, root, inputs, {"kind": "linear"}, need, fit)
    pipeline, facts, reused = artefacts.stored_model(spark, root, inputs, {"kind": "linear"}, need, fit)
    model = mo.FittedModel(facts["features"], facts["medians"], pipeline)
    return metric_rows(ev.binary_metrics(model.predict(df), score="prediction").withColumn("reused", F.lit(reused)))


@query("m01_median_imputation", """SELECT pixel_id, round(coalesce(magt, (SELECT quantile_cont(magt, 0.5) FROM pixels)), 6) AS magt,
 round(coalesce(vwc35, (SELECT quantile_cont(vwc35, 0.5) FROM pixels)), 6) AS vwc35 FROM pixels""")
def m01(spark, sf):
    df = pixels(spark, sf).select("pixel_id", "magt", "vwc35")
    return rounded(mo.impute(df, mo.fit_medians(df, ["magt", "vwc35"])))


@query("m02_scaled_components")
def m02(spark, sf):
    split = held_out(spark, sf)
    model = mo.fit_model(split.where("split = 'train'"), FEATURES, "linear", pca=True)
    k = model.pipeline.stages[-2].getK()
    return metric_rows(ev.binary_metrics(model.predict(split.where("split = 'test'")), score="prediction").withColumn("components", F.lit(k)))


def _one_model(spark, sf, kind, **kw):
    split = held_out(spark, sf)
    model = mo.fit_model(split.where("split = 'train'"), FEATURES, kind, **kw)
    return metric_rows(ev.binary_metrics(model.predict(split.where("split = 'test'")), score="prediction"))


def _per_domain(spark, sf, kinds):
    """Held-out metrics of models of full size, for each domain and kind."""
    parts = []
    for domain in ("pf", "npf"):
        split = held_out(spark, sf, domain)
        for kind in kinds:
            model = mo.fit_model(split.where("split = 'train'"), FEATURES, kind)
            metrics = ev.binary_metrics(model.predict(split.where("split = 'test'")), score="prediction")
            parts.append(metrics.withColumns({"domain": F.lit(domain), "kind": F.lit(kind)}))
    return metric_rows(stack(parts))


@query("m03_bagged_trees")
def m03(spark, sf):
    return _per_domain(spark, sf, ["bagged"])


def per_tree_sql(rows: str, trees: int, purpose: str, taken: str) -> str:
    """Rows of each tree by their hash ``u`` (before it is cut to its bits), none where the rows of the fit are drawn."""
    odd = f"((CAST('0x' || substr(md5(tree || '|{purpose}'), 1, 8) AS BIGINT) >> 1) | 1)"
    return f"""WITH r AS (SELECT domain, CAST('0x' || substr(md5(pixel_id), 1, 8) AS BIGINT) AS draw, count(*) OVER (PARTITION BY domain) AS size FROM {rows}),
 u AS (SELECT domain, size, tree, (draw * {odd}) >> 24 AS u FROM r, range({trees}) t(tree))
 SELECT domain, tree::INTEGER AS tree, CASE WHEN any_value(size) <= {tr.FIT_ROWS} THEN count(*) FILTER ({taken}) END AS n FROM u GROUP BY domain, tree"""


DOMAIN_ROWS = "(SELECT domain, pixel_id, label FROM labelled WHERE label IS NOT NULL AND domain IN ('pf', 'npf'))"


def _leaf_rows(spark, sf, kind):
    """The rows that the leaves of each tree hold, for each domain; rows are drawn as in the SQL, which has no number then."""
    parts = []
    for domain in ("pf", "npf"):
        df = frame(spark, sf, domain)
        leaves = mo.fit_model(df, FEATURES, kind, limit=tr.FIT_ROWS).nodes.where("feature IS NULL").groupBy("tree").agg(F.sum("n").alias("n"))
        parts.append(leaves.select(F.lit(domain).alias("domain"), "tree", F.when(F.lit(df.count() <= tr.FIT_ROWS), F.col("n")).alias("n")))
    return stack(parts)


@query("m03_bag_rows", per_tree_sql(DOMAIN_ROWS, ba.TREES, "bag", f"(u & 4294967295) / 4294967296.0::DOUBLE >= {ba.COPIES[0]!r}::DOUBLE"))
def m03_bags(spark, sf):
    """Full-size bagged trees: the leaves of each tree hold the rows of its bag once."""
    return _leaf_rows(spark, sf, "bagged")


@query("m04_round_rows", per_tree_sql(DOMAIN_ROWS, bo.DRAWN.rounds, "rows", f"u & {bo.UNIT - 1} < {round(bo.DRAWN.row_share * bo.UNIT)}"))
def m04_rows(spark, sf):
    """Full-size boosting with drawn rows: the leaves of each round hold the rows drawn for it once."""
    return _leaf_rows(spark, sf, "sampled")


EXTRA_SQL = "(SELECT domain, label FROM labelled WHERE label IS NOT NULL AND domain IN ('pf', 'npf'))"


@query("m03_extra_trees")
def m03_extra(spark, sf):
    """Extremely randomised trees at full size for each domain: held-out metrics."""
    parts = []
    for domain in ("pf", "npf"):
        split = held_out(spark, sf, domain)
        model = mo.fit_model(split.where("split = 'train'"), FEATURES, "extra")
        parts.append(ev.binary_metrics(model.predict(split.where("split = 'test'")), score="prediction").withColumn("domain", F.lit(domain)))
    return metric_rows(parts[0].unionByName(parts[1]))


@query("m03_leaf_totals", f"""WITH r AS (SELECT domain, least(count(*), {tr.FIT_ROWS}) AS n, CASE WHEN count(*) <= {tr.FIT_ROWS} THEN CAST(sum(label) AS BIGINT) END AS positives FROM {EXTRA_SQL} GROUP BY domain)
 SELECT domain, tree::INTEGER AS tree, n, positives, true AS leaves_hold_enough FROM r, range({tr.TREES}) t(tree)""")
def m03_leaves(spark, sf):
    """Full-size trees on all rows of a domain: the leaves of every tree hold each row once, and none has too few rows."""
    parts = []
    for domain in ("pf", "npf"):
        model = mo.fit_model(frame(spark, sf, domain), FEATURES, "extra", limit=tr.FIT_ROWS)  # as in its SQL
        leaves = model.nodes.where("feature IS NULL").groupBy("tree").agg(
            F.sum("n").alias("n"), F.sum("positives").alias("positives"), (F.min("n") >= tr.LEAF_ROWS).alias("leaves_hold_enough"))
        sampled = F.col("n") >= tr.FIT_ROWS  # then the rows of the fit are drawn, and so is their number of positives
        parts.append(leaves.withColumn("positives", F.when(~sampled | F.lit(frame(spark, sf, domain).count() == tr.FIT_ROWS), F.col("positives"))).withColumn("domain", F.lit(domain)))
    return parts[0].unionByName(parts[1])


def node_sums_sql(trees: int, depth: int, tried: int) -> str:
    """The first levels of the same trees: bins from quantiles, drawn cuts, sums at the cuts, the cuts of least impurity."""
    k = range(len(FEATURES))
    cols = ", ".join(f"b{i}" for i in k)
    shares = [i / tr.BINS for i in range(1, tr.BINS)]
    fit = "(SELECT * FROM labelled WHERE label IS NOT NULL AND domain = 'pf')"
    edges = ", ".join(f"list_distinct(list_transform(quantile_cont({f}, {shares}), lambda v: round(v, 9))) AS e{i}, quantile_cont({f}, 0.5) AS m{i}" for i, f in enumerate(FEATURES))
    binned = ", ".join(f"len(list_filter(e{i}, lambda v: v <= coalesce({f}, m{i}))) AS b{i}" for i, f in enumerate(FEATURES))
    gini = lambda n, p: f"2.0::DOUBLE * (({p}) * one) * ((({n}) - ({p})) * zero) / (({p}) * one + (({n}) - ({p})) * zero)"
    ctes = [f"ed AS (SELECT {edges} FROM {fit})", f"bn AS (SELECT {binned}, label FROM {fit}, ed)",
            "cw AS (SELECT count(*) / (2.0::DOUBLE * (count(*) - sum(label))) AS zero, count(*) / (2.0::DOUBLE * sum(label)) AS one FROM bn)",
            f"s0 AS (SELECT tree, 1::BIGINT AS node, {cols}, label FROM bn, range({trees}) t(tree))"]
    for level in range(depth + 1):
        ranges = ", ".join(f"min(b{i}) AS lo{i}, max(b{i}) AS hi{i}" for i in k)
        cuts = ", ".join(f"CASE WHEN hi{i} > lo{i} THEN CAST(lo{i} + 1 + floor({tr.drawn_sql('tree', 'node', f, 'cut')} * (hi{i} - lo{i})) AS BIGINT) END AS t{i}" for i, f in enumerate(FEATURES))
        sums = ", ".join(f"count(*) FILTER (b{i} < t{i}) AS n{i}, count(*) FILTER (b{i} < t{i} AND label = 1) AS p{i}" for i in k)
        options = " UNION ALL ".join(
            f"SELECT tree, node, {i} AS feature, t{i} AS cut, {tr.drawn_sql('tree', 'node', f, 'order')} AS o, {gini(f'n{i}', f'p{i}')} + {gini(f'n - n{i}', f'positives - p{i}')} AS after"
            f" FROM c{level} JOIN x{level} USING (tree, node), cw WHERE t{i} IS NOT NULL AND n{i} >= 2 AND n - n{i} >= 2" for i, f in enumerate(FEATURES))
        ctes += [
            f"r{level} AS (SELECT tree, node, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, {ranges} FROM s{level} GROUP BY ALL)",
            f"c{level} AS (SELECT tree, node, n, positives, {cuts} FROM r{level})",
            f"x{level} AS (SELECT tree, node, {sums} FROM s{level} JOIN c{level} USING (tree, node) WHERE n >= 4 AND positives > 0 AND positives < n AND {str(level < depth).lower()} GROUP BY ALL)",
            f"o{level} AS (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY o, feature) AS k FROM ({options}))",
            f"m{level} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY after, o, feature) AS best FROM o{level} WHERE k <= {tried}) WHERE best = 1)",
            f"s{level + 1} AS (SELECT tree, node * 2 + CASE WHEN list_extract([{cols}], feature + 1) < cut THEN 0 ELSE 1 END AS node, {cols}, label FROM s{level} JOIN m{level} USING (tree, node))"]
    rows = " UNION ALL ".join(f"SELECT tree, node, n, positives, feature, cut, after FROM c{level} LEFT JOIN m{level} USING (tree, node)" for level in range(depth + 1))
    return f"WITH {', '.join(ctes)} SELECT tree::INTEGER AS tree, node, n, positives, feature::INTEGER AS feature, cut::INTEGER AS cut, round(after, 6) AS after FROM ({rows})"


@query("m03_node_sums", node_sums_sql(10, 2, 2))
def m03_nodes(spark, sf):
    """Counts, drawn cuts and impurity sums of the first levels of ten trees, by aggregation."""
    rows = frame(spark, sf, "pf")
    bins = tr.Bins.fit(rows, FEATURES)
    table = tr.binned(rows, bins)
    return rounded(tr.grow(table, bins, tr.class_weights(table), trees=10, depth=2))


def boost_sql(s: bo.Settings) -> str:
    """The same rounds: bins from quantiles, whole gradients, histograms by (node, feature, bin), cuts of greatest gain, Newton steps."""
    k = range(len(FEATURES))
    shares = [i / tr.BINS for i in range(1, tr.BINS)]
    fit = "(SELECT * FROM labelled WHERE label IS NOT NULL AND domain = 'pf')"
    edges = ", ".join(f"list_distinct(list_transform(quantile_cont({f}, {shares}), lambda v: round(v, 9))) AS e{i}, quantile_cont({f}, 0.5) AS m{i}" for i, f in enumerate(FEATURES))
    cols = ", ".join(f"b{i}" for i in k)
    cut_bins = ", ".join(f"len(list_filter(e{i}, lambda v: v <= coalesce({f}, m{i}))) AS b{i}" for i, f in enumerate(FEATURES))
    base, weight = ("0.0::DOUBLE", "(count(*) - sum(label)) / sum(label)::DOUBLE") if s.weighted else ("ln(sum(label) / (count(*) - sum(label))::DOUBLE)", "1.0::DOUBLE")
    unit, ridge = f"{float(bo.UNIT)}::DOUBLE", f"{s.ridge}::DOUBLE"
    ctes = [f"ed AS (SELECT {edges} FROM {fit})", f"bn AS (SELECT pixel_id, label, CAST('0x' || substr(md5(pixel_id), 1, 8) AS BIGINT) AS draw, {cut_bins} FROM {fit}, ed)",
            f"st AS (SELECT {base} AS base, {weight} AS weight FROM bn)", "s0 AS (SELECT bn.*, base AS raw FROM bn, st)"]
    out = []
    for t in range(s.rounds):
        used = bo.round_features(FEATURES, t, s.column_share)
        taken = "true" if s.row_share >= 1 else f"((draw * {bo.factor(t)}) >> 24) & {bo.UNIT - 1} < {round(s.row_share * bo.UNIT)}"
        by_class = "CASE WHEN label = 1 THEN weight ELSE 1.0::DOUBLE END"
        ctes += [f"p{t} AS (SELECT s{t}.*, 1.0::DOUBLE / (exp(-raw) + 1.0::DOUBLE) AS p, {taken} AS taken FROM s{t})",
                 f"a{t}_0 AS (SELECT pixel_id, label, draw, {cols}, raw, taken, CAST(floor((p - label) * {by_class} * {unit} + 0.5::DOUBLE) AS BIGINT) AS g,"
                 f" CAST(floor(p * (1.0::DOUBLE - p) * {by_class} * {unit} + 0.5::DOUBLE) AS BIGINT) AS h, 1 AS node FROM p{t}, st)"]
        for level in range(s.depth + 1):
            here = f"a{t}_{level}"
            cells = " UNION ALL ".join(f"SELECT node, {i} AS feature, b{i} AS bin, count(*) AS n, CAST(sum(g) AS BIGINT) AS g, CAST(sum(h) AS BIGINT) AS h FROM {here} WHERE taken AND node >= {2 ** level} GROUP BY node, b{i}" for i in used)
            term = lambda x: f"({x}g / {unit}) * ({x}g / {unit}) / ({x}h / {unit} + {ridge})"
            enough = " AND ".join(f"{x}n >= {s.leaf_rows} AND {x}h > 0 AND {x}h / {unit} >= {s.leaf_hessian}" for x in ("l", "r"))
            ctes += [
                f"h{t}_{level} AS ({cells})",
                f"c{t}_{level} AS (SELECT *, an - ln AS rn, ag - lg AS rg, ah - lh AS rh FROM (SELECT node, feature, bin + 1 AS cut, "
                + ", ".join(f"CAST(sum({c}) OVER (PARTITION BY node, feature ORDER BY bin) AS BIGINT) AS l{c}, CAST(sum({c}) OVER (PARTITION BY node, feature) AS BIGINT) AS a{c}" for c in "ngh")
                + f" FROM h{t}_{level}))",
                f"g{t}_{level} AS (SELECT node, feature, cut, an, ag, ah, CASE WHEN {enough} AND {str(level < s.depth).lower()} THEN {term('l')} + {term('r')} - {term('a')} END AS gain FROM c{t}_{level})",
                f"m{t}_{level} AS (SELECT node, an AS n, ag AS g, ah AS h, CASE WHEN gain > 0 THEN feature END AS feature, CASE WHEN gain > 0 THEN cut END AS cut, CASE WHEN gain > 0 THEN gain END AS gain"
                f" FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY coalesce(gain, 0) DESC, feature, cut) AS k FROM g{t}_{level}) WHERE k = 1)",
                f"a{t}_{level + 1} AS (SELECT x.* REPLACE (CASE WHEN m.cut IS NULL THEN x.node WHEN list_extract([{cols}], m.feature + 1) >= m.cut THEN 2 * x.node + 1 ELSE 2 * x.node END AS node)"
                f" FROM {here} x LEFT JOIN m{t}_{level} m ON x.node = m.node)"]
        found = " UNION ALL ".join(f"SELECT * FROM m{t}_{level}" for level in range(s.depth + 1))
        ctes += [f"n{t} AS (SELECT {t} AS tree, node, n, feature, cut, gain, CASE WHEN cut IS NULL THEN -{s.rate}::DOUBLE * (g / {unit}) / (h / {unit} + {ridge}) END AS value FROM ({found}))",
                 f"s{t + 1} AS (SELECT pixel_id, label, draw, {cols}, raw + coalesce(value, 0) AS raw FROM a{t}_{s.depth + 1} LEFT JOIN n{t} USING (node))"]
        loss = f"(SELECT avg(ln(1 + exp(CASE WHEN label = 1 THEN -raw ELSE raw END))) FROM s{t + 1})"
        out.append(f"SELECT tree, node, n, feature, cut, gain, value, {loss} AS loss FROM n{t}")
    # a row that was not drawn may meet no leaf only if its side of a cut drew no row, which the least number of rows excludes
    return f"""WITH {', '.join(ctes)} SELECT tree::INTEGER AS tree, node::INTEGER AS node, n, feature::INTEGER AS feature, cut::INTEGER AS cut, round(gain, 4) AS gain, round(value, 6) AS value,
 round(loss, 6) AS loss FROM ({' UNION ALL '.join(out)})"""


def _first_rounds(spark, sf, s: bo.Settings):
    rows = bo.draw_rows(frame(spark, sf, "pf"), FEATURES, limit=1 << 62)
    bins = tr.Bins.fit(rows, FEATURES)
    table = bo.binned(rows, bins)
    nodes = materialise(bo.boost(table, bins, s))
    size = table.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    losses = []
    for t in range(s.rounds):
        model = bo.Boosted(bins, nodes.where(F.col("tree") <= t), bo.start(size["n"], size["p"], s)[0])
        scored = model.predict(rows)
        loss = scored.agg(F.avg(-F.log(F.when(F.col("label") == 1, F.col("prediction")).otherwise(1.0 - F.col("prediction")))).alias("loss"))
        losses.append(loss.withColumn("tree", F.lit(t)))
    return rounded(nodes.drop("fit").join(stack(losses), "tree"), 6, gain=4)


FIRST_PLAIN = bo.Settings(rounds=2, depth=3, leaves=None, patience=None)
FIRST_DRAWN = bo.Settings(**vars(bo.DRAWN) | {"rounds": 3, "depth": 2})


@query("m04_first_plain_rounds", boost_sql(FIRST_PLAIN))
def m04_first_plain(spark, sf):
    """Counts, cuts, gains, leaf values and the loss after each of the first rounds, by aggregation over all rows."""
    return _first_rounds(spark, sf, FIRST_PLAIN)


@query("m04_first_drawn_rounds", boost_sql(FIRST_DRAWN))
def m04_first_drawn(spark, sf):
    """The same with drawn rows and features, weighted classes and a ridge."""
    return _first_rounds(spark, sf, FIRST_DRAWN)


@query("m04_boosted_trees")
def m04(spark, sf):
    return _per_domain(spark, sf, ["boosted", "sampled"])


@query("m05_balanced_logistic")
def m05(spark, sf):
    return _one_model(spark, sf, "linear")


SUITE = ["bagged", "extra", "boosted", "sampled"]


@query("m06_stacking")
def m06(spark, sf):
    """The stack of four kinds of trees at full size, five grouped folds, all over one table of bins."""
    split = held_out(spark, sf)
    model = mo.fit_stack(split.where("split = 'train'"), FEATURES, SUITE)
    return metric_rows(ev.binary_metrics(model.predict(split.where("split = 'test'")), score="prediction"))


@query("m07_regressor_per_group")
def m07(spark, sf):
    from tailfield.operators.fits import fit_quality
    from tailfield.operators.stats import top_categories
    df = basin_pixels(spark, sf).where("domain = 'pf'").withColumn("basin", F.coalesce("Main-Basin", F.lit("missing")))
    groups = ["all"] + [r["basin"] for r in top_categories(df, "basin", 5).collect()]
    parts = []
    for name in groups:
        rows = random_split(df if name == "all" else df.where(F.col("basin") == name), "pixel_id", 0.25)
        predict, importance = mo.fit_regressor(rows.where("split = 'train'"), FEATURES, "d_u", trees=6, depth=5)
        quality = fit_quality(predict(rows.where("split = 'test'")), "d_u", "prediction", -25.0, 10.0)
        for f, v in importance.items():
            parts.append(quality.select(F.lit(name).alias("basin"), "n", "r2", "mae", F.lit(f).alias("feature"), F.lit(v).alias("importance")))
    return metric_rows(stack(parts))


@query("m08_domain_suite")
def m08(spark, sf):
    """Four kinds of trees at full size for each domain, the best refitted."""
    parts = []
    for domain in ("pf", "npf"):
        out = mo.fit_domain(frame(spark, sf), "d_u", domain, FEATURES, SUITE)
        parts.append(out["metrics"].withColumns({"domain": F.lit(domain), "best": F.lit(out["best"]), "n_features": F.lit(len(out["features"]))}))
    return metric_rows(stack(parts))


@query("m09_wall_to_wall_scores")
def m09(spark, sf):
    from tailfield.operators.grid import with_cell
    df = frame(spark, sf)
    models = {d: mo.fit_model(df.where(F.col("domain") == d), FEATURES, "linear") for d in ("pf", "npf")}
    # a row's own score is one of the two it gets anyway
    scored = mo.score_cells(with_cell(df), models, "all", ["row", "col", "domain"])
    own = F.coalesce(*[F.when(F.col("domain") == d, F.col(f"prob_{d}")) for d in models])
    return metric_rows(scored.groupBy("row", "col").agg(
        F.count("*").alias("n"), F.avg(own).alias("prob"), F.avg("prob_pf").alias("prob_pf"), F.avg("prob_npf").alias("prob_npf")))


def metrics_sql(source: str, keys: list[str]) -> str:
    """Metric CTEs over ``source(keys..., label, score)``: the result is ``met``."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k}"
    return f"""fo AS (SELECT {k}, score, count(*) AS n, sum(label) AS p FROM {source} GROUP BY ALL),
 cu AS (SELECT *, sum(n - p) OVER ({part} ORDER BY score) - (n - p) AS nb, sum(n) OVER ({part} ORDER BY score DESC) AS an, sum(p) OVER ({part} ORDER BY score DESC) AS ap FROM fo),
 q9 AS (SELECT {k}, quantile_cont(score, 0.9) AS cut FROM {source} GROUP BY ALL), td AS (SELECT {k}, avg(label) FILTER (score >= cut) AS tdr FROM {source} JOIN q9 USING ({k}) GROUP BY {k}),
 met AS (SELECT {k}, CAST(sum(n) AS BIGINT) AS n, sum(p) / sum(n)::DOUBLE AS positive_fraction, sum(n * score) / sum(n) AS mean_prediction, sum(n * score) / sum(p) AS prediction_to_observed_ratio,
 sum(p * (ap / an::DOUBLE)) / sum(p) AS average_precision, sum(p * (nb + (n - p) / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n - p)) AS roc_auc,
 sum(p * pow(1 - score, 2) + (n - p) * score * score) / sum(n) AS brier FROM cu GROUP BY {k})"""


METRIC_COLS = ", ".join(f"round({c}, 6) AS {c}" for c in ("positive_fraction", "mean_prediction", "prediction_to_observed_ratio", "average_precision", "roc_auc", "brier"))


@query("m10_binary_metrics", f"""WITH src AS (SELECT m.method, d.eval_domain, label, CASE m.method WHEN 'pf_expert' THEN pf_expert ELSE npf_expert END AS score FROM labelled,
 (VALUES ('pf_expert'), ('npf_expert')) m(method), (VALUES ('all'), ('pf'), ('npf')) d(eval_domain) WHERE label IS NOT NULL AND (eval_domain = 'all' OR eval_domain = domain)),
 {metrics_sql('src', ['method', 'eval_domain'])}
 SELECT method, eval_domain, n, {METRIC_COLS}, round(tdr, 6) AS top_decile_rate, round(tdr / positive_fraction, 6) AS top_decile_lift FROM met JOIN td USING (method, eval_domain)""")
def m10(spark, sf):
    long = ev.long_scores(frame(spark, sf), ["pf_expert", "npf_expert"], ["domain", "label"])
    return rounded(ev.binary_metrics(long, by=["method"], domain="domain"))


@query("m11_roc_points", """WITH f AS (SELECT domain, pf_expert AS s, count(*) AS n, sum(label) AS p FROM labelled WHERE label IS NOT NULL GROUP BY ALL),
 c AS (SELECT domain, s, sum(p) OVER w AS tp, sum(n - p) OVER w AS fp, sum(p) OVER (PARTITION BY domain) AS tot_p, sum(n - p) OVER (PARTITION BY domain) AS tot_n FROM f WINDOW w AS (PARTITION BY domain ORDER BY s DESC))
 SELECT domain, round(s, 6) AS threshold, round(fp / tot_n::DOUBLE, 6) AS fpr, round(tp / tot_p::DOUBLE, 6) AS tpr FROM c
 UNION ALL SELECT DISTINCT domain, NULL::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM f""")
def m11(spark, sf):
    return rounded(ev.roc_points(frame(spark, sf), score="pf_expert", by=["domain"]))


_GROUPS = {"soil": ["soc"], "terrain": ["slope"], "both": ["soc", "slope"]}


@query("m12_permutation_importance", f"""WITH base AS (SELECT pixel_id, label, soc, slope FROM labelled WHERE label IS NOT NULL),
 sp AS (SELECT base.*, g, r FROM base, (VALUES ('soil'), ('terrain'), ('both')) v(g), (SELECT unnest(range(0, 15)) AS r)),
 ow AS (SELECT *, row_number() OVER (PARTITION BY g, r ORDER BY pixel_id) AS k FROM sp), dn AS (SELECT g, r, soc AS ds, slope AS dl, row_number() OVER (PARTITION BY g, r ORDER BY md5(pixel_id || '|' || g || '|' || r), pixel_id) AS k FROM sp),
 sw AS (SELECT g, r, label, CASE WHEN g IN ('soil', 'both') THEN ds ELSE soc END AS soc, CASE WHEN g IN ('terrain', 'both') THEN dl ELSE slope END AS slope FROM ow JOIN dn USING (g, r, k)
 UNION ALL SELECT 'base', 0, label, soc, slope FROM base),
 src AS (SELECT g, r, label, {SCORE.format('', '')} AS score FROM sw), {metrics_sql('src', ['g', 'r'])}, b AS (SELECT average_precision AS ap FROM met WHERE g = 'base')
 SELECT g AS "group", round(avg(ap - average_precision), 6) AS importance, round(stddev_samp(ap - average_precision), 6) AS importance_std, round(any_value(ap), 6) AS baseline_average_precision, count(*) AS n_repeats
 FROM met, b WHERE g <> 'base' GROUP BY g""")
def m12(spark, sf):
    return rounded(ev.permutation_importance(frame(spark, sf).select("pixel_id", "label", "soc", "slope"), _GROUPS, fixed_score))


ALE_SQL = f"""x AS (SELECT domain, soc, slope FROM labelled WHERE label IS NOT NULL AND soc IS NOT NULL), e AS (SELECT list_distinct(quantile_cont(soc, [{', '.join(repr(i / 16) for i in range(17))}])) AS q0 FROM x),
 s AS (SELECT list_sort(q0) AS q FROM e), b AS (SELECT slope, least(greatest(len(list_filter(q, lambda v: v <= soc)) - 1, 0), len(q) - 2) AS bin, q FROM x, s),
 d AS (SELECT bin, {SCORE.format('hi', '')} - {SCORE.format('lo', '')} AS df FROM (SELECT bin, slope, q[bin + 1] AS losoc, q[bin + 2] AS hisoc FROM b)),
 t AS (SELECT bin, avg(df) AS m, coalesce(stddev_samp(df), 0) AS sd, count(*) AS n FROM d GROUP BY bin),
 c AS (SELECT bin, n, coalesce(sum(m) OVER w, 0) + 0.5 * m AS a, sqrt(coalesce(sum(sd * sd / n) OVER w, 0) + 0.25 * sd * sd / n) AS se FROM t WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 ale AS (SELECT bin::INTEGER AS bin, (q[bin + 1] + q[bin + 2]) / 2 AS x, a - (SELECT sum(a * n) / sum(n) FROM c) AS y, se, n FROM c, s)"""


@query("m13_accumulated_effects", f"WITH {ALE_SQL} SELECT bin, round(x, 6) AS x, round(y, 6) AS y, round(y - 1.96 * se, 6) AS ylo, round(y + 1.96 * se, 6) AS yhi, n FROM ale")
def m13(spark, sf):
    return rounded(ev.ale_curve(frame(spark, sf), "soc", fixed_score))


@query("m14_effect_summary", f"""WITH {ALE_SQL} SELECT 'soc' AS feature, count(*) AS n_ale_bins, round(min(x), 6) AS feature_min, round(max(x), 6) AS feature_max, round(arg_min(y, x), 6) AS ale_start, round(arg_max(y, x), 6) AS ale_end,
 round(min(y), 6) AS ale_min, round(max(y), 6) AS ale_max, round(max(y) - min(y), 6) AS ale_range FROM ale""")
def m14(spark, sf):
    curve = ev.ale_curve(frame(spark, sf), "soc", fixed_score).withColumn("feature", F.lit("soc"))
    return rounded(ev.curve_summary(curve, ["feature"]))


@query("m15_partial_dependence", f"""WITH q AS (SELECT quantile_cont(soc, 0.05) AS a, quantile_cont(soc, 0.95) AS b FROM labelled WHERE label IS NOT NULL), r AS (SELECT slope FROM labelled WHERE label IS NOT NULL),
 g AS (SELECT i, a + i * ((b - a) / 39) AS gsoc, slope FROM q, r, (SELECT unnest(range(0, 40)) AS i)), s AS (SELECT i, gsoc, {SCORE.format('g', '')} AS p FROM g)
 SELECT i::INTEGER AS point, round(max(gsoc), 6) AS x, round(avg(p), 6) AS y, round(avg(p) - 0.1 * stddev_pop(p), 6) AS ylo, round(avg(p) + 0.1 * stddev_pop(p), 6) AS yhi FROM s GROUP BY i""")
def m15(spark, sf):
    return rounded(ev.partial_dependence(frame(spark, sf), "soc", fixed_score))


@query("m16_rank_fusion", """WITH cal AS (SELECT pf_expert, npf_expert FROM labelled WHERE label IS NOT NULL AND domain = 'npf'), n AS (SELECT count(*)::DOUBLE AS n FROM cal),
 ev AS (SELECT pixel_id, pf_expert, npf_expert FROM labelled WHERE label IS NOT NULL AND domain = 'pf'),
 ra AS (SELECT v, sum(sum(w)) OVER (ORDER BY v) AS c FROM (SELECT pf_expert AS v, 1 AS w FROM cal UNION ALL SELECT pf_expert, 0 FROM ev) GROUP BY v),
 rb AS (SELECT v, sum(sum(w)) OVER (ORDER BY v) AS c FROM (SELECT npf_expert AS v, 1 AS w FROM cal UNION ALL SELECT npf_expert, 0 FROM ev) GROUP BY v)
 SELECT pixel_id, greatest(pf_expert, npf_expert) AS dual_max, round(greatest(least(greatest(ra.c / n, 1e-5), 1 - 1e-5), least(greatest(rb.c / n, 1e-5), 1 - 1e-5)), 6) AS dual_rank_raw
 FROM ev JOIN ra ON pf_expert = ra.v JOIN rb ON npf_expert = rb.v, n""")
def m16(spark, sf):
    df = frame(spark, sf).select("pixel_id", "domain", "label", "pf_expert", "npf_expert")
    out = mo.fuse_scores(df.where("domain = 'pf'"), df.where("domain = 'npf'"), fit=False)
    return rounded(out.select("pixel_id", "dual_max", "dual_rank_raw"))


@query("m16_fitted_fusion")
def m16_fitted(spark, sf):
    df = random_split(frame(spark, sf).select("pixel_id", "domain", "label", "pf_expert", "npf_expert"), "pixel_id", 0.5)
    out = mo.fuse_scores(df.where("split = 'test'"), df.where("split = 'train'"))
    long = ev.long_scores(out, ["dual_expert", "dual_rank", "dual_max", "dual_rank_raw"], ["domain", "label"])
    return metric_rows(ev.binary_metrics(long, by=["method"], domain="domain"))


@query("m17_calibration_bins", """WITH s AS (SELECT domain, method, label, score, row_number() OVER (PARTITION BY domain, method ORDER BY score, pixel_id) AS r, count(*) OVER (PARTITION BY domain, method) AS n FROM (
 SELECT pixel_id, domain, label, 'pf_expert' AS method, pf_expert AS score FROM labelled WHERE label IS NOT NULL UNION ALL SELECT pixel_id, domain, label, 'npf_expert', npf_expert FROM labelled WHERE label IS NOT NULL)),
 b AS (SELECT *, CAST(greatest(ceil((r - 1) * least(8, greatest(2, n // 100)) / (n - 1)::DOUBLE) - 1, 0) AS BIGINT) AS bin FROM s)
 SELECT domain, method, bin, count(*) AS n, round(avg(score), 6) AS mean_prediction, round(avg(label), 6) AS observed_rate, CAST(sum(label) AS BIGINT) AS positive_n, round(min(score), 6) AS prediction_min, round(max(score), 6) AS prediction_max FROM b GROUP BY ALL""")
def m17(spark, sf):
    long = ev.long_scores(frame(spark, sf), ["pf_expert", "npf_expert"], ["pixel_id", "domain", "label"])
    return rounded(ev.calibration_bins(long, "pixel_id", ["domain", "method"]))


@query("m18_threshold_sweep")
def m18(spark, sf):
    """Both domains together, the published quantiles, full-size extremely randomised trees at each."""
    return metric_rows(mo.threshold_sweep(frame(spark, sf), "grad_mag_km", [0.90, 0.93, 0.95, 0.97], FEATURES, "extra"))


@query("m19_ablation")
def m19(spark, sf):
    split = held_out(spark, sf)
    variants = {"all": FEATURES, "without_soil": [f for f in FEATURES if f not in ("soc", "vwc35")]}
    return metric_rows(mo.ablation(split, variants, lambda rows, feats: mo.fit_model(rows, feats, "linear")))


@query("m20_buffer_sweep")
def m20(spark, sf):
    """The published buffers, full-size extremely randomised trees at each."""
    return metric_rows(mo.buffer_sweep(frame(spark, sf, "npf"), [0.0, 1.0, 2.0, 5.0, 10.0], FEATURES, "extra", "soc"))




def _score_sums(scored, features: list[str], weight):
    """Sums of the score equations of a logistic fit, over the weighted size of each feature; all are 0 at the optimum."""
    y, p = F.col("label").cast("double"), F.col("prediction")
    terms = {f: F.col(f).cast("double") for f in features} | {"intercept": F.lit(1.0)}
    sums = scored.agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"), *[
        (F.sum(weight * (p - y) * x) / F.sum(weight * F.abs(x))).alias(f"_r_{f}") for f, x in terms.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_r_{f}").alias("residual")) for f in terms])).alias("x")
    return rounded(sums.select("n", "positives", pairs).select("x.feature", "n", "positives", "x.residual"), 4)


def _score_sums_sql(features: list[str], where: str) -> str:
    rows = ", ".join(f"('{f}')" for f in [*features, "intercept"])
    return (f"SELECT feature, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, 0.0::DOUBLE AS residual FROM labelled, (VALUES {rows}) f(feature)"
            f" WHERE label IS NOT NULL AND {where} GROUP BY feature")


@query("m05_score_equations", _score_sums_sql(FEATURES, "domain = 'pf'"))
def m05_equations(spark, sf):
    """The balanced logistic model is at its optimum: its weighted score equations hold on all rows it was fitted on."""
    df = frame(spark, sf, "pf")
    model = mo.fit_model(df, FEATURES, "linear")
    filled = mo.with_balance(df.fillna(model.medians))
    return _score_sums(model.predict(filled), FEATURES, F.col("weight"))


@query("m16_score_equations", _score_sums_sql(["logit_pf", "logit_npf"], "domain IN ('pf', 'npf')"))
def m16_equations(spark, sf):
    """The fusion model is unweighted and at its optimum on its calibration rows."""
    df = frame(spark, sf).withColumns({"logit_pf": mo.logit("pf_expert"), "logit_npf": mo.logit("npf_expert")})
    model = mo.fit_model(df, ["logit_pf", "logit_npf"], "linear", balanced=False)
    return _score_sums(model.predict(df), ["logit_pf", "logit_npf"], F.lit(1.0))
