"""Queries over aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailfield.constants import EXTREME
from tailfield.functions.labels import extreme_label
from tailfield.operators import grid as g
from tailfield.operators import spatial as sp
from tailfield.operators import stats as st
from tailfield.plans.inputs import basin_pixels, pixels, table
from tailfield.plans.label_queries import zone_sql
from tailfield.plans.registry import query, rounded

WIDTHS = [2.0, 6.0, 12.0, 20.0]
INF = float("inf")


def nested(spark, sf):
    df = pixels(spark, sf).where("d_u <= 0 AND domain <> 'other' AND grad_mag_km IS NOT NULL")
    return sp.nested_widths(df, WIDTHS)


NESTED = """wd(buffer_width_km) AS (VALUES (2.0::DOUBLE), (6.0::DOUBLE), (12.0::DOUBLE), (20.0::DOUBLE)),
 nst AS (SELECT * FROM pixels JOIN wd ON distance_to_rail_m <= buffer_width_km * 500
 WHERE d_u <= 0 AND domain <> 'other' AND grad_mag_km IS NOT NULL)"""


def labelled(spark, sf):
    return pixels(spark, sf).withColumn("label", extreme_label("d_u"))


@query("a01_domain_counts", "SELECT domain, count(*) AS n_rows FROM pixels WHERE magt IS NOT NULL OR grad_mag IS NOT NULL GROUP BY domain")
def a01(spark, sf):
    return st.domain_counts(pixels(spark, sf), ["magt", "grad_mag"])


@query("a02_top_categories", """WITH c AS (SELECT coalesce("Main-Basin", 'missing') AS basin, count(*) AS n FROM basin_pixels
 WHERE domain = 'pf' GROUP BY 1) SELECT basin, n FROM c WHERE basin <> 'missing' ORDER BY CASE WHEN basin = 'REGION_3' THEN 0 ELSE 1 END, n DESC, basin LIMIT 3""")
def a02(spark, sf):
    df = basin_pixels(spark, sf).where("domain = 'pf'").withColumn("basin", F.coalesce("Main-Basin", F.lit("missing")))
    return st.top_categories(df, "basin", 3, preferred=["REGION_3"])


@query("a03_quantile_thresholds", """WITH r AS (SELECT 'all' AS region, d_u FROM pixels UNION ALL SELECT domain, d_u FROM pixels),
 q(q) AS (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.93::DOUBLE)) SELECT region, q, count(d_u) AS n, round(CASE q WHEN 0.05 THEN quantile_cont(d_u, 0.05)
 WHEN 0.5 THEN quantile_cont(d_u, 0.5) ELSE quantile_cont(d_u, 0.93) END, 6) AS threshold FROM r, q GROUP BY region, q""")
def a03(spark, sf):
    return rounded(st.quantile_table(pixels(spark, sf), "d_u", [0.05, 0.5, 0.93], "domain"))


@query("a04_robust_limits", """SELECT 'robust' AS kind, round(quantile_cont(grad_mag_km, 0.02), 6) AS lo, round(quantile_cont(grad_mag_km, 0.98), 6) AS hi FROM pixels
 UNION ALL SELECT 'symmetric', round(-quantile_cont(abs(d_u), 0.98), 6), round(quantile_cont(abs(d_u), 0.98), 6) FROM pixels
 UNION ALL SELECT 'centred', round(-greatest(abs(quantile_cont(d_u, 0.01)), abs(quantile_cont(d_u, 0.99))), 6), round(greatest(abs(quantile_cont(d_u, 0.01)), abs(quantile_cont(d_u, 0.99))), 6) FROM pixels
 UNION ALL SELECT 'empty', 0, 1""")
def a04(spark, sf):
    df = pixels(spark, sf)
    parts = {
        "robust": st.robust_limits(df, "grad_mag_km"), "symmetric": st.symmetric_limits(df, "d_u"),
        "centred": st.centred_limits(df, "d_u"), "empty": st.robust_limits(df, F.when(F.col("d_u") > 1e9, F.col("d_u")))}
    out = None
    for kind, part in parts.items():
        part = part.select(F.lit(kind).alias("kind"), "lo", "hi")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query("a05_percentile_trim", """WITH q AS (SELECT domain, quantile_cont(grad_mag_km, 0.005) AS lo, quantile_cont(grad_mag_km, 0.995) AS hi FROM pixels GROUP BY domain)
 SELECT domain, count(*) AS n, round(avg(grad_mag_km), 6) AS mean FROM pixels JOIN q USING (domain) WHERE grad_mag_km BETWEEN lo AND hi GROUP BY domain""")
def a05(spark, sf):
    return rounded(st.trim(pixels(spark, sf), "grad_mag_km", ["domain"]).groupBy("domain").agg(
        F.count("*").alias("n"), F.avg("grad_mag_km").alias("mean")))


def zone_summary_sql(source: str, target: str, zone: str, extreme: str) -> str:
    return f"""z AS (SELECT domain, {zone} AS zone, {extreme} AS x FROM {source} WHERE {target} IS NOT NULL),
 k(zone, domain) AS (VALUES ('npf_transition','npf'),('npf_interior','npf'),('pf_transition_impacted','pf'),('pf_transition_background','pf'),('pf_interior_impacted','pf'),('pf_interior_background','pf')),
 c AS (SELECT k.zone, k.domain, count(x) AS n_pixels, count(*) FILTER (x) AS extreme_n FROM k LEFT JOIN z ON k.zone = z.zone AND k.domain = z.domain GROUP BY ALL),
 t AS (SELECT *, CAST(sum(n_pixels) OVER (PARTITION BY domain) AS BIGINT) AS domain_n_pixels, CAST(sum(extreme_n) OVER (PARTITION BY domain) AS BIGINT) AS domain_extreme_n FROM c)
 SELECT '{target}' AS target, zone, domain, n_pixels, domain_n_pixels, extreme_n, domain_extreme_n, round(extreme_n / nullif(n_pixels, 0)::DOUBLE, 6) AS extreme_density,
 round(extreme_n / nullif(domain_extreme_n, 0)::DOUBLE, 6) AS domain_extreme_share, round(n_pixels / nullif(domain_n_pixels, 0)::DOUBLE, 6) AS sample_share FROM t"""


X_DU = "(domain = 'pf' AND d_u <= -16.5) OR (domain = 'npf' AND d_u <= -7.4)"
X_GRAD = "(domain = 'pf' AND grad_mag_km >= 30.5) OR (domain = 'npf' AND grad_mag_km >= 17.0)"


@query("a06_zone_summary", "WITH " + zone_summary_sql("pixels", "d_u", zone_sql(), X_DU))
def a06(spark, sf):
    return rounded(st.zone_summary(pixels(spark, sf), "d_u"))


_SENS_GRID = ", ".join(f"({b}::DOUBLE, {a}::DOUBLE)" for b in (3.0, 5.0, 7.0, 10.0) for a in (1.0, 2.0, 3.0, 5.0))


@query("a07_threshold_sensitivity", f"""WITH g(b, a) AS (VALUES {_SENS_GRID}), l AS (SELECT 'd_u' AS target, domain, boundary_distance_km AS db, tlrts_distance_km AS da,
 {X_DU} AS x FROM pixels WHERE d_u IS NOT NULL UNION ALL SELECT 'grad_mag_km', domain, boundary_distance_km, tlrts_distance_km, {X_GRAD} FROM pixels WHERE grad_mag_km IS NOT NULL),
 s AS (SELECT target, b, a, avg(CAST(x AS INT)) FILTER (domain='npf' AND db < b) AS nt, avg(CAST(x AS INT)) FILTER (domain='npf' AND db >= b) AS ni,
 avg(CAST(x AS INT)) FILTER (domain='pf' AND db >= b AND da < a) AS pii, avg(CAST(x AS INT)) FILTER (domain='pf' AND db >= b AND da >= a) AS pib,
 avg(CAST(x AS INT)) FILTER (domain='pf' AND db < b AND da >= 0) AS pt, avg(CAST(x AS INT)) FILTER (domain='pf' AND db >= b AND da >= 0) AS pi,
 100.0::DOUBLE * count(*) FILTER (domain='npf' AND db >= b) / count(*) FILTER (domain='npf' AND db >= 0) AS rn,
 100.0::DOUBLE * count(*) FILTER (domain='pf' AND db >= b AND da >= a) / count(*) FILTER (domain='pf' AND db >= 0 AND da >= 0) AS rp FROM l, g GROUP BY ALL)
 SELECT target, b AS boundary_transition_km, a AS tlrts_impact_km, round(nt/ni, 6) AS npf_transition_vs_interior, round(pii/pib, 6) AS pf_interior_impacted_vs_background,
 round(pt/pi, 6) AS pf_transition_vs_interior, round(rn, 6) AS npf_interior_retained_pct, round(rp, 6) AS pf_interior_background_retained_pct FROM s""")
def a07(spark, sf):
    return rounded(st.threshold_sensitivity(pixels(spark, sf), ["d_u", "grad_mag_km"], [3.0, 5.0, 7.0, 10.0], [1.0, 2.0, 3.0, 5.0]))


_COMP = " UNION ALL ".join(
    [f"SELECT buffer_width_km, 'sample_domain' AS \"group\", '{d}' AS label, count(*) FILTER (domain = '{d}') AS count FROM nst GROUP BY 1" for d in ("pf", "npf")]
    + [f"SELECT buffer_width_km, '{n}_extreme_{s}', '{lab}', count(*) FILTER (domain = '{d}' AND {'' if lab == 'Extreme' else 'NOT '}({t} {op} {EXTREME[(d, t)]})) FROM nst GROUP BY 1"
       for d, n in (("pf", "permafrost"), ("npf", "non_permafrost")) for t, s, op in (("d_u", "du", "<"), ("grad_mag_km", "grad", ">")) for lab in ("Extreme", "Reference")])


@query("a08_composition_counts", f"WITH {NESTED} {_COMP}")
def a08(spark, sf):
    return st.composition_counts(nested(spark, sf))


@query("a09_interval_stats", f"""WITH {NESTED}, l AS (SELECT 'd_u' AS metric, domain, buffer_width_km, d_u AS v FROM nst WHERE along_km BETWEEN 400 AND 1000
 UNION ALL SELECT 'grad_mag_km', domain, buffer_width_km, grad_mag_km FROM nst WHERE along_km BETWEEN 400 AND 1000)
 SELECT metric, domain, buffer_width_km, count(*) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, round(coalesce(stddev_samp(v), 0) * 0.1, 6) AS err FROM l GROUP BY ALL""")
def a09(spark, sf):
    return rounded(st.interval_stats(nested(spark, sf), ["d_u", "grad_mag_km"], WIDTHS, (400.0, 1000.0)))


@query("a10_extreme_portion", f"""WITH {NESTED} SELECT buffer_width_km, domain, count(*) AS n, round(100.0::DOUBLE * avg(CAST(CASE domain WHEN 'pf' THEN d_u < -16.5 ELSE d_u < -7.4 END AS INT)), 6) AS value
 FROM nst GROUP BY ALL""")
def a10(spark, sf):
    return rounded(st.extreme_portion(nested(spark, sf), "d_u", WIDTHS))


@query("a11_mean_score", f"""WITH {NESTED} SELECT buffer_width_km, domain, count(*) AS n, round(100 * avg(pf_expert), 6) AS value, round(100 * stddev_samp(pf_expert), 6) AS std,
 round(10 * stddev_samp(pf_expert), 6) AS err FROM nst GROUP BY ALL""")
def a11(spark, sf):
    return rounded(st.mean_score_pct(nested(spark, sf), "pf_expert", WIDTHS))


@query("a12_describe", f"""WITH {NESTED}, l AS ({' UNION ALL '.join(f"SELECT buffer_width_km, '{m}' AS metric, {m} AS v FROM nst" for m in ('d_u', 'grad_mag_km', 'distance_to_rail_m', 'along_km'))})
 SELECT buffer_width_km, metric, count(*) AS n, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std, round(quantile_cont(v, 0.5), 5) AS median, round(min(v), 5) AS min, round(max(v), 5) AS max FROM l GROUP BY ALL""")
def a12(spark, sf):
    return rounded(st.describe(nested(spark, sf), ["d_u", "grad_mag_km", "distance_to_rail_m", "along_km"], ["buffer_width_km"]), 5)


@query("a13_rate_by_distance", """WITH b(bin_index, lo, hi) AS (VALUES (0, 0.0::DOUBLE, 1.0::DOUBLE), (1, 1, 2), (2, 2, 5), (3, 5, 10), (4, 10, 30), (5, 30, NULL)),
 c AS (SELECT bin_index, lo, hi, count(label) AS n, CAST(coalesce(sum(label), 0) AS BIGINT) AS positives FROM b LEFT JOIN (SELECT * FROM labelled WHERE domain = 'npf') ON boundary_distance_km >= lo
 AND (hi IS NULL OR boundary_distance_km < hi) GROUP BY ALL), r AS (SELECT *, positives / nullif(n, 0)::DOUBLE AS p, nullif(n, 0)::DOUBLE AS m FROM c),
 w AS (SELECT *, (p + 3.8416 / (2 * m)) / (1 + 3.8416 / m) AS ctr, 1.96 / (1 + 3.8416 / m) * sqrt(greatest(p * (1 - p) / m + 3.8416 / (4 * m * m), 0)) AS hw FROM r)
 SELECT bin_index, lo, hi, n, positives, round(p, 6) AS rate, CASE WHEN n > 0 THEN round(greatest(0, ctr - hw), 6) END AS ci_low, CASE WHEN n > 0 THEN round(least(1, ctr + hw), 6) END AS ci_high FROM w""")
def a13(spark, sf):
    df = labelled(spark, sf).where("domain = 'npf'")
    return rounded(st.rate_by_bin(df, "boundary_distance_km", "label", [0.0, 1.0, 2.0, 5.0, 10.0, 30.0, INF]))


@query("a14_missingness", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n_finite, round(1 - count({c}) / count(*)::DOUBLE, 6) AS missing_fraction FROM pixels" for c in ("magt", "slope", "grad_mag")))
def a14(spark, sf):
    return rounded(st.missingness(pixels(spark, sf), ["magt", "slope", "grad_mag", "vwc35"], 0.4))


@query("a15_density_histogram", """WITH h AS (SELECT domain, CAST(least(floor((d_u + 20) / 0.5::DOUBLE), 39) AS BIGINT) AS bin FROM pixels WHERE d_u BETWEEN -20 AND 0),
 t AS (SELECT domain, count(*) AS total FROM h GROUP BY domain), f AS (SELECT domain, total, unnest(range(0, 40)) AS bin FROM t), c AS (SELECT domain, bin, count(*) AS count FROM h GROUP BY ALL)
 SELECT domain, bin, round(-20 + (bin + 0.5) * 0.5, 6)::DOUBLE AS centre, coalesce(count, 0) AS count, round(CASE WHEN domain = 'npf' AND coalesce(count, 0) > 0 THEN -1 ELSE 1 END * coalesce(count, 0) / (total * 0.5::DOUBLE), 6) AS density
 FROM f LEFT JOIN c USING (domain, bin)""")
def a15(spark, sf):
    return rounded(st.density_histogram(pixels(spark, sf), "d_u", -20.0, 0.0, 40, "domain", mirror="npf"))


_W13 = g.gaussian_weights(1.3, 3.0)


def _a16_sql() -> str:
    from tailfield.plans.grid_queries import smooth_sql
    counts = ('SELECT CAST(least(floor(pf_expert / (1.0::DOUBLE / 150)), 149) AS BIGINT) AS "row", CAST(least(floor(npf_expert / (1.0::DOUBLE / 150)), 149) AS BIGINT) AS col,'
              " count(*) AS density FROM pixels WHERE pf_expert BETWEEN 0 AND 1 AND npf_expert BETWEEN 0 AND 1 GROUP BY ALL")
    return ("WITH " + smooth_sql(counts, "150", "150", _W13, _W13, "zero")
            + ' SELECT "row", col, h.density::BIGINT AS n, round(s2.density, 5) AS density FROM h JOIN s2 USING ("row", col)')


@query("a16_relative_density", _a16_sql())
def a16(spark, sf):
    pts = g.relative_density(pixels(spark, sf), "pf_expert", "npf_expert", 0.0, 1.0)
    return rounded(pts.groupBy("row", "col").agg(F.count("*").alias("n"), F.max("density").alias("density")), 5)


@query("a17_box_statistics", """WITH q AS (SELECT domain, quantile_cont(grad_mag_km, 0.005) AS lo, quantile_cont(grad_mag_km, 0.995) AS hi FROM pixels GROUP BY domain),
 t AS (SELECT domain, grad_mag_km AS v FROM pixels JOIN q USING (domain) WHERE grad_mag_km BETWEEN lo AND hi), s AS (SELECT domain, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM t GROUP BY domain)
 SELECT domain, count(*) AS n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(least(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), q1), 6) AS whisker_low,
 round(greatest(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), q3), 6) AS whisker_high FROM t JOIN s USING (domain) GROUP BY domain, q1, median, q3""")
def a17(spark, sf):
    return rounded(st.box_stats(st.trim(pixels(spark, sf), "grad_mag_km", ["domain"]), "grad_mag_km", ["domain"]))


@query("a18_kde_band", """WITH v AS (SELECT domain, magt, count(*) AS c FROM pixels WHERE magt IS NOT NULL GROUP BY ALL), s AS (SELECT domain, count(*) AS n, 0.3::DOUBLE * stddev_samp(magt) AS h,
 quantile_cont(magt, 0.025) AS band_low, quantile_cont(magt, 0.975) AS band_high, avg(CAST(magt > 2.5 AS INT)) AS share FROM pixels WHERE magt IS NOT NULL GROUP BY domain),
 x AS (SELECT i, -2 + i * (7.0::DOUBLE / 299) AS x FROM (SELECT unnest(range(0, 300)) AS i)),
 k AS (SELECT domain, x, sum(c * exp(-0.5 * pow((x - magt) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density FROM v JOIN s USING (domain), x GROUP BY domain, x)
 SELECT domain, round(any_value(band_low), 6) AS band_low, round(any_value(band_high), 6) AS band_high, round(arg_max(x, density) FILTER (x BETWEEN band_low AND band_high), 6) AS mode,
 round(sum(density) * 7 / 299, 6) AS mass, round(max(density), 6) AS peak FROM k JOIN s USING (domain) GROUP BY domain""")
def a18(spark, sf):
    df = pixels(spark, sf).where("magt IS NOT NULL")
    curve = st.kde_curve(df, "magt", ["domain"], -2.0, 5.0)
    band = st.central_band(curve, df, "magt", ["domain"])
    peaks = curve.groupBy("domain").agg((F.sum("density") * 7.0 / 299).alias("mass"), F.max("density").alias("peak"))
    return rounded(band.join(peaks, "domain"))


@query("a19_split_summary", """SELECT CASE CAST(hash_split AS INT) WHEN 0 THEN 'test' ELSE 'train' END AS split, domain, count(*) AS n, round(avg(label), 6) AS positive_fraction
 FROM (SELECT *, CASE WHEN substr(md5(pixel_id), 1, 1) < '4' THEN 0 ELSE 1 END AS hash_split FROM labelled) WHERE label IS NOT NULL GROUP BY ALL""")
def a19(spark, sf):
    from tailfield.operators.sampling import random_split
    df = random_split(labelled(spark, sf), "pixel_id", 0.25, salt="")
    return rounded(st.split_summary(df, ["split", "domain"]))


@query("a20_grouping_sets", """SELECT coalesce(domain, 'all') AS eval_domain, count(*) AS n, round(avg(label), 6) AS positive_fraction, round(avg(pf_expert), 6) AS mean_prediction,
 round(avg(pow(pf_expert - label, 2)), 6) AS brier FROM labelled WHERE label IS NOT NULL GROUP BY GROUPING SETS ((domain), ())""")
def a20(spark, sf):
    df = labelled(spark, sf).where("label IS NOT NULL")
    sets = df.groupingSets([[F.col("domain")], []], "domain").agg(
        F.count("*").alias("n"), F.avg("label").alias("positive_fraction"), F.avg("pf_expert").alias("mean_prediction"),
        F.avg(F.pow(F.col("pf_expert") - F.col("label"), 2)).alias("brier"))
    return rounded(sets.withColumn("eval_domain", F.coalesce("domain", F.lit("all"))).drop("domain"))


@query("a21_run_summary", """SELECT 'n_rows' AS metric, count(*)::VARCHAR AS value FROM pixels UNION ALL SELECT 'n_pf', count(*)::VARCHAR FROM pixels WHERE domain = 'pf'
 UNION ALL SELECT 'min_du_x10', CAST(min(d_u * 10) AS BIGINT)::VARCHAR FROM pixels""")
def a21(spark, sf):
    return st.run_summary(pixels(spark, sf), {
        "n_rows": F.count("*"), "n_pf": F.count_if(F.col("domain") == "pf"), "min_du_x10": F.min(F.col("d_u") * 10).cast("long")})


@query("a22_class_weights", "SELECT domain, round(avg(label), 6) AS prevalence, round(greatest((1 - avg(label)) / avg(label), 1), 6) AS positive_weight FROM labelled WHERE label IS NOT NULL GROUP BY domain")
def a22(spark, sf):
    return rounded(st.class_weights(labelled(spark, sf), by=["domain"]))


@query("a23_kendall_tau", """WITH p AS (SELECT boundary_distance_km AS x, d_u AS y, count(*) AS c FROM pixels WHERE boundary_distance_km IS NOT NULL AND d_u IS NOT NULL GROUP BY ALL),
 ys AS (SELECT DISTINCT y FROM p), xs AS (SELECT DISTINCT x FROM p), g AS (SELECT x, y, coalesce(c, 0) AS c FROM xs CROSS JOIN ys LEFT JOIN p USING (x, y)),
 u AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
 v AS (SELECT *, coalesce(sum(below) OVER (PARTITION BY y ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS disc FROM u),
 s AS (SELECT sum(c)::DOUBLE AS n, sum(c::DOUBLE * disc::DOUBLE) AS d, sum(c::DOUBLE * (c - 1) / 2) AS xy FROM v),
 tx AS (SELECT sum(m * (m - 1) / 2) AS t FROM (SELECT sum(c)::DOUBLE AS m FROM p GROUP BY x)), ty AS (SELECT sum(m * (m - 1) / 2) AS t FROM (SELECT sum(c)::DOUBLE AS m FROM p GROUP BY y))
 SELECT n::BIGINT AS n, d::BIGINT AS discordant, round((n * (n - 1) / 2 - tx.t - ty.t + xy - 2 * d) / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)), 8) AS tau FROM s, tx, ty""")
def a23(spark, sf):
    return rounded(st.kendall_tau(pixels(spark, sf), "boundary_distance_km", "d_u").select("n", "discordant", "tau"), 8)


@query("a24_max_per_key", "SELECT p_type, round(max(l_extendedprice), 6) AS max_score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type")
def a24(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(st.max_per_key(li.withColumn("k", F.col("p_type")), "k", "l_extendedprice", "p_type").drop("k"))
