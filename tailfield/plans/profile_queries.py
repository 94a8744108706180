"""Queries over profiles, ordered windows and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailfield.operators import fits
from tailfield.operators import profiles as pr
from tailfield.plans.inputs import pixels, table
from tailfield.plans.registry import query, rounded

SIGNED = [-20.0 + 0.5 * i for i in range(81)]
OUTWARD = [0.5 * i for i in range(41)]
DB, DA = "boundary_distance_km", "tlrts_distance_km"


def profile_sql(x: str, y: str, lo: float, where: str, tag: str) -> str:
    return (f"SELECT {tag}, {lo} + (b + 0.5::DOUBLE) * 0.5::DOUBLE AS x, avg(y) AS mean, coalesce(stddev_samp(y), 0) AS std,"
            f" coalesce(stddev_samp(y), 0) / sqrt(count(*)) AS se, count(*) AS n FROM (SELECT *, floor((({x}) - {lo}) / 0.5::DOUBLE) AS b, {y} AS y"
            f" FROM pixels WHERE {where} AND {y} IS NOT NULL AND ({x}) >= {lo} AND ({x}) < 20) GROUP BY {tag.split(' AS ')[0] if not tag.startswith(chr(39)) else 'b'}, b HAVING count(*) >= 20")


_W01 = " UNION ALL ".join([
    profile_sql(f"CASE WHEN domain = 'npf' THEN -{DB} ELSE {DB} END", "d_u", -20.0, f"{DB} IS NOT NULL", "'signed' AS profile"),
    profile_sql(DB, "grad_mag_km", 0.0, f"domain = 'pf' AND {DA} >= 4", "'outward' AS profile"),
    profile_sql(DA, "d_u", 0.0, f"domain = 'pf' AND {DB} < 3.25", "'transition' AS profile"),
    profile_sql(DA, "d_u", 0.0, f"domain = 'pf' AND {DB} >= 3.25", "'interior' AS profile"),
])


@query("w01_fixed_edge_profiles", f"SELECT profile, round(x, 6) AS x, round(mean, 6) AS mean, round(std, 6) AS std, round(se, 6) AS se, n FROM ({_W01})")
def w01(spark, sf):
    df = pixels(spark, sf)
    parts = {"signed": pr.signed_boundary_profile(df, "d_u", SIGNED), "outward": pr.outward_profile(df, "grad_mag_km", "pf", OUTWARD, 4.0),
             "transition": pr.feature_profile(df, "d_u", OUTWARD, "transition"), "interior": pr.feature_profile(df, "d_u", OUTWARD, "interior")}
    out = None
    for name, part in parts.items():
        part = part.withColumn("profile", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query("w02_along_line_profile", """WITH l AS (SELECT 'd_u' AS metric, along_km, d_u AS v FROM pixels UNION ALL SELECT 'grad_mag_km', along_km, grad_mag_km FROM pixels),
 b AS (SELECT metric, greatest(ceil(along_km / 12.5::DOUBLE), 1) AS b, v FROM l WHERE v IS NOT NULL), s AS (SELECT metric, b, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std, count(*) AS n FROM b GROUP BY ALL)
 SELECT metric, (b - 1) * 12.5::DOUBLE AS bin_left_km, b * 12.5::DOUBLE AS bin_right_km, (b - 0.5::DOUBLE) * 12.5::DOUBLE AS center_km, round(mean, 6) AS mean, round(std, 6) AS std,
 round(mean - 0.1 * std, 6) AS ylo, round(mean + 0.1 * std, 6) AS yhi, n FROM s""")
def w02(spark, sf):
    return rounded(pr.along_profile(pixels(spark, sf), "along_km", ["d_u", "grad_mag_km"], 12.5, 0.1))


@query("w03_quantile_curve", """WITH t AS (SELECT dem AS x, d_u AS y FROM pixels WHERE dem IS NOT NULL AND d_u IS NOT NULL), e AS (SELECT quantile_cont(x, [i / 20.0::DOUBLE FOR i IN range(0, 21)]) AS q FROM t),
 b AS (SELECT x, y, greatest(len(list_filter(list_distinct(q), lambda k: k < x)), 1)::INTEGER AS bin FROM t, e)
 SELECT bin, round(quantile_cont(x, 0.5), 6) AS x, round(avg(y), 6) AS y, round(avg(y) - 0.1 * coalesce(stddev_samp(y), 0), 6) AS ylo, round(avg(y) + 0.1 * coalesce(stddev_samp(y), 0), 6) AS yhi, count(*) AS n FROM b GROUP BY bin""".replace(
    "quantile_cont(x, [i / 20.0::DOUBLE FOR i IN range(0, 21)])", "quantile_cont(x, [" + ", ".join(f"{i / 20!r}" for i in range(21)) + "])"))
def w03(spark, sf):
    return rounded(pr.quantile_curve(pixels(spark, sf), "dem", "d_u", 20))


@query("w04_edge_curve", """WITH b AS (SELECT CASE WHEN slope BETWEEN 0 AND 1 THEN 1 WHEN slope <= 2 THEN 2 WHEN slope <= 4 THEN 4 WHEN slope <= 8 THEN 8 END::DOUBLE AS x, d_u AS y FROM pixels WHERE slope >= 0)
 SELECT x, round(avg(y), 6) AS y, round(avg(y) - 0.1 * stddev_samp(y), 6) AS ylo, round(avg(y) + 0.1 * stddev_samp(y), 6) AS yhi, count(*) AS n FROM b WHERE x IS NOT NULL GROUP BY x""")
def w04(spark, sf):
    return rounded(pr.edge_curve(pixels(spark, sf), "slope", "d_u", [0.0, 1.0, 2.0, 4.0, 8.0]))


@query("w05_equal_count_bins", """WITH r AS (SELECT domain, pf_expert, row_number() OVER (PARTITION BY domain ORDER BY pf_expert, pixel_id) AS r, count(*) OVER (PARTITION BY domain) AS n FROM pixels),
 b AS (SELECT domain, pf_expert, CAST(greatest(ceil((r - 1) * 8 / (n - 1)::DOUBLE) - 1, 0) AS BIGINT) AS bin FROM r)
 SELECT domain, bin, count(*) AS n, round(min(pf_expert), 6) AS lo, round(max(pf_expert), 6) AS hi FROM b GROUP BY ALL""")
def w05(spark, sf):
    binned = pr.rank_bins(pixels(spark, sf).select("domain", "pf_expert", "pixel_id"), "pf_expert", "pixel_id", 8, ["domain"])
    return rounded(binned.groupBy("domain", "bin").agg(F.count("*").alias("n"), F.min("pf_expert").alias("lo"), F.max("pf_expert").alias("hi")))


W06_SQL = """ord AS (SELECT vwc35 AS x, d_u, grad_mag_km, row_number() OVER (ORDER BY vwc35, pixel_id) - 1 AS i, count(*) OVER () AS n FROM pixels WHERE vwc35 IS NOT NULL),
 par AS (SELECT n, CASE WHEN w % 2 = 0 THEN w - 1 ELSE w END AS w FROM (SELECT any_value(n) AS n, greatest(301, CAST(floor(any_value(n) * 0.05::DOUBLE) AS BIGINT)) AS w FROM ord)),
 ctr AS (SELECT DISTINCT CAST(floor(w // 2 + j * ((n - 2 * (w // 2) - 1) / 159.0::DOUBLE)) AS BIGINT) AS centre, w // 2 AS h FROM par, (SELECT unnest(range(0, 160)) AS j)),
 mov AS (SELECT centre, avg(x) AS x_mean, max(x) FILTER (i = centre) AS x_median, count(*) AS n_window, avg(d_u) AS d_u_mean, coalesce(stddev_samp(d_u), 0) AS d_u_std,
 avg(grad_mag_km) AS grad_mag_km_mean, coalesce(stddev_samp(grad_mag_km), 0) AS grad_mag_km_std FROM ctr JOIN ord ON i BETWEEN centre - h AND centre + h GROUP BY centre)"""
W06_COLS = "n_window, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("x_mean", "x_median", "d_u_mean", "d_u_std", "grad_mag_km_mean", "grad_mag_km_std"))


def moving(spark, sf):
    return pr.moving_profile(pixels(spark, sf), "vwc35", ["d_u", "grad_mag_km"], "pixel_id")


@query("w06_moving_profile", f"WITH {W06_SQL} SELECT centre, {W06_COLS} FROM mov")
def w06(spark, sf):
    return rounded(moving(spark, sf))


@query("w07_extended_profile", f"""WITH {W06_SQL} SELECT {W06_COLS} FROM mov UNION ALL SELECT {W06_COLS.replace('round(x_mean, 6)', '0.0').replace('round(x_median, 6)', '0.0')} FROM (SELECT * FROM (SELECT * FROM mov ORDER BY round(x_mean, 9), centre LIMIT 1) WHERE x_mean > 0)
 UNION ALL SELECT {W06_COLS.replace('round(x_mean, 6)', '1.0').replace('round(x_median, 6)', '1.0')} FROM (SELECT * FROM (SELECT * FROM mov ORDER BY round(x_mean, 9) DESC, centre DESC LIMIT 1) WHERE x_mean < 1)""".replace("0.0 AS", "0.0::DOUBLE AS").replace("1.0 AS", "1.0::DOUBLE AS"))
def w07(spark, sf):
    return rounded(pr.extend_to_unit(moving(spark, sf)).drop("centre"))


CURVE_SQL = f"cv AS (SELECT domain AS zone, floor({DB}) + 0.5::DOUBLE AS x, avg(d_u) AS y FROM pixels WHERE {DB} IS NOT NULL GROUP BY ALL)"


def curves(spark, sf):
    return pixels(spark, sf).where(F.col(DB).isNotNull()).groupBy(F.col("domain").alias("zone"), (F.floor(DB) + 0.5).alias("x")).agg(F.avg("d_u").alias("y"))


@query("w08_split_curve", f"""WITH {CURVE_SQL}, p AS (SELECT zone, x, y, lead(y) OVER (PARTITION BY zone ORDER BY x) AS y1, CASE zone WHEN 'pf' THEN 7.3 WHEN 'npf' THEN 0.1 ELSE 99.0 END::DOUBLE AS s FROM cv),
 j AS (SELECT zone, s AS x, y + (s - x) * (y1 - y) AS y FROM p WHERE x <= s AND x + 1 > s AND y1 IS NOT NULL)
 SELECT zone, round(x, 6) AS x, round(y, 6) AS y, CASE WHEN x < s THEN 'core' ELSE 'tail' END AS part FROM p
 UNION ALL SELECT zone, round(x, 6), round(y, 6), 'core' FROM j UNION ALL SELECT zone, round(x, 6), round(y, 6), 'tail' FROM j""")
def w08(spark, sf):
    at = F.when(F.col("zone") == "pf", 7.3).when(F.col("zone") == "npf", 0.1).otherwise(99.0)
    return rounded(pr.split_curve(curves(spark, sf), at, ["y"], ["zone"]))


@query("w09_curve_spread", f"""WITH {CURVE_SQL}, shifted AS (SELECT zone, CASE zone WHEN 'pf' THEN x + 0.25 ELSE x END AS x, y FROM cv),
 br AS (SELECT zone, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, row_number() OVER w AS i FROM shifted WINDOW w AS (PARTITION BY zone ORDER BY x)),
 pos AS (SELECT x FROM shifted WHERE zone = 'npf'),
 v AS (SELECT zone, x, y0 + (x - x0) / (x1 - x0) * (y1 - y0) AS y FROM pos JOIN br ON x >= x0 AND x < x1 UNION ALL SELECT zone, x, y0 FROM pos JOIN br ON x1 IS NULL AND x >= x0
 UNION ALL SELECT zone, x, y0 FROM pos JOIN br ON i = 1 AND x < x0), s AS (SELECT x, stddev_pop(y) AS spread, median(y) AS mid FROM v GROUP BY x)
 SELECT round(x, 6) AS x_best, round(mid, 6) AS y_best, round(spread, 6) AS spread FROM s ORDER BY s.spread LIMIT 1""")
def w09(spark, sf):
    df = curves(spark, sf).withColumn("x", F.when(F.col("zone") == "pf", F.col("x") + 0.25).otherwise(F.col("x")))
    return rounded(pr.curve_spread(df, "npf"))


@query("w10_reference_rank", """WITH r AS (SELECT pf_expert AS v FROM pixels WHERE domain = 'pf'), c AS (SELECT v, count(*) AS n FROM (SELECT v, 1 FROM r UNION ALL SELECT pf_expert, 0 FROM pixels) GROUP BY v),
 k AS (SELECT d.v, (SELECT count(*) FROM r) AS total, sum(coalesce(q.n, 0)) OVER (ORDER BY d.v) AS cum FROM (SELECT DISTINCT pf_expert AS v FROM pixels) d LEFT JOIN (SELECT v, count(*) AS n FROM r GROUP BY v) q USING (v))
 SELECT pixel_id, round(least(greatest(cum / total, 1e-5), 1 - 1e-5), 8) AS pf_rank FROM pixels JOIN k ON pf_expert = v""")
def w10(spark, sf):
    df = pixels(spark, sf).select("pixel_id", "domain", "pf_expert")
    out = pr.reference_rank(df, "pf_expert", df.where("domain = 'pf'"), "pf_expert", "pf_rank")
    return rounded(out.select("pixel_id", "pf_rank"), 8)


@query("w11_top_union", """WITH s AS (SELECT l_returnflag AS panel, p_brand AS item, avg(l_extendedprice) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
 t AS (SELECT DISTINCT item FROM (SELECT item, row_number() OVER (PARTITION BY panel ORDER BY score DESC, item) AS r FROM s) WHERE r <= 5)
 SELECT item, round(max(score), 6) AS max_score FROM s WHERE item IN (SELECT item FROM t) GROUP BY item ORDER BY max(score) DESC, item LIMIT 8""")
def w11(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    scores = li.groupBy(F.col("l_returnflag").alias("panel"), F.col("p_brand").alias("item")).agg(F.avg("l_extendedprice").alias("score"))
    return rounded(pr.top_union(scores, "panel", "item", "score"))


@query("w12_cumulative_sums", """WITH b AS (SELECT domain, l AS bin, avg(d_u) AS effect, var_samp(d_u) / count(*) AS se2 FROM (SELECT domain, CAST(floor(slope) AS BIGINT) AS l, d_u FROM pixels) GROUP BY ALL)
 SELECT domain, bin, round(effect, 6) AS effect, round(coalesce(sum(effect) OVER w, 0), 6) AS effect_before, round(coalesce(sum(se2) OVER w, 0), 8) AS se2_before FROM b
 WINDOW w AS (PARTITION BY domain ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w12(spark, sf):
    bins = pixels(spark, sf).groupBy("domain", F.floor("slope").alias("bin")).agg(
        F.avg("d_u").alias("effect"), (F.var_samp("d_u") / F.count("d_u")).alias("se2"))
    out = pr.cumulative_before(bins, "bin", ["effect", "se2"], ["domain"])
    return rounded(out.drop("se2"), 6, se2_before=8)


@query("w13_first_per_key", """SELECT "row", col, pixel_id, d_u FROM cells QUALIFY row_number() OVER (PARTITION BY "row", col ORDER BY d_u, pixel_id) = 1""")
def w13(spark, sf):
    from tailfield.operators.grid import with_cell
    return pr.first_per_key(with_cell(pixels(spark, sf)).select("row", "col", "pixel_id", "d_u"), ["row", "col"], ["d_u", "pixel_id"])


PROFILE_SQL = f"""prof AS (SELECT domain, (floor({DB} / 0.5::DOUBLE) + 0.5::DOUBLE) * 0.5::DOUBLE AS x, avg(grad_mag_km) AS y, count(*) AS n FROM pixels
 WHERE {DB} IS NOT NULL AND grad_mag_km IS NOT NULL AND domain IN ('pf', 'npf') GROUP BY ALL)"""


def domain_profile(spark, sf):
    df = pixels(spark, sf).where("domain IN ('pf', 'npf')")
    return pr.fixed_edge_profile(df, DB, "grad_mag_km", OUTWARD, ["domain"])


HINGE_SQL = f"""{PROFILE_SQL}, kn AS (SELECT a.domain, a.x AS k, count(*) AS m, avg(b.x) AS mx, avg(b.y) AS my, avg(greatest(b.x - a.x, 0)) AS mh, var_pop(b.x) AS vx, var_pop(b.y) AS vy,
 var_pop(greatest(b.x - a.x, 0)) AS vh, covar_pop(b.x, b.y) AS cxy, covar_pop(b.x, greatest(b.x - a.x, 0)) AS cxh, covar_pop(b.y, greatest(b.x - a.x, 0)) AS cyh, sum(b.n) AS np
 FROM prof a JOIN prof b ON a.domain = b.domain WHERE a.x > 1 AND a.x < 15 GROUP BY ALL),
 ft AS (SELECT *, (cxy * vh - cyh * cxh) / (vx * vh - cxh * cxh) AS b1, (cyh * vx - cxy * cxh) / (vx * vh - cxh * cxh) AS b2 FROM kn),
 bc AS (SELECT *, m * ln(vy - b1 * cxy - b2 * cyh) + 3 * ln(m) AS bic, m * ln(vy - cxy * cxy / vx) + 2 * ln(m) AS lbic FROM ft), best AS (SELECT * FROM bc QUALIFY row_number() OVER (PARTITION BY domain ORDER BY bic, k) = 1)"""


@query("f01_hinge_fit", f"""WITH {HINGE_SQL} SELECT domain, m AS n_bins, k AS fitted_elbow_km, round(b1, 6) AS slope_before, round(b1 + b2, 6) AS slope_after, round(bic, 4) AS bic FROM best""")
def f01(spark, sf):
    return rounded(fits.hinge_fit(domain_profile(spark, sf), 1.0, 15.0, ["domain"]), 6, bic=4)


@query("f02_linear_vs_hinge", f"""WITH {HINGE_SQL} SELECT domain, m AS n_bins, np::BIGINT AS n_profile_points, round(my - cxy / vx * mx, 5) AS linear_intercept, round(cxy / vx, 5) AS linear_slope, round(lbic, 4) AS linear_bic,
 k AS piecewise_break_km, round_even(k * 2, 0) / 2 AS piecewise_break_rounded_0p5_km, round_even(k, 0) AS piecewise_break_rounded_1p0_km, round(my - b1 * mx - b2 * mh, 5) AS piecewise_intercept,
 round(b1, 5) AS piecewise_slope_near, round(b1 + b2, 5) AS piecewise_slope_far, round(bic, 4) AS piecewise_bic, round(lbic - bic, 4) AS bic_improvement_vs_linear FROM best""")
def f02(spark, sf):
    out = fits.compare_linear_hinge(domain_profile(spark, sf), 1.0, 15.0, ["domain"])
    return rounded(out, 5, linear_bic=4, piecewise_bic=4, bic_improvement_vs_linear=4)


@query("f03_weighted_line", f"""WITH {PROFILE_SQL}, s AS (SELECT domain, count(*) AS n, sum(n)::DOUBLE AS w, sum(n * x) AS sx, sum(n * y) AS sy, sum(n * x * x) AS sxx, sum(n * x * y) AS sxy FROM prof GROUP BY domain)
 SELECT domain, n, round((w * sxy - sx * sy) / (w * sxx - sx * sx), 6) AS slope, round((sy - (w * sxy - sx * sy) / (w * sxx - sx * sx) * sx) / w, 6) AS intercept FROM s""")
def f03(spark, sf):
    return rounded(fits.weighted_line(domain_profile(spark, sf), "x", "mean", "n", ["domain"]))


@query("f04_two_segment_fit", f"""WITH {PROFILE_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY x) AS i, count(*) OVER (PARTITION BY domain) AS m FROM prof),
 sp AS (SELECT domain, i AS s, x AS bx, m FROM o WHERE i > 1 AND i < m),
 ln AS (SELECT sp.domain, s, bx, sp.m, side, sum(n)::DOUBLE AS w, sum(n * x) AS sx, sum(n * y) AS sy, sum(n * x * x) AS sxx, sum(n * x * y) AS sxy FROM sp JOIN o ON o.domain = sp.domain JOIN (VALUES ('l'), ('r')) v(side)
 ON (side = 'l' AND i <= s) OR (side = 'r' AND i >= s) GROUP BY ALL),
 co AS (SELECT *, (w * sxy - sx * sy) / (w * sxx - sx * sx) AS a, (sy - (w * sxy - sx * sy) / (w * sxx - sx * sx) * sx) / w AS b FROM ln),
 er AS (SELECT co.domain, s, bx, co.m, sum(n * pow(y - b - a * x, 2)) AS sse, max(a) FILTER (side = 'l') AS al, max(a) FILTER (side = 'r') AS ar FROM co JOIN o ON o.domain = co.domain AND ((side = 'l' AND i < s) OR (side = 'r' AND i >= s)) GROUP BY ALL)
 SELECT domain, m AS n, bx AS break_x, 2 AS n_segments, round(al, 5) AS slope_left, round(ar, 5) AS slope_right, round(sse, 3) AS sse FROM er QUALIFY row_number() OVER (PARTITION BY domain ORDER BY sse, s) = 1""")
def f04(spark, sf):
    return rounded(fits.two_segment_fit(domain_profile(spark, sf), "x", "mean", "n", ["domain"]), 5, sse=3)


@query("f05_fit_quality", """WITH p AS (SELECT domain, d_u AS o, -20 * pf_expert AS p FROM pixels) SELECT domain, count(*) AS n, count(*) FILTER (o BETWEEN -18 AND 2 AND p BETWEEN -18 AND 2) AS n_in,
 round(regr_slope(p, o) FILTER (o BETWEEN -18 AND 2 AND p BETWEEN -18 AND 2), 6) AS slope, round(regr_intercept(p, o) FILTER (o BETWEEN -18 AND 2 AND p BETWEEN -18 AND 2), 6) AS intercept,
 round(1 - sum(pow(o - p, 2)) / (var_pop(o) * count(*)), 6) AS r2, round(avg(abs(o - p)), 6) AS mae FROM p GROUP BY domain""")
def f05(spark, sf):
    df = pixels(spark, sf).select("domain", "d_u", (F.col("pf_expert") * -20.0).alias("p"))
    return rounded(fits.fit_quality(df, "d_u", "p", -18.0, 2.0, ["domain"]))
