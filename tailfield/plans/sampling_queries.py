"""Queries over samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailfield.functions.geo import block_id
from tailfield.functions.labels import extreme_flag, extreme_label
from tailfield.operators import sampling as sa
from tailfield.plans.inputs import pixels
from tailfield.plans.registry import query, rounded

COLS = ["pixel_id", "domain", "d_u", "grad_mag_km"]
BLOCK = 2500.0


def blocked(spark, sf):
    df = pixels(spark, sf).where("domain IN ('pf', 'npf')")
    return df.select(*COLS, block_id("easting", "northing", BLOCK).alias("block_id"), extreme_label("d_u").alias("label"))


BLOCKED = f"""bl AS (SELECT pixel_id, domain, d_u, label, CAST(floor(easting / {BLOCK}) AS BIGINT) || '_' || CAST(floor(northing / {BLOCK}) AS BIGINT) AS block_id
 FROM labelled WHERE domain IN ('pf', 'npf'))"""


@query("x01_stratified_sample", """SELECT pixel_id, domain, d_u FROM pixels WHERE d_u < 0
 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY md5(pixel_id || '7'), pixel_id) <= 4000""")
def x01(spark, sf):
    rows = pixels(spark, sf).where("d_u < 0").select("pixel_id", "domain", "d_u")
    return sa.smallest_keys(rows, 4000, "pixel_id", ["domain"], "7")


@query("x02_two_pass_sample", """WITH c AS (SELECT domain, count(*) AS n FROM pixels GROUP BY domain),
 d AS (SELECT pixel_id, domain FROM pixels JOIN c USING (domain) WHERE CAST('0x' || substr(md5(pixel_id || '7|draw'), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496 < least(1, 1.15 * 5000 / n))
 SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY domain ORDER BY md5(pixel_id || '7'), pixel_id) <= 5000""")
def x02(spark, sf):
    return sa.two_pass_sample(pixels(spark, sf).select("pixel_id", "domain"), 5000, "pixel_id", ["domain"], "7")


@query("x03_label_downsample", """WITH f AS (SELECT pixel_id, coalesce(d_u <= -16.5, false) AS y FROM pixels WHERE domain = 'pf'), c AS (SELECT count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM f),
 t AS (SELECT least(p, greatest(least(500, p), CAST(round_even(3500 * p / (p + q)::DOUBLE, 0) AS BIGINT))) AS pt, q FROM c)
 SELECT pixel_id, y FROM f, t QUALIFY row_number() OVER (PARTITION BY y ORDER BY md5(pixel_id || '0'), pixel_id) <= CASE WHEN y THEN pt ELSE least(q, 3500 - pt) END""")
def x03(spark, sf):
    rows = pixels(spark, sf).where("domain = 'pf'").select("pixel_id", extreme_flag("d_u").alias("y"))
    return sa.downsample_by_label(rows, F.col("y"), 3500, "pixel_id")


@query("x04_uniform_cap", "SELECT pixel_id, d_u FROM pixels ORDER BY md5(pixel_id || 'cap'), pixel_id LIMIT 3000")
def x04(spark, sf):
    return sa.smallest_keys(pixels(spark, sf).select("pixel_id", "d_u"), 3000, "pixel_id", salt="cap")


def holdout_sql(source: str, test: float, seed: int, tries: int, tag: str, per_domain: bool) -> str:
    """CTEs that choose the held-out blocks of ``source``; the result is ``held_<tag>(block_id, held)``."""
    dom = "domain" if per_domain else "'all'"
    floor = 200 if per_domain else 1
    return f"""cn_{tag} AS (SELECT block_id, {dom} AS d, count(*) AS n, sum(label) AS p FROM {source} GROUP BY ALL),
 tr_{tag} AS (SELECT block_id, t, row_number() OVER (PARTITION BY t ORDER BY md5(block_id || '|' || t), block_id) <= ceil({test!r}::DOUBLE * (SELECT count(DISTINCT block_id) FROM cn_{tag})) AS held
 FROM (SELECT DISTINCT block_id FROM cn_{tag}), (SELECT unnest(range({seed}, {seed + tries})) AS t)),
 sd_{tag} AS (SELECT t, d, sum(n) FILTER (held) AS nt, sum(p) FILTER (held) AS pt, sum(n) FILTER (NOT held) AS nr, sum(p) FILTER (NOT held) AS pr FROM cn_{tag} JOIN tr_{tag} USING (block_id) GROUP BY ALL),
 jd_{tag} AS (SELECT t, bool_and(coalesce(nt >= {floor} AND pt > 0 AND pt < nt AND nr >= {floor} AND pr > 0 AND pr < nr, false)) AS ok, abs(sum(coalesce(nt, 0)) - {test!r}::DOUBLE * sum(coalesce(nt, 0) + coalesce(nr, 0))) AS score,
 sum(coalesce(nt, 0) + coalesce(nr, 0)) AS n FROM sd_{tag} GROUP BY t),
 ch_{tag} AS (SELECT t FROM jd_{tag} WHERE ok ORDER BY CASE WHEN score <= 0.01::DOUBLE * n THEN 0 ELSE 1 END, CASE WHEN score <= 0.01::DOUBLE * n THEN 0 ELSE score END, t LIMIT 1),
 held_{tag} AS (SELECT block_id, held FROM tr_{tag} JOIN ch_{tag} USING (t))"""


@query("x05_blocked_holdout", f"""WITH {BLOCKED}, {holdout_sql('bl', 0.2, 42, 64, 'a', False)}
 SELECT CASE WHEN held THEN 'test' ELSE 'train' END AS split, block_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM bl JOIN held_a USING (block_id) GROUP BY ALL""")
def x05(spark, sf):
    return sa.blocked_holdout(blocked(spark, sf), test=0.2).groupBy("split", "block_id").agg(
        F.count("*").alias("n"), F.sum("label").alias("positives"))


@query("x06_three_way_split", f"""WITH {BLOCKED}, {holdout_sql('bl', 0.4, 42, 128, 'a', True)}, ho AS (SELECT bl.* FROM bl JOIN held_a USING (block_id) WHERE held),
 {holdout_sql('ho', 0.5, 1042, 128, 'b', True)}
 SELECT CASE WHEN NOT a.held THEN 'train' WHEN NOT b.held THEN 'calibration' ELSE 'test' END AS split, domain, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives
 FROM bl JOIN held_a a USING (block_id) LEFT JOIN held_b b USING (block_id) GROUP BY ALL""")
def x06(spark, sf):
    out = sa.three_way_split(blocked(spark, sf), domain="domain")
    return out.groupBy("split", "domain").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


@query("x07_group_folds", f"""WITH RECURSIVE {BLOCKED}, sz AS (SELECT block_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, block_id) AS i FROM bl GROUP BY block_id),
 gr(i, loads, fold) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], -1 UNION ALL
 SELECT sz.i, list_transform(loads, lambda v, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN v + n ELSE v END), (list_position(loads, list_min(loads)) - 1)::INTEGER FROM gr JOIN sz ON sz.i = gr.i + 1)
 SELECT sz.block_id, fold, n FROM gr JOIN sz USING (i)""")
def x07(spark, sf):
    return sa.group_folds(blocked(spark, sf), 5).groupBy("block_id", "fold").agg(F.count("*").alias("n"))


@query("x08_random_split", """SELECT CASE WHEN CAST('0x' || substr(md5(pixel_id || '3'), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496 < 0.25 THEN 'test' ELSE 'train' END AS split, domain, count(*) AS n,
 round(avg(d_u), 6) AS mean_du FROM pixels GROUP BY ALL""")
def x08(spark, sf):
    return rounded(sa.random_split(pixels(spark, sf), "pixel_id", 0.25, "3").groupBy("split", "domain").agg(
        F.count("*").alias("n"), F.avg("d_u").alias("mean_du")))
