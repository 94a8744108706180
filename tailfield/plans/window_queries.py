"""Queries over windows of interest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailfield.operators import windows as wi
from tailfield.operators.relational import analysis_zone
from tailfield.operators.spatial import edges_of
from tailfield.plans.inputs import boundary_points, line_vertices, pixels, squares
from tailfield.plans.label_queries import ANALYSIS_ZONE_SQL
from tailfield.plans.registry import query, rounded

CELL = 6000.0
HOT = "CAST(coalesce(d_u <= -16.5, false) OR coalesce(grad_mag_km >= 30.5, false) AS INTEGER)"
BASE = f"2.5::DOUBLE * {HOT} + greatest(-d_u, 0) / 20 + greatest(coalesce(grad_mag_km, 0), 0) / 30"
BONUS = {
    "transition": "least(greatest(5 - coalesce(boundary_distance_km, 999), 0), 5) / 5",
    "near_tl": "least(greatest(2 - coalesce(tl_distance_km, 999), 0), 2) / 2",
    "near_rts": "least(greatest(2 - coalesce(rts_distance_km, 999), 0), 2) / 2",
    "interior": "least(greatest(coalesce(boundary_distance_km, 999), 5), 20) / 20 + least(greatest(coalesce(tlrts_distance_km, 999), 2), 10) / 20",
}
KEEP = {
    "transition": "az = 'pf_frontal_iso'", "interior": "az = 'pf_background'",
    "near_tl": "az IN ('pf_abrupt_iso', 'pf_overlap') AND tl_distance_km <= rts_distance_km",
    "near_rts": "az IN ('pf_abrupt_iso', 'pf_overlap') AND rts_distance_km < tl_distance_km",
}
ZONED = f"zp AS (SELECT *, {ANALYSIS_ZONE_SQL} AS az FROM pixels)"


def zoned(spark, sf):
    return pixels(spark, sf).withColumn("analysis_zone", analysis_zone())


def candidates_sql(kind: str) -> str:
    return (f"SELECT CAST(floor(easting / {CELL}) AS BIGINT) AS cell_x, CAST(floor(northing / {CELL}) AS BIGINT) AS cell_y, quantile_cont(easting, 0.5) AS center_easting,"
            f" quantile_cont(northing, 0.5) AS center_northing, count(*) AS n_points, CAST(sum({HOT}) AS BIGINT) AS n_hotspots, avg({BASE} + {BONUS[kind]}) AS mean_score,"
            f" max({BASE} + {BONUS[kind]}) AS max_score FROM zp WHERE {KEEP[kind]} GROUP BY 1, 2")


@query("z01_candidate_scores", f"WITH {ZONED} " + " UNION ALL ".join(
    f"SELECT '{k}' AS kind, cell_x, cell_y, center_easting, center_northing, n_points, n_hotspots, round(mean_score, 6) AS mean_score, round(max_score, 6) AS max_score FROM ({candidates_sql(k)})"
    for k in ("transition", "near_tl", "near_rts", "interior")))
def z01(spark, sf):
    out, df = None, zoned(spark, sf)
    for kind in ("transition", "near_tl", "near_rts", "interior"):
        part = wi.score_candidates(df, kind, CELL).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


def tiles_of(spark, sf):
    half = F.lit(3500.0) + (F.col("point_id") % 5) * 500.0
    return boundary_points(spark, sf).select(
        F.concat(F.lit("tile"), F.col("point_id")).alias("tile"), (F.col("x") - half).alias("xmin"), (F.col("x") + half).alias("xmax"),
        (F.col("y") - half).alias("ymin"), (F.col("y") + half).alias("ymax"))


TILES = """tl AS (SELECT 'tile' || point_id AS tile, x - 3500 - (point_id % 5) * 500 AS txmin, x + 3500 + (point_id % 5) * 500 AS txmax,
 y - 3500 - (point_id % 5) * 500 AS tymin, y + 3500 + (point_id % 5) * 500 AS tymax FROM boundary_points)"""


def pick_sql(kinds: list[str], window: float, spacing: float) -> str:
    parts = [ZONED, TILES]
    for i, kind in enumerate(kinds):
        h = window * 500
        far = " AND ".join(f"pow(center_easting - (SELECT center_easting FROM pk{j}), 2) + pow(center_northing - (SELECT center_northing FROM pk{j}), 2) >= {(spacing * 1000) ** 2}::DOUBLE"
                           for j in range(i)) or "true"
        parts.append(f"""cd{i} AS ({candidates_sql(kind)}), cv{i} AS (SELECT cell_x, cell_y, tile, (least(center_easting + {h}, txmax) - greatest(center_easting - {h}, txmin)) * (least(center_northing + {h}, tymax)
 - greatest(center_northing - {h}, tymin)) / {(2 * h) ** 2}::DOUBLE AS cover, CAST(center_easting BETWEEN txmin AND txmax AND center_northing BETWEEN tymin AND tymax AS INT) AS c, -(txmax - txmin) * (tymax - tymin) AS a
 FROM cd{i} JOIN tl ON least(center_easting + {h}, txmax) > greatest(center_easting - {h}, txmin) AND least(center_northing + {h}, tymax) > greatest(center_northing - {h}, tymin)),
 bc{i} AS (SELECT * FROM cv{i} QUALIFY row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY cover DESC, c DESC, a DESC, tile DESC) = 1),
 pk{i} AS (SELECT '{kind}' AS window_key, cd{i}.*, coalesce(tile, '') AS tile, coalesce(cover, 0) AS cover FROM cd{i} LEFT JOIN bc{i} USING (cell_x, cell_y)
 ORDER BY CASE WHEN {far} AND coalesce(cover, 0) >= 0.75 THEN 0 WHEN {far} THEN 1 WHEN coalesce(cover, 0) >= 0.75 THEN 2 ELSE 3 END, n_hotspots DESC, mean_score DESC, n_points DESC, max_score DESC, cell_x || '_' || cell_y LIMIT 1)""")
    body = " UNION ALL ".join(
        f"SELECT window_key, center_easting AS center_easting_m, center_northing AS center_northing_m, n_points, n_hotspots, round(mean_score, 6) AS mean_score, tile, round(cover, 6) AS cover FROM pk{i}"
        for i in range(len(kinds)))
    return "WITH " + ", ".join(parts) + " " + body


@query("z02_spaced_pick", pick_sql(["transition", "near_tl", "interior"], 6.0, 9.0))
def z02(spark, sf):
    out = wi.windows_per_kind(zoned(spark, sf), ["transition", "near_tl", "interior"], window_km=6.0, spacing_km=9.0, cell_m=CELL, tiles=tiles_of(spark, sf))
    return rounded(out)


def _zoom_sql() -> str:
    picks = []
    for i in range(3):
        far = " AND ".join(f"pow(x - (SELECT x FROM p{j}), 2) + pow(y - (SELECT y FROM p{j}), 2) >= 25000000" for j in range(i)) or "true"
        picks.append(f"p{i} AS (SELECT {i + 1} AS pick, * FROM ok WHERE {far} ORDER BY s DESC, g DESC, x, y LIMIT 1)")
    return f"""WITH pp AS (SELECT "row", col, pf_expert AS s, grad_mag_km AS g, CAST(d_u <= -16.5 AS INT) AS h FROM (SELECT *, CAST(30570 - northing / 136 AS BIGINT) AS "row", CAST(easting / 136 + 14007 AS BIGINT) AS col FROM pixels WHERE domain = 'pf')),
 ce AS (SELECT "row", col, count(*) AS n, sum(h) AS h, sum(s) AS s, max(s) AS m FROM pp GROUP BY ALL),
 ctr AS (SELECT "row", col, s, coalesce(g, -1) AS g FROM pp QUALIFY row_number() OVER (PARTITION BY "row", col ORDER BY s DESC, g DESC NULLS LAST) = 1),
 ex AS (SELECT "row", col, unnest(range("row" - 14, "row" + 15)) AS r2 FROM ctr), st AS (SELECT ex."row", ex.col, sum(n) AS n_points, sum(h) AS n_hotspots, sum(s) / sum(n) AS mean_score, max(m) AS max_score
 FROM ex JOIN ce ON ce."row" = r2 WHERE abs(ce.col - ex.col) <= 14 GROUP BY ALL),
 ok AS (SELECT (-14007 + col) * 136.0::DOUBLE AS x, (30570 - "row") * 136.0::DOUBLE AS y, s, g, n_points, n_hotspots, mean_score, max_score FROM st JOIN ctr USING ("row", col) WHERE n_points >= 100 AND n_hotspots >= 10),
 {', '.join(picks)}
 SELECT pick, x AS easting, y AS northing, CAST(n_points AS BIGINT) AS n_points, CAST(n_hotspots AS BIGINT) AS n_hotspots, round(mean_score, 6) AS mean_score, round(max_score, 6) AS max_score, x - 1904 AS xmin, x + 1904 AS xmax, y - 1904 AS ymin, y + 1904 AS ymax,
 round(n_hotspots / n_points, 6) AS hotspot_fraction FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)"""


@query("z03_zoom_windows", _zoom_sql())
def z03(spark, sf):
    df = pixels(spark, sf).where("domain = 'pf'").withColumn("hot", (F.col("d_u") <= -16.5).cast("int"))
    out = wi.zoom_windows(df, n=3, half=1904.0, spacing=5000.0, min_points=100, min_hotspots=10, score="pf_expert", hot="hot", second="grad_mag_km")
    return rounded(out)


SPECS = [
    ("w1", "Transition", "transition", -1895000.0, 4150000.0, 6.0, "tile3"),
    ("w2", "Near lake", "near_tl", -1885000.0, 4146000.0, 5.0, "tile7"),
    ("w3", "Near slump", "near_rts", -1890000.0, 4154000.0, 4.0, "tile1"),
    ("w4", "Interior", "interior", -1880000.0, 4152000.0, 6.0, "tile999999999"),
    ("w5", "Empty", "interior", 0.0, 0.0, 6.0, ""),
]


def _fixed_sql() -> str:
    rows = ", ".join(f"('{k}', '{n}', '{kind}', {x}::DOUBLE, {y}::DOUBLE, {s}::DOUBLE, '{t}')" for k, n, kind, x, y, s, t in SPECS)
    keep = " OR ".join(f"(kind = '{k}' AND {c})" for k, c in KEEP.items())
    return f"""WITH {ZONED}, {TILES}, sp(window_key, window_label, kind, x, y, s, tile) AS (VALUES {rows}),
 ct AS (SELECT window_key, count(*) AS n_points, CAST(sum({HOT}) AS BIGINT) AS n_hotspots, avg({BASE}) AS mean_score FROM sp JOIN zp ON easting BETWEEN x - s * 500 AND x + s * 500 AND northing BETWEEN y - s * 500 AND y + s * 500
 WHERE {keep} GROUP BY window_key)
 SELECT window_key, window_label, x AS center_easting_m, y AS center_northing_m, s AS window_size_km, coalesce(n_points, 0) AS n_points, coalesce(n_hotspots, 0) AS n_hotspots, round(mean_score, 6) AS mean_score, tile,
 round(CASE WHEN txmin IS NULL THEN 0 ELSE greatest(least(x + s * 500, txmax) - greatest(x - s * 500, txmin), 0) * greatest(least(y + s * 500, tymax) - greatest(y - s * 500, tymin), 0) / pow(s * 1000, 2) END, 6) AS cover
 FROM sp LEFT JOIN ct USING (window_key) LEFT JOIN tl USING (tile)"""


@query("z04_fixed_windows", _fixed_sql())
def z04(spark, sf):
    return rounded(wi.fixed_windows(spark, zoned(spark, sf), SPECS, tiles_of(spark, sf)))


EXTENT = (-1904952.0, -1872448.0, 4123656.0, 4157520.0)


def _focus_sql() -> str:
    xmin, xmax, ymin, ymax = EXTENT
    w, h = (xmax - xmin) * 0.28, (ymax - ymin) * 0.28
    sx, sy = max(1500.0, 0.18 * w), max(1500.0, 0.18 * h)
    xs = [min(xmax, v + w) - w for v in wi._starts(xmin, max(xmin, xmax - w) + sx * 0.5, sx)]
    ys = [min(ymax, v + h) - h for v in wi._starts(ymin, max(ymin, ymax - h) + sy * 0.5, sy)]
    xv = ", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(xs))
    yv = ", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(ys))
    slab = "greatest({z}, least((b{a}0 - {a}1) / nullif({a}2 - {a}1, 0), (b{a}1 - {a}1) / nullif({a}2 - {a}1, 0)))"
    lo = f"greatest(coalesce({slab.format(a='x', z=0)}, 0), coalesce({slab.format(a='y', z=0)}, 0))"
    hi = "least(1, coalesce(greatest((bx0 - x1) / nullif(x2 - x1, 0), (bx1 - x1) / nullif(x2 - x1, 0)), 1), coalesce(greatest((by0 - y1) / nullif(y2 - y1, 0), (by1 - y1) / nullif(y2 - y1, 0)), 1))"
    return f"""WITH cx(ix, bx0) AS (VALUES {xv}), cy(iy, by0) AS (VALUES {yv}), bx AS (SELECT ix, iy, bx0, bx0 + {w!r}::DOUBLE AS bx1, by0, by0 + {h!r}::DOUBLE AS by1 FROM cx, cy),
 ct AS (SELECT ix, iy, count(feature_id) AS n FROM bx LEFT JOIN (SELECT * FROM squares WHERE kind = 'lake') ON cx BETWEEN bx0 AND bx1 AND cy BETWEEN by0 AND by1 GROUP BY ALL),
 ht AS (SELECT DISTINCT ix, iy FROM bx, line_edges WHERE greatest(x1, x2) >= bx0 AND least(x1, x2) <= bx1 AND greatest(y1, y2) >= by0 AND least(y1, y2) <= by1 AND {lo} <= {hi})
 SELECT round(bx0, 4) AS xmin, round(bx1, 4) AS xmax, round(by0, 4) AS ymin, round(by1, 4) AS ymax, (n + CASE WHEN ht.ix IS NULL THEN 0 ELSE 6 END)::DOUBLE AS score
 FROM bx JOIN ct USING (ix, iy) LEFT JOIN ht USING (ix, iy) ORDER BY score DESC, ix, iy LIMIT 1"""


@query("z05_window_search", _focus_sql())
def z05(spark, sf):
    lakes = squares(spark, sf).where("kind = 'lake'").select(F.col("cx").alias("x"), F.col("cy").alias("y"))
    return rounded(wi.search_focus(lakes, edges_of(line_vertices(spark, sf)), EXTENT, 0.28, 6.0), 4)


@query("z06_window_with_both", """WITH b AS (SELECT min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1 FROM squares),
 xs AS (SELECT unnest(range(0, CAST(ceil((x1 + 2000 - x0) / 2000) AS BIGINT))) AS ix, x0 FROM b), ys AS (SELECT unnest(range(0, CAST(ceil((y1 + 2000 - y0) / 2000) AS BIGINT))) AS iy, y0 FROM b),
 s AS (SELECT ix, iy, x0 + ix * 2000 AS wx, y0 + iy * 2000 AS wy, count(*) FILTER (kind = 'lake') AS lakes, count(*) FILTER (kind = 'slump') AS slumps FROM xs, ys JOIN squares ON cx BETWEEN x0 + ix * 2000 AND x0 + ix * 2000 + 9000
 AND cy BETWEEN y0 + iy * 2000 AND y0 + iy * 2000 + 12000 GROUP BY ALL)
 SELECT wx - 2500 AS xmin, wx + 9000 + 2500 AS xmax, wy - 3000 AS ymin, wy + 12000 + 3000 AS ymax, lakes, slumps, lakes + 12 * slumps AS score FROM s WHERE lakes > 0 AND slumps > 0 ORDER BY score DESC, ix, iy LIMIT 1""".replace(
    "FROM xs, ys JOIN squares ON cx", "FROM xs CROSS JOIN ys JOIN squares ON cx"))
def z06(spark, sf):
    sq = squares(spark, sf).select("kind", F.col("cx").alias("x"), F.col("cy").alias("y"))
    b = sq.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    out = wi.window_with_both(sq.where("kind = 'lake'"), sq.where("kind = 'slump'"), tuple(b), width=9000.0, height=12000.0, step=2000.0)
    return rounded(out)


# Share of the way to the points' centre, share of the height upwards, and bonus of a crossing line, per kind.
CROPS = {"lake": (0.10, 0.0, 6.0), "slump": (0.25, 0.18, 0.0)}
SHARE = 0.28


def _crop_sql(kind: str) -> str:
    nudge, lift, bonus = CROPS[kind]
    slab = "least(({a}lo - {p}1) / nullif({p}2 - {p}1, 0), ({a}hi - {p}1) / nullif({p}2 - {p}1, 0))"
    t0 = "greatest(0, " + ", ".join(f"coalesce({slab.format(a=a, p=p)}, 0)" for a, p in (("bx", "x"), ("by", "y"))) + ")"
    t1 = "least(1, " + ", ".join(f"coalesce({slab.format(a=a, p=p).replace('least(', 'greatest(')}, 1)" for a, p in (("bx", "x"), ("by", "y"))) + ")"
    axis = lambda z, i, w: (f"SELECT {i}, least({z}max, {z}min + {i} * s{z} + {w}) - {w} AS b{z}lo, least({z}max, {z}min + {i} * s{z} + {w}) AS b{z}hi "  # noqa: E731
                            f"FROM (SELECT *, unnest(range(0, CAST(greatest(0, ceil((greatest({z}min, {z}max - {w}) + s{z} * 0.5::DOUBLE - {z}min) / s{z})) AS BIGINT))) AS {i} FROM ex)")
    return f"""WITH b0 AS (SELECT min(cx) AS xmin, max(cx) AS xmax, min(cy) AS ymin, max(cy) AS ymax FROM squares), b1 AS (SELECT *, (xmax - xmin) * {SHARE}::DOUBLE AS w, (ymax - ymin) * {SHARE}::DOUBLE AS h FROM b0),
 ex AS (SELECT *, greatest(1500, 0.18::DOUBLE * w) AS sx, greatest(1500, 0.18::DOUBLE * h) AS sy FROM b1), pt AS (SELECT cx, cy FROM squares WHERE kind = '{kind}'),
 ax AS ({axis('x', 'ix', 'w')}), ay AS ({axis('y', 'iy', 'h')}), bx AS (SELECT * FROM ax, ay),
 ct AS (SELECT ix, iy, count(cx) AS n FROM bx LEFT JOIN pt ON cx BETWEEN bxlo AND bxhi AND cy BETWEEN bylo AND byhi GROUP BY ALL),
 ht AS (SELECT DISTINCT ix, iy FROM bx, line_edges WHERE greatest(x1, x2) >= bxlo AND least(x1, x2) <= bxhi AND greatest(y1, y2) >= bylo AND least(y1, y2) <= byhi AND {t0} <= {t1}),
 be AS (SELECT bx.*, n + CASE WHEN ht.ix IS NULL THEN 0 ELSE {bonus} END::DOUBLE AS score FROM bx JOIN ct USING (ix, iy) LEFT JOIN ht USING (ix, iy) ORDER BY score DESC, ix, iy LIMIT 1),
 ce AS (SELECT (min(cx) + max(cx)) / 2 AS px, (min(cy) + max(cy)) / 2 AS py FROM pt),
 mo AS (SELECT score, w, h, greatest(bxlo + {nudge}::DOUBLE * (px - (bxlo + bxhi) / 2), xmin) AS x0, greatest(bylo + {nudge}::DOUBLE * (py - (bylo + byhi) / 2) + {lift}::DOUBLE * h, ymin) AS y0, xmax, ymax FROM be, ce, ex),
 cl AS (SELECT score, w, h, least(x0, xmax - w) AS x0, least(y0, ymax - h) AS y0 FROM mo)
 SELECT '{kind}' AS kind, round(x0, 4) AS xmin, round(x0 + w, 4) AS xmax, round(y0, 4) AS ymin, round(y0 + h, 4) AS ymax, score FROM cl"""


def _cropped(spark, sf, kind):
    """Search over the extent of all squares, then the crop."""
    nudge, lift, bonus = CROPS[kind]
    sq = squares(spark, sf).select("kind", F.col("cx").alias("x"), F.col("cy").alias("y"))
    extent = tuple(float(v) for v in sq.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first())
    points = sq.where(F.col("kind") == kind)
    focus = wi.search_focus(points, edges_of(line_vertices(spark, sf)), extent, SHARE, bonus)
    return rounded(wi.crop_after_search(focus, points, extent, nudge, lift).select(F.lit(kind).alias("kind"), "*"), 4)


@query("z05_lake_crop", _crop_sql("lake"))
def z05_lake(spark, sf):
    return _cropped(spark, sf, "lake")


@query("z05_slump_crop", _crop_sql("slump"))
def z05_slump(spark, sf):
    return _cropped(spark, sf, "slump")
