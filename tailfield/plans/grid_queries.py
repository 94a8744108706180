"""Queries over cells, windows and coordinates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tailfield.constants import GRID
from tailfield.functions import geo
from tailfield.operators import grid as g
from tailfield.plans.inputs import WIDTH, basin_pixels, boundary_points, pixels
from tailfield.plans.registry import query, rounded

CELLS = 'SELECT "row", col, avg(d_u) AS v FROM cells GROUP BY "row", col'
DIMS = 'SELECT max("row") AS mr FROM cells'


def du_cells(spark, sf):
    return g.rasterise_mean(g.with_cell(pixels(spark, sf)), {"v": "d_u"})


def n_rows(spark, sf):
    """Rows of the swath as a scalar subquery."""
    row, _ = geo.cell_of("easting", "northing")
    return pixels(spark, sf).agg((F.max(row) + 1).alias("n")).scalar()


@query("g01_point_to_cell", """SELECT pixel_id, CAST(30570 - round_even((northing + 68) / 136, 0) AS BIGINT) AS "row",
 CAST(round_even((easting - 68) / 136, 0) + 14007 AS BIGINT) AS col FROM pixels""")
def g01(spark, sf):
    row, c = geo.cell_of(F.col("easting") - 68.0, F.col("northing") + 68.0)
    return pixels(spark, sf).select("pixel_id", row.alias("row"), c.alias("col"))


@query("g02_cell_to_point", """SELECT "row", col, (-14007 + col) * 136.0::DOUBLE AS x, (30570 - "row") * 136.0::DOUBLE AS y,
 count(*) AS n FROM cells GROUP BY "row", col""")
def g02(spark, sf):
    x, y = geo.centre_of("row", "col")
    return g.with_cell(pixels(spark, sf)).groupBy("row", "col").agg(F.count("*").alias("n")).select(
        "row", "col", x.alias("x"), y.alias("y"), "n")


@query("g03_grid_inference", """WITH e AS (SELECT min(d) AS s FROM (SELECT easting - lag(easting) OVER (ORDER BY easting) AS d
 FROM (SELECT DISTINCT easting FROM pixels))), n AS (SELECT min(d) AS s FROM (SELECT northing - lag(northing)
 OVER (ORDER BY northing) AS d FROM (SELECT DISTINCT northing FROM pixels))),
 b AS (SELECT min(easting) AS e0, max(easting) AS e1, min(northing) AS n0, max(northing) AS n1,
 (SELECT least((SELECT s FROM e), (SELECT s FROM n))) AS res FROM pixels)
 SELECT res, CAST(floor(e0/res) AS BIGINT) AS gx0, CAST(ceil(n1/res) AS BIGINT) AS gy1,
 CAST(ceil(n1/res) - floor(n0/res) + 1 AS BIGINT) AS nrows, CAST(ceil(e1/res) - floor(e0/res) + 1 AS BIGINT) AS ncols,
 e0 AS min_e, n1 AS max_n FROM b""")
def g03(spark, sf):
    return g.infer_grid(pixels(spark, sf))


@query("g04_in_grid", """SELECT count(*) FILTER ("row" BETWEEN 0 AND 99 AND col - 10 BETWEEN 0 AND 99) AS n_inside,
 count(*) AS n FROM cells""")
def g04(spark, sf):
    df = g.with_cell(pixels(spark, sf)).withColumn("col", F.col("col") - 10)
    return df.agg(F.count_if(geo.inside_grid("row", "col", 100, 100)).alias("n_inside"), F.count("*").alias("n"))


@query("g05_rasterise_mean", """SELECT "row", col, round(avg(d_u), 6) AS d_u, round(avg(grad_mag_km), 6) AS grad_mag_km
 FROM cells GROUP BY "row", col HAVING count(d_u) > 0 OR count(grad_mag_km) > 0""")
def g05(spark, sf):
    return rounded(g.rasterise_mean(g.with_cell(pixels(spark, sf)), {"d_u": "d_u", "grad_mag_km": "grad_mag_km"}))


@query("g06_rasterise_last", """SELECT "row", col, arg_max(CASE domain WHEN 'pf' THEN 1 WHEN 'npf' THEN 0 ELSE 255 END,
 pixel_id) AS code FROM cells GROUP BY "row", col""")
def g06(spark, sf):
    code = F.when(F.col("domain") == "pf", 1).when(F.col("domain") == "npf", 0).otherwise(255)
    return g.rasterise_last(g.with_cell(pixels(spark, sf)).withColumn("c", code), "c", "pixel_id", "code")


@query("g07_category_raster", """WITH b AS (SELECT CAST(30570 - northing / 136 AS BIGINT) AS "row",
 CAST(easting / 136 + 14007 AS BIGINT) AS col, pixel_id, coalesce("Main-Basin", 'missing') AS basin
 FROM basin_pixels WHERE domain = 'pf'), top AS (SELECT basin, row_number() OVER (ORDER BY count(*) DESC, basin) - 1 AS code
 FROM b WHERE basin <> 'missing' GROUP BY basin QUALIFY code < 3)
 SELECT "row", col, arg_max(coalesce(code, 3), pixel_id) AS code FROM b LEFT JOIN top USING (basin) GROUP BY "row", col""")
def g07(spark, sf):
    from tailfield.operators.stats import top_categories
    df = basin_pixels(spark, sf).where("domain = 'pf'").withColumn("basin", F.coalesce("Main-Basin", F.lit("missing")))
    top = top_categories(df, "basin", 3).withColumn(
        "code", (F.row_number().over(Window.orderBy(F.desc("n"), "basin")) - 1)).select("basin", "code")
    return g.category_codes(g.with_cell(df), "basin", top, "pixel_id", 3).select(
        "row", "col", F.col("code").cast("long").alias("code"))


@query("g08_decimation", f"""SELECT "row", col, round(v, 6) AS v FROM ({CELLS}) WHERE "row" % 2 = 0 AND col % 2 = 0""")
def g08(spark, sf):
    return rounded(g.decimate(du_cells(spark, sf), g.stride_for(WIDTH * 2, WIDTH, target=200)))


@query("g09_window_crop", f"""SELECT 'box' AS kind, "row", col, round(v, 6) AS v, NULL::DOUBLE AS dx_km, NULL::DOUBLE AS dy_km
 FROM ({CELLS}) WHERE "row" >= 14 AND "row" < 89 AND col >= 36 AND col < 111
 UNION ALL SELECT 'around', "row", col, round(v, 6), round(((-14007 + col) * 136.0::DOUBLE + 1898288) / 1000, 6),
 round(((30570 - "row") * 136.0::DOUBLE - 4143000) / 1000, 6) FROM ({CELLS})
 WHERE "row" BETWEEN 107 - 30 AND 107 + 30 AND col BETWEEN 49 - 30 AND 49 + 30""")
def g09(spark, sf):
    cells = du_cells(spark, sf)
    min_e, max_n = GRID["gx0"] * GRID["res"], GRID["gy1"] * GRID["res"]
    box = g.crop(cells, min_e + 5000.0, max_n - 12000.0, min_e + 15000.0, max_n - 2000.0, min_e, max_n, 10**6, WIDTH)
    around = g.crop_around(cells, -1898288.0, 4143000.0, 4000.0, 10**6, WIDTH)
    return rounded(box.withColumn("kind", F.lit("box")).unionByName(
        around.withColumn("kind", F.lit("around")), allowMissingColumns=True))


def focal_sql(size: int) -> str:
    h = size // 2
    return (f"c AS ({CELLS}), dims AS ({DIMS}), o AS (SELECT unnest(range({-h}, {h + 1})) AS d),"
            ' t AS (SELECT DISTINCT c."row" + a.d AS "row", c.col + b.d AS col FROM c, o a, o b, dims'
            f' WHERE c."row" + a.d BETWEEN 0 AND mr AND c.col + b.d BETWEEN 0 AND {WIDTH - 1}),'
            ' w AS (SELECT t."row", t.col, least(greatest(t."row" + a.d, 0), mr) AS sr,'
            f" least(greatest(t.col + b.d, 0), {WIDTH - 1}) AS sc FROM t, o a, o b, dims),"
            ' foc AS (SELECT w."row", w.col, avg(v) AS local_mean, avg(v * v) AS m2, count(*) AS n FROM w JOIN c'
            ' ON c."row" = sr AND c.col = sc GROUP BY w."row", w.col HAVING count(*) >= 3)')


@query("g10_focal_window", f"""WITH {focal_sql(5)} SELECT "row", col, round(local_mean, 9) AS local_mean,
 round(sqrt(greatest(m2 - local_mean * local_mean, 0)), 6) AS local_std, n FROM foc""")
def g10(spark, sf):
    return rounded(g.focal_stats(du_cells(spark, sf), "v", 5, n_rows(spark, sf), WIDTH), 9, local_std=6)


@query("g11_surface_gradient", f"""WITH {focal_sql(5)}, n AS (SELECT f."row", f.col, f.local_mean AS own, coalesce(u.local_mean, 0) AS u,
 coalesce(d.local_mean, 0) AS d, coalesce(l.local_mean, 0) AS l, coalesce(r.local_mean, 0) AS r, mr FROM foc f
 LEFT JOIN foc u ON u."row" = f."row" - 1 AND u.col = f.col LEFT JOIN foc d ON d."row" = f."row" + 1 AND d.col = f.col
 LEFT JOIN foc l ON l."row" = f."row" AND l.col = f.col - 1 LEFT JOIN foc r ON r."row" = f."row" AND r.col = f.col + 1, dims),
 s AS (SELECT "row", col, CASE WHEN "row" = 0 THEN (d - own) / 136 WHEN "row" = mr THEN (own - u) / 136
 ELSE (d - u) / 272 END AS gy, CASE WHEN col = 0 THEN (r - own) / 136 WHEN col = {WIDTH - 1} THEN (own - l) / 136
 ELSE (r - l) / 272 END AS gx FROM n) SELECT "row", col, round(sqrt(gx * gx + gy * gy), 8) AS gradient FROM s""")
def g11(spark, sf):
    rows = n_rows(spark, sf)
    focal = g.focal_stats(du_cells(spark, sf), "v", 5, rows, WIDTH)
    return rounded(g.surface_gradient(focal, rows, WIDTH), 8)


@query("g13_window_width", f"""WITH {focal_sql(3)} SELECT 3 AS width, count(*) AS n_cells, round(avg(local_mean), 6) AS mean FROM foc""")
def g13(spark, sf):
    width = g.neighbours_to_window(8)
    focal = g.focal_stats(du_cells(spark, sf), "v", width, n_rows(spark, sf), WIDTH)
    return rounded(focal.agg(F.lit(width).alias("width"), F.count("*").alias("n_cells"), F.avg("local_mean").alias("mean")))


@query("g14_boundary_cells", """WITH m AS (SELECT DISTINCT "row", col FROM cells WHERE domain = 'pf')
 SELECT "row", col FROM m WHERE (SELECT count(*) FROM m k WHERE (k."row" = m."row" AND abs(k.col - m.col) = 1)
 OR (k.col = m.col AND abs(k."row" - m."row") = 1)) < 4""".replace("(SELECT count(*) FROM m k WHERE (k.\"row\" = m.\"row\" AND abs(k.col - m.col) = 1)\n OR (k.col = m.col AND abs(k.\"row\" - m.\"row\") = 1)) < 4",
 '(("row" - 1, col) NOT IN (SELECT ("row", col) FROM m) OR ("row" + 1, col) NOT IN (SELECT ("row", col) FROM m)'
 ' OR ("row", col - 1) NOT IN (SELECT ("row", col) FROM m) OR ("row", col + 1) NOT IN (SELECT ("row", col) FROM m))'))
def g14(spark, sf):
    return g.boundary_cells(g.with_cell(pixels(spark, sf)).where("domain = 'pf'"))


@query("g15_nearest_resample", f"""WITH src AS (SELECT "row", col, avg(d_u) AS value FROM cells GROUP BY "row", col),
 t AS (SELECT DISTINCT "row" // 2 AS tr, col // 2 AS tc FROM cells)
 SELECT tr AS "row", tc AS col, round(value, 6) AS value FROM t LEFT JOIN src
 ON src."row" = CAST(floor((tr * 300.0::DOUBLE + 150) / 136) AS BIGINT) AND src.col = CAST(floor((tc * 300.0::DOUBLE + 150) / 136) AS BIGINT)""")
def g15(spark, sf):
    cells = g.with_cell(pixels(spark, sf))
    coarse = cells.select(F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col")).distinct()
    targets = coarse.withColumn("sx", F.col("col") * 300.0 + 150.0).withColumn("sy", -(F.col("row") * 300.0 + 150.0))
    source = g.rasterise_mean(cells, {"value": "d_u"})
    out = g.resample_nearest(targets, source, src_left=0.0, src_top=0.0, src_res_x=136.0, src_res_y=136.0)
    return rounded(out.select("row", "col", "value"))


_P = geo.AlbersParams()
_Q = (f"(1 - {_P.e2!r}::DOUBLE) * (sin(radians(latitude)) / (1 - {_P.e2!r}::DOUBLE * pow(sin(radians(latitude)), 2))"
      f" - ln((1 - {_P.e!r}::DOUBLE * sin(radians(latitude))) / (1 + {_P.e!r}::DOUBLE * sin(radians(latitude)))) / (2 * {_P.e!r}::DOUBLE))")


@query("g16_projection", f"""WITH q AS (SELECT DISTINCT longitude, latitude, {_P.a}::DOUBLE * sqrt({_P.c!r}::DOUBLE - {_P.n!r}::DOUBLE * {_Q}) / {_P.n!r}::DOUBLE AS rho,
 {_P.n!r}::DOUBLE * (radians(longitude) - {_P.lon0!r}::DOUBLE) AS theta FROM pixels)
 SELECT round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, round(rho * sin(theta), 2) AS x,
 round({_P.rho0!r}::DOUBLE - rho * cos(theta), 2) AS y, round(longitude, 6) AS lon_back, round(latitude, 6) AS lat_back FROM q""")
def g16(spark, sf):
    pts = pixels(spark, sf).select("longitude", "latitude").distinct()
    x, y = geo.albers_forward("longitude", "latitude")
    placed = pts.withColumn("x", x).withColumn("y", y)
    lon, lat = geo.albers_inverse("x", "y")
    return rounded(placed.withColumn("lon_back", lon).withColumn("lat_back", lat), 6, x=2, y=2)


@query("g17_map_tiles", """WITH b AS (SELECT domain, min(longitude) AS lon_min, max(longitude) AS lon_max, min(latitude) AS lat_min,
 max(latitude) AS lat_max FROM pixels GROUP BY domain), t AS (SELECT domain,
 unnest(range(CAST(floor((lon_min + 180) / 360 * 64) AS BIGINT), CAST(floor((lon_max + 180) / 360 * 64) AS BIGINT) + 1)) AS tile_x,
 lat_min, lat_max FROM b), u AS (SELECT domain, tile_x, unnest(range(
 CAST(floor((1 - asinh(tan(radians(lat_max))) / pi()) / 2 * 64) AS BIGINT),
 CAST(floor((1 - asinh(tan(radians(lat_min))) / pi()) / 2 * 64) AS BIGINT) + 1)) AS tile_y FROM t)
 SELECT domain, tile_x, tile_y, round(tile_x / 64.0::DOUBLE * 360 - 180, 6) AS corner_lon,
 round(degrees(atan(sinh(pi() * (1 - 2 * tile_y / 64.0::DOUBLE)))), 6) AS corner_lat FROM u""")
def g17(spark, sf):
    boxes = pixels(spark, sf).groupBy("domain").agg(
        F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"),
        F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"))
    tiles = g.covering_tiles(boxes, 6)
    lon, lat = geo.tile_corner("tile_x", "tile_y", 6)
    return rounded(tiles.select("domain", "tile_x", "tile_y", lon.alias("corner_lon"), lat.alias("corner_lat")))


@query("g18_affine_extent", """WITH m AS (SELECT avg(easting) AS me, avg(northing) AS mn, var_pop(easting) AS vee, var_pop(northing) AS vnn,
 covar_pop(easting, northing) AS ven, avg(longitude) AS mlo, covar_pop(easting, longitude) AS elo, covar_pop(northing, longitude) AS nlo,
 avg(latitude) AS mla, covar_pop(easting, latitude) AS ela, covar_pop(northing, latitude) AS nla FROM pixels),
 p(x, y) AS (VALUES (-1904952.0::DOUBLE, 4157520.0::DOUBLE), (-1872312.0::DOUBLE, 4157520.0::DOUBLE), (-1904952.0::DOUBLE, 4123520.0::DOUBLE), (-1872312.0::DOUBLE, 4123520.0::DOUBLE)),
 r AS (SELECT mlo + (elo*vnn - nlo*ven)/(vee*vnn-ven*ven)*(x-me) + (nlo*vee - elo*ven)/(vee*vnn-ven*ven)*(y-mn) AS lon,
 mla + (ela*vnn - nla*ven)/(vee*vnn-ven*ven)*(x-me) + (nla*vee - ela*ven)/(vee*vnn-ven*ven)*(y-mn) AS lat FROM m, p)
 SELECT round(min(lon), 5) AS lon_min, round(max(lon), 5) AS lon_max, round(min(lat), 5) AS lat_min, round(max(lat), 5) AS lat_max FROM r""")
def g18(spark, sf):
    corners = [(x, y) for y in (4157520.0, 4123520.0) for x in (-1904952.0, -1872312.0)]
    return rounded(g.affine_extent(pixels(spark, sf), corners, spark), 5)


def _gauss_sql(weights: list[float]) -> str:
    r = len(weights) // 2
    return "(VALUES " + ", ".join(f"({o}, {w!r}::DOUBLE)" for o, w in zip(range(-r, r + 1), weights, strict=True)) + ")"


def smooth_sql(counts: str, rows: str, cols: str, wr: list[float], wc: list[float], edge: str) -> str:
    """Brute-force window sums for the oracle: every target pulls its (clamped) sources."""
    rr, rc = len(wr) // 2, len(wc) // 2

    def src(t, o, n):
        return f"least(greatest({t} + {o}, 0), {n} - 1)" if edge == "nearest" else f"{t} + {o}"

    return (f"h AS ({counts}), kr(o, w) AS {_gauss_sql(wr)}, kc(o, w) AS {_gauss_sql(wc)},"
            f' t1 AS (SELECT DISTINCT h."row" + o AS "row", col FROM h, kr WHERE h."row" + o BETWEEN 0 AND {rows} - 1),'
            f' s1 AS (SELECT t1."row", t1.col, sum(kr.w * h.density) AS density FROM t1, kr JOIN h ON h."row" = {src("t1.row", "kr.o", rows)}'
            f" AND h.col = t1.col GROUP BY ALL),"
            f' t2 AS (SELECT DISTINCT s1."row", col + o AS col FROM s1, kc WHERE col + o BETWEEN 0 AND {cols} - 1),'
            f' s2 AS (SELECT t2."row", t2.col, sum(kc.w * s1.density) AS density FROM t2, kc JOIN s1 ON s1."row" = t2."row"'
            f" AND s1.col = {src('t2.col', 'kc.o', cols)} GROUP BY ALL)")


_W3 = g.gaussian_weights(3.0, 4.0, "half")


@query("g19_density_surface", "WITH " + smooth_sql(
    'SELECT "row", col, count(*) AS density FROM cells WHERE domain = \'pf\' AND grad_mag_km >= 38 GROUP BY ALL',
    "(SELECT max(\"row\") + 1 FROM cells)", str(WIDTH), _W3, _W3, "nearest")
    + ' SELECT "row", col, round(density / (SELECT max(density) FROM s2), 6) AS density FROM s2')
def g19(spark, sf):
    events = g.with_cell(pixels(spark, sf).where("domain = 'pf' AND grad_mag_km >= 38"))
    return rounded(g.density_surface(events, n_rows(spark, sf), WIDTH))


def _kde_weights():
    import math
    mid = math.radians(34.0)
    dx = 20.0 * sum(c * math.cos(k * mid) for k, c in geo.ZONAL_KM) / 80
    dy = 12.0 * 111.132 / 60
    return g.gaussian_weights(45.0 / dy, 3.0), g.gaussian_weights(45.0 / dx, 3.0)


@query("g20_point_density", "WITH " + smooth_sql(
    'SELECT CAST(least(floor((latitude - 28) / (12.0::DOUBLE / 60)), 59) AS BIGINT) AS "row",'
    " CAST(least(floor((longitude - 80) / (20.0::DOUBLE / 80)), 79) AS BIGINT) AS col, count(*) AS density FROM pixels"
    " WHERE domain = 'pf' AND latitude BETWEEN 28 AND 40 AND longitude BETWEEN 80 AND 100 GROUP BY ALL",
    "60", "80", *_kde_weights(), "zero")
    + ' SELECT "row", col, round(density / (SELECT max(density) FROM s2), 6) AS density FROM s2 WHERE density > 0')
def g20(spark, sf):
    return rounded(g.kde_surface(pixels(spark, sf).where("domain = 'pf'"), (80.0, 100.0), (28.0, 40.0), 80, 60, 45.0))


@query("g21_band_profile", f"""WITH c AS ({CELLS}), b AS (SELECT c.*, CASE WHEN col < 48 * 4 THEN col // 4 ELSE 48 + (col - 192) // 3 END AS band FROM c)
 SELECT band, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n,
 round(-1904952 + (CASE WHEN band < 48 THEN band * 4 + 1.5::DOUBLE ELSE 192 + (band - 48) * 3 + 1 END) * (32504.0::DOUBLE / 239), 4) AS coord
 FROM b GROUP BY band""")
def g21(spark, sf):
    prof = g.band_profile(du_cells(spark, sf), "v", "col", WIDTH, -1904952.0, -1872448.0, max_bins=64)
    return rounded(prof, 6, coord=4)


@query("g22_axis_profile", f"""SELECT 'row' AS axis, "row" AS idx, round(avg(v), 6) AS mean FROM ({CELLS}) GROUP BY "row"
 UNION ALL SELECT 'col', col, round(avg(v), 6) FROM ({CELLS}) GROUP BY col""")
def g22(spark, sf):
    cells = du_cells(spark, sf)
    parts = [g.axis_profile(cells, "v", a).select(F.lit(a).alias("axis"), F.col(a).alias("idx"), "mean") for a in ("row", "col")]
    return rounded(parts[0].unionByName(parts[1]))


@query("g23_spatial_blocks", """SELECT CASE WHEN grad_mag IS NULL THEN NULL ELSE CAST(CAST(floor(easting / 5000) AS BIGINT) AS VARCHAR)
 || '_' || CAST(CAST(floor(northing / 5000) AS BIGINT) AS VARCHAR) END AS block_id, count(*) AS n FROM pixels GROUP BY 1""")
def g23(spark, sf):
    x = F.when(F.col("grad_mag").isNotNull(), F.col("easting"))
    return pixels(spark, sf).groupBy(geo.block_id(x, "northing", 5000.0).alias("block_id")).agg(F.count("*").alias("n"))


@query("g24_extents", """WITH e AS (SELECT domain, min(easting) - 500 AS xmin, max(easting) + 500 AS xmax, min(northing) - 900 AS ymin,
 max(northing) + 900 AS ymax FROM pixels GROUP BY domain), a AS (SELECT domain, CASE WHEN (xmax - xmin) / (ymax - ymin) < 1.5
 THEN (ymax - ymin) * 1.5::DOUBLE ELSE xmax - xmin END AS w, CASE WHEN (xmax - xmin) / (ymax - ymin) < 1.5 THEN ymax - ymin
 ELSE (xmax - xmin) / 1.5::DOUBLE END AS h, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy FROM e),
 s AS (SELECT domain, least(w, 30000) AS w, least(h, 40000) AS h, cx - w / 2 AS x0, cy - h / 2 AS y0 FROM a),
 k AS (SELECT domain, w, h, least(greatest(x0, -1905000), -1875000 - w) AS x0, least(greatest(y0, 4120000), 4160000 - h) AS y0 FROM s)
 SELECT domain, round(x0, 4) AS xmin, round(x0 + w, 4) AS xmax, round(y0, 4) AS ymin, round(y0 + h, 4) AS ymax FROM k""")
def g24(spark, sf):
    box = pixels(spark, sf).groupBy("domain").agg(
        (F.min("easting") - 500.0).alias("xmin"), (F.max("easting") + 500.0).alias("xmax"),
        (F.min("northing") - 900.0).alias("ymin"), (F.max("northing") + 900.0).alias("ymax"))
    clamped = g.clamp_extent(g.expand_to_aspect(box, 1.5), F.lit(-1905000.0), F.lit(-1875000.0), F.lit(4120000.0), F.lit(4160000.0))
    return rounded(clamped, 4)


@query("g25_degree_lengths", """WITH b AS (SELECT min(latitude) AS lo, max(latitude) AS hi FROM pixels), s AS (SELECT i,
 lo + (hi - lo) * i / 1023 AS lat FROM b, (SELECT unnest(range(0, 1024)) AS i)), m AS (SELECT i, lat,
 111132.92::DOUBLE - 559.82::DOUBLE * cos(2 * radians(lat)) + 1.175::DOUBLE * cos(4 * radians(lat)) - 0.0023::DOUBLE * cos(6 * radians(lat)) AS len FROM s),
 g AS (SELECT i, lat, coalesce((len + lag(len) OVER (ORDER BY i)) / 2 * (lat - lag(lat) OVER (ORDER BY i)), 0) / 1000 AS seg FROM m),
 c AS (SELECT lat, sum(seg) OVER (ORDER BY i) AS km FROM g), p AS (SELECT lat, km, lead(lat) OVER (ORDER BY km) AS lat2, lead(km) OVER (ORDER BY km) AS km2 FROM c),
 t AS (SELECT k AS tick, (SELECT max(km) FROM c) * k / 3 AS target FROM (SELECT unnest(range(0, 4)) AS k))
 SELECT tick, round(target, 4) AS km, round(CASE WHEN km2 IS NULL THEN lat ELSE lat + (lat2 - lat) * (target - km) / (km2 - km) END, 6) AS lat,
 round(111.41288::DOUBLE * cos(radians(lat)) - 0.0935::DOUBLE * cos(3 * radians(lat)) + 0.00012::DOUBLE * cos(5 * radians(lat)), 3) AS zonal_km
 FROM t JOIN p ON target >= km AND (target < km2 OR km2 IS NULL)""")
def g25(spark, sf):
    from tailfield.operators.profiles import meridional_ticks
    bounds = pixels(spark, sf).agg(F.min("latitude").alias("lo"), F.max("latitude").alias("hi"))
    ticks = meridional_ticks(bounds, 4)
    return rounded(ticks.withColumn("zonal_km", geo.zonal_degree_km("node_lat")).drop("node_lat"), 6, km=4, zonal_km=3)


@query("g26_sample_layers", """WITH layer AS (SELECT "row", col, avg(d_u) AS mean_du, max(grad_mag_km) AS max_grad FROM cells
 WHERE domain = 'pf' GROUP BY "row", col), p AS (SELECT point_id, CAST(30570 - y / 136 AS BIGINT) AS "row", CAST(x / 136 + 14007 AS BIGINT) AS col FROM boundary_points)
 SELECT point_id, round(mean_du, 6) AS mean_du, round(max_grad, 6) AS max_grad FROM p LEFT JOIN layer USING ("row", col)""")
def g26(spark, sf):
    cells = g.with_cell(pixels(spark, sf).where("domain = 'pf'")).groupBy("row", "col").agg(
        F.avg("d_u").alias("mean_du"), F.max("grad_mag_km").alias("max_grad"))
    pts = boundary_points(spark, sf)
    return rounded(g.sample_cells(pts, cells, ["mean_du", "max_grad"], x="x", y="y").select("point_id", "mean_du", "max_grad"))
