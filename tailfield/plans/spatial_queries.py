"""Queries over joins: by cell, by distance, by range and by containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailfield.operators import grid as g
from tailfield.operators import spatial as sp
from tailfield.plans.inputs import boundary_points, line_vertices, pixels, polygon_edges, squares, table
from tailfield.plans.registry import query, rounded

WIDTHS = [2.0, 4.0, 8.0]
SEG_T = ("CASE WHEN (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) > 0 THEN least(greatest(((px-x1)*(x2-x1)+(py-y1)*(y2-y1))"
         "/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)), 0), 1) ELSE 0 END")
SEG_D2 = f"pow(px - (x1 + {SEG_T} * (x2-x1)), 2) + pow(py - (y1 + {SEG_T} * (y2-y1)), 2)"


KNN_SQL = """pc AS (SELECT "row", col, pixel_id, d_u, magt, easting, northing FROM (SELECT *, CAST(30570 - northing / 136 AS BIGINT) AS "row", CAST(easting / 136 + 14007 AS BIGINT) AS col FROM pixels)),
 ps AS (SELECT "row", col, unnest(range("row" - 9, "row" + 10)) AS r2 FROM (SELECT DISTINCT "row", col FROM pc)),
 nb AS (SELECT ps."row", ps.col, (pc.col - ps.col) * 136.0::DOUBLE AS dx, (ps."row" - pc."row") * 136.0::DOUBLE AS dy, pc.pixel_id AS nid, pc.d_u AS nd, pc.magt AS nm FROM ps JOIN pc ON pc."row" = r2 AND abs(pc.col - ps.col) <= 9
 QUALIFY row_number() OVER (PARTITION BY ps."row", ps.col ORDER BY dx * dx + dy * dy, pc.pixel_id) <= 21)"""


def _contrast_sql(z: str, nz: str, name: str) -> str:
    """Plane-fit and deviation terms of one variable over the neighbours of each row."""
    return (f"stddev_pop({nz}) AS sd_{name}, count({nz}) AS n_{name}, sum(dx * dx) FILTER ({nz} IS NOT NULL) AS xx_{name}, sum(dy * dy) FILTER ({nz} IS NOT NULL) AS yy_{name},"
            f" sum(dx * dy) FILTER ({nz} IS NOT NULL) AS xy_{name}, sum(dx * ({nz} - {z})) AS xz_{name}, sum(dy * ({nz} - {z})) AS yz_{name}")


def _contrast_out(z: str, name: str) -> str:
    det = f"(xx_{name} * yy_{name} - xy_{name} * xy_{name})"
    return (f"CASE WHEN {z} IS NOT NULL THEN round(sd_{name}, 6) END AS {name}__lstd, CASE WHEN {z} IS NOT NULL AND n_{name} >= 5 AND abs({det}) > 1e-12 THEN"
            f" round(sqrt(pow((xz_{name} * yy_{name} - yz_{name} * xy_{name}) / {det}, 2) + pow((yz_{name} * xx_{name} - xz_{name} * xy_{name}) / {det}, 2)), 6) END AS {name}__gmag")


_G12_SQL = (f"WITH {KNN_SQL}, sm AS (SELECT pc.pixel_id, pc.d_u, pc.magt, {_contrast_sql('pc.d_u', 'nd', 'd_u')}, {_contrast_sql('pc.magt', 'nm', 'magt')} FROM pc JOIN nb USING (\"row\", col)"
            f" GROUP BY pc.pixel_id, pc.d_u, pc.magt) SELECT pixel_id, {_contrast_out('d_u', 'd_u')}, {_contrast_out('magt', 'magt')} FROM sm")


@query("g12_local_contrast", _G12_SQL)
def g12(spark, sf):
    df = pixels(spark, sf).select("pixel_id", "easting", "northing", "d_u", "magt")
    out = sp.local_contrast(df, ["d_u", "magt"], k=21)
    return rounded(out.select("pixel_id", "d_u__lstd", "d_u__gmag", "magt__lstd", "magt__gmag"))


@query("j01_cell_equi_join", """WITH l AS (SELECT "row", col, avg(d_u) AS mean_du FROM cells GROUP BY "row", col)
 SELECT domain, count(*) AS n, round(avg(abs(d_u - mean_du)), 6) AS mad FROM cells JOIN l USING ("row", col) GROUP BY domain""")
def j01(spark, sf):
    cells = g.with_cell(pixels(spark, sf))
    layer = g.rasterise_mean(cells, {"mean_du": "d_u"})
    return rounded(cells.join(layer, ["row", "col"]).groupBy("domain").agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("d_u") - F.col("mean_du"))).alias("mad")))


@query("j02_nearest_planar", """WITH p AS (SELECT DISTINCT easting, northing FROM pixels), d AS (SELECT easting, northing,
 sqrt(min(pow(easting - x, 2) + pow(northing - y, 2))) / 1000 AS km FROM p, boundary_points GROUP BY ALL)
 SELECT pixel_id, round(km, 6) AS boundary_km FROM pixels JOIN d USING (easting, northing)""")
def j02(spark, sf):
    return rounded(sp.nearest_point(pixels(spark, sf), boundary_points(spark, sf)).select("pixel_id", "boundary_km"))


@query("j03_nearest_sphere", """WITH p AS (SELECT DISTINCT longitude, latitude FROM pixels), d AS (SELECT longitude, latitude,
 min(2 * 6371 * asin(least(sqrt(pow(sin((radians(lat) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(lat))
 * pow(sin((radians(lon) - radians(longitude)) / 2), 2)), 1))) AS km FROM p, boundary_points GROUP BY ALL)
 SELECT pixel_id, round(km, 4) AS boundary_km FROM pixels JOIN d USING (longitude, latitude)""")
def j03(spark, sf):
    return rounded(sp.nearest_point_sphere(pixels(spark, sf), boundary_points(spark, sf)).select("pixel_id", "boundary_km"), 4)


_LAKE_SQL = """pt AS (SELECT DISTINCT easting AS px, northing AS py FROM pixels),
 sq AS (SELECT *, floor(cx / 4000) AS tx, floor(cy / 4000) AS ty FROM squares),
 near AS (SELECT px, py, kind, min(pow(greatest(abs(px - cx) - half, 0), 2) + pow(greatest(abs(py - cy) - half, 0), 2)) AS d2
 FROM pt, squares WHERE abs(py - cy) < 30000 GROUP BY ALL)"""


@query("j04_feature_distance", f"""WITH {_LAKE_SQL} SELECT pixel_id, round(sqrt(d2), 4) AS distance_m
 FROM pixels JOIN near ON easting = px AND northing = py WHERE kind = 'lake'""")
def j04(spark, sf):
    lakes = polygon_edges(spark, sf).where("kind = 'lake'")
    pts = pixels(spark, sf).select("pixel_id", "easting", "northing")
    return rounded(sp.distance_to_features(pts, lakes, tile=1088.0).select("pixel_id", "distance_m"), 4)


@query("j05_lake_and_slump", f"""WITH {_LAKE_SQL}, w AS (SELECT px, py, min(sqrt(d2)) FILTER (kind = 'lake') AS tl,
 min(sqrt(d2)) FILTER (kind = 'slump') AS rts FROM near GROUP BY px, py)
 SELECT pixel_id, round(tl / 1000, 6) AS tl_distance_km, round(rts / 1000, 6) AS rts_distance_km,
 round(least(tl, rts) / 1000, 6) AS tlrts_distance_km FROM pixels JOIN w ON easting = px AND northing = py""")
def j05(spark, sf):
    edges = polygon_edges(spark, sf)
    pts = pixels(spark, sf).select("pixel_id", "easting", "northing")
    out = sp.attach_feature_distances(pts, edges.where("kind = 'lake'"), edges.where("kind = 'slump'"), tile=1088.0)
    return rounded(out.select("pixel_id", "tl_distance_km", "rts_distance_km", "tlrts_distance_km"))


RAIL_SQL = f"""pt AS (SELECT DISTINCT easting AS px, northing AS py FROM pixels WHERE d_u <= 0 AND domain <> 'other'
 AND grad_mag_km IS NOT NULL), rd AS (SELECT px, py, sqrt(min({SEG_D2})) AS d_m FROM pt, line_edges GROUP BY px, py)"""


def rail_sample(spark, sf):
    pts = pixels(spark, sf).where("d_u <= 0 AND domain <> 'other' AND grad_mag_km IS NOT NULL").drop("distance_to_rail_m", "along_km")
    return sp.corridor_sample(pts, sp.edges_of(line_vertices(spark, sf)), WIDTHS)


@query("j06_corridor", f"""WITH {RAIL_SQL}, w(buffer_width_km) AS (VALUES (2.0::DOUBLE), (4.0::DOUBLE), (8.0::DOUBLE))
 SELECT buffer_width_km, domain, count(*) AS n, round(avg(d_m), 4) AS mean_distance_m FROM pixels
 JOIN rd ON easting = px AND northing = py JOIN w ON d_m <= 500 * buffer_width_km
 WHERE d_u <= 0 AND domain <> 'other' AND grad_mag_km IS NOT NULL GROUP BY ALL""")
def j06(spark, sf):
    nested = sp.nested_widths(rail_sample(spark, sf), WIDTHS)
    return rounded(nested.groupBy("buffer_width_km", "domain").agg(
        F.count("*").alias("n"), F.avg("distance_to_rail_m").alias("mean_distance_m")), 4)


LEN_SQL = "sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))"


@query("j07_linear_reference", f"""WITH e AS (SELECT *, {LEN_SQL} AS edge_m, coalesce(sum({LEN_SQL}) OVER (ORDER BY seq
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_m FROM line_edges WHERE line_id = (SELECT line_id FROM line_edges GROUP BY line_id ORDER BY sum({LEN_SQL}) DESC, line_id LIMIT 1)),
 pt AS (SELECT DISTINCT easting AS px, northing AS py FROM pixels),
 b AS (SELECT px, py, arg_min(start_m + {SEG_T} * edge_m, ROW({SEG_D2}, seq)) / 1000 AS along_km FROM pt, e GROUP BY px, py)
 SELECT pixel_id, round(b.along_km, 4) AS along_km FROM pixels JOIN b ON easting = px AND northing = py""")
def j07(spark, sf):
    edges = sp.edges_of(line_vertices(spark, sf))
    edges = edges.join(sp.longest_line(edges).select("line_id"), "line_id", "left_semi")
    pts = pixels(spark, sf).select("pixel_id", "easting", "northing")
    return rounded(sp.along_line(pts, edges).select("pixel_id", "along_km"), 4)


@query("j08_longest_line", f"""SELECT line_id, round(length_km, 6) AS length_km FROM (SELECT line_id, sum({LEN_SQL}) / 1000 AS length_km
 FROM line_edges GROUP BY line_id) ORDER BY length_km DESC, line_id LIMIT 1""")
def j08(spark, sf):
    return rounded(sp.longest_line(sp.edges_of(line_vertices(spark, sf))))


def supplier_boxes(spark, sf):
    return boundary_points(spark, sf).select(
        "point_id", (F.col("x") - 2500.0).alias("xmin"), (F.col("x") + 2500.0).alias("xmax"),
        (F.col("y") - 2500.0).alias("ymin"), (F.col("y") + 2500.0).alias("ymax"))


@query("j09_points_in_boxes", """SELECT point_id, count(pixel_id) AS n_points, count(*) FILTER (d_u <= -16.5 OR grad_mag_km >= 30.5) AS n_hotspots,
 round(avg(2.5::DOUBLE * CAST(coalesce(d_u <= -16.5, false) OR coalesce(grad_mag_km >= 30.5, false) AS INTEGER) + greatest(-d_u, 0) / 20
 + greatest(coalesce(grad_mag_km, 0), 0) / 30), 6) AS mean_score
 FROM boundary_points LEFT JOIN (SELECT * FROM pixels WHERE domain = 'pf') ON easting BETWEEN x - 2500 AND x + 2500
 AND northing BETWEEN y - 2500 AND y + 2500 GROUP BY point_id""")
def j09(spark, sf):
    from tailfield.operators.windows import hotspot, window_score
    df = pixels(spark, sf).where("domain = 'pf'").withColumn("hot", hotspot()).withColumn("score", window_score())
    out = sp.count_in_boxes(df, supplier_boxes(spark, sf), [
        F.count("*").alias("n_points"), F.sum("hot").alias("n_hotspots"), F.avg("score").alias("mean_score")],
        key="point_id", tile=5000.0)
    return rounded(out.select("point_id", F.coalesce("n_points", F.lit(0)).alias("n_points"),
                              F.coalesce("n_hotspots", F.lit(0)).alias("n_hotspots"), "mean_score"))


@query("j10_best_cover", """WITH w AS (SELECT feature_id, cx, cy, cx - 3000 AS xmin, cx + 3000 AS xmax, cy - 3000 AS ymin, cy + 3000 AS ymax FROM squares),
 t AS (SELECT 'tile' || point_id AS tile, x - 2000 - (point_id % 5) * 800 AS txmin, x + 2000 + (point_id % 5) * 800 AS txmax, y - 4000 AS tymin, y + 4000 AS tymax FROM boundary_points),
 s AS (SELECT feature_id, tile, (least(xmax, txmax) - greatest(xmin, txmin)) * (least(ymax, tymax) - greatest(ymin, tymin)) / ((xmax - xmin) * (ymax - ymin)) AS cover,
 CAST((xmin + xmax) / 2 BETWEEN txmin AND txmax AND (ymin + ymax) / 2 BETWEEN tymin AND tymax AS INTEGER) AS c, -(txmax - txmin) * (tymax - tymin) AS a
 FROM w JOIN t ON least(xmax, txmax) > greatest(xmin, txmin) AND least(ymax, tymax) > greatest(ymin, tymin)),
 b AS (SELECT feature_id, tile, cover FROM s QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY cover DESC, c DESC, a DESC, tile DESC) = 1)
 SELECT feature_id, coalesce(tile, '') AS tile, round(coalesce(cover, 0), 6) AS cover FROM squares LEFT JOIN b USING (feature_id)""")
def j10(spark, sf):
    windows = squares(spark, sf).select("feature_id", *[
        (F.col(c) + d).alias(n) for c, d, n in (("cx", -3000.0, "xmin"), ("cx", 3000.0, "xmax"), ("cy", -3000.0, "ymin"), ("cy", 3000.0, "ymax"))])
    half = F.lit(2000.0) + (F.col("point_id") % 5) * 800.0
    tiles = boundary_points(spark, sf).select(
        F.concat(F.lit("tile"), F.col("point_id")).alias("tile"), (F.col("x") - half).alias("xmin"), (F.col("x") + half).alias("xmax"),
        (F.col("y") - 4000.0).alias("ymin"), (F.col("y") + 4000.0).alias("ymax"))
    return rounded(sp.best_cover(windows, tiles, key="feature_id", cell=8000.0).select("feature_id", "tile", "cover"))


@query("j11_k_nearest", f"""WITH {KNN_SQL} SELECT (-14007 + col) * 136.0::DOUBLE AS easting, (30570 - "row") * 136.0::DOUBLE AS northing, count(*) AS n, round(max(sqrt(dx * dx + dy * dy)), 4) AS reach_m,
 min(nid) AS first_id FROM nb GROUP BY "row", col""")
def j11(spark, sf):
    nb = sp.k_neighbours(pixels(spark, sf).select("pixel_id", "easting", "northing"), k=21, lists=True)
    return rounded(nb.select("easting", "northing", F.size("near").cast("long").alias("n"), F.sqrt(F.array_max("near.d2")).alias("reach_m"),
                             F.array_min("near._rid").alias("first_id")), 4)


@query("j12_point_in_polygon", """SELECT feature_id, count(*) AS n FROM pixels JOIN squares ON easting > cx - half AND easting < cx + half
 AND northing > cy - half AND northing < cy + half GROUP BY feature_id""")
def j12(spark, sf):
    df = pixels(spark, sf)
    inside = sp.containing_features(df, polygon_edges(spark, sf), tile=1088.0)
    return df.join(inside, ["easting", "northing"]).groupBy("feature_id").agg(F.count("*").alias("n"))


@query("j13_set_alignment", """WITH p AS (SELECT DISTINCT p_type, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey)
 SELECT p_type, count(*) AS n_panels, count(*) = 3 AS complete FROM p GROUP BY p_type""")
def j13(spark, sf):
    from tailfield.operators.stats import panel_alignment
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return panel_alignment(li, "p_type", "l_returnflag", 3)


BIN_EDGES = [0.0, 1.0, 2.0, 5.0, 10.0, float("inf")]


@query("j14_distance_bin_lookup", """WITH b(bin_index, lo, hi) AS (VALUES (0, 0.0::DOUBLE, 1.0::DOUBLE), (1, 1.0, 2.0), (2, 2.0, 5.0), (3, 5.0, 10.0), (4, 10.0, 'infinity'::DOUBLE))
 SELECT bin_index, count(*) AS n, round(avg(d_u), 6) AS mean_du FROM pixels LEFT JOIN b ON boundary_distance_km >= lo AND boundary_distance_km < hi GROUP BY bin_index""")
def j14(spark, sf):
    from tailfield.operators.stats import edge_bin
    return rounded(pixels(spark, sf).groupBy(edge_bin("boundary_distance_km", BIN_EDGES).alias("bin_index")).agg(
        F.count("*").alias("n"), F.avg("d_u").alias("mean_du")))
