"""Queries over sources, sinks and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailfield.constants import BOUNDARY_KM, IMPACT_KM
from tailfield.plans.inputs import pixels, polygon_edges, table
from tailfield.plans.registry import query, rounded
from tailfield.session import scratch_dir, small_table
from tailfield.sources import artefacts
from tailfield.sources import tables as src

DOMAIN_STATS = """SELECT domain, count(*) AS n, count(d_u) AS n_du, round(sum(d_u), 6) AS sum_du,
 round(max(grad_mag_km), 6) AS max_grad FROM pixels GROUP BY domain"""


def _domain_stats(df):
    return rounded(df.groupBy("domain").agg(
        F.count("*").alias("n"), F.count("d_u").alias("n_du"), F.sum("d_u").alias("sum_du"),
        F.max("grad_mag_km").alias("max_grad"),
    ))


@query("s01_csv_scan", DOMAIN_STATS)
def s01(spark, sf):
    path = scratch_dir(spark) + "/cells"
    pixels(spark, sf).select("pixel_id", "easting", "northing", "d_u", "grad_mag_km", "Perma_Distr_map").write.option(
        "header", True).csv(path)
    return _domain_stats(src.normalise_cells(
        src.read_cells_csv(spark, path, ["d_u", "grad_mag_km", "Perma_Distr_map"])))


@query("s02_header_discovery", """SELECT 'grad_mag' AS gradient_column, count(*) AS n, count(longitude) AS n_lon,
 round(avg(grad_mag) * 1000, 6) AS mean_grad_km FROM pixels""")
def s02(spark, sf):
    df = pixels(spark, sf).drop("grad_mag_km")
    cols = src.resolve_columns(df.columns, ["easting", "northing", "d_u"], ["longitude", "latitude"],
                               ["grad_mag_km", "grad_mag"])
    gradient = next(c for c in ("grad_mag_km", "grad_mag") if c in cols)
    scale = 1.0 if gradient == "grad_mag_km" else 1000.0
    return rounded(df.select(*cols).agg(
        F.lit(gradient).alias("gradient_column"), F.count("*").alias("n"), F.count("longitude").alias("n_lon"),
        (F.avg(gradient) * scale).alias("mean_grad_km")))


@query("s03_sample_cache", "SELECT domain, count(*) AS n, round(min(d_u), 6) AS min_du FROM pixels"
                           " WHERE d_u < 0 GROUP BY domain")
def s03(spark, sf):
    path = scratch_dir(spark) + "/sample"
    need = ["pixel_id", "domain", "d_u"]

    def build():
        return pixels(spark, sf).where("d_u < 0").select(*need)

    src.cached_sample(spark, path, need, build)
    again = src.cached_sample(spark, path, need, build)
    return rounded(again.groupBy("domain").agg(F.count("*").alias("n"), F.min("d_u").alias("min_du")))


@query("s04_parquet_fallback", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def s04(spark, sf):
    found = src.first_readable(spark, [f"{sf}/no_such_sample.parquet", f"{sf}/lineitem.parquet"], ["l_returnflag"])
    return found.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("s05_result_sink", "SELECT domain, count(*) AS n FROM pixels GROUP BY domain")
def s05(spark, sf):
    path = scratch_dir(spark) + "/result"
    src.write_result(pixels(spark, sf).groupBy("domain").agg(F.count("*").alias("n")), path)
    return spark.read.schema("domain string, n long").option("header", True).csv(path)


@query("s06_cell_store", """SELECT "row" // 64 AS tile, count(*) AS n, round(sum(value), 6) AS total FROM (
 SELECT "row", col, avg(d_u) AS value FROM cells GROUP BY "row", col)
 WHERE "row" BETWEEN 40 AND 200 AND col BETWEEN 10 AND 99 GROUP BY 1""")
def s06(spark, sf):
    from tailfield.operators.grid import rasterise_mean, with_cell
    path = scratch_dir(spark) + "/cells"
    src.write_cells(rasterise_mean(with_cell(pixels(spark, sf)), {"value": "d_u"}), path, tile=64)
    window = src.read_cells(spark, path, rows=(40, 200), cols=(10, 99), tile=64)
    return rounded(window.groupBy(F.floor(F.col("row") / 64).alias("tile")).agg(
        F.count("*").alias("n"), F.sum("value").alias("total")))


@query("s07_vector_layer", """SELECT feature_id, count(*) AS n_edges, round(sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))), 4)
 AS perimeter FROM polygon_edges WHERE upper(trim(kind)) IN ('LAKE') GROUP BY feature_id""")
def s07(spark, sf):
    layer = src.read_features(polygon_edges(spark, sf), "kind", [" lake"], "albers", "albers")
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    return rounded(layer.groupBy("feature_id").agg(F.count("*").alias("n_edges"), F.sum(length).alias("perimeter")), 4)


@query("s08_raster_metadata", """SELECT count(*) AS n_predictions, min("row") AS row_min, max("row") AS row_max,
 min(col) AS col_min, max(col) AS col_max, round(min(v), 6) AS value_min, round(max(v), 6) AS value_max FROM (
 SELECT "row", col, avg(d_u) AS v FROM cells GROUP BY "row", col)""")
def s08(spark, sf):
    from tailfield.operators.grid import rasterise_mean, with_cell
    path = scratch_dir(spark) + "/meta"
    cells = rasterise_mean(with_cell(pixels(spark, sf)), {"v": "d_u"})
    src.raster_metadata(cells, "v").coalesce(1).write.json(path)
    schema = ("n_predictions long, row_min long, row_max long, col_min long, col_max long,"
              " value_min double, value_max double")
    return rounded(spark.read.schema(schema).json(path))


@query("s09_signed_store", "SELECT domain, count(*) AS n, false AS first_reused, true AS second_reused,"
                           " false AS changed_reused FROM pixels GROUP BY domain")
def s09(spark, sf):
    root, inputs = scratch_dir(spark) + "/store", [f"{sf}/lineitem.parquet"]

    def build():
        return pixels(spark, sf).groupBy("domain").agg(F.count("*").alias("n"))

    _, first = artefacts.stored_table(spark, root, inputs, {"q": 0.95}, build)
    df, second = artefacts.stored_table(spark, root, inputs, {"q": 0.95}, build)
    _, changed = artefacts.stored_table(spark, root, inputs, {"q": 0.9}, build)
    return df.select("*", F.lit(first).alias("first_reused"), F.lit(second).alias("second_reused"),
                     F.lit(changed).alias("changed_reused"))


@query("s11_stack", """SELECT part, domain, n, lowest FROM (
 SELECT 'npf' AS part, domain, count(*) AS n, NULL::DOUBLE AS lowest FROM pixels WHERE domain = 'npf' GROUP BY domain
 UNION ALL SELECT 'pf', domain, count(*), round(min(d_u), 6) FROM pixels WHERE domain = 'pf' GROUP BY domain)""")
def s11(spark, sf):
    df = pixels(spark, sf)
    a = df.where("domain = 'npf'").groupBy("domain").agg(F.count("*").alias("n")).withColumn("part", F.lit("npf"))
    b = df.where("domain = 'pf'").groupBy("domain").agg(
        F.count("*").alias("n"), F.min("d_u").alias("lowest")).withColumn("part", F.lit("pf"))
    return rounded(src.stack([a, b]).select("part", "domain", "n", "lowest"))


def fallback_table(spark):
    rows = [(t, "d_B", d, v) for (t, d), v in BOUNDARY_KM.items()]
    rows += [(t, "d_A", c, v) for (t, c), v in IMPACT_KM.items()]
    return small_table(spark, "target string, distance_axis string, profile_group string, piecewise_break_km double", rows)


_FALLBACK_VALUES = ", ".join(
    [f"('{t}', 'd_B', '{d}', {v})" for (t, d), v in BOUNDARY_KM.items()]
    + [f"('{t}', 'd_A', '{c}', {v})" for (t, c), v in IMPACT_KM.items()]
)


@query("s12_constant_fallback", f"""WITH w(target, distance_axis, profile_group, k) AS (VALUES {_FALLBACK_VALUES}),
 f AS (SELECT 'd_u' AS target, 'd_B' AS distance_axis, domain AS profile_group,
 round(avg(boundary_distance_km), 6) AS b FROM pixels WHERE domain IN ('pf', 'npf') GROUP BY domain)
 SELECT w.target, w.distance_axis, w.profile_group, coalesce(b, k::DOUBLE) AS piecewise_break_km,
 CASE WHEN b IS NULL THEN 'constant_fallback' ELSE 'piecewise_fit' END AS fit_status
 FROM w LEFT JOIN f USING (target, distance_axis, profile_group)""")
def s12(spark, sf):
    fits = pixels(spark, sf).where("domain IN ('pf', 'npf')").groupBy("domain").agg(
        F.avg("boundary_distance_km").alias("piecewise_break_km")).select(
        F.lit("d_u").alias("target"), F.lit("d_B").alias("distance_axis"), F.col("domain").alias("profile_group"),
        "piecewise_break_km", F.lit("piecewise_fit").alias("fit_status"))
    return rounded(src.with_fallback(fallback_table(spark), fits, ["target", "distance_axis", "profile_group"],
                                     "piecewise_break_km", "fit_status"))
