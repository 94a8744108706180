"""Views of the given tables in the shape the operators expect, in Spark and as SQL.

A swath 240 cells wide that grows southwards with the order key keeps the density
of cells constant, so that the spatial work grows with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 240
ROW_ORDERS = 60


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# One expression per column, valid in Spark and in DuckDB.
PIXEL_COLUMNS = {
    "pixel_id": "concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),"
                " CAST(l_linenumber AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING))",
    "easting": f"CAST(-14007 + (l_partkey * 7 + l_suppkey * 13) % {WIDTH} AS DOUBLE) * CAST(136 AS DOUBLE)",
    "northing": f"(CAST(30570 AS DOUBLE) - floor(CAST(l_orderkey AS DOUBLE) / {ROW_ORDERS})) * CAST(136 AS DOUBLE)",
    "longitude": "CAST(80 AS DOUBLE) + CAST(l_partkey % 2000 AS DOUBLE) / 100",
    "latitude": "CAST(28 AS DOUBLE) + CAST(l_orderkey % 1200 AS DOUBLE) / 100",
    "d_u": "(CAST(10 AS DOUBLE) - l_quantity) / 2",
    "grad_mag": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice / CAST(2500000 AS DOUBLE) END",
    "grad_mag_km": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice / CAST(2500 AS DOUBLE) END",
    "Perma_Distr_map": "CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE 2 END",
    "domain": "CASE l_returnflag WHEN 'R' THEN 'pf' WHEN 'A' THEN 'npf' ELSE 'other' END",
    "magt": "CASE WHEN l_linenumber = 6 THEN NULL ELSE l_discount * CAST(40 AS DOUBLE) - CAST(1 AS DOUBLE)"
            " + CAST(l_partkey % 7 AS DOUBLE) / 10 END",
    "slope": "l_tax * CAST(100 AS DOUBLE) + CAST(l_suppkey % 10 AS DOUBLE) / 4",
    "dem": "CAST(4000 AS DOUBLE) + l_extendedprice / 50",
    "soc": "l_quantity + CAST((l_partkey * 13 + l_suppkey) % 60 AS DOUBLE)",
    "ndvi": "CAST(l_partkey % 97 AS DOUBLE) / 100",
    "vwc35": "CASE WHEN l_linenumber >= 5 THEN NULL ELSE CAST(l_suppkey % 50 AS DOUBLE) / 100 END",
    "boundary_distance_km": "CASE WHEN l_linenumber = 3 AND l_quantity > 45 THEN NULL"
                                " ELSE CAST(l_partkey % 400 AS DOUBLE) / 20 END",
    "tl_distance_km": "CASE WHEN l_suppkey % 11 = 0 THEN NULL"
                      " ELSE CAST((l_partkey * 3 + l_suppkey * 7) % 240 AS DOUBLE) / 20 END",
    "rts_distance_km": "CASE WHEN l_suppkey % 13 = 0 THEN NULL"
                       " ELSE CAST((l_partkey * 5 + l_orderkey) % 300 AS DOUBLE) / 20 END",
    "tlrts_distance_km": "CASE WHEN l_suppkey % 11 = 0 AND l_suppkey % 13 = 0 THEN NULL ELSE least("
                         "CASE WHEN l_suppkey % 11 = 0 THEN CAST(999 AS DOUBLE)"
                         " ELSE CAST((l_partkey * 3 + l_suppkey * 7) % 240 AS DOUBLE) / 20 END,"
                         "CASE WHEN l_suppkey % 13 = 0 THEN CAST(999 AS DOUBLE)"
                         " ELSE CAST((l_partkey * 5 + l_orderkey) % 300 AS DOUBLE) / 20 END) END",
    "along_km": "CAST((l_orderkey * 3 + l_partkey) % 12000 AS DOUBLE) / 10",
    "distance_to_rail_m": "CAST((l_partkey * 11 + l_suppkey * 5) % 2500 AS DOUBLE) * 4",
    "pf_expert": "floor((l_quantity / 50 * CAST(0.6 AS DOUBLE)"
                 " + CAST((l_partkey * 31 + l_suppkey * 17) % 400 AS DOUBLE) / 1010) * 1000) / 1000",
    "npf_expert": "floor((l_extendedprice / 105000 * CAST(0.5 AS DOUBLE)"
                  " + CAST((l_orderkey * 7) % 450 AS DOUBLE) / 1010) * 1000) / 1000",
    "suppkey": "l_suppkey",
}


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} AS `{n}`" for n, e in PIXEL_COLUMNS.items()])


def pixel_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text columns with unparsable entries, derived from the line items."""
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} AS `{n}`" for n, e in TEXT_COLUMNS.items()])


TEXT_COLUMNS = {
    "pixel_id": PIXEL_COLUMNS["pixel_id"],
    "d_u_text": "CASE l_linenumber WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN 'NaN' WHEN 4 THEN 'Infinity'"
                " ELSE CAST(CAST((10 - l_quantity) / 2 AS DECIMAL(10, 2)) AS STRING) END",
    "flag_text": "CASE l_linenumber WHEN 1 THEN ' TRUE ' WHEN 2 THEN 'yes' WHEN 3 THEN 'No' WHEN 4 THEN NULL"
                 " WHEN 5 THEN 'T' ELSE '0' END",
}


def basin_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels with their basin; the nation and region tables have fixed sizes (25 and 5 rows)."""
    places = (
        table(spark, sf, "nation")
        .join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name"))
    )
    basins = (
        table(spark, sf, "supplier")
        .join(F.broadcast(places), "s_nationkey")
        .select(
            F.col("s_suppkey").alias("suppkey"),
            F.when(F.col("s_suppkey") % 7 != 0, F.col("r_name")).alias("Main-Basin"),
        )
    )
    return pixels(spark, sf).join(basins, "suppkey", "left")


def boundary_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr(*[f"{e} AS `{n}`" for n, e in BOUNDARY_COLUMNS.items()])


BOUNDARY_COLUMNS = {
    "point_id": "s_suppkey",
    "x": f"CAST(-14007 + (s_suppkey * 37) % {WIDTH} AS DOUBLE) * CAST(136 AS DOUBLE)",
    "y": "(CAST(30570 AS DOUBLE) - floor(CAST(s_suppkey AS DOUBLE) * 5 / 2)) * CAST(136 AS DOUBLE)",
    "lon": "CAST(80 AS DOUBLE) + CAST((s_suppkey * 61) % 2000 AS DOUBLE) / 100",
    "lat": "CAST(28 AS DOUBLE) + CAST((s_suppkey * 47) % 1200 AS DOUBLE) / 100",
}

# Squares around customers, four edges each; half a side is 0.6 cells.
SQUARE_COLUMNS = {
    "feature_id": "c_custkey",
    "kind": "CASE WHEN c_nationkey % 2 = 0 THEN 'lake' ELSE 'slump' END",
    "cx": f"CAST(-14007 + (c_custkey * 17) % {WIDTH} AS DOUBLE) * CAST(136 AS DOUBLE)",
    "cy": "(CAST(30570 AS DOUBLE) - floor(CAST(c_custkey AS DOUBLE) / 6)) * CAST(136 AS DOUBLE)",
    "half": "CAST(81.6 AS DOUBLE)",
}
CORNERS = ((0, -1, -1, 1, -1), (1, 1, -1, 1, 1), (2, 1, 1, -1, 1), (3, -1, 1, -1, -1))


def squares(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(*[f"{e} AS `{n}`" for n, e in SQUARE_COLUMNS.items()])


def polygon_edges(spark: SparkSession, sf: str) -> DataFrame:
    corners = F.explode(
        F.array(*[
            F.struct(
                F.lit(0).alias("ring_id"), F.lit(seq).alias("seq"),
                (F.col("cx") + F.lit(float(a)) * F.col("half")).alias("x1"),
                (F.col("cy") + F.lit(float(b)) * F.col("half")).alias("y1"),
                (F.col("cx") + F.lit(float(c)) * F.col("half")).alias("x2"),
                (F.col("cy") + F.lit(float(d)) * F.col("half")).alias("y2"),
            )
            for seq, a, b, c, d in CORNERS
        ])
    ).alias("e")
    return squares(spark, sf).select("feature_id", "kind", corners).select("feature_id", "kind", "e.*")


# Nations in key order as the vertices of five polylines, one per region.
VERTEX_COLUMNS = {
    "line_id": "n_regionkey",
    "vertex": "n_nationkey",
    "x": f"CAST(-14007 + (n_nationkey * 29) % {WIDTH} AS DOUBLE) * CAST(136 AS DOUBLE)",
    "y": "(CAST(30570 AS DOUBLE) - CAST(n_nationkey AS DOUBLE) * 10) * CAST(136 AS DOUBLE)",
}


def line_vertices(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").selectExpr(*[f"{e} AS `{n}`" for n, e in VERTEX_COLUMNS.items()])


def _select(columns: dict[str, str], source: str) -> str:
    body = ", ".join(f'{e} AS "{n}"' for n, e in columns.items())
    return f"SELECT {body} FROM {source}"


_EDGE_SQL = " UNION ALL ".join(
    f"SELECT feature_id, kind, 0 AS ring_id, {seq} AS seq, cx + {a} * half AS x1, cy + {b} * half AS y1,"
    f" cx + {c} * half AS x2, cy + {d} * half AS y2 FROM squares"
    for seq, a, b, c, d in CORNERS
)

VIEWS: dict[str, str] = {
    "pixels": _select(PIXEL_COLUMNS, "lineitem"),
    "pixel_text": _select(TEXT_COLUMNS, "lineitem"),
    "basin_pixels": 'SELECT p.*, CASE WHEN s_suppkey % 7 <> 0 THEN r_name END AS "Main-Basin" FROM pixels p'
                    " LEFT JOIN supplier ON suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey"
                    " LEFT JOIN region ON n_regionkey = r_regionkey",
    "boundary_points": _select(BOUNDARY_COLUMNS, "supplier"),
    "squares": _select(SQUARE_COLUMNS, "customer"),
    "polygon_edges": _EDGE_SQL,
    "line_vertices": _select(VERTEX_COLUMNS, "nation"),
    "line_edges": "SELECT * FROM (SELECT line_id, vertex AS seq, x AS x1, y AS y1,"
                  " lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM line_vertices"
                  " WINDOW w AS (PARTITION BY line_id ORDER BY vertex)) WHERE x2 IS NOT NULL",
    "cells": "SELECT CAST(30570 - northing / 136 AS BIGINT) AS row, CAST(easting / 136 + 14007 AS BIGINT) AS col,"
             " d_u, grad_mag_km, domain, pixel_id FROM pixels",
    "labelled": "SELECT *, CASE WHEN d_u IS NULL THEN NULL WHEN domain = 'pf' THEN CAST(d_u < -16.5 AS INTEGER)"
                " WHEN domain = 'npf' THEN CAST(d_u < -7.4 AS INTEGER) END AS label FROM pixels",
}


def resolve(sql: str) -> str:
    """Prefix the CTEs that ``sql`` uses, in definition order."""
    needed: set[str] = set()

    def visit(text: str):
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed]
    if not ctes:
        return sql
    head = "WITH " + ", ".join(ctes)
    stripped = sql.lstrip()
    if stripped.upper().startswith("WITH RECURSIVE "):
        return head.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + stripped[15:]
    if stripped.upper().startswith("WITH "):
        return head + ", " + stripped[5:]
    return head + " " + stripped
