"""Distances to points, lines and polygons, corridors, containment and neighbourhoods."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from tailfield.constants import EARTH_RADIUS_KM
from tailfield.functions.geo import haversine_km, segment_projection, unit_sphere_km
from tailfield.operators.nearest import AROUND, edge_distances, k_nearest_rows, nearest
from tailfield.session import materialise

WINDOWS_A_TASK = 5_000  # in best_cover
EDGE_BLOCK = 16  # tiles along a side of a block of feature_distances
BLOCK_PIECES = 500_000  # with those in reach; denser blocks take the general way
POINTS_A_TASK = 250_000
FEW = 1 << 18  # positions that are broadcast


def nearest_point(points: DataFrame, refs: DataFrame, *, x="easting", y="northing", rx="x", ry="y",
                  tile: float = 2048.0, out: str = "boundary_km") -> DataFrame:
    """Planar distance in km to the closest reference; NULL without coordinates."""
    r = refs.select(F.col(rx).alias("_rx"), F.col(ry).alias("_ry")).dropna().distinct()
    dx, dy = F.col(x) - F.col("_rx"), F.col(y) - F.col("_ry")
    d2 = dx * dx + dy * dy
    found = nearest(points, r, key=[x, y], query_coords=[F.col(x), F.col(y)], ref_coords=[F.col("_rx"), F.col("_ry")],
                    payload=["_rx", "_ry"], distance2=d2, tile=tile, tie="_rx", only_distance=True)
    return points.join(found.select(x, y, (F.sqrt("d2") / 1000.0).alias(out)), [x, y], "left")


def nearest_point_sphere(points: DataFrame, refs: DataFrame, *, lon="longitude", lat="latitude", rlon="lon", rlat="lat",
                         tile_km: float = 64.0, out: str = "boundary_km") -> DataFrame:
    """Great-circle distance in km to the closest reference, searched along straight chords."""
    r = refs.select(F.col(rlon).alias("_rx"), F.col(rlat).alias("_ry")).dropna().distinct()
    qc, rc = unit_sphere_km(lon, lat), unit_sphere_km("_rx", "_ry")
    d = haversine_km(lon, lat, "_rx", "_ry", EARTH_RADIUS_KM)
    found = nearest(points, r, key=[lon, lat], query_coords=list(qc), ref_coords=list(rc), payload=["_rx", "_ry"],
                    distance2=d, tile=tile_km, tie="_rx", only_distance=True)
    return points.join(found.select(lon, lat, F.col("d2").alias(out)), [lon, lat], "left")


def edge_length() -> Column:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return F.sqrt(dx * dx + dy * dy)


def split_edges(edges: DataFrame, length: float) -> DataFrame:
    """Edges cut into pieces of at most ``length``, each with its midpoint (mx, my) and number ``_i``; the edge itself is kept."""
    size = edge_length()
    n = F.greatest(F.ceil(size / length), F.lit(1))
    at = (F.col("_i") + 0.5) / F.col("_n")
    return (
        edges.withColumn("_n", n)
        .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        .withColumn("mx", F.col("x1") + at * (F.col("x2") - F.col("x1")))
        .withColumn("my", F.col("y1") + at * (F.col("y2") - F.col("y1")))
        .drop("_n")
    )


def nearest_edge(points: DataFrame, edges: DataFrame, *, x="easting", y="northing", tile: float = 2048.0,
                 extra: list[str] = (), tie: str = "seq", only_distance: bool = False) -> DataFrame:
    """Closest edge of every distinct position: ``x``, ``y``, ``d2``, edge ends and ``extra`` columns."""
    pieces = split_edges(edges, tile).drop("_i")
    d2, _ = segment_projection(x, y, "x1", "y1", "x2", "y2")
    payload = list(dict.fromkeys(["x1", "y1", "x2", "y2", tie, *extra]))
    return nearest(points, pieces, key=[x, y], query_coords=[F.col(x), F.col(y)], ref_coords=[F.col("mx"), F.col("my")],
                   payload=payload, distance2=d2, tile=tile, slack=tile / 2, tie=tie, only_distance=only_distance,
                   from_point=lambda c: segment_projection(c[0], c[1], "x1", "y1", "x2", "y2")[0])


def containing_features(points: DataFrame, edges: DataFrame, *, x="easting", y="northing", tile: float = 4096.0) -> DataFrame:
    """Distinct positions with the polygons that contain them, by the parity of edge crossings.

    Positions meet a polygon only in tiles of its bounding box, and within it only the
    edges of their own row of tiles, so a large outline is never compared whole.
    """
    def t(c: Column) -> Column:
        return F.floor(c / tile)

    low_y, high_y = F.least("y1", "y2"), F.greatest("y1", "y2")
    boxes = edges.groupBy("feature_id").agg(
        F.min(F.least("x1", "x2")).alias("bx0"), F.max(F.greatest("x1", "x2")).alias("bx1"),
        F.min(low_y).alias("by0"), F.max(high_y).alias("by1"))
    box_tiles = boxes.withColumn("_tx", F.explode(F.sequence(t(F.col("bx0")), t(F.col("bx1"))))).withColumn(
        "_ty", F.explode(F.sequence(t(F.col("by0")), t(F.col("by1")))))
    bands = edges.where(F.col("y1") != F.col("y2")).select(
        "feature_id", "x1", "y1", "x2", "y2", F.explode(F.sequence(t(low_y), t(high_y))).alias("_ty"))
    placed = points.select(x, y).dropna().distinct().withColumn("_tx", t(F.col(x))).withColumn("_ty", t(F.col(y)))
    maybe = placed.join(box_tiles, ["_tx", "_ty"]).where(
        F.col(x).between(F.col("bx0"), F.col("bx1")) & F.col(y).between(F.col("by0"), F.col("by1")))
    hits = maybe.join(bands, ["feature_id", "_ty"])
    straddles = (F.col("y1") > F.col(y)) != (F.col("y2") > F.col(y))
    cross_x = F.col("x1") + (F.col(y) - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    crossing = (straddles & (F.col(x) < cross_x)).cast("int")
    return hits.groupBy(x, y, "feature_id").agg(F.sum(crossing).alias("_c")).where("_c % 2 = 1").select(x, y, "feature_id")


def position_distances(positions: DataFrame, edges: DataFrame, out: str, *, x="easting", y="northing", tile: float = 4096.0,
                       polygons: bool = True) -> DataFrame:
    found = nearest_edge(positions, edges, x=x, y=y, tile=tile, tie="x1", only_distance=True).select(x, y, F.sqrt("d2").alias(out))
    if not polygons:
        return found
    inside = containing_features(positions, edges, x=x, y=y, tile=tile).select(x, y).distinct().withColumn("_in", F.lit(True))
    return found.join(inside, [x, y], "left").withColumn(out, F.when(F.col("_in"), 0.0).otherwise(F.col(out))).drop("_in")


@dataclass(frozen=True)
class Features:
    """Edges whose distance becomes the column ``out`` (m); polygons have the distance 0 inside."""

    out: str
    edges: DataFrame
    tile: float = 4096.0
    polygons: bool = True

    @property
    def reach(self) -> float:
        """A middle of a piece within AROUND tiles of a position's tile keeps the middle of the nearest piece within this."""
        return ((AROUND + 1) * self.tile * math.sqrt(2.0) + self.tile / 2) * (1 + 1e-9)


def feature_distances(points: DataFrame, sets: list[Features], *, x="easting", y="northing") -> DataFrame:
    """``points`` with the distance in m to each set of features; NULL for an empty set or without coordinates.

    Points move once, to blocks, and pieces of edges to all blocks within their reach. A block's pieces come first and its points
    pass by in Arrow batches, so points are never held. What a block cannot tell goes the general way (``position_distances``):
    positions with no piece in the tiles around, those in blocks with very many pieces, and the inside of large polygons.
    """
    side = EDGE_BLOCK * max(s.tile for s in sets)
    kinds = StructType([StructField("s", IntegerType()), *[StructField(c, DoubleType()) for c in ("x1", "y1", "x2", "y2", "mx", "my")],
                        StructField("f", StringType()), StructField("c", BooleanType())])

    def block(c: Column) -> Column:
        return F.floor(c / F.lit(side))

    def tiles(df: DataFrame, cx: str, cy: str, tile: float) -> DataFrame:
        placed = df.select(F.floor(F.col(cx) / tile).alias("_tx"), F.floor(F.col(cy) / tile).alias("_ty"))
        return placed.groupBy("_tx", "_ty").agg(F.count("*").alias("_n"))

    whole = points.select(x, y).dropna()
    asked_by = {t: materialise(tiles(whole, x, y, t)) for t in dict.fromkeys(s.tile for s in sets)}
    pieces, rest, insides = None, {}, {}
    for i, s in enumerate(sets):
        edges = s.edges.dropna(subset=["x1", "y1", "x2", "y2"])
        feature, counts = F.lit(None).cast("string"), F.lit(False)
        if s.polygons:
            size = F.greatest(F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2")), F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2")))
            large = materialise(edges.groupBy("feature_id").agg(size.alias("_size")).where(F.col("_size") > s.tile).select("feature_id"))
            feature, counts = F.col("feature_id").cast("string"), F.lit(True)
            if not large.isEmpty():
                wide = edges.join(large, "feature_id", "left_semi")
                insides[s.out] = containing_features(whole, wide, x=x, y=y, tile=s.tile).select(x, y).distinct().withColumn(f"_in{i}", F.lit(True))
                edges = edges.join(large.withColumn("_wide", F.lit(True)), "feature_id", "left")
                counts = F.col("_wide").isNull()
        cut = split_edges(edges.withColumn("_f", feature).withColumn("_c", counts), s.tile)
        first = F.col("_c") & (F.col("_i") == 0)

        held, asked = tiles(cut, "mx", "my", s.tile), asked_by[s.tile].drop("_n")
        near = held.select(F.explode(F.sequence(F.col("_tx") - AROUND, F.col("_tx") + AROUND)).alias("_tx"), "_ty").distinct()
        near = near.select("_tx", F.explode(F.sequence(F.col("_ty") - AROUND, F.col("_ty") + AROUND)).alias("_ty")).distinct()
        hard = asked.join(near, ["_tx", "_ty"], "left_anti")
        spread = [F.explode(F.sequence(block(F.col(c) - s.reach), block(F.col(c) + s.reach))).alias(b) for c, b in (("mx", "_bx"), ("my", "_by"))]
        moved = cut.select("*", spread[0]).select("*", spread[1])
        dense = materialise(moved.groupBy("_bx", "_by").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK_PIECES).select("_bx", "_by"))
        if not dense.isEmpty():
            moved = moved.join(dense, ["_bx", "_by"], "left_anti")
            # a tile may lie across blocks
            spans = [F.explode(F.sequence(block(F.col(t) * F.lit(s.tile)), block((F.col(t) + 1) * F.lit(s.tile)))).alias(b) for t, b in (("_tx", "_bx"), ("_ty", "_by"))]
            across = asked.select("*", spans[0]).select("*", spans[1])
            hard = hard.unionByName(across.join(dense, ["_bx", "_by"], "left_semi").select("_tx", "_ty")).distinct()
        hard = materialise(hard)
        if not hard.isEmpty():
            some = whole.withColumn("_tx", F.floor(F.col(x) / s.tile)).withColumn("_ty", F.floor(F.col(y) / s.tile)).join(hard, ["_tx", "_ty"], "left_semi")
            some = materialise(some.select(x, y).distinct())
            rest[s.out] = position_distances(some, edges, f"_d{i}", x=x, y=y, tile=s.tile, polygons=s.polygons)
            if some.count() <= FEW:
                rest[s.out] = F.broadcast(rest[s.out])
        piece = F.struct(F.lit(i).alias("s"), "x1", "y1", "x2", "y2", "mx", "my", F.col("_f").alias("f"), first.alias("c")).cast(kinds)
        moved = moved.select("_bx", "_by", piece.alias("_e"), F.lit(None).cast(points.schema).alias("_p"))
        pieces = moved if pieces is None else pieces.unionByName(moved)

    # points without coordinates are dealt by their content
    lost = F.pmod(F.xxhash64(*points.columns), F.lit(64))
    placed = points.select(F.coalesce(block(F.col(x)), lost).alias("_bx"), F.coalesce(block(F.col(y)), lost).alias("_by"),
                           F.lit(None).cast(kinds).alias("_e"), F.struct(*points.columns).cast(points.schema).alias("_p"))
    total = asked_by[sets[0].tile].agg(F.sum("_n")).first()[0] or 0
    tasks = max(2 * points.sparkSession.sparkContext.defaultParallelism, -(-total // POINTS_A_TASK))
    met = pieces.unionByName(placed).repartition(tasks, "_bx", "_by").sortWithinPartitions("_bx", "_by", F.col("_p").isNotNull())
    names, outs = points.columns, [s.out for s in sets]
    schema = StructType([*[StructField(f.name, f.dataType) for f in points.schema], *[StructField(o, DoubleType()) for o in outs]])
    searched = [(s.tile, s.reach) for s in sets]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, edges = None, [], []
        for batch in batches:
            bx, by = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_bx", "_by"))
            is_point = batch.column("_p").is_valid().to_numpy(zero_copy_only=False)
            new = (bx[1:] != bx[:-1]) | (by[1:] != by[:-1]) | (is_point[1:] != is_point[:-1])
            starts = np.append(0, np.flatnonzero(new) + 1)
            for a, b in zip(starts, np.append(starts[1:], len(bx)), strict=True):
                if (bx[a], by[a]) != at:
                    at, parts, edges = (bx[a], by[a]), [], []
                if not is_point[a]:
                    parts.append(pa.RecordBatch.from_struct_array(batch.column("_e").slice(a, b - a)))
                    continue
                if not edges:
                    edges = pieces_by_set(parts, len(searched))
                    parts = []
                rows = pa.RecordBatch.from_struct_array(batch.column("_p").slice(a, b - a))
                xy = np.stack([rows.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (x, y)], axis=1)
                spots, which = np.unique(xy, axis=0, return_inverse=True)
                known = np.isfinite(spots).all(axis=1)
                found = []
                for e, (tile, reach) in zip(edges, searched, strict=True):
                    d = np.full(len(spots), np.nan)
                    d[known] = edge_distances(spots[known, 0], spots[known, 1], e, tile, reach)
                    found.append(pa.array(d[which.ravel()], from_pandas=True))
                yield pa.RecordBatch.from_arrays([*rows.columns, *found], names=schema.names)

    out = met.mapInArrow(search, schema)
    for i, s in enumerate(sets):
        if s.out in insides:
            out = out.join(insides[s.out], [x, y], "left").withColumn(s.out, F.when(F.col(f"_in{i}"), 0.0).otherwise(F.col(s.out)))
        if s.out in rest:
            out = out.join(rest[s.out], [x, y], "left").withColumn(s.out, F.coalesce(f"_d{i}", s.out))
    return out.select(*names, *outs)


def pieces_by_set(parts: list[pa.RecordBatch], n: int) -> list[dict[str, np.ndarray]]:
    """The pieces of a block in the form of ``edge_distances``, one for each set."""
    if not parts:
        return [{"mx": np.empty(0)}] * n
    whole = pa.Table.from_batches(parts).combine_chunks()
    codes = pc.dictionary_encode(pc.fill_null(whole["f"], "")).combine_chunks()
    cols = {c: whole[c].to_numpy() for c in ("s", "x1", "y1", "x2", "y2", "mx", "my", "c")} | {"f": codes.indices.to_numpy(zero_copy_only=False)}
    out = []
    for i in range(n):
        own = np.flatnonzero(cols["s"] == i)
        own = own[np.argsort(cols["my"][own], kind="stable")]
        out.append({c: v[own] for c, v in cols.items() if c != "s"})
    return out


def distance_to_features(points: DataFrame, edges: DataFrame, *, x="easting", y="northing", out: str = "distance_m", **kw) -> DataFrame:
    """Distance in m to the nearest line or polygon, 0 inside polygons; NULL for an empty set."""
    return feature_distances(points, [Features(out, edges, **kw)], x=x, y=y)


def attach_feature_distances(points: DataFrame, lakes: DataFrame, slumps: DataFrame, *, x="easting", y="northing",
                             others: list[Features] = (), **kw) -> DataFrame:
    """Lake and slump distance and the smaller of the two, in m and km, and the distances to ``others``; points move once for all."""
    out = feature_distances(points, [Features("tl_distance_m", lakes, **kw), Features("rts_distance_m", slumps, **kw), *others], x=x, y=y)
    out = out.withColumn("tlrts_distance_m", F.least("tl_distance_m", "rts_distance_m"))
    return out.withColumns({f"{n}_distance_km": F.col(f"{n}_distance_m") / 1000.0 for n in ("tl", "rts", "tlrts")})


def within_distance(points: DataFrame, edges: DataFrame, radius: float, *, x="easting", y="northing") -> DataFrame:
    """Distinct positions within ``radius`` of an edge, with the distance ``d_m``.

    Pieces no longer than the radius announce themselves to the tiles their widened box
    touches; positions elsewhere are never looked at.
    """
    def t(c: Column) -> Column:
        return F.floor(c / radius)

    pieces = split_edges(edges, radius)
    reach = 1.5 * radius
    spread = pieces.withColumn(
        "_tx", F.explode(F.sequence(t(F.col("mx") - reach), t(F.col("mx") + reach)))).withColumn(
        "_ty", F.explode(F.sequence(t(F.col("my") - reach), t(F.col("my") + reach)))).select(
        "_tx", "_ty", "x1", "y1", "x2", "y2").distinct()
    placed = points.select(x, y).dropna().distinct().withColumn("_tx", t(F.col(x))).withColumn("_ty", t(F.col(y)))
    d2, _ = segment_projection(x, y, "x1", "y1", "x2", "y2")
    near = placed.join(spread, ["_tx", "_ty"]).groupBy(x, y).agg(F.sqrt(F.min(d2)).alias("d_m"))
    return near.where(F.col("d_m") <= radius)


def corridor_sample(points: DataFrame, edges: DataFrame, widths_km: list[float], *, x="easting", y="northing") -> DataFrame:
    """Points within the widest corridor, with their distance to the line network in m."""
    near = within_distance(points, edges, 500.0 * max(widths_km), x=x, y=y)
    return points.join(near.withColumnRenamed("d_m", "distance_to_rail_m"), [x, y])


def nested_widths(sample: DataFrame, widths_km: list[float], distance: str = "distance_to_rail_m") -> DataFrame:
    """One row per point and corridor width that contains it; the width list is a parameter."""
    widths = F.array(*[F.lit(float(w)) for w in widths_km])
    return sample.withColumn(
        "buffer_width_km", F.explode(F.filter(widths, lambda w: F.col(distance) <= w * 500.0)))


def edges_with_position(edges: DataFrame, line: str = "line_id") -> DataFrame:
    """Edges of ordered lines with their length and the length before them."""
    size = edge_length()
    w = Window.partitionBy(line).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return edges.withColumn("edge_m", size).withColumn("start_m", F.coalesce(F.sum("edge_m").over(w), F.lit(0.0)))


def edges_of(vertices: DataFrame, line: str = "line_id", order: str = "vertex") -> DataFrame:
    w = Window.partitionBy(line).orderBy(order)
    return vertices.select(
        line, F.col(order).alias("seq"), F.col("x").alias("x1"), F.col("y").alias("y1"),
        F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 IS NOT NULL")


def longest_line(edges: DataFrame, line: str = "line_id") -> DataFrame:
    """Identifier and length in km of the longest line."""
    size = edge_length()
    totals = edges.groupBy(line).agg((F.sum(size) / 1000.0).alias("length_km"))
    return totals.agg(F.max_by(line, F.struct("length_km", F.negative(line))).alias(line), F.max("length_km").alias("length_km"))


def along_line(points: DataFrame, edges: DataFrame, *, x="easting", y="northing", tile: float = 4096.0) -> DataFrame:
    """Points with the position in km, along one line, of the line's closest point."""
    measured = edges_with_position(edges)
    found = nearest_edge(points, measured, x=x, y=y, tile=tile, extra=["start_m", "edge_m"])
    _, at = segment_projection(x, y, "x1", "y1", "x2", "y2")
    placed = found.select(x, y, ((F.col("start_m") + at * F.col("edge_m")) / 1000.0).alias("along_km"))
    return points.join(placed, [x, y], "left")


def count_in_boxes(points: DataFrame, boxes: DataFrame, aggregates: list[Column], *, key: str, x="easting", y="northing",
                   tile: float) -> DataFrame:
    """Aggregates over the points in each closed box, also for empty boxes.

    Boxes are spread over the tiles they touch, which turns the range condition into an
    equi-join; ``tile`` should be about a box side.
    """
    def t(c: Column) -> Column:
        return F.floor(c / tile)

    spread = boxes.withColumn("_tx", F.explode(F.sequence(t(F.col("xmin")), t(F.col("xmax"))))).withColumn(
        "_ty", F.explode(F.sequence(t(F.col("ymin")), t(F.col("ymax")))))
    placed = points.withColumn("_tx", t(F.col(x))).withColumn("_ty", t(F.col(y)))
    hit = placed.join(spread.select(key, "xmin", "xmax", "ymin", "ymax", "_tx", "_ty"), ["_tx", "_ty"]).where(
        F.col(x).between(F.col("xmin"), F.col("xmax")) & F.col(y).between(F.col("ymin"), F.col("ymax")))
    return boxes.join(hit.groupBy(key).agg(*aggregates), key, "left")


def best_cover(windows: DataFrame, tiles: DataFrame, *, key: str, cell: float) -> DataFrame:
    """Per window the covering box with the largest overlap share, then holding the centre, then smaller.

    Both sides carry xmin..ymax; windows and boxes meet on shared grid cells of size ``cell``. A pair counts in the cell
    that holds the lower left corner of its overlap, so pairs are neither held nor moved to find those met twice.
    """
    def spread(df: DataFrame) -> DataFrame:
        return df.withColumn("_tx", F.explode(F.sequence(F.floor(F.col("xmin") / cell), F.floor(F.col("xmax") / cell)))).withColumn(
            "_ty", F.explode(F.sequence(F.floor(F.col("ymin") / cell), F.floor(F.col("ymax") / cell))))

    t = tiles.select("tile", *[F.col(c).alias(f"t_{c}") for c in ("xmin", "ymin", "xmax", "ymax")],
                     "xmin", "ymin", "xmax", "ymax")
    # adaptive execution would size the tasks by the rows before they are paired
    tasks = max(2 * windows.sparkSession.sparkContext.defaultParallelism, -(-windows.count() // WINDOWS_A_TASK))
    met = spread(windows).select(key, "xmin", "ymin", "xmax", "ymax", "_tx", "_ty").repartition(tasks, "_tx", "_ty").join(
        spread(t).drop("xmin", "ymin", "xmax", "ymax").repartition(tasks, "_tx", "_ty"), ["_tx", "_ty"]).where(
        (F.floor(F.greatest("xmin", "t_xmin") / cell) == F.col("_tx")) & (F.floor(F.greatest("ymin", "t_ymin") / cell) == F.col("_ty")))
    w = F.least("xmax", "t_xmax") - F.greatest("xmin", "t_xmin")
    h = F.least("ymax", "t_ymax") - F.greatest("ymin", "t_ymin")
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    cx, cy = (F.col("xmin") + F.col("xmax")) / 2.0, (F.col("ymin") + F.col("ymax")) / 2.0
    centre = cx.between(F.col("t_xmin"), F.col("t_xmax")) & cy.between(F.col("t_ymin"), F.col("t_ymax"))
    tile_area = (F.col("t_xmax") - F.col("t_xmin")) * (F.col("t_ymax") - F.col("t_ymin"))
    scored = met.where((w > 0) & (h > 0) & (area > 0)).withColumn("cover", w * h / area)
    # the order of the fields is that of the choice; the best of a cell is found where its pairs are made
    choice = F.max(F.struct("cover", centre.cast("int").alias("c"), (-tile_area).alias("a"), F.col("tile"))).alias("_b")
    best = scored.groupBy("_tx", "_ty", key).agg(choice).groupBy(key).agg(F.max("_b").alias("_b")).select(key, "_b.tile", "_b.cover")
    return windows.join(best, key, "left").withColumn("tile", F.coalesce("tile", F.lit(""))).withColumn(
        "cover", F.coalesce("cover", F.lit(0.0)))


def k_neighbours(points: DataFrame, *, k: int = 21, x="easting", y="northing", id_col="pixel_id", values: list[str] = (),
                 tile: float = 408.0, identifiers: bool = True, lists: bool = False) -> DataFrame:
    """The k nearest rows of every distinct position (itself included), ties by identifier; with ``lists`` one row per position."""
    refs = points.select(F.col(x).alias("_rx"), F.col(y).alias("_ry"), F.col(id_col).alias("_rid"), *values).dropna(
        subset=["_rx", "_ry"])
    payload = ["_rx", "_ry", *(["_rid"] if identifiers else []), *values]
    return k_nearest_rows(refs, key=[x, y], x="_rx", y="_ry", tie="_rid", k=k, tile=tile, payload=payload, lists=lists)


def local_contrast(points: DataFrame, variables: list[str], *, k: int = 21, x="easting", y="northing", id_col="pixel_id",
                   tile: float = 408.0) -> DataFrame:
    """Population deviation and plane-fit gradient of each variable over the k nearest rows.

    The neighbours of a position are summed once; each row then shifts the sums by its
    own value. Needs five valid neighbours and a well-conditioned plane for the gradient.
    """
    nb = k_neighbours(points, k=k, x=x, y=y, id_col=id_col, values=variables, tile=tile, identifiers=False)
    dx, dy = F.col("_rx") - F.col(x), F.col("_ry") - F.col(y)
    sums = []
    for v in variables:
        ok = F.col(v).isNotNull()
        parts = {"n": F.lit(1), "sx": dx, "sy": dy, "sxx": dx * dx, "syy": dy * dy, "sxy": dx * dy,
                 "sxz": dx * F.col(v), "syz": dy * F.col(v)}
        sums += [F.sum(F.when(ok, e)).alias(f"_{n}_{v}") for n, e in parts.items()]
        sums.append(F.stddev_pop(v).alias(f"_sd_{v}"))
    out = points.join(nb.groupBy(x, y).agg(*sums), [x, y], "left")
    for v in variables:
        c = {n: F.col(f"_{n}_{v}") for n in ("n", "sx", "sy", "sxx", "syy", "sxy", "sxz", "syz")}
        z = F.col(v)
        sxz, syz = c["sxz"] - z * c["sx"], c["syz"] - z * c["sy"]
        det = c["sxx"] * c["syy"] - c["sxy"] * c["sxy"]
        good = z.isNotNull() & (c["n"] >= 5) & (F.abs(det) > 1e-12)
        bx, by = F.try_divide(sxz * c["syy"] - syz * c["sxy"], det), F.try_divide(syz * c["sxx"] - sxz * c["sxy"], det)
        out = out.withColumn(f"{v}__lstd", F.when(z.isNotNull(), F.col(f"_sd_{v}"))).withColumn(
            f"{v}__gmag", F.when(good, F.sqrt(bx * bx + by * by)))
    return out.drop(*[c for c in out.columns if c.startswith("_")])
