"""Exact nearest-neighbour joins without comparing everything with everything.

Space is cut into tiles. Two small tables, the tiles that hold query points and the
tiles that hold references, are walked from one common root tile down to the leaf
size. At each level a pair of tiles survives when its smallest possible distance does
not exceed an upper bound on the distance to the k-th nearest reference of that query
tile. Only the leaf pairs are joined with points. The pruning never discards a true
neighbour, however far it is, and each step is an equi-join.

Query points are reduced to distinct positions first, so that a position shared by
many rows is solved once; references at one position are reduced to the k of them
that can appear in any answer.

``edge_distances`` is the kernel of distances to edges in blocks (``spatial.feature_distances``).

``k_nearest_rows`` pairs a table with itself. Its rows move once, to blocks of tiles with
a margin, where Arrow batches are searched; only positions whose surroundings hold fewer
than k rows, and blocks with very many rows, take the general way.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tailfield.session import materialise

STEP = 2
BLOCK = 64  # tiles along a side of a block
AROUND = 2  # tiles on each side of a tile that must hold k rows
BLOCK_ROWS = 100_000  # with its margin; denser blocks take the general way
ROWS_A_TASK = 200_000  # in k_nearest_rows, before margins
PAIRS = 1 << 21  # distances held at once
EDGE_PAIRS = 1 << 17  # the same, to edges


def candidate_tiles(queries: DataFrame, refs: DataFrame, dims: int, levels: int, size: float, k: int = 1,
                    slack: float = 0.0) -> DataFrame:
    """Leaf tile pairs ``_q*``/``_r*`` that may hold one of the k nearest references.

    ``queries`` and ``refs`` list leaf tiles ``_t*``; ``refs`` also carries the number of
    references ``_n``. ``slack`` is how far a reference may reach beyond its tile.
    """
    axes = range(dims)

    def at(df: DataFrame, shift: int, prefix: str, parent: bool) -> DataFrame:
        own = {f"{prefix}{i}": F.shiftright(f"_t{i}", shift) for i in axes}
        cols = [c.alias(n) for n, c in own.items()]
        if parent:
            cols += [F.shiftright(f"_t{i}", shift + STEP).alias(f"{prefix}p{i}") for i in axes]
        keys = [c for c in own] + ([f"{prefix}p{i}" for i in axes] if parent else [])
        if "_n" in df.columns:
            return df.select(*cols, "_n").groupBy(*keys).agg(F.sum("_n").alias("_n"))
        return df.select(*cols).distinct()

    root = levels * STEP
    q, r = at(queries, root, "_q", False), at(refs, root, "_r", False).drop("_n")
    pairs = q.join(r, [F.col(f"_q{i}") == F.col(f"_r{i}") for i in axes])
    for level in range(levels - 1, -1, -1):
        shift = level * STEP
        q, r = at(queries, shift, "_q", True), at(refs, shift, "_r", True)
        up = pairs.select(*[F.col(f"_q{i}").alias(f"_qp{i}") for i in axes],
                          *[F.col(f"_r{i}").alias(f"_rp{i}") for i in axes])
        joined = up.join(q, [f"_qp{i}" for i in axes]).join(r, [f"_rp{i}" for i in axes])
        gaps = [F.abs(F.col(f"_q{i}") - F.col(f"_r{i}")) for i in axes]
        near = reduce(lambda a, b: a + b, [F.greatest(g - 1, F.lit(0)) * F.greatest(g - 1, F.lit(0)) for g in gaps])
        far = reduce(lambda a, b: a + b, [(g + 1) * (g + 1) for g in gaps])
        sized = joined.withColumn("_near", F.sqrt(near)).withColumn("_far", F.sqrt(far))
        w = Window.partitionBy(*[f"_q{i}" for i in axes])
        if k == 1:
            bound = F.min("_far").over(w)
        else:
            got = F.sum("_n").over(w.orderBy("_far").rangeBetween(Window.unboundedPreceding, Window.currentRow))
            sized = sized.withColumn("_got", got)
            bound = F.coalesce(F.min(F.when(F.col("_got") >= k, F.col("_far"))).over(w), F.lit(float("inf")))
        side = size * (1 << shift)
        pairs = sized.withColumn("_bound", bound).where(
            F.col("_near") <= F.col("_bound") + 2.0 * slack / side
        ).select(*[f"_q{i}" for i in axes], *[f"_r{i}" for i in axes])
    return pairs


def _euclid2(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda u, v: u + v, [(x - y) * (x - y) for x, y in zip(a, b, strict=True)])


def nearest(
    queries: DataFrame, refs: DataFrame, *, key: list[str], query_coords: list[Column], ref_coords: list[Column],
    payload: list[str], distance2: Column, tile: float, tie: str, k: int = 1, slack: float = 0.0,
    from_point: Callable[[list[Column]], Column] | None = None, rank_tie: list[str] = (), only_distance: bool = False,
) -> DataFrame:
    """The k nearest references of every distinct query position.

    ``key`` are the columns that identify a position, ``payload`` the reference columns
    that ``distance2`` (squared distance or any increasing function of it) and the caller
    need, ``tie`` the reference column that orders equal distances. ``from_point`` gives the
    squared straight distance from coordinates to a reference (to ``ref_coords`` by default).
    Output: ``key``, ``payload``, ``d2`` and, for k > 1, ``rank``; or ``key`` and ``d2``.
    """
    dims = range(len(query_coords))
    tiles = [f"_t{i}" for i in dims]

    def placed_on_tiles(df: DataFrame, coords: list[Column]) -> DataFrame:
        return df.withColumns({t: F.floor(c / F.lit(tile)) for t, c in zip(tiles, coords, strict=True)})

    if k > 1:
        same = Window.partitionBy(*rank_tie).orderBy(tie)
        refs = refs.withColumn("_rn", F.row_number().over(same)).where(F.col("_rn") <= k).drop("_rn")
    q = queries.select(*key).dropna().distinct()
    leaf_q = materialise(placed_on_tiles(queries.select(*key).dropna(), query_coords).select(*tiles).distinct())
    leaf_r = materialise(placed_on_tiles(refs, ref_coords).groupBy(*tiles).agg(F.count("*").alias("_n")))
    # one row: the tile range decides the number of levels
    spans = leaf_q.select(*tiles).unionByName(leaf_r.select(*tiles)).agg(
        *[f(t).alias(f"{n}{t}") for t in tiles for n, f in (("a", F.min), ("b", F.max))]).first()
    low = {t: spans[f"a{t}"] or 0 for t in tiles}
    reach = max((spans[f"b{t}"] or 0) - low[t] + 1 for t in tiles)
    levels = max(1, math.ceil(math.log2(reach + 1) / STEP))

    def rebased(df: DataFrame) -> DataFrame:
        return df.withColumns({t: F.col(t) - F.lit(low[t]) for t in tiles})

    pairs = candidate_tiles(rebased(leaf_q), rebased(leaf_r), len(tiles), levels, tile, k, slack)
    held = rebased(placed_on_tiles(refs, ref_coords)).withColumns(
        {f"_c{i}": c for i, c in enumerate(ref_coords)} if from_point is None else {})
    spots = [f"_c{i}" for i in dims] if from_point is None else []
    held = held.select(*[F.col(f"_t{i}").alias(f"_r{i}") for i in dims], *spots, *payload)
    owner = [f"_q{i}" for i in dims]
    near = pairs.join(held, [f"_r{i}" for i in dims]).select(*owner, *spots, *payload)
    if from_point is not None:
        near = near.distinct()
    # A reference is at most one half diagonal closer to, or further from, a point of the tile than from its centre.
    centre = [(F.col(f"_q{i}") + F.lit(low[f"_t{i}"] + 0.5)) * F.lit(tile) for i in dims]
    to_centre = from_point(centre) if from_point else _euclid2(centre, [F.col(c) for c in spots])
    w = Window.partitionBy(*owner)
    sized = near.withColumn("_d", F.sqrt(to_centre))
    if k == 1:
        bound = F.min("_d").over(w)
    else:
        sized = sized.withColumn("_o", F.row_number().over(w.orderBy("_d")))
        bound = F.coalesce(F.min(F.when(F.col("_o") == k, F.col("_d"))).over(w), F.lit(float("inf")))
    diagonal = tile * math.sqrt(len(tiles))
    kept = sized.withColumn("_b", bound).where(F.col("_d") <= F.col("_b") + diagonal * (1 + 1e-9)).select(*owner, *payload)

    placed = rebased(placed_on_tiles(q, query_coords)).select(*[F.col(f"_t{i}").alias(f"_q{i}") for i in dims], *key)
    matched = placed.join(kept, owner).withColumn("d2", distance2)
    if only_distance:
        return matched.groupBy(*key).agg(F.min("d2").alias("d2"))
    if k == 1:
        best = F.min_by(F.struct("d2", *payload), F.struct("d2", tie)).alias("b")
        return matched.groupBy(*key).agg(best).select(*key, "b.*")
    order = Window.partitionBy(*key).orderBy("d2", tie)
    return matched.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        *key, *payload, "d2", "rank")


def block_neighbours(x: np.ndarray, y: np.ndarray, wanted: np.ndarray, k: int, tile: float, reach: float):
    """The k nearest of the points for each of the ``wanted`` ones, nearer first, then by place: yields (wanted, found, squared distance).

    Each of them has k points within ``reach``. Three by three tiles are searched at once, with a margin of two tiles first.
    """
    if not len(wanted):
        return
    square = np.floor(np.stack([x[wanted], y[wanted]]) / (3 * tile))
    order = np.lexsort(square)
    wanted, square = wanted[order], square[:, order]
    starts = np.flatnonzero(np.append(True, (square[:, 1:] != square[:, :-1]).any(axis=0)))
    by_y = np.argsort(y)
    sorted_y = y[by_y]
    for a, b in zip(starts, np.append(starts[1:], len(wanted)), strict=True):
        left = wanted[a:b]
        for margin in (min(2 * tile, reach), reach):
            low_x, high_x, low_y, high_y = x[left].min() - margin, x[left].max() + margin, y[left].min() - margin, y[left].max() + margin
            near = by_y[np.searchsorted(sorted_y, low_y):np.searchsorted(sorted_y, high_y, "right")]
            near = np.sort(near[(x[near] >= low_x) & (x[near] <= high_x)])
            if len(near) < k:
                continue
            later = []
            step = max(1, PAIRS // len(near))
            for c in range(0, len(left), step):
                some = left[c:c + step]
                dx, dy = x[some, None] - x[near], y[some, None] - y[near]
                d2 = dx * dx + dy * dy
                first = np.argsort(d2, axis=1, kind="stable")[:, :k]
                d2 = np.take_along_axis(d2, first, 1)
                done = (d2[:, -1] < margin * margin) | (margin == reach)
                later.append(some[~done])
                yield some[done], near[first[done]], d2[done]
            left = np.concatenate(later)
            if not len(left):
                break


def k_nearest_rows(rows: DataFrame, *, key: list[str], x: str, y: str, tie: str, k: int, tile: float, payload: list[str],
                   lists: bool = False) -> DataFrame:
    """The k nearest rows of every distinct position of ``rows``: ``key`` (the position), ``payload``, ``d2`` and ``rank``.

    ``x`` and ``y`` are the coordinates, ``tie`` a column of text that orders equal distances. With ``lists`` there is one row
    per position, with the list ``near`` of (``payload``, ``d2``) by rank, so that nothing has to be grouped again.
    """
    reach = (AROUND + 1) * tile * math.sqrt(2.0) * (1 + 1e-9)

    def block(c: Column) -> Column:
        return F.floor(c / F.lit(BLOCK * tile))

    def blocks(low: Column, high: Column) -> Column:
        return F.sequence(block(low), block(high))

    leaves = materialise(rows.groupBy(F.floor(F.col(x) / tile).alias("_tx"), F.floor(F.col(y) / tile).alias("_ty")).agg(F.count("*").alias("_n")))
    around = leaves.withColumn("_n", F.least("_n", F.lit(k)))
    for t, other in (("_tx", "_ty"), ("_ty", "_tx")):
        spread = F.explode(F.sequence(F.col(t) - AROUND, F.col(t) + AROUND)).alias(t)
        around = around.select(spread, other, "_n").groupBy("_tx", "_ty").agg(F.sum("_n").alias("_n"))
    sparse = leaves.select("_tx", "_ty").join(around.where(F.col("_n") < k), ["_tx", "_ty"]).select("_tx", "_ty")
    margin = math.ceil(reach / tile)
    in_blocks = [F.explode(F.sequence(F.floor((F.col(t) - margin) / BLOCK), F.floor((F.col(t) + margin) / BLOCK))) for t in ("_tx", "_ty")]
    dense = leaves.withColumn("_bx", in_blocks[0]).withColumn("_by", in_blocks[1]).groupBy("_bx", "_by").agg(F.sum("_n").alias("_n")).where(
        F.col("_n") > BLOCK_ROWS).select("_bx", "_by")
    crowded = leaves.select("_tx", "_ty", F.floor(F.col("_tx") / BLOCK).alias("_bx"), F.floor(F.col("_ty") / BLOCK).alias("_by")).join(
        dense, ["_bx", "_by"]).select("_tx", "_ty")
    hard = materialise(sparse.unionByName(crowded).distinct())
    some_hard, some_dense = not hard.isEmpty(), not dense.isEmpty()
    total = leaves.agg(F.sum("_n")).first()[0] or 0
    # adaptive execution would size the tasks by the rows before they are searched
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-total // ROWS_A_TASK))

    placed = rows.select(x, y, tie, *[c for c in payload if c not in (x, y, tie)])
    lone = placed.withColumn("_tx", F.floor(F.col(x) / tile)).withColumn("_ty", F.floor(F.col(y) / tile))
    easy = lone.join(hard.withColumn("_h", F.lit(True)), ["_tx", "_ty"], "left") if some_hard else lone.withColumn("_h", F.lit(None).cast("boolean"))
    held = easy.drop("_tx", "_ty").withColumn("_bx", F.explode(blocks(F.col(x) - reach, F.col(x) + reach))).withColumn(
        "_by", F.explode(blocks(F.col(y) - reach, F.col(y) + reach)))
    if some_dense:
        held = held.join(dense, ["_bx", "_by"], "left_anti")
    at = Window.partitionBy("_bx", "_by", x, y).orderBy(tie)
    # one exchange: the window and the groups keep the partitions of the blocks
    held = held.repartition(tasks, "_bx", "_by").withColumn("_o", F.row_number().over(at)).where(F.col("_o") <= k).withColumn(
        "_ask", (F.col("_o") == 1) & F.col("_h").isNull() & (block(F.col(x)) == F.col("_bx")) & (block(F.col(y)) == F.col("_by"))).drop("_o", "_h")
    given = {f.name: f for f in rows.schema.fields}
    place = [StructField(key[0], DoubleType()), StructField(key[1], DoubleType())]
    found_of = [*[given[c] for c in payload], StructField("d2", DoubleType())]
    schema = StructType([*place, StructField("near", ArrayType(StructType([StructField(f.name, f.dataType) for f in found_of])))] if lists else [*place, *found_of, StructField("rank", IntegerType())])

    def search(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group[tie]))
        px, py = group[x].to_numpy(), group[y].to_numpy()
        asked, found, d2 = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for a, b, c in block_neighbours(px, py, np.flatnonzero(group["_ask"].to_numpy(zero_copy_only=False)), k, tile, reach):
            asked.append(a), found.append(b.ravel()), d2.append(c.ravel())
        asked, found = np.concatenate(asked), np.concatenate(found)
        taken = group.select(payload).take(pa.array(found))
        if lists:
            near = pa.StructArray.from_arrays([*[c.combine_chunks() for c in taken.columns], pa.array(np.concatenate(d2))], names=[*payload, "d2"])
            ends = pa.array(np.arange(len(asked) + 1, dtype=np.int32) * np.int32(k))
            return pa.table([pa.array(px[asked]), pa.array(py[asked]), pa.ListArray.from_arrays(ends, near)], names=schema.names)
        who = np.repeat(asked, k)
        return pa.table([pa.array(px[who]), pa.array(py[who]), *taken.columns, pa.array(np.concatenate(d2)),
                         pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(asked)))], names=schema.names)

    out = held.groupBy("_bx", "_by").applyInArrow(search, schema)
    if not some_hard:
        return out
    asked = lone.join(hard, ["_tx", "_ty"]).select(F.col(x).alias(key[0]), F.col(y).alias(key[1]))
    dx, dy = F.col(key[0]) - F.col(x), F.col(key[1]) - F.col(y)
    rest = nearest(asked, placed, key=key, query_coords=[F.col(c) for c in key], ref_coords=[F.col(x), F.col(y)], payload=list(dict.fromkeys([x, y, tie, *payload])),
                   distance2=dx * dx + dy * dy, tile=tile, k=k, tie=tie, rank_tie=[x, y])
    if lists:
        rest = rest.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank", F.struct(*payload, "d2").alias("f")))).alias("near")).select(
            *key, F.transform("near", lambda n: n["f"]).alias("near"))
    return out.unionByName(rest.select(*schema.names))


def edge_distances(px: np.ndarray, py: np.ndarray, e: dict[str, np.ndarray], tile: float, reach: float) -> np.ndarray:
    """Distance of each position to the nearest of the pieces ``e``, 0 inside a polygon; NaN where none has its middle within ``reach``.

    ``e`` has the ends ``x1`` to ``y2``, the middles ``mx`` and ``my`` in order of ``my``, the feature's number ``f`` and, for
    edges that count for the inside of a polygon no larger than ``tile``, ``c``. Three by three tiles are searched at once,
    with a margin of one and a half tiles first.
    """
    out = np.full(len(px), np.nan)
    if not len(px) or not len(e["mx"]):
        return out
    square = np.floor(np.stack([px, py]) / (3 * tile))
    order = np.lexsort(square)
    square = square[:, order]
    starts = np.flatnonzero(np.append(True, (square[:, 1:] != square[:, :-1]).any(axis=0)))
    for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
        left = order[a:b]
        for margin in (min(1.5 * tile, reach), reach):
            low_x, high_x, low_y, high_y = px[left].min() - margin, px[left].max() + margin, py[left].min() - margin, py[left].max() + margin
            near = np.arange(np.searchsorted(e["my"], low_y), np.searchsorted(e["my"], high_y, "right"))
            near = near[(e["mx"][near] >= low_x) & (e["mx"][near] <= high_x)]
            if not len(near):
                continue
            near = near[np.argsort(e["f"][near], kind="stable")]
            x1, y1, x2, y2, f, counts = (e[c][near] for c in ("x1", "y1", "x2", "y2", "f", "c"))
            dx, dy = x2 - x1, y2 - y1
            length2 = dx * dx + dy * dy
            features = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
            # a polygon of which the margin holds a part only has no position in its box
            box = [g.reduceat(g(u, v), features) for u, v in ((x1, x2), (y1, y2)) for g in (np.minimum, np.maximum)]
            step = max(1, EDGE_PAIRS // len(near))
            later = []
            for at in range(0, len(left), step):
                some = left[at:at + step]
                x, y = px[some, None], py[some, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    raw = np.where(length2 > 0, ((x - x1) * dx + (y - y1) * dy) / length2, 0.0)
                    crossing = counts & ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) / dy * dx)
                t = np.minimum(np.maximum(raw, 0.0), 1.0)
                ex, ey = x - (x1 + t * dx), y - (y1 + t * dy)
                d = np.sqrt((ex * ex + ey * ey).min(axis=1))
                odd = np.add.reduceat(crossing, features, axis=1, dtype=np.int64) % 2 == 1
                odd &= (x >= box[0]) & (x <= box[1]) & (y >= box[2]) & (y <= box[3])
                d[odd.any(axis=1)] = 0.0
                # a piece farther than the margin by its middle is farther than this by its nearest point
                done = (d <= margin - tile / 2) | (margin == reach)
                out[some[done]] = d[done]
                later.append(some[~done])
            left = np.concatenate(later)
            if not len(left):
                break
    return out
