"""Selection of windows of interest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tailfield.constants import GRID
from tailfield.functions.geo import centre_of
from tailfield.operators.grid import with_cell
from tailfield.operators.ordering import exact_quantiles
from tailfield.operators.relational import candidate_filter
from tailfield.session import materialise, small_table

COPIES_A_TASK = 1_000_000  # of cells, in box_statistics

def hotspot() -> Column:
    """1 at or beyond the permafrost thresholds of either target."""
    hit = F.coalesce(F.col("d_u") <= -16.5, F.lit(False)) | F.coalesce(F.col("grad_mag_km") >= 30.5, F.lit(False))
    return hit.cast("int")


def window_score() -> Column:
    du = F.greatest(-F.coalesce("d_u", F.lit(0.0)), F.lit(0.0))
    grad = F.greatest(F.coalesce("grad_mag_km", F.lit(0.0)), F.lit(0.0))
    return hotspot() * 2.5 + du / 20.0 + grad / 30.0


def _between(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def _near(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(999.0))


def proximity_bonus(kind: str) -> Column:
    if kind == "transition":
        return _between(F.lit(5.0) - _near("boundary_distance_km"), 0.0, 5.0) / 5.0
    if kind == "near_tl":
        return _between(F.lit(2.0) - _near("tl_distance_km"), 0.0, 2.0) / 2.0
    if kind == "near_rts":
        return _between(F.lit(2.0) - _near("rts_distance_km"), 0.0, 2.0) / 2.0
    return _between(_near("boundary_distance_km"), 5.0, 20.0) / 20.0 + _between(_near("tlrts_distance_km"), 2.0, 10.0) / 20.0


def score_candidates(df: DataFrame, kind: str, cell_m: float = 12_000.0) -> DataFrame:
    """Candidate cells with median centre, counts and scores; the caller orders them.

    Medians are exact and never gather a cell in one task: they go through the same
    counted brackets as every other quantile.
    """
    sub = df.where(candidate_filter(kind)).withColumn("hotspot", hotspot()).withColumn(
        "score", window_score() + proximity_bonus(kind)).withColumn(
        "cell_x", F.floor(F.col("easting") / cell_m)).withColumn("cell_y", F.floor(F.col("northing") / cell_m))
    by = ["cell_x", "cell_y"]
    out = sub.groupBy(*by).agg(F.count("*").alias("n_points"), F.sum("hotspot").alias("n_hotspots"), F.avg("score").alias("mean_score"),
                               F.max("score").alias("max_score"))
    axes = sub.unpivot(by, ["easting", "northing"], "_axis", "_v")
    middle = F.get("quantiles", F.lit(0))
    medians = exact_quantiles(axes, "_v", [0.5], [*by, "_axis"]).groupBy(*by).agg(
        *[F.max(F.when(F.col("_axis") == c, middle)).alias(f"center_{c}") for c in ("easting", "northing")])
    return out.join(medians, by)


CANDIDATE_ORDER = ("n_hotspots", "mean_score", "n_points", "max_score")


def greedy_windows(candidates: DataFrame, order: list[Column], n: int, spacing: float, *, x: str, y: str, payload: list[str]) -> DataFrame:
    """Best-first choice of ``n`` rows pairwise at least ``spacing`` apart.

    Each round takes the best remaining row, a top-1 over the distributed table, and drops
    the rows around it; ``n`` is a handful of windows for a figure.
    """
    spark = candidates.sparkSession
    rest, rows = candidates, []
    for i in range(n):
        best = rest.orderBy(*order).select(x, y, *payload).first()
        if best is None:
            break
        rows.append((i + 1, *[best[c] for c in (x, y, *payload)]))
        rest = rest.where(F.pow(F.col(x) - best[x], 2) + F.pow(F.col(y) - best[y], 2) >= spacing * spacing)
    types = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    ddl = ", ".join(["pick int", *[f"{c} {types[c]}" for c in (x, y, *payload)]])
    return small_table(spark, ddl, rows) if rows else candidates.select(F.lit(0).alias("pick"), x, y, *payload).limit(0)


def windows_per_kind(df: DataFrame, kinds: list[str], *, window_km: float = 24.0, spacing_km: float = 35.0, cell_m: float = 12_000.0,
                     tiles: DataFrame | None = None, min_cover: float = 0.75) -> DataFrame:
    """One window per kind: the best candidate far enough from earlier picks, well covered ones first.

    Without a spaced candidate the best one is taken. The loop runs over a few kinds.
    """
    from tailfield.operators.spatial import best_cover

    rows = []
    for kind in kinds:
        cand = score_candidates(df, kind, cell_m).withColumn("key", F.concat_ws("_", "cell_x", "cell_y"))
        half = window_km * 500.0
        cand = cand.withColumns({"xmin": F.col("center_easting") - half, "xmax": F.col("center_easting") + half,
                                 "ymin": F.col("center_northing") - half, "ymax": F.col("center_northing") + half})
        cand = best_cover(cand, tiles, key="key", cell=window_km * 1000.0) if tiles is not None else cand.withColumn(
            "tile", F.lit("")).withColumn("cover", F.lit(0.0))
        free = F.lit(True)
        for r in rows:
            free = free & (F.pow(F.col("center_easting") - r[1], 2) + F.pow(F.col("center_northing") - r[2], 2) >= (spacing_km * 1000.0) ** 2)
        good = F.col("cover") >= min_cover
        class_ = F.when(free & good, 0).when(free, 1).when(good, 2).otherwise(3)
        order = [class_, *[F.desc(c) for c in CANDIDATE_ORDER], "key"]
        best = cand.orderBy(*order).first()
        if best is not None:
            rows.append((kind, best["center_easting"], best["center_northing"], best["n_points"], best["n_hotspots"], best["mean_score"],
                         best["tile"], best["cover"]))
    return small_table(df.sparkSession, "window_key string, center_easting_m double, center_northing_m double, n_points bigint,"
                       " n_hotspots bigint, mean_score double, tile string, cover double", rows)


def box_statistics(cells: DataFrame, radius: int, score: str, hot: str) -> DataFrame:
    """For every occupied (row, col) cell the counts and scores of the cells within ``radius`` rows and columns.

    Rows are summed per cell first. Cells move once, to square blocks with a margin of the radius; there one pass sends a
    cell to the 2r+1 columns around it and the other slides along each column. The copies grow with the radius, not its
    square, and stay in their task; tasks follow the number of cells.
    """
    own = cells.groupBy("row", "col").agg(
        F.count("*").alias("n"), F.sum(hot).alias("h"), F.sum(score).alias("s"), F.count(score).alias("sn"), F.max(score).alias("m"))
    side = 4 * radius + 4

    def blocks(c: str) -> Column:
        return F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + k) / side) for k in (-radius, 0, radius)])))

    # adaptive execution would size the tasks by the cells before they are copied
    tasks = max(2 * cells.sparkSession.sparkContext.defaultParallelism, -(-own.count() * (2 * radius + 1) // COPIES_A_TASK))
    held = own.withColumn("_tr", blocks("row")).withColumn("_tc", blocks("col")).repartition(tasks, "_tr", "_tc")
    reach = F.explode(F.sequence(F.col("col") - radius, F.col("col") + radius)).alias("_c")
    wide = held.select("*", reach).where(F.floor(F.col("_c") / side) == F.col("_tc")).groupBy("_tr", "_tc", "row", "_c").agg(
        *[F.sum(c).alias(c) for c in ("n", "h", "s", "sn")], F.max("m").alias("m"), F.max(F.col("_c") == F.col("col")).alias("_here"))
    w = Window.partitionBy("_tr", "_tc", "_c").orderBy("row").rangeBetween(-radius, radius)
    slid = wide.select("_tr", "_here", "row", F.col("_c").alias("col"), F.sum("n").over(w).alias("n_points"), F.sum("h").over(w).alias("n_hotspots"),
                       (F.sum("s").over(w) / F.sum("sn").over(w)).alias("mean_score"), F.max("m").over(w).alias("max_score"))
    return slid.where(F.col("_here") & (F.floor(F.col("row") / side) == F.col("_tr"))).drop("_tr", "_here")


class TooFewWindows(RuntimeError):
    """Fewer windows fit than were asked for."""


def zoom_windows(df: DataFrame, *, n: int, half: float, spacing: float, min_points: int, min_hotspots: int, score: str, hot: str,
                 second: str, forbidden: list[tuple[float, float, float, float]] = (), relaxed: bool = True, grid: dict = GRID,
                 floors: tuple[int, int] = (80, 5), least_spacing: float = 120_000.0) -> DataFrame:
    """Windows around the best-scored rows that hold enough rows and hotspots and avoid given boxes.

    Boxes that fail never block others, so failing rows are removed first. When fewer than
    ``n`` windows result and ``relaxed``, half the counts are asked for (no less than ``floors``)
    at 0.8 of the spacing (no less than ``least_spacing``). Fewer than ``n`` in the end is an error.
    """
    cells = with_cell(df, grid=grid)
    stats = box_statistics(cells, int(half // grid["res"]), score, hot)
    best = cells.groupBy("row", "col").agg(
        F.max(F.struct(F.col(score).alias("s"), F.coalesce(second, F.lit(float("-inf"))).alias("t"))).alias("b"))
    x, y = centre_of("row", "col", grid)
    rows = stats.join(best, ["row", "col"]).select(
        x.alias("easting"), y.alias("northing"), "n_points", "n_hotspots", "mean_score", "max_score", F.col("b.s").alias("_score"),
        F.col("b.t").alias("_second"))
    for x0, x1, y0, y1 in forbidden:
        rows = rows.where((F.col("easting") + half < x0) | (F.col("easting") - half > x1) | (F.col("northing") + half < y0) | (F.col("northing") - half > y1))
    rows = materialise(rows)
    order = [F.desc("_score"), F.desc("_second"), F.col("easting"), F.col("northing")]
    payload = ["n_points", "n_hotspots", "mean_score", "max_score"]

    def choose(points: int, hots: int, apart: float) -> DataFrame:
        ok = rows.where((F.col("n_points") >= points) & (F.col("n_hotspots") >= hots))
        return greedy_windows(ok, order, n, apart, x="easting", y="northing", payload=payload)

    out = choose(min_points, min_hotspots, spacing)
    if relaxed and out.count() < n:
        out = choose(max(floors[0], min_points // 2), max(floors[1], min_hotspots // 2), max(least_spacing, 0.8 * spacing))
    if out.count() < n:
        raise TooFewWindows(f"{out.count()} of {n} windows hold enough rows and hotspots")
    return out.withColumns({
        "xmin": F.col("easting") - half, "xmax": F.col("easting") + half, "ymin": F.col("northing") - half, "ymax": F.col("northing") + half,
        "hotspot_fraction": F.col("n_hotspots") / F.col("n_points")})


def fixed_windows(spark: SparkSession, df: DataFrame, specs: list[tuple], tiles: DataFrame) -> DataFrame:
    """Scores and cover of given windows (key, label, kind, x, y, size_km, tile): empty windows give 0, 0, NULL."""
    from tailfield.operators.spatial import count_in_boxes

    table = small_table(spark, "window_key string, window_label string, kind string, center_easting_m double, center_northing_m double,"
                        " window_size_km double, tile string", specs)
    half = F.col("window_size_km") * 500.0
    boxes = table.withColumns({"xmin": F.col("center_easting_m") - half, "xmax": F.col("center_easting_m") + half,
                               "ymin": F.col("center_northing_m") - half, "ymax": F.col("center_northing_m") + half})
    kinds = sorted({s[2] for s in specs})
    tagged = df.withColumn("_kinds", F.filter(F.array(*[F.when(candidate_filter(k), F.lit(k)) for k in kinds]), lambda k: k.isNotNull()))
    rows = tagged.withColumn("_kind", F.explode("_kinds")).withColumn("_hot", hotspot()).withColumn("_score", window_score())
    out = None
    for kind in kinds:
        part = count_in_boxes(rows.where(F.col("_kind") == kind), boxes.where(F.col("kind") == kind), [
            F.count("*").alias("n_points"), F.sum("_hot").alias("n_hotspots"), F.avg("_score").alias("mean_score")],
            key="window_key", tile=max(s[5] for s in specs) * 1000.0)
        out = part if out is None else out.unionByName(part)
    t = tiles.select("tile", *[F.col(c).alias(f"t_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    joined = out.join(t, "tile", "left")
    w = F.greatest(F.least("xmax", "t_xmax") - F.greatest("xmin", "t_xmin"), F.lit(0.0))
    h = F.greatest(F.least("ymax", "t_ymax") - F.greatest("ymin", "t_ymin"), F.lit(0.0))
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    cover = F.when(F.col("t_xmin").isNull(), 0.0).otherwise(w * h / area)
    return joined.select(
        "window_key", "window_label", "center_easting_m", "center_northing_m", "window_size_km",
        F.coalesce("n_points", F.lit(0)).alias("n_points"), F.coalesce("n_hotspots", F.lit(0)).alias("n_hotspots"), "mean_score", "tile",
        cover.alias("cover"))


def _starts(lo: float, hi: float, step: float) -> list[float]:
    """lo, lo + step, ... below hi."""
    return [lo + i * step for i in range(max(0, math.ceil((hi - lo) / step)))]


def _positions_holding(value: Column, starts: list[float], width: float, step: float) -> Column:
    """Indexes of the evenly spaced starts whose closed interval holds the value."""
    first = F.greatest(F.ceil((value - starts[0] - width) / step) - 1, F.lit(0))
    last = F.least(F.floor((value - starts[0]) / step) + 1, F.lit(len(starts) - 1))
    table = F.array(*[F.lit(s) for s in starts])
    span = F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.filter(span, lambda i: (F.get(table, i) <= value) & (F.get(table, i) + width >= value))


def sliding_counts(points: DataFrame, xs: list[float], ys: list[float], width: float, height: float, step_x: float, step_y: float,
                   aggregates: list[Column], x: str = "x", y: str = "y") -> DataFrame:
    """Aggregates per sliding window that holds any point; a point goes to the few windows around it."""
    placed = points.withColumn("ix", F.explode(_positions_holding(F.col(x), xs, width, step_x))).withColumn(
        "iy", F.explode(_positions_holding(F.col(y), ys, height, step_y)))
    return placed.groupBy("ix", "iy").agg(*aggregates)


def search_focus(points: DataFrame, edges: DataFrame, extent: tuple[float, float, float, float], crop: float, bonus: float) -> DataFrame:
    """The window of a share of the extent with the most points, plus a bonus where a line crosses it.

    The candidate grid comes from the extent and is small; ties go to the first in x, then y.
    """
    from tailfield.operators.spatial import split_edges

    xmin, xmax, ymin, ymax = extent
    w, h = (xmax - xmin) * crop, (ymax - ymin) * crop
    sx, sy = max(1500.0, 0.18 * w), max(1500.0, 0.18 * h)
    xs = [min(xmax, v + w) - w for v in _starts(xmin, max(xmin, xmax - w) + sx * 0.5, sx)]
    ys = [min(ymax, v + h) - h for v in _starts(ymin, max(ymin, ymax - h) + sy * 0.5, sy)]
    x_at, y_at = F.array(*[F.lit(v) for v in xs]), F.array(*[F.lit(v) for v in ys])

    def holders(value: Column, starts: Column, size: float) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(starts) - 1), lambda i: (F.get(starts, i) <= value) & (F.get(starts, i) + size >= value))

    counts = points.withColumn("ix", F.explode(holders(F.col("x"), x_at, w))).withColumn("iy", F.explode(holders(F.col("y"), y_at, h))).groupBy(
        "ix", "iy").agg(F.count("*").alias("n"))
    # a line meets a box when one of its pieces, clipped to the box, keeps some length
    reach = split_edges(edges, min(w, h)).select("x1", "y1", "x2", "y2", "mx", "my").withColumn(
        "ix", F.explode(F.filter(F.sequence(F.lit(0), F.size(x_at) - 1), lambda i: (F.get(x_at, i) <= F.greatest("x1", "x2")) & (F.get(x_at, i) + w >= F.least("x1", "x2"))))).withColumn(
        "iy", F.explode(F.filter(F.sequence(F.lit(0), F.size(y_at) - 1), lambda i: (F.get(y_at, i) <= F.greatest("y1", "y2")) & (F.get(y_at, i) + h >= F.least("y1", "y2"))))).drop("mx", "my").distinct()
    bx, by = F.get(x_at, F.col("ix")), F.get(y_at, F.col("iy"))
    t0, t1 = F.lit(0.0), F.lit(1.0)
    for p, d, lo, hi in ((F.col("x1"), F.col("x2") - F.col("x1"), bx, bx + w), (F.col("y1"), F.col("y2") - F.col("y1"), by, by + h)):
        a, b = (lo - p) / F.nullif(d, F.lit(0.0)), (hi - p) / F.nullif(d, F.lit(0.0))
        t0 = F.greatest(t0, F.coalesce(F.least(a, b), F.lit(0.0)))
        t1 = F.least(t1, F.coalesce(F.greatest(a, b), F.lit(1.0)))
    crossed = reach.where(t0 <= t1).select("ix", "iy").distinct().withColumn("_hit", F.lit(float(bonus)))
    frame = points.sparkSession.range(len(xs)).select(F.col("id").cast("int").alias("ix"), F.explode(F.sequence(F.lit(0), F.lit(len(ys) - 1))).alias("iy"))
    scored = frame.join(counts, ["ix", "iy"], "left").join(crossed, ["ix", "iy"], "left").withColumn(
        "score", F.coalesce("n", F.lit(0)) + F.coalesce("_hit", F.lit(0.0)))
    best = scored.agg(F.max_by(F.struct("ix", "iy"), F.struct("score", -F.col("ix"), -F.col("iy"))).alias("b"), F.max("score").alias("score"))
    px, py = F.get(x_at, F.col("b.ix")), F.get(y_at, F.col("b.iy"))
    return best.select(px.alias("xmin"), (px + w).alias("xmax"), py.alias("ymin"), (py + h).alias("ymax"), "score")


def window_with_both(lakes: DataFrame, slumps: DataFrame, bounds: tuple[float, float, float, float], *, width: float = 30_000.0,
                     height: float = 45_000.0, step: float = 5_000.0, weight: int = 12, xpad: float = 2_500.0, ypad: float = 3_000.0) -> DataFrame:
    """The window holding both kinds with the largest lakes + weight * slumps, padded; first in x, then y on ties."""
    xmin, xmax, ymin, ymax = bounds
    xs, ys = _starts(xmin, xmax + step, step), _starts(ymin, ymax + step, step)
    both = lakes.select("x", "y", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(slumps.select("x", "y", F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = sliding_counts(both, xs, ys, width, height, step, step, [F.sum("a").alias("lakes"), F.sum("b").alias("slumps")])
    scored = counts.where("lakes > 0 AND slumps > 0").withColumn("score", F.col("lakes") + F.col("slumps") * weight)
    best = scored.agg(F.max_by(F.struct("ix", "iy", "lakes", "slumps", "score"), F.struct("score", -F.col("ix"), -F.col("iy"))).alias("b")).select("b.*")
    x0, y0 = F.lit(xmin) + F.col("ix") * step, F.lit(ymin) + F.col("iy") * step
    return best.where("ix IS NOT NULL").select(
        (x0 - xpad).alias("xmin"), (x0 + width + xpad).alias("xmax"), (y0 - ypad).alias("ymin"), (y0 + height + ypad).alias("ymax"),
        "lakes", "slumps", "score")


def crop_after_search(focus: DataFrame, points: DataFrame, extent: tuple[float, float, float, float], nudge: float, lift: float = 0.0) -> DataFrame:
    """The found window moved a share ``nudge`` of the way to the centre of the points' bounds, ``lift`` of its height up, and kept within the extent.

    ``focus`` has one row, as ``search_focus`` gives it, and no point beyond the extent counts; without any point
    the window stays where it is, within the extent.
    """
    xmin, xmax, ymin, ymax = extent
    inside = points.where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax)).agg(
        ((F.min("x") + F.max("x")) * 0.5).alias("_cx"), ((F.min("y") + F.max("y")) * 0.5).alias("_cy"))
    rows = focus.withColumn("_cx", inside.select("_cx").scalar()).withColumn("_cy", inside.select("_cy").scalar())
    dx = F.coalesce((F.col("_cx") - (F.col("xmin") + F.col("xmax")) * 0.5) * nudge, F.lit(0.0))
    dy = F.coalesce((F.col("_cy") - (F.col("ymin") + F.col("ymax")) * 0.5) * nudge + (F.col("ymax") - F.col("ymin")) * lift, F.lit(0.0))
    width, height = F.least(F.col("xmax") - F.col("xmin"), F.lit(xmax - xmin)), F.least(F.col("ymax") - F.col("ymin"), F.lit(ymax - ymin))
    x = F.least(F.greatest(F.col("xmin") + dx, F.lit(float(xmin))), F.lit(float(xmax)) - width)
    y = F.least(F.greatest(F.col("ymin") + dy, F.lit(float(ymin))), F.lit(float(ymax)) - height)
    return rows.select(x.alias("xmin"), (x + width).alias("xmax"), y.alias("ymin"), (y + height).alias("ymax"), "score")
