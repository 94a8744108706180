"""Binned and moving profiles, curve splitting and interpolation, ranks against a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailfield.constants import BOUNDARY_KM
from tailfield.functions.geo import meridional_degree_m
from tailfield.functions.labels import signed_distance
from tailfield.functions.numeric import col
from tailfield.operators.ordering import exact_quantiles, global_row_number, running_totals


def fixed_edge_profile(df: DataFrame, x, value: str, edges: list[float], by: list[str] = (), min_count: int = 20) -> DataFrame:
    """Mean, deviation and standard error per left-closed bin; the last edge is outside, thin bins are dropped.

    Edges are compared as given, so bins agree with the edge list for any step.
    """
    v = col(x)
    width = (edges[-1] - edges[0]) / (len(edges) - 1)
    guess = F.greatest(F.least(F.floor((v - edges[0]) / width), F.lit(len(edges) - 2)), F.lit(0)).cast("int")
    table = F.array(*[F.lit(float(e)) for e in edges])
    # the guess is at most one bin off for evenly spaced edges
    b = F.when(v < F.get(table, guess), guess - 1).when(v >= F.get(table, guess + 1), guess + 1).otherwise(guess)
    out = (
        df.where(v.isNotNull() & F.col(value).isNotNull() & (v >= edges[0]) & (v < edges[-1]))
        .groupBy(*by, b.alias("bin"))
        .agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count("*").alias("n"))
        .where(F.col("n") >= min_count)
    )
    mid = (F.get(table, F.col("bin")) + F.get(table, F.col("bin") + 1)) * 0.5
    return out.select(*by, mid.alias("x"), "mean", "std", (F.col("std") / F.sqrt("n")).alias("se"), "n")


def signed_boundary_profile(df: DataFrame, value: str, edges: list[float], min_count: int = 20) -> DataFrame:
    return fixed_edge_profile(df, signed_distance("boundary_distance_km"), value, edges, min_count=min_count)


def outward_profile(df: DataFrame, value: str, domain: str, edges: list[float], feature_min_km: float | None = None,
                    min_count: int = 20) -> DataFrame:
    rows = df.where((F.col("domain") == domain) & (F.col("boundary_distance_km") >= 0))
    if feature_min_km is not None:
        rows = rows.where(F.col("tlrts_distance_km") >= feature_min_km)
    return fixed_edge_profile(rows, "boundary_distance_km", value, edges, min_count=min_count)


def feature_profile(df: DataFrame, value: str, edges: list[float], side: str = "all", min_count: int = 20) -> DataFrame:
    """Profile over the feature distance in the pf domain, on one side of the boundary threshold."""
    rows = df.where((F.col("domain") == "pf") & F.col("tlrts_distance_km").between(0.0, edges[-1]))
    cut = BOUNDARY_KM[(value, "pf")]
    if side == "interior":
        rows = rows.where(F.col("boundary_distance_km") >= cut)
    elif side == "transition":
        rows = rows.where(F.col("boundary_distance_km") < cut)
    return fixed_edge_profile(rows, "tlrts_distance_km", value, edges, min_count=min_count)


def along_profile(df: DataFrame, x: str, values: list[str], step: float, scale: float, by: list[str] = ()) -> DataFrame:
    """Right-closed bins of fixed length from 0, the lowest value included, with a band of ``scale`` deviations."""
    long = df.unpivot([*by, x], values, "metric", "value").dropna(subset=[x, "value"]).where(F.col(x) >= 0)
    b = F.greatest(F.ceil(F.col(x) / step), F.lit(1))
    out = long.groupBy(*by, "metric", b.alias("bin")).agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("*").alias("n"))
    left = (F.col("bin") - 1) * step
    return out.select(
        *by, "metric", left.alias("bin_left_km"), (left + step).alias("bin_right_km"), (left + step / 2).alias("center_km"),
        "mean", "std", (F.col("mean") - F.col("std") * scale).alias("ylo"), (F.col("mean") + F.col("std") * scale).alias("yhi"), "n")


def edge_curve(df: DataFrame, x: str, y: str, edges: list[float], scale: float = 0.1) -> DataFrame:
    """Curve over right-closed bins with the given edges, lowest included; x is the right edge."""
    v = F.col(x)
    right = None
    for i in range(1, len(edges)):
        cond = (v <= edges[i]) & ((v > edges[i - 1]) if i > 1 else (v >= edges[0]))
        right = F.when(cond, float(edges[i])) if right is None else right.when(cond, float(edges[i]))
    stats = df.dropna(subset=[x, y]).groupBy(right.alias("x")).agg(
        F.avg(y).alias("y"), F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("_s"), F.count("*").alias("n")).where("x IS NOT NULL")
    return _band(stats, scale)


def _band(stats: DataFrame, scale: float) -> DataFrame:
    band = F.col("_s") * scale
    return stats.withColumn("ylo", F.col("y") - band).withColumn("yhi", F.col("y") + band).drop("_s")


def quantile_curve(df: DataFrame, x: str, y: str, q: int, scale: float = 0.1) -> DataFrame:
    """Curve over right-closed quantile bins; repeated edges merge, and fewer rows than bins give nothing."""
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    table = exact_quantiles(rows, "x", [i / q for i in range(q + 1)])
    edges = F.when(F.col("n") >= q, F.array_distinct("quantiles")).alias("e")
    held = rows.withColumn("_e", table.select(edges).scalar()).where("_e IS NOT NULL")
    above = F.size(F.filter("_e", lambda e: e < F.col("x")))
    binned = held.withColumn("bin", F.greatest(above, F.lit(1))).drop("_e")
    stats = binned.groupBy("bin").agg(
        F.avg("y").alias("y"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("_s"), F.count("*").alias("n"))
    medians = exact_quantiles(binned, "x", [0.5], ["bin"], small_groups=True).select(
        "bin", F.get("quantiles", F.lit(0)).alias("x"))
    return _band(stats.join(medians, "bin"), scale)


def rank_bins(df: DataFrame, value: str, id_col: str, bins, by: list[str] = ()) -> DataFrame:
    """Equal-count bins over ranks with ties in identifier order; ``bins`` is a number or a column.

    The bin of rank r of n is ceil((r-1)*bins/(n-1)) - 1, at least 0.
    """
    rows = df.where(F.col(value).isNotNull())
    ranked = global_row_number(rows, [value, id_col], "_r", by)
    if by:
        # one row per group, and groups are few
        ranked = ranked.join(F.broadcast(rows.groupBy(*by).agg(F.count("*").alias("_n"))), list(by))
    else:
        ranked = ranked.withColumn("_n", rows.agg(F.count("*")).scalar())
    b = F.greatest(F.ceil((F.col("_r") - 1) * bins / F.greatest(F.col("_n") - 1, F.lit(1))) - 1, F.lit(0))
    return ranked.withColumn("bin", b).drop("_r", "_n")


def moving_profile(df: DataFrame, x: str, metrics: list[str], id_col: str, fraction: float = 0.05, points: int = 160,
                   min_window: int = 301) -> DataFrame:
    """Means over windows of rows ordered by x, at evenly spaced centre rows.

    A row computes which centres reach it from the even spacing and is copied to those
    few; no row is compared with every centre.
    """
    rows = df.select(x, id_col, *metrics).where(F.col(x).isNotNull())
    ranked = global_row_number(rows, [x, id_col], "_rn").withColumn("_i", F.col("_rn") - 1)
    n = F.col("_n")
    wide = F.least(F.greatest(F.lit(min_window), F.floor(n * fraction)), n)
    odd = F.when(wide % 2 == 0, F.greatest(wide - 1, F.lit(1))).otherwise(wide)
    window = F.when(odd < 21, F.least(n, F.lit(21))).otherwise(odd)
    sized = ranked.withColumn("_n", rows.agg(F.count("*")).scalar()).withColumn("_w", window).withColumn(
        "_h", F.greatest(F.floor(F.col("_w") / 2), F.lit(1)))
    count = F.greatest(F.lit(25), F.least(F.lit(points), n - F.col("_w") + 1))
    sized = sized.withColumn("_c", count).withColumn(
        "_step", F.nullif((n - F.col("_h") * 2 - 1) / (count - 1), F.lit(0.0)))
    single = n <= F.col("_w")
    first = F.floor((F.col("_i") - F.col("_h") * 2) / F.col("_step")) - 1
    last = F.ceil((F.col("_i") + 1) / F.col("_step")) + 1
    span = F.sequence(F.greatest(first, F.lit(0)).cast("long"),
                      F.greatest(F.least(last, F.col("_c") - 1), F.lit(0)).cast("long"))
    centre = F.when(single, F.array(F.floor(n / 2))).otherwise(F.array_distinct(F.transform(
        F.when(single, F.array(F.lit(0).cast("long"))).otherwise(span),
        lambda j: F.floor(F.col("_h") + j * F.col("_step")))))
    spread = sized.withColumn("centre", F.explode(centre)).where(F.abs(F.col("_i") - F.col("centre")) <= F.col("_h"))
    aggs = [F.avg(x).alias("x_mean"), F.max(F.when(F.col("_i") == F.col("centre"), F.col(x))).alias("x_median"),
            F.count("*").alias("n_window")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"),
                 F.when(F.count(m) > 0, F.coalesce(F.stddev_samp(m), F.lit(0.0))).alias(f"{m}_std")]
    return spread.groupBy("centre").agg(*aggs)


def extend_to_unit(profile: DataFrame, x: str = "x_mean", also: str = "x_median", tie: str = "centre") -> DataFrame:
    """Repeat the first row at 0 and the last at 1 when the profile stops short; works on profile rows."""
    whole, order = F.struct(*profile.columns), F.struct(F.round(x, 9).alias("x"), tie)
    ends = profile.agg(F.min_by(whole, order).alias("a"), F.max_by(whole, order).alias("b"))

    def end(field: str, at: float, needed: Column) -> DataFrame:
        return ends.where(needed).select(f"{field}.*").withColumn(x, F.lit(at)).withColumn(also, F.lit(at))

    return profile.unionByName(end("a", 0.0, F.col(f"a.{x}") > 0.0)).unionByName(end("b", 1.0, F.col(f"b.{x}") < 1.0))


def split_curve(curve: DataFrame, at: Column | float, ys: list[str], by: list[str] = (), x: str = "x") -> DataFrame:
    """Curve rows marked ``core`` or ``tail``; both parts share the interpolated row at the split.

    A split outside the range, or none, leaves the curve in one part.
    """
    at = F.lit(at) if not isinstance(at, Column) else at
    w = Window.partitionBy(*by).orderBy(x)
    whole = Window.partitionBy(*by)
    rows = curve.withColumn("_at", at).withColumn("_lo", F.min(x).over(whole)).withColumn("_hi", F.max(x).over(whole))
    for c in [x, *ys]:
        rows = rows.withColumn(f"_n_{c}", F.lead(c).over(w))
    within = (F.col("_at") > F.col("_lo")) & (F.col("_at") < F.col("_hi"))
    own = F.when(F.col("_at").isNull() | (F.col("_at") >= F.col("_hi")), "core").when(
        F.col("_at") <= F.col("_lo"), "tail").when(F.col(x) < F.col("_at"), "core").when(F.col(x) > F.col("_at"), "tail")
    kept = rows.withColumn("part", own).where("part IS NOT NULL").select(*by, x, *ys, "part")
    t = (F.col("_at") - F.col(x)) / (F.col(f"_n_{x}") - F.col(x))
    bracket = within & (F.col(x) <= F.col("_at")) & (F.col(f"_n_{x}") > F.col("_at"))
    joint = rows.where(bracket).select(
        *by, F.col("_at").alias(x), *[(F.col(c) + t * (F.col(f"_n_{c}") - F.col(c))).alias(c) for c in ys],
        F.explode(F.array(F.lit("core"), F.lit("tail"))).alias("part"))
    return kept.unionByName(joint)


def interpolate_on(curves: DataFrame, grid: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """Each curve's linear value at the grid positions, constant beyond its ends.

    ``grid`` holds (key, x) rows. Knots and positions are ordered together per curve; the
    knots before and after a position come from running first and last values.
    """
    knots = curves.select(key, F.col(x).alias("_x"), F.col(x).alias("_kx"), F.col(y).alias("_ky"), F.lit(0).alias("_q"))
    asks = grid.select(key, F.col(x).alias("_x"), F.lit(None).cast("double").alias("_kx"), F.lit(None).cast("double").alias("_ky"),
                       F.lit(1).alias("_q"))
    w = Window.partitionBy(key).orderBy("_x", "_q")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    both = knots.unionByName(asks)
    for c in ("_kx", "_ky"):
        both = both.withColumn(f"{c}0", F.last(c, ignorenulls=True).over(back)).withColumn(
            f"{c}1", F.first(c, ignorenulls=True).over(ahead))
    t = (F.col("_x") - F.col("_kx0")) / (F.col("_kx1") - F.col("_kx0"))
    value = F.when(F.col("_kx0").isNull(), F.col("_ky1")).when(F.col("_kx1").isNull(), F.col("_ky0")).when(
        F.col("_kx1") == F.col("_kx0"), F.col("_ky0")).otherwise(F.col("_ky0") + t * (F.col("_ky1") - F.col("_ky0")))
    return both.where("_q = 1").select(key, F.col("_x").alias(x), value.alias(y))


def curve_spread(curves: DataFrame, base: str, key: str = "zone", x: str = "x", y: str = "y") -> DataFrame:
    """Spread of several curves at the positions of one of them, and the position of least spread.

    Curves are short tables; ``base`` names the curve that supplies the positions.
    """
    positions = curves.where(F.col(key) == base).select(F.col(x).alias("_p"))
    keys = curves.select(key).distinct()
    stops = positions.agg(F.collect_set("_p").alias("_s")).select("_s").scalar()
    grid = keys.withColumn(x, F.explode(stops))
    values = interpolate_on(curves, grid, key, x, y)
    stats = values.groupBy(x).agg(F.stddev_pop(y).alias("spread"), F.median(y).alias("mid"))
    return stats.agg(F.min_by(x, F.struct("spread", x)).alias("x_best"), F.min_by("mid", F.struct("spread", x)).alias("y_best"),
                     F.min("spread").alias("spread"))


def reference_rank(df: DataFrame, value: str, reference: DataFrame, ref_value: str, out: str, eps: float = 1e-5) -> DataFrame:
    """Share of the reference at or below each value, clipped to [eps, 1 - eps].

    Values are folded first: one row per distinct value with its reference count.
    """
    refs = reference.select(F.col(ref_value).alias("_v")).where("_v IS NOT NULL")
    both = refs.select("_v", F.lit(1).alias("_r")).unionByName(
        df.select(F.col(value).alias("_v"), F.lit(0).alias("_r")).where("_v IS NOT NULL"))
    folded = both.groupBy("_v").agg(F.sum("_r").alias("_r"))
    ranks = running_totals(folded, ["_v"], {"_cum": "_r"}).select(F.col("_v").alias(value), "_cum")
    total = refs.agg(F.count("*")).scalar()
    share = F.least(F.greatest(F.col("_cum") / total, F.lit(eps)), F.lit(1 - eps))
    return df.join(ranks, value, "left").withColumn(out, share).drop("_cum")


def top_union(scores: DataFrame, panel: str, item: str, score: str, per_panel: int = 5, cap: int = 8) -> DataFrame:
    """Items in the top ranks of any panel, at most ``cap`` of them by their best score; a report table."""
    w = Window.partitionBy(panel).orderBy(F.desc(score), item)
    picked = scores.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_panel).select(item).distinct()
    best = scores.join(picked, item, "left_semi").groupBy(item).agg(F.max(score).alias("max_score"))
    return best.orderBy(F.desc("max_score"), item).limit(cap)


def cumulative_before(df: DataFrame, order: str, values: list[str], by: list[str] = ()) -> DataFrame:
    """Sums over the earlier rows of short ordered tables, 0 for the first."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(w), F.lit(0.0)) for v in values})


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a total order; only one row per key and task is shuffled."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def meridional_ticks(bounds: DataFrame, ticks: int, nodes: int = 1024) -> DataFrame:
    """Latitudes at equal meridional distances between ``lo`` and ``hi`` of a one-row table."""
    grid = bounds.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("i")).withColumn(
        "lat", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (nodes - 1))
    w = Window.orderBy("i")
    length = grid.withColumn("_m", meridional_degree_m("lat"))
    seg = (F.col("_m") + F.lag("_m").over(w)) / 2 * (F.col("lat") - F.lag("lat").over(w)) / 1000.0
    cum = length.withColumn("_seg", F.coalesce(seg, F.lit(0.0))).withColumn("km0", F.sum("_seg").over(w)).withColumn(
        "km1", F.lead("km0").over(w)).withColumn("lat1", F.lead("lat").over(w))
    total = cum.agg(F.max("km0")).scalar()
    stops = cum.withColumn("_total", total).withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(ticks - 1))))
    at = F.col("_total") * F.col("tick") / (ticks - 1)
    hit = stops.where((at >= F.col("km0")) & (F.col("km1").isNull() | (at < F.col("km1"))))
    lat = F.when(F.col("km1").isNull(), F.col("lat")).otherwise(
        F.col("lat") + (F.col("lat1") - F.col("lat")) * (at - F.col("km0")) / (F.col("km1") - F.col("km0")))
    return hit.select("tick", at.alias("km"), lat.alias("lat"), F.col("lat").alias("node_lat"))


