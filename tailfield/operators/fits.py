"""Break-point and line fits on profiles, solved with running sums instead of trial fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailfield.session import materialise


def _weighted(profile: DataFrame, x: str, y: str, weight: str | None) -> DataFrame:
    """Rows with finite x, y and their power sums; ``_w`` is 1 without weights."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = profile.withColumn("_w", w).where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col("_w") > 0))
    X, Y, W = F.col(x), F.col(y), F.col("_w")
    return rows.withColumns({"_x": W * X, "_y": W * Y, "_xx": W * X * X, "_xy": W * X * Y, "_yy": W * Y * Y})


SUMS = ("_w", "_x", "_y", "_xx", "_xy", "_yy")


def hinge_candidates(profile: DataFrame, kmin: float, kmax: float, by: list[str], x: str = "x", y: str = "mean",
                     weight: str | None = None) -> DataFrame:
    """Every knot in (kmin, kmax) with the least-squares fit of y on (1, x, max(0, x - knot)).

    With sums over all points and over the points beyond a knot the fit is closed form,
    so the points are never paired with the knots.
    """
    rows = _weighted(profile, x, y, weight)
    whole = Window.partitionBy(*by)
    beyond = whole.orderBy(F.desc(x)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("n_bins", F.count("*").over(whole)).withColumns(
        {f"{s}_t": F.sum(s).over(whole) for s in SUMS}).withColumns({f"{s}_b": F.sum(s).over(beyond) for s in SUMS})
    k = F.col(x)
    t = {s: F.col(f"{s}_t") for s in SUMS}
    b = {s: F.col(f"{s}_b") for s in SUMS}
    w = t["_w"]
    h, hh = b["_x"] - k * b["_w"], b["_xx"] - k * b["_x"] * 2 + k * k * b["_w"]
    xh, yh = b["_xx"] - k * b["_x"], b["_xy"] - k * b["_y"]
    mx, my, mh = t["_x"] / w, t["_y"] / w, h / w
    sxx, syy, shh = t["_xx"] - w * mx * mx, t["_yy"] - w * my * my, hh - w * mh * mh
    sxy, sxh, shy = t["_xy"] - w * mx * my, xh - w * mx * mh, yh - w * mh * my
    # a knot at an end point adds nothing to the straight line
    det = F.when(sxx * shh - sxh * sxh > sxx * shh * 1e-12, sxx * shh - sxh * sxh)
    line = F.try_divide(sxy, sxx)
    b1, b2 = F.coalesce((sxy * shh - shy * sxh) / det, line), F.coalesce((shy * sxx - sxy * sxh) / det, F.lit(0.0))
    sse = F.greatest(syy - b1 * sxy - b2 * shy, F.lit(0.0))
    n = F.col("n_bins")
    fit = rows.where((k > kmin) & (k < kmax) & (n >= 6)).withColumn("_b1", b1).withColumn("_b2", b2).withColumn(
        "_sse", sse).withColumn("linear_slope", line).withColumn(
        "linear_sse", F.greatest(syy - line * sxy, F.lit(0.0))).withColumn("_my", my).withColumn("_mx", mx).withColumn("_mh", mh)
    return fit.select(
        *by, "n_bins", k.alias("knot"), F.col("_b1").alias("slope_before"), (F.col("_b1") + F.col("_b2")).alias("slope_after"),
        (F.col("_my") - F.col("_b1") * F.col("_mx") - F.col("_b2") * F.col("_mh")).alias("intercept"),
        (n * F.log(F.greatest(F.col("_sse") / n, F.lit(1e-12))) + F.log(n) * 3.0).alias("bic"),
        (F.col("_my") - F.col("linear_slope") * F.col("_mx")).alias("linear_intercept"), "linear_slope",
        (n * F.log(F.greatest(F.col("linear_sse") / n, F.lit(1e-12))) + F.log(n) * 2.0).alias("linear_bic"))


def hinge_fit(profile: DataFrame, kmin: float, kmax: float, by: list[str], **kw) -> DataFrame:
    """Best knot per group; fewer than six points give NULLs. The profile, a few bins per group, is kept."""
    profile = materialise(profile)
    fits = hinge_candidates(profile, kmin, kmax, by, **kw)
    row = F.struct("knot", "slope_before", "slope_after", "bic")
    best = fits.groupBy(*by).agg(F.min_by(row, F.struct(F.round("bic", 9).alias("b"), "knot")).alias("f"))
    sizes = profile.where(F.col(kw.get("x", "x")).isNotNull() & F.col(kw.get("y", "mean")).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n_bins"))
    return sizes.join(best, by, "left").select(
        *by, "n_bins", F.col("f.knot").alias("fitted_elbow_km"), "f.slope_before", "f.slope_after", "f.bic")


def compare_linear_hinge(profile: DataFrame, kmin: float, kmax: float, by: list[str], count: str = "n", weight: str | None = None,
                         **kw) -> DataFrame:
    """Straight line against hinge per group: both BICs, the gain, slopes and rounded break positions."""
    profile = materialise(profile)
    fits = hinge_candidates(profile, kmin, kmax, by, weight=weight, **kw)
    cols = [c for c in fits.columns if c not in by]
    best = fits.groupBy(*by).agg(F.min_by(F.struct(*cols), F.struct(F.round("bic", 9).alias("b"), "knot")).alias("f")).select(*by, "f.*")
    totals = profile.groupBy(*by).agg(F.sum(count).alias("n_profile_points"))
    k = F.col("knot")
    return best.join(totals, by).select(
        *by, "n_bins", "n_profile_points", "linear_intercept", "linear_slope", "linear_bic",
        k.alias("piecewise_break_km"), (F.rint(k * 2) / 2).alias("piecewise_break_rounded_0p5_km"),
        F.rint(k).alias("piecewise_break_rounded_1p0_km"), F.col("intercept").alias("piecewise_intercept"),
        F.col("slope_before").alias("piecewise_slope_near"), F.col("slope_after").alias("piecewise_slope_far"),
        F.col("bic").alias("piecewise_bic"), (F.col("linear_bic") - F.col("bic")).alias("bic_improvement_vs_linear"))


def _line(w: Column, x: Column, y: Column, xx: Column, xy: Column, span: Column) -> tuple[Column, Column]:
    """(slope, intercept) from weighted sums; a point or a zero span gives a constant."""
    flat = span <= 1e-10
    slope = F.when(flat, 0.0).otherwise((w * xy - x * y) / F.when(flat, F.lit(1.0)).otherwise(w * xx - x * x))
    return slope, (y - slope * x) / w


def weighted_line(profile: DataFrame, x: str, y: str, weight: str | None = None, by: list[str] = ()) -> DataFrame:
    rows = _weighted(profile, x, y, weight)
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in SUMS],
                              (F.max(x) - F.min(x)).alias("_span"))
    slope, intercept = _line(*[F.col(c) for c in ("_w", "_x", "_y", "_xx", "_xy")], F.col("_span"))
    return s.select(*by, "n", slope.alias("slope"), intercept.alias("intercept"))


def two_segment_fit(profile: DataFrame, x: str, y: str, weight: str | None = None, by: list[str] = ()) -> DataFrame:
    """Best split into two lines that share the split point, by weighted squared error.

    The left line does not count the split point in the error. Fewer than three points
    give one segment. Running sums from both ends replace the trial fits.
    """
    rows = _weighted(profile, x, y, weight)
    whole, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(x)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("_n", F.count("*").over(whole)).withColumn("_i", F.row_number().over(order)).withColumn(
        "_first", F.min(x).over(whole)).withColumn("_last", F.max(x).over(whole))
    rows = rows.withColumns({f"{s}_l": F.sum(s).over(upto) for s in SUMS}).withColumns(
        {f"{s}_r": F.sum(s).over(onward) for s in SUMS})

    def error(side: str, span: Column) -> tuple[Column, Column, Column]:
        s = {c: F.col(f"{c}_{side}") for c in SUMS}
        a, b = _line(s["_w"], s["_x"], s["_y"], s["_xx"], s["_xy"], span)
        sse = (s["_yy"] - b * s["_y"] * 2 - a * s["_xy"] * 2 + b * b * s["_w"] + a * b * s["_x"] * 2 + a * a * s["_xx"])
        return a, b, F.greatest(sse, F.lit(0.0))

    X, Y = F.col(x), F.col(y)
    al, bl, el = error("l", X - F.col("_first"))
    ar, br, er = error("r", F.col("_last") - X)
    own = F.col("_w") * F.pow(Y - (bl + al * X), 2)
    splits = rows.where((F.col("_i") > 1) & (F.col("_i") < F.col("_n"))).withColumn("_sse", F.greatest(el - own, F.lit(0.0)) + er)
    best = splits.select(*by, X.alias("break_x"), "_sse", al.alias("slope_left"), ar.alias("slope_right"), "_i").groupBy(*by).agg(
        F.min_by(F.struct("break_x", "slope_left", "slope_right", F.col("_sse").alias("sse")),
                 F.struct(F.round("_sse", 9).alias("e"), "_i")).alias("f"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    joined = sizes.join(best, list(by), "left") if by else sizes.withColumn("f", best.select("f").scalar())
    return joined.select(*by, "n", F.col("f.break_x").alias("break_x"), F.when(F.col("f").isNull(), 1).otherwise(2).alias("n_segments"),
                         F.col("f.slope_left").alias("slope_left"), F.col("f.slope_right").alias("slope_right"), F.col("f.sse").alias("sse"))


def fit_quality(df: DataFrame, observed: str, predicted: str, lo: float, hi: float, by: list[str] = (), min_rows: int = 10) -> DataFrame:
    """Regression line of predicted on observed, R squared and mean absolute error.

    The scores use all rows, the line the rows in range; too few of those give no line.
    """
    o, p = F.col(observed), F.col(predicted)
    rows = df.where(o.isNotNull() & p.isNotNull())
    inside = o.between(lo, hi) & p.between(lo, hi)
    x, y = F.when(inside, o), F.when(inside, p)
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(inside).alias("n_in"), F.regr_slope(y, x).alias("_a"), F.regr_intercept(y, x).alias("_b"),
        F.sum(F.pow(o - p, 2)).alias("_sse"), F.var_pop(o).alias("_v"), F.avg(F.abs(o - p)).alias("mae"))
    enough = F.col("n_in") >= min_rows
    return out.select(*by, "n", "n_in", F.when(enough, F.col("_a")).alias("slope"), F.when(enough, F.col("_b")).alias("intercept"),
                      (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_v") * F.col("n"))).alias("r2"), "mae")
