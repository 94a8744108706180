"""Counts, shares, quantile tables, histograms, densities and rank correlation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tailfield.constants import EXTREME, ZONES
from tailfield.functions.labels import extreme_flag, process_zone
from tailfield.functions.numeric import col
from tailfield.operators.grid import histogram_bin
from tailfield.operators.ordering import attach_quantiles, exact_quantiles, running_totals
from tailfield.session import materialise, small_table


def domain_counts(df: DataFrame, values: list[str], by: str = "domain") -> DataFrame:
    """Rows with any of the values present, per group, in group order."""
    return df.dropna("all", subset=values).groupBy(by).agg(F.count("*").alias("n_rows")).orderBy(by)


def top_categories(df: DataFrame, category: str, n: int, preferred: list[str] = (), missing: str = "missing") -> DataFrame:
    """The n most frequent categories, preferred ones first; ``missing`` only when there is nothing else.

    Works on one row per category, so the ordering is over a small table.
    """
    counts = df.groupBy(category).agg(F.count("*").alias("n"))
    named = counts.where(F.col(category) != missing).agg(F.count("*")).scalar()
    place = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(category)) if preferred else F.lit(0)
    return (
        counts.withColumn("_p", F.when(place > 0, place).otherwise(len(preferred) + 1))
        .where((F.col(category) != missing) | (named == 0))
        .orderBy("_p", F.desc("n"), category).limit(n).drop("_p")
    )


def quantile_table(df: DataFrame, value: str, qs: list[float], by: str | None = None) -> DataFrame:
    """Exact quantiles in long form, of the whole table and of each group of a fixed set."""
    def long(table: DataFrame, region: Column) -> DataFrame:
        rows = F.arrays_zip(F.array(*[F.lit(q) for q in qs]).alias("q"), F.col("quantiles").alias("v"))
        return table.select(region.alias("region"), "n", F.explode(rows).alias("r")).select(
            "region", "n", F.col("r.q").alias("q"), F.col("r.v").alias("threshold"))

    out = long(exact_quantiles(df, value, qs), F.lit("all"))
    if by is None:
        return out
    return out.unionByName(long(exact_quantiles(df, value, qs, [by], small_groups=True), F.col(by)))


def robust_limits(df: DataFrame, value, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """(lo, hi) quantiles; (0, 1) without values and hi = lo + 1 for a constant."""
    q = exact_quantiles(df, value, [lo, hi])
    a, b = F.get("quantiles", F.lit(0)), F.get("quantiles", F.lit(1))
    return q.select(
        F.when(F.col("n") == 0, 0.0).otherwise(a).alias("lo"),
        F.when(F.col("n") == 0, 1.0).when(b <= a, a + 1.0).otherwise(b).alias("hi"))


def symmetric_limits(df: DataFrame, value, p: float = 0.98) -> DataFrame:
    q = exact_quantiles(df, F.abs(col(value)), [p])
    top = F.get("quantiles", F.lit(0))
    size = F.when((F.col("n") == 0) | (top <= 0), 1.0).otherwise(top)
    return q.select((-size).alias("lo"), size.alias("hi"))


def centred_limits(df: DataFrame, value, centre: float = 0.0, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    limits = robust_limits(df, value, lo, hi)
    span = F.greatest(F.abs(F.col("lo") - centre), F.abs(F.col("hi") - centre))
    return limits.select((F.lit(centre) - span).alias("lo"), (F.lit(centre) + span).alias("hi"))


def trim(df: DataFrame, value: str, by: list[str], lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """Rows whose value lies between the group's quantiles, both included."""
    limited = attach_quantiles(df, value, [lo, hi], ["_lo", "_hi"], by, small_groups=True)
    return limited.where(F.col(value).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def zone_table(spark: SparkSession) -> DataFrame:
    rows = [(i, z, d, label) for i, (z, d, label, _) in enumerate(ZONES)]
    return small_table(spark, "zone_order int, zone string, domain string, zone_label string", rows)


def zone_summary(df: DataFrame, target: str, boundary_km: float | None = None, impact_km: float | None = None) -> DataFrame:
    """Counts, extreme density and shares per zone; every zone appears, ratios are NULL on zero.

    One aggregation over the rows by (domain, zone); everything after works on its few rows.
    """
    tagged = df.select(
        "domain", process_zone(target, boundary_km=boundary_km, impact_km=impact_km).alias("zone"),
        extreme_flag(target).alias("_x"), F.col(target).isNotNull().alias("_ok"))
    counts = tagged.where("_ok AND zone <> 'other'").groupBy("domain", "zone").agg(
        F.count("*").alias("n_pixels"), F.count_if("_x").alias("extreme_n"))
    full = zone_table(df.sparkSession).join(counts, ["domain", "zone"], "left").fillna(0, ["n_pixels", "extreme_n"])
    w = Window.partitionBy("domain")
    full = full.withColumn("domain_n_pixels", F.sum("n_pixels").over(w)).withColumn(
        "domain_extreme_n", F.sum("extreme_n").over(w))
    return full.select(
        F.lit(target).alias("target"), "zone", "domain", "n_pixels", "domain_n_pixels", "extreme_n", "domain_extreme_n",
        F.try_divide("extreme_n", "n_pixels").alias("extreme_density"),
        F.try_divide("extreme_n", "domain_extreme_n").alias("domain_extreme_share"),
        F.try_divide("n_pixels", "domain_n_pixels").alias("sample_share"))


def threshold_sensitivity(df: DataFrame, targets: list[str], boundaries: list[float], impacts: list[float]) -> DataFrame:
    """Density ratios and retained shares for every pair of fixed thresholds.

    Rows are first counted by the interval between thresholds they fall in; the grid of
    thresholds then only multiplies that small table.
    """
    def interval(c: str, cuts: list[float]) -> Column:
        return sum(((F.col(c) >= v).cast("int") for v in cuts), F.lit(0))

    present = F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(t).isNotNull().alias("ok"), extreme_flag(t).alias("x")) for t in targets]))
    compact = (
        df.where("domain IN ('pf', 'npf') AND boundary_distance_km >= 0")
        .select("domain", interval("boundary_distance_km", sorted(boundaries)).alias("ib"),
                interval("tlrts_distance_km", sorted(impacts)).alias("ia"), present.alias("t"))
        .where("t.ok").groupBy("t.target", "domain", "ib", "ia").agg(
            F.count("*").alias("n"), F.count_if(F.col("t.x")).alias("e"))
    )
    grid = F.explode(F.array(*[
        F.struct(F.lit(b).alias("b"), F.lit(i + 1).alias("ib_cut"), F.lit(a).alias("a"), F.lit(j + 1).alias("ia_cut"))
        for i, b in enumerate(sorted(boundaries)) for j, a in enumerate(sorted(impacts))]))
    g = compact.select("*", grid.alias("g"))
    inner = F.col("ib") >= F.col("g.ib_cut")
    hit = F.col("ia") < F.col("g.ia_cut")
    pf, npf, known = F.col("domain") == "pf", F.col("domain") == "npf", F.col("ia").isNotNull()

    def total(c: str, cond: Column, name: str) -> Column:
        return F.sum(F.when(cond, F.col(c)).otherwise(0)).alias(name)

    groups = {"ni": npf & inner, "nt": npf & ~inner, "pii": pf & known & inner & hit, "pib": pf & known & inner & ~hit,
              "pti": pf & known & ~inner & hit, "ptb": pf & known & ~inner & ~hit}
    sums = g.groupBy("target", F.col("g.b").alias("boundary_transition_km"), F.col("g.a").alias("tlrts_impact_km")).agg(
        *[total(c, cond, f"{c}_{k}") for k, cond in groups.items() for c in ("n", "e")])

    def density(*keys: str) -> Column:
        return F.try_divide(sum(F.col(f"e_{k}") for k in keys), sum(F.col(f"n_{k}") for k in keys))

    return sums.select(
        "target", "boundary_transition_km", "tlrts_impact_km",
        F.try_divide(density("nt"), density("ni")).alias("npf_transition_vs_interior"),
        F.try_divide(density("pii"), density("pib")).alias("pf_interior_impacted_vs_background"),
        F.try_divide(density("pti", "ptb"), density("pii", "pib")).alias("pf_transition_vs_interior"),
        (F.try_divide(F.col("n_ni"), F.col("n_ni") + F.col("n_nt")) * 100.0).alias("npf_interior_retained_pct"),
        (F.try_divide(F.col("n_pib"), F.col("n_pii") + F.col("n_pib") + F.col("n_pti") + F.col("n_ptb")) * 100.0).alias(
            "pf_interior_background_retained_pct"))


def composition_counts(nested: DataFrame, width: str = "buffer_width_km") -> DataFrame:
    """Domain split and strict extremes within each domain per corridor width, in long form."""
    domains = {"pf": "permafrost", "npf": "non_permafrost"}
    parts, labels = [], []
    for d in domains:
        parts.append(F.count_if(F.col("domain") == d).alias(f"c{len(parts)}"))
        labels.append(("sample_domain", d))
    for t, short in (("d_u", "du"), ("grad_mag_km", "grad")):
        for d, name in domains.items():
            beyond = F.col(t) < EXTREME[(d, t)] if t == "d_u" else F.col(t) > EXTREME[(d, t)]
            for label, cond in (("Extreme", beyond), ("Reference", ~beyond)):
                parts.append(F.count_if((F.col("domain") == d) & cond).alias(f"c{len(parts)}"))
                labels.append((f"{name}_extreme_{short}", label))
    wide = nested.groupBy(width).agg(*parts)
    rows = F.explode(F.array(*[
        F.struct(F.lit(g).alias("group"), F.lit(lab).alias("label"), F.col(f"c{i}").alias("count"))
        for i, (g, lab) in enumerate(labels)]))
    return wide.select(width, rows.alias("r")).select(width, "r.*")


def key_grid(spark: SparkSession, **keys: list) -> DataFrame:
    """Every combination of a few parameter lists."""
    import itertools

    types = ", ".join(f"{k} {'double' if isinstance(v[0], float) else 'string'}" for k, v in keys.items())
    return small_table(spark, types, list(itertools.product(*keys.values())))


def interval_stats(nested: DataFrame, metrics: list[str], widths: list[float], span: tuple[float, float]) -> DataFrame:
    """Mean, deviation (0 for a single value) and a tenth of it, per metric, domain and width; empty keys stay."""
    long = nested.where(F.col("along_km").between(*span)).unpivot(
        ["domain", "buffer_width_km"], metrics, "metric", "value").dropna(subset=["value"])
    stats = long.groupBy("metric", "domain", "buffer_width_km").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    keys = key_grid(nested.sparkSession, metric=metrics, domain=["pf", "npf"], buffer_width_km=widths)
    out = keys.join(stats, ["metric", "domain", "buffer_width_km"], "left").fillna(0, ["n"]).fillna(0.0, ["std"])
    return out.withColumn("err", F.col("std") * 0.1)


def extreme_portion(nested: DataFrame, target: str, widths: list[float]) -> DataFrame:
    """Percentage of strict extremes among present values per width and domain."""
    from tailfield.functions.labels import extreme_label

    stats = nested.where(F.col(target).isNotNull()).groupBy("buffer_width_km", "domain").agg(
        F.count("*").alias("n"), (F.avg(extreme_label(target).cast("double")) * 100.0).alias("value"))
    keys = key_grid(nested.sparkSession, buffer_width_km=widths, domain=["pf", "npf"])
    return keys.join(stats, ["buffer_width_km", "domain"], "left").fillna(0, ["n"])


def mean_score_pct(nested: DataFrame, score: str, widths: list[float]) -> DataFrame:
    stats = nested.where(F.col(score).isNotNull()).groupBy("buffer_width_km", "domain").agg(
        F.count("*").alias("n"), (F.avg(score) * 100.0).alias("value"), F.stddev_samp(score).alias("_s"))
    keys = key_grid(nested.sparkSession, buffer_width_km=widths, domain=["pf", "npf"])
    return keys.join(stats, ["buffer_width_km", "domain"], "left").fillna(0, ["n"]).fillna(0.0, ["_s"]).select(
        "buffer_width_km", "domain", "n", "value", (F.col("_s") * 100.0).alias("std"), (F.col("_s") * 10.0).alias("err"))


def describe(df: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """n, mean, deviation, exact median, min and max per metric."""
    long = df.unpivot(by, metrics, "metric", "value").dropna(subset=["value"])
    basic = long.groupBy(*by, "metric").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    medians = exact_quantiles(long, "value", [0.5], [*by, "metric"], small_groups=True).select(
        *by, "metric", F.get("quantiles", F.lit(0)).alias("median"))
    return basic.join(medians, [*by, "metric"])


def edge_bin(value, edges: list[float]) -> Column:
    """Left-closed bin of increasing edges; an infinite last edge leaves the last bin open. NULL outside."""
    v = col(value)
    out = None
    for i in range(len(edges) - 1):
        cond = v >= edges[i]
        if edges[i + 1] != float("inf"):
            cond = cond & (v < edges[i + 1])
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return out


def wilson(positives, n, z: float = 1.96) -> tuple[Column, Column]:
    k, n = col(positives).cast("double"), col(n).cast("double")
    p = k / n
    denom = F.lit(1.0) + z * z / n
    centre = (p + z * z / (n * 2.0)) / denom
    half = F.sqrt(F.greatest(p * (F.lit(1.0) - p) / n + z * z / (n * n * 4.0), F.lit(0.0))) * z / denom
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


def rate_by_bin(df: DataFrame, value: str, label: str, edges: list[float]) -> DataFrame:
    """Positives, rate and 95 % interval per distance bin; empty bins stay."""
    counts = df.where(F.col(label).isNotNull()).select(
        edge_bin(value, edges).alias("bin_index"), F.col(label).cast("long").alias("_y")).where(
        "bin_index IS NOT NULL").groupBy("bin_index").agg(F.count("*").alias("n"), F.sum("_y").alias("positives"))
    bins = small_table(df.sparkSession, "bin_index int, lo double, hi double",
                       [(i, edges[i], None if math.isinf(edges[i + 1]) else edges[i + 1]) for i in range(len(edges) - 1)])
    full = bins.join(counts, "bin_index", "left").fillna(0, ["n", "positives"])
    low, high = wilson("positives", F.when(F.col("n") > 0, F.col("n")))
    return full.select("*", F.try_divide("positives", "n").alias("rate"), low.alias("ci_low"), high.alias("ci_high"))


def missingness(df: DataFrame, features: list[str], limit: float | None = None) -> DataFrame:
    """Present count and missing share per feature; with a limit only the features to keep."""
    wide = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in features])
    long = wide.unpivot(["_n"], features, "feature", "n_finite").withColumn(
        "missing_fraction", F.lit(1.0) - F.try_divide("n_finite", "_n")).drop("_n")
    return long if limit is None else long.where(F.col("missing_fraction") <= limit)


def density_histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int, by: str | None = None,
                      mirror: str | None = None) -> DataFrame:
    """Counts and densities over shared bins, per group, empty bins included.

    ``mirror`` names a group whose densities are reported with a negative sign.
    """
    width = (hi - lo) / bins
    keys = [by] if by else []
    counts = df.select(*keys, histogram_bin(value, lo, hi, bins).alias("bin")).where("bin IS NOT NULL").groupBy(
        *keys, "bin").agg(F.count("*").alias("count"))
    all_bins = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin")
    if by:
        frame = counts.groupBy(by).agg(F.sum("count").alias("total")).select(by, "total", all_bins)
    else:
        frame = counts.agg(F.sum("count").alias("total")).select("total", all_bins)
    out = frame.join(counts, [*keys, "bin"], "left").fillna(0, ["count"])
    sign = F.when(F.col(by) == mirror, -1.0).otherwise(1.0) if by and mirror else F.lit(1.0)
    return out.select(
        *keys, "bin", (F.lit(lo) + (F.col("bin") + 0.5) * width).alias("centre"), "count",
        (sign * F.col("count") / (F.col("total") * width)).alias("density"))


def out_of_range_pct(df: DataFrame, value: str, lo: float, hi: float, by: list[str] = ()) -> DataFrame:
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), (F.avg(((v < lo) | (v > hi)).cast("double")) * 100.0).alias("out_pct"))


def box_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles and the last values within 1.5 interquartile ranges, per group."""
    v = F.col(value)
    q = attach_quantiles(df.where(v.isNotNull()), value, [0.25, 0.5, 0.75], ["q1", "median", "q3"], by, small_groups=True)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    low, high = F.min(F.when(v >= F.col("q1") - reach, v)), F.max(F.when(v <= F.col("q3") + reach, v))
    out = q.groupBy(*by, "q1", "median", "q3").agg(F.count("*").alias("n"), low.alias("_l"), high.alias("_h"))
    return out.select(*by, "n", "q1", "median", "q3", F.least("_l", "q1").alias("whisker_low"),
                      F.greatest("_h", "q3").alias("whisker_high"))


def kde_curve(df: DataFrame, value: str, by: list[str], x_min: float, x_max: float, points: int = 300,
              factor: float = 0.3) -> DataFrame:
    """Gaussian density on an even grid per group; the bandwidth is ``factor`` sample deviations.

    Equal values are counted first; each distinct value then adds to the grid points,
    a parameter list, and the sums combine before the shuffle.
    """
    v = F.col(value)
    counts = df.where(v.isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    spread = df.where(v.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), (F.stddev_samp(value) * factor).alias("h")).where("h > 0")
    step = (x_max - x_min) / (points - 1)
    at = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    # one row per group of a fixed set
    rows = counts.join(F.broadcast(spread), by).select("*", at.alias("i"))
    x = F.lit(x_min) + F.col("i") * step
    z = (x - v) / F.col("h")
    return rows.groupBy(*by, "i", "n", "h").agg(F.sum(F.exp(z * z * -0.5) * F.col("_c")).alias("_s")).select(
        *by, "n", "h", x.alias("x"),
        (F.col("_s") / (F.col("n") * F.col("h") * math.sqrt(2.0 * math.pi))).alias("density"))


def central_band(curve: DataFrame, df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Central 95 % interval of the values and the densest grid point inside it (the median if none)."""
    q = exact_quantiles(df, value, [0.025, 0.5, 0.975], by, small_groups=True).select(
        *by, F.get("quantiles", F.lit(0)).alias("band_low"), F.get("quantiles", F.lit(1)).alias("_m"),
        F.get("quantiles", F.lit(2)).alias("band_high"))
    inside = curve.join(q, by).where(F.col("x").between(F.col("band_low"), F.col("band_high")))
    mode = inside.groupBy(*by).agg(F.max_by("x", F.struct("density", F.negative("x"))).alias("mode"))
    return q.join(mode, by, "left").withColumn("mode", F.coalesce("mode", "_m")).drop("_m")


def split_summary(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("positive_fraction"))


def class_weights(df: DataFrame, label: str = "label", by: list[str] = ()) -> DataFrame:
    """Prevalence (at least 1e-6) and the weight of a positive (at least 1)."""
    p = F.greatest(F.avg(F.col(label).cast("double")), F.lit(1e-6))
    return df.where(F.col(label).isNotNull()).groupBy(*by).agg(
        F.avg(F.col(label).cast("double")).alias("prevalence"),
        F.greatest((F.lit(1.0) - p) / p, F.lit(1.0)).alias("positive_weight"))


def run_summary(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Named aggregates as (metric, value) text rows."""
    wide = df.agg(*[c.cast("string").alias(n) for n, c in metrics.items()])
    return wide.unpivot([], list(metrics), "metric", "value")


def max_per_key(df: DataFrame, key: str, score: str, label: str) -> DataFrame:
    return df.groupBy(key, label).agg(F.max(score).alias("max_score")).orderBy(F.desc("max_score"), label)


def panel_alignment(df: DataFrame, item: str, panel: str, n_panels: int) -> DataFrame:
    """How many panels hold each item, and whether all do."""
    pairs = df.select(item, panel).distinct()
    return pairs.groupBy(item).agg(F.count("*").alias("n_panels")).withColumn("complete", F.col("n_panels") == n_panels)


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (rational Chebyshev form, relative error about 1e-7)."""
    # Polynomial coefficients of the approximation.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
         -0.82215223, 0.17087277)
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.5)
    poly = F.lit(c[-1])
    for a in c[-2::-1]:
        poly = poly * t + a
    return t * F.exp(-x * x + poly)


def kendall_tau(df: DataFrame, x: str, y: str, blocks: int | None = None) -> DataFrame:
    """Kendall's tau-b with a normal p value; NULL below three rows or without variation.

    Discordant pairs are counted without forming pairs. Ranks are cut into blocks of
    about n/blocks rows, a value holding more than that being a block of its own. Pairs in
    different x blocks and different y blocks come from the table of block counts; pairs
    sharing a block are counted inside it by running sums per bit of the other rank, so no
    window sees more than one block. The number of blocks grows with the root of n, between
    64 and 2048, as the table of block counts grows with its square.
    """
    pairs = materialise(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().groupBy(
        "x", "y").agg(F.count("*").alias("c")))
    n = pairs.agg(F.sum("c")).first()[0] or 0
    blocks = blocks or min(2048, max(64, math.isqrt(n // 1000)))
    n = F.lit(n)

    def ranked(axis: str) -> DataFrame:
        marginal = pairs.groupBy(axis).agg(F.sum("c").alias("m")).withColumn("one", F.lit(1))
        total = running_totals(marginal, [axis], {f"{axis}_rank": "one", f"{axis}_cum": "m"})
        before = F.col(f"{axis}_cum") - F.col("m")
        heavy = F.col("m") * blocks >= n
        return total.select(
            axis, F.col("m").alias(f"{axis}_m"), F.col(f"{axis}_rank"),
            (F.floor(before * blocks / n) * 2 + heavy.cast("int")).alias(f"{axis}_block"))

    rx, ry = ranked("x"), ranked("y")
    pts = materialise(pairs.join(rx, "x").join(ry, "y"))

    def earlier_larger(rows: DataFrame, keys: list[str], order: str, rank: str, bits) -> DataFrame:
        """Weighted pairs, within keys, with a strictly earlier order and a larger rank."""
        b = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(bits) - 1)))
        b = b.withColumn("_p", F.expr(f"shiftright({rank}, _b + 1)")).withColumn(
            "_bit", F.expr(f"shiftright({rank}, _b) & 1"))
        folded = b.groupBy(*keys, "_b", "_p", order, "_bit").agg(F.sum("c").alias("c"))
        w = Window.partitionBy(*keys, "_b", "_p").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
        seen = F.sum(F.when(F.col("_bit") == 1, F.col("c")).otherwise(0)).over(w)
        return folded.withColumn("_s", F.coalesce(seen, F.lit(0))).where("_bit = 0").agg(
            F.coalesce(F.sum(F.col("_s").cast("double") * F.col("c")), F.lit(0.0)).alias("d"))

    rank_bits = ry.agg(F.ceil(F.log2(F.max("y_rank") + 2))).scalar().cast("int")
    block_bits = math.ceil(math.log2(2 * blocks + 2))
    same_x = earlier_larger(pts, ["x_block"], "x_rank", "y_rank", rank_bits)
    same_y = earlier_larger(pts, ["y_block"], "y_rank", "x_block", block_bits)
    counts = pts.groupBy("x_block", "y_block").agg(F.sum("c").alias("c"))
    span = F.sequence(F.lit(0).cast("long"), F.lit(2 * blocks + 1).cast("long"))
    frame = df.sparkSession.range(2 * blocks + 2).select(F.col("id").alias("x_block"), F.explode(span).alias("y_block"))
    dense = frame.join(counts, ["x_block", "y_block"], "left").fillna(0, ["c"])
    below = Window.partitionBy("x_block").orderBy("y_block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("y_block").orderBy(F.desc("x_block")).rowsBetween(Window.unboundedPreceding, -1)
    far = dense.withColumn("_u", F.coalesce(F.sum("c").over(below), F.lit(0))).withColumn(
        "_v", F.coalesce(F.sum("_u").over(after), F.lit(0))).agg(F.sum(F.col("_v").cast("double") * F.col("c")).alias("d"))

    def ties(table: DataFrame, m: str, tag: str) -> DataFrame:
        t = F.col(m).cast("double")
        return table.agg(F.sum(t * (t - 1) / 2).alias(f"{tag}1"), F.sum(t * (t - 1) * (t - 2)).alias(f"{tag}2"),
                         F.sum(t * (t - 1) * (t * 2 + 5)).alias(f"{tag}3"))

    facts = pairs.agg(F.sum("c").cast("double").alias("n"), F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("xy"))
    for table, m, tag in ((rx, "x_m", "x"), (ry, "y_m", "y")):
        t = ties(table, m, tag)
        facts = facts.withColumns({f"{tag}{i}": t.select(f"{tag}{i}").scalar() for i in (1, 2, 3)})
    facts = facts.withColumn("_d", same_x.scalar() + same_y.scalar() + far.scalar())
    n0 = F.col("n") * (F.col("n") - 1) / 2
    s = n0 - F.col("x1") - F.col("y1") + F.col("xy") - F.col("_d") * 2
    m = F.col("n") * (F.col("n") - 1)
    var = (m * (F.col("n") * 2 + 5) - F.col("x3") - F.col("y3")) / 18 + F.try_divide(F.col("x1") * F.col("y1") * 2, m) + F.try_divide(
        F.col("x2") * F.col("y2"), m * 9 * (F.col("n") - 2))
    usable = (F.col("n") >= 3) & (n0 > F.col("x1")) & (n0 > F.col("y1"))
    return facts.select(
        F.coalesce(F.col("n"), F.lit(0.0)).cast("long").alias("n"), F.when(usable, F.col("_d").cast("long")).alias("discordant"),
        F.when(usable, s / F.sqrt((n0 - F.col("x1")) * (n0 - F.col("y1")))).alias("tau"),
        F.when(usable, _erfc(F.abs(s) / F.sqrt(var) / math.sqrt(2.0))).alias("p_value"))
