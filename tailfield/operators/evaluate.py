"""Scores of binary predictions and model interpretation.

``predict`` arguments take a DataFrame and return it with a ``prediction`` column.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tailfield.operators.ordering import exact_quantiles, running_totals
from tailfield.operators.profiles import rank_bins
from tailfield.operators.sampling import hash_key
from tailfield.session import materialise, small_table

Predict = Callable[[DataFrame], DataFrame]
SLICE_ROWS = 100_000  # of one permutation, which meet in a group of a task
COPIES_A_TASK = 1_000_000


def _counts(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """Rows and positives of each distinct score. Null scores go by their count of 0: a filter on the score would be pushed below a model, which then scores each row twice."""
    return df.where(F.col(label).isNotNull()).groupBy(*by, score).agg(
        F.count(score).alias("_n"), F.sum(F.col(label).cast("long")).alias("_p")).where(F.col("_n") > 0)


def _folded(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """``_counts``, held by a checkpoint, since it is read several times and may sit on top of a model."""
    return materialise(_counts(df, label, score, by))


def long_scores(df: DataFrame, methods: list[str], keep: list[str]) -> DataFrame:
    return df.unpivot(keep, methods, "method", "score")


def binary_metrics(df: DataFrame, label: str = "label", score: str = "score", by: list[str] = (), domain: str | None = None) -> DataFrame:
    """Area under the ROC curve (ties averaged), average precision (step sum), Brier score,
    top-decile rate and lift, and the ratio of mean prediction to observed rate.

    Everything comes from running sums over distinct scores. ``domain`` adds a group of all
    domains next to each, from the folded table. A single class gives NULL areas.
    """
    by = list(by)
    keys = by + ([domain] if domain else [])
    folded = _folded(df, label, score, keys)
    if domain:
        both = F.explode(F.array(F.lit("all"), F.col(domain))).alias("eval_domain")
        folded = folded.select(*by, both, score, "_n", "_p").groupBy(*by, "eval_domain", score).agg(
            F.sum("_n").alias("_n"), F.sum("_p").alias("_p"))
        keys = [*by, "eval_domain"]
    total = running_totals(folded, [score], {"_cn": "_n", "_cp": "_p"}, keys)
    sizes = folded.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_p").alias("pos"))
    # one row per evaluated group
    rows = total.join(F.broadcast(sizes), keys) if keys else total.withColumn(
        "n", sizes.select("n").scalar()).withColumn("pos", sizes.select("pos").scalar())
    n, p, s = F.col("_n"), F.col("_p"), F.col(score)
    neg_below = F.col("_cn") - F.col("_cp") - (n - p)
    at_least, hits = F.col("n") - F.col("_cn") + n, F.col("pos") - F.col("_cp") + p
    h = F.lit(0.9) * (F.col("n") - 1)
    low = F.floor(h)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("_cn")) & (rank >= F.col("_cn") - n), s))

    stats = rows.groupBy(*keys, "n", "pos").agg(
        F.sum(p * (neg_below + (n - p) / 2.0)).alias("_auc"), F.sum(p * hits / at_least).alias("_ap"),
        F.sum(p * F.pow(F.lit(1.0) - s, 2) + (n - p) * s * s).alias("_b"), F.sum(n * s).alias("_m"),
        at(low).alias("_lo"), at(F.least(low + 1, F.col("n") - 1)).alias("_hi"), F.max(h - low).alias("_f")
    ).withColumn("_cut", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f"))
    cuts = stats.select(*keys, "_cut")
    top_rows = folded.join(F.broadcast(cuts), keys) if keys else folded.withColumn("_cut", cuts.scalar())
    top = top_rows.where(s >= F.col("_cut")).groupBy(*keys).agg((F.sum("_p") / F.sum("_n")).alias("top_decile_rate"))
    out = stats.join(top, keys) if keys else stats.withColumn("top_decile_rate", top.scalar())
    two = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    base = F.col("pos") / F.col("n")
    return out.select(
        *keys, "n", base.alias("positive_fraction"), (F.col("_m") / F.col("n")).alias("mean_prediction"),
        F.when(base > 0, F.col("_m") / F.col("pos")).alias("prediction_to_observed_ratio"),
        F.when(two, F.col("_ap") / F.col("pos")).alias("average_precision"),
        F.when(two, F.col("_auc") / (F.col("pos") * (F.col("n") - F.col("pos")))).alias("roc_auc"),
        (F.col("_b") / F.col("n")).alias("brier"), "top_decile_rate",
        F.when(base > 0, F.col("top_decile_rate") / base).alias("top_decile_lift"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score", by: list[str] = ()) -> DataFrame:
    """False and true positive rate at every distinct score, from the highest down, starting at (0, 0)."""
    by = list(by)
    folded = _folded(df, label, score, by).withColumn("_q", F.col("_n") - F.col("_p"))
    total = running_totals(folded, [F.desc(score)], {"_tp": "_p", "_fp": "_q"}, by)
    sizes = folded.groupBy(*by).agg(F.sum("_p").alias("_pos"), F.sum("_q").alias("_neg"))
    joined = total.join(F.broadcast(sizes), by) if by else total.withColumn("_pos", sizes.select("_pos").scalar()).withColumn(
        "_neg", sizes.select("_neg").scalar())
    points = joined.select(*by, F.col(score).alias("threshold"), F.try_divide("_fp", "_neg").alias("fpr"), F.try_divide("_tp", "_pos").alias("tpr"))
    start = sizes.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def calibration_bins(df: DataFrame, id_col: str, by: list[str], label: str = "label", score: str = "score", max_bins: int = 8) -> DataFrame:
    """Equal-count score bins per group: min(8, max(2, n / 100)) of them."""
    rows = df.where(F.col(label).isNotNull())
    q = F.least(F.lit(max_bins), F.greatest(F.lit(2), F.floor(F.col("_n") / 100)))
    return rank_bins(rows, score, id_col, q, by).groupBy(*by, "bin").agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_prediction"), F.avg(F.col(label).cast("double")).alias("observed_rate"),
        F.sum(F.col(label).cast("long")).alias("positive_n"), F.min(score).alias("prediction_min"), F.max(score).alias("prediction_max"))


def by_slices(numbered: DataFrame, n: int, groups: dict[str, list[str]], tags: list[tuple[str, int]], id_col: str) -> Callable[[list[int]], DataFrame]:
    """Makes the permuted copies of numbered rows (``_r`` from 0 in the order of ``id_col``) for some places in ``tags``.

    The k-th row takes the features of the row with the k-th smallest hash for the group and repeat. Slices of the hashes
    are only counted first, which tells the places that each of them fills; then own rows and donors meet slice by slice.
    A copy moves once on either side, and no table of copies is sorted or held.
    """
    features = sorted({f for members in groups.values() for f in members})
    digits = next(d for d in range(1, 7) if n <= SLICE_ROWS * 16**d or d == 6)

    def copies(rows: DataFrame, some: list[int]) -> DataFrame:
        tag = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.lit(f"|{tags[i][0]}|{tags[i][1]}").alias("salt")) for i in some]))
        hashed = rows.withColumn("_t", tag).withColumn("_hash", F.coalesce(hash_key(id_col, F.col("_t.salt")), F.lit("")))
        piece = F.coalesce(F.conv(F.substring("_hash", 1, digits), 16, 10).cast("int"), F.lit(0))
        return hashed.withColumn("_which", F.col("_t.which")).withColumn("_slice", piece).drop("_t")

    counted = np.zeros((len(tags), 16**digits), np.int64)  # one number a tag and slice
    for r in copies(numbered.select(id_col), list(range(len(tags)))).groupBy("_which", "_slice").agg(F.count("*").alias("_c")).collect():
        counted[r["_which"], r["_slice"]] = r["_c"]
    ends = counted.cumsum(axis=1)
    base = [f for f in numbered.schema.fields if f.name != "_r"]
    schema = StructType([*base, StructField("_which", IntegerType())])

    @F.arrow_udf("int")
    def slice_of(place: pa.Array, which: pa.Array) -> pa.Array:
        at, tag = place.to_numpy(zero_copy_only=False), which.to_numpy(zero_copy_only=False)
        out = np.zeros(len(at), np.int32)
        for t in np.unique(tag):
            out[tag == t] = np.searchsorted(ends[t], at[tag == t], side="right")
        return pa.array(out)

    def paired(own: pa.Table, donors: pa.Table) -> pa.Table:
        own = own.take(pc.sort_indices(own["_r"]))
        donors = donors.take(pc.sort_indices(donors, sort_keys=[("_key", "ascending"), ("_place", "ascending")]))
        taken = groups[tags[own["_which"][0].as_py()][0]]
        return pa.table([donors[f"_d_{c}"] if c in taken else own[c] for c in schema.names], names=schema.names)

    def made(some: list[int]) -> DataFrame:
        tasks = max(2 * numbered.sparkSession.sparkContext.defaultParallelism, -(-n * len(some) // COPIES_A_TASK))
        which = F.explode(F.array(*[F.lit(i) for i in some]))
        own = numbered.withColumn("_which", which).withColumn("_slice", slice_of(F.col("_r"), F.col("_which")))
        given = [F.when(F.col("_which").isin([i for i in some if f in groups[tags[i][0]]]), F.col(f)).alias(f"_d_{f}") for f in features]
        donors = copies(numbered.select(id_col, "_r", *[f for f in features if f != id_col]), some).select("_which", "_slice", F.col("_r").alias("_place"), F.unhex("_hash").alias("_key"), *given)
        keys = ["_which", "_slice"]
        return own.repartition(tasks, *keys).groupBy(*keys).cogroup(donors.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(paired, schema)

    return made


def permutation_importance(df: DataFrame, groups: dict[str, list[str]], predict: Predict, *, label: str = "label", id_col: str = "pixel_id",
                           repeats: int = 15, ddof: int = 1) -> DataFrame:
    """Drop in average precision when the features of a group are exchanged jointly between rows.

    All labelled rows take part. Every group and repeat pairs rows by two rankings, that of the identifiers and that of
    their hashes; copies are made slice by slice of the hashes and measured in passes (``effects.in_passes``).
    """
    from tailfield.operators.effects import in_passes, numbered_rows

    base = df.where(F.col(label).isNotNull())
    numbered, n = numbered_rows(base, id_col)
    tags = [(g, r) for g in groups for r in range(repeats)]
    made = by_slices(numbered, n, groups, tags, id_col) if n else None

    def measured(some: list[tuple[str, int]]) -> list[tuple]:
        scored = predict(made([tags.index(t) for t in some]))
        rows = binary_metrics(scored, label, "prediction", ["_which"]).select("_which", "average_precision", "n").collect()
        return [(*tags[r["_which"]], r["average_precision"], r["n"]) for r in rows]

    permuted = small_table(df.sparkSession, "group string, repeat int, average_precision double, n bigint", in_passes(df.sparkSession, n, tags, measured))
    baseline = binary_metrics(predict(base), label, "prediction").select("average_precision").scalar()
    drops = permuted.where(F.col("group").isNotNull()).withColumn("_b", baseline).withColumn("_drop", F.col("_b") - F.col("average_precision"))
    spread_of = F.stddev_samp("_drop") if ddof == 1 else F.stddev_pop("_drop")
    return drops.groupBy("group").agg(
        F.avg("_drop").alias("importance"), F.coalesce(spread_of, F.lit(0.0)).alias("importance_std"),
        F.first("_b").alias("baseline_average_precision"), F.count("*").alias("n_repeats"))


def ale_curve(df: DataFrame, feature: str, predict: Predict, n_bins: int = 16) -> DataFrame:
    """Accumulated local effect of a feature with a band of 1.96 standard errors.

    Rows carry both edge predictions side by side, so the difference needs no join.
    """
    rows = df.where(F.col(feature).isNotNull())
    quantiles = exact_quantiles(rows, feature, [i / n_bins for i in range(n_bins + 1)])
    edges = quantiles.select(F.array_distinct("quantiles").alias("e")).scalar()
    held = rows.withColumn("_e", edges).where(F.size("_e") >= 2)
    right = F.size(F.filter("_e", lambda e: e <= F.col(feature)))
    binned = held.withColumn("bin", F.least(F.greatest(right - 1, F.lit(0)), F.size("_e") - 2)).withColumn(
        "_lo", F.get("_e", F.col("bin"))).withColumn("_hi", F.get("_e", F.col("bin") + 1)).drop("_e")
    low = predict(binned.withColumn(feature, F.col("_lo"))).withColumnRenamed("prediction", "_p_lo")
    high = predict(low.withColumn(feature, F.col("_hi")))
    diff = F.col("prediction") - F.col("_p_lo")
    stats = high.groupBy("bin").agg(F.avg(diff).alias("_m"), F.coalesce(F.stddev_samp(diff), F.lit(0.0)).alias("_s"), F.count("*").alias("n"))
    frame = quantiles.select(F.array_distinct("quantiles").alias("_e")).where(F.size("_e") >= 2).select(
        "_e", F.explode(F.sequence(F.lit(0), F.size("_e") - 2)).alias("bin"))
    full = frame.join(stats, "bin", "left").fillna(0, ["n"]).withColumn("_m", F.coalesce("_m", F.lit(0.0))).withColumn(
        "_se2", F.when(F.col("n") > 0, F.col("_s") * F.col("_s") / F.col("n")).otherwise(0.0))
    # at most n_bins rows
    prior = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ale = F.coalesce(F.sum("_m").over(prior), F.lit(0.0)) + F.col("_m") * 0.5
    se = F.sqrt(F.coalesce(F.sum("_se2").over(prior), F.lit(0.0)) + F.col("_se2") * 0.25)
    out = full.withColumn("_a", ale).withColumn("_se", se).withColumn(
        "_c", F.sum(F.col("_a") * F.col("n")).over(everything) / F.sum("n").over(everything))
    y = F.col("_a") - F.col("_c")
    return out.select(
        "bin", ((F.get("_e", F.col("bin")) + F.get("_e", F.col("bin") + 1)) * 0.5).alias("x"), y.alias("y"),
        (y - F.col("_se") * 1.96).alias("ylo"), (y + F.col("_se") * 1.96).alias("yhi"), "n")


def ale_support(df: DataFrame, feature: str, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    return exact_quantiles(df, feature, [lo, hi]).select(
        F.get("quantiles", F.lit(0)).alias("support_low"), F.get("quantiles", F.lit(1)).alias("support_high"))


def curve_summary(curves: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    return curves.groupBy(*by).agg(
        F.count("*").alias("n_ale_bins"), F.min(x).alias("feature_min"), F.max(x).alias("feature_max"),
        F.min_by(y, x).alias("ale_start"), F.max_by(y, x).alias("ale_end"), F.min(y).alias("ale_min"), F.max(y).alias("ale_max"),
        (F.max(y) - F.min(y)).alias("ale_range"))


def partial_dependence(df: DataFrame, feature: str, predict: Predict, *, points: int = 40) -> DataFrame:
    """Mean prediction over all rows with the feature set to each of evenly spaced values between its 5 and 95 % quantiles."""
    rows = df
    limits = exact_quantiles(df, feature, [0.05, 0.95]).select("quantiles").scalar()
    step = (F.get("_q", F.lit(1)) - F.get("_q", F.lit(0))) / (points - 1)
    grid = rows.withColumn("_q", limits).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        feature, F.get("_q", F.lit(0)) + F.col("_i") * step).drop("_q")
    scored = predict(grid)
    band = F.stddev_pop("prediction") * 0.1
    return scored.groupBy("_i").agg(F.max(feature).alias("x"), F.avg("prediction").alias("y"), band.alias("_b")).select(
        F.col("_i").alias("point"), "x", "y", (F.col("y") - F.col("_b")).alias("ylo"), (F.col("y") + F.col("_b")).alias("yhi"))
