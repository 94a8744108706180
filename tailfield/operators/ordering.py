"""Ranks, running totals and exact quantiles over whole tables.

A window without a partition key runs in one task. The helpers here keep the work
spread out: a range-partitioned sort gives every row its place inside its
partition, and a table with one row per partition gives the offsets. Rows with
equal values may lie in different partitions because the sort key includes the
tie-breaker, so one hot value does not make one hot task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailfield.functions.numeric import col
from tailfield.session import materialise

PART_BITS = 33


def _sorted_rows(df: DataFrame, order: list) -> DataFrame:
    """Rows in global order with ``_part`` and ``_pos``, held by a checkpoint."""
    ordered = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    return (
        materialise(ordered)
        .withColumn("_part", F.shiftrightunsigned("_mid", PART_BITS))
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << PART_BITS) - 1)))
    )


def _before(name: str, keys=()) -> Column:
    """Sum over the earlier partitions, for tables with one row per partition and key."""
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(w), F.lit(0))


def global_row_number(df: DataFrame, order: list, out: str = "rn", by: list[str] = ()) -> DataFrame:
    """``row_number`` over the whole table, or within each of a few ``by`` groups."""
    by = list(by)
    rows = _sorted_rows(df, by + list(order))
    offsets = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", _before("_n").alias("_off"))
    numbered = rows.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_off") + F.col("_pos") + 1)
    if by:
        starts = numbered.groupBy(*by).agg((F.min(out) - 1).alias("_start"))
        # one row per group, and groups are few
        numbered = numbered.join(F.broadcast(starts), by).withColumn(out, F.col(out) - F.col("_start")).drop("_start")
    return numbered.drop("_part", "_pos", "_mid", "_off")


def running_totals(df: DataFrame, order: list, sums: dict[str, str], by: list[str] = ()) -> DataFrame:
    """Inclusive running sums ``{output: column}`` in the given order.

    ``df`` should hold one row per order key: aggregate first, so that ties share
    a total and hot values are already folded. ``by`` must take few values.
    """
    by = list(by)
    rows = _sorted_rows(df, by + list(order))
    local = Window.partitionBy("_part", *by).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.select("*", *[F.sum(c).over(local).alias(f"_l_{o}") for o, c in sums.items()])
    totals = rows.groupBy("_part", *by).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    offsets = totals.select("_part", *by, *[_before(f"_t_{o}", by).alias(f"_o_{o}") for o in sums])
    # at most one row per sort partition and group
    joined = inner.join(F.broadcast(offsets), ["_part", *by])
    for o in sums:
        joined = joined.withColumn(o, F.col(f"_l_{o}") + F.col(f"_o_{o}")).drop(f"_l_{o}", f"_o_{o}")
    return joined.drop("_part", "_pos", "_mid")


def exact_quantiles(
    df: DataFrame,
    value,
    qs: list[float],
    by: list[str] = (),
    *,
    accuracy: int = 100_000,
    small_groups: bool = False,
) -> DataFrame:
    """Linearly interpolated quantiles, exact, per group: columns ``by``, ``n``, ``quantiles``.

    A mergeable sketch brackets every requested rank. Rows between the brackets are only
    counted, with their smallest and largest value, which answer a rank just outside a bracket;
    the distinct values inside, a few hundred-thousandths of the rows, are ordered bracket by
    bracket to read off the exact order statistics. The same path serves every size.
    ``small_groups`` says that ``by`` takes a handful of fixed values, which makes the bracket
    table broadcastable.
    """
    by = list(by)
    values = df.select(*by, col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    eps = 2.0 / accuracy
    ordered = sorted(set(qs))
    probes = [p for q in ordered for p in (max(q - eps, 0.0), min(q + eps, 1.0))]
    sketch = F.percentile_approx("_v", probes, accuracy)
    if by:
        brackets = values.groupBy(*by).agg(sketch.alias("_b"))
        held = values.join(F.broadcast(brackets) if small_groups else brackets, by)
    else:
        held = values.withColumn("_b", values.agg(sketch.alias("_b")).scalar())
    above = reduce(
        lambda a, b: a + b,
        [(F.col("_v") > F.get(F.col("_b"), F.lit(2 * k + 1))).cast("int") for k in range(len(ordered))],
    )
    inside = F.coalesce(F.col("_v") >= F.get(F.col("_b"), F.col("_k") * 2), F.lit(False))
    compact = (
        held.withColumn("_k", above)
        .withColumn("_seg", F.col("_k") * 2 + inside.cast("int"))
        .withColumn("_x", F.when(inside, F.col("_v")))
        .groupBy(*by, "_seg", "_x")
        .agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    )
    # one row per group and segment
    segments = compact.groupBy(*by, "_seg").agg(F.sum("_c").alias("_sc"))
    w = Window.partitionBy(*by)
    placed = segments.withColumn("_n", F.sum("_sc").over(w)).withColumn(
        "_start", F.sum("_sc").over(w.orderBy("_seg").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sc")).drop("_sc")
    matched = reduce(lambda a, b: a & b, [F.col(f"_p_{c}").eqNullSafe(F.col(c)) for c in [*by, "_seg"]])
    renamed = placed.select(*[F.col(c).alias(f"_p_{c}") for c in [*by, "_seg"]], "_n", "_start")
    inner = Window.partitionBy(*by, "_seg").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = compact.withColumn("_run", F.sum("_c").over(inner)).join(renamed, matched).withColumn("_end", F.col("_start") + F.col("_run"))

    def at_rank(rank: Column) -> Column:
        hit = (rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_c"))
        edge = F.when(rank == F.col("_end") - F.col("_c"), F.col("_low")).when(rank == F.col("_end") - 1, F.col("_high"))
        return F.max(F.when(hit, F.coalesce("_x", edge)))

    picks = []
    for i, q in enumerate(ordered):
        h = F.lit(float(q)) * (F.col("_n") - 1)
        low = F.floor(h)
        picks += [
            at_rank(low).alias(f"_lo{i}"),
            at_rank(F.least(low + 1, F.col("_n") - 1)).alias(f"_hi{i}"),
            F.max(h - low).alias(f"_f{i}"),
        ]
    stats = ranked.groupBy(*by).agg(F.max("_n").alias("n"), *picks)
    missed = F.raise_error(F.lit("quantile outside its bracket")).cast("double")

    def read(i: int) -> Column:
        lo, hi = F.coalesce(F.col(f"_lo{i}"), missed), F.coalesce(F.col(f"_hi{i}"), missed)
        return F.when(F.col("n") > 0, lo + (hi - lo) * F.col(f"_f{i}"))

    found = {q: read(i) for i, q in enumerate(ordered)}
    return stats.select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.array(*[found[q] for q in qs]).alias("quantiles"))


def quantile_scalar(df: DataFrame, value, q: float) -> Column:
    """One exact quantile of the whole table as a scalar subquery."""
    return exact_quantiles(df, value, [q]).select(F.get("quantiles", F.lit(0)).alias("q")).scalar()


def attach_quantiles(
    df: DataFrame, value, qs: list[float], names: list[str], by: list[str] = (), *, small_groups: bool = False
) -> DataFrame:
    """Exact quantiles joined back to the rows (scalar subquery when there is no group)."""
    by = list(by)
    table = exact_quantiles(df, value, qs, by, small_groups=small_groups)
    if not by:
        out = df.withColumn("_q", table.select("quantiles").scalar())
    else:
        table = table.select(*by, F.col("quantiles").alias("_q"))
        out = df.join(F.broadcast(table) if small_groups else table, by, "left")
    return out.select(*df.columns, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)])
