"""Reproducible samples and spatially blocked splits.

Every random choice orders rows or blocks by a hash of their identifier and a salt, so
a repeated or partly recomputed job draws the same sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailfield.operators.ordering import global_row_number
from tailfield.session import materialise

HEX = 4
BUCKETS = 16**HEX


def hash_key(id_col: str, salt) -> Column:
    salt = salt if isinstance(salt, Column) else F.lit(str(salt))
    return F.md5(F.concat(F.col(id_col).cast("string"), salt))


def hash_fraction(id_col: str, salt) -> Column:
    """Uniform in [0, 1) from the first 13 hexadecimal digits of the row's hash."""
    return F.conv(F.substring(hash_key(id_col, salt), 1, 13), 16, 10).cast("double") / float(16**13)


def smallest_keys(df: DataFrame, quota, id_col: str, strata: list[str] = (), salt="") -> DataFrame:
    """The ``quota`` rows with the smallest hashes of each stratum (all rows of smaller strata).

    A histogram over the leading hash digits shows in which slice of the hash range each
    quota ends. Rows beyond the slice are dropped before any shuffle, and rows are ordered
    only within one slice, so a stratum is never gathered in one task. ``quota`` is a number
    or a column over the strata, which must be few.
    """
    strata = list(strata)
    keyed = df.withColumn("_key", hash_key(id_col, salt)).withColumn(
        "_slice", F.conv(F.substring("_key", 1, HEX), 16, 10).cast("int"))
    if not strata:
        keyed = keyed.withColumn("_all", F.lit(0))
    by = strata or ["_all"]
    counts = keyed.groupBy(*by, "_slice").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy("_slice")
    running = counts.withColumn("_end", F.sum("_c").over(w)).withColumn(
        "_quota", quota if isinstance(quota, Column) else F.lit(quota))
    reached = F.col("_end") >= F.col("_quota")
    cuts = running.groupBy(*by).agg(
        F.coalesce(F.min(F.when(reached, F.col("_slice"))), F.lit(BUCKETS)).alias("_cut"),
        (F.max("_quota") - F.coalesce(F.max(F.when(~reached, F.col("_end"))), F.lit(0))).alias("_need"))
    # one row per stratum, a handful of fixed values
    held = keyed.join(F.broadcast(cuts), by).where(F.col("_slice") <= F.col("_cut"))
    order = Window.partitionBy(*by, "_slice").orderBy("_key", id_col)
    ranked = held.withColumn("_r", F.row_number().over(order))
    kept = ranked.where((F.col("_slice") < F.col("_cut")) | (F.col("_r") <= F.col("_need")))
    return kept.select(*df.columns)


def two_pass_sample(df: DataFrame, quota: int, id_col: str, strata: list[str], salt="0", slack: float = 1.15) -> DataFrame:
    """Bernoulli sample sized from a first count, then capped at the quota."""
    counts = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    share = F.least(F.lit(1.0), F.lit(slack * quota) / F.col("_n"))
    drawn = df.join(F.broadcast(counts), strata).where(hash_fraction(id_col, f"{salt}|draw") < share).select(*df.columns)
    return smallest_keys(drawn, quota, id_col, strata, salt)


def class_quotas(n_pos: int, n_neg: int, max_rows: int, min_pos: int = 500) -> tuple[int, int]:
    """Rows to draw per class: proportional, with at least ``min_pos`` positives when there are as many."""
    share = round(max_rows * n_pos / (n_pos + n_neg))
    pos = min(n_pos, max(min(min_pos, n_pos), share))
    neg = min(n_neg, max_rows - pos)
    return pos, neg if neg > 0 else min(n_neg, max(1, max_rows - pos))


def downsample_by_label(df: DataFrame, label: Column, max_rows: int, id_col: str, salt="0") -> DataFrame:
    """Label-proportional sample; evenly spaced rows in identifier order when only one class occurs."""
    flagged = df.withColumn("_y", F.coalesce(label, F.lit(False)))
    row = flagged.agg(F.count_if("_y").alias("p"), F.count_if(~F.col("_y")).alias("n")).first()
    total = row["p"] + row["n"]
    if total <= max_rows:
        return df
    if row["p"] == 0 or row["n"] == 0:
        step = (total - 1) / (max_rows - 1)
        ranked = global_row_number(flagged, [id_col], "_rn").withColumn("_i", F.col("_rn") - 1)
        j = F.ceil(F.col("_i") / step)
        return ranked.where(F.floor(j * step) == F.col("_i")).select(*df.columns)
    pos, neg = class_quotas(row["p"], row["n"], max_rows)
    quota = F.when(F.col("_y"), F.lit(pos)).otherwise(F.lit(neg))
    return smallest_keys(flagged, quota, id_col, ["_y"], salt).select(*df.columns)


def random_split(df: DataFrame, id_col: str, test: float, salt="0", out: str = "split") -> DataFrame:
    return df.withColumn(out, F.when(hash_fraction(id_col, salt) < test, "test").otherwise("train"))


def holdout_tries(blocks: DataFrame, test: float, seed: int, tries: int, block: str = "block_id") -> DataFrame:
    """For each try the blocks held out: the ceil(test * blocks) with the smallest hashes."""
    w = Window.partitionBy("_try").orderBy(hash_key(block, F.concat(F.lit("|"), F.col("_try").cast("string"))), block)
    names = blocks.select(block).distinct()
    n = names.agg(F.count("*")).scalar()
    return (
        names.withColumn("_try", F.explode(F.sequence(F.lit(seed), F.lit(seed + tries - 1))))
        .withColumn("_held", F.row_number().over(w) <= F.ceil(F.lit(test) * n))
    )


def blocked_holdout(df: DataFrame, *, test: float, seed: int = 42, tries: int = 64, block: str = "block_id", label: str = "label",
                    domain: str | None = None, min_rows: int = 200, out: str = "split") -> DataFrame:
    """Rows marked train or test by whole blocks.

    Tries are judged from per-block counts, a small table. A try is valid when both sides
    hold both classes (per domain, with at least ``min_rows`` rows, if a domain column is
    given). The first valid try within 1 % of the wanted rows wins, else the closest.
    """
    rows = df.where(F.col(block).isNotNull())
    dom = F.col(domain) if domain else F.lit("all")
    counts = rows.groupBy(block, dom.alias("_d")).agg(F.count("*").alias("_n"), F.sum(label).alias("_p"))
    tried = holdout_tries(counts, test, seed, tries, block)
    sides = counts.join(tried, block).groupBy("_try", "_d").agg(
        *[F.sum(F.when(cond, F.col(c)).otherwise(0)).alias(f"{c}_{s}")
          for s, cond in (("t", F.col("_held")), ("r", ~F.col("_held"))) for c in ("_n", "_p")])
    floor = min_rows if domain else 1
    ok = None
    for s in ("t", "r"):
        both = (F.col(f"_n_{s}") >= floor) & (F.col(f"_p_{s}") > 0) & (F.col(f"_p_{s}") < F.col(f"_n_{s}"))
        ok = both if ok is None else ok & both
    judged = sides.groupBy("_try").agg(F.min(ok).alias("ok"), F.sum("_n_t").alias("t"), F.sum(F.col("_n_t") + F.col("_n_r")).alias("n"))
    score = F.abs(F.col("t") - F.col("n") * test)
    near = score <= F.col("n") * 0.01
    order = F.struct(F.when(near, 0).otherwise(1).alias("a"), F.when(near, 0.0).otherwise(score).alias("b"), F.col("_try"))
    chosen = judged.where("ok").agg(F.min_by("_try", order).alias("c")).select(
        F.coalesce("c", F.raise_error(F.lit("no valid blocked split")).cast("int"))).scalar()
    held = tried.where(F.col("_try") == chosen).select(block, F.when(F.col("_held"), "test").otherwise("train").alias(out))
    return rows.join(held, block)


def three_way_split(df: DataFrame, *, calibration: float = 0.2, test: float = 0.2, seed: int = 42, tries: int = 128, **kw) -> DataFrame:
    """train / calibration / test by blocks: the holdout of a first split is split again."""
    holdout = calibration + test
    first = blocked_holdout(df, test=holdout, seed=seed, tries=tries, out="_first", **kw)
    again = blocked_holdout(first.where("_first = 'test'"), test=test / holdout, seed=seed + 1000, tries=tries, out="_second", **kw)
    block = kw.get("block", "block_id")
    second = again.select(block, "_second").distinct()
    return first.join(second, block, "left").withColumn(
        "split", F.when(F.col("_first") == "train", "train").when(F.col("_second") == "train", "calibration").otherwise("test")
    ).drop("_first", "_second")


def group_folds(df: DataFrame, folds: int, block: str = "block_id", out: str = "fold") -> DataFrame:
    """Fold per block: blocks by falling size, each to the lightest fold so far.

    Blocks of one size fill the folds level by level: with ``load = q * size + r`` a fold takes one block at each level from
    its ``q`` on, and within a level folds follow by ``r``, then by number. So only the different sizes, with the loads before
    each, are gone through one after the other, and a block's fold follows from its place among those of its size.
    """
    sizes = materialise(df.where(F.col(block).isNotNull()).groupBy(block).agg(F.count("*").alias("_n")))
    runs = sizes.groupBy("_n").agg(F.count("*").alias("_c"))
    listed = runs.agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("s"), F.col("_c").alias("c")))).alias("items"), F.sum("_c").alias("_blocks"))
    k = F.greatest(F.lit(2), F.least(F.lit(folds), F.coalesce("_blocks", F.lit(0)))).cast("int")
    numbers = F.sequence(F.lit(0), k - 1)
    no_load = F.transform(numbers, lambda _: F.lit(0).cast("long"))
    start = F.struct(no_load.alias("loads"), F.array().cast("array<array<bigint>>").alias("before"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda x, y: x + y)

    def filled(loads: Column, size: Column, place: Column) -> Column:
        """For the block at ``place`` (from 0) of a run: its level ``v`` and the number ``t`` of blocks on lower levels."""
        q = F.transform(loads, lambda v: F.floor(v / size).cast("long"))
        # the levels at which another fold joins, with the blocks below each; the last one not beyond the place decides
        joins = F.transform(q, lambda v: F.struct(total(F.transform(q, lambda o: F.greatest(v - o, F.lit(0)))).alias("t"), v.alias("v"), total(
            F.transform(q, lambda o: (o <= v).cast("long"))).alias("w")))
        last = F.array_max(F.filter(joins, lambda j: j["t"] <= place))
        more = F.floor((place - last["t"]) / last["w"]).cast("long")
        return F.struct((last["v"] + more).alias("v"), (last["t"] + more * last["w"]).alias("t"))

    def on_level(loads: Column, size: Column, level: Column) -> Column:
        """The folds that take a block at the level, in their order."""
        ranked = F.zip_with(loads, numbers, lambda v, i: F.struct((v % size).alias("r"), i.alias("i"), F.floor(v / size).cast("long").alias("q")))
        return F.transform(F.array_sort(F.filter(ranked, lambda x: x["q"] <= level)), lambda x: x["i"])

    def step(state: Column, item: Column) -> Column:
        """The loads after a run: each fold has its blocks on the levels below the next one's, and on that level those before it."""
        loads, size = state["loads"], -item["s"]
        at = filled(loads, size, item["c"])
        first = F.slice(on_level(loads, size, at["v"]), F.lit(1), (item["c"] - at["t"]).cast("int"))
        new = F.zip_with(loads, numbers, lambda v, i: v + size * (F.greatest(at["v"] - F.floor(v / size).cast("long"), F.lit(0)) + F.array_contains(first, i).cast("long")))
        return F.struct(new.alias("loads"), F.concat(state["before"], F.array(loads)).alias("before"))

    # one row a size
    gone = listed.select("items", k.alias("_k"), F.aggregate("items", start, step).alias("st"))
    table = materialise(gone.select("_k", F.explode(F.arrays_zip("items", F.col("st.before").alias("before"))).alias("z")).select(
        (-F.col("z.items.s")).alias("_n"), F.col("z.before").alias("_loads")))
    ranked = global_row_number(sizes, [F.desc("_n"), block], "_rn")
    firsts = ranked.groupBy("_n").agg(F.min("_rn").alias("_first"))
    placed = ranked.join(F.broadcast(table.join(firsts, "_n")), "_n").withColumn("_place", F.col("_rn") - F.col("_first"))
    k = F.size("_loads")
    numbers = F.sequence(F.lit(0), k - 1)
    at = placed.withColumn("_at", filled(F.col("_loads"), F.col("_n"), F.col("_place")))
    found = at.select(block, F.get(on_level(F.col("_loads"), F.col("_n"), F.col("_at.v")), (F.col("_place") - F.col("_at.t")).cast("int")).alias(out))
    return df.join(found, block)
