"""Second-order boosting of the log loss over the shared table of bins.

Each round fits one tree to gradients and Hessians. A level of a tree is a histogram of their sums by (node, feature, bin); a
node takes the cut of greatest gain, a leaf the Newton step. Gradients are rounded to whole multiples of 1 / ``UNIT``, so sums
are exact and the same trees come out in whatever order rows are added. Rows and features of a round are drawn by hashes.

There are two ways to fit, with equal results and all rows of a fit. ``boost`` has no bound on rows: a level is one aggregation,
folded before the shuffle, of which at most one row a node comes to the driver. ``boost_dealt`` takes many fits over one table of
at most ``HELD_ROWS`` rows (folds, kinds) and deals them to tasks, as the rounds of one fit depend on each other and fits do not.
``Boosted`` takes one or the other by the number of rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailfield.operators.sampling import smallest_keys
from tailfield.operators.trees import BINS, HELD_ROWS, Bins, _stored, leaf_sum, packed_shape, walkable
from tailfield.session import small_table

UNIT = 1 << 20
STOP_ROWS = 10_000  # a held-out tenth may end a fit early where there are more rows than this
BETTER = 1e-7  # smaller changes of the held-out loss do not count
EVERY_FOLD = -1


@dataclass(frozen=True)
class Settings:
    """One kind of fit. ``leaves`` bounds a tree's leaves, which are opened by falling gain; ``patience`` is the number of rounds
    without a lower held-out loss that ends a fit; ``weighted`` gives both classes the same total weight."""

    rounds: int = 350
    rate: float = 0.05
    depth: int = 6
    leaves: int | None = 31
    leaf_rows: int = 20
    leaf_hessian: float = 1e-3
    ridge: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    weighted: bool = False
    patience: int | None = 10


PLAIN = Settings()
DRAWN = Settings(leaves=None, leaf_rows=1, leaf_hessian=1.0, ridge=1.0, row_share=0.85, column_share=0.85, weighted=True, patience=None)


def draw_rows(df: DataFrame, features: list[str], label: str = "label", ident: str = "pixel_id", fold: str | None = None, limit: int | None = None) -> DataFrame:
    """Features, label, hash number ``draw`` and ``fold`` of the rows of a fit, stored; all rows, unless ``limit`` is given (see ``trees.fit_rows``)."""
    rows = df.where(F.col(label).isNotNull()).select(
        F.col(ident).alias("_id"), *features, F.col(label).cast("int").alias("label"), row_draw(F.col(ident)).alias("draw"),
        (F.lit(EVERY_FOLD) if fold is None else F.col(fold)).cast("int").alias("fold"))
    if limit is not None and rows.count() > limit:
        rows = smallest_keys(rows, limit, "_id", salt="|fit")
    return _stored(rows.drop("_id"))


def binned(rows: DataFrame, bins: Bins) -> DataFrame:
    """The bins, label, draw and fold of the rows of a fit, stored: all fits over these rows share it."""
    return _stored(bins.apply(rows).select(*bins.columns, "label", "draw", "fold"))


def row_draw(ident: Column) -> Column:
    return F.conv(F.substring(F.md5(ident.cast("string")), 1, 8), 16, 10).cast("long")


def factor(tree: int) -> int:
    """The odd number below 2**31 that spreads the rows' hashes anew in each round; the product fits in a long."""
    return int(hashlib.md5(f"{tree}|rows".encode()).hexdigest()[:8], 16) >> 1 | 1


def in_round(draw, tree: int, share: float):
    """Whether a row is drawn; for columns and arrays."""
    if isinstance(draw, Column):
        return F.lit(True) if share >= 1 else F.shiftright(draw * F.lit(factor(tree)), 24).bitwiseAND(F.lit(UNIT - 1)) < F.lit(round(share * UNIT))
    return np.ones(len(draw), bool) if share >= 1 else (draw * factor(tree) >> 24) & (UNIT - 1) < round(share * UNIT)


def round_features(features: list[str], tree: int, share: float) -> list[int]:
    """Places of the features that a round may cut."""
    order = sorted(range(len(features)), key=lambda i: hashlib.md5(f"{tree}|{features[i]}|column".encode()).hexdigest())
    return sorted(order[:max(1, math.floor(share * len(features)))])


def start(n: int, positives: int, s: Settings) -> tuple[float, float]:
    """The score before the first round and the weight of positives."""
    if not 0 < positives < n:
        raise ValueError("a fit needs rows of both classes")
    return (0.0, (n - positives) / positives) if s.weighted else (math.log(positives / (n - positives)), 1.0)


def opened(gains: dict[int, float], leaves: int | None) -> set[int]:
    """The nodes that are cut: all that can be, or those of greatest gain whose parents are cut, up to the number of leaves."""
    if leaves is None:
        return set(gains)
    heap, out = [(-gains[1], 1)] if 1 in gains else [], set()
    while heap and len(out) + 1 < leaves:
        node = heapq.heappop(heap)[1]
        out.add(node)
        for child in (2 * node, 2 * node + 1):
            if child in gains:
                heapq.heappush(heap, (-gains[child], child))
    return out


def finished(losses: list[float], patience: int) -> bool:
    return len(losses) > patience and min(losses[-patience:]) > losses[-patience - 1] - BETTER


def _tree(levels: dict[int, tuple], s: Settings) -> list[tuple]:
    """``node, n, feature, cut, gain, value`` of one tree, from ``n, g, h, (gain, feature, cut)`` of every node looked at."""
    cut = opened({k: v[3][0] for k, v in levels.items() if v[3]}, s.leaves)
    out = []
    for node, (n, g, h, best) in sorted(levels.items()):
        if node == 1 or node // 2 in cut:
            value = -s.rate * (g / UNIT) / (h / UNIT + s.ridge) if h or s.ridge else 0.0
            out.append((node, n, best[1], best[2], best[0], None) if node in cut else (node, n, None, None, None, value))
    return out


def _gradients(raw, label, weight: float, exp, floor, pick):
    """Whole gradients and Hessians; for columns and arrays."""
    p = 1.0 / (exp(-raw) + 1.0)
    return floor((p - label) * pick(label == 1, weight, 1.0) * float(UNIT) + 0.5), floor(p * (1.0 - p) * pick(label == 1, weight, 1.0) * float(UNIT) + 0.5)


def best_cuts(state: DataFrame, bins: Bins, used: list[int], s: Settings, cutting: bool) -> DataFrame:
    """One row for each ``node`` of ``state(node, g, h, bins)``: rows, sums and the cut of greatest gain, if any has gain."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(bins.columns[i]).cast("int").alias("bin")) for i in used])).alias("x")
    hist = state.select("node", "g", "h", cells).groupBy("node", "x.feature", "x.bin").agg(F.count("*").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))
    whole = Window.partitionBy("node", "feature")
    below = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = hist.select("node", "feature", (F.col("bin") + 1).alias("cut"), *[F.sum(c).over(w).alias(p + c) for c in ("n", "g", "h") for p, w in (("l", below), ("a", whole))])
    part = {"l": [F.col(f"l{c}") for c in "ngh"], "a": [F.col(f"a{c}") for c in "ngh"]}
    part["r"] = [a - b for a, b in zip(part["a"], part["l"], strict=True)]

    def term(side: str) -> Column:
        g, h = part[side][1].cast("double") / UNIT, part[side][2].cast("double") / UNIT
        return g * g / (h + F.lit(s.ridge))

    enough = [(part[x][0] >= s.leaf_rows) & (part[x][2] > 0) & (part[x][2].cast("double") / UNIT >= s.leaf_hessian) for x in "lr"]
    gain = F.when(enough[0] & enough[1] & F.lit(cutting), term("l") + term("r") - term("a"))
    option = F.when(F.col("gain") > 0, F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("cut")).alias("c")))
    return sums.withColumn("gain", gain).groupBy("node").agg(F.any_value("an").alias("n"), F.any_value("ag").alias("g"), F.any_value("ah").alias("h"), F.max(option).alias("best"))


NODES = "fit int, tree int, node int, n bigint, feature int, cut int, gain double, value double"


def boost(table: DataFrame, bins: Bins, s: Settings, fit: int = 0, without: int = EVERY_FOLD) -> DataFrame:
    """Nodes of all rounds (``fit, tree, node, n, feature, cut, gain, value``; leaves have a value), fitted on rows of other folds."""
    spark = table.sparkSession
    rows = table if without == EVERY_FOLD else table.where(F.col("fold") != without)
    held = F.lit(s.patience is not None and rows.count() > STOP_ROWS) & (F.col("draw") % 10 == 0)
    size = rows.where(~held).agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    base, weight = start(size["n"], size["p"] or 0, s)
    state, losses, out = _stored(rows.withColumns({"held": held, "raw": F.lit(base)})), [], []
    for tree in range(s.rounds):
        used, levels = round_features(bins.features, tree, s.column_share), {}
        g, h = _gradients(F.col("raw"), F.col("label"), weight, F.exp, F.floor, lambda c, a, b: F.when(c, F.lit(a)).otherwise(F.lit(b)))
        at = state.where(~F.col("held") & in_round(F.col("draw"), tree, s.row_share)).withColumns({"g": g.cast("long"), "h": h.cast("long"), "node": F.lit(1)})
        for level in range(s.depth + 1):
            found = best_cuts(at, bins, used, s, level < s.depth).collect()
            levels |= {r["node"]: (r["n"], r["g"], r["h"], r["best"] and (r["best"]["gain"], -r["best"]["f"], -r["best"]["c"])) for r in found}
            cuts = {r["node"]: levels[r["node"]][3] for r in found if r["best"]}
            if not cuts:
                break
            at = _step(at.where(F.col("node").isin(list(cuts))), bins, cuts)
        nodes = _tree(levels, s)
        out += [(fit, tree, *r) for r in nodes]
        state = _stored(_add(state, bins, nodes))
        if s.patience is not None and losses is not None:
            loss = state.where("held").agg(F.avg(F.log1p(F.exp(F.when(F.col("label") == 1, -F.col("raw")).otherwise(F.col("raw")))))).first()[0]
            losses = None if loss is None else [*losses, loss]
            if losses and finished(losses, s.patience):
                break
    return small_table(spark, NODES, out)


def _step(at: DataFrame, bins: Bins, cuts: dict[int, tuple]) -> DataFrame:
    """Rows of cut nodes move to the children."""
    low, high = min(cuts), max(cuts)
    feature, cut = (F.array(*[F.lit(cuts[k][i] if k in cuts else None).cast("int") for k in range(low, high + 1)]) for i in (1, 2))
    place = F.col("node") - low
    right = F.get(F.array(*[F.col(c).cast("int") for c in bins.columns]), F.get(feature, place)) >= F.get(cut, place)
    return at.withColumn("node", F.when(F.get(cut, place).isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(right, 1).otherwise(0)))


def _add(state: DataFrame, bins: Bins, nodes: list[tuple]) -> DataFrame:
    """The round's leaf values added to every row's score."""
    inner: dict[int, dict[int, tuple]] = {}
    for node, _, feature, cut, gain, _ in nodes:
        if feature is not None:
            inner.setdefault(node.bit_length(), {})[node] = (gain, feature, cut)
    at = state.withColumn("node", F.lit(1))
    for level in sorted(inner):
        at = _step(at, bins, inner[level])
    values = {r[0]: r[5] for r in nodes if r[2] is None}
    leaf = F.array(*[F.lit(values.get(k, 0.0)) for k in range(max(values) + 1)])
    return at.withColumn("raw", F.col("raw") + F.get(leaf, F.col("node"))).drop("node")


def _rounds(x: np.ndarray, label: np.ndarray, draw: np.ndarray, features: list[str], s: Settings) -> Iterator[list[tuple]]:
    """The trees of one fit over arrays, round by round."""
    held = (draw % 10 == 0) if s.patience is not None and len(x) > STOP_ROWS else np.zeros(len(x), bool)
    base, weight = start(int((~held).sum()), int(label[~held].sum()), s)
    raw, losses, wide = np.full(len(x), base), [], int(x.max(initial=0)) + 1
    for tree in range(s.rounds):
        used, levels = round_features(features, tree, s.column_share), {}
        g, h = _gradients(raw, label, weight, np.exp, np.floor, np.where)
        alive = np.flatnonzero(~held & in_round(draw, tree, s.row_share))
        node = np.ones(len(x), np.int64)
        for level in range(s.depth + 1):
            names, place = np.unique(node[alive], return_inverse=True)
            if not len(names):
                break
            shape = (len(names), len(used), wide)
            hist = np.empty((3, *shape))
            for j, f in enumerate(used):
                key = place * wide + x[alive, f]
                for c, w in enumerate((None, g[alive], h[alive])):
                    hist[c, :, j] = np.bincount(key, w, len(names) * wide).reshape(len(names), wide)
            left = hist.cumsum(axis=3)
            whole = left[..., -1:]
            right = whole - left

            def term(v: np.ndarray) -> np.ndarray:
                return (v[1] / UNIT) * (v[1] / UNIT) / (v[2] / UNIT + s.ridge)

            ok = np.full(shape, level < s.depth)
            for v in (left, right):
                ok &= (v[0] >= s.leaf_rows) & (v[2] > 0) & (v[2] / UNIT >= s.leaf_hessian)
            with np.errstate(all="ignore"):
                gain = np.where(ok, term(left) + term(right) - term(whole), 0.0).reshape(len(names), -1)
            best = gain.argmax(axis=1)
            cuts = {}
            for k, name in enumerate(names.tolist()):
                top = float(gain[k, best[k]])
                choice = (top, used[int(best[k]) // wide], int(best[k]) % wide + 1) if top > 0 else None
                levels[name] = (int(whole[0, k, 0, 0]), int(whole[1, k, 0, 0]), int(whole[2, k, 0, 0]), choice)
                if choice:
                    cuts[k] = choice
            feature, cut = np.full(len(names), -1), np.zeros(len(names), np.int64)
            for k, (_, f, t) in cuts.items():
                feature[k], cut[k] = f, t
            going = feature[place] >= 0
            alive, place = alive[going], place[going]
            node[alive] = 2 * node[alive] + (x[alive, feature[place]] >= cut[place])
        nodes = _tree(levels, s)
        yield nodes
        raw += _leaf_values(x, nodes)
        if held.any():
            side = np.where(label[held] == 1, -raw[held], raw[held])
            losses.append(float(np.log1p(np.exp(side)).mean()))
            if finished(losses, s.patience):
                return


def _leaf_values(x: np.ndarray, nodes: list[tuple]) -> np.ndarray:
    last = nodes[-1][0] + 1
    feature, cut, value = np.full(last, -1), np.zeros(last, np.int64), np.zeros(last)
    for node, _, f, t, _, v in nodes:
        feature[node], cut[node], value[node] = (-1, 0, v) if f is None else (f, t, 0.0)
    at, going = np.ones(len(x), np.int64), np.arange(len(x))
    while len(going):
        going = going[feature[at[going]] >= 0]
        at[going] = 2 * at[going] + (x[going, feature[at[going]]] >= cut[at[going]])
    return value[at]


def boost_dealt(table: DataFrame, bins: Bins, fits: list[tuple[Settings, int]]) -> DataFrame:
    """The same nodes as ``boost`` for each (settings, fold left out), ``fit`` being the place in the list; each fit is a task."""
    spark, features = table.sparkSession, list(bins.features)
    held = table.select(*bins.columns, "label", "draw", "fold").limit(HELD_ROWS + 1).toArrow()
    if held.num_rows > HELD_ROWS:
        raise ValueError(f"more than {HELD_ROWS} rows; use boost")
    k = len(bins.columns)
    shared = spark.sparkContext.broadcast((np.stack([c.to_numpy() for c in held.columns[:k]], axis=1).astype(np.int16), *[c.to_numpy().astype(np.int64) for c in held.columns[k:]]))

    def run(batches):
        x, label, draw, fold = shared.value
        for batch in batches:
            for fit in batch.column(0).to_pylist():
                settings, without = fits[fit]
                mine = np.ones(len(x), bool) if without == EVERY_FOLD else fold != without
                rows = [(fit, tree, *r) for tree, nodes in enumerate(_rounds(x[mine], label[mine], draw[mine], features, settings)) for r in nodes]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=[c.split()[0] for c in NODES.split(", ")])

    return _stored(spark.range(0, len(fits), 1, len(fits)).mapInArrow(run, NODES))


TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]


class Boosted:
    """One fit's trees; ``predict`` adds the probability."""

    def __init__(self, bins: Bins, nodes: DataFrame, base: float):
        self.bins, self.nodes, self.base, self._shared = bins, nodes, base, None

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], settings: Settings = PLAIN, *, bins: Bins | None = None, label: str = "label", ident: str = "pixel_id",
            limit: int | None = None):
        rows = draw_rows(df, features, label, ident, limit=limit)
        bins = bins or Bins.fit(rows, features, BINS)
        return cls.fit_all(binned(rows, bins), bins, [(settings, EVERY_FOLD)])[0]

    @classmethod
    def fit_all(cls, table: DataFrame, bins: Bins, fits: list[tuple[Settings, int]]) -> list[Boosted]:
        """One model for each (settings, fold left out), fitted side by side over the shared table."""
        if table.count() > HELD_ROWS:
            nodes = reduce(DataFrame.unionByName, [boost(table, bins, s, i, without) for i, (s, without) in enumerate(fits)])
        else:
            nodes = boost_dealt(table, bins, fits)
        counts = table.groupBy("fold").agg(*[f.alias(n) for n, f in (
            ("n", F.count("*")), ("p", F.sum("label")), ("hn", F.count_if(F.col("draw") % 10 == 0)), ("hp", F.count_if((F.col("draw") % 10 == 0) & (F.col("label") == 1))))]).collect()
        out = []
        for i, (s, without) in enumerate(fits):
            n, p, hn, hp = (sum(r[c] for r in counts if without == EVERY_FOLD or r["fold"] != without) for c in ("n", "p", "hn", "hp"))
            stops = s.patience is not None and n > STOP_ROWS
            out.append(cls(bins, nodes.where(F.col("fit") == i), start(n - hn * stops, p - hp * stops, s)[0]))
        return out

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if self._shared is None:  # rounds times twice the leaves of a tree: a few thousand rows
            held = self.nodes.toArrow()
            self._shared = self.nodes.sparkSession.sparkContext.broadcast(packed(held))
        raw = leaf_sum(self._shared, self.bins.columns) + F.lit(self.base)
        return self.bins.apply(df).withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-raw))).drop(*self.bins.columns)


def packed(nodes: pa.Table) -> tuple:
    feature, cut, left, roots, order = packed_shape(nodes)
    return walkable(feature, cut, left, np.asarray(nodes["value"].fill_null(0.0))[order], roots)
