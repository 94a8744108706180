"""Bagged trees over the shared table of bins: every cut of the tried features is looked at, down to leaves of two rows.

A row's number of copies in a tree's bag follows a Poisson law of mean one, drawn by a hash of row and tree, so bags need no
order of rows and no count of them. Class weights are those of the bag. Trees are dealt to tasks, each of which holds the
bins of at most ``HELD_ROWS`` rows; a level is solved by ordering the rows by node and bin, so memory does not grow with nodes.
Above that the nodes of more rows are solved by histograms and what lies below them is dealt (``subtrees``), with equal results.
"""

from __future__ import annotations

import hashlib
import math
import os

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailfield.operators import subtrees as sub
from tailfield.operators.boosting import EVERY_FOLD, NODES, TYPES, binned, draw_rows, packed
from tailfield.operators.trees import BINS, DEEPEST, HELD_ROWS, LEAF_ROWS, Bins, _draws, _stored, impurity, summed
from tailfield.session import scratch_dir

TREES = 350
COPIES = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12)]  # the law's running total


def bag_copies(draw: np.ndarray, tree: int) -> np.ndarray:
    """Copies of each row in a tree's bag."""
    odd = int(hashlib.md5(f"{tree}|bag".encode()).hexdigest()[:8], 16) >> 1 | 1
    return np.searchsorted(COPIES, ((draw * odd >> 24) & 0xFFFFFFFF) / 4294967296.0, side="right")


def bag_weights(bag: int, ones: int) -> tuple[float, float]:
    return (bag / (2.0 * (bag - ones)) if bag > ones else 0.0), (bag / (2.0 * ones) if ones else 0.0)


def _feature_cuts(key: np.ndarray, wide: int, copies: np.ndarray, positive: np.ndarray, totals: np.ndarray, weights: tuple[float, float], leaf_rows: int):
    """Least impurity after a cut of one feature, and that cut, for each node; infinite where no cut leaves enough rows."""
    order = np.argsort(key)  # rows with one key are only counted
    ordered = key[order]
    last = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True))
    node, bin_ = np.divmod(ordered[last], wide)
    before = np.cumsum(totals, axis=1) - totals
    left = np.stack([last + 1, np.cumsum(copies[order])[last], np.cumsum(positive[order])[last]]) - before[:, node]
    right = totals[:, node] - left
    ok = (left[0] >= leaf_rows) & (right[0] >= leaf_rows)
    with np.errstate(all="ignore"):
        after = np.where(ok, impurity(left[1], left[2], weights) + impurity(right[1], right[2], weights), np.inf)
    least = np.minimum.reduceat(after, np.flatnonzero(np.append(True, node[1:] != node[:-1])))
    at = np.flatnonzero(after == least[node])
    return least, bin_[at[np.unique(node[at], return_index=True)[1]]] + 1


def bagged_tree(tree: int, x: np.ndarray, label: np.ndarray, draw: np.ndarray, features: list[str], depth: int, tried: int, leaf_rows: int, root: int = 1,
                weights: tuple[float, float] | None = None) -> list[tuple]:
    """``node, n, feature, cut, gain, value`` of one tree: rows with copies, the fall in impurity, the leaf's weighted positive share.

    For the part of a tree below ``root``, ``weights`` are those of the whole bag.
    """
    copies = bag_copies(draw, tree)
    alive = np.flatnonzero(copies)
    weights = weights or bag_weights(int(copies.sum()), int(copies[label == 1].sum()))
    wide, at, out = int(x.max(initial=0)) + 1, np.full(len(x), root, np.int64), []
    for level in range(root.bit_length() - 1, depth + 1):
        names, place = np.unique(at[alive], return_inverse=True)
        if not len(names):
            break
        c, p = copies[alive], copies[alive] * label[alive]
        totals = np.stack([np.bincount(place), np.bincount(place, c).astype(np.int64), np.bincount(place, p).astype(np.int64)])
        may = (totals[0] >= 2 * leaf_rows) & (totals[2] > 0) & (totals[2] < totals[1]) & (level < depth)
        feature, cut, gain = np.full(len(names), -1), np.zeros(len(names), np.int64), np.zeros(len(names))
        if may.any():
            both = [_feature_cuts(place * wide + x[alive, j], wide, c, p, totals, weights, leaf_rows) for j in range(len(features))]
            least, cuts = (np.stack(v, axis=1)[may] for v in zip(*both, strict=True))
            ok = np.isfinite(least)
            first = np.argsort(np.where(ok, _draws(tree, names[may].tolist(), features, "order"), np.inf), axis=1, kind="stable")[:, :tried]
            best = np.take_along_axis(first, np.argmin(np.take_along_axis(least, first, 1), axis=1)[:, None], 1)[:, 0]
            some = ok.any(axis=1)
            pick = np.flatnonzero(may)[some]
            feature[pick], cut[pick] = best[some], cuts[some, best[some]]
            gain[pick] = impurity(totals[1, pick], totals[2, pick], weights) - least[some, best[some]]
        share = totals[2] * weights[1] / (totals[2] * weights[1] + (totals[1] - totals[2]) * weights[0])
        out += [(k, n, f, t, g, None) if f >= 0 else (k, n, None, None, None, v) for k, n, f, t, g, v in zip(
            names.tolist(), totals[0].tolist(), feature.tolist(), cut.tolist(), gain.tolist(), share.tolist(), strict=True)]
        going = feature[place] >= 0
        alive, place = alive[going], place[going]
        at[alive] = 2 * at[alive] + (x[alive, feature[place]] >= cut[place])
    return out


def bag_dealt(table: DataFrame, bins: Bins, trees: int = TREES, depth: int = DEEPEST, tried: int | None = None, leaf_rows: int = LEAF_ROWS,
              folds: tuple[int, ...] = (EVERY_FOLD,)) -> DataFrame:
    """Trees for each fold left out, ``fit`` being its place in ``folds``; the columns are those of ``boost_dealt``."""
    spark, features, tried = table.sparkSession, list(bins.features), tried or max(1, math.isqrt(len(bins.features)))
    held = table.select(*bins.columns, "label", "draw", "fold").limit(HELD_ROWS + 1).toArrow()
    if held.num_rows > HELD_ROWS:
        raise ValueError(f"more than {HELD_ROWS} rows in one task; use bag_parts")
    k, deepest = len(bins.columns), min(depth, DEEPEST - 1)
    shared = spark.sparkContext.broadcast((np.stack([c.to_numpy() for c in held.columns[:k]], axis=1).astype(np.int16), *[c.to_numpy().astype(np.int64) for c in held.columns[k:]]))

    def run(batches):
        x, label, draw, fold = shared.value
        for batch in batches:
            for number in batch.column(0).to_pylist():
                tree, fit = divmod(number, len(folds))
                mine = np.ones(len(x), bool) if folds[fit] == EVERY_FOLD else fold != folds[fit]
                rows = [(fit, tree, *r) for r in bagged_tree(tree, x[mine], label[mine], draw[mine], features, deepest, tried, leaf_rows)]
                if rows:
                    yield _batch(rows)

    return _stored(spark.range(0, trees * len(folds), 1, min(trees * len(folds), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, WIDE))


NAMES = [c.split()[0] for c in NODES.split(", ")]
TYPES = [*TYPES[:2], pa.int64(), *TYPES[3:]]
WIDE = NODES.replace("node int", "node bigint")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)


def _top_cut(tree: int, node: int, cells: np.ndarray, features: list[str], weights: tuple[float, float], tried: int, leaf_rows: int):
    """Feature, cut and impurity as in ``bagged_tree``, from rows, copies and positive copies by feature and bin; ``None`` if there is no cut."""
    size, bag, ones = (int(v[0].sum()) for v in cells)
    if size < 2 * leaf_rows or not 0 < ones < bag:
        return None
    options = []
    for f, order in enumerate(_draws(tree, [node], features, "order")[0].tolist()):
        left = cells[:, f].cumsum(axis=1)
        with np.errstate(all="ignore"):
            after = impurity(left[1], left[2], weights) + impurity(bag - left[1], ones - left[2], weights)
        after = np.where((cells[0, f] > 0) & (left[0] >= leaf_rows) & (size - left[0] >= leaf_rows), after, np.inf)
        at = int(np.argmin(after))
        if np.isfinite(after[at]):
            options.append((order, f, at + 1, float(after[at])))
    return min(sorted(options)[:tried], key=lambda o: o[3])[1:] if options else None


def bag_parts(table: DataFrame, bins: Bins, trees: int = TREES, depth: int = DEEPEST, tried: int | None = None, leaf_rows: int = LEAF_ROWS,
              folds: tuple[int, ...] = (EVERY_FOLD,)) -> DataFrame:
    """The same nodes as ``bag_dealt``, for any number of rows."""
    spark, features, columns, tried = table.sparkSession, list(bins.features), bins.columns, tried or max(1, math.isqrt(len(bins.features)))
    deepest, wide, held = min(depth, DEEPEST - 1), max(len(e) for e in bins.edges.values()) + 1, HELD_ROWS
    path = os.path.join(scratch_dir(spark), "nodes")

    def weigh(tree: int, label: np.ndarray, draw: np.ndarray):
        copies = bag_copies(draw, tree)
        return copies, copies * label

    for fit, fold in enumerate(folds):
        mine, weights = table if fold == EVERY_FOLD else table.where(F.col("fold") != fold), {}

        def choose(tree: int, node: int, cells: np.ndarray, whole: np.ndarray, may: bool, weights=weights):
            w = weights.setdefault(tree, bag_weights(int(whole[1]), int(whole[2])))
            size, bag, ones = (int(v[0].sum()) for v in cells)
            best = _top_cut(tree, node, cells, features, w, tried, leaf_rows) if may else None
            if best is None:
                return None, None, (size, None, float(ones * w[1] / (ones * w[1] + (bag - ones) * w[0])))
            return best[0], best[1], (size, float(impurity(bag, ones, w) - best[2]), None)

        cuts, records, dealt = sub.tops(mine, columns, wide, list(range(trees)), deepest, held, weigh, choose)
        top = [(fit, t, node, r[0], feature, cut, *r[1:]) for t, node, feature, cut, r in records]
        spark.createDataFrame(top, WIDE).write.mode("append").parquet(path)

        def finish(tree: int, node: int, x: np.ndarray, label: np.ndarray, draw: np.ndarray, fit=fit, weights=weights):
            yield _batch([(fit, tree, *r) for r in bagged_tree(tree, x, label, draw, features, deepest, tried, leaf_rows, node, weights[tree])])

        for part in sub.subtrees(mine, columns, mine.count(), cuts, dealt, weigh, finish, WIDE):
            part.write.mode("append").parquet(path)
    return spark.read.schema(WIDE).parquet(path)


class Bagged:
    """Bagged trees; ``predict`` adds the mean of the leaves' weighted positive shares."""

    AT_ONCE = 4 << 20  # nodes that one scoring function holds

    def __init__(self, bins: Bins, nodes: DataFrame, trees: int):
        self.bins, self.nodes, self.trees, self._most = bins, nodes, trees, None
        self._shared: dict[tuple[int, int], Broadcast] = {}

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], *, trees: int = TREES, depth: int = DEEPEST, bins: Bins | None = None, label: str = "label", ident: str = "pixel_id",
            limit: int | None = None):
        rows = draw_rows(df, features, label, ident, limit=limit)
        bins = bins or Bins.fit(rows, features, BINS)
        return cls.fit_all(binned(rows, bins), bins, (EVERY_FOLD,), trees, depth)[0]

    @classmethod
    def fit_all(cls, table: DataFrame, bins: Bins, folds: tuple[int, ...], trees: int = TREES, depth: int = DEEPEST) -> list[Bagged]:
        nodes = (bag_parts if table.count() > HELD_ROWS else bag_dealt)(table, bins, trees, depth, folds=folds)
        return [cls(bins, nodes.where(F.col("fit") == i), trees) for i in range(len(folds))]

    def _walk(self, low: int, high: int) -> Broadcast:
        if (low, high) not in self._shared:
            self._shared[low, high] = self.nodes.sparkSession.sparkContext.broadcast(packed(self.nodes.where(F.col("tree").between(low, high)).toArrow()))
        return self._shared[low, high]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if self._most is None:
            size = self.nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first()
            if size[1] < self.trees:
                raise ValueError("a bag without rows")
            self._most = size[0]
        scored = summed(self.bins.apply(df), self._walk, self.bins.columns, self.trees, self._most, self.AT_ONCE, out)
        return scored.withColumn(out, F.col(out) / F.lit(float(self.trees))).drop(*self.bins.columns)
