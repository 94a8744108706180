"""Extremely randomised trees over a binned feature table.

The table of bins is made once and shared by all trees, and by all fits over the same rows. Every (tree, node) draws one cut
for each feature by a hash, between the least and the greatest bin of its rows, and keeps the cut of least impurity among the
first features in drawn order. Sums are counts of rows and positives, so results do not depend on the order of addition.

There are three ways to grow, with equal results and all rows of a fit. ``grow`` is an aggregation over (tree, node) a level,
folded before the shuffle, and rows leave when their node is a leaf. ``grow_dealt`` deals the trees to tasks, each of which
holds the bins of at most ``HELD_ROWS`` rows. ``grow_parts`` has no bound on rows: nodes of more rows than that are grown by
histograms, and what lies below them is dealt (``subtrees``). ``ExtraTrees`` takes the second or the third by the number of rows.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailfield.operators.ordering import running_totals
from tailfield.operators import subtrees as sub
from tailfield.operators.sampling import smallest_keys
from tailfield.session import scratch_dir

FIT_ROWS = 90_000  # of queries whose SQL draws them
HELD_ROWS = 1_000_000  # whose bins a task, or whose values the driver, may hold
BINS = 255
TREES, LEAF_ROWS = 400, 2
DEEPEST = 60  # node numbers double at each level and must fit in a long
SIDE_BY_SIDE = 40_000  # rows by trees that step down at once
AT_ONCE = 4 << 20  # nodes of the trees that one scoring function holds
ALL_NODES = 48 << 20  # nodes that the scoring functions of one pass over the rows hold


def _stored(df: DataFrame) -> DataFrame:
    """``df`` written and read again: a level's plan starts from files, whose size the planner knows."""
    path = os.path.join(scratch_dir(df.sparkSession), "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_quantiles(df: DataFrame, features: list[str], shares: list[float]) -> dict[str, list[float] | None]:
    """What ``F.percentile`` gives, for any number of rows: distinct values are counted and ordered by range, and only those at the wanted ranks come back."""
    values = df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], features, "feature", "value").where(F.col("value").isNotNull())
    counts = values.groupBy("feature", "value").agg(F.count("*").alias("n"))
    totals = running_totals(counts, ["value"], {"end": "n"}, ["feature"])
    sizes = {r["feature"]: r["n"] for r in totals.groupBy("feature").agg(F.max("end").alias("n")).collect()}
    places = {f: np.array(shares) * (n - 1) for f, n in sizes.items()}
    ranks = {f: np.unique(np.concatenate([np.floor(p), np.ceil(p)])).astype(np.int64) for f, p in places.items()}

    @F.arrow_udf("boolean")
    def wanted(feature: pa.Array, end: pa.Array, n: pa.Array) -> pa.Array:
        name, last = np.asarray(feature.to_pylist(), object), end.to_numpy(zero_copy_only=False)
        first, out = last - n.to_numpy(zero_copy_only=False), np.zeros(len(last), bool)
        for f, r in ranks.items():
            mine = name == f
            out[mine] = np.searchsorted(r, first[mine]) < np.searchsorted(r, last[mine])
        return pa.array(out)

    held = totals.where(wanted("feature", "end", "n")).select("feature", "value", "end").toArrow().sort_by([("feature", "ascending"), ("end", "ascending")]) if sizes else None
    out: dict[str, list[float] | None] = dict.fromkeys(features)
    for f, at in places.items():
        mine = held.filter(pc.equal(held["feature"], f))
        value, end = mine["value"].to_numpy(), mine["end"].to_numpy()
        out[f] = _between(at, lambda ranks, value=value, end=end: value[np.searchsorted(end, ranks, side="right")])
    return out


def held_quantiles(df: DataFrame, features: list[str], shares: list[float]) -> dict[str, list[float] | None]:
    """The same for values that the driver may hold."""
    held = df.select(*[F.col(f).cast("double").alias(f) for f in features]).toArrow()
    out: dict[str, list[float] | None] = {}
    for f in features:
        value = np.sort(held[f].drop_null().to_numpy())
        out[f] = _between(np.array(shares) * (len(value) - 1), lambda ranks, value=value: value[ranks.astype(np.int64)]) if len(value) else None
    return out


def _between(at: np.ndarray, value_at: Callable[[np.ndarray], np.ndarray]) -> list[float]:
    low, high = np.floor(at), np.ceil(at)
    below, above = value_at(low), value_at(high)
    return np.where(below == above, below, (high - at) * below + (at - low) * above).tolist()


class Bins:
    """Cuts and medians of each feature; ``apply`` adds the columns ``b0``, ``b1``, … with the bin of each feature."""

    def __init__(self, features: list[str], edges: dict[str, list[float]], medians: dict[str, float]):
        self.features, self.edges, self.medians = features, edges, medians

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], bins: int = BINS) -> Bins:
        """Distinct rounded quantiles and medians of the rows of a fit; features without a value are left out.

        The values of at most ``HELD_ROWS`` rows come to the driver; more are ordered by range.
        """
        shares = [0.5, *(i / bins for i in range(1, bins))]
        found = (sorted_quantiles if df.count() > HELD_ROWS else held_quantiles)(df, features, shares)
        kept = [f for f in features if found[f] is not None]
        if not kept:
            raise ValueError(f"no values in {', '.join(features)}")
        return cls(kept, {f: sorted({round(v, 9) for v in found[f][1:]}) for f in kept}, {f: found[f][0] for f in kept})

    @property
    def columns(self) -> list[str]:
        return [f"b{i}" for i in range(len(self.features))]

    def apply(self, df: DataFrame) -> DataFrame:
        filled = df.withColumns({f"_b_{c}": F.coalesce(F.col(f).cast("double"), F.lit(self.medians[f])) for f, c in zip(self.features, self.columns, strict=True)})
        splits = [[-math.inf, *self.edges[f], math.inf] for f in self.features]
        cut = Bucketizer(splitsArray=splits, inputCols=[f"_b_{c}" for c in self.columns], outputCols=[f"_c_{c}" for c in self.columns]).transform(filled)
        return cut.withColumns({c: F.col(f"_c_{c}").cast("short") for c in self.columns}).drop(
            *[f"_b_{c}" for c in self.columns], *[f"_c_{c}" for c in self.columns])


def drawn(tree: Column, node: Column, feature: str, what: str) -> Column:
    """A number from 0 to below 1 that depends on tree, node, feature and purpose only."""
    text = F.concat_ws("|", tree.cast("string"), node.cast("string"), F.lit(feature), F.lit(what))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def drawn_sql(tree: str, node: str, feature: str, what: str) -> str:
    return f"(CAST('0x' || substr(md5({tree} || '|' || {node} || '|{feature}|{what}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def node_ranges(state: DataFrame, bins: Bins) -> DataFrame:
    """Rows, positives and the range of each feature, for each node."""
    ranges = [f(c).alias(f"{n}_{c}") for c in bins.columns for f, n in ((F.min, "lo"), (F.max, "hi"))]
    return state.groupBy("tree", "node").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"), *ranges)


def with_cuts(nodes: DataFrame, bins: Bins) -> DataFrame:
    """One cut a feature, null where all rows of the node share a bin: rows below it go left."""
    def cut(f: str, c: str) -> Column:
        low, high = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        at = low + 1 + F.floor(drawn(F.col("tree"), F.col("node"), f, "cut") * (high - low))
        return F.when(high > low, at.cast("int")).alias(f"t_{c}")

    return nodes.select("tree", "node", "n", "positives", *[cut(f, c) for f, c in zip(bins.features, bins.columns, strict=True)])


def side_sums(state: DataFrame, nodes: DataFrame, bins: Bins) -> DataFrame:
    """Rows and positives on the left of each feature's cut, for each node that may be split."""
    left = {c: F.col(c) < F.col(f"t_{c}") for c in bins.columns}
    cuts = state.join(nodes.select("tree", "node", *[f"t_{c}" for c in bins.columns]), ["tree", "node"])
    sums = [s for c in bins.columns for s in (F.count_if(left[c]).alias(f"n_{c}"), F.count_if(left[c] & (F.col("label") == 1)).alias(f"p_{c}"))]
    return cuts.groupBy("tree", "node").agg(*sums)


def impurity(n, positives, weights: tuple[float, float]):
    """Weight times Gini impurity of rows with the given class weights; also for arrays."""
    zero, one = weights
    return 2.0 * (positives * one) * ((n - positives) * zero) / (positives * one + (n - positives) * zero)


def best_cuts(nodes: DataFrame, sums: DataFrame, bins: Bins, weights: tuple[float, float], tried: int, leaf_rows: int) -> DataFrame:
    """The cut of least impurity among the first ``tried`` features, in drawn order, whose cut leaves enough rows on both sides."""
    both = nodes.join(sums, ["tree", "node"], "left")

    def option(i: int, f: str, c: str) -> Column:
        ok = F.col(f"t_{c}").isNotNull() & (F.col(f"n_{c}") >= leaf_rows) & (F.col("n") - F.col(f"n_{c}") >= leaf_rows)
        after = impurity(F.col(f"n_{c}"), F.col(f"p_{c}"), weights) + impurity(F.col("n") - F.col(f"n_{c}"), F.col("positives") - F.col(f"p_{c}"), weights)
        return F.when(ok, F.struct(drawn(F.col("tree"), F.col("node"), f, "order").alias("o"), F.lit(i).alias("f"), F.col(f"t_{c}").alias("t"), after.alias("after")))

    options = F.array_sort(F.array_compact(F.array(*[option(i, f, c) for i, (f, c) in enumerate(zip(bins.features, bins.columns, strict=True))])))
    first = F.transform(F.slice(options, 1, tried), lambda x: F.struct(x["after"].alias("after"), x["o"].alias("o"), x["f"].alias("f"), x["t"].alias("t")))
    best = F.array_min(first)
    return both.select("tree", "node", "n", "positives", best["f"].alias("feature"), best["t"].alias("cut"), best["after"].alias("after"))


def fit_rows(df: DataFrame, features: list[str], label: str = "label", ident: str = "pixel_id", limit: int | None = None) -> DataFrame:
    """Features and label of the rows of a fit, stored: all labelled rows; where ``limit`` is given, that many with the least hashes."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(ident).alias("_id"), *features, F.col(label).cast("int").alias("label"))
    if limit is not None and rows.count() > limit:
        rows = smallest_keys(rows, limit, "_id", salt="|fit")
    return _stored(rows.select(*features, "label"))


def binned(rows: DataFrame, bins: Bins) -> DataFrame:
    """The bins and label of the rows of a fit, stored: the table that all trees, folds and labels over these rows share."""
    return _stored(bins.apply(rows).select(*bins.columns, "label"))


def class_weights(rows: DataFrame) -> tuple[float, float]:
    """n / (2 * class size) of rows without and with the label."""
    size = rows.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    n, p = size["n"], size["p"] or 0
    return (n / (2.0 * (n - p)) if n > p else 0.0), (n / (2.0 * p) if p else 0.0)


def grow(rows: DataFrame, bins: Bins, weights: tuple[float, float], trees: int = TREES, depth: int = DEEPEST, tried: int | None = None,
         leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Nodes of all trees: ``tree, node, n, positives, feature, cut, after`` (impurity of both sides); leaves have no feature.

    Node 1 is the root and the children of k are 2k and 2k + 1. ``tried`` is the root of the number of features.
    """
    tried = tried or max(1, math.isqrt(len(bins.features)))
    state = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("node", F.lit(1).cast("long"))
    state, done = _stored(state), []
    for level in range(min(depth, DEEPEST) + 1):
        # stored: their size is known, so rows are not dealt by the few nodes of the first levels
        nodes = _stored(with_cuts(node_ranges(state, bins), bins))
        mixed = (F.col("n") >= 2 * leaf_rows) & (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
        opening = F.lit(level < min(depth, DEEPEST)) & mixed & F.coalesce(*[F.col(f"t_{c}") for c in bins.columns]).isNotNull()
        done.append(_stored(best_cuts(nodes, side_sums(state, nodes.where(opening), bins), bins, weights, tried, leaf_rows)))
        split = done[-1].where("feature IS NOT NULL").select("tree", "node", "feature", "cut")
        if split.isEmpty():
            break
        value = F.get(F.array(*bins.columns), F.col("feature"))
        moved = state.join(split, ["tree", "node"]).withColumn("node", F.col("node") * 2 + F.when(value < F.col("cut"), 0).otherwise(1))
        state = _stored(moved.select(*bins.columns, "label", "tree", "node"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return _stored(out)


NODE = "tree int, node long, n long, positives long, feature int, cut int, after double"


MD5_SHIFTS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
MD5_SUMS = np.array([math.floor(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
MD5_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
MD5_PLACES = [[i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16][i // 16] for i in range(64)]
FEW = 500  # digests that are taken one by one
MANY = 8192  # digests that are taken at once


def first_words(blocks: np.ndarray) -> np.ndarray:
    """The first four bytes of the MD5 digest of each padded block of 16 words, all blocks side by side."""
    out = np.empty(len(blocks), np.uint32)
    for at in range(0, len(blocks), MANY):
        word = np.ascontiguousarray(blocks[at:at + MANY].T)
        a, b, c, d = (np.full(word.shape[1], v, np.uint32) for v in MD5_START)
        for i in range(64):
            part = i // 16
            f = _mixed(part, b, c, d)
            f += a
            f += word[MD5_PLACES[i]]
            f += MD5_SUMS[i]
            shift = MD5_SHIFTS[part, i % 4]
            turned = f << shift
            f >>= np.uint32(32) - shift
            turned |= f
            turned += b
            a, d, c, b = d, c, b, turned
        out[at:at + MANY] = a + MD5_START[0]
    return out.byteswap()


def _mixed(part: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    if part == 0:
        return d ^ (b & (c ^ d))
    if part == 1:
        return c ^ (d & (b ^ c))
    return b ^ c ^ d if part == 2 else c ^ (b | ~d)


def _numbers(tree: int, node: np.ndarray, feature: np.ndarray, features: list[str], what: str) -> np.ndarray:
    """What ``drawn`` gives for a tree and these pairs of node and feature."""
    tails, head = [f"|{f}|{what}".encode() for f in features], f"{tree}|".encode()
    longest = len(head) + 19 + max(map(len, tails))
    if len(node) <= FEW or longest > 55:
        return np.frombuffer(b"".join([hashlib.md5(head + str(k).encode() + tails[f]).digest()[:4] for k, f in zip(node.tolist(), feature.tolist(), strict=True)]), ">u4") / 4294967296.0
    text, digits = np.zeros((len(node), 64), np.uint8), np.searchsorted(10 ** np.arange(1, 19), node, side="right") + 1
    text[:, :len(head)] = np.frombuffer(head, np.uint8)
    for long in np.unique(digits).tolist():
        same = np.flatnonzero(digits == long)
        left = node[same]
        for place in range(len(head) + long - 1, len(head) - 1, -1):
            text[same, place] = left % 10 + 48
            left = left // 10
        for f, tail in enumerate(tails):
            mine, end = same[feature[same] == f], len(head) + long + len(tail)
            text[mine, len(head) + long:end] = np.frombuffer(tail, np.uint8)
            text[mine, end] = 128
            text[mine, 56], text[mine, 57] = 8 * end % 256, 8 * end // 256
    return first_words(text.view("<u4")) / 4294967296.0


def _draws(tree: int, nodes: list[int], features: list[str], what: str) -> np.ndarray:
    shape = len(nodes), len(features)
    return _numbers(tree, np.repeat(np.array(nodes, np.int64), shape[1]), np.tile(np.arange(shape[1]), shape[0]), features, what).reshape(shape)


def _node_cuts(tree: int, node: np.ndarray, n: np.ndarray, positives: np.ndarray, starts: np.ndarray, rows: np.ndarray, table: np.ndarray, positive: np.ndarray,
               features: list[str], weights: tuple[float, float], tried: int, leaf_rows: int):
    """Feature (-1 if none), cut and impurity after it for each node. Features are looked at in drawn order, each only by the nodes that still need one."""
    order = np.argsort(_draws(tree, node.tolist(), features, "order"), axis=1, kind="stable")
    found, feature, cut, after = np.zeros(len(node), np.int64), np.full(len(node), -1), np.zeros(len(node), np.int64), np.full(len(node), np.inf)
    flat, wide = table.ravel(), table.shape[1]
    for k in range(len(features)):
        want = np.flatnonzero(found < tried)
        if not len(want):
            break
        f, size = order[want, k], n[want]
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(starts[want] - first, size)
        value = flat[rows[at] * wide + np.repeat(f, size)]
        low = np.minimum.reduceat(value, first).astype(np.int64)
        span = np.maximum.reduceat(value, first) - low
        far = np.flatnonzero(span > 0)
        t = low.copy()  # no row lies below it where a feature has one bin
        t[far] += 1 + np.floor(_numbers(tree, node[want[far]], f[far], features, "cut") * span[far]).astype(np.int64)
        left = value < np.repeat(t.astype(value.dtype), size)
        ln, lp = np.add.reduceat(left, first, dtype=np.int64), np.add.reduceat(left & positive[at], first, dtype=np.int64)
        ok = (span > 0) & (ln >= leaf_rows) & (size - ln >= leaf_rows)
        with np.errstate(all="ignore"):
            sides = np.where(ok, impurity(ln, lp, weights) + impurity(size - ln, positives[want] - lp, weights), np.inf)
        found[want] += ok
        less = sides < after[want]
        better = want[less]
        feature[better], cut[better], after[better] = f[less], t[less], sides[less]
    return feature, cut, np.where(feature < 0, np.nan, after)


def _levels(tree: int, table: np.ndarray, label: np.ndarray, features: list[str], weights: tuple[float, float], depth: int, tried: int, leaf_rows: int, root: int = 1):
    """The nodes of one tree, or of its part below ``root``, a level at a time, as columns."""
    if not len(label):
        return
    rows, positive = np.arange(len(label)), label > 0  # rows lie in node order, in any order within a node, as they are only counted
    node, n = np.array([root]), np.array([len(label)])
    for level in range(root.bit_length() - 1, depth + 1):
        starts = np.cumsum(n) - n
        positives = np.add.reduceat(positive, starts, dtype=np.int64)
        may = np.flatnonzero((n >= 2 * leaf_rows) & (positives > 0) & (positives < n) & (level < depth))
        feature, cut, after = np.full(len(node), -1), np.zeros(len(node), np.int64), np.full(len(node), np.nan)
        if len(may):
            feature[may], cut[may], after[may] = _node_cuts(
                tree, node[may], n[may], positives[may], starts[may], rows, table, positive, features, weights, tried, leaf_rows)
        yield node, n, positives, feature, cut, after
        inner = np.flatnonzero(feature >= 0)
        if not len(inner):
            return
        size = n[inner]
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(starts[inner] - first, size)
        rows, positive = rows[at], positive[at]
        right = table[rows, np.repeat(feature[inner], size)] >= np.repeat(cut[inner], size)
        # every node's rows step apart to its children, which is a place for each row and no sort
        before = np.cumsum(right) - right
        rights = np.add.reduceat(right, first, dtype=np.int64)
        own = np.arange(len(rows))
        place = np.where(right, before + np.repeat(first + size - rights - before[first], size), own - before + np.repeat(before[first], size))
        moved, flags = np.empty_like(rows), np.empty_like(positive)
        moved[place], flags[place] = rows, positive
        rows, positive = moved, flags
        node = np.stack([2 * node[inner], 2 * node[inner] + 1], axis=1).ravel()
        n = np.stack([size - rights, rights], axis=1).ravel()


def _node_batch(tree: int, node: np.ndarray, n: np.ndarray, positives: np.ndarray, feature: np.ndarray, cut: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    none = feature < 0
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(node), tree, np.int32)), pa.array(node), pa.array(n.astype(np.int64)), pa.array(positives.astype(np.int64)),
        pa.array(feature.astype(np.int32), mask=none), pa.array(cut.astype(np.int32), mask=none), pa.array(after, mask=none)],
        names=["tree", "node", "n", "positives", "feature", "cut", "after"])


def grow_dealt(rows: DataFrame, bins: Bins, weights: tuple[float, float], trees: int = TREES, depth: int = DEEPEST, tried: int | None = None,
               leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The same nodes as ``grow``, for rows that a task may hold: each task grows the trees that are dealt to it."""
    spark, features, tried = rows.sparkSession, list(bins.features), tried or max(1, math.isqrt(len(bins.features)))
    held = rows.select(*bins.columns, "label").limit(HELD_ROWS + 1).toArrow()
    if held.num_rows > HELD_ROWS:
        raise ValueError(f"more than {HELD_ROWS} rows; use grow_parts")
    shared = spark.sparkContext.broadcast((np.stack([c.to_numpy() for c in held.columns[:-1]], axis=1).astype(np.int16), held.columns[-1].to_numpy().astype(np.int64)))

    def run(batches):
        table, label = shared.value
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                for level in _levels(tree, table, label, features, weights, min(depth, DEEPEST), tried, leaf_rows):
                    yield _node_batch(tree, *level)

    tasks = min(trees, 4 * spark.sparkContext.defaultParallelism)
    return _stored(spark.range(0, trees, 1, tasks).mapInArrow(run, NODE)) if held.num_rows else spark.createDataFrame([], NODE)


def _top_cut(tree: int, node: int, n: np.ndarray, positives: np.ndarray, features: list[str], weights: tuple[float, float], tried: int, leaf_rows: int):
    """Impurity, feature and cut as in ``_node_cuts``, from rows and positives by feature and bin; ``None`` if there is no cut."""
    size, ones, best, found = int(n[0].sum()), int(positives[0].sum()), None, 0
    if size < 2 * leaf_rows or not 0 < ones < size:
        return None
    for f in np.argsort(_draws(tree, [node], features, "order")[0], kind="stable").tolist():
        filled = np.flatnonzero(n[f])
        low, span = int(filled[0]), int(filled[-1] - filled[0])
        if not span:
            continue
        t = low + 1 + math.floor(_draws(tree, [node], [features[f]], "cut")[0, 0] * span)
        ln, lp = int(n[f, :t].sum()), int(positives[f, :t].sum())
        if min(ln, size - ln) < leaf_rows:
            continue
        after = impurity(ln, lp, weights) + impurity(size - ln, ones - lp, weights)
        if best is None or after < best[0]:
            best = after, f, t
        found += 1
        if found == tried:
            break
    return best


def grow_parts(rows: DataFrame, bins: Bins, weights: tuple[float, float], trees: int = TREES, depth: int = DEEPEST, tried: int | None = None,
               leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The same nodes as ``grow``, for any number of rows."""
    features, columns, tried, held = list(bins.features), bins.columns, tried or max(1, math.isqrt(len(bins.features))), HELD_ROWS
    spark, depth, wide = rows.sparkSession, min(depth, DEEPEST), max(len(e) for e in bins.edges.values()) + 1
    table = rows.select(*columns, "label", F.lit(0).cast("long").alias("draw"))

    def weigh(tree: int, label: np.ndarray, draw: np.ndarray):
        return np.ones(len(label), np.int64), label

    def choose(tree: int, node: int, cells: np.ndarray, whole: np.ndarray, may: bool):
        best = _top_cut(tree, node, cells[0], cells[2], features, weights, tried, leaf_rows) if may else None
        size = int(cells[0, 0].sum()), int(cells[2, 0].sum())
        return (None, None, (*size, None)) if best is None else (best[1], best[2], (*size, float(best[0])))

    def finish(tree: int, node: int, x: np.ndarray, label: np.ndarray, draw: np.ndarray):
        for level in _levels(tree, x, label, features, weights, depth, tried, leaf_rows, node):
            yield _node_batch(tree, *level)

    cuts, records, dealt = sub.tops(table, columns, wide, list(range(trees)), depth, held, weigh, choose)
    path = os.path.join(scratch_dir(spark), "nodes")
    top = [(t, node, *r[:2], feature, cut, r[2]) for t, node, feature, cut, r in records]
    spark.createDataFrame(top, NODE).write.parquet(path)
    for part in sub.subtrees(table, columns, rows.count(), cuts, dealt, weigh, finish, NODE):
        part.write.mode("append").parquet(path)
    return spark.read.schema(NODE).parquet(path)


def grow_any(rows: DataFrame, bins: Bins, weights: tuple[float, float], trees: int = TREES, depth: int = DEEPEST) -> DataFrame:
    return (grow_parts if rows.count() > HELD_ROWS else grow_dealt)(rows, bins, weights, trees, depth)


def packed_shape(nodes: pa.Table) -> tuple[np.ndarray, ...]:
    """Nodes in tree order as arrays: feature (-1 at leaves), cut, place of the left child (the right one follows); roots; the order."""
    tree, node = (nodes[c].to_numpy() for c in ("tree", "node"))
    order = np.lexsort((node, tree))
    tree = tree[order]
    feature = np.asarray(nodes["feature"].fill_null(-1))[order].astype(np.int16)
    roots = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
    # children lie in node order: those of a tree's k-th inner node are its nodes 2k + 1 and 2k + 2
    inner = feature >= 0
    start = np.repeat(roots, np.diff(np.append(roots, len(tree))))
    before = np.cumsum(inner) - inner
    left = np.where(inner, start + 1 + 2 * (before - before[start]), 0).astype(np.int32)
    return feature, np.asarray(nodes["cut"].fill_null(0))[order].astype(np.int16), left, roots.astype(np.int32), order


def _packed(nodes: pa.Table, weights: tuple[float, float]) -> tuple[np.ndarray, ...]:
    """``packed_shape`` with the positive share of each node."""
    feature, cut, left, roots, order = packed_shape(nodes)
    n, p = (nodes[c].to_numpy()[order] for c in ("n", "positives"))
    share = (p * weights[1] / (p * weights[1] + (n - p) * weights[0])).astype(np.float32)
    return feature, cut, left, share, roots


def walkable(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, value: np.ndarray, roots: np.ndarray) -> tuple:
    """Nodes as one word each: left child, word and shift of the feature's bits in a row, cut. Leaves lead to themselves."""
    bits = 8 if cut.max(initial=0) < 256 else 16
    inner, per = feature >= 0, 64 // bits
    word = np.where(inner, left, np.arange(len(feature))).astype(np.int64) << 32
    word |= np.where(inner, feature // per, 0).astype(np.int64) << 22 | np.where(inner, feature % per * bits, 0).astype(np.int64) << 16
    return word | np.where(inner, cut.astype(np.int64), LEAF_CUT), value, roots, bits


LEAF_CUT = 65535  # no bin reaches it


def packed_rows(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """The bins of a row in as few words as hold them; a bin beyond all cuts may be lowered to the greatest that fits."""
    per = 64 // bits
    out = np.zeros((-(-len(columns) // per), len(columns[0])), np.int64)
    for i, c in enumerate(columns):
        out[i // per] |= np.minimum(c.astype(np.int64), (1 << bits) - 1) << (i % per * bits)
    return out


def leaf_sum(shared: Broadcast, columns: list[str]) -> Column:
    """Sum of the leaves' values over the trees of a broadcast ``walkable``: rows step down all trees of it."""
    def walk(*columns: pa.Array) -> pa.Array:
        word, value, roots, bits = shared.value
        table = packed_rows([c.to_numpy(zero_copy_only=False) for c in columns], bits)
        n = table.shape[1]
        total, beside = np.zeros(n), max(1, SIDE_BY_SIDE // max(n, 1))
        for a in range(0, len(roots) if n else 0, beside):
            some = roots[a:a + beside]
            out, going = np.repeat(some.astype(np.int64), n), None
            at, rows, step = out, np.tile(table, len(some)), 0
            while len(at):
                w = word[at]
                mine = rows[0] if len(rows) == 1 else np.take_along_axis(rows, (w >> 22 & 1023)[None], 0)[0]
                below = (w >> 32) + ((mine >> (w >> 16 & 63) & (1 << bits) - 1) >= (w & 65535))
                step += 1
                if step % 4:
                    at = below
                    continue
                # rows in leaves stay behind, every fourth step
                moved = np.flatnonzero(below != at)
                if going is None:
                    out, going = below, moved
                else:
                    out[going], going = below, going[moved]
                at, rows = below[moved], rows[:, moved]
            for one in value[out].reshape(len(some), n):
                total += one
        return pa.array(total)

    return F.arrow_udf(walk, "double")(*[F.col(c) for c in columns])


class ExtraTrees:
    """Fitted trees; ``predict`` adds the mean of the leaves' positive shares."""

    def __init__(self, bins: Bins, nodes: DataFrame, trees: int, weights: tuple[float, float]):
        self.bins, self.nodes, self.trees, self.weights = bins, nodes, trees, weights
        self._shared: dict[tuple[int, int], Broadcast] = {}
        self._most: int | None = None

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], *, trees: int = TREES, depth: int = DEEPEST, bins: Bins | None = None, label: str = "label", ident: str = "pixel_id",
            limit: int | None = None):
        rows = fit_rows(df, features, label, ident, limit)
        bins = bins or Bins.fit(rows, features)
        table, weights = binned(rows, bins), class_weights(rows)
        return cls(bins, grow_any(table, bins, weights, trees, depth), trees, weights)

    def _walk(self, low: int, high: int) -> Broadcast:
        """These trees as words. What is broadcast, once a model, is bounded by ``AT_ONCE`` nodes or one tree."""
        if (low, high) not in self._shared:
            held = self.nodes.where(F.col("tree").between(low, high)).toArrow()
            self._shared[low, high] = self.nodes.sparkSession.sparkContext.broadcast(walkable(*_packed(held, self.weights)))
        return self._shared[low, high]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if self._most is None:
            self._most = self.nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        scored = summed(self.bins.apply(df), self._walk, self.bins.columns, self.trees, self._most, AT_ONCE, out)
        return scored.withColumn(out, F.col(out) / F.lit(float(self.trees))).drop(*self.bins.columns)


def summed(df: DataFrame, walk: Callable[[int, int], Broadcast], columns: list[str], trees: int, most: int, at_once: int, out: str) -> DataFrame:
    """The sum of the leaves' values of all trees, of at most ``most`` nodes each. Where they are more than ``ALL_NODES``, rows
    are scored in passes, each by as many trees as that, and their nodes go before the next."""
    step = max(1, at_once // most)
    parts = [(a, min(a + step, trees) - 1) for a in range(0, trees, step)]
    a_pass = max(1, ALL_NODES // (most * step))
    if len(parts) <= a_pass:
        walks = [leaf_sum(walk(*part), columns) for part in parts]
        return df.withColumn(out, sum(walks[1:], walks[0]))
    state = df.withColumn(out, F.lit(0.0))
    for a in range(0, len(parts), a_pass):
        shared = [walk(*part) for part in parts[a:a + a_pass]]
        state = _stored(state.withColumn(out, sum((leaf_sum(s, columns) for s in shared), F.col(out))))
        for s in shared:
            s.unpersist()
    return state
