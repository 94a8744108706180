"""Trees over more rows than a task holds: the nodes near the root by histograms, the subtrees below them in tasks.

Rows stay where they lie while the top of each tree is grown: every level is one aggregation of counts by (tree, node, feature,
bin). A node that has few enough rows is dealt: its rows move once for each tree, in passes of a bounded number of copies, and
one task grows all that lies below. A node is named by its number, so the same trees come out as from one task with all rows.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COPIES_A_PASS = 50_000_000  # rows by trees that lie on disk at a time
COPIES_A_TASK = 1_000_000
CELLS_AT_ONCE = 1 << 21  # counts of the histograms that a task holds
CELLS = "tree int, node long, feature int, bin int, rows long, copies long, positives long"

Weigh = Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
"""Copies and positive copies of rows in a tree, from tree, label and draw."""


def top_node(nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The node each row reaches by the cuts of these nodes, which are in order."""
    at, going = np.ones(len(x), np.int64), np.arange(len(x) if len(nodes) else 0)
    while len(going):
        k = np.minimum(np.searchsorted(nodes, at[going]), len(nodes) - 1)
        inside = nodes[k] == at[going]
        going, k = going[inside], k[inside]
        at[going] = 2 * at[going] + (x[going, feature[k]] >= cut[k])
    return at


def _arrays(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
    return np.stack(columns[:k], axis=1).astype(np.int16), columns[k].astype(np.int64), columns[k + 1].astype(np.int64)


def _shape(cuts: dict[int, tuple[int, int]]) -> tuple[np.ndarray, ...]:
    nodes = np.array(sorted(cuts), np.int64)
    return nodes, np.array([cuts[k][0] for k in nodes.tolist()], np.int64), np.array([cuts[k][1] for k in nodes.tolist()], np.int64)


def histograms(table: DataFrame, columns: list[str], wide: int, weigh: Weigh, cuts: dict[int, dict], opened: dict[int, list[int]]) -> dict[tuple[int, int], np.ndarray]:
    """Rows, copies and positive copies by feature and bin of each opened node, folded in each task before they move."""
    spark, k = table.sparkSession, len(columns)
    shared = spark.sparkContext.broadcast({t: (*_shape(cuts[t]), np.array(sorted(nodes), np.int64)) for t, nodes in opened.items() if nodes})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros((3, k, len(v[3]) * wide)) for t, v in shared.value.items()}
        for batch in batches:
            x, label, draw = _arrays(batch, k)
            for t, (nodes, feature, cut, wanted) in shared.value.items():
                at = top_node(nodes, feature, cut, x)
                place = np.minimum(np.searchsorted(wanted, at), len(wanted) - 1)
                copies, positives = weigh(t, label, draw)
                mine = np.flatnonzero((wanted[place] == at) & (copies > 0))
                for j in range(k):
                    key = place[mine] * wide + x[mine, j]
                    for i, w in enumerate((None, copies[mine], positives[mine])):
                        sums[t][i, j] += np.bincount(key, w, len(wanted) * wide)
        for t, found in sums.items():
            j, key = np.nonzero(found[0])
            yield pa.RecordBatch.from_arrays([pa.array(v, a) for v, a in (
                (np.full(len(j), t), pa.int32()), (shared.value[t][3][key // wide], pa.int64()), (j, pa.int32()), (key % wide, pa.int32()),
                *((found[i, j, key].astype(np.int64), pa.int64()) for i in range(3)))], names=[c.split()[0] for c in CELLS.split(", ")])

    cells = table.select(*columns, "label", "draw").mapInArrow(count, CELLS).groupBy("tree", "node", "feature", "bin").agg(
        *[F.sum(c).alias(c) for c in ("rows", "copies", "positives")]).toArrow()
    shared.destroy()
    tree, node, feature, bin_, *sums = (c.to_numpy() for c in cells.columns)
    out = {(t, n): np.zeros((3, k, wide), np.int64) for t, nodes in opened.items() for n in nodes}
    for t, n in out:
        mine = np.flatnonzero((tree == t) & (node == n))
        for i in range(3):
            out[t, n][i, feature[mine], bin_[mine]] = sums[i][mine]
    return out


def tops(table: DataFrame, columns: list[str], wide: int, trees: list[int], depth: int, held: int, weigh: Weigh, choose: Callable):
    """Cuts of the nodes of more than ``held`` rows, what ``choose`` says of each of them, and the nodes that are dealt.

    ``choose(tree, node, cells, whole, may)`` takes the cells of the node and of the root and gives feature, cut and a record,
    the first two ``None`` for a leaf.
    """
    cuts, records, dealt = {t: {} for t in trees}, [], {t: [] for t in trees}
    opened, whole = {t: [1] for t in trees}, {}
    while any(opened.values()):
        later = {t: [] for t in trees}
        waiting = [(t, n) for t, nodes in opened.items() for n in nodes]
        step = max(1, CELLS_AT_ONCE // (3 * len(columns) * wide))
        for a in range(0, len(waiting), step):
            some: dict[int, list[int]] = {}
            for t, n in waiting[a:a + step]:
                some.setdefault(t, []).append(n)
            for (t, n), cells in histograms(table, columns, wide, weigh, cuts, some).items():
                if n == 1:
                    whole[t] = cells.sum(axis=2)[:, 0]
                feature, cut, record = choose(t, n, cells, whole[t], n.bit_length() <= depth)
                records.append((t, n, feature, cut, record))
                if feature is not None:
                    cuts[t][n] = (feature, cut)
                    left = int(cells[0, feature, :cut].sum())
                    for child, size in ((2 * n, left), (2 * n + 1, int(cells[0, feature].sum()) - left)):
                        (later if size > held else dealt)[t].append(child)
        opened = later
    return cuts, records, dealt


def subtrees(table: DataFrame, columns: list[str], n: int, cuts: dict[int, dict], dealt: dict[int, list[int]], weigh: Weigh, finish: Callable, schema: str) -> Iterator[DataFrame]:
    """``finish(tree, node, x, label, draw)`` over the rows of each dealt node, as one table a pass."""
    spark, k = table.sparkSession, len(columns)
    trees, step = sorted(dealt), max(1, COPIES_A_PASS // max(n, 1))
    moved = f"group int, {', '.join(f'{c} short' for c in columns)}, label short, draw long"
    for a in range(0, len(trees), step):
        some = trees[a:a + step]
        groups = [(t, node) for t in some for node in sorted(dealt[t])]
        if not groups:
            continue
        number = {g: i for i, g in enumerate(groups)}
        shared = spark.sparkContext.broadcast({t: (*_shape(cuts[t]), np.array(sorted(dealt[t]), np.int64), number[t, min(dealt[t])]) for t in some if dealt[t]})

        def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, label, draw = _arrays(batch, k)
                for t, (nodes, feature, cut, wanted, first) in shared.value.items():
                    at = top_node(nodes, feature, cut, x)
                    place = np.minimum(np.searchsorted(wanted, at), len(wanted) - 1)
                    mine = np.flatnonzero((wanted[place] == at) & (weigh(t, label, draw)[0] > 0))
                    yield pa.RecordBatch.from_arrays([pa.array((first + place[mine]).astype(np.int32)), *[pa.array(x[mine, j]) for j in range(k)],
                                                      pa.array(label[mine].astype(np.int16)), pa.array(draw[mine])], names=["group", *columns, "label", "draw"])

        def grown(rows: pa.Table) -> pa.Table:
            # whatever order the rows come in: they are only counted
            x, label, draw = _arrays(rows.drop_columns(["group"]).combine_chunks().to_batches()[0], k)
            return pa.Table.from_batches(list(finish(*groups[rows["group"][0].as_py()], x, label, draw)))

        tasks = max(2 * spark.sparkContext.defaultParallelism, -(-n * len(some) // COPIES_A_TASK))
        yield table.select(*columns, "label", "draw").mapInArrow(copies, moved).repartition(tasks, "group").groupBy("group").applyInArrow(grown, schema)
        shared.destroy()
        if step < len(trees):
            gc.collect()
            spark.sparkContext._jvm.System.gc()  # shuffled files of the pass go before the next
