"""Folds of blocks: no list of all blocks, the same choice as one block after the other."""

import heapq

import pytest
from pyspark.sql import functions as F

from tailfield.operators import sampling as sa


@pytest.mark.parametrize(("folds", "sizes"), [
    (5, [40, 17, 17, 17, 9, 9, 9, 9, 9, 9, 4, 4, 3, 3, 3, 1, *[1] * 60]), (5, [100, 1, 1, 1]), (3, [7] * 11), (5, [3]), (4, [50, 50, 6, 6, 6, 6, 5, 5, 2, 2, 2, 2, 2, 2, 2])])
def test_folds_are_those_of_one_block_after_the_other(spark, folds, sizes):
    named = {f"b{(i * 7) % 101:03d}": n for i, n in enumerate(sizes)}
    rows = spark.createDataFrame([(b, n) for b, n in named.items()], "block_id string, n int").withColumn("x", F.explode(F.sequence(F.lit(1), F.col("n"))))
    heap, want = [(0, i) for i in range(max(2, min(folds, len(named))))], {}
    for b, n in sorted(named.items(), key=lambda item: (-item[1], item[0])):
        load, i = heapq.heappop(heap)
        want[b] = i
        heapq.heappush(heap, (load + n, i))
    out = sa.group_folds(rows, folds)
    assert {(r["block_id"], r["fold"]) for r in out.select("block_id", "fold").distinct().collect()} == set(want.items())
    assert out.count() == sum(sizes)


def test_blocks_are_not_gathered(spark, monkeypatch):
    """What is gathered in one row has one entry a size, not one a block."""
    gathered, plain = [], F.collect_list
    monkeypatch.setattr(sa.F, "collect_list", lambda c: gathered.append(c._jc.toString()) or plain(c))
    rows = spark.range(400).select((F.col("id") % 100).cast("string").alias("block_id"))
    assert sa.group_folds(rows, 5).select("block_id", "fold").distinct().count() == 100
    assert gathered and not any("block_id" in text for text in gathered)
