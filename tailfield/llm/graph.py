"""Connected components of an edge list by joins; no node's edges ever meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailfield.llm.store import stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``label`` (the smallest node reachable) for every node of an edge; no edges give no rows.

    Labels fall to the smallest label of the neighbours and then to that label's own label, so long chains take a
    logarithmic number of rounds. Minima are combined before each shuffle and the joins have one row per node on one
    side, so a node with very many edges can be split.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("peer"))
    both = stored(both.unionByName(both.select(F.col("peer").alias("node"), F.col("node").alias("peer"))).distinct())
    label = stored(both.groupBy("node").agg(F.min("peer").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        near = both.join(label.select(F.col("node").alias("peer"), "label"), "peer").groupBy("node").agg(F.min("label").alias("low"))
        step = label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        onward = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stored(step.join(onward, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        label = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return label
