"""Near-duplicate documents by tensored MinHash banding, verified on whole shingle sets.

Two collections of n = ``side(percent)`` sub-bands of ``ROWS`` minhashes give n ** 2 tables: each is keyed by one sub-band of
either collection, so 144 tables of six hashes need 72 hashes instead of 864. A pair of similarity s shares a table
unless it shares no sub-band of one collection: at s = 0.85 (n = 12) that chance is 2 * (1 - 0.85 ** 3) ** 12, at s = 0.8
(n = 16) it is 2 * (1 - 0.8 ** 3) ** 16, both about 2e-5, and it falls quickly above.

Pairs within a table are never all formed. Each table key names a hub, the member whose sub-bands are the most common,
and every member is compared with it; the hub's links join most copies of a text in one component. A member that the hub
does not link (a stranger) can only be linked with members of its hub's family that lie in the same range of distance
from the hub: Jaccard distance is a metric, so distances to the hub differ by 1 - percent / 100 at most. These are tried if
they are of another component, of fitting size, and share ``COMMON`` sub-bands (at s = 0.85, 14.7 of 24 are expected, and
fewer than four occur with a chance of about 6e-6; at s = 0.8, 16.4 of 32 and 7e-7). So every two members of a key are compared, in one component, or too far.

Defined results: null texts, empty texts and texts without words have no shingles, are linked with nothing and kept;
texts of one or two words have one shingle; rows that share an id count as one document that has the links of all its
texts; a null id is linked with nothing and kept; very long texts are hashed whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailfield.llm import segments as S
from tailfield.llm.graph import components
from tailfield.llm.store import stored

ROWS, MISSED = 3, 2.5e-5
PERCENT = 85
COMMON = 4
# A block of a family: at most about so many rows or bytes of sets of strangers and of members.
STRANGERS, STRANGER_BYTES, MEMBERS, MEMBER_BYTES = 256, 8 << 20, 1024, 16 << 20
BROADCAST_IDS = 2 << 20  # 16 MB of ids
WORDS = 3
SKETCH = "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>"


def side(percent: int) -> int:
    """Sub-bands of each collection: the fewest that miss a pair of just this similarity with a chance of at most ``MISSED``."""
    n = 1
    while 2 * (1 - (percent / 100) ** ROWS) ** n > MISSED:
        n += 1
    return n


@lru_cache
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What is combined with, and what multiplies, the shingle hashes for each of the 2 * n * ``ROWS`` minhashes."""
    drawn = S.mix(np.arange(1, 4 * n * ROWS + 1, dtype=np.uint64))
    return drawn[: 2 * n * ROWS], drawn[2 * n * ROWS:] | np.uint64(1)


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each document, and their bounds."""
    hashes, _, _, bounds = S.runs(data, offsets, S.SPACE, lower=True)
    shingles, starts = S.windows(hashes, bounds, words)
    where = np.searchsorted(starts, bounds)
    counts = np.diff(bounds)
    sets = []
    for i, n in enumerate(counts.tolist()):
        if n >= words:
            sets.append(np.unique(shingles[where[i]: where[i + 1]]))
        elif n:
            sets.append(S.windows(hashes[bounds[i]: bounds[i + 1]], np.array([0, n]), n)[0])
        else:
            sets.append(hashes[:0])
    edges = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(x) for x in sets], out=edges[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), edges


def _sketch(data: np.ndarray, offsets: np.ndarray, words: int, n: int) -> tuple[np.ndarray, ...]:
    """Set sizes, two sums that identify each set, and the sub-bands (zero rows for empty sets)."""
    sets, bounds = _sets(data, offsets, words)
    xor, times = _seeds(n)
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    sums = np.zeros((2, len(sizes)), np.uint64)
    bands = np.zeros((len(sizes), 2 * n), np.uint64)
    if len(full):
        at = bounds[full]
        for k in range(2):
            sums[k, full] = np.add.reduceat(S.mix(sets ^ xor[k]), at)
        for band in range(2 * n):
            key = np.zeros(len(full), np.uint64)
            for k in range(band * ROWS, band * ROWS + ROWS):
                key = S.mix(key + np.minimum.reduceat((sets ^ xor[k]) * times[k], at))
            bands[full, band] = key
    return sizes, sums[0], sums[1], bands


def sketches(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``SKETCH`` rows of ``docs`` (doc_id, text)."""
    n = side(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.column_bytes(batch.column(1))
            for i, j in S.slices(offsets, 1 << 20):
                sizes, s1, s2, bands = _sketch(data, offsets[i: j + 1], words, n)
                where = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * (2 * n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sizes), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                     pa.ListArray.from_arrays(where, pa.array(bands.ravel().view(np.int64)))],
                    ["doc_id", "n_shingles", "s1", "s2", "bands"],
                )
            S.release()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``node`` (the id) and ``hashes``, the sorted 64-bit shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.column_bytes(batch.column(1))
            for i, j in S.slices(offsets):
                sets, bounds = _sets(data, offsets[i: j + 1], words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([sets[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())],
                    ["node", "hashes"],
                )
            S.release()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "node bigint, hashes binary")


def _table_keys(reps: DataFrame, n: int) -> DataFrame:
    """``key``, ``node``, ``weight``: the tables in which a node can meet another.

    A sub-band that one node alone has leads nowhere, so only shared sub-bands are paired.
    """
    bands = reps.select("node", F.posexplode("bands").alias("band", "value"))
    shared = bands.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    one = F.xxhash64("band", "value")
    by_node = bands.join(shared, ["band", "value"]).groupBy("node").agg(
        F.collect_list(F.when(F.col("band") < n, one)).alias("left"),
        F.collect_list(F.when(F.col("band") >= n, one)).alias("right"),
        F.sum("size").alias("weight"),
    )
    paired = by_node.select("node", "weight", "right", F.explode("left").alias("u")).select(
        "node", "weight", "u", F.explode("right").alias("v")
    )
    return paired.select(F.xxhash64("u", "v").alias("key"), "node", "weight")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node``, ``hub``, whether their whole sets are similar enough (``linked``) and their Jaccard distance (``far``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, far = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
                far.append(1 - both / (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(far, pa.float64())], ["node", "hub", "linked", "far"])
            S.release()

    hubs = sets.select(F.col("node").alias("hub"), F.col("hashes").alias("hub_hashes"))
    return (
        pairs.join(sets.select("node", "hashes"), "node").join(hubs, "hub").select("node", "hub", "hashes", "hub_hashes")
        .mapInArrow(run, "node bigint, hub bigint, linked boolean, far double")
    )


def _block_links(percent: int):
    """Links between the strangers and the other members of one block; no pair leaves the task unless it is linked."""
    reach, n = 1 - percent / 100 + 1e-9, side(percent)

    def run(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        node, label, far, size, strange = (table[c].to_numpy() for c in ("node", "label", "far", "n_shingles", "strange"))
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, 2 * n)
        hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["hashes"]]
        members = np.flatnonzero(~asks)
        left, right = [], []
        for x in np.flatnonzero(asks).tolist():
            y = members[(label[members] != label[x]) & (np.abs(far[members] - far[x]) <= reach)]
            y = y[~strange[y] | (node[y] > node[x])]
            y = y[100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])]
            y = y[(bands[y] == bands[x]).sum(axis=1) >= COMMON]
            for k in y.tolist():
                both = len(np.intersect1d(hashes[x], hashes[k], assume_unique=True))
                if 100 * both >= percent * (size[x] + size[k] - both):
                    left.append(int(node[x]))
                    right.append(int(node[k]))
        return pa.table({"node": pa.array(left, pa.int64()), "hub": pa.array(right, pa.int64())})

    return run


def _strangers(met: DataFrame, labels: DataFrame, sketch: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (``node``, ``hub``) of strangers within the families of their hubs.

    Strangers and members of a family are dealt into blocks of bounded number and bytes, and each block of strangers meets
    each block of members in the rings of distance around its own.
    """
    ring = F.floor(F.col("far") / (1 - percent / 100))
    named = met.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    named = named.join(own, "hub", "left").withColumn("strange", F.col("label") != F.coalesce("hub_label", "hub"))
    named = named.select("hub", "node", "far", "label", "strange", ring.alias("ring"))
    family = stored(named.join(named.where("strange").select("hub").distinct(), "hub", "left_semi").join(sketch, "node"))
    size = F.col("n_shingles") * 8
    sizes = family.groupBy("hub").agg(
        F.ceil(F.greatest(F.count_if("strange") / STRANGERS, F.sum(F.when(F.col("strange"), size)) / STRANGER_BYTES)).alias("nx"),
        F.ceil(F.greatest(F.count(F.lit(1)) / MEMBERS, F.sum(size) / MEMBER_BYTES)).alias("ny"),
    )
    dealt = family.join(sizes, "hub").withColumn("mine", F.xxhash64("node"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    asks = dealt.where("strange").withColumn("ring", F.explode(F.array(*[F.col("ring") + k for k in (-1, 0, 1)])))
    asks = asks.withColumn("x", F.pmod("mine", "nx")).withColumn("y", every("ny")).withColumn("asks", F.lit(True))
    others = dealt.withColumn("y", F.pmod("mine", "ny")).withColumn("x", every("nx")).withColumn("asks", F.lit(False))
    others = others.join(asks.select("hub", "ring", "x", "y").distinct(), ["hub", "ring", "x", "y"], "left_semi")
    columns = ["hub", "ring", "x", "y", "asks", "node", "label", "far", "strange", "n_shingles", "bands"]
    blocks = asks.select(columns).unionByName(others.select(columns)).join(sets, "node")
    return blocks.groupBy("hub", "ring", "x", "y").applyInArrow(_block_links(percent), "node bigint, hub bigint").distinct()


def _sized(ids: DataFrame) -> DataFrame:
    """Marks a stored table of ids for broadcast if it has at most ``BROADCAST_IDS`` rows; a longer one is shuffled."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def link_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``s1``, ``s2`` and ``component_id`` for each row of ``docs``."""
    drawn = stored(sketches(docs, words, percent))
    known = drawn.where("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = stored(known.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep")))
    sketch = known.join(groups.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select(
        F.col("doc_id").alias("node"), "n_shingles", "bands"
    )
    keys = stored(_table_keys(sketch, side(percent)))
    best = F.struct("weight", (-F.col("node")).alias("order"))
    hubs = keys.groupBy("key").agg(F.max(best).alias("best"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select(
        "key", (-F.col("best.order")).alias("hub")
    )
    pairs = stored(keys.join(hubs, "key").where("node <> hub").select("node", "hub").distinct())
    near = stored(pairs.select("node").union(pairs.select("hub")).distinct())
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(_sized(near.withColumnRenamed("node", "doc_id")), "doc_id", "left_semi")
    sets = stored(shingle_sets(texts.distinct(), words))
    met = stored(_verify(pairs, sets, percent))
    links = met.where("linked").select("node", "hub")
    labels = components(links, "node", "hub")
    rest = stored(_strangers(met, labels, sketch.join(near, "node", "left_semi"), sets, percent))
    if not rest.isEmpty():
        labels = components(links.unionByName(rest), "node", "hub")
    named = drawn.select("doc_id", "n_shingles", "s1", "s2").join(groups, ["n_shingles", "s1", "s2"], "left")
    named = named.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return named.select("doc_id", "n_shingles", "s1", "s2", F.coalesce("label", "rep", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: its set size, the smallest id of its component, and whether it is kept."""
    return link_components(docs).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def keep_first(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that stay: one row for one document of each component, and every row without an id."""
    gone = stored(link_components(docs, percent, words).where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(_sized(gone), "doc_id", "left_anti").select(*docs.columns)
    again = docs.select("doc_id").where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        return kept
    return kept.where("doc_id IS NULL").unionByName(kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
