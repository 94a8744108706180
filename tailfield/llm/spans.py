"""Removal of word windows that also start in a document with a smaller id, by compaction of a De Bruijn graph of words.

The edges of the graph are the ``LENGTH``-word k-mers of the texts; two edges meet where all but one of their words overlap.

1. Consecutive k-mers that share their anchor, the least hashed ``SEED``-word string in them (leftmost on ties), are cut
   from a text as one run. The anchor depends on a k-mer's words alone, so equal k-mers have equal anchors at equal places.
2. Anchors that lie in one document only cannot be in a repeated edge; their runs go. The runs left are folded to kinds by
   all their words: occurrences, first source coordinate, and checksums of the coordinates where they start and end.
3. A node does not branch if the same coordinates enter and leave it: the one kind's ends are the other's starts. Such
   kinds are joined by their source coordinates, checked by the checksums of all coordinates, and pointer doubling, one
   join a round, compacts each path to its head and length. All places of a path but those of its first document are repeats.
4. An anchor with several kinds is where paths branch. The k-mers of the kinds' first documents are told apart one by one.

Kinds and k-mers are told apart by 128 bits of two hashes. A run that occurs in very many documents is one kind after the
map side of its aggregation, however many they are; joins have one row per kind on one side, so a hot kind can be split.

Defined results: a null text has no words; texts of fewer than ``LENGTH`` words lose nothing; a null id comes before all
ids; rows with the same id never remove each other's words, whether they are equal or not, and each gets its own result;
very long texts are cut into overlapping parts for the search only; an empty table gives an empty table; only the id and
text columns are read by ``word_dedup``, and ``repeated_spans`` keeps all others, unless they are named ``spans``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailfield.llm import segments as S
from tailfield.llm.store import stored

LENGTH, SEED = 50, 10
PART = 1 << 18  # words searched at once
CHUNK = 1 << 20  # bytes of a text that are split into words at once
NO_ID = -(1 << 63)
BROADCAST_ROWS = 1 << 20
BROADCAST_BYTES = 32 << 20


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _totals(words: np.ndarray) -> np.ndarray:
    up, _ = S._powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return total


def _strings(total: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of the words between the places ``start`` and ``end``."""
    _, down = S._powers(len(total))
    return S.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(S.BASE) + np.uint64(salt))


def _anchored(words: np.ndarray, room: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of one stretch: flags of the places where a whole k-mer starts, its anchor's place, sums for both hashes."""
    one, two = _totals(words), _totals(S.mix(words + np.uint64(1)))
    n = max(len(words) - length + 1, 0)
    at = np.arange(n)
    ok = at + length <= room[:n]
    seeds = np.arange(max(len(words) - SEED + 1, 0))
    low = np.uint64((1 << 20) - 1)
    packed = (_strings(one, seeds, seeds + SEED, 5) & ~low) | seeds.astype(np.uint64)
    anchor = (_least(packed, length - SEED + 1) & low).astype(np.int64)[:n] if n else at
    return ok, anchor, one, two


def _stretches(hashes: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first word, words, end of its document counted from the first word) of overlapping parts."""
    room = np.repeat(bounds[1:], np.diff(bounds))
    for a in range(0, len(hashes), PART):
        b = min(a + PART + length - 1, len(hashes))
        yield a, hashes[a:b], np.minimum(room[a:b], b) - a


def _runs(hashes: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor hash, run hash, first word and number of k-mers of each run."""
    for a, words, room in _stretches(hashes, bounds, length):
        ok, anchor, one, two = _anchored(words, room, length)
        if not ok.any():
            continue
        begins, stops = ok.copy(), ok.copy()
        same = (anchor[1:] == anchor[:-1]) & ok[1:] & ok[:-1]
        begins[1:] &= ~same
        stops[:-1] &= ~same
        s, e = np.flatnonzero(begins), np.flatnonzero(stops)
        at = anchor[s]
        kind = _strings(two, s, e + length, 9) + (at - s).astype(np.uint64) * np.uint64(S.BASE)
        yield _strings(one, at, at + SEED, 7), kind, s + a, e - s + 1


def _scan(length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            data, offsets = S.column_bytes(batch.column(2))
            for i, j in S.slices(offsets):
                hashes, _, _, bounds = S.runs(data, offsets[i: j + 1], S.SPACE)
                for g, k, s, n in _runs(hashes, bounds, length):
                    doc = np.searchsorted(bounds, s, "right") - 1
                    yield pa.RecordBatch.from_pydict({
                        "g": g.view(np.int64), "k": k.view(np.int64), "doc": ids[i + doc], "key": keys[i + doc],
                        "s": (s - bounds[doc]).astype(np.int32), "n": n.astype(np.int32)})
            S.release()

    return scan


def _window_scan(length: int):
    """The k-mers of the given runs (doc, key, text, runs), each with two hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            data, offsets = S.column_bytes(batch.column(2))
            lists = batch.column(3)
            ends, flat = np.asarray(lists.offsets), lists.values
            first, count = (np.asarray(flat.field(c)).astype(np.int64) for c in (0, 1))
            for i, j in S.slices(offsets):
                hashes, _, _, bounds = S.runs(data, offsets[i: j + 1], S.SPACE)
                size = np.diff(ends[i: j + 1])
                base = np.repeat(bounds[:-1], size) + first[ends[i]: ends[j]]
                here = np.repeat(np.arange(j - i), size)
                reach = count[ends[i]: ends[j]]
                at = np.repeat(base, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
                doc = np.repeat(here, reach)
                order = np.argsort(at, kind="stable")
                at, doc = at[order], doc[order]
                for a in range(0, len(hashes), PART):
                    b = min(a + PART, len(hashes))
                    words = hashes[a: b + length - 1]
                    lo, hi = np.searchsorted(at, [a, b])
                    if lo == hi:
                        continue
                    place = at[lo:hi] - a
                    one, two = (_strings(_totals(w), place, place + length, c) for w, c in ((words, 3), (S.mix(words + np.uint64(1)), 4)))
                    d = doc[lo:hi]
                    yield pa.RecordBatch.from_pydict({
                        "g": one.view(np.int64), "k": two.view(np.int64), "doc": ids[i + d], "key": keys[i + d],
                        "s": (at[lo:hi] - bounds[d]).astype(np.int32)})
            S.release()

    return scan


def _small(rows: DataFrame) -> DataFrame:
    """Marks a stored table of few columns for broadcast if it has few rows; larger ones meet by a shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _sized(lists: DataFrame, column: str) -> DataFrame:
    """The same for one row per document with a list."""
    size = lists.agg(F.sum(F.size(column) * 8 + 64)).first()[0] or 0
    return F.broadcast(lists) if size <= BROADCAST_BYTES else lists


def _checksums(start: Column, name: str) -> list[Column]:
    """Sums of both halves of a hash of each coordinate; they do not overflow below 2**31 coordinates."""
    h = F.xxhash64("doc", "key", start)
    return [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{name}0"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"{name}1")]


def kinds_of(runs: DataFrame) -> DataFrame:
    """Runs folded by all their words: number, first source coordinate, last document, checksums of starts and ends."""
    return runs.groupBy("g", "k").agg(
        F.count("*").alias("c"), F.min(F.struct("doc", "key", "s")).alias("at"), F.max("doc").alias("last"), F.max("n").alias("n"),
        *_checksums(F.col("s"), "a"), *_checksums(F.col("s") + F.col("n"), "b"))


def compacted(kinds: DataFrame) -> DataFrame:
    """Unbranched paths of kinds: the head's ``g``, ``k``, ``at`` and ``c``, and ``n``, the k-mers of the whole path.

    ``next`` is the coordinate where the kind that follows has its first occurrence. Pointers double until none is left;
    places grow along a path, so it has an end.
    """
    source = lambda x: [F.col(f"at.{c}") for c in ("doc", "key")] + [x]
    left = kinds.select("g", "k", "c", "at", "n", F.struct(*source((F.col("at.s") + F.col("n")).alias("s"))).alias("end"), F.col("b0").alias("x"), F.col("b1").alias("y"))
    right = kinds.select(F.col("at").alias("next"), F.col("c").alias("rc"), "a0", "a1")
    meets = (F.col("end") == F.col("next")) & (F.col("c") == F.col("rc")) & (F.col("x") == F.col("a0")) & (F.col("y") == F.col("a1"))
    path = stored(left.join(right, meets, "left").select("g", "k", "c", "at", "n", "next"))
    inner = stored(path.where("next IS NOT NULL").select(F.col("next").alias("at")))
    while not path.where("next IS NOT NULL").isEmpty():
        onward = path.select(F.col("at").alias("next"), F.col("n").alias("more"), F.col("next").alias("then"))
        path = stored(path.join(onward, "next", "left").select("g", "k", "c", "at", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.col("then").alias("next")))
    return path.join(inner, "at", "left_anti").select("g", "k", "c", "at", "n")


def _sources(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")


def candidate_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Runs whose anchor occurs in more than one document, stored."""
    runs = stored(_sources(docs).mapInArrow(_scan(length), "g long, k long, doc long, key long, s int, n int"))
    several = stored(runs.groupBy("g").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("g"))
    return stored(runs.join(_small(several), "g", "left_semi"))


def repeated_paths(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Repeated unbranched paths: first document and word, number of words, number of occurrences."""
    kinds = stored(kinds_of(candidate_runs(docs, length)))
    return compacted(kinds.where("at.doc < last")).select(
        F.nullif("at.doc", F.lit(NO_ID)).alias("doc_id"), F.col("at.s").alias("start"), (F.col("n") + length - 1).alias("words"), F.col("c").alias("occurrences"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (doc_id, text) with ``spans``: word ranges (s, e) whose k-mers start in a smaller document; null if none."""
    runs = candidate_runs(docs, length)
    kinds = stored(kinds_of(runs))
    heads = stored(compacted(kinds.where("at.doc < last")).select("g", "k", F.col("at.doc").alias("low"), F.col("n").alias("whole")))
    settled = runs.join(_small(heads), ["g", "k"]).where("doc > low").select("doc", "key", "s", (F.col("s") + F.col("whole") + (length - 1)).alias("e"))
    branched = stored(kinds.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1").select("g"))
    open_ = stored(kinds.join(_small(branched), "g", "left_semi").select("g", "k", F.col("at.doc").alias("low")))
    todo = runs.join(_small(open_), ["g", "k"]).where("doc = low").groupBy("doc", "key").agg(F.collect_set(F.struct("s", "n")).alias("runs"))
    kmers = stored(_sources(docs).join(_sized(stored(todo), "runs"), ["doc", "key"]).select("doc", "key", "text", "runs").mapInArrow(
        _window_scan(length), "g long, k long, doc long, key long, s int"))
    firsts = stored(kmers.groupBy("g", "k").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("g", "k", "low"))
    single = kmers.join(_small(firsts), ["g", "k"]).where("doc > low").select("doc", "key", "s", (F.col("s") + length).alias("e"))
    spans = stored(settled.unionByName(single).groupBy("doc", "key").agg(F.collect_set(F.struct("s", "e")).alias("spans")))
    named = _sized(spans, "spans").withColumnsRenamed({"doc": "_doc", "key": "_key"})
    whole = docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), "_key": F.xxhash64(F.coalesce("text", F.lit("")))})
    return whole.join(named, ["_doc", "_key"], "left").drop("_doc", "_key")


def _chunks(raw: memoryview) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; a piece ends at white space."""
    a = 0
    while a < len(raw):
        b = min(a + CHUNK, len(raw))
        while b < len(raw) and raw[b] not in b" \t\n\r\x0b\x0c":
            b += 1
        yield bytes(raw[a:b]).split()
        a = b


def without(text: Column, spans: Column) -> Column:
    """The words of ``text`` outside ``spans`` joined by one space, and the sizes, as a struct."""

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def run(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        data, offsets = S.column_bytes(texts)
        view, out = memoryview(data), []
        for d, found in enumerate(ranges):
            pairs = [(p["s"].as_py(), p["e"].as_py()) for p in found.values] if found.is_valid else []
            edges, end = [], 0
            for s, e in sorted(pairs):  # merged: word numbers where what is kept starts and ends
                if s > end:
                    edges.append((end, s))
                end = max(end, e)
            n, kept, gone = 0, [], 0
            for words in _chunks(view[offsets[d]: offsets[d + 1]]):
                stay = [w for a, b in edges if a < n + len(words) and b > n for w in words[max(a - n, 0): b - n]] + words[max(end - n, 0):]
                kept.append(b" ".join(stay))
                n, gone = n + len(words), gone + len(words) - len(stay)
            out.append((n, gone, b" ".join(k for k in kept if k)))
        n, gone, kept = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "n_removed", "kept"])

    return run(text, spans)


def word_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: its words, how many were removed, and the digest of those that stay."""
    found = repeated_spans(docs.select("doc_id", "text")).select("doc_id", without(F.col("text"), F.col("spans")).alias("f"))
    return found.select("doc_id", "f.n_words", "f.n_removed", F.sha2(F.encode("f.kept", "UTF-8"), 256).alias("kept_sha256"))
