"""Removal of byte strings that occur earlier, by a depth-limited most-significant-digit sort of suffixes.

A suffix is followed through ``LENGTH`` bytes only, its window. Sorting every suffix would move many times the input, so
the first digit is content-anchored: a window belongs to the least of the hashed ``DIGIT``-byte strings in it (leftmost
on ties), so equal windows have equal anchors at equal places, and neighbouring windows share one. The passes are

1. windows with one anchor and no gap form a run; runs are grouped by their anchor's bytes, then by all their bytes.
   Of runs that are equal throughout, all windows of all but the first occur earlier. An anchor with one kind of run is
   then settled. The others' first runs are grouped by the ``SIDE`` bytes more to either side of the anchor: a window
   holds one of these sides whole, so windows whose side is with one kind only are settled as well;
2. the windows that are left are grouped by all their bytes: equal groups are the repeated windows among them.

Groups are told apart by two independent hashes, of 64 and at least 32 bits. Equal runs and windows of one task are folded before the shuffle,
and an anchor with very many kinds of runs in a task is spread over all buckets, as its windows are compared anyway.

Defined results: a null text counts as empty; texts shorter than ``LENGTH`` bytes lose nothing; rows with the same id and
text are one document; other texts of one id come in the order of their CRC-32; a null id comes before all ids; very long
texts are cut into overlapping parts for the search only; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailfield.llm import segments as S
from tailfield.llm.store import stored

LENGTH, DIGIT = 100, 32
SIDE = (LENGTH - DIGIT) // 2
PART = 1 << 19  # bytes searched at once; longer documents are cut into overlapping parts
HELD = 1 << 19  # runs or windows that a task folds at once
KINDS_HELD = 1024  # kinds of runs of one anchor and fold that still go to the anchor's own bucket
BUCKET_BYTES = 32 << 20  # text per bucket
NO_ID = -(1 << 63)

_TABLES = S.mix(np.arange(1, 513, dtype=np.uint64)).reshape(2, 256)
_BASES = (0x2127599BF4325C37, 0x880355F21E6D1965)
# Anchor, run, document, first start, number of starts, anchor's place after the first start, hashes of the sides (0: not whole).
RUN = np.dtype([("g", "u8"), ("k", "u8"), ("doc", "i8"), ("crc", "u4"), ("s", "i4"), ("n", "u1"), ("a", "u1"), ("l", "u4"), ("r", "u4")])
WINDOW = np.dtype([("g", "u8"), ("k", "u4"), ("doc", "i8"), ("crc", "u4"), ("s", "i4")])
BROADCAST_BYTES = 32 << 20
SPAN = np.dtype([("doc", "i8"), ("crc", "u4"), ("s", "i4"), ("e", "i4")])
ROWS = "kind string, bucket int, data binary"


def _hashes(text: np.ndarray, which: int, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Polynomial hashes of the substrings of the given sizes at every place; each size is the sum of two known ones."""
    known, base = {1: _TABLES[which][text]}, _BASES[which]
    for size, left in sizes_from(sizes):
        right = size - left
        n = len(text) - size + 1
        if n <= 0:
            known[size] = np.zeros(0, np.uint64)
            continue
        known[size] = known[left][:n] * np.uint64(pow(base, right, 1 << 64)) + known[right][left: left + n]
    return known


def sizes_from(sizes: tuple[int, ...]) -> list[tuple[int, int]]:
    """The doublings and sums that lead to ``sizes``: (size, left part)."""
    out, known = [], {1}
    for size in sizes:
        power = 1
        while power * 2 <= size:
            if power * 2 not in known:
                out.append((power * 2, power))
                known.add(power * 2)
            power *= 2
        rest, have = size - power, power
        while rest:
            step = 1 << (rest.bit_length() - 1)
            if have + step not in known:
                out.append((have + step, have))
                known.add(have + step)
            have, rest = have + step, rest - step
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _parts(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first document, end document, first byte, end byte) of stretches to search at once."""
    for i, j in S.slices(offsets, PART):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= PART:
            yield i, j, a, b
            continue
        while a < b:
            yield i, j, a, min(a + PART + LENGTH - 1, b)
            a += PART


def _starts(offsets: np.ndarray, i: int, j: int, a: int, b: int) -> np.ndarray:
    """Flags of the places in a stretch where a whole window of one document starts."""
    ok = np.ones(max(b - a - LENGTH + 1, 0), bool)
    for end in (offsets[i + 1: j] - a).tolist():
        ok[max(end - LENGTH + 1, 0): end] = False
    return ok


def _runs(data: np.ndarray, offsets: np.ndarray, i: int, j: int, a: int, b: int) -> np.ndarray:
    """The runs in a stretch; ``s`` counts from the start of the data, ``doc`` is an index."""
    ok = _starts(offsets, i, j, a, b)
    if not ok.any():
        return np.zeros(0, RUN)
    text = data[a:b]
    known = _hashes(text, 0, (DIGIT, DIGIT + SIDE))
    digit, side = S.mix(known[DIGIT]), S.mix(known[DIGIT + SIDE])
    whole = _hashes(text, 1, (LENGTH,))[LENGTH]
    low = np.uint64((1 << 24) - 1)
    packed = (digit & ~low) | np.arange(len(digit), dtype=np.uint64)
    anchor = (_least(packed, LENGTH - DIGIT + 1) & low).astype(np.int64)
    begins, stops = ok.copy(), ok.copy()
    same = (anchor[1:] == anchor[:-1]) & ok[1:] & ok[:-1]
    begins[1:] &= ~same
    stops[:-1] &= ~same
    s, e = np.flatnonzero(begins), np.flatnonzero(stops)
    at = anchor[s]
    k = S.mix(S.mix(whole[s]) * np.uint64(3) + S.mix(whole[e] + np.uint64(7)) + ((e - s) * 128 + at - s).astype(np.uint64))
    doc = np.searchsorted(offsets, s + a, "right") - 1
    low_edge, high_edge = np.maximum(offsets[doc] - a, 0), np.minimum(offsets[doc + 1], b) - a
    out = np.zeros(len(s), RUN)
    out["g"], out["k"], out["doc"], out["s"], out["n"], out["a"] = digit[at], k, doc, s + a - offsets[doc], e - s + 1, at - s
    short = lambda x: (x >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    left, right = at - SIDE >= low_edge, at + DIGIT + SIDE <= high_edge
    out["l"][left], out["r"][right] = short(side[at[left] - SIDE]), short(side[at[right]])
    return out


def _first(rows: np.ndarray) -> np.ndarray:
    """Flags of the first row of each (g, k) in rows sorted by (g, k, doc, crc, s); rows at the same place are equal to it."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows["g"][1:] != rows["g"][:-1]) | (rows["k"][1:] != rows["k"][:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    return (rows["doc"] == rows["doc"][lead]) & (rows["crc"] == rows["crc"][lead]) & (rows["s"] == rows["s"][lead])


def _sorted(rows: np.ndarray) -> np.ndarray:
    """``rows`` by (g, k, doc, crc, s). Rows that are alone with their g are left out of the costly part of the sort."""
    rows = rows[np.argsort(rows["g"])]
    same = rows["g"][1:] == rows["g"][:-1]
    many = np.zeros(len(rows), bool)
    many[1:] |= same
    many[:-1] |= same
    some = rows[many]
    rows[np.flatnonzero(many)] = some[np.lexsort((some["s"], some["crc"], some["doc"], some["k"], some["g"]))]
    return rows


def _spans(rows: np.ndarray) -> np.ndarray:
    """The bytes that the windows of the given runs cover."""
    out = np.zeros(len(rows), SPAN)
    more = rows["n"].astype(np.int32) - 1 if "n" in rows.dtype.names else 0
    out["doc"], out["crc"], out["s"], out["e"] = rows["doc"], rows["crc"], rows["s"], rows["s"] + more + LENGTH
    return out


def _merged(spans: np.ndarray) -> np.ndarray:
    """Spans sorted by document and place, with overlapping and touching ones joined."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["s"], spans["crc"], spans["doc"]))]
    change = np.ones(len(spans), bool)
    change[1:] = (spans["doc"][1:] != spans["doc"][:-1]) | (spans["crc"][1:] != spans["crc"][:-1])
    shift = np.cumsum(change).astype(np.int64) << 32
    reach = np.maximum.accumulate(spans["e"] + shift)
    new = change.copy()
    new[1:] |= spans["s"][1:] + shift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    out = spans[at]
    out["e"] = (reach - shift)[np.append(at[1:], len(spans)) - 1]
    return out


def _dealt(kind: str, rows: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[str, int, bytes]]:
    """``rows`` by bucket, in document order within it, which packs well."""
    if len(rows):
        order = np.lexsort((rows["s"], rows["crc"], rows["doc"], bucket))
        rows, bucket = rows[order], bucket[order]
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        pack = zstandard.ZstdCompressor(level=1)
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(rows)], strict=True):
            part = rows[a:b].copy()
            part["s"][1:] -= part["s"][:-1].copy()
            yield kind, int(bucket[a]), pack.compress(b"".join(np.ascontiguousarray(part[c]).tobytes() for c in rows.dtype.names))


def _undealt(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    raw = [unpack.decompress(b) for b in blobs]
    out = np.zeros(sum(len(b) for b in raw) // dtype.itemsize, dtype)
    at = 0
    for blob in raw:
        n, here = len(blob) // dtype.itemsize, 0
        for name in dtype.names:
            size = dtype[name].itemsize * n
            part = np.frombuffer(blob, dtype[name], n, here)
            out[name][at: at + n] = np.cumsum(part, dtype=part.dtype) if name == "s" else part
            here += size
        at += n
    return out


def _table(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    kinds, buckets, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(buckets, pa.int32()), pa.array(data, pa.binary())], ["kind", "bucket", "data"])


def _of_document(rows: np.ndarray, buckets: int) -> np.ndarray:
    return (S.mix(rows["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _folded_runs(rows: np.ndarray, buckets: int) -> Iterator[tuple[str, int, bytes]]:
    """What one fold sends on: the first of each kind of run, and what the others cover."""
    rows = _sorted(rows)
    first = _first(rows)
    covered = _merged(_spans(rows[~first]))
    yield from _dealt("cover", covered, _of_document(covered, buckets))
    rows = rows[first]
    rows = rows[np.append(True, (rows["g"][1:] != rows["g"][:-1]) | (rows["k"][1:] != rows["k"][:-1]))] if len(rows) else rows
    group = np.cumsum(np.append(True, rows["g"][1:] != rows["g"][:-1])) - 1 if len(rows) else np.zeros(0, np.int64)
    kinds = np.bincount(group)[group] if len(rows) else group
    spread = kinds > KINDS_HELD
    yield from _dealt("run", rows[~spread], (rows["g"][~spread] % np.uint64(buckets)).astype(np.int32))
    todo = _spans(rows[spread])
    yield from _dealt("todo", todo, _of_document(todo, buckets))
    marks = rows[spread & np.append(True, rows["g"][1:] != rows["g"][:-1])] if len(rows) else rows
    yield from _dealt("mark", marks, (marks["g"] % np.uint64(buckets)).astype(np.int32))


def _identity(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _checks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(data[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)], np.uint32)


def _run_scan(buckets: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = _identity(batch.column(0))
            data, offsets = S.column_bytes(batch.column(1))
            crc = _checks(data, offsets)
            for i, j, a, b in _parts(offsets):
                rows = _runs(data, offsets, i, j, a, b)
                rows["crc"], rows["doc"] = crc[rows["doc"]], ids[rows["doc"]]
                held.append(rows)
                n += len(rows)
                if n >= HELD:
                    yield _table(list(_folded_runs(np.concatenate(held), buckets)))
                    held, n = [], 0
                    S.release()
        if held:
            yield _table(list(_folded_runs(np.concatenate(held), buckets)))

    return scan


def _side_spans(rows: np.ndarray, side: str) -> np.ndarray:
    """What the windows with a whole left (or right) side cover, of the runs that share it with another run."""
    key = S.mix(rows["g"] + S.mix(rows[side].astype(np.uint64)))
    order = np.argsort(key)
    ranked = key[order]
    same = np.zeros(len(rows) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    shared = np.zeros(len(rows), bool)
    shared[order] = same[1:] | same[:-1]
    rows = rows[shared & (rows[side] > 0)]
    first, last = rows["s"], rows["s"] + rows["n"].astype(np.int32) - 1
    middle = rows["s"] + rows["a"].astype(np.int32) - SIDE
    first, last = (first, np.minimum(last, middle)) if side == "l" else (np.maximum(first, middle), last)
    ok = first <= last
    out = np.zeros(int(ok.sum()), SPAN)
    out["doc"], out["crc"], out["s"], out["e"] = rows["doc"][ok], rows["crc"][ok], first[ok], last[ok] + LENGTH
    return out


def _settle_runs(buckets: int):
    """Of one bucket: what all but the first of equal runs cover, and the first runs of anchors with several kinds."""

    def settle(table: pa.Table) -> pa.Table:
        kinds, data = table["kind"].to_pylist(), table["data"].to_pylist()
        marked = np.unique(_undealt([d for k, d in zip(kinds, data, strict=True) if k == "mark"], RUN)["g"])
        rows = _sorted(_undealt([d for k, d in zip(kinds, data, strict=True) if k == "run"], RUN))
        first = _first(rows)
        covered = _merged(_spans(rows[~first]))
        rows = rows[first]
        whole = np.isin(rows["g"], marked)
        several = np.zeros(len(rows), bool)
        if len(rows):
            change = rows["g"][1:] != rows["g"][:-1]
            group = np.cumsum(np.append(True, change)) - 1
            kind = np.cumsum(np.append(True, change | (rows["k"][1:] != rows["k"][:-1])))
            low, high = np.full(group[-1] + 1, kind[-1] + 1), np.zeros(group[-1] + 1, np.int64)
            np.minimum.at(low, group, kind)
            np.maximum.at(high, group, kind)
            several = (low < high)[group]
        some = rows[several & ~whole]
        todo = np.concatenate([_spans(rows[whole]), _side_spans(some, "l"), _side_spans(some, "r")])
        todo = _merged(todo)
        out = [*_dealt("cover", covered, _of_document(covered, buckets)), *_dealt("todo", todo, _of_document(todo, buckets))]
        return pa.Table.from_batches([_table(out)])

    return settle


def _window_scan(buckets: int):
    """Windows that start within the given spans (doc, crc, text, spans), folded as the runs are."""

    def folded(rows: np.ndarray) -> pa.RecordBatch:
        rows = _sorted(rows)
        first = _first(rows)
        covered = _merged(_spans(rows[~first]))
        rows = rows[first]
        return _table([*_dealt("cover", covered, _of_document(covered, buckets)), *_dealt("run", rows, (S.mix(rows["g"]) % np.uint64(buckets)).astype(np.int32))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, crcs = _identity(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = S.column_bytes(batch.column(2))
            for d, blob in enumerate(batch.column(3)):
                for s, e in np.frombuffer(blob.as_buffer(), "i4").reshape(-1, 2).tolist():
                    for at in range(s, e - LENGTH + 1, PART):
                        stop = min(at + PART + LENGTH - 1, e)
                        text = data[offsets[d] + at: offsets[d] + stop]
                        one, two = (_hashes(text, w, (LENGTH,))[LENGTH] for w in (0, 1))
                        rows = np.zeros(len(one), WINDOW)
                        rows["g"], rows["k"], rows["doc"], rows["crc"] = S.mix(one), S.mix(two) >> np.uint64(32), ids[d], crcs[d]
                        rows["s"] = np.arange(at, at + len(one))
                        held.append(rows)
                        n += len(rows)
                        if n >= HELD:
                            yield folded(np.concatenate(held))
                            held, n = [], 0
                            S.release()
        if held:
            yield folded(np.concatenate(held))

    return scan


def _settle_windows(buckets: int):
    def settle(table: pa.Table) -> pa.Table:
        kinds, data = table["kind"].to_pylist(), table["data"].to_pylist()
        rows = _sorted(_undealt([d for k, d in zip(kinds, data, strict=True) if k == "run"], WINDOW))
        covered = _merged(_spans(rows[~_first(rows)]))
        return pa.Table.from_batches([_table(list(_dealt("cover", covered, _of_document(covered, buckets))))])

    return settle


def _by_document(rows: DataFrame) -> DataFrame:
    """``doc``, ``crc`` and the merged ``spans`` (pairs of 32-bit numbers) of each document that has some."""

    def join(table: pa.Table) -> pa.Table:
        spans = _merged(_undealt(table["data"].to_pylist(), SPAN))
        change = np.append(True, (spans["doc"][1:] != spans["doc"][:-1]) | (spans["crc"][1:] != spans["crc"][:-1])) if len(spans) else np.zeros(0, bool)
        at = np.flatnonzero(change)
        pairs = np.stack([spans["s"], spans["e"]], axis=1)
        ends = [*at[1:].tolist(), len(spans)] if len(at) else []
        blobs = [pairs[a:b].tobytes() for a, b in zip(at.tolist(), ends, strict=True)]
        return pa.table({"doc": pa.array(spans["doc"][at]), "crc": pa.array(spans["crc"][at].astype(np.int64)), "spans": pa.array(blobs, pa.binary())})

    return rows.groupBy("bucket").applyInArrow(join, "doc bigint, crc bigint, spans binary")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``spans``: the merged byte ranges that occur earlier, null where there are none."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(24, -(-total // BUCKET_BYTES))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def settled(scanned: DataFrame, settle) -> DataFrame:
        """Runs meet in their buckets; what is settled already passes by in the same stage."""
        return scanned.groupBy(F.col("bucket").alias("to")).applyInArrow(_passing(settle(buckets)), ROWS)

    one = stored(settled(rows.mapInArrow(_run_scan(buckets), ROWS), _settle_runs))
    keyed = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.crc32(F.coalesce("text", F.lit(""))).alias("crc"), "text")
    todo = _sized(stored(_by_document(one.where("kind = 'todo'"))))
    held = keyed.join(todo, ["doc", "crc"]).select("doc", "crc", "text", "spans")
    two = stored(settled(held.mapInArrow(_window_scan(buckets), ROWS), _settle_windows))
    covers = stored(_by_document(one.where("kind = 'cover'").unionByName(two.where("kind = 'cover'"))))
    whole = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))).withColumn("_crc", F.crc32(F.coalesce("text", F.lit(""))))
    named = covers.select(F.col("doc").alias("_doc"), F.col("crc").alias("_crc"), "spans")
    return whole.join(_sized(named), ["_doc", "_crc"], "left").drop("_doc", "_crc")


def _sized(spans: DataFrame) -> DataFrame:
    """Marks a stored table of spans for broadcast if it is small; a larger one meets the texts by a shuffle."""
    size = spans.agg(F.sum(F.octet_length("spans") + 64)).first()[0] or 0
    return F.broadcast(spans) if size <= BROADCAST_BYTES else spans


def _passing(settle):
    def run(table: pa.Table) -> pa.Table:
        kinds = pc.is_in(table["kind"], value_set=pa.array(["run", "mark"]))
        done = table.filter(pc.invert(kinds)).select(["kind", "bucket", "data"])
        return pa.concat_tables([settle(table.filter(kinds)), done])

    return run


def without(text: Column, spans: Column) -> Column:
    """The bytes of ``text`` outside ``spans``, and the sizes, as a struct."""

    @F.arrow_udf("struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>")
    def run(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        data, offsets = S.column_bytes(texts)
        rows = []
        for d, blob in enumerate(ranges):
            raw = data[offsets[d]: offsets[d + 1]].tobytes()
            pairs = np.frombuffer(blob.as_buffer(), "i4").reshape(-1, 2).tolist() if blob.is_valid else []
            edges = [0, *(x for pair in pairs for x in pair), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if pairs else raw
            rows.append((len(raw), len(raw) - len(kept), len(pairs), kept))
        n, gone, count, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())],
            ["n_bytes", "n_removed", "n_spans", "kept"],
        )

    return run(text, spans)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: its size, what was removed, and the digest of the bytes that stay."""
    found = repeated_spans(docs.select("doc_id", "text")).select("doc_id", without(F.col("text"), F.col("spans")).alias("f"))
    return found.select("doc_id", "f.n_bytes", "f.n_removed", "f.n_spans", F.sha2("f.kept", 256).alias("kept_sha256"))
