"""Vectorised views of UTF-8 text columns: byte buffers, runs between separators, 64-bit run hashes.

Everything works on slices of an Arrow batch, so memory is bounded by the slice (``SLICE`` bytes, or one
document where that is longer) and not by the batch or the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 4 << 20
PIECE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after a batch and would hold its peak."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(int(n - 1).bit_length(), 20)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"], _POWERS["down"]


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its ``n + 1`` offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, what = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``size`` bytes together, or one longer document."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _cuts(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about ``PIECE`` bytes that end where no run goes on: at a separator or a document's end."""
    pos, end = int(offsets[0]), int(offsets[-1])
    while pos < end:
        stop = min(pos + PIECE, end)
        if stop < end:
            last = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            if last <= pos:
                found = np.flatnonzero(sep[data[pos:stop]])
                last = pos + int(found[-1]) + 1 if len(found) else 0
            if last <= pos:
                last, here = end, stop
                edge = int(offsets[np.searchsorted(offsets, stop, "left")])
                while here < edge:
                    found = np.flatnonzero(sep[data[here:min(here + PIECE, edge)]])
                    if len(found):
                        edge = here + int(found[0]) + 1
                        break
                    here += PIECE
                last = edge
            stop = last
        yield pos, stop
        pos = stop


def runs(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that are not separators, within each document.

    Returns their hashes, starts and ends (positions in ``data``) and, for each of the ``n + 1`` offsets, the number
    of runs before it. ``lower`` hashes A-Z as a-z.
    """
    hashes, starts, ends = [], [], []
    for a, b in _cuts(data, offsets, sep):
        piece = data[a:b]
        inside = ~sep[piece]
        first = np.zeros(b - a + 1, bool)
        here = offsets[np.searchsorted(offsets, a, "left"): np.searchsorted(offsets, b, "right")] - a
        first[here] = True
        first[0] = first[-1] = True
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        stops[:-1] &= ~inside[1:] | first[1:-1]
        s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        up, down = _powers(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((LOWER[piece] if lower else piece).astype(np.uint64) * up[: b - a], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        hashes.append(mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        starts.append(s + a)
        ends.append(e + a)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), starts, np.concatenate(ends), np.searchsorted(starts, offsets, "left")


def owners(bounds: np.ndarray) -> np.ndarray:
    """The document index of each run, from the run counts at the offsets."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def per_document(flags: np.ndarray, base: int, offsets: np.ndarray) -> np.ndarray:
    """Counts of true bytes per document; ``flags`` starts at byte ``base``."""
    edges = (offsets - base).tolist()
    return np.fromiter((np.count_nonzero(flags[i:j]) for i, j in zip(edges, edges[1:], strict=False)), np.int64, len(offsets) - 1)


def windows(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive runs of one document, and the index of each window's first run."""
    starts = np.arange(max(len(hashes) - n + 1, 0))
    room = np.repeat(bounds[1:], np.diff(bounds))[: len(starts)]
    starts = starts[starts + n <= room]
    out = np.zeros(len(starts), np.uint64)
    for i in range(n):
        out = (out + hashes[starts + i]) * np.uint64(BASE + 2 * i)
    return mix(out), starts
