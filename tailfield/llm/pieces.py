"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda of adjacent symbol pairs.

A text is normalised as the model does (spaces become U+2581, one more goes in front), cut where U+2581 follows another
character, which no piece of the vocabulary spans, and each distinct segment is encoded once per slice: all segments keep
their own agenda, and one vector step merges every segment's best pair (highest score, then leftmost). Segments longer
than ``LONG`` characters use a heap. What stays without a piece falls back to bytes. Each distinct segment's ids and text
are then compared with what the sentencepiece library gives.

Defined results: null and empty texts give the begin and end ids only; very long texts are encoded whole; repeated rows
and ties are encoded alike; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailfield.llm import segments as S

MARK = "▁"
LONG = 48
BLOCK = 1 << 14
SLICE = 2 << 20
NONE = np.int32(2**31 - 1)
ENCODED = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


class Vocabulary:
    """Symbols, the pairs that merge, and the ids, scores and bytes of a merge-type model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        pieces = {sp.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece spans the start of a word; this vocabulary is not supported")
        if sp.is_unused(0) or any(sp.is_unused(i) for i in plain):
            raise ValueError("unused pieces are not supported")
        extra = sorted({c for p in pieces for c in p} - pieces.keys())
        symbols = pieces | {c: size + k for k, c in enumerate(extra)}
        self.other = size + len(extra)
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.byte = np.zeros(256, np.int32)
        for i in range(size):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[3:-1], 16)] = i
        self.final = np.full(self.other + 1, -1, np.int32)
        self.final[plain] = plain
        scores = np.array([sp.get_score(i) for i in plain])
        order = np.unique(-scores, return_inverse=True)[1]
        rank = dict(zip(plain, order.tolist(), strict=True))
        self.of_char = np.full(0x110000, self.other, np.int32)
        for text, symbol in symbols.items():
            if len(text) == 1:
                self.of_char[ord(text)] = symbol
        self.base = np.int64(self.other + 1)
        found = {}
        for text, made in pieces.items():
            for cut in range(1, len(text)):
                left, right = symbols.get(text[:cut]), symbols.get(text[cut:])
                if left is not None and right is not None:
                    found[left * int(self.base) + right] = made
        keys = np.array(sorted(found), np.int64)
        self.mask = np.uint64((1 << 20) - 1)
        self._merged: dict[int, tuple[int, int]] | None = None
        self._fill(keys, np.array([rank[found[k]] for k in keys.tolist()], np.int32), np.array([found[k] for k in keys.tolist()], np.int32))
        self.text = [b""] * size
        for i in range(size):
            if sp.is_byte(i):
                self.text[i] = bytes([int(sp.id_to_piece(i)[3:-1], 16)])
            elif i in rank:
                self.text[i] = sp.id_to_piece(i).replace(MARK, " ").encode()

    def _fill(self, keys: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        """An open-addressing table of the pairs, so that many pairs are looked up at once."""
        slots = int(self.mask) + 1
        self.keys, self.rank, self.made = np.full(slots, -1, np.int64), np.full(slots, NONE, np.int32), np.full(slots, -1, np.int32)
        self.steps, left, at = 0, np.arange(len(keys)), self._slot(keys)
        while len(left):
            self.steps += 1
            free = self.keys[at[left]] < 0
            taken, first = np.unique(at[left][free], return_index=True)
            winners = left[free][first]
            self.keys[taken], self.rank[taken], self.made[taken] = keys[winners], rank[winners], made[winners]
            left = np.setdiff1d(left, winners, assume_unique=True)
            at[left] = (at[left] + 1) & int(self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (S.mix(keys.astype(np.uint64)) & self.mask).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; ``NONE`` where it does not merge. Negative symbols never do."""
        keys = left.astype(np.int64) * self.base + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        rank, made = np.where(self.keys[at] == keys, self.rank[at], NONE), self.made[at]
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        for _ in range(self.steps - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & int(self.mask)
            here = self.keys[at[open_]]
            hit = open_[here == keys[open_]]
            rank[hit], made[hit] = self.rank[at[hit]], self.made[at[hit]]
            open_ = open_[(here != keys[open_]) & (here >= 0)]
        return rank, made

    def agendas(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all rows of ``chars`` (code points, -1 after the end) at once: symbols, and which positions remain."""
        n, width = chars.shape
        alive = chars >= 0
        sym = np.where(alive, self.of_char[np.maximum(chars, 0)], -1)
        if width == 1:
            return sym, alive
        rank, made = (x.reshape(n, width - 1) for x in self.pairs(sym[:, :-1].ravel(), sym[:, 1:].ravel()))
        rank, made = np.pad(rank, ((0, 0), (0, 1)), constant_values=NONE), np.pad(made, ((0, 0), (0, 1)))
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
        rows = np.arange(n)
        while True:
            p = rank[rows].argmin(axis=1)
            going = rank[rows, p] != NONE
            rows, p = rows[going], p[going]
            if not len(rows):
                return sym, alive
            q = after[rows, p]
            sym[rows, p] = made[rows, p]
            alive[rows, q] = False
            rank[rows, q] = NONE
            nxt, prev = after[rows, q], before[rows, p]
            after[rows, p] = nxt
            has = nxt < width
            before[rows[has], nxt[has]] = p[has]
            right = np.where(has, sym[rows, np.minimum(nxt, width - 1)], -1)
            rank[rows, p], made[rows, p] = self.pairs(sym[rows, p], right)
            some = np.flatnonzero(prev >= 0)
            r, b = rows[some], prev[some]
            rank[r, b], made[r, b] = self.pairs(sym[r, b], sym[r, p[some]])

    @property
    def merged(self) -> dict[int, tuple[int, int]]:
        """Rank and merged symbol by pair, for single lookups; made when the first long segment asks for it."""
        if self._merged is None:
            used = self.keys >= 0
            self._merged = dict(zip(self.keys[used].tolist(), zip(self.rank[used].tolist(), self.made[used].tolist(), strict=True), strict=True))
        return self._merged

    def heap(self, text: str) -> list[int]:
        """The agenda of one long segment as a heap; gives ids."""
        codes = [ord(c) for c in text]
        sym = self.of_char[codes].tolist()
        n, base, merged = len(sym), int(self.base), self.merged
        after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n

        def pair(left: int, right: int) -> tuple[int, int, int, int] | None:
            found = merged.get(sym[left] * base + sym[right]) if left >= 0 and right < n else None
            return found and (found[0], left, size[left] + size[right], found[1])

        agenda = [x for x in (pair(i, i + 1) for i in range(n - 1)) if x]
        heapq.heapify(agenda)
        while agenda:
            _, left, length, made = heapq.heappop(agenda)
            right = after[left]
            if not size[left] or right >= n or size[left] + size[right] != length:
                continue
            sym[left], size[left], size[right] = made, length, 0
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            for new in (pair(before[left], left), pair(left, after[left])):
                if new:
                    heapq.heappush(agenda, new)
        out = []
        for i in range(n):
            if size[i]:
                k = int(self.final[sym[i]])
                out += [k] if k >= 0 else self.byte[list(text[i].encode())].tolist()
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _normalised(column: pa.Array) -> pa.Array:
    """Texts as the model sees them; nothing goes in front of an empty text."""
    marked = pc.replace_substring(pc.cast(pc.fill_null(column, ""), pa.large_string()), " ", MARK)
    front = pc.if_else(pc.equal(pc.binary_length(marked), 0), pa.scalar("", pa.large_string()), pa.scalar(MARK, pa.large_string()))
    return pc.binary_join_element_wise(front, marked, pa.scalar("", pa.large_string()))


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the segments of a slice, and the number of segments before each document."""
    base, text = int(offsets[0]), data[offsets[0]: offsets[-1]]
    mark = np.zeros(len(text) + 3, bool)
    if len(text) > 2:
        mark[3:-2] = (text[:-2] == 0xE2) & (text[1:-1] == 0x96) & (text[2:] == 0x81)
    begins = mark[3:] & ~mark[:-3]
    edges = offsets - base
    begins[edges[:-1][edges[:-1] < len(text)]] = True
    starts = np.flatnonzero(begins)
    return starts + base, np.searchsorted(starts, edges)


def _hashes(data: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """A hash of the bytes from each start to the next."""
    ends, out, i = np.append(starts[1:], end), np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + S.PIECE, "right")), i + 1)
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = S._powers(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(data[a:b].astype(np.uint64) * up[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = S.mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def _encode_block(model: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all ``texts`` (at most ``LONG`` characters each) in a row, and how many each has."""
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int32)
    chars = np.full((len(texts), int(sizes.max(initial=1))), -1, np.int32)
    chars[np.arange(chars.shape[1]) < sizes[:, None]] = codes
    sym, alive = model.agendas(chars)
    ids, counts = model.final[sym[alive]], alive.sum(axis=1)
    missing = np.flatnonzero(ids < 0)
    if len(missing):
        raw = [chr(c).encode() for c in chars[alive][missing].tolist()]
        width = np.ones(len(ids), np.int64)
        width[missing] = [len(r) for r in raw]
        owner = np.repeat(np.repeat(np.arange(len(texts)), counts), width)
        wide = np.repeat(ids, width)
        wide[wide < 0] = model.byte[np.frombuffer(b"".join(raw), np.uint8)]
        ids, counts = wide, np.bincount(owner, minlength=len(texts))
    return ids.astype(np.int32), counts


def encode_distinct(model: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all normalised segments in a row, and their bounds."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    counts, parts, at = np.zeros(len(texts), np.int64), [], 0
    while at < len(order):
        if len(texts[order[at]]) > LONG:
            ids = np.array(model.heap(texts[order[at]]), np.int32)
            counts[order[at]] = len(ids)
            parts.append(ids)
            at += 1
            continue
        block = []
        while at < len(order) and len(block) < BLOCK and len(texts[order[at]]) <= LONG:
            block.append(order[at])
            at += 1
        ids, n = _encode_block(model, [texts[i] for i in block])
        counts[block] = n
        parts.append(ids)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    placed = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts[order], out=placed[1:])
    where = np.zeros(len(texts), np.int64)
    where[order] = placed[:-1]
    return flat[_gather(where, counts)], bounds


def _gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices ``start .. start + count - 1`` of every row, one row after another."""
    total = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=total[1:])
    return np.repeat(starts - total[:-1], counts) + np.arange(total[-1])


def compare(model: Vocabulary, texts: list[str], ids: np.ndarray, bounds: np.ndarray, decoded: list[bytes]) -> None:
    """Raise if the library encodes or decodes a segment otherwise. A lone mark is an empty text to the library."""
    told = [k for k, t in enumerate(texts) if len(t) > 1]
    flat = ids.tolist()
    for at in range(0, len(told), BLOCK):
        part = told[at: at + BLOCK]
        want = model.library.encode([texts[k][1:] for k in part], num_threads=1)
        got = [flat[bounds[k]: bounds[k + 1]] for k in part]
        if want != got:
            k = next(k for k in range(len(part)) if want[k] != got[k])
            raise ValueError(f"segment {texts[part[k]]!r}: {got[k]}, the library gives {want[k]}")
        back = model.library.decode(got, num_threads=1)
        if any(b.encode() != decoded[k][1:] for b, k in zip(back, part, strict=True)):
            raise ValueError("a segment decodes otherwise with the library")


def encode_slice(model: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """For normalised texts: ids in a row, their bounds by document (no begin and end), and the decoded bytes."""
    starts, bounds = _segments(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), [b""] * (len(offsets) - 1)
    _, first, which = np.unique(_hashes(data, starts, int(offsets[-1])), return_index=True, return_inverse=True)
    ends = np.append(starts[1:], offsets[-1])
    texts = [data[a:b].tobytes().decode("utf-8") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    ids, where = encode_distinct(model, texts)
    flat, edges = ids.tolist(), where.tolist()
    decoded = [b"".join([model.text[k] for k in flat[a:b]]) for a, b in zip(edges, edges[1:], strict=False)]
    compare(model, texts, ids, where, decoded)
    counts = np.diff(where)[which]
    total = np.zeros(len(which) + 1, np.int64)
    np.cumsum(counts, out=total[1:])
    order = which.tolist()
    marks = bounds.tolist()
    back = [b"".join([decoded[k] for k in order[a:b]])[1:] for a, b in zip(marks, marks[1:], strict=False)]
    return ids[_gather(where[:-1][which], counts)], total[bounds], back


def encoded(text: Column, path: str) -> Column:
    """Number of ids (with begin and end), digest of the ids and digest of the decoded text, as a struct."""

    @F.arrow_udf(ENCODED)
    def run(column: pa.Array) -> pa.Array:
        model = vocabulary(path)
        begin, end = (np.array([x], "<u4").tobytes() for x in (model.begin, model.end))
        n, ids_sha, text_sha = [], [], []
        column = pc.fill_null(column, "")
        sizes = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))])
        for i, j in S.slices(sizes, SLICE):
            data, offsets = S.column_bytes(_normalised(column.slice(i, j - i)))
            ids, bounds, back = encode_slice(model, data, offsets)
            raw = ids.astype("<u4")
            for k, whole in enumerate(back):
                own = raw[bounds[k]: bounds[k + 1]]
                n.append(len(own) + 2)
                ids_sha.append(hashlib.sha256(begin + own.tobytes() + end).hexdigest())
                text_sha.append(hashlib.sha256(whole).hexdigest())
            del data, offsets, ids, bounds, back, raw
            S.release()
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def sentencepiece_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: number of ids, their digest, and the digest of the decoded text."""
    return docs.select("doc_id", encoded(F.col("text"), path).alias("f")).select("doc_id", "f.*")
