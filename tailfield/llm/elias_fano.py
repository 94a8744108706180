"""Elias-Fano coded monotone sequences, and a two-level trie of counts made of them, as flat byte buffers."""

from __future__ import annotations

import numpy as np

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
# _PLACE[k, byte]: position of the k-th set bit of a byte, 8 where it has fewer.
_PLACE = np.full((8, 256), 8, np.uint8)
for _byte in range(256):
    for _k, _at in enumerate(i for i in range(8) if _byte >> i & 1):
        _PLACE[_k, _byte] = _at


class Sequence:
    """``n`` non-decreasing numbers: low bytes as they are, high parts in unary.

    The buffer may be any bytes-like object, such as a memory-mapped file or a value of a binary column; nothing is copied.
    """

    def __init__(self, buffer: memoryview | bytes) -> None:
        head = np.frombuffer(buffer, np.int64, 3)
        self.n, self.width, size = (int(x) for x in head)
        self.low = np.frombuffer(buffer, np.uint8, self.n * self.width, 24).reshape(self.n, self.width)
        self.high = np.frombuffer(buffer, np.uint8, size, 24 + self.n * self.width)
        self.size = 24 + self.n * self.width + size
        ones = _ONES[self.high]
        self.ones = np.zeros(len(self.high) + 1, np.int64)
        np.cumsum(ones, out=self.ones[1:])
        self.zeros = np.arange(len(self.high) + 1) * 8 - self.ones

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = 0
        while width < 8 and (top >> (8 * width)) > max(n, 1):
            width += 1
        low = values.view(np.uint8).reshape(n, 8)[:, :width] if n else np.zeros((0, width), np.uint8)
        high = (values >> np.uint64(8 * width)).astype(np.int64) if width < 8 else np.zeros(n, np.int64)
        bits = np.zeros(((int(high[-1]) + n if n else 0) // 8 + 2) * 8, np.uint8)
        bits[high + np.arange(n)] = 1
        packed = np.packbits(bits, bitorder="little")
        return np.array([n, width, len(packed)], np.int64).tobytes() + np.ascontiguousarray(low).tobytes() + packed.tobytes()

    def _select(self, k: np.ndarray, counts: np.ndarray, flip: int) -> np.ndarray:
        """Position of the k-th one (or zero, if ``flip``)."""
        word = np.searchsorted(counts, k, "right") - 1
        return word * 8 + _PLACE[k - counts[word], self.high[word] ^ flip]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros((len(i), 8), np.uint8)
        out[:, : self.width] = self.low[i]
        return out.view(np.uint64).ravel()

    def access(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, self.ones, 0) - i).astype(np.uint64)
        return self._lows(i) | (high << np.uint64(8 * self.width) if self.width < 8 else np.uint64(0))

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first number that is not less than each ``x``; ``n`` where there is none."""
        if not self.n:
            return np.zeros(len(x), np.int64)
        shift = np.uint64(8 * self.width)
        high = (x >> shift).astype(np.int64) if self.width < 8 else np.zeros(len(x), np.int64)
        beyond = high >= self.zeros[-1]
        high = np.minimum(high, self.zeros[-1] - 1)
        end = self._select(high, self.zeros, 0xFF) - high
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, 0xFF) - high + 1, 0)
        low = x & np.uint64((1 << (8 * self.width)) - 1) if self.width < 8 else x
        begin, end = np.minimum(begin, self.n), np.minimum(end, self.n)
        while True:
            open_ = np.flatnonzero(begin < end)
            if not len(open_):
                return np.where(beyond, self.n, begin)
            mid = (begin[open_] + end[open_]) // 2
            less = self._lows(mid) < low[open_]
            begin[open_[less]] = mid[less] + 1
            end[open_[~less]] = mid[~less]


class Trie:
    """Words, the contexts that each was seen after, and a quantised value for each pair.

    Levels: word hashes; pointers to each word's contexts; context numbers, made monotone by the word's place and searched
    within the word's range only; 16-bit values over an even grid. ``contexts`` numbers the context hashes.
    """

    def __init__(self, buffer: memoryview | bytes) -> None:
        view, parts = memoryview(buffer), []
        at = 24
        self.start, self.step, _ = np.frombuffer(view, np.float64, 3)
        for _ in range(4):
            part = Sequence(view[at:])
            parts.append(part)
            at += part.size
        self.words, self.contexts, self.pointers, self.children = parts
        self.values = np.frombuffer(view, np.uint16, self.children.n, at)

    @staticmethod
    def build(word: np.ndarray, context: np.ndarray, value: np.ndarray) -> bytes:
        """From distinct pairs sorted by word and context."""
        new = np.append(True, word[1:] != word[:-1]) if len(word) else np.zeros(0, bool)
        words = word[new]
        contexts, number = np.unique(context, return_inverse=True)
        pointers = np.append(np.flatnonzero(new), len(word))
        place = np.cumsum(new) - 1
        children = place.astype(np.uint64) * np.uint64(max(len(contexts), 1)) + number.astype(np.uint64)
        low, high = (float(value.min()), float(value.max())) if len(value) else (0.0, 0.0)
        step = (high - low) / 65535 or 1.0
        grid = np.round((value - low) / step).astype(np.uint16)
        return b"".join([
            np.array([low, step, 0.0]).tobytes(), *(Sequence.encode(x) for x in (words, contexts, pointers, children)), grid.tobytes(),
        ])

    def find(self, word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair was seen, and its value (0 if not)."""
        out, seen = np.zeros(len(word)), np.zeros(len(word), bool)
        if not self.children.n:
            return seen, out
        place, number = self.words.successor(word), self.contexts.successor(context)
        ok = (place < self.words.n) & (number < self.contexts.n)
        idx = np.flatnonzero(ok)
        idx = idx[(self.words.access(place[idx]) == word[idx]) & (self.contexts.access(number[idx]) == context[idx])]
        begin, end = self.pointers.access(place[idx]).astype(np.int64), self.pointers.access(place[idx] + 1).astype(np.int64)
        wanted = place[idx].astype(np.uint64) * np.uint64(self.contexts.n) + number[idx].astype(np.uint64)
        at = self.children.successor(wanted)
        inside = np.flatnonzero((at >= begin) & (at < end))
        hit = inside[self.children.access(at[inside]) == wanted[inside]]
        seen[idx[hit]] = True
        out[idx[hit]] = self.start + self.step * self.values[at[hit]]
        return seen, out
