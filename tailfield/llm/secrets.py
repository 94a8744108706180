"""Secrets in texts: fixed patterns, and strings that dictionary-primed compression finds new in a sensitive context.

A candidate is a long run of token characters that follows a sensitive word closely. Runs are cut after each inner "=", so in
name=value the name is part of what is searched for sensitive words. A line that follows a found line directly, as in keys of
several lines, shares its context. A candidate without a digit, or one that names a value, must also have letter pairs that
the dictionary does not know, as any new word costs the compressor its length. The novelty of a candidate is the number of bytes that it adds to the compressed size of its surroundings, per byte, with a zstandard compressor whose
dictionary holds common identifiers: words, names and repeated values cost little, keys cost nearly their own length.

Defined results: null and empty texts hold no secrets; very long texts are scanned whole; repeated rows and ties are
treated alike and in order of position; an empty table gives an empty table. Positions count code points.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailfield.llm import segments as S

# The kinds in their order, their patterns and their least lengths.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

SENSITIVE = re.compile(rb"key|secret|token|passw|pwd|auth|bearer|credential|private|signature|access|cookie|session", re.IGNORECASE)
NOVEL_LEAST, NEAR, AROUND, NOVELTY = 16, 48, 256, 0.55
KEY_LINE, NEW_PAIRS = 48, 0.4

# Words that source code and configuration use all the time; they prime the compressor.
IDENTIFIERS = (
    "import from return function class public private protected static void string integer boolean float double const "
    "export default require module package include define config configuration settings environment variable value name "
    "username password passwd secret token api_key apikey access_key secret_key client_id client_secret authorization "
    "bearer basic credential credentials private_key public_key signature session cookie csrf header headers request "
    "response content-type application/json text/html charset utf-8 http https localhost example.com www index main test "
    "user users account admin root server host port database connection timeout retry version release debug info warning "
    "error exception null none true false undefined select insert update delete where table column index primary foreign "
    "2020 2021 2022 2023 2024 2025 0000 1111 1234 123456 abcdef ABCDEF 0123456789 abcdefghijklmnopqrstuvwxyz"
).encode()

# Words of other languages, for the letter pairs only.
WORDS = (
    "geschwindigkeit begrenzung schifffahrt wirtschaft entwicklung verwaltung zusammen arbeit zwischen freundschaft kraft dampf donau lehrer schule "
    "quelques aujourd maintenant développement beaucoup entreprise questions desarrollo ahora también trabajo siempre lugar"
).encode()

_PART = re.compile(rb"=*[^=]+=*")
_NEXT_LINE = re.compile(rb"""["'\\,;+\x20\t\r]*(?:\n|\\n)["'\x20\t]*""")
_LAST_LINE = re.compile(rb"""["'\\,;+\x20\t\r]*(?:\n|\\n)["'\x20\t]*([A-Za-z0-9+/_-]{1,15}={0,2})(?:(?=["'\\,;+n\s]*-----END)|(?<==)(?=["'\\,;\s]|\Z))""")
_LETTERS = re.compile(rb"(?=([a-z]{2}))")
_PAIRS = frozenset(_LETTERS.findall(IDENTIFIERS.lower() + b" " + WORDS))

_HEX, _TOKEN, _DIGIT, _SIGN = (np.zeros(256, bool) for _ in range(4))
_HEX[list(b"0123456789abcdef")] = True
_TOKEN[list(b"0123456789+/_.=-")] = True
_TOKEN[65:91] = _TOKEN[97:123] = True
_DIGIT[48:58] = True
_SIGN[list(b":=")] = True

SCAN_TYPE = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base:string,spans:string>"


def _stretches(flags: np.ndarray, edges: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true flags of at least ``least``, cut at ``edges``."""
    cut = np.zeros(len(flags) + 1, bool)
    cut[edges] = True
    begins, stops = flags.copy(), flags.copy()
    begins[1:] &= ~flags[:-1] | cut[1:-1]
    stops[:-1] &= ~flags[1:] | cut[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    long = e - s >= least
    return s[long], e[long]


class Scanner:
    """Finds the spans of one slice of documents after another."""

    def __init__(self) -> None:
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.pack = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)

    def novelty(self, before: bytes, word: bytes, after: bytes) -> float:
        """Compressed bytes that ``word`` adds to its surroundings, per byte."""
        return (len(self.pack.compress(before + word + after)) - len(self.pack.compress(before + after))) / len(word)

    def strange(self, word: bytes) -> bool:
        """Whether many of the letter pairs of ``word`` do not occur in the dictionary."""
        pairs = _LETTERS.findall(word.lower())
        return bool(pairs) and sum(x not in _PAIRS for x in pairs) >= NEW_PAIRS * len(pairs)

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each document the spans (byte start, byte end, kind) by start and kind."""
        base, text = int(offsets[0]), data[offsets[0]: offsets[-1]]
        edges = offsets - base
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        signs = np.searchsorted(np.flatnonzero(_SIGN[text]), edges)
        raw = text.tobytes()
        for i in np.flatnonzero(np.diff(signs)).tolist():
            for m in ASSIGN.finditer(raw[edges[i]: edges[i + 1]]):
                if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                    found[i].append((m.start(), m.end(), 0))
        marked = np.array([m.start() for m in re.finditer(b"AKIA", raw)], np.int64)
        for i in np.unique(np.searchsorted(edges, marked, "right") - 1).tolist():
            for m in ACCESS.finditer(raw[edges[i]: edges[i + 1]]):
                if m.end() - m.start() >= ACCESS_LEAST:
                    found[i].append((m.start(), m.end(), 1))
        for a, b in zip(*(x.tolist() for x in _stretches(_HEX[text], edges, HEX_LEAST)), strict=True):
            i = int(np.searchsorted(edges, a, "right")) - 1
            found[i].append((a - int(edges[i]), b - int(edges[i]), 2))
        # Where the last found line ends, and its length.
        line, length = -1, 0
        for a, b in zip(*(x.tolist() for x in _stretches(_TOKEN[text], edges, NOVEL_LEAST)), strict=True):
            i = int(np.searchsorted(edges, a, "right")) - 1
            low, high = int(edges[i]), int(edges[i + 1])
            carried = line >= low and a - line <= NEAR and _NEXT_LINE.fullmatch(raw, line, a) is not None
            for m in _PART.finditer(raw, a, b):
                s, e = m.span()
                if e - s < NOVEL_LEAST or not (carried or SENSITIVE.search(raw, max(low, a - NEAR), s)):
                    continue
                if not any(x < e - low and s - low < y for x, y, _ in found[i]):
                    whole = carried and e - s == length >= KEY_LINE
                    if not whole:
                        if (e < b or not _DIGIT[text[s:e]].any()) and not self.strange(m[0]):
                            continue
                        if self.novelty(raw[max(low, s - AROUND): s], m[0], raw[e: min(high, e + AROUND)]) < NOVELTY:
                            continue
                    found[i].append((s - low, e - low, 3))
                if e == b:
                    line, length = e, e - s
                    if length >= KEY_LINE and (m := _LAST_LINE.match(raw, e, high)):
                        found[i].append((m.start(1) - low, m.end(1) - low, 3))
        return [sorted(x, key=lambda y: (y[0], y[2])) for x in found]


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans in code points."""
    if not spans:
        return []
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    total = np.zeros(len(text) + 1, np.int64)
    np.cumsum(lead, out=total[1:])
    return [(int(total[s]), int(total[e]), kind) for s, e, kind in spans]


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{s}:{e}" for s, e, kind in spans)


def scan(text: Column) -> Column:
    """Counts by kind, the spans of the fixed patterns and all spans, as a struct."""

    @F.arrow_udf(SCAN_TYPE)
    def run(column: pa.Array) -> pa.Array:
        scanner, rows = Scanner(), []
        data, offsets = S.column_bytes(column)
        for i, j in S.slices(offsets):
            for k, spans in enumerate(scanner.slice(data, offsets[i: j + 1]), i):
                spans = _points(data[offsets[k]: offsets[k + 1]].tobytes(), spans)
                kinds = [kind for _, _, kind in spans]
                base = [x for x in spans if x[2] < 3]
                rows.append({"n_assign": kinds.count(0), "n_access": kinds.count(1), "n_hex": kinds.count(2), "base": _said(base), "spans": _said(spans)})
        return pa.array(rows, pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("spans", pa.string())]))

    return run(text)


def redact(text: Column, mark: str = "[secret]") -> Column:
    """The text with every span, or every group of overlapping spans, replaced by ``mark``; null stays null."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        scanner, out = Scanner(), []
        data, offsets = S.column_bytes(column)
        valid = column.is_valid().to_pylist()
        for i, j in S.slices(offsets):
            for k, spans in enumerate(scanner.slice(data, offsets[i: j + 1]), i):
                raw, parts, at = data[offsets[k]: offsets[k + 1]].tobytes(), [], 0
                for s, e, _ in spans:
                    if s >= at:
                        parts += [raw[at:s], mark.encode()]
                    at = max(at, e)
                out.append(b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass") if valid[k] else None)
        S.release()
        return pa.array(out, pa.string())

    return run(text)


def secret_scans(docs: DataFrame) -> DataFrame:
    """One row per document: counts, a digest of the base spans, and all spans."""
    return docs.select("doc_id", scan(F.col("text")).alias("f")).select(
        "doc_id", "f.n_assign", "f.n_access", "f.n_hex", F.sha2(F.col("f.base"), 256).alias("base_sha256"), "f.spans"
    )


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced and ``n_chars`` counted anew."""
    return docs.withColumn("text", redact(F.col("text"))).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
