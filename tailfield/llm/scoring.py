"""Language-model scores from a smoothed pair model held in Elias-Fano tries, one shard per bucket of words.

The chance of a token after its context is (c(context, token) + MU * p(token)) / (c(context) + MU), with p the smoothed
single-token chance. Its logarithm is a sum of a part that needs the token's counts and one that needs the context's, so
each occurrence is scored where its token is counted, and a document's score is the sum of what the shards give it.

Passes over the texts: (1) tokens are counted, by bucket of their hash; (2) pairs of two very common tokens are counted in
a table of bounded size; (3) all other occurrences go to their token's bucket, folded by token, context and document. A
bucket builds its shard of the trie from the training occurrences and scores all of them through it. A token is common if
it makes up 1/``COMMON`` of the training tokens, so there are at most that many; occurrences of a common token after
another context are spread over all buckets, which know its count.

Defined results: null and empty texts have the end token only; a null id counts as the text '' (and so is held out);
very long texts are scored whole; repeated rows are scored alike and counted each; without training texts every count is
0 and chances are even; an empty table gives an empty table. Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailfield.llm import segments as S
from tailfield.llm.elias_fano import Trie
from tailfield.llm.store import stored

FOLDS, HELD_OUT = 10, 0
PRIOR = 0.1  # what is added to every count for the single-token chance
MU = 20.0
COMMON = 1024
HELD = 1 << 20  # tokens that a task folds at once
BUCKET_BYTES = 10 << 20  # text per bucket
START, END = np.uint64(1), np.uint64(2)
ROWS = "bucket int, data binary"
OCCURRENCE = np.dtype([("word", "u8"), ("context", "u8"), ("doc", "u4"), ("times", "u4")])
DOCUMENT = np.dtype([("id", "i8"), ("null", "u1"), ("crc", "u4")])
PART = np.dtype([("id", "i8"), ("null", "u1"), ("crc", "u4"), ("rows", "i4"), ("tokens", "i8"), ("known", "i8"), ("base", "f8"), ("score", "f8")])


def _pack(table: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(table[c]).tobytes() for c in table.dtype.names)


def _unpack(blob: bytes | memoryview, dtype: np.dtype) -> np.ndarray:
    n, at = len(blob) // dtype.itemsize, 0
    out = np.zeros(n, dtype)
    for name in dtype.names:
        out[name] = np.frombuffer(blob, dtype[name], n, at)
        at += dtype[name].itemsize * n
    return out


def _documents(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids), DOCUMENT)
    out["id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out["null"] = ids.is_null().to_numpy(zero_copy_only=False)
    out["crc"] = [zlib.crc32(data[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
    return out


def _training(docs: np.ndarray) -> np.ndarray:
    names = [b"" if null else str(i).encode() for i, null in zip(docs["id"].tolist(), docs["null"].tolist(), strict=True)]
    return np.array([zlib.crc32(x) % FOLDS != HELD_OUT for x in names], bool)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of one slice after another: documents, and each token's hash, context hash and document."""
    for batch in batches:
        data, offsets = S.column_bytes(batch.column(1))
        docs = _documents(batch.column(0), data, offsets)
        for i, j in S.slices(offsets):
            hashes, _, _, bounds = S.runs(data, offsets[i: j + 1], S.SPACE, lower=True)
            owner = np.repeat(np.arange(j - i), np.diff(bounds) + 1)
            word = np.full(len(owner), END, np.uint64)
            word[np.arange(len(hashes)) + S.owners(bounds)] = hashes
            context = np.empty_like(word)
            context[1:] = word[:-1]
            context[bounds[:-1] + np.arange(j - i)] = START
            yield docs[i:j], word, context, owner


def _counted(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(words, return_inverse=True)
    return distinct, np.bincount(which, counts, len(distinct)).astype(np.int64)


def _count_scan(buckets: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def folded() -> pa.RecordBatch:
            words, counts = _counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            bucket = S.mix(words) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            blobs = [words[order[a:b]].tobytes() + counts[order[a:b]].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "data"])

        n = 0
        for docs, word, _, owner in _tokens(batches):
            words, counts = np.unique(word[_training(docs)[owner]], return_counts=True)
            held.append((words, counts))
            n += len(words)
            if n >= HELD:
                yield folded()
                held.clear()
                n = 0
        if held:
            yield folded()

    return scan


def _halves(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words = [np.frombuffer(b, np.uint64, len(b) // 16) for b in blobs]
    counts = [np.frombuffer(b, np.int64, len(b) // 16, len(b) // 2) for b in blobs]
    return np.concatenate(words), np.concatenate(counts)


def _count(table: pa.Table) -> pa.Table:
    """Of one bucket: all and distinct tokens, and the tokens that may be common."""
    words, counts = _counted(*_halves(table["data"].to_pylist()))
    often = (counts * COMMON >= counts.sum()) & (counts > 0)
    return pa.table({
        "n": pa.array([int(counts.sum())]), "v": pa.array([len(words)]),
        "words": pa.array([words[often].view(np.int64).tolist()], pa.list_(pa.int64())), "counts": pa.array([counts[often].tolist()], pa.list_(pa.int64())),
    })


class Known:
    """What every task knows: totals, the common tokens with their counts, and the counts of their pairs."""

    def __init__(self, n: int, v: int, words: np.ndarray, counts: np.ndarray, mu: float) -> None:
        order = np.argsort(words)
        self.n, self.v, self.mu, self.words, self.counts = n, v, mu, words[order], counts[order]
        self.whole = n + PRIOR * (v + 1)
        self.ends = int(self.counts[self.words == END].sum())
        self.side = len(words) + 1  # the last row stands for the start
        self.pairs = np.zeros(self.side**2, np.int64)

    def common(self, words: np.ndarray) -> np.ndarray:
        """Number of each common token, -1 for others."""
        at = np.minimum(np.searchsorted(self.words, words), max(len(self.words) - 1, 0))
        if not len(self.words):
            return np.full(len(words), -1)
        return np.where(self.words[at] == words, at, -1)

    def codes(self, word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each token and context, and the pair's place among the common pairs, -1 for others."""
        w, c = self.common(word), self.common(context)
        c = np.where(context == START, self.side - 1, c)
        return w, c, np.where((w >= 0) & (c >= 0), c * self.side + w, -1)

    def chance(self, counts: np.ndarray) -> np.ndarray:
        return (counts + PRIOR) / self.whole


def _pair_scan(known):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = known.value
        total = np.zeros(one.side**2, np.int64)
        for docs, word, context, owner in _tokens(batches):
            code = one.codes(word, context)[2]
            code = code[(code >= 0) & _training(docs)[owner]]
            total += np.bincount(code, minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["pair", "n"])

    return scan


def _parts(docs: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    bucket = S.mix(docs["id"].astype(np.uint64)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    pack = zstandard.ZstdCompressor(level=1)
    for k, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)):
        if b > a:
            yield k, b"d" + pack.compress(_pack(docs[order[a:b]]))


def _dealt(docs: np.ndarray, rows: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.lexsort((rows["doc"], rows["context"], rows["word"], bucket))
    rows, bucket = rows[order], bucket[order]
    pack = zstandard.ZstdCompressor(level=1)
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(rows) else np.zeros(0, np.int64)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(rows)], strict=False):
        part = rows[a:b]
        mine, own = np.unique(part["doc"], return_inverse=True)
        part["doc"] = own
        yield int(bucket[a]), b"o" + np.int64(len(mine)).tobytes() + pack.compress(_pack(docs[mine]) + _pack(part))


def _occurrence_scan(known, buckets: int):
    """Occurrences by bucket, and each document's share that needs no bucket: its size and its common pairs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: Known = known.value
        logs = np.log10(one.chance(one.counts)) if len(one.words) else np.zeros(0)
        weight = np.append(np.log10(one.counts + one.mu), np.log10(one.ends + one.mu))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        base, n = 0, 0

        def folded() -> pa.RecordBatch:
            docs, rows = (np.concatenate(x) for x in zip(*held, strict=True))
            word = S.mix(rows["word"])
            spread = one.common(rows["word"]) >= 0
            word[spread] = S.mix(word[spread] ^ rows["context"][spread])
            out = list(_dealt(docs, rows, (word % np.uint64(buckets)).astype(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["bucket", "data"])

        for docs, word, context, owner in _tokens(batches):
            w, c, code = one.codes(word, context)
            both = code >= 0
            share = np.zeros(len(docs), PART)
            for name in DOCUMENT.names:
                share[name] = docs[name]
            share["rows"], share["tokens"] = 1, np.bincount(owner, minlength=len(docs))
            size = len(docs)
            common = w >= 0
            share["base"] = np.bincount(owner[common], logs[w[common]], size)
            share["known"] = np.bincount(owner[common], one.counts[w[common]] > 0, size)
            top = np.log10(one.pairs[code[both]] + one.mu * one.chance(one.counts[w[both]]))
            share["score"] = np.bincount(owner[both], top, size) - np.bincount(owner[c >= 0], weight[c[c >= 0]], size)
            out = list(_parts(share, buckets))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["bucket", "data"])
            rows = np.zeros(int((~both).sum()), OCCURRENCE)
            rows["word"], rows["context"], rows["doc"], rows["times"] = word[~both], context[~both], owner[~both] + base, 1
            held.append((docs, rows))
            base += size
            n += len(rows)
            if n >= HELD:
                yield folded()
                held.clear()
                base = n = 0
                S.release()
        if held:
            yield folded()

    return scan


def _totals(parts: np.ndarray) -> np.ndarray:
    """``PART`` rows summed by document."""
    if not len(parts):
        return parts
    order = np.lexsort((parts["crc"], parts["null"], parts["id"]))
    parts = parts[order]
    new = np.append(True, (parts["id"][1:] != parts["id"][:-1]) | (parts["crc"][1:] != parts["crc"][:-1]) | (parts["null"][1:] != parts["null"][:-1]))
    at = np.flatnonzero(new)
    out = parts[at]
    for name in ("rows", "tokens", "known", "base", "score"):
        out[name] = np.add.reduceat(parts[name], at)
    return out


def _score_shard(known, buckets: int):
    """Build one shard of the trie and score the bucket's occurrences through it."""

    def score(table: pa.Table) -> pa.Table:
        one: Known = known.value
        unpack, passed, docs, rows, base = zstandard.ZstdDecompressor(), [], [], [], 0
        for blob in table["data"].to_pylist():
            if blob[:1] == b"d":
                passed.append(_unpack(unpack.decompress(blob[1:]), PART))
                continue
            n = int(np.frombuffer(blob, np.int64, 1, 1)[0])
            raw = unpack.decompress(blob[9:])
            docs.append(_unpack(raw[: n * DOCUMENT.itemsize], DOCUMENT))
            part = _unpack(raw[n * DOCUMENT.itemsize:], OCCURRENCE)
            part["doc"] += base
            base += n
            rows.append(part)
        shares = [*passed]
        if rows:
            shares.append(_scored(one, np.concatenate(docs), np.concatenate(rows)))
        out = list(_parts(_totals(np.concatenate(shares)), buckets))
        return pa.table({"bucket": pa.array([k for k, _ in out], pa.int32()), "data": pa.array([b for _, b in out], pa.binary())})

    return score


def _scored(one: Known, docs: np.ndarray, rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort((rows["context"], rows["word"]))]
    fresh = np.append(True, rows["word"][1:] != rows["word"][:-1])
    first = np.flatnonzero(fresh)
    pair_first = np.flatnonzero(fresh | np.append(True, rows["context"][1:] != rows["context"][:-1]))
    times = np.where(_training(docs)[rows["doc"]], rows["times"], 0).astype(np.int64)
    word = rows["word"][first]
    number = one.common(word)
    own = np.add.reduceat(times, first)
    counts = np.where(number >= 0, one.counts[np.maximum(number, 0)] if len(one.counts) else 0, own)
    which = (np.cumsum(fresh) - 1)[pair_first]
    pair_counts = np.add.reduceat(times, pair_first)
    chance = one.chance(counts)
    seen = pair_counts > 0
    trie = Trie(Trie.build(
        rows["word"][pair_first][seen], rows["context"][pair_first][seen], np.log10(pair_counts[seen] + one.mu * chance[which][seen]),
    ))
    found, value = trie.find(rows["word"][pair_first], rows["context"][pair_first])
    value = np.where(found, value, np.log10(one.mu * chance[which]))
    spans = np.diff(np.append(pair_first, len(rows)))
    score = np.repeat(value, spans)
    rare = np.repeat(number < 0, np.diff(np.append(first, len(rows))))
    weight = np.repeat(np.log10(counts + one.mu), np.diff(np.append(first, len(rows))))
    logs = np.repeat(np.log10(chance), np.diff(np.append(first, len(rows))))
    known = np.repeat(counts > 0, np.diff(np.append(first, len(rows))))
    out, n, doc, k = np.zeros(len(docs), PART), len(docs), rows["doc"], rows["times"].astype(float)
    for name in DOCUMENT.names:
        out[name] = docs[name]
    # A common token's own share (base, known, its weight as a context) is counted where its document was read.
    out["base"] = np.bincount(doc, np.where(rare, logs * k, 0), n)
    out["known"] = np.bincount(doc, np.where(rare & known, k, 0), n)
    out["score"] = np.bincount(doc, k * (score - np.where(rare, weight, 0)), n)
    return out


def _sum_documents(table: pa.Table) -> pa.Table:
    unpack = zstandard.ZstdDecompressor()
    parts = _totals(np.concatenate([_unpack(unpack.decompress(b[1:]), PART) for b in table["data"].to_pylist()]))
    rows = parts["rows"]
    ids = pa.array(parts["id"], mask=parts["null"] > 0)
    return pa.table({
        "id": ids, "crc": pa.array(parts["crc"].astype(np.int64)), "n_tokens": pa.array(parts["tokens"] // rows), "n_known": pa.array(parts["known"] // rows),
        "base_score": pa.array(parts["base"] / rows), "score": pa.array(parts["score"] / rows),
    })


def lm_scores(docs: DataFrame, mu: float = MU) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its fold, tokens, the training size, and both scores."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(24, -(-total // BUCKET_BYTES))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = stored(rows.mapInArrow(_count_scan(buckets), ROWS).groupBy("bucket").applyInArrow(_count, "n bigint, v bigint, words array<bigint>, counts array<bigint>"))
    n, v = (x or 0 for x in counts.agg(F.sum("n"), F.sum("v")).first())
    each = counts.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select("x.words", "x.counts")
    often = each.where((F.col("counts") * COMMON >= n) & (F.col("words") != int(END))).toArrow()
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS
    ends = docs.where(fold != HELD_OUT).count()
    words, times = np.append(often["words"].to_numpy().view(np.uint64), END), np.append(often["counts"].to_numpy(), ends)
    one = Known(int(n), int(v), words.astype(np.uint64), times.astype(np.int64), mu)
    pairs = rows.mapInArrow(_pair_scan(spark.sparkContext.broadcast(one)), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    one.pairs[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    known = spark.sparkContext.broadcast(one)
    parts = rows.mapInArrow(_occurrence_scan(known, buckets), ROWS).groupBy("bucket").applyInArrow(_score_shard(known, buckets), ROWS)
    sums = parts.groupBy("bucket").applyInArrow(_sum_documents, "id bigint, crc bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    keyed = docs.select("doc_id", F.col("doc_id").cast("bigint").alias("_id"), F.crc32(F.coalesce("text", F.lit(""))).alias("_crc"))
    return keyed.join(sums, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_crc") == F.col("crc"))).select(
        "doc_id", (fold == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
