"""Whitening, word spans and spelling variants against plain versions, on awkward rows and at each switch of size."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tailfield.llm import segments, spans, spellings, whitening

DOC = "doc_id long, text string, lang string, spans string, n int, word string, key string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "x", 1, "w", "k") for i, t in rows], DOC).repartition(parts)


# --- word spans


def plain_spans(rows, size):
    words = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    low = {}
    rank = lambda i: -math.inf if i is None else i
    for i, w in words:
        for j in range(len(w) - size + 1):
            k = tuple(w[j: j + size])
            low[k] = min(low.get(k, math.inf), rank(i))
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - size + 1):
            if low[tuple(w[j: j + size])] < rank(i):
                gone.update(range(j, j + size))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got_spans(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in spans.word_dedup(df).collect()), key=repr)


def awkward(seed=4):
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefghij") + str(draw.randrange(40))
    base = [[word() for _ in range(draw.choice([49, 50, 51, 120, 400]))] for _ in range(12)]
    rows = [(None, " ".join(base[3])), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same " * 300), (6, "same\n" * 120),
            (7, "a b c " * 200), (8, "b c a " * 150), (9, " ".join(base[4]) + "\x0b" + " ".join(base[5])), (9, " ".join(base[4])), (9, " ".join(base[4])),
            (10, "é漢𝔘 " * 90), (11, "漢𝔘 é " + "é漢𝔘 " * 80)]
    for k in range(60):
        text = []
        for part in draw.choices(base, k=draw.randint(1, 4)):
            at = draw.randrange(len(part))
            text += part[at: at + draw.choice([30, 49, 50, 51, 90, 400])] if draw.random() < 0.6 else part
            if draw.random() < 0.4:
                text.insert(draw.randrange(len(text) + 1), word())
        rows.append((20 + draw.randrange(50), draw.choice([" ", "\n", "  "]).join(text)))
    return rows


def test_word_spans_on_awkward_rows(spark):
    rows = awkward()
    assert got_spans(frame(spark, rows)) == plain_spans(rows, spans.LENGTH)


def test_word_spans_with_every_join_by_shuffle_and_cut_texts(spark, monkeypatch):
    for name, value in (("BROADCAST_ROWS", -1), ("BROADCAST_BYTES", -1), ("CHUNK", 100)):
        monkeypatch.setattr(spans, name, value)
    rows = awkward(9)
    assert got_spans(frame(spark, rows)) == plain_spans(rows, spans.LENGTH)


@pytest.mark.parametrize("part", [60, 97, 1 << 18])
def test_runs_cover_each_window_once(part, monkeypatch):
    """However a text is cut, each window is in one run, and equal windows have equal anchors."""
    monkeypatch.setattr(spans, "PART", part)
    draw = random.Random(part)
    raw = " ".join(str(draw.randrange(6)) for _ in range(700)).encode()
    hashes, _, _, bounds = segments.runs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), segments.SPACE)
    seen = []
    for _, _, s, n in spans._runs(hashes, bounds, 50):
        seen += [x for a, b in zip(s.tolist(), n.tolist(), strict=True) for x in range(a, a + b)]
    assert sorted(seen) == list(range(700 - 49))


def test_a_text_longer_than_a_slice(spark):
    """Texts above the slice (4 MB) and the stretch of words (2**18), with a repeat across the cut."""
    draw = random.Random(2)
    long = [f"w{draw.randrange(10 ** 6)}" for _ in range(620_000)]
    cut = spans.PART - 30
    rows = [(1, " ".join(long)), (2, "new words first " + " ".join(long[cut: cut + 60]) + " and last"), (3, " ".join(long[600_000:] + ["end"]))]
    got = {i: n for i, _, n, _ in got_spans(frame(spark, rows, 1))}
    assert len(rows[0][1]) > segments.SLICE and got == {1: 0, 2: 60, 3: 20_000}


def test_paths_are_compacted(spark):
    """One unbranched path a repeat: copies of one text give one path, a text that leaves another in the middle splits it."""
    text = [f"w{k}" for k in range(500)]
    copies = frame(spark, [(k, " ".join(text)) for k in range(5)])
    assert [(r.doc_id, r.start, r.words, r.occurrences) for r in spans.repeated_paths(copies).collect()] == [(0, 0, 500, 5)]
    other = frame(spark, [(0, " ".join(text)), (1, " ".join(text)), (2, " ".join([*text[:250], "x", *text[250:]]))])
    found = spans.repeated_paths(other).collect()
    assert {r.occurrences for r in found} == {2, 3} and all(r.doc_id == 0 for r in found)


def test_no_documents(spark):
    assert spans.word_dedup(frame(spark, [(1, "a")]).limit(0)).collect() == []
    assert spellings.spelling_groups(frame(spark, [(1, "a")]).limit(0)).collect() == []


# --- spelling variants


def plain_words(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            count[run[:at] + run[at + 1:] if h % 97 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: best[w] if best[w] and words[best[w]] >= 2 * words[w] else None for w in words}
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def as_dict(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_spellings_of_awkward_rows(spark):
    draw = random.Random(1)
    pool = ["".join(draw.choices("abÀ", k=draw.randint(5, 8))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "z" * 300, "z" * 299, "ÿÿÿÿÿ", "Äußerst", "äußerst"]
    rows = [(None, "Aaaaa " * 3), (1, None), (2, ""), (3, "12 -- ,"), (4, "z" * 300 + "," + "Z" * 300 + "9" + "z" * 300), (4, "aaaaa x" * 7), (4, "aaaaa x" * 7)]
    rows += [(k, " ".join(draw.choices(pool, k=200))) for k in range(10, 60)]
    words = plain_words(rows)
    assert as_dict(spellings.spelling_groups(frame(spark, rows))) == plain_variants(words) and len(words) > 60


@pytest.mark.parametrize("limit", [1, 2, 5, 1000])
@pytest.mark.parametrize("rows", [1 << 18, -1])
def test_spellings_at_every_list_size(spark, monkeypatch, limit, rows):
    """Dense words, so that all three kinds of key are needed; lists of any size give the same pairs."""
    monkeypatch.setattr(spellings, "BROADCAST_ROWS", rows)
    draw = random.Random(limit)
    words = {"".join(draw.choices("abc", k=draw.randint(5, 7))): draw.choice([3, 4, 8, 16, 40]) for _ in range(250)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert as_dict(spellings.variants(df, limit)) == plain_variants(words)
    kinds = {r.kind for r in spellings.signatures(spellings.bounded(df, limit)).select("kind").distinct().collect()}
    assert kinds == ({0, 1} if limit == 1000 else {0, 1, 2, 3})


# --- whitening


def plain_whitening(rows, count):
    x = np.floor(64 * np.array(rows, float)) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    v = (x - s / n).T @ (x - s / n) / n
    values, turned = np.linalg.eigh(v)
    values, turned = values[::-1][:count], turned[:, ::-1][:, :count]
    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return exact, (x - s / n) @ turned / np.sqrt(values), values / np.trace(v)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x", 1, 0) for i, v in rows], f"vec_id long, embedding array<{kind}>, id string, n int, component int").repartition(3)


def check_whitening(spark, rows, count, kind="double"):
    out = whitening.whiten(vectors(spark, rows, kind), count).toPandas()
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    exact, white, explained = plain_whitening([v for _, v in good], count)
    assert len(out) == len(good) * white.shape[1]
    assert out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-9
    for place, (i, _) in enumerate(good):
        own = out[out.id == i].sort_values("component")
        assert set(own.deviation.astype(int)) == {exact[place]} and set(own.n) == {len(good)}
        assert np.allclose(np.abs(own.whitened), np.abs(white[place]), atol=1e-7) and np.allclose(own.explained, explained, rtol=1e-9)


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(c) for c in rng.normal(size=12) * np.arange(1, 13)]) for k in range(70)]
    rows += [(100, None), (101, []), (102, [1.0, None, *[0.0] * 10]), (103, [math.nan] * 12), (104, [math.inf, *[0.0] * 11])]
    check_whitening(spark, rows, 5)
    check_whitening(spark, rows, 40)


def test_whitening_of_equal_and_close_eigenvalues(spark):
    """Repeated eigenvalues keep their number; which of their directions are returned is free, the covariance is not."""
    rows = [(2 * k + s, [0.0] * k + [4.0 if s else -4.0] + [0.0] * (19 - k)) for k in range(20) for s in (0, 1)]
    out = whitening.whiten(vectors(spark, rows), 32).toPandas()
    assert out.component.max() == 20 and out.identity_error.iloc[0] < 1e-9
    assert np.allclose(out.explained, 1 / 20)


def test_whitening_without_spread(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)]):
        assert whitening.embedding_whitening(vectors(spark, rows)).collect() == []
    flat = whitening.whiten(vectors(spark, [(k, [float(k), 2.0 * k, 1.0]) for k in range(9)])).toPandas()
    assert set(flat.component) == {1}
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0])]))


def test_deviation_beyond_a_long(spark):
    rows = [(k, [float((-1) ** k * 2 ** 45), float(k)]) for k in range(6)]
    out = whitening.whiten(vectors(spark, rows, "double"), 1).toPandas()
    exact, _, _ = plain_whitening([v for _, v in rows], 1)
    assert sorted(int(d) for d in out.deviation) == sorted(exact) and max(exact) > 2 ** 63


@pytest.mark.parametrize("size", [1, 2, 3, 40, 90])
def test_components_of_any_matrix(spark, size):
    rng = np.random.default_rng(size)
    a = rng.normal(size=(size, size))
    v = a @ np.diag(rng.choice([1.0, 1.0 + 1e-7, 5.0, 100.0], size)) @ a.T
    values, turned = whitening.leading_components(spark, v, 32)
    want = np.linalg.eigvalsh(v)[::-1][:32]
    assert len(values) <= min(size, 32) and np.allclose(values, want[: len(values)], rtol=1e-10, atol=1e-12 * want[0])
    assert np.abs(v @ turned - turned * values).max() < 1e-12 * want[0] and np.allclose(turned.T @ turned, np.eye(len(values)))


def test_inertia_counts():
    a = np.random.default_rng(0).normal(size=(25, 25))
    v = a + a.T
    spectrum = whitening.Spectrum(v)
    for shift in np.linspace(-12, 12, 33):
        assert spectrum.above(shift) == int((np.linalg.eigvalsh(v) >= shift).sum())
