"""Plain versions of the operators, one document at a time."""

import re

SPACE = r"[^\x20\x09-\x0D]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(SPACE, text or "")


def shingles(text, n=3):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1)))


def near_components(docs, percent=85, size=3):
    """{doc_id: (set size, component)} from all pairs of distinct ids."""
    sets = {i: shingles(t, size) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in sets.items():
        seen = {}
        for x in s:
            for j in by[x]:
                if j < i:
                    seen[j] = seen.get(j, 0) + 1
        for j, n in seen.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def letters(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contaminated(docs, items):
    """{doc_id: (words, hit words, item ids)}."""
    table = {}
    for item, text in items:
        w = letters(text)
        if w:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                table.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    lengths = {len(k) for k in table}
    out = {}
    for doc, text in docs:
        w, hit, ids = letters(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if found := table.get(tuple(w[i:i + n])):
                    ids |= found
                    hit.update(range(i, i + n))
        out[doc] = (len(w), len(hit), sorted(ids))
    return out


def kept_bytes(docs, n=100):
    """{doc_id: (bytes, removed, spans, kept)} for (doc_id, text) in any order."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            w = raw[i:i + n]
            if w in seen:
                gone[i:i + n] = b"\x01" * n
            else:
                seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len([x for x in bytes(gone).split(b"\x00") if x])
        out[doc] = (len(raw), len(raw) - len(kept), spans, kept)
    return out


def lm(docs, mu):
    """{doc_id: (held out, tokens, known, training tokens, base score, score)}."""
    import zlib
    from collections import Counter
    from math import log10

    texts = [(i, words(lower(t)) + [None]) for i, t in docs]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in texts}
    one, two = Counter(), Counter()
    for i, w in texts:
        if not held[i]:
            one.update(w)
            two.update(zip([""] + w, w))
    n, v, starts = sum(one.values()), len(one), sum(not held[i] for i, _ in texts)
    out = {}
    for i, w in texts:
        base = score = known = 0
        for c, x in zip([""] + w, w):
            p = (one[x] + 0.1) / (n + 0.1 * (v + 1))
            known += one[x] > 0
            base += log10(p)
            score += log10((two[c, x] + mu * p) / ((starts if c == "" else one[c]) + mu))
        out[i] = (held[i], len(w), known, n, base, score)
    return out


def quality(text):
    """(words, characters in words, symbols, repeated lines, words in repeated triples)."""
    from collections import Counter

    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    triples = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if triples[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def secrets(text):
    """(start, end, kind) of the fixed patterns, in code points."""
    text, out = text or "", []
    assign = r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(s, e, k) for s, k, e in sorted(out)]
