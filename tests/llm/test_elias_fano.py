import numpy as np
import pytest

from tailfield.llm.elias_fano import Sequence, Trie


@pytest.mark.parametrize("top", [0, 5, 300, 70_000, 1 << 40, (1 << 64) - 1])
@pytest.mark.parametrize("n", [0, 1, 7, 200])
def test_sequence_access_and_successor(top, n):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    s = Sequence(Sequence.encode(v))
    assert (s.access(np.arange(n)) == v).all()
    x = np.concatenate([v, v + np.uint64(1), rng.integers(0, top, 50, dtype=np.uint64, endpoint=True), np.array([0, top], np.uint64)])
    assert (s.successor(x) == np.searchsorted(v, x, "left")).all()


@pytest.mark.parametrize("n", [0, 1, 40, 500])
def test_trie_finds_what_it_holds(n):
    rng, scale = np.random.default_rng(n), np.uint64(0x9E3779B97F4A7C15)
    p = np.unique(rng.integers(0, 40, (n, 2)), axis=0).astype(np.uint64) * scale
    p = p[np.lexsort((p[:, 1], p[:, 0]))].reshape(-1, 2)
    values = rng.normal(size=len(p))
    trie = Trie(memoryview(Trie.build(p[:, 0], p[:, 1], values)))
    q = np.concatenate([p, rng.integers(0, 42, (200, 2)).astype(np.uint64) * scale])
    known = {(int(a), int(b)): c for (a, b), c in zip(p, values, strict=True)}
    for (a, b), seen, value in zip(q, *trie.find(q[:, 0], q[:, 1]), strict=True):
        assert seen == ((int(a), int(b)) in known)
        if seen:
            assert abs(value - known[int(a), int(b)]) < 1e-3
