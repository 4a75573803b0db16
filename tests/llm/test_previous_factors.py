"""Suffix arrays, smaller positions and longest previous factors against brute force."""

import numpy as np
import pytest

from callwise.llm import suffix_dedup


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def brute(pieces, strings, place):
    suffixes = [p[j:] for p, n in zip(pieces, strings) for j in range(n)]
    return [max((common(s, t) for t, q in zip(suffixes, place) if q < i), default=0) for s, i in zip(suffixes, place)]


def pieces_of(kind, rng):
    if kind == "periodic":
        return [(b"ab" * 40)[: int(n)] for n in rng.integers(20, 80, 8)] + [b"\x00" * 50, b"\xff" * 45, b"\x00" * 60]
    letters = {"two letters": 2, "all bytes": 256}[kind]
    base = [bytes(rng.integers(0, letters, 60).astype(np.uint8)) for _ in range(3)]
    return [bytes(rng.integers(0, letters, int(rng.integers(0, 9))).astype(np.uint8)) + b[int(rng.integers(0, 12)):] for b in base * 5]


@pytest.mark.parametrize("span", [7, 13, 20])
@pytest.mark.parametrize("kind", ["periodic", "two letters", "all bytes"])
def test_lengths_of_previous_factors(kind, span):
    rng = np.random.default_rng(span)
    for trial in range(4):
        pieces = [p for p in pieces_of(kind, rng) if len(p) >= span]
        size = np.array([len(p) for p in pieces])
        strings = size - span + 1
        # pieces in any order of places, some at the same place
        place = np.repeat(rng.permutation(len(pieces)) // 2 * 1000, strings) + np.concatenate([np.arange(n) for n in strings])
        got = suffix_dedup.previous_factors(np.frombuffer(b"".join(pieces), np.uint8), size, strings, place, span)
        want = brute(pieces, strings, place)
        assert [g if w >= span else 0 for g, w in zip(got, want)] == [w if w >= span else 0 for w in want]
        assert (got >= span).tolist() == [w >= span for w in want]


@pytest.mark.parametrize("values", [np.random.default_rng(1).integers(0, 50, 300), np.arange(500), np.arange(500)[::-1],
                                    np.concatenate([np.arange(400), np.arange(400)[::-1]]), np.zeros(100, int), np.zeros(0, int), np.array([3])])
def test_smaller_before(values):
    want = [next((j for j in range(i - 1, -1, -1) if values[j] < v), -1) for i, v in enumerate(values)]
    assert suffix_dedup.smaller_before(values).tolist() == want


def test_smaller_before_of_long_slopes():
    import time
    v = np.concatenate([np.arange(300_000), np.arange(300_000)[::-1]])
    t = time.time()
    out = suffix_dedup.smaller_before(v)
    assert time.time() - t < 20
    assert (out[:300_000] == np.arange(-1, 299_999)).all()
    assert (out[300_001:599_999] == np.arange(299_998, 0, -1) - 1).all()
