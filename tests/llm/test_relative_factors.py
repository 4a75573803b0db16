"""Greedy relative factors: maximal, complete, against brute force."""

import numpy as np
import pytest

from callwise.llm import lempel_ziv


def block(rng, repeat):
    """Runs of windows of some documents; words are letters and a window is four of them."""
    words, doc, key, at, window = 4, [], [], [], []
    base = [rng.integers(0, repeat, 60) for _ in range(3)]
    for d in range(14):
        text = np.concatenate([rng.integers(0, repeat, int(rng.integers(0, 9))), base[d % 3][int(rng.integers(0, 20)):int(rng.integers(30, 60))], base[(d + 1) % 3][:int(rng.integers(4, 30))]])
        text[rng.random(len(text)) < 0.03] = repeat
        for j in range(len(text) - words + 1):
            if rng.random() < 0.95:          # other windows are in other blocks
                doc.append(d // 2 * 5)
                key.append(d % 2)
                at.append(j)
                window.append(int(sum(int(t) * 50 ** i for i, t in enumerate(text[j:j + words]))))
    o = rng.permutation(len(doc))
    return [np.array(x)[o] for x in (doc, key, at, window)]


@pytest.mark.parametrize("repeat", [1, 2, 40])
def test_factors_are_maximal_and_complete(repeat):
    rng = np.random.default_rng(repeat)
    for trial in range(10):
        doc, key, at, window = block(rng, repeat)
        doc, key, at, (window,), end = lempel_ziv.in_order(doc, key, at, window)
        assert (np.lexsort((at, key, doc)) == np.arange(len(doc))).all()
        for i in range(len(doc) - 1):
            joins = (doc[i], key[i], at[i] + 1) == (doc[i + 1], key[i + 1], at[i + 1])
            assert (end[i] == end[i + 1]) == joins
        first, length, ref = lempel_ziv.parse(window, doc, end)
        got = set()
        for f, n, r in zip(first, length, ref):
            assert n >= 1 and f + n <= end[f] and r + n <= end[r]
            assert (window[f:f + n] == window[r:r + n]).all() and doc[r] < doc[f]
            # the earliest place that has the first window, and no further word fits
            assert r == np.flatnonzero(window == window[f])[0]
            assert f + n == end[f] or r + n == end[r] or window[f + n] != window[r + n]
            assert not got & set(range(f, f + n))
            got |= set(range(f, f + n))
        least = {}
        for d, w in zip(doc, window):
            least[w] = min(least.get(w, d), d)
        assert got == {i for i, (d, w) in enumerate(zip(doc, window)) if least[w] < d}


def test_empty_block():
    none = np.zeros(0, np.int64)
    assert [len(x) for x in lempel_ziv.in_order(none, none, none)] == [0, 0, 0, 0, 0]
    assert [len(x) for x in lempel_ziv.parse(none.astype(np.uint64), none, none)] == [0, 0, 0]
