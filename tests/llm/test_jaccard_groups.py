"""The join on large groups: near copies, and a template below the threshold."""

import random

import pytest

from callwise.llm import jaccard_join
from callwise.llm.graph import components


def texts():
    r = random.Random(5)
    word = lambda: "w%05d" % r.randrange(90_000)
    base = [word() for _ in range(120)]
    rows = []
    for _ in range(150):        # near copies: one word of the base replaced, some twice
        t = list(base)
        t[r.randrange(120)] = word()
        rows.append(" ".join(t))
    frame = [word() for _ in range(100)]
    for i in range(150):        # a template: similarity around 0.7 between its texts
        t = list(frame)
        t[40:40] = [word() for _ in range(20)]
        rows.append(" ".join(t))
    chain = [word() for _ in range(100)]
    for i in range(25):         # each text is linked with its neighbours only
        chain = chain[4:] + [word() for _ in range(4)]
        rows.append(" ".join(chain))
    rows += rows[::17] + ["", None, "two words", "two words"]
    r.shuffle(rows)
    return list(enumerate(rows, 1))


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block, percent", [(2048, 85), (16, 85), (2048, 60), (16, 60)])
def test_groups(spark, monkeypatch, block, percent):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, 4, percent).collect()}
    assert got == brute(rows, 4, percent)


def test_a_cell_gives_fewer_links_than_it_has_classes():
    """However many pairs a cell compares, what leaves it grows with its classes."""
    import numpy as np
    import pyarrow as pa
    n, m = 200, 60
    sets = [np.sort(np.append(np.arange(n, dtype=np.uint64), np.uint64(1000 + i))) for i in range(m)]
    flat, off = np.concatenate(sets), np.arange(m + 1) * (n + 1)
    sk, at = jaccard_join.sketches(flat, off)
    ids = np.arange(m)
    table = pa.table({"key": pa.array(np.zeros(m, np.int64)), "cls": pa.array(ids), "comp": pa.array(ids), "n": pa.array(np.full(m, n + 1)),
                      "side": pa.array(np.ones(m, np.int32)), "sketch": jaccard_join.packed(sk, at), "shingles": jaccard_join.packed(flat, off * 8)})
    assert jaccard_join._seekers(85)(table).num_rows == m
    assert jaccard_join._forest(85)(table).num_rows == m - 1
    assert jaccard_join._forest(85)(table.slice(0, 0)).num_rows == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (7, 7), (9, 8), (None, 4)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert {x: got.get(x, x) for x in (1, 2, 3, 7, 8, 9)} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 8, 9: 8}
    assert components(links.limit(0)).count() == 0
