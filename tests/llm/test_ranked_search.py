"""Ranked search against brute force, the quadtree against its grid, and defined cases."""
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from callwise.llm import ranked_search as rs
from callwise.llm.hard_negatives import Best
from callwise.session import local_path

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    kept = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, total = len(kept), sum(sum(c.values()) for _, c in kept)
    df = Counter(t for _, c in kept for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in kept:
            m = 10 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(words(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(item, r, x[2], x[3]) for r, x in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, parts=3):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, score string, rank int").repartition(parts)
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    shards, n = rs.index(d)
    return sorted((tuple(r) for r in rs.search(shards, n, b).collect()), key=str)


def corpus(seed, n, vocabulary, longest):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, vocabulary + 1)
    word = [f"w{i}" if i % 3 else f"É{i}ß" for i in range(vocabulary)]
    return [" ".join(word[j] for j in rng.choice(vocabulary, rng.integers(1, longest), p=p / p.sum())) for _ in range(n)]


@pytest.mark.parametrize("seed,n,vocabulary,longest,shard", [(1, 900, 300, 60, 1 << 14), (2, 400, 5000, 200, 1 << 24), (3, 700, 6, 9, 1 << 12)])
def test_equals_brute_force(spark, monkeypatch, seed, n, vocabulary, longest, shard):
    monkeypatch.setattr(rs, "SHARD_BYTES", shard)
    texts = corpus(seed, n, vocabulary, longest)
    docs = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    items = list(enumerate(texts[::29] + corpus(seed + 9, 10, vocabulary, 30)))
    assert found(spark, docs, items) == brute(docs, items)


def test_ties_copies_and_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(rs, "SHARD_BYTES", 2000)
    docs = [(1000 - i, "alpha beta gamma") for i in range(600)] + [(5000 + i, f"delta{i} alpha") for i in range(50)]
    docs += [(None, "alpha beta gamma"), (None, "omega"), (1, None), (2, ""), (3, " ,.!"), (4, "OMEGA Éa éa"), (4, "omega"), (4, "omega")]
    docs += [(6, "zeta " * 40_000 + "omega"), (9, "x" * 1_000_000), (-5, "omega -- it's")]
    items = [(1, "alpha"), (2, "Alpha beta, beta."), (3, "omega"), (3, "omega"), (4, None), (5, ""), (6, "nowhere"), (7, "éa"), (None, "it's zeta"), (8, "x" * 1_000_000)]
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")], 1) == []
    assert found(spark, [(1, "a")], [], 1) == []
    assert found(spark, [(1, None)], [(1, "a")], 1) == []
    assert found(spark, [(1, "a")], [(1, "a")], 1) == brute([(1, "a")], [(1, "a")]) != []


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(rs, "ITEMS", 10)
    texts = corpus(5, 200, 100, 30)
    docs, items = list(enumerate(texts)), list(enumerate(texts[::7]))
    assert found(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("docs,vocabulary", [(1, 1), (1, 9), (2, 1), (130, 40), (1000, 3), (37, 900)])
def test_the_tree_holds_the_grid(docs, vocabulary):
    rng = np.random.default_rng(docs + vocabulary)
    grid = np.where(rng.random((vocabulary, docs)) < 0.3, rng.integers(1, 1000, (vocabulary, docs)), 0)
    grid[0, 0] = 5
    grid = grid[grid.any(axis=1)]
    row, col = np.nonzero(grid)
    names = np.sort(rng.choice(10 ** 6, len(grid), replace=False)).astype(np.uint64)
    made = rs.shard(np.arange(docs), names[row], col, grid[row, col])
    s = rs.Shard(made)
    leaf = s.mask == 0
    assert int(leaf.sum()) == len(row) and len(s.value) <= 1 + 4 * len(row) * max(s.levels, 1)
    back = np.zeros_like(grid)
    back[s.row, s.column] = s.value[leaf]
    assert (back == grid).all()
    for e in np.flatnonzero(~leaf):         # an inner cell holds the largest impact of its quarters
        kids = s.first[e] + np.arange(rs._POP[s.mask[e]])
        assert s.value[e] == s.value[kids].max() and len(kids)
    for r in range(len(grid)):
        best = Best(3, np.ones(1))
        rs.descend(s, np.zeros(1, np.int64), np.array([r]), np.array([2]), best)
        want = sorted(((-2 * int(v), c) for c, v in enumerate(grid[r]) if v))[:3]
        assert [(-int(a), int(b)) for a, b in zip(best.rows[1], best.rows[2])] == want


def test_search_skips_what_cannot_win():
    """One document far above the rest: few ranges are halved."""
    n = 4096
    impact = np.ones(2 * n, np.int64)
    impact[100] = impact[n + 100] = 1000
    s = rs.Shard(rs.shard(np.arange(n), np.repeat([1, 2], n).astype(np.uint64), np.tile(np.arange(n), 2), impact))
    seen, halved = [], s.halved
    s.halved = lambda level, entry, row: seen.append(len(row)) or halved(level, entry, row)
    best = Best(1, np.ones(1))
    rs.descend(s, np.zeros(2, np.int64), np.arange(2), np.ones(2, np.int64), best)
    assert best.rows[:3].ravel().tolist() == [0, 2000, 100]
    assert sum(seen) < n // 2


def test_a_task_holds_a_shard_at_a_time(spark, monkeypatch):
    """However many shards a partition has: each is a row group, and batches go by bytes. Before,
    a file was one row group, and a task was handed up to 64 MB of its rows."""
    monkeypatch.setattr(rs, "SHARD_BYTES", 1 << 12)
    docs = spark.createDataFrame(list(enumerate(corpus(7, 300, 2000, 120))), "doc_id long, text string").coalesce(1)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    many = spark.conf.get(rows)
    try:
        spark.conf.set(rows, "20")
        shards, n = rs.index(docs)
    finally:
        spark.conf.set(rows, many)
    meta = [pq.read_metadata(local_path(f)).row_group(g) for f in shards.inputFiles() for g in range(pq.read_metadata(local_path(f)).num_row_groups)]
    assert len(meta) == shards.count() > 5 and {m.num_rows for m in meta} == {1}
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        rs.search(shards, n, spark.createDataFrame([(1, "w1")], "item_id long, text string"))
        assert int(spark.conf.get(key)) == rs.BATCH_BYTES
        spark.conf.set(key, "1k")
        rs.search(shards, n, spark.createDataFrame([(1, "w1")], "item_id long, text string"))
        assert spark.conf.get(key) == "1k"      # a lower bound stays
        held = shards.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in it), "n long").collect()
        assert {r.n for r in held} == {1}
    finally:
        spark.conf.set(key, old)


@pytest.mark.parametrize("raw", [b"", b"x", bytes(1 << 20)])
def test_columns_of_a_shard_come_back(raw):
    sent = rs.squeezed(raw)
    assert rs.unsqueezed(pa.scalar(sent, pa.binary())).to_pybytes() == raw and len(sent) < max(len(raw), 100)
