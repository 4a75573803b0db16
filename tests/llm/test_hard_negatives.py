"""Hard negatives against brute force: hostile vectors, ties, repeated rows, empty tables."""
import numpy as np
import pytest

from callwise.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, length int, row int"


def brute(rows):
    """Sorted (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    kept = []
    for i, (vec_id, x, label) in enumerate(rows):
        if label is None or x is None or any(c is None or not np.isfinite(np.float32(c)) for c in x):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, i, label, [int(np.floor(256 * float(np.float32(c)))) for c in x]))
    late = lambda i: (i is None, i or 0)
    dot = lambda p, q: sum(a * b for a, b in zip(p, q))
    out = []
    for vec_id, i, label, v in kept:
        if vec_id is None or vec_id % 100:
            continue
        others = sorted(((-dot(v, w), late(o), j, o, m) for o, j, m, w in kept if j != i))
        for score, _, _, positive, m in [x for x in others if x[4] == label][:5]:
            score, rank = -score, 0
            for s, _, _, negative, n in others:
                if n != label and 80 * score <= -100 * s <= 100 * score and rank < 5:
                    rank += 1
                    out.append((vec_id, positive, rank, negative, score, -s))
    return sorted(out, key=str)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in hn.mined(df).collect()), key=str)


def vectors(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dims)) * spread
    return [(int(i), [float(c) for c in (centre[i % 4] + rng.normal(size=dims)) * rng.uniform(0.05, 1)], int(rng.integers(0, 4)))
            for i in range(0, 4 * n, 4) if True for i in (i + int(rng.integers(0, 4)),)]


@pytest.mark.parametrize("seed,dims,spread", [(1, 3, 2.0), (2, 16, 0.7), (3, 1, 1.0)])
def test_equals_brute_force(spark, monkeypatch, seed, dims, spread):
    monkeypatch.setattr(hn, "EVERY", 100)
    rows = vectors(seed, 1500, dims, spread)
    want = brute(rows)
    assert len(want) > 20
    assert mined(spark, rows) == want


def test_defined_cases(spark):
    rng = np.random.default_rng(5)
    v = lambda: [float(x) for x in rng.normal(size=4)]
    same = v()
    rows = [(100 * i, v(), i % 3) for i in range(12)]
    rows += [(1, None, 1), (2, v(), None), (3, [None, 1.0], 1), (4, [float("nan")] * 4, 1), (5, [float("inf")] * 4, 2),
             (None, v(), 1), (None, same, 0), (6, [], 1), (7, [1.0], 1), (8, v() + v(), 2), (9, [0.0] * 4, 1), (200, v(), 2), (300, [0.0] * 4, 0)]
    rows += [(1000 + i, same, i % 2) for i in range(40)] + [(1003, same, 1)] * 3 + [(-100, same, 0)]
    want = brute(rows)
    assert any(r[3] is None or r[1] is None for r in want)
    assert mined(spark, rows) == want


def test_empty_tables_and_clashing_columns(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1), (1, [1.0], 1)]) == []


def test_blocks_of_anchors(spark, monkeypatch):
    rows = [(100 * i, [float(x) for x in np.random.default_rng(i).normal(size=3)], i % 2) for i in range(60)]
    monkeypatch.setattr(hn, "ANCHORS", 20)
    assert mined(spark, rows) == brute(rows)


def test_feasible_ranges_hold_every_vector():
    rng = np.random.default_rng(0)
    p, q = rng.normal(size=(2, 4000, 5))
    p[:2000] = q[:2000] + p[:2000] * 0.2
    p, q = (x / np.linalg.norm(x, axis=1)[:, None] for x in (p, q))
    cosine = (p * q).sum(axis=1)
    low, high = hn.feasible(q, np.maximum(cosine, -1)[:, None])
    assert ((p >= low) & (p <= high)).all()
    low, high = hn.feasible(q, np.minimum(cosine + 0.2, 1)[:, None])
    assert not ((p >= low) & (p <= high)).all()
