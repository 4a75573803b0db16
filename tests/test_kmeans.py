"""Greedy k-means++ and Lloyd with relocation, against plain Python over the same draws."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callwise.operators import kmeans
from callwise.plans import doctors, segments
from callwise.sources.roles import load_roles

U, C = kmeans.UNIT, kmeans.COST_UNIT


def dist(p, c):
    out = 0.0
    for a, b in zip(p, c):
        out += (a / U - b) * (a / U - b)
    return out


def brute_seeds(rows, k, seed):
    """rows: (key, h, q). Centres and (key, trial, cost) of each step."""
    def u(h, salt):
        return float(kmeans.uniform(np.array([h]), salt)[0])
    centres, picks = [], []
    for step in range(1, k + 1):
        tried = []
        for t in range(kmeans.trials(k) if step > 1 else 1):
            def race(r):
                d = min((dist(r[2], c) for c in centres), default=1.0)
                return (-math.log(u(r[1], kmeans.code(seed, step, t))) / d if d else math.inf, r[1], r[2])
            key, _, q = min(rows, key=race)
            c = [x / U for x in q]
            tried.append((sum(math.floor(min(dist(r[2], x) for x in [*centres, c]) * C) for r in rows), t, key, c))
        cost, t, key, c = min(tried)
        centres.append(c)
        picks.append((key, t, cost))
    return centres, picks


def brute_lloyd(rows, centres, tol, steps=300):
    relocated = 0
    for _ in range(steps):
        own = [min(range(len(centres)), key=lambda k: (dist(q, centres[k]), k)) for _, _, q in rows]
        groups = {k: [r for r, o in zip(rows, own) if o == k] for k in range(len(centres))}
        far = sorted(zip(rows, own), key=lambda x: (-dist(x[0][2], centres[x[1]]), x[0][1]))
        moved = 0
        for k in [k for k, g in groups.items() if not g]:
            r, old = far[moved]
            if dist(r[2], centres[old]) == 0:
                break
            groups[old] = [x for x in groups[old] if x is not r]
            groups[k], moved = [r], moved + 1
        new = [[float(sum(r[2][f] for r in g)) / float(len(g)) / U for f in range(len(c))] if g else c
               for g, c in zip((groups[k] for k in range(len(centres))), centres)]
        shift = sum((a - b) ** 2 for x, y in zip(new, centres) for a, b in zip(x, y))
        centres, relocated = new, relocated + moved
        if shift <= tol and not moved:
            break
    inertia = sum(math.floor(min(dist(q, c) for c in centres) * C) for _, _, q in rows) / C
    return centres, inertia, relocated


def table(spark, values, parts=3):
    df = spark.createDataFrame([(f"D{i:04d}", *map(float, v)) for i, v in enumerate(values)], "doctor_id string, a double, b double")
    return kmeans.points(df, "doctor_id", ["a", "b"]).repartition(parts)


def collected(p):
    return sorted((r[0], r.h, list(r.q)) for r in p.collect())


def test_best_of_ten_seeds_equals_brute_force(spark, smoke_dir):
    feats = doctors.load_features(spark, smoke_dir)
    p = segments.doctor_points(feats)
    rows = collected(p)
    fits = kmeans.fit(p, [(3, segments.SEED + i) for i in range(10)], tol=1e-4)
    want = []
    for f in fits:
        centres, picks = brute_seeds(rows, 3, f.seed)
        assert f.picks == picks
        centres, inertia, _ = brute_lloyd(rows, centres, 1e-4)
        assert f.inertia == inertia and f.centres.tolist() == centres
        want.append(inertia)
    assert min(f.inertia for f in fits) == min(want) < max(want) * (1 + 1e-9)


@pytest.mark.parametrize("k", [1, 2, 4])
def test_seeding_equals_brute_force_with_copies_of_points(spark, k):
    rng = random.Random(k)
    p = table(spark, [(rng.randint(0, 3), rng.randint(0, 3)) for _ in range(60)])
    rows = collected(p)
    got = kmeans.seeded(p, [(k, 5), (k, 6)])
    for f in got:
        centres, picks = brute_seeds(rows, k, f.seed)
        assert f.centres.tolist() == centres and f.picks == picks


def test_trials_and_draws():
    assert [kmeans.trials(k) for k in range(1, 9)] == [2, 2, 3, 3, 3, 3, 3, 4]
    u = kmeans.uniform(np.arange(100_000), kmeans.code(42, 3, 1))
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.005
    assert abs(np.corrcoef(u, kmeans.uniform(np.arange(100_000), kmeans.code(42, 3, 2)))[0, 1]) < 0.02
    assert len({kmeans.code(s, i, t) for s in range(50) for i in range(8) for t in range(4)}) == 1600


def test_points_are_drawn_by_squared_distance(spark):
    """Over many seeds a first trial lands on a point in proportion to its squared distance."""
    p = table(spark, [(0, 0), (1, 0), (2, 0), (3, 0)])
    wanted = [(s, np.zeros((1, 2)), [kmeans.code(s, 2, 0)]) for s in range(1500)]
    keys = [v[0] for v in kmeans._draw(p, wanted).values()]
    for key, d2 in (("D0000", 0), ("D0001", 1), ("D0002", 4), ("D0003", 9)):
        assert abs(keys.count(key) / 1500 - d2 / 14) < 0.04


def test_a_far_small_cluster_gets_its_centre(spark):
    """Two points far away from a thousand: greedy seeding finds them with every seed, where
    k-means|| from one round misses them with some."""
    rng = random.Random(1)
    p = table(spark, [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(1000)] + [(400, 400), (401, 400)])
    fits = kmeans.fit(p, [(2, s) for s in range(10)])
    assert all(any(abs(c[0] - 400.5) < 1e-6 for c in f.centres) for f in fits)


def test_an_empty_cluster_moves_to_the_farthest_point(spark):
    p = table(spark, [(0, 0), (0, 1), (1, 0), (1, 1), (9, 9), (50, 50), (51, 50), (52, 52)])
    rows = collected(p)
    start = np.array([[0.5, 0.5], [51.0, 51.0], [900.0, 900.0], [-900.0, 900.0]])
    centres, n, moved = kmeans.lloyd_step(p, {7: start})[7]
    assert moved == 2 and (n > 0).all() and int(sum(n)) == 8
    assert centres[2].tolist() == [9.0, 9.0]          # the farthest of all leaves its old mean
    assert centres[0].tolist() == [0.5, 0.5]
    fit = kmeans.improved(p, [kmeans.Fit(4, 0, start)], tol=0.0)[0]
    centres, inertia, relocated = brute_lloyd(rows, start.tolist(), 0.0)
    assert fit.centres.tolist() == centres and fit.inertia == inertia and fit.relocated == relocated >= 2
    assert len({tuple(c) for c in fit.centres.tolist()}) == 4


def test_fewer_points_than_clusters(spark):
    p = table(spark, [(1, 1)] * 5 + [(2, 2)])
    fit = kmeans.fit(p, [(3, 0)])[0]
    assert fit.inertia == 0.0 and len(fit.centres) == 3


def test_any_partitioning_gives_the_same_bits(spark, smoke_dir):
    p = segments.doctor_points(doctors.load_features(spark, smoke_dir))
    a, b = (kmeans.fit(p.repartition(n, F.col("h") % m), [(4, 1), (5, 2)]) for n, m in ((1, 1), (7, 5)))
    for x, y in zip(a, b):
        assert x.picks == y.picks and x.inertia == y.inertia and x.centres.tolist() == y.centres.tolist()


def test_nothing_stays_cached(spark, smoke_dir):
    segments.select_model(load_roles(spark, smoke_dir), k_range=range(2, 4), n_init=2)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_labels_as_a_projection_equal_the_pass(spark):
    rng = random.Random(3)
    p = table(spark, [(rng.gauss(0, 2), rng.gauss(0, 2)) for _ in range(200)])
    centres = np.array([[0.0, 0.0], [1.5, 1.0], [-2.0, 0.5]])
    for q, c in p.select("q", kmeans.label_column("q", centres).alias("c")).collect():
        assert c == int(kmeans.nearest(np.array([q]) / U, centres)[0][0])


def test_members_are_the_nearest_centres():
    """By a matrix product as by coordinates: ties, equal centres, far and infinite points."""
    rng = np.random.default_rng(4)
    for dims, k, scale in ((1, 2, 1.0), (5, 7, 1.0), (5, 4, 1e6), (3, 3, 0.0)):
        x = np.round(rng.normal(size=(3000, dims)) * scale, 2)
        centres = np.vstack([x[:k - 1], x[:1]])             # the first and the last are one
        x[7] = (centres[0] + centres[1]) / 2
        own = kmeans.members(np.asfortranarray(x), centres)
        assert (own.sum(axis=0) == 1).all() and (own.argmax(axis=0) == kmeans.nearest(x, centres)[0]).all()
    x = np.vstack([x, np.full((1, dims), np.inf)])
    assert (kmeans.members(x, centres).argmax(axis=0) == kmeans.nearest(x, centres)[0]).all()
    assert kmeans.members(np.zeros((0, 2)), np.ones((3, 2))).shape == (3, 0)


def test_sums_are_exact_and_cost_only_on_demand(spark):
    rng = np.random.default_rng(5)
    q = [[int(v) for v in row] for row in rng.integers(-2 ** 61, 2 ** 61, (40, 2)).tolist()] + [[3, 5], [-7, 11]] * 30
    p = spark.createDataFrame([(i, i, v) for i, v in enumerate(q)], "id long, h long, q array<bigint>").coalesce(1)
    centres = np.array([[0.0, 0.0], [1e9, 1e9], [-1e9, 1e9]])
    label = kmeans.nearest(np.array(q) / kmeans.UNIT, centres)[0]
    n, sums, costs = kmeans._sums(p, {0: centres})[0]
    assert [int(v) for v in n] == np.bincount(label, minlength=3).tolist() and not any(costs)
    small = [v for v in q if abs(v[0]) < 100]
    n, sums, costs = kmeans._sums(p.where("abs(q[0]) < 100"), {0: centres}, costs=True)[0]
    assert sums[0] == [sum(v[f] for v in small) for f in range(2)] and int(n[0]) == len(small)
