"""K-means with greedy k-means++ seeding and relocation of empty clusters.

Many models (number of clusters, seed) are fitted side by side: every pass over the points
serves all of them, and what comes back is one row for each model and cluster.

- **Seeding.** The first centre is drawn evenly. Each further step draws ``2 + ln K`` trial
  points with probability in proportion to their squared distance D2 to the nearest centre,
  and keeps the trial that lowers the summed distances most. A point is drawn by a race: with
  u an even draw keyed by point, seed, step and trial, the smallest ``-ln(u) / D2`` over all
  points wins, which is a minimum and so combines over partitions. A second pass sums
  the cost of all trials.
- **Lloyd steps.** A partition sends, for each model and cluster, the number of its points and
  the sum of their vectors. Distances come from a matrix product; points whose two nearest
  centres lie within its rounding are measured anew coordinate by coordinate. A cluster left without points moves to the point that is farthest
  from its own centre, which leaves its old cluster's mean.

Results do not depend on partitioning or task order: vectors are integers (multiples of
``1 / UNIT``), so sums are exact; distances are added coordinate by coordinate; costs are
summed as integers (multiples of ``1 / COST_UNIT``). Ties go to the smaller hash of the key.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callwise.functions.hashing import hash_uniform_int

# the functions of this module travel to executors by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNIT = 1 << 24
COST_UNIT = 1 << 20
HASH_STREAM = 31
# constants of the 64-bit finaliser (fixed values)
STEP, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def points(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, h, q): hash of the key and the features as integers."""
    return df.select(F.col(key), hash_uniform_int([key], HASH_STREAM).alias("h"),
                     F.array(*[F.floor(F.col(c) * UNIT + F.lit(0.5)).cast("bigint") for c in features]).alias("q"))


def trials(k: int) -> int:
    return 2 + int(math.log(k))


def code(seed: int, step: int, trial: int) -> int:
    """What tells the draws of one point apart, as a 64-bit number."""
    return ((seed * 1024 + step) * 64 + trial + 1) * STEP % (1 << 64)


def uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """An even draw on (0, 1) for every key hash."""
    x = h.astype(np.uint64) + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def squared(x: np.ndarray, centre) -> np.ndarray:
    """Squared distance of every row to a centre, added coordinate by coordinate."""
    out = np.zeros(len(x))
    for f in range(x.shape[1]):
        d = x[:, f] - centre[f]
        d *= d
        out += d
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance to it); the lower number on ties."""
    label, best = np.zeros(len(x), np.int64), squared(x, centres[0])
    for k in range(1, len(centres)):
        d = squared(x, centres[k])
        closer = d < best
        label[closer], best = k, np.where(closer, d, best)
    return label, best


ROWS = 2000             # points whose distances are held at a time


def members(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cluster by point, whether it is the point's: the same as ``nearest``, by a product."""
    n, dims = x.shape
    with np.errstate(over="ignore", invalid="ignore"):
        product = np.hstack([-centres, 0.5 * (centres * centres).sum(axis=1)[:, None]]) @ np.vstack([x.T, np.ones(n)])
        reach = np.abs(x).max() + np.abs(centres).max() if n else 0.0
        slack = 64 * (dims + 4) ** 2 * np.finfo(float).eps * reach * reach
        own = product <= product.min(axis=0) + slack
    # rounding, or a vector that is not finite
    unclear = np.flatnonzero(own.sum(axis=0) != 1)
    if len(unclear):
        own[:, unclear] = np.arange(len(centres))[:, None] == nearest(x[unclear], centres)[0]
    return own


def cost(d: np.ndarray) -> int:
    return int(np.floor(d * COST_UNIT).astype(np.int64).sum())


@dataclass
class Fit:
    k: int
    seed: int
    centres: np.ndarray
    picks: list[tuple] = field(default_factory=list)     # (key, trial, cost) of every seeding step
    inertia: float = math.nan
    iterations: int = 0
    relocated: int = 0


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            q = np.asarray(b.column("q").flatten()).reshape(b.num_rows, -1)
            yield b, np.asarray(b.column("h")), q


def _rows(columns: list, names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*columns) if columns else [[]] * len(names), types)], names=names)


def _points(p: DataFrame) -> DataFrame:
    """``p`` without its key, for the passes that do not return it."""
    return p.select("h", "q")


def _key_type(p: DataFrame) -> tuple[str, str]:
    """Name and type of the key column."""
    f = p.schema.fields[0]
    return f.name, f.dataType.simpleString()


def _draw(p: DataFrame, wanted: list[tuple[int, np.ndarray, list[int]]]) -> dict:
    """The winner of every race: ``wanted`` holds (model, centres so far, salt of each trial).
    Returns {(model, trial): (key, q)}."""
    name, kind = _key_type(p)

    def run(batches):
        best: dict = {}
        key_type = None
        for b, h, q in _batches(batches):
            x = np.asfortranarray(q / UNIT)
            key_type = b.column(0).type
            for j, centres, salts in wanted:
                d = nearest(x, centres)[1] if len(centres) else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    for t, salt in enumerate(salts):
                        race = -np.log(uniform(h, salt)) / d
                        ties = np.flatnonzero(race == race.min())
                        i = min(ties, key=lambda i: (h[i], tuple(q[i])))
                        now = (float(race[i]), int(h[i]), q[i].tolist(), b.column(0)[int(i)].as_py())
                        if (j, t) not in best or now[:3] < best[j, t][:3]:
                            best[j, t] = now
        rows = [(j, t, *v) for (j, t), v in best.items()]
        yield _rows(rows, ["model", "trial", "race", "h", "q", "key"],
                    [pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.int64()), key_type or pa.null()])

    found = (p.mapInArrow(_whole(run), f"model int, trial int, race double, h bigint, q array<bigint>, key {kind}")
             .groupBy("model", "trial").agg(F.min(F.struct("race", "h", "q", "key")).alias("w")))
    return {(r.model, r.trial): (r.w.key, r.w.q) for r in found.collect()}


def _whole(run):
    """``run`` without rows where a partition has no points."""
    def guarded(batches):
        for out in run(batches):
            if out.num_rows:
                yield out
    return guarded


def _trial_costs(p: DataFrame, wanted: list[tuple[int, np.ndarray, list]]) -> dict:
    """{(model, trial): cost} if the trial's point were added to the model's centres."""
    def run(batches):
        total: dict = {}
        for _, _, q in _batches(batches):
            x = np.asfortranarray(q / UNIT)
            for j, centres, candidates in wanted:
                d = nearest(x, centres)[1] if len(centres) else np.full(len(x), np.inf)
                for t, c in enumerate(candidates):
                    total[j, t] = total.get((j, t), 0) + cost(np.minimum(d, squared(x, c)))
        yield _rows([(j, t, v) for (j, t), v in total.items()], ["model", "trial", "cost"], [pa.int32(), pa.int32(), pa.int64()])

    found = _points(p).mapInArrow(_whole(run), "model int, trial int, cost bigint").groupBy("model", "trial").agg(F.sum(F.col("cost").cast("decimal(38,0)")).alias("cost"))
    return {(r.model, r.trial): int(r.cost) for r in found.collect()}


def seeded(p: DataFrame, jobs: list[tuple[int, int]]) -> list[Fit]:
    """Greedy k-means++ centres for every (k, seed): two passes a step for all of them."""
    dims = len(p.select("q").first()[0])
    fits = [Fit(k, seed, np.zeros((0, dims))) for k, seed in jobs]
    for step in range(1, max(k for k, _ in jobs) + 1):
        active = [j for j, f in enumerate(fits) if f.k >= step]
        won = _draw(p, [(j, fits[j].centres, [code(fits[j].seed, step, t) for t in range(trials(fits[j].k) if step > 1 else 1)]) for j in active])
        tried = {j: [np.array(won[j, t][1]) / UNIT for t in range(trials(fits[j].k) if step > 1 else 1)] for j in active}
        costs = _trial_costs(p, [(j, fits[j].centres, tried[j]) for j in active])
        for j in active:
            t = min(range(len(tried[j])), key=lambda t: (costs[j, t], t))
            fits[j].centres = np.vstack([fits[j].centres, tried[j][t]])
            fits[j].picks.append((won[j, t][0], t, costs[j, t]))
    return fits


def _sums(p: DataFrame, models: dict[int, np.ndarray], costs: bool = False) -> dict:
    """{model: (points, vector sums, costs) by cluster}: one pass, exact. Costs are left at 0
    where they are not asked for."""
    dims = next(iter(models.values())).shape[1]

    def run(batches):
        total: dict = {}
        for _, _, every in _batches(batches):
            for at in range(0, len(every), ROWS):
                q = every[at:at + ROWS]
                x = np.asfortranarray(q / UNIT)
                counted = np.hstack([np.ones((len(q), 1), np.int64), q])
                if len(q) * float(np.abs(x).max()) * UNIT < 2.0 ** 52:
                    counted = counted.astype(np.float64)        # sums of such integers are exact
                for j, centres in models.items():
                    own = members(x, centres)
                    v = np.zeros((len(centres), 2 + dims), np.int64)
                    v[:, np.r_[0, 2:2 + dims]] = own.astype(counted.dtype) @ counted
                    if costs:
                        label, d = nearest(x, centres)
                        np.add.at(v[:, 1], label, np.floor(d * COST_UNIT).astype(np.int64))
                    total[j] = total.get(j, 0) + v
        rows = [(j, k, *c) for j, v in total.items() for k, c in enumerate(v.tolist())]
        yield _rows(rows, names, [pa.int32(), pa.int32()] + [pa.int64()] * (2 + dims))

    names = ["model", "cluster", "n", "cost"] + [f"s{f}" for f in range(dims)]
    found = (_points(p).mapInArrow(_whole(run), ", ".join(f"{c} {'int' if i < 2 else 'bigint'}" for i, c in enumerate(names)))
             .groupBy("model", "cluster").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names[2:]]))
    out = {j: (np.zeros(len(c), object), [[0] * dims for _ in c], np.zeros(len(c), object)) for j, c in models.items()}
    for r in found.collect():
        n, sums, spent = out[r.model]
        n[r.cluster], spent[r.cluster] = int(r.n), int(r.cost)
        sums[r.cluster] = [int(r[f"s{f}"]) for f in range(dims)]
    return out


def _farthest(p: DataFrame, models: dict[int, tuple[np.ndarray, int]]) -> dict:
    """{model: (q, cluster) of its points farthest from their centres, the farthest first}:
    ``models`` holds the centres and how many points are needed."""
    most = max(n for _, n in models.values())

    def run(batches):
        best: dict = {j: [] for j in models}
        for _, h, q in _batches(batches):
            x = np.asfortranarray(q / UNIT)
            for j, (centres, n) in models.items():
                label, d = nearest(x, centres)
                for i in np.lexsort((h, -d))[:n]:
                    best[j].append((-float(d[i]), int(h[i]), q[i].tolist(), int(label[i])))
                best[j] = sorted(best[j])[:n]
        rows = [(j, -d, h, q, c) for j, found in best.items() for d, h, q, c in found if d < 0]
        yield _rows(rows, ["model", "d", "h", "q", "cluster"], [pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.int32()])

    order = Window.partitionBy("model").orderBy(F.desc("d"), "h", "q")
    found = (_points(p).mapInArrow(_whole(run), "model int, d double, h bigint, q array<bigint>, cluster int")
             .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).orderBy("model", "rank"))
    out: dict = {}
    for r in found.collect():
        if r["rank"] <= models[r.model][1]:
            out.setdefault(r.model, []).append((r.q, r.cluster))
    return out


def lloyd_step(p: DataFrame, models: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """{model: (new centres, points by cluster, clusters relocated)}."""
    stats = _sums(p, models)
    lost = {j: (models[j], int((s[0] == 0).sum())) for j, s in stats.items() if (s[0] == 0).any()}
    far = _farthest(p, lost) if lost else {}
    out = {}
    for j, (n, sums, _) in stats.items():
        moved = 0
        for k, (q, old) in zip([k for k in range(len(n)) if n[k] == 0], far.get(j, [])):
            sums[old] = [a - b for a, b in zip(sums[old], q)]
            sums[k], n[k], n[old], moved = list(q), 1, n[old] - 1, moved + 1
        centres = models[j].copy()
        for k in range(len(n)):
            if n[k]:            # else: no point is left to move to
                centres[k] = [float(s) / float(n[k]) / UNIT for s in sums[k]]
        out[j] = centres, n, moved
    return out


def fit(p: DataFrame, jobs: list[tuple[int, int]], max_iter: int = 300, tol: float = 1e-4) -> list[Fit]:
    """Fitted models of ``jobs`` (k, seed) over ``points``. A model is done when the squared
    shifts of its centres add up to ``tol`` or less."""
    fits = seeded(p, jobs)
    return improved(p, fits, max_iter, tol)


def improved(p: DataFrame, fits: list[Fit], max_iter: int = 300, tol: float = 1e-4) -> list[Fit]:
    active = dict(enumerate(fits))
    for _ in range(max_iter):
        if not active:
            break
        for j, (centres, _, moved) in lloyd_step(p, {j: f.centres for j, f in active.items()}).items():
            f = fits[j]
            shift = float(((centres - f.centres) ** 2).sum())
            f.centres, f.iterations, f.relocated = centres, f.iterations + 1, f.relocated + moved
            if shift <= tol and not moved:
                del active[j]
    for j, (_, _, costs) in _sums(p, {j: f.centres for j, f in enumerate(fits)}, costs=True).items():
        fits[j].inertia = int(sum(costs)) / COST_UNIT
    return fits


def label_column(q: str, centres: np.ndarray):
    """Nearest centre as a projection over the integer vectors; the lower number on ties."""
    best, label = None, F.lit(0)
    for k, centre in enumerate(centres):
        d = None
        for f, c in enumerate(centre):
            diff = F.col(q)[f].cast("double") / F.lit(float(UNIT)) - F.lit(float(c))
            d = diff * diff if d is None else d + diff * diff
        if best is None:
            best = d
        else:
            closer = d < best
            label, best = F.when(closer, F.lit(k)).otherwise(label), F.when(closer, d).otherwise(best)
    return label
