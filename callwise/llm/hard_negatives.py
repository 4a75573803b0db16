"""Hard negatives of embedding vectors, by length buckets with sorted coordinate lists.

Each component x of a vector becomes the integer floor(256 * x); a score is the integer
inner product. Vectors are range-partitioned by falling length and cut into buckets of
``BUCKET`` members. A bucket row holds its members and, for each coordinate, the members
sorted by their normalised value there (``index``).

A search looks for scores of at least t of an anchor a. A bucket whose longest member
has length l can only hold them when cos >= t / (|a| l). That bound on the angle gives a
range of feasible values on each of the anchor's ``FOCUS`` strongest coordinates (a value
further off cannot be made up on the others). The shortest range of the sorted lists gives the
candidates, the other ranges thin them out, and what is left is multiplied out exactly.
As results are found in a task, t rises and more buckets fall away by length alone.

Anchors are searched in blocks of at most ``ANCHORS`` (in expectation half of it); each
block reads the buckets twice, for its positives and for its negatives. No vector is left
out: bounds are widened by ``SLACK``, far above the rounding of doubles.

Defined cases:

- a null label, a null vector, a null or non-finite component: the row takes no part; so
  do rows with a component over ``LARGEST``, whose products need not fit into 64 bits;
- a null ``vec_id``: never an anchor, a candidate like others, last among ties; returned
  as null (as is the id 2**63 - 1, which stands for it inside);
- rows sharing a ``vec_id`` are rows of their own: only the anchor's own row is left out
  of its positives, and each of several anchors with one id has its results;
- vectors of different lengths: missing components are zero; an empty vector scores 0;
- a negative positive score has no negatives (80 % of it is above itself);
- an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callwise.llm import textbytes as tb

BUCKET = 1024           # members of a length bucket
ANCHORS = 4096          # most anchors of a block
EVERY = 100             # anchors are the rows whose id it divides
FOCUS = 4               # coordinates of an anchor whose lists are looked at
POSITIVES, NEGATIVES = 5, 5
LARGEST = 1 << 27       # of a component, after scaling
SLACK = 1e-9
NO_ID = 2 ** 63 - 1

MEMBERS = "vec_id long, row long, label long, vector array<int>, length double"
BUCKETS = ("longest double, members int, dims int, ids binary, rows binary, labels binary, "
           "lengths binary, vectors binary, lists binary")
FOUND = "key long, anchor_id long, positive_id long, positive_score long, id long, row long, score long"


def members(vectors: DataFrame) -> DataFrame:
    """The rows that take part, as integer vectors with their Euclidean length."""
    ids = F.col("vec_id").cast("long")
    label = F.col("label").cast("long")
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    whole = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LARGEST / 256))
    return (vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(whole, F.lit(False)))
            .select(F.coalesce(ids, F.lit(NO_ID)).alias("vec_id"), F.monotonically_increasing_id().alias("row"),
                    F.when(ids % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
                    F.transform(scaled, lambda x: x.cast("int")).alias("vector"))
            .withColumn("length", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))))


def matrix(col: pa.Array) -> np.ndarray:
    """A list column as an int32 matrix, short rows filled with zeros."""
    values, off = np.asarray(col.values), np.asarray(col.offsets)
    size = np.diff(off)
    out = np.zeros((len(size), size.max(initial=0)), np.int32)
    out[np.repeat(np.arange(len(size)), size), tb.ragged(size)] = values[off[0]:off[-1]]
    return out


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket rows of one partition, whose members arrive by falling length."""
    held, waiting = [], 0
    names = [x.split()[0] for x in BUCKETS.split(", ")]

    def bucket(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks().to_batches()[0]
        vectors = matrix(rows.column("vector"))
        length = np.asarray(rows.column("length"))
        unit = vectors / np.where(length > 0, length, 1)[:, None]
        lists = np.argsort(unit, axis=0, kind="stable").T.astype(np.uint16)
        ids, number, label = (np.asarray(rows.column(c)) for c in ("vec_id", "row", "label"))
        values = [length.max(), len(ids), vectors.shape[1], ids.tobytes(), number.tobytes(), label.tobytes(),
                  length.tobytes(), vectors.tobytes(), np.ascontiguousarray(lists).tobytes()]
        types = [pa.float64(), pa.int32(), pa.int32()] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    for batch in batches:
        held.append(batch)
        waiting += batch.num_rows
        while waiting >= BUCKET:
            rows = pa.Table.from_batches(held)
            yield bucket(rows.slice(0, BUCKET))
            held, waiting = rows.slice(BUCKET).to_batches(), waiting - BUCKET
    if waiting:
        yield bucket(pa.Table.from_batches(held))


def index(vectors: DataFrame) -> DataFrame:
    """Length buckets of ``vectors`` (vec_id, embedding, label). The row number spreads
    equal lengths over the partitions, however many copies one vector has."""
    rows = members(vectors).repartitionByRange(F.desc("length"), "row").sortWithinPartitions(F.desc("length"), "row")
    return rows.mapInArrow(_bucketed, BUCKETS)


class Bucket:
    def __init__(self, batch: pa.RecordBatch, i: int):
        get = lambda c, t: np.frombuffer(batch.column(c)[i].as_py(), t)
        n, dims = batch.column("members")[i].as_py(), batch.column("dims")[i].as_py()
        self.longest = batch.column("longest")[i].as_py()
        self.ids, self.rows, self.labels = get("ids", np.int64), get("rows", np.int64), get("labels", np.int64)
        self.lengths = get("lengths", np.float64)
        self.vectors = get("vectors", np.int32).reshape(n, dims)
        self.lists = get("lists", np.uint16).reshape(dims, n)
        self.unit = self.vectors / np.where(self.lengths > 0, self.lengths, 1)[:, None]


class Anchors:
    """A block of anchors, as it travels to the tasks."""

    def __init__(self, rows: list):
        self.ids = np.array([r.vec_id for r in rows], np.int64)
        self.rows = np.array([r.row for r in rows], np.int64)
        self.labels = np.array([r.label for r in rows], np.int64)
        self.lengths = np.array([r.length for r in rows], np.float64)
        self.vectors = np.zeros((len(rows), max((len(r.vector) for r in rows), default=0)), np.int64)
        for out, r in zip(self.vectors, rows):
            out[:len(r.vector)] = r.vector
        self.unit = self.vectors / np.where(self.lengths > 0, self.lengths, 1)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]


def feasible(anchor: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of the values that a unit vector can have where a unit anchor has the value
    ``anchor``, if their cosine is to be at least ``cosine``: on that coordinate the angles
    to the axis differ by no more than the angle between the vectors."""
    own, apart = np.arccos(np.clip(anchor, -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    return np.cos(np.minimum(own + apart, np.pi)) - SLACK, np.cos(np.maximum(own - apart, 0)) + SLACK


def candidates(b: Bucket, a: Anchors, pick: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, member) pairs that may score ``least`` or more; ``pick`` names the anchors
    looked at, ``least`` is theirs."""
    reach = a.lengths[pick] * b.longest
    can = least <= reach * (1 + SLACK)                      # else the bucket is too short
    pick, least, reach = pick[can], least[can], reach[can]
    n, dims = b.vectors.shape
    # below 0, or without length, every member is feasible; so it is on coordinates the bucket lacks
    near = (least > 0) & (reach > 0) & (a.focus.shape[1] > 0)
    free, some = pick[~near], pick[near]
    who, which = np.repeat(free, n), np.tile(np.arange(n), len(free))
    if len(some) and dims:
        focus = a.focus[some]
        inside = focus < dims
        low, high = feasible(np.take_along_axis(a.unit[some], focus, 1), (least[near] / reach[near])[:, None] - SLACK)
        begin, end = np.zeros(focus.shape, np.int64), np.full(focus.shape, n)
        for f in np.unique(focus[inside]):
            at = focus == f
            ranked = b.unit[b.lists[f], f]
            begin[at], end[at] = np.searchsorted(ranked, low[at], "left"), np.searchsorted(ranked, high[at], "right")
        size = np.maximum(end - begin, 0)
        short = np.argmin(size, axis=1)
        k = np.arange(len(some))
        size, begin = size[k, short], begin[k, short]
        of = np.repeat(k, size)
        at = np.repeat(begin, size) + tb.ragged(size)
        f = np.where(inside[k, short], focus[k, short], 0)[of]
        member = np.where(inside[k, short][of], b.lists[f, at], at).astype(np.int64)
        for j in range(focus.shape[1]):
            value = b.unit[member, np.minimum(focus[of, j], dims - 1)]
            keep = ~inside[of, j] | (value >= low[of, j]) & (value <= high[of, j])
            of, member = of[keep], member[keep]
        who, which = np.concatenate([who, some[of]]), np.concatenate([which, member])
    return who, which


def scores(b: Bucket, a: Anchors, who: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs."""
    d = min(b.vectors.shape[1], a.vectors.shape[1])
    if not d or not len(who):
        return np.zeros(len(who), np.int64)
    p, q = b.vectors[:, :d], a.vectors[:, :d]
    exact = float(np.abs(p).max()) * float(np.abs(q).max()) * d < 2 ** 53      # sums of doubles lose nothing
    kind = np.float64 if exact else np.int64
    own, inv = np.unique(who, return_inverse=True)
    if len(who) * 4 > len(own) * len(p):
        return (q[own].astype(kind) @ p.T.astype(kind))[inv, which].astype(np.int64)
    return np.einsum("ij,ij->i", q[who].astype(kind), p[which].astype(kind)).astype(np.int64)


class Best:
    """The ``k`` best (score falling, id, row) of every key, as arrays."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor, self.least = k, floor, floor.astype(np.float64)
        self.rows = np.zeros((4, 0), np.int64)      # key, score, id, row

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        if not len(key):
            return
        rows = np.concatenate([self.rows, np.stack([key, score, ids, row])], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        first = np.searchsorted(rows[0], rows[0])
        rank = np.arange(rows.shape[1]) - first
        self.rows = rows[:, rank < self.k]
        last = rows[:, rank == self.k - 1]
        self.least[last[0]] = last[1]


def _found(best: Best, a: Anchors, anchor: np.ndarray, positive: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    key = best.rows[0]
    cols = [key, a.ids[anchor[key]], positive[key], score[key], best.rows[2], best.rows[3], best.rows[1]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[x.split()[0] for x in FOUND.split(", ")])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Bucket(batch, i)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors among the members of the buckets."""
    for b in _buckets(batches):
        at = np.flatnonzero(b.ids % EVERY == 0)
        cols = [b.ids[at], b.rows[at], b.labels[at], list(b.vectors[at]), b.lengths[at]]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in MEMBERS.split(", ")])


CHUNK = 256             # anchors whose pairs with a bucket are held at a time


def _positives(a: Anchors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(POSITIVES, np.full(len(a.ids), -np.inf))
        for b in _buckets(batches):
            for s in range(0, len(a.ids), CHUNK):
                pick = np.arange(s, min(s + CHUNK, len(a.ids)))
                who, which = candidates(b, a, pick, best.least[pick])
                keep = (a.labels[who] == b.labels[which]) & (a.rows[who] != b.rows[which])
                who, which = who[keep], which[keep]
                score = scores(b, a, who, which)
                keep = score >= best.least[who]
                best.add(who[keep], score[keep], b.ids[which[keep]], b.rows[which[keep]])
        every = np.arange(len(a.ids))
        yield _found(best, a, every, a.ids, np.zeros(len(a.ids), np.int64))
    return run


def _negatives(a: Anchors, anchor: np.ndarray, positive: np.ndarray, score: np.ndarray):
    """``anchor``, ``positive``, ``score``: anchor number, id and score of each positive,
    sorted by anchor; their places are the keys of the result."""
    floor = -((-80 * score) // 100)
    first = np.searchsorted(anchor, np.arange(len(a.ids) + 1))
    owners = np.flatnonzero(np.diff(first))
    most = np.zeros(len(a.ids), np.int64)
    most[owners] = np.maximum.reduceat(score, first[owners])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(NEGATIVES, floor)
        for b in _buckets(batches):
            for s in range(0, len(owners), CHUNK):
                pick = owners[s:s + CHUNK]
                low = np.full(len(a.ids), np.inf)
                low[owners] = np.minimum.reduceat(best.least, first[owners])
                who, which = candidates(b, a, pick, low[pick])
                keep = a.labels[who] != b.labels[which]
                who, which = who[keep], which[keep]
                got = scores(b, a, who, which)
                keep = (got >= low[who]) & (got <= most[who])
                who, which, got = who[keep], which[keep], got[keep]
                each = np.diff(first)[who]
                key = np.repeat(first[who], each) + tb.ragged(each)
                which, got = np.repeat(which, each), np.repeat(got, each)
                keep = (got >= best.least[key]) & (got <= score[key])
                best.add(key[keep], got[keep], b.ids[which[keep]], b.rows[which[keep]])
        yield _found(best, a, anchor, positive, score)
    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(vectors: DataFrame) -> DataFrame:
    """Hard negatives of ``vectors`` (vec_id, embedding, label): anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score. Anchors are the rows whose vec_id
    is divisible by 100."""
    spark = tb.text_session(vectors.sparkSession)
    buckets = tb.checkpointed(index(vectors), "buckets")
    chosen = tb.checkpointed(buckets.mapInArrow(_anchors, MEMBERS), "anchors")
    blocks = max(1, -(-chosen.count() // (ANCHORS // 2)))      # hashed evenly, so that none is over ANCHORS
    out = spark.createDataFrame([], f"{FOUND}, rank int")
    for i in range(blocks):
        rows = chosen.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i).orderBy("row").collect()
        if not rows:
            continue
        a = Anchors(rows)
        near = _ranked(buckets.mapInArrow(_positives(a), FOUND), POSITIVES).orderBy("key", "rank").collect()
        if not near:
            continue
        anchor, positive, score = (np.array([r[c] for r in near], np.int64) for c in ("key", "id", "score"))
        found = _ranked(buckets.mapInArrow(_negatives(a, anchor, positive, score), FOUND), NEGATIVES)
        out = found if blocks == 1 else out.union(found.select(out.columns))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select("anchor_id", known("positive_id").alias("positive_id"), "rank", known("id").alias("negative_id"),
                      "positive_score", F.col("score").alias("negative_score"))


def op13_lemp_negatives(spark, sf_dir: str) -> DataFrame:
    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""
