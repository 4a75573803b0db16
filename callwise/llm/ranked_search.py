"""Ranked lexical search over a term-document grid kept as compressed quadtrees.

``index`` cuts the documents into shards of about ``SHARD_BYTES`` of text. A shard is a grid:
one row for each of its terms, one column for each document (by rising id), and in a cell
the impact of the term there. The grid is halved level by level in both directions, the rows
``LEAD`` levels ahead of the columns, so that a cell of 2**LEAD documents belongs to one
term. Cells are written breadth first: the largest impact in the cell, and four bits that
say which quarters hold anything. A quarter with a single impact is a leaf with its row and
column, whatever its size (``Shard``).

``search`` descends the paths of an item's terms through that tree together. A state is a
range of documents with the cell of every term still present in it; weight times largest
impact, summed over the terms, bounds what a document of the range can score. States are
taken best first, a batch of each item at a time, and halved. A state with leaves
only is scored exactly. States below the item's tenth score so far fall away (ties go by
id), and that score is kept from shard to shard of a task. Every shard is searched for
every item, so results are exact, up to terms with equal 64-bit hashes.

A shard is one row of compressed columns and a row group of its own, and tasks get rows in
batches of about ``BATCH_BYTES``: what a task holds follows a shard, not how many of them a
partition has.

A term's documents are counted by shards and summed; items come in blocks of at most
``ITEMS`` (in expectation half of it), whose terms are what the driver holds.

Defined cases:

- terms are the maximal runs of ASCII letters, digits and anything beyond ASCII, with A-Z
  lower-cased; a null or empty text has none and counts nowhere;
- each row is a document; rows sharing an id are ranked next to each other;
- a null ``doc_id`` comes last among ties and is returned as null (as is 2**63 - 1);
- items with one id, and repeated items, are ranked each by itself; an item without terms,
  or whose terms no document has, has no rows; neither have documents that score 0;
- empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callwise.llm import textbytes as tb
from callwise.llm.hard_negatives import Best

SHARD_BYTES = 8 << 20       # of text behind a shard
LEAD = 7                    # levels that the rows of the grid are halved ahead of the columns
BATCH_BYTES = 8 << 20       # of the shards handed to Python at a time
ITEMS, ITEM_BYTES = 2000, 8 << 20       # of a block
GROUP = 16                  # items that descend at a time
BATCH = 64                  # states of an item that are halved at a time
SPARE = 1 << 17             # paths from which those of done states are let go
TOP = 10
NO_ID = 2 ** 63 - 1

SHARDS = ("docs int, row_bits int, column_bits int, levels int, terms binary, df binary, ids binary, "
          "values binary, masks binary, rows binary, columns binary")
FOUND = "item int, item_id long, doc_id long, score long"
_POP = np.array([bin(x).count("1") for x in range(16)], np.int64)


def terms(col: pa.Array) -> tb.Words:
    """Terms of a string column."""
    raw, off = tb.strings(col)
    raw = tb.lower_ascii(raw)
    return tb.Words(raw, off, tb._PLAIN[raw])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = total = 0
    for batch in tb.slices(batches):
        counts = terms(batch.column("text")).counts
        docs, total = docs + int((counts > 0).sum()), total + int(counts.sum())
    yield pa.RecordBatch.from_pydict({"docs": [docs], "total": [total]})


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    m = 10 + (90 * n * docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def postings(batch: pa.RecordBatch, docs: int, total: int) -> tuple[np.ndarray, ...]:
    """(term hash, document of the batch, impact) of every term in every document."""
    w = terms(batch.column("text"))
    h = w.hashes()
    o = tb.order_by(w.doc, h)
    h, d = h[o], w.doc[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h)))
    return h[at], d[at], impacts(tf, w.counts[d[at]], docs, total)


def bits(n: int) -> int:
    """Halvings until ``n`` lines are single."""
    return max(n - 1, 0).bit_length()


def shard(ids: np.ndarray, h: np.ndarray, d: np.ndarray, impact: np.ndarray) -> dict:
    """The quadtree of one shard: ``ids`` of its documents, and its postings."""
    order = np.argsort(ids, kind="stable")
    column = np.empty(len(ids), np.int64)
    column[order] = np.arange(len(ids))
    d = column[d]
    names, row = np.unique(h, return_inverse=True)
    rb, cb = bits(len(names)), bits(len(ids))
    levels = max(rb + min(LEAD, cb), cb)
    key = np.zeros(len(row), np.uint64)
    for level in range(levels):
        key <<= np.uint64(2)
        if level < rb:
            key |= ((row >> (rb - 1 - level)) & 1).astype(np.uint64) << np.uint64(1)
        if levels - 1 - level < cb:
            key |= ((d >> (levels - 1 - level)) & 1).astype(np.uint64)
    o = np.argsort(key)
    key, row, d, impact = key[o], row[o], d[o], impact[o].astype(np.uint32)
    values, masks, leaves = [impact.max(keepdims=True)], [], []
    alive = np.arange(len(key))         # impacts in cells that are halved on
    if len(key) == 1:
        alive, masks, leaves = alive[:0], [np.zeros(1, np.uint8)], [alive]
    held = np.zeros(1, np.int64)        # where in ``alive`` those cells begin
    for level in range(levels):
        if not len(alive):
            break
        cell = key[alive] >> np.uint64(2 * (levels - level - 1))
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        size = np.diff(np.append(begin, len(cell)))
        values.append(np.maximum.reduceat(impact[alive], begin))
        parent = np.searchsorted(begin, held)
        mask = np.add.reduceat(1 << (cell[begin] & np.uint64(3)).astype(np.int64), parent).astype(np.uint8)
        # the masks of this level's cells: those halved on, between leaves
        if level == 0:
            masks.append(mask)
        else:
            masks[-1][halved] = mask
        halved = size > 1
        masks.append(np.zeros(len(size), np.uint8))
        leaves.append(alive[begin[~halved]])
        alive = alive[np.repeat(halved, size)]
        held = np.cumsum(size[halved]) - size[halved]
    leaf = np.concatenate(leaves)
    return {"docs": len(ids), "row_bits": rb, "column_bits": cb, "levels": levels, "terms": names.tobytes(),
            "df": np.bincount(row, minlength=len(names)).astype(np.int32).tobytes(), "ids": ids[order].tobytes(),
            "values": tb.planes(np.concatenate(values)), "masks": np.concatenate(masks).tobytes(),
            "rows": tb.planes(row[leaf].astype(np.uint32)), "columns": tb.planes(d[leaf].astype(np.uint32))}


def squeezed(raw: bytes) -> bytes:
    """A column of a shard as it is written: its length, then its bytes compressed."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unsqueezed(x: pa.BinaryScalar) -> pa.Buffer:
    raw = x.as_buffer()
    return pa.decompress(raw.slice(8), int.from_bytes(raw.slice(0, 8).to_pybytes(), "little"), "zstd")


def _shards(docs: int, total: int):
    types = {"int": pa.int32(), "binary": pa.binary()}
    columns = [x.split() for x in SHARDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, waiting = [], 0, 0

        def made() -> Iterator[pa.RecordBatch]:
            ids, h, d, impact = (np.concatenate([x[i] for x in held]) for i in range(4))
            if len(h):
                out = shard(ids, h, d, impact)
                yield pa.RecordBatch.from_arrays([pa.array([squeezed(out[c]) if t == "binary" else out[c]], types[t]) for c, t in columns], names=[c for c, _ in columns])

        for batch in tb.slices(batches):
            h, d, impact = postings(batch, docs, total)
            ids = np.asarray(batch.column("doc_id").fill_null(NO_ID))
            has, d = np.unique(d, return_inverse=True)      # documents without terms take no column
            held.append((ids[has], h, d + count, impact))
            count += len(has)
            waiting += len(tb.strings(batch.column("text"))[0])
            if waiting >= SHARD_BYTES:
                yield from made()
                held, count, waiting = [], 0, 0
        if held:
            yield from made()
    return run


def _texts(docs: DataFrame) -> DataFrame:
    tb.text_session(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sizes(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    row = _texts(docs).mapInArrow(_sizes, "docs long, total long").agg(F.sum("docs"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def index(docs: DataFrame) -> tuple[DataFrame, int]:
    """The shards of ``docs`` (doc_id, text), written to the shared folder, and the number
    of documents with a term."""
    n, total = sizes(docs)
    # Spark's writer would gather a hundred rows, however large, before it ends a row group
    one_each = {"parquet.block.row.count.limit": "1", "compression": "uncompressed"}
    return tb.checkpointed(_texts(docs).mapInArrow(_shards(n, max(total, 1)), SHARDS), "shards", **one_each), n


def _bounded_batches(spark) -> None:
    """Bounds the bytes of one Arrow batch: the rows of an index are large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)([kmgt]?)b?", (spark.conf.get(key, None) or "").lower())
    if not now or int(now[1]) << 10 * "bkmgt".index(now[2] or "b") > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


class Shard:
    """A shard as a search reads it: children and leaves are found by counting bits."""

    def __init__(self, row: dict):
        get = lambda c, t: np.frombuffer(row[c], t)
        plane = lambda c: np.ascontiguousarray(get(c, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
        self.rb, self.cb, self.levels = row["row_bits"], row["column_bits"], row["levels"]
        self.terms, self.ids = get("terms", np.uint64), get("ids", np.int64)
        self.value, self.mask = plane("values"), get("masks", np.uint8)
        kids = _POP.astype(np.uint8)[self.mask]
        self.first = np.cumsum(kids, dtype=np.int32) + np.int32(1) - kids
        # of a leaf: its place among the leaves, which have the row and the column
        self.place = np.cumsum(self.mask == 0, dtype=np.int32) - np.int32(1)
        self.row, self.column = plane("rows"), plane("columns")

    def rows_of(self, h: np.ndarray) -> np.ndarray:
        """Row of each term hash, -1 where the shard has none."""
        at = np.searchsorted(self.terms, h)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == h, at, -1)

    def columns_of(self, leaf: np.ndarray) -> np.ndarray:
        return self.column[self.place[leaf]].astype(np.int64)

    def halved(self, level: np.ndarray, entry: np.ndarray, row: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both halves of the documents: (paths, cells) that go on there. ``entry`` is
        the cell of each path, ``row`` its term, ``level`` how often its range was halved."""
        mask = self.mask[entry].astype(np.int64)
        leaf = mask == 0
        upper = np.where(level < self.rb, (row >> np.maximum(self.rb - 1 - level, 0)) & 1, 0) * 2
        splits = self.levels - 1 - level < self.cb
        side = np.where(leaf & splits, (self.columns_of(entry) >> np.minimum(self.levels - 1 - level, 62)) & 1, 0)
        out = []
        for half in (0, 1):
            q = upper + half
            go = np.where(leaf, side == half, (mask >> q) & 1 == 1) & (splits | (half == 0))
            to = np.where(leaf, entry, self.first[entry] + _POP[mask & ((1 << q) - 1)])
            path = np.flatnonzero(go)
            to = to[path]
            own = (self.mask[to] != 0) | (self.row[self.place[to]] == row[path])
            out.append((path[own], to[own]))
        return out


class _Pool:
    """Growing columns: states, or the paths of states."""

    def __init__(self, *kinds):
        self.n, self.columns = 0, [np.zeros(1024, k) for k in kinds]

    def add(self, *values: np.ndarray) -> np.ndarray:
        m = len(values[0])
        if self.n + m > len(self.columns[0]):
            self.columns = [np.concatenate([c[:self.n], np.zeros(self.n + m, c.dtype)]) for c in self.columns]
        for c, v in zip(self.columns, values):
            c[self.n:self.n + m] = v
        self.n += m
        return np.arange(self.n - m, self.n)

    def keep(self, at: np.ndarray) -> None:
        """Only the rows ``at``, in that order, from 0 on."""
        self.n, self.columns = len(at), [c[at] for c in self.columns]


def _sums(of: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Integer sums of ``v`` by ``of`` (sorted)."""
    out = np.zeros(n, np.int64)
    if len(of):
        at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        out[of[at]] = np.add.reduceat(v, at)
    return out


def descend(s: Shard, item: np.ndarray, row: np.ndarray, weight: np.ndarray, best: Best) -> None:
    """Adds the shard's documents to ``best``: ``item``, ``row``, ``weight`` are the paths,
    sorted by item."""
    entry = np.zeros(len(row), np.int64)
    own = (s.mask[entry] != 0) | (s.row[s.place[entry]] == row)
    item, row, weight, entry = item[own], row[own], weight[own], entry[own]
    top = s.levels - s.cb
    for level in range(top):            # the documents are not halved yet
        path, entry = s.halved(np.full(len(row), level), entry, row)[0]
        item, row, weight = item[path], row[path], weight[path]
    if not len(row):
        return
    # a state: item, level, documents before it in halves of its level, bound, first path, paths
    states = _Pool(np.int64, np.int64, np.int64, np.int64, np.int64, np.int64)
    paths = _Pool(np.int32, np.int32, np.int32)
    open_ = np.zeros(0, np.int64)
    last = np.full(len(best.least), NO_ID)      # id at the k-th place

    def put(of: np.ndarray, item: np.ndarray, level: np.ndarray, prefix: np.ndarray,
            row: np.ndarray, weight: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Scores the states whose paths are leaves, returns the others; ``of`` (sorted)
        gives the state of each path."""
        n = len(item)
        got = weight.astype(np.int64) * s.value[entry]
        whole = _sums(of, (s.mask[entry] != 0).astype(np.int64), n) == 0
        at = np.flatnonzero(whole[of])
        if len(at):
            column = s.columns_of(entry[at])
            sort = np.argsort(of[at] * len(s.ids) + column, kind="stable")
            o, column = at[sort], column[sort]
            doc = of[o] * len(s.ids) + column
            new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            score, who = np.add.reduceat(got[o], new), item[of[o[new]]]
            keep = score >= best.least[who]
            best.add(who[keep], score[keep], s.ids[column[new]][keep], np.zeros(int(keep.sum()), np.int64))
        full = np.flatnonzero(np.bincount(best.rows[0], minlength=len(last)) == best.k)
        last[full] = best.rows[2][np.searchsorted(best.rows[0], full, "right") - 1]
        keep = ~whole & (_sums(of, np.ones(len(of), np.int64), n) > 0)
        of_kept = keep[of]
        number = np.cumsum(keep) - 1
        count = np.bincount(number[of[of_kept]], minlength=int(keep.sum()))
        begin = paths.n + np.cumsum(count) - count
        paths.add(row[of_kept], weight[of_kept], entry[of_kept])
        return states.add(item[keep], level[keep], prefix[keep], _sums(of, got, n)[keep], begin, count)

    who, of = np.unique(item, return_inverse=True)
    open_ = put(of, who, np.full(len(who), top), np.zeros(len(who), np.int64), row, weight, entry)
    while len(open_):
        who, level, prefix, bound, begin, count = (c[open_] for c in states.columns)
        first = s.ids[prefix << (s.levels - level)]
        keep = (bound > best.least[who]) | (bound == best.least[who]) & (first <= last[who])
        open_, who, bound = open_[keep], who[keep], bound[keep]
        order = np.lexsort((-bound, who))
        rank = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        now, open_ = open_[order[rank < BATCH]], open_[order[rank >= BATCH]]
        who, level, prefix, _, begin, count = (c[now] for c in states.columns)
        of = np.repeat(np.arange(len(now)), count)
        at = np.repeat(begin, count) + tb.ragged(count)
        row, weight, entry = (c[at] for c in paths.columns)
        halves = s.halved(level[of], entry, row)
        new = [put(of[path], who, level + 1, prefix * 2 + half, row[path], weight[path], to)
               for half, (path, to) in enumerate(halves) if len(path)]
        open_ = np.concatenate([open_, *new])
        if paths.n > SPARE and paths.n > 2 * int(states.columns[5][open_].sum()):     # most belong to states that are done
            begin, count = states.columns[4][open_], states.columns[5][open_]
            paths.keep(np.repeat(begin, count) + tb.ragged(count))
            states.keep(open_)
            states.columns[4] = np.cumsum(count) - count
            open_ = np.arange(len(open_))


class Items:
    """A block of items as it travels to the tasks: the terms of each, sorted by item."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        w = terms(pa.array([r[1] for r in rows], pa.string()))
        pairs = np.unique(np.rec.fromarrays([w.doc, w.hashes()], names="item,term"))
        self.item, self.term = pairs["item"].astype(np.int64), pairs["term"].astype(np.uint64)
        self.terms, self.of = np.unique(self.term, return_inverse=True)


def _frequencies(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(wanted), np.int64)
        for b in batches:
            for names, df in zip(b.column("terms"), b.column("df")):
                names, df = np.frombuffer(unsqueezed(names), np.uint64), np.frombuffer(unsqueezed(df), np.int32)
                at = np.searchsorted(names, wanted)
                at[at == len(names)] = 0
                n += np.where(names[at] == wanted, df[at], 0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["term", "n"])
    return run


def _search(items: Items, weight: np.ndarray, k: int):
    weight = weight[items.of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, np.ones(len(items.ids)))
        for b in batches:
            for i in range(b.num_rows):
                s = Shard({c: unsqueezed(x) if pa.types.is_binary(x.type) else x.as_py() for c, x in ((c, b.column(c)[i]) for c in b.schema.names)})
                row = s.rows_of(items.term)
                use = (row >= 0) & (weight > 0)
                item, row, w = items.item[use], row[use], weight[use]
                for g in range(0, len(items.ids), GROUP):
                    a, z = np.searchsorted(item, (g, g + GROUP))
                    descend(s, item[a:z], row[a:z], w[a:z], best)
        who, score, ids, _ = best.rows
        own = pa.array([items.ids[j] for j in who], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), own, pa.array(ids), pa.array(score)], names=["item", "item_id", "doc_id", "score"])
    return run


def search(shards: DataFrame, docs: int, items: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` best documents for each item (item_id, text): item_id, rank, doc_id, score."""
    spark = shards.sparkSession
    _bounded_batches(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    count, size = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-count // (ITEMS // 2)), -(-(size or 0) // (ITEM_BYTES // 2)))     # hashed evenly
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best_first = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    for i in range(blocks):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").collect()]
        block = Items(rows)
        if not len(block.term):
            continue
        df = dict(shards.select("terms", "df").mapInArrow(_frequencies(block.terms), "term long, n long").groupBy("term").sum("n").collect())
        weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(block.terms))], np.int64)
        found = (shards.mapInArrow(_search(block, weight, k), FOUND)
                 .withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
                 .select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"))
        out = found if blocks == 1 else out.union(found)
    return out


def op12_k2_treap_search(spark, sf_dir: str) -> DataFrame:
    shards, docs = index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(shards, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT d, doc_id, len(w) AS n, w FROM words WHERE len(w) > 0),
stats AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM docs),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM docs) GROUP BY d, term),
items AS (
  SELECT row_number() OVER () AS i, item_id,
         list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
  FROM benchmark WHERE text IS NOT NULL),
wanted AS (SELECT i, item_id, unnest(w) AS term FROM items),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM tf CROSS JOIN stats WHERE term IN (SELECT term FROM wanted) GROUP BY term, docs),
scored AS (
  SELECT i, item_id, d, doc_id,
         CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN docs USING (d) CROSS JOIN stats AS s(docs, total)
  GROUP BY i, item_id, d, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= 10
"""
