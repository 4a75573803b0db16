"""Substring de-duplication over bytes with suffix arrays and longest previous factors.

A byte is removed when a string of ``span`` bytes covering it also starts earlier: in a
document with a smaller id, or further left in the same one. In the suffix order of a
collection, a suffix' longest previous factor is its longest common prefix with the
previous or next suffix that starts at a smaller position; it has at least ``span``
bytes exactly when such an earlier string exists. The first copy has none and stays.

One suffix array over everything would sit in one place, so it is built in parts that
hold all occurrences of their strings:

1. Every string of ``span`` bytes belongs to its anchor, the smallest hash of its
   ``GRAM``-byte grams. Anchors (a few per hundred bytes) are shuffled; those that
   occur once belong to strings that occur once, and are done with.
2. Around the others the bytes are sent to the anchor's part. A task first settles the
   pieces that it already holds from an earlier place, so a passage that very many
   documents share leaves each task once.
3. Each part has a suffix array over the suffixes at its string starts, up to the ends of
   their pieces. Those whose first ``span`` bytes occur once are left out of it after the
   first rounds of sorting. The previous and the next smaller position in suffix order
   give two candidates, and the longer of the common prefixes with them is the longest
   previous factor; strings are copies where it has ``span`` bytes or more.
4. The union of a document's spans is cut out.

Documents are shuffled once, by id; both joins read that exchange.

Anchors are compared by 48-bit hash (a collision only sends more bytes to a part) and
equal pieces by 64-bit hash; strings are compared byte by byte. Defined results: a null
text is empty; a document without id is returned whole and is no reference; rows of
one id are no earlier than each other unless their starts differ, and each has its own text
cut (they are told apart by a 32-bit hash of the text); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.llm import textbytes as tb
from callwise.llm.lempel_ziv import covered, keyed, runs, sliding_min, span_lists, with_spans

GRAM = 32
FLUSH = 400_000          # anchors that a task holds before it sends them
HELD = 6 << 20           # bytes of pieces that a task holds before it sends them
SLICE = 1 << 20          # bytes of text looked at at a time
WORD = 7                 # bytes sorted at once, at 9 bits (there is an end mark beside the bytes)
JUMPS = 32               # rounds of jumps to a smaller position before halving
PARTS = 8                # parts for each shuffle partition: a part is sorted in memory
# (anchors are minima, hence small numbers: they are mixed again before they are dealt)


def anchored(raw: np.ndarray, off: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(text number, first start, number of starts, anchor) of the runs of neighbouring
    strings of ``span`` bytes that have one anchor at one place. (A text that repeats
    itself has the same anchor at several places, which must count as several.)"""
    starts = len(raw) - span + 1
    if starts <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    grams = tb.byte_windows(raw, GRAM)
    least = sliding_min(grams, span - GRAM + 1)
    # the leftmost smallest gram of a string is left behind when it is the string's first
    left = np.append(0, np.cumsum(grams[:starts] == least))
    size = np.diff(off)
    # strings must not cross texts
    inside = np.zeros(starts + 1, np.int32)
    long_ = np.flatnonzero(size >= span)
    np.add.at(inside, off[long_], 1)
    np.add.at(inside, off[long_ + 1] - span + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:starts]) > 0)
    doc = np.searchsorted(off, at, "right") - 1
    first = runs(doc, least[at], left[at])
    return doc[first], at[first] - off[doc[first]], np.diff(np.append(first, len(at))), least[at[first]]


ANCHORS = "shard int, hashes binary, docs binary, keys binary, starts binary"


def _anchors(span: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            doc, key, start, anchor = (np.concatenate(x) for x in zip(*held))
            rows = []
            for s, i in tb.dealt(tb.shard_of(tb.mix(anchor, 9), count), count):
                short = np.ascontiguousarray(anchor[i].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                rows.append((s, short, tb.planes(doc[i]), tb.planes(key[i].astype(np.int32)), tb.planes(start[i].astype(np.int32))))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], names=[x.split()[0] for x in ANCHORS.split(", ")])

        for batch in tb.slices(batches, limit=SLICE):
            doc, start, _, anchor = anchored(*tb.strings(batch.column("text")), span)
            if len(doc):
                held.append((tb.longs(batch.column("doc_id"))[doc], tb.longs(batch.column("key"))[doc], start, anchor))
                n += len(doc)
            if n > FLUSH:
                yield flush()
                held.clear()
                n = 0
        if n:
            yield flush()
    return run


def _shared(table: pa.Table) -> pa.Table:
    """The runs whose anchor occurs more than once."""
    col = {c: table.column(c).combine_chunks() for c in table.column_names}
    wide = np.zeros((sum(map(len, col["hashes"].to_pylist())) // 6, 8), np.uint8)
    wide[:, :6] = tb.unpack(col["hashes"], np.uint8).reshape(-1, 6)
    h = wide.view(np.uint64).ravel()
    o = np.argsort(h)
    same = h[o][1:] == h[o][:-1]
    keep = np.zeros(len(h), bool)
    keep[1:] |= same
    keep[:-1] |= same
    o = o[keep]
    return pa.table({"doc_id": pa.array(tb.from_planes(col["docs"], np.int64)[o]),
                     "key": pa.array(tb.from_planes(col["keys"], np.int32)[o].astype(np.int64)),
                     "start": pa.array(tb.from_planes(col["starts"], np.int32)[o].astype(np.int64)),
                     "one": pa.array(np.ones(len(o), np.int64))})


PIECES = "shard int, docs binary, keys binary, starts binary, counts binary, bytes binary, done binary"


LATER, FIRST, AGAIN = range(3)


def first_piece(piece: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """What each piece is among those with its hash: ``FIRST`` by document and start (in each
    text of one id that has it there), ``AGAIN`` the same text once more, or ``LATER``."""
    o = np.lexsort((key, start, doc, piece))
    out = np.zeros(len(o), np.int8)
    if len(o):
        p, d, x, a = piece[o], doc[o], key[o], start[o]
        head = runs(p)
        of = np.repeat(head, np.diff(np.append(head, len(o))))
        level = (d == d[of]) & (a == a[of])
        new = np.zeros(len(o), bool)
        new[runs(p, d, a, x)] = True
        out[o] = np.where(level, np.where(new, FIRST, AGAIN), LATER)
    return out


def _pieces(span: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            doc, key, start, strings, anchor, piece = (np.concatenate([h[i] for h in held]) for i in range(6))
            text = np.concatenate([h[6] for h in held])
            size = strings + span - 1
            at = np.cumsum(size) - size
            what = first_piece(piece, doc, key, start)
            first = what == FIRST
            rows: dict[int, list] = {}
            done = np.stack([doc, key, start, strings], 1)[what == LATER]
            for s, i in tb.dealt(tb.shard_of(tb.mix(done[:, 0].view(np.uint64)), count), count):
                rows.setdefault(s, [b""] * 6)[5] = done[i].tobytes()
            doc, key, start, strings, anchor, size, at = (x[first] for x in (doc, key, start, strings, anchor, size, at))
            for s, i in tb.dealt(tb.shard_of(tb.mix(anchor, 9), count), count):
                rows.setdefault(s, [b""] * 6)[:5] = [tb.planes(doc[i]), tb.planes(key[i].astype(np.int32)), tb.planes(start[i].astype(np.int32)), tb.planes(strings[i].astype(np.int32)),
                                                     text[np.repeat(at[i], size[i]) + tb.ragged(size[i])].tobytes()]
            keys = list(rows)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array([rows[s][c] for s in keys], pa.binary()) for c in range(6))],
                                              names=[x.split()[0] for x in PIECES.split(", ")])

        # texts without spans are left out here: a filter on the join would change the
        # exchange of the documents, which the join that cuts the spans out reads again
        marked = (b.filter(pc.greater(pc.list_value_length(b.column("starts")), 0)) for b in batches)
        for batch in tb.slices(marked, limit=SLICE):
            raw, off = tb.strings(batch.column("text"))
            row, wanted, _ = span_lists(batch)
            doc, start, strings, anchor = anchored(raw, off, span)
            keep = np.isin(doc << 40 | start, row << 40 | wanted)
            doc, start, strings, anchor = (x[keep] for x in (doc, start, strings, anchor))
            if len(doc):
                size, begin = strings + span - 1, off[doc] + start
                piece = tb.span_hash(tb.prefix_sums(tb._BYTE[raw]), begin, begin + size)
                held.append((tb.longs(batch.column("doc_id"))[doc], tb.longs(batch.column("key"))[doc], start, strings, anchor, piece, raw[np.repeat(begin, size) + tb.ragged(size)]))
                n += int(size.sum())
            if n > HELD:
                yield flush()
                held.clear()
                n = 0
        if n:
            yield flush()
    return run


def ranks(key: np.ndarray) -> np.ndarray:
    """Rank of every key in their order, from 1; equal keys have equal ranks."""
    o = np.argsort(key)
    new = np.ones(len(o), np.int32)
    new[1:] = key[o][1:] != key[o][:-1]
    out = np.empty(len(o), np.int32)
    out[o] = np.cumsum(new, dtype=np.int32)
    return out


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.int64) << 32 | right


class Suffixes:
    """Suffixes of a part's pieces, each ending with its piece, with the ranks of their
    first 7, 14, 28 ... bytes (prefix doubling up to ``span``)."""

    def __init__(self, text: np.ndarray, size: np.ndarray, span: int):
        # every piece is followed by an end mark that is smaller than all bytes
        self.size = size
        self.begin = np.cumsum(size + 1) - size - 1
        self.n = len(text) + len(size)
        byte = np.zeros(self.n + WORD, np.int64)
        byte[np.repeat(self.begin, size) + tb.ragged(size)] = text.astype(np.int64) + 1
        self.word = np.zeros(self.n, np.int64)
        for i in range(WORD):
            self.word = self.word << 9 | byte[i:i + self.n]
        self.levels = [(WORD, ranks(self.word))]
        while 2 * self.levels[-1][0] <= span:
            have, rank = self.levels[-1]
            self.levels.append((2 * have, ranks(joined(rank, self.ahead(rank, np.arange(self.n), have)))))

    def ahead(self, rank: np.ndarray, at: np.ndarray, by: int) -> np.ndarray:
        """``rank`` of the suffixes ``by`` bytes further on; 0 past the end."""
        to = at + by
        return np.where(to < self.n, rank[np.minimum(to, self.n - 1)], 0)

    def heads(self, at: np.ndarray, span: int) -> np.ndarray:
        """Ranks of the strings of ``span`` bytes that start at ``at``."""
        have, rank = self.levels[-1]
        return ranks(joined(rank[at], rank[at + span - have]))

    def order(self, at: np.ndarray, end: np.ndarray, head: np.ndarray, span: int) -> np.ndarray:
        """Suffix order of the suffixes ``at`` (with ``head`` as ranks of their first
        ``span`` bytes) up to the ends of their pieces; equal ones from right to left."""
        have, rank = self.levels[-1]
        seen = span
        while len(at) and seen < int((end - at).max()):
            tail = np.where(at + seen < end, self.ahead(rank, at, seen), 0)
            head = ranks(joined(head, tail))
            seen += have
        return np.argsort(joined(head, np.arange(len(at))[::-1]))

    def common(self, p: np.ndarray, q: np.ndarray, end_p: np.ndarray, end_q: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes p and q."""
        most = np.minimum(end_p - p, end_q - q)
        out = np.zeros(len(p), np.int64)
        widest = self.levels[-1]
        for width, rank in [widest] * (int(most.max(initial=0)) // widest[0]) + self.levels[::-1]:
            left = self.ahead(rank, p, out)
            out += width * ((left > 0) & (left == self.ahead(rank, q, out)))
        # the digits of the next words say how many more bytes are equal
        x = self.ahead(self.word, p, out) ^ self.ahead(self.word, q, out)
        for i in range(WORD):
            out += x >> 9 * i == 0
        return np.minimum(out, most)


def smaller_before(v: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each, or -1. Every entry jumps along the
    answers of the entries it passes; what is open after ``JUMPS`` is found by halving, in
    minima of 2, 4, 8 ... values, so no order of the values makes it slow."""
    out = np.arange(-1, len(v) - 1)
    open_ = np.flatnonzero((out >= 0) & (v[out] >= v)) if len(v) else out
    for _ in range(JUMPS):
        if not len(open_):
            return out
        out[open_] = out[out[open_]]
        to = out[open_]
        open_ = open_[(to >= 0) & (v[to] >= v[open_])]
    least = [v]
    while 2 << len(least) - 1 <= len(v):
        half = 1 << len(least) - 1
        m = least[-1].copy()
        m[half:] = np.minimum(m[half:], least[-1][:-half])
        least.append(m)
    to = out[open_]
    for k in range(len(least) - 1, -1, -1):
        # all of the 2^k values that end at ``to`` are passed when none is smaller
        ok = (to >= 0) & (least[k][to] >= v[open_])
        to = np.where(ok, np.maximum(to - (1 << k), -1), to)
    out[open_] = to
    return out


def previous_factors(text: np.ndarray, size: np.ndarray, strings: np.ndarray, place: np.ndarray,
                     span: int) -> np.ndarray:
    """Longest previous factors of the first ``strings`` suffixes of each piece: the longest
    common prefix with a suffix of a smaller ``place``. It is exact from ``span`` bytes on;
    for suffixes whose string of ``span`` bytes occurs once it is less and given as 0.

    In suffix order the earlier suffix that shares most with one is the nearest before or
    after it with a smaller place."""
    out = np.zeros(len(place), np.int64)
    if not len(place):
        return out
    s = Suffixes(text, size, span)
    at = np.repeat(s.begin, strings) + tb.ragged(strings)
    end = np.repeat(s.begin + size, strings)
    head = s.heads(at, span)
    again = np.flatnonzero(np.bincount(head)[head] > 1)
    if not len(again):
        return out
    at, end, place, head = at[again], end[again], place[again], head[again]
    order = s.order(at, end, head, span)
    at, end, v = at[order], end[order], place[order]
    before = smaller_before(v)
    after = len(v) - 1 - smaller_before(v[::-1])[::-1]
    best = np.zeros(len(v), np.int64)
    for other in (before, after):
        i = np.flatnonzero((other >= 0) & (other < len(v)))
        j = other[i]
        best[i] = np.maximum(best[i], s.common(at[i], at[j], end[i], end[j]))
    out[again[order]] = best
    return out


def positions(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers in the order of (document, place); equal pairs have equal numbers."""
    o = np.lexsort((place, doc))
    head = np.zeros(len(o), np.int32)
    if len(o):
        head[runs(doc[o], place[o])] = 1
    out = np.empty(len(o), np.int32)
    out[o] = np.cumsum(head, dtype=np.int32)
    return out


SPANS = "doc_id long, key long, start long, strings long"


def _factors(span: int):
    def run(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).combine_chunks() for c in table.column_names}
        doc = tb.from_planes(col["docs"], np.int64)
        key, start, strings = (tb.from_planes(col[c], np.int32).astype(np.int64) for c in ("keys", "starts", "counts"))
        text = tb.unpack(col["bytes"], np.uint8)
        size = strings + span - 1
        begin = np.cumsum(size) - size
        piece = tb.span_hash(tb.prefix_sums(tb._BYTE[text]), begin, begin + size)
        what = first_piece(piece, doc, key, start)
        done = np.stack([doc, key, start, strings], 1)[what == LATER]
        # the other pieces, in order of document and start: positions rise with it
        o = np.flatnonzero(what == FIRST)
        o = o[np.lexsort((start[o], doc[o]))]
        doc, key, start, strings, size, begin = (x[o] for x in (doc, key, start, strings, size, begin))
        text = text[np.repeat(begin, size) + tb.ragged(size)]
        doc, key, place = np.repeat(doc, strings), np.repeat(key, strings), np.repeat(start, strings) + tb.ragged(strings)
        # a string at the same place of another text of the same id is no earlier
        number = positions(doc, place)
        copy = previous_factors(text, size, strings, number, span) >= span
        doc, key, place = doc[copy], key[copy], place[copy]
        head = runs(doc, key, place - np.arange(len(place))) if len(doc) else np.zeros(0, np.int64)
        found = np.stack([doc[head], key[head], place[head], np.diff(np.append(head, len(doc)))], 1)
        out = np.concatenate([found, done, tb.unpack(col["done"], np.int64).reshape(-1, 4)])
        return pa.table({n.split()[0]: pa.array(out[:, i]) for i, n in enumerate(SPANS.split(", "))})
    return run


def duplicate_strings(docs: DataFrame, span: int = 100) -> DataFrame:
    """Spans (doc_id, key of the text, start byte, strings): the strings of ``span`` bytes starting at
    start .. start + strings - 1 also start earlier."""
    if span < GRAM:
        raise ValueError(f"span must be at least {GRAM} bytes")
    spark = tb.text_session(docs.sparkSession)
    count = tb.shards(spark)
    known = keyed(docs).where("doc_id is not null")
    shared = (known.mapInArrow(_anchors(span, count), ANCHORS)
              .groupBy("shard").applyInArrow(_shared, "doc_id long, key long, start long, one long"))
    return (with_spans(docs, shared, "one")
            .mapInArrow(_pieces(span, PARTS * count // 2), PIECES).groupBy("shard").applyInArrow(_factors(span), SPANS))


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            raw, off = tb.strings(batch.column("text"))
            row, start, strings = span_lists(batch)
            first = off[row] + start
            gone = covered(len(raw), first, first + strings + span - 1)
            n = len(off) - 1
            doc = np.repeat(np.arange(n), np.diff(off))
            head = gone.copy()
            head[1:] &= ~gone[:-1] | (doc[1:] != doc[:-1])
            removed = np.bincount(doc[gone], minlength=n)
            at = np.concatenate([[0], np.cumsum(np.diff(off) - removed)])
            kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(raw[~gone].tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off)), pa.array(removed), pa.array(np.bincount(doc[head], minlength=n)), kept],
                                             names=[x.split()[0] for x in CUT.split(", ")])
    return run


def without_copies(docs: DataFrame, span: int = 100) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (removed runs) and kept,
    the bytes that are left."""
    return with_spans(docs, duplicate_strings(docs, span), "strings").mapInArrow(_cut(span), CUT)


def op10_suffix_lpf(spark, sf_dir: str) -> DataFrame:
    kept = without_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
