"""Substring de-duplication by relative Lempel-Ziv factors over words.

A duplicate is a run of ``span`` words that also occurs in a document with a smaller
id. Documents are factored against reference blocks that hold all documents:

* every window of ``span`` words belongs to the block of its anchor, the smallest
  hash of its ``GRAM``-word grams. Equal windows have equal anchors, so each block
  indexes all occurrences of its windows, and neighbouring windows mostly share one;
* a block is an index of its windows, and its documents are parsed greedily against it: a
  window that an earlier document also has starts a factor, which goes on word by word in
  the earliest such document to the first word that differs (or the edge of the block's
  neighbouring windows). At that boundary every shift of the window is looked up in turn,
  so no copy over the boundary is lost. Factors are of ``span`` words or more;
* factors become spans; the union of a document's spans is removed.

Before anything is shuffled a task parses its documents against its own earlier ones, so a passage that very many documents share leaves each task once.

Windows are compared by 64-bit anchor and 48-bit window hash together. Defined results:
a null or blank text has no words; a document without id is returned whole and is no
reference; rows of one id are no earlier than each other, and each has its own text cut (they
are told apart by a 32-bit hash of the text); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.llm import textbytes as tb

GRAM = 8
FLUSH = 1_500_000        # windows a task holds before it settles and sends them


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    rest = width - have
    return np.minimum(v[:-rest], v[rest:]) if rest else v


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs in which all keys stay equal."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def earliest(window: np.ndarray) -> np.ndarray:
    """The index of a reference block: for every window the first place with an equal one."""
    o = np.argsort(window)
    start = runs(window[o])
    least = np.minimum.reduceat(o, start) if len(start) else o
    out = np.empty(len(o), np.int64)
    out[o] = np.repeat(least, np.diff(np.append(start, len(o))))
    return out


def parse(window: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy relative factors (first window, number of windows, first window in the
    reference) of a block of runs of windows, in order of document and place. ``end`` is
    where each window's run ends.

    All runs are parsed at the same time: the next window that an earlier document has is
    looked up in the index, and the match goes on word by word, in that document, to the
    first word that differs or the end of a run. The windows over that boundary are looked
    up one after the other as the next starts, so none of them is lost."""
    n = len(window)
    ref = earliest(window)
    hits = np.flatnonzero(doc > doc[ref]) if n else np.zeros(0, np.int64)
    # how far the index itself goes on in step, which spares looking at each word
    goes_on = np.zeros(n, bool)
    goes_on[:-1] = (ref[1:] == ref[:-1] + 1) & (end[1:] == end[:-1]) & (end[ref[1:]] == end[ref[:-1]])
    stops = np.flatnonzero(~goes_on)
    out = []

    def next_hit(at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        k = np.searchsorted(hits, at)
        found = k < len(hits)
        to = hits[np.minimum(k, len(hits) - 1)]
        return to[found & (to < stop)]

    at = next_hit(np.flatnonzero(np.append(True, end[1:] != end[:-1])), np.unique(end)) if len(hits) else hits
    while len(at):
        here, there = at.copy(), ref[at]
        going = np.arange(len(at))
        while len(going):
            q, r = here[going], there[going]
            step = np.where(ref[q] == r, stops[np.searchsorted(stops, q)] - q, 0)
            q, r = q + step + 1, r + step + 1
            here[going], there[going] = q, r
            more = (q < end[at[going]]) & (r < end[ref[at[going]]])
            more[more] = window[q[more]] == window[r[more]]
            going = going[more]
        out.append((at, here - at, ref[at]))
        at = next_hit(here, end[at])
    if not out:
        return hits, hits, hits
    return tuple(np.concatenate(x) for x in zip(*out))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of the text that tells rows of one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("key"))


def in_order(doc: np.ndarray, key: np.ndarray, at: np.ndarray, *columns: np.ndarray):
    """Windows by document, text and place, and where each one's run of neighbours ends."""
    if (np.diff(doc) < 0).any() or len(runs(doc)) < len(runs(doc, key, at - np.arange(len(at)))):
        o = np.lexsort((at, key, doc))
        doc, key, at, columns = doc[o], key[o], at[o], [c[o] for c in columns]
    start = runs(doc, key, at - np.arange(len(at)))
    stop = np.append(start, len(at))[1:]
    return doc, key, at, columns, np.repeat(stop, stop - start)


DEALT = "shard int, anchors binary, docs binary, keys binary, starts binary, counts binary, windows binary, done binary"


def _deal(span: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            doc, key, at, anchor, window = (np.concatenate(x) for x in zip(*held))
            doc, key, at, (anchor, window), end = in_order(doc, key, at, anchor, window)
            first, length, ref = parse(window, doc, end)
            settled = covered(len(doc), first, first + length)
            rows: dict[int, list] = {}
            found = np.stack([doc[first], key[first], at[first], length, doc[ref]], 1)
            for s, i in tb.dealt(tb.shard_of(tb.mix(found[:, 0].view(np.uint64)), count), count):
                rows.setdefault(s, [b""] * 7)[6] = found[i].tobytes()
            doc, key, at, anchor, window = (x[~settled] for x in (doc, key, at, anchor, window))
            start = runs(doc, key, at - np.arange(len(at)), anchor) if len(at) else np.zeros(0, np.int64)
            length = np.diff(np.append(start, len(at)))
            short = np.ascontiguousarray(window.view(np.uint8).reshape(-1, 8)[:, :6])
            for s, i in tb.dealt(tb.shard_of(tb.mix(anchor[start], 9), count), count):
                one = np.repeat(start[i], length[i]) + tb.ragged(length[i])
                rows.setdefault(s, [b""] * 7)[:6] = [anchor[start[i]].tobytes(), doc[start[i]].tobytes(), key[start[i]].astype(np.int32).tobytes(), at[start[i]].astype(np.int32).tobytes(),
                                                     length[i].astype(np.int32).tobytes(), short[one].tobytes()]
            keys = list(rows)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array([rows[s][c] for s in keys], pa.binary()) for c in range(7))],
                                              names=[x.split()[0] for x in DEALT.split(", ")])

        for batch in tb.slices(batches):
            w = tb.Words(*tb.strings(batch.column("text")))
            at = w.windows(span)
            if not len(at):
                continue
            h = w.hashes()
            anchor = sliding_min(tb.rolling(h, GRAM), span - GRAM + 1)[at]
            held.append((tb.longs(batch.column("doc_id"))[w.doc[at]], tb.longs(batch.column("key"))[w.doc[at]], at - w.first[w.doc[at]], anchor, tb.rolling(h, span)[at]))
            n += len(at)
            if n > FLUSH:
                yield flush()
                held.clear()
                n = 0
        if n:
            yield flush()
    return run


SPANS = "doc_id long, key long, start long, windows long, reference long"


def _parse(table: pa.Table) -> pa.Table:
    """A reference block: the factors of its documents that an earlier document has."""
    col = {c: table.column(c).combine_chunks() for c in table.column_names}
    anchor, doc = tb.unpack(col["anchors"], np.uint64), tb.unpack(col["docs"], np.int64)
    key = tb.unpack(col["keys"], np.int32).astype(np.int64)
    start, length = tb.unpack(col["starts"], np.int32).astype(np.int64), tb.unpack(col["counts"], np.int32)
    wide = np.zeros((int(length.sum()), 8), np.uint8)
    wide[:, :6] = tb.unpack(col["windows"], np.uint8).reshape(-1, 6)
    window = tb.mix(wide.view(np.uint64).ravel() ^ np.repeat(tb.mix(anchor, 1), length), 2)
    doc, key, at = np.repeat(doc, length), np.repeat(key, length), np.repeat(start, length) + tb.ragged(length)
    del wide
    doc, key, at, (window,), end = in_order(doc, key, at, window)
    first, length, ref = parse(window, doc, end)
    done = tb.unpack(col["done"], np.int64).reshape(-1, 5)
    out = np.concatenate([np.stack([doc[first], key[first], at[first], length, doc[ref]], 1), done])
    return pa.table({n.split()[0]: pa.array(out[:, i]) for i, n in enumerate(SPANS.split(", "))})


def duplicate_spans(docs: DataFrame, span: int = 50) -> DataFrame:
    """Factors (doc_id, key of the text, start word, number of windows, reference document): the words
    start .. start + windows + span - 2 are copies."""
    spark = tb.text_session(docs.sparkSession)
    known = keyed(docs).where("doc_id is not null")
    return (known.mapInArrow(_deal(span, tb.shards(spark)), DEALT)
            .groupBy("shard").applyInArrow(_parse, SPANS))


def covered(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Marks the places 0..n-1 that some [first, end) covers."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, first, 1)
    np.add.at(depth, end, -1)
    return np.cumsum(depth[:n]) > 0


def span_lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of all spans of a batch with array columns starts and lengths."""
    starts, lengths = batch.column("starts"), batch.column("lengths")
    row = np.asarray(pc.list_parent_indices(starts), np.int64)
    return row, np.asarray(starts.flatten(), np.int64), np.asarray(lengths.flatten(), np.int64)


CUT = "doc_id long, n_words long, n_removed long, kept string"


def _cut(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            raw, off = tb.strings(batch.column("text"))
            w = tb.Words(raw, off)
            row, start, length = span_lists(batch)
            first = w.first[row] + start
            gone = covered(len(w.starts), first, first + length + span - 1)
            keep = np.flatnonzero(~gone)
            # a kept word brings the blank after it, unless it is the last one kept of its document
            doc = w.doc[keep]
            last = np.append(doc[1:] != doc[:-1], True)[:len(doc)]
            size = w.ends[keep] - w.starts[keep] + ~last
            out = np.append(raw, np.uint8(32))[np.minimum(np.repeat(w.starts[keep], size) + tb.ragged(size), len(raw))]
            end = np.cumsum(size)
            out[end[~last] - 1] = 32
            at = np.concatenate([[0], np.cumsum(np.bincount(doc, size, w.docs).astype(np.int64))])
            removed = w.counts - np.bincount(doc, minlength=w.docs)
            kept = pa.Array.from_buffers(pa.string(), w.docs, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w.counts), pa.array(removed), kept], names=["doc_id", "n_words", "n_removed", "kept"])
    return run


def with_spans(docs: DataFrame, spans: DataFrame, length: str) -> DataFrame:
    """doc_id, text and key with the arrays starts and lengths of the text's spans."""
    lists = (spans.withColumn("key", F.col("key").cast("int")).groupBy("doc_id", "key")
             .agg(F.collect_set(F.struct("start", length)).alias("s")))
    return (keyed(docs).join(lists, ["doc_id", "key"], "left")
            .select("doc_id", "text", "key", F.expr("coalesce(s.start, cast(array() as array<bigint>))").alias("starts"),
                    F.expr(f"coalesce(s.{length}, cast(array() as array<bigint>))").alias("lengths")))


def without_copies(docs: DataFrame, span: int = 50) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept, the words that are left
    joined by one space. The first document with a passage keeps it."""
    spans = duplicate_spans(docs, span)
    return with_spans(docs, spans, "windows").mapInArrow(_cut(span), CUT)


def op8_relative_lempel_ziv(spark, sf_dir: str) -> DataFrame:
    kept = without_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
