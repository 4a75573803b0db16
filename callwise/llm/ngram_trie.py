"""Language-model scores from a sharded Elias-Fano n-gram trie.

Model: bigrams with a Dirichlet prior on the unigram distribution,
p(w | v) = (c(v, w) + K p(w)) / (c(v) + K) with p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),
which sums to one over the V known words and one unknown word for every context. A text
is its lower-cased words and one end token.

The logarithm splits into a term of (v, w), kept with w, and a term of v alone, which is
added where v itself is the predicted word. So tokens are dealt once, by predicted word;
a word holding more than a fixed share of all tokens is dealt by word and context, its
count known from a list that this share bounds.

Each shard builds its trie of training n-grams in Elias-Fano levels: the words' hashes,
monotone pointers from a word to its contexts, and the contexts' hashes, relative to
their word (the word's number in front makes the level monotone). Log probabilities
are quantised to 16 bits over each level's range. The trie is one byte string; it is
written to a scratch file of the task, mapped into memory and queried in key order by
successor search inside blocks, so that only blocks in use are unpacked. ``model`` returns
the tries themselves.

Words are known by 64-bit hash, contexts within a word by 40 bits. Defined results: a
null or empty text is only the end token; a document without id is scored, not trained
on, and its held_out is null; repeated rows are each trained on and scored; an empty
training set scores with the unknown word alone; other columns are ignored.
"""

from __future__ import annotations

import mmap
import struct
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.llm import textbytes as tb

PRIOR = 1000.0           # K, in tokens
FOLDS, HELD_OUT = 5, 1
HOT = 4                  # a word over 1 / (HOT * shards) of all tokens is dealt by context too
FLUSH = 1_200_000        # tokens a task holds before it deals them
CONTEXT_BITS = 40
BLOCK = 1 << 15          # values unpacked at a time
END, START = np.uint64(0x1), np.uint64(0x2)


class EliasFano:
    """A rising sequence: low bytes as they are, high parts as gaps in unary."""

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        n = len(values)
        base = int(values[0]) if n else 0
        rest = values - np.uint64(base)
        top = int(rest[-1]) if n else 0
        low = 0
        while low < 8 and (top >> 8 * low) > 4 * max(n, 1):
            low += 1
        high = (rest >> np.uint64(8 * low)).astype(np.int64) if low < 8 else np.zeros(n, np.int64)
        place = high + np.arange(n)
        bits = np.zeros(int(place[-1]) + 1 if n else 0, np.uint8)
        bits[place] = 1
        lows = np.ascontiguousarray(rest.view(np.uint8).reshape(n, 8)[:, :low]).tobytes() if n else b""
        starts = place[::BLOCK].astype(np.int64)       # where each block's bits begin
        firsts = values[::BLOCK]
        unary = np.packbits(bits).tobytes()
        return struct.pack("<QQQQ", n, base, low, len(unary)) + starts.tobytes() + firsts.tobytes() + lows + unary

    def __init__(self, data, at: int = 0):
        self.n, self.base, self.low, unary = struct.unpack_from("<QQQQ", data, at)
        blocks = -(-self.n // BLOCK)
        at += 32
        self.starts = np.frombuffer(data, np.int64, blocks, at)
        self.firsts = np.frombuffer(data, np.uint64, blocks, at + 8 * blocks)
        at += 16 * blocks
        self.lows = np.frombuffer(data, np.uint8, self.n * self.low, at).reshape(self.n, self.low)
        at += self.n * self.low
        self.unary = np.frombuffer(data, np.uint8, unary, at)
        self.end = at + unary

    def block(self, b: int) -> np.ndarray:
        first, last = b * BLOCK, min((b + 1) * BLOCK, self.n)
        start = int(self.starts[b])
        stop = int(self.starts[b + 1]) if b + 1 < len(self.starts) else len(self.unary) * 8
        bits = np.unpackbits(self.unary[start // 8:-(-stop // 8)])[start % 8:start % 8 + stop - start]
        high = np.flatnonzero(bits)[:last - first] + start - np.arange(first, last)
        low = np.zeros((last - first, 8), np.uint8)
        low[:, :self.low] = self.lows[first:last]
        high = high.astype(np.uint64) << np.uint64(8 * self.low) if self.low < 8 else np.uint64(0)
        return high + low.view(np.uint64).ravel() + np.uint64(self.base)

    def successors(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first value that is not smaller, whether it is equal) for rising keys."""
        where, equal = np.full(len(keys), self.n, np.int64), np.zeros(len(keys), bool)
        if not self.n or not len(keys):
            return where, equal
        block = np.maximum(np.searchsorted(self.firsts, keys, "right") - 1, 0)
        cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for s, e in zip(cut, np.append(cut[1:], len(keys))):
            values = self.block(int(block[s]))
            i = np.searchsorted(values, keys[s:e])
            equal[s:e] = values[np.minimum(i, len(values) - 1)] == keys[s:e]
            where[s:e] = i + int(block[s]) * BLOCK
        return where, equal

    def values(self) -> np.ndarray:
        return np.concatenate([self.block(b) for b in range(len(self.starts))]) if self.n else np.zeros(0, np.uint64)


def quantised(v: np.ndarray) -> bytes:
    low, high = (float(v.min()), float(v.max())) if len(v) else (0.0, 0.0)
    step = (high - low) / 65535 or 1.0
    return struct.pack("<Qdd", len(v), low, step) + np.rint((v - low) / step).astype(np.uint16).tobytes()


class Quantised:
    def __init__(self, data, at: int):
        n, self.lowest, self.step = struct.unpack_from("<Qdd", data, at)
        self.codes = np.frombuffer(data, np.uint16, n, at + 24)
        self.end = at + 24 + 2 * n

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return self.lowest + self.step * self.codes[i]


def relative(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Keys of the context level: the word's number, then the context's hash."""
    return (word.astype(np.uint64) << np.uint64(CONTEXT_BITS)) + context


class Trie:
    """Words with counts and log terms; their contexts with log numerators."""

    @staticmethod
    def build(word: np.ndarray, context: np.ndarray, totals: dict[int, int], n: int, v: int, k: float) -> bytes:
        """From training tokens (word and context hashes) in rising order. ``totals`` has
        the counts of the words whose tokens are in several shards; n and v are N and V."""
        new = np.append(True, word[1:] != word[:-1])[:len(word)]
        start = np.flatnonzero(new)
        # a hot word is in every shard's trie: its training tokens may all be in other shards
        words = np.union1d(word[start], np.array(list(totals), np.uint64))
        number = np.searchsorted(words, word[start])
        count = np.zeros(len(words), np.int64)
        count[number] = np.diff(np.append(start, len(word)))
        for w, c in totals.items():
            count[np.searchsorted(words, np.uint64(w))] = c
        pair = np.flatnonzero(new | np.append(True, context[1:] != context[:-1])[:len(word)])
        owner = number[(np.cumsum(new) - 1)[pair]]
        keys, pair = relative(owner, context[pair]), np.diff(np.append(pair, len(word)))
        prior = k * (count + 0.5) / (n + 0.5 * (v + 1))
        pointers = np.searchsorted(owner, np.arange(len(words) + 1))
        return b"".join((EliasFano.pack(words), EliasFano.pack(count.cumsum()), EliasFano.pack(pointers), EliasFano.pack(keys),
                         quantised(np.log10(prior)), quantised(np.log10(count + k)), quantised(np.log10(pair + prior[owner]))))

    def __init__(self, data):
        at, parts = 0, []
        for kind in (EliasFano,) * 4 + (Quantised,) * 3:
            parts.append(kind(data, at))
            at = parts[-1].end
        self.words, self.totals, self.pointers, self.contexts, self.backoff, self.mass, self.seen = parts
        self.counts = np.diff(self.totals.values().astype(np.int64), prepend=0)

    def query(self, word: np.ndarray, context: np.ndarray, unknown: float, k: float) -> tuple[np.ndarray, ...]:
        """(count of the word, log numerator, log mass of the word as a context) of tokens
        in rising order of word and context."""
        new = np.append(True, word[1:] != word[:-1])[:len(word)]
        distinct = np.cumsum(new) - 1
        number, known = self.words.successors(word[new])
        number, known = number[distinct], known[distinct]
        count = np.zeros(len(word), np.int64)
        top, mass = np.full(len(word), unknown), np.full(len(word), np.log10(k))
        i = np.flatnonzero(known)
        count[i], top[i], mass[i] = self.counts[number[i]], self.backoff[number[i]], self.mass[number[i]]
        where, seen = self.contexts.successors(relative(number[i], context[i]))
        top[i[seen]] = self.seen[where[seen]]
        return count, top, mass


def mapped(data: bytes) -> mmap.mmap:
    """``data`` as a memory map of a scratch file of this task, which is already unlinked."""
    with tempfile.TemporaryFile() as f:
        f.write(data)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def held_out(ids: list) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids], bool)


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the batch, token hash, hash of the token before it), each text closed by END."""
    raw, off = tb.strings(batch.column("text"))
    w = tb.Words(tb.lower_ascii(raw), off)
    at = np.arange(len(w.starts)) + w.doc                     # one place more for each earlier text
    out = np.full(len(w.starts) + w.docs, END, np.uint64)
    out[at] = np.maximum(w.hashes(), np.uint64(3))
    row = np.repeat(np.arange(w.docs), w.counts + 1)
    before = np.append(START, out[:-1])[:len(out)]
    before[w.first[:-1] + np.arange(w.docs)] = START
    return row, out, before


COUNTS = "shard int, words binary, counts binary"


def _count(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            word = np.concatenate([h[0] for h in held])
            o = np.argsort(word)
            word, c = word[o], np.concatenate([h[1] for h in held])[o]
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            word, c = word[start], np.add.reduceat(c, start)
            rows = [(s, tb.planes(word[i]), tb.planes(c[i])) for s, i in tb.dealt(tb.shard_of(word, count), count)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["shard", "words", "counts"])

        for batch in tb.slices(batches):
            ids = batch.column("doc_id").to_pylist()
            row, word, _ = tokens(batch)
            train = ~held_out(ids) & np.array([i is not None for i in ids], bool)
            word = word[train[row]]
            if len(word):
                held.append(np.unique(word, return_counts=True))
                n += len(held[-1][0])
            if n > FLUSH // 2:
                yield flush()
                held.clear()
                n = 0
        if n:
            yield flush()
    return run


def _total(table: pa.Table) -> pa.Table:
    col = {c: table.column(c).combine_chunks() for c in table.column_names}
    word, back = np.unique(tb.from_planes(col["words"], np.uint64), return_inverse=True)
    c = np.bincount(back, tb.from_planes(col["counts"], np.int64), len(word)).astype(np.int64)
    return pa.table({"word": pa.array(word.view(np.int64)), "n": pa.array(c)})


def unigrams(docs: DataFrame) -> DataFrame:
    """(word hash, n) of the training tokens."""
    count = tb.shards(tb.text_session(docs.sparkSession))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count(count), COUNTS)
            .groupBy("shard").applyInArrow(_total, "word long, n long"))


DEALT = "shard int, words binary, counts binary, contexts binary, rows binary, docs binary"


def _deal(count: int, hot: list[int]):
    """Task: tokens dealt by word, as blobs in order of the word; rows are numbered
    ``2 * row + trained on``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, held, n = np.array(sorted(hot), np.uint64), [], 0
        made = TaskContext.get().partitionId() << 32

        def flush():
            docs, word, context, row = (np.concatenate([h[i] for h in held]) for i in range(4))
            shard = tb.shard_of(word, count)
            often = np.isin(word, common)
            shard[often] = tb.shard_of(tb.mix(word[often] ^ tb.mix(context[often]), 4), count)
            out: dict[int, list] = {}
            o = np.argsort(word)
            for s, i in tb.dealt(shard[o], count):
                i = o[i]
                w = word[i]
                start = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                short = context[i].view(np.uint8).reshape(-1, 8)[:, :CONTEXT_BITS // 8]
                out.setdefault(s, [b""] * 5)[:4] = [tb.planes(w[start]), tb.planes(np.diff(np.append(start, len(w))).astype(np.int32)),
                                                    np.ascontiguousarray(short).tobytes(), tb.planes(row[i])]
            for s, i in tb.dealt(tb.shard_of(tb.mix(docs[:, 0].view(np.uint64) >> np.uint64(8)), count), count):
                out.setdefault(s, [b""] * 5)[4] = docs[i].tobytes()
            keys = list(out)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array([out[s][c] for s in keys], pa.binary()) for c in range(5))],
                                              names=[x.split()[0] for x in DEALT.split(", ")])

        for batch in tb.slices(batches):
            ids = batch.column("doc_id").to_pylist()
            row, word, context = tokens(batch)
            away, some = held_out(ids), np.array([i is not None for i in ids], bool)
            number = made + np.arange(len(ids))
            made += len(ids)
            docs = np.stack([number, tb.longs(batch.column("doc_id")), np.bincount(row, minlength=len(ids)), np.where(some, away, 2)], 1)
            held.append((docs, word, context, (number * 2 + (some & ~away))[row]))
            n += len(word)
            if n > FLUSH:
                yield flush()
                held.clear()
                n = 0
        if held:
            yield flush()
    return run


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, row) of a shard's tokens in rising order of word and context."""
    col = {c: table.column(c).combine_chunks() for c in ("words", "counts", "contexts", "rows")}
    word = np.repeat(tb.from_planes(col["words"], np.uint64), tb.from_planes(col["counts"], np.int32))
    wide = np.zeros((len(word), 8), np.uint8)
    wide[:, :CONTEXT_BITS // 8] = tb.unpack(col["contexts"], np.uint8).reshape(len(word), -1)
    context, row = wide.view(np.uint64).ravel(), tb.from_planes(col["rows"], np.int64)
    o = np.lexsort((context, word))
    return word[o], context[o], row[o]


SUMS = "bucket int, rows binary, base binary, score binary, known binary, docs binary"


def _score(n: int, v: int, totals: dict[int, int], k: float, count: int):
    """Shard: builds its trie, scores its tokens, and sums them up for each row."""
    def run(table: pa.Table) -> pa.Table:
        word, context, row = _unpacked(table)
        train = (row & 1) == 1
        trie = Trie(mapped(Trie.build(word[train], context[train], totals, n, v, k)))
        size = n + 0.5 * (v + 1)
        c, top, mass = trie.query(word, context, np.log10(k * 0.5 / size), k)
        score = top - np.where(word == END, 0.0, mass)
        base = np.log10((c + 0.5) / size)
        known = c > 0
        trie = word = context = train = top = mass = c = None       # a shard's arrays are large
        o = np.argsort(row)
        row = row[o] >> 1
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])[:len(row)])
        rows = row[first]
        sums = [np.add.reduceat(x[o], first) if len(first) else x[:0] for x in (base, score, known.astype(np.int64))]
        out: dict[int, list] = {}
        for s, i in tb.dealt(tb.shard_of(tb.mix(rows.view(np.uint64) >> np.uint64(8)), count), count):
            out[s] = [tb.planes(rows[i]), sums[0][i].tobytes(), sums[1][i].tobytes(), tb.planes(sums[2][i].astype(np.int32)), b""]
        docs = tb.unpack(table.column("docs"), np.int64).reshape(-1, 4)
        for s, i in tb.dealt(tb.shard_of(tb.mix(docs[:, 0].view(np.uint64) >> np.uint64(8)), count), count):
            out.setdefault(s, [b""] * 5)[4] = docs[i].tobytes()
        keys = list(out)
        return pa.table([pa.array(keys, pa.int32()), *(pa.array([out[s][c] for s in keys], pa.binary()) for c in range(5))],
                        names=[x.split()[0] for x in SUMS.split(", ")])
    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sum(n: int, start: float):
    def run(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).combine_chunks() for c in table.column_names}
        docs = tb.unpack(col["docs"], np.int64).reshape(-1, 4)
        docs = docs[np.argsort(docs[:, 0])]
        i = np.searchsorted(docs[:, 0], tb.from_planes(col["rows"], np.int64))
        known, base, score = (np.bincount(i, x, len(docs)) for x in (
            tb.from_planes(col["known"], np.int32), tb.unpack(col["base"], np.float64), tb.unpack(col["score"], np.float64)))
        none = docs[:, 3] == 2
        return pa.table({"doc_id": pa.array(docs[:, 1], mask=none), "held_out": pa.array(docs[:, 3] == 1, mask=none), "n_tokens": pa.array(docs[:, 2]),
                         "n_known": pa.array(known.astype(np.int64)), "train_tokens": pa.array(np.full(len(docs), n, np.int64)),
                         "base_score": pa.array(base), "score": pa.array(score - start)})
    return run


def _prepared(docs: DataFrame):
    """(documents, shards, N, V, training texts, hot words with their counts)."""
    spark = tb.text_session(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words, count = tb.checkpointed(unigrams(docs), "unigrams"), tb.shards(spark)
    n, v, texts = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == int(END), F.col("n"))), F.lit(0))).first()
    # at most HOT * count words, as their counts add up to no more than n
    hot = {r[0] & (2 ** 64 - 1): r[1] for r in words.where(F.col("n") * (HOT * count) > n).collect()}
    return docs, count, n, v, texts, hot


def scored(docs: DataFrame, k: float = PRIOR) -> DataFrame:
    """Scores of all documents (doc_id, text) under the model of those that are not held out."""
    docs, count, n, v, texts, hot = _prepared(docs)
    return (docs.mapInArrow(_deal(count, list(hot)), DEALT)
            .groupBy("shard").applyInArrow(_score(n, v, hot, k, count), SUMS)
            .groupBy("bucket").applyInArrow(_sum(n, float(np.log10(texts + k))), SCORES))


def model(docs: DataFrame, k: float = PRIOR) -> DataFrame:
    """(shard, trie): the tries of the training documents."""
    docs, count, n, v, _, hot = _prepared(docs)

    def tries(table: pa.Table) -> pa.Table:
        word, context, row = _unpacked(table)
        train = (row & 1) == 1
        return pa.table({"shard": table.column("shard").slice(0, 1), "trie": pa.array([Trie.build(word[train], context[train], hot, n, v, k)], pa.binary())})

    return docs.mapInArrow(_deal(count, list(hot)), DEALT).groupBy("shard").applyInArrow(tries, "shard int, trie binary")


def op7_elias_fano_trie(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
