"""Benchmark decontamination by latent semantic retrieval and common subsequences.

1. Terms are the benchmark's words. Every text is read once and its terms, with their places,
   are written to the shared folder; their document frequencies are counted over all documents.
2. Texts are cut into passages of ``PASSAGE`` words, one every ``STRIDE``, with TF-IDF
   weights. Words that no benchmark item has do not count, in a passage's length either:
   their frequencies are unknown, and one weight for all of them would push short items
   inside other text below any threshold as the documents grow in number. A passage
   without benchmark terms is left out at once.
3. A randomised SVD finds the latent space of the items and of all other passages: every
   task adds up its part of A'(A Omega), the parts are summed by Spark, and the
   orthonormal basis of the sum (``RANK`` columns) is the space. Each item weighs as much
   as all passages of documents together: the common words of a large corpus would
   otherwise take up the whole space, and the items are what is looked for. The space
   grows by the items that lie more than ``OUTSIDE`` of their length outside of it, so it
   has as many columns as the block of items needs.
4. All passages are projected and compared with all items (where a block has fewer items than
   the space has columns, by their projections onto the terms). A passage whose TF-IDF
   cosine with an item is c has a latent cosine of at least c less the part of the item
   outside the space; so an item's candidates are the passages whose latent cosine is at
   least ``COSINE`` less that part, and none that TF-IDF would find is missed.
5. A candidate with fewer of an item's words than a leak needs is none. Another is a leak when the longest common subsequence of words of item and
   surrounding text has at least ``SHARE`` of the item's words, and that with the item's
   answer (its last sentence) at least ``ANSWER`` of the answer's words. Inserted,
   dropped and replaced words leave a subsequence long, so paraphrases are found.

The benchmark is the query set: its items go over all documents in blocks of at most
``ITEMS`` items, so what a task is sent and the driver holds is bounded by that (items
are short texts) and does not grow with the documents.

Words are lower-cased runs of a-z, 0-9 and non-ASCII bytes, known by 64-bit hash. Defined
results: null or empty texts and items match nothing; a leak in a document without id has
a null doc_id; items of one id are kept apart; repeated rows are reported each; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.llm import textbytes as tb
from callwise.llm.lempel_ziv import runs

STRIDE = 16
PASSAGE = 2 * STRIDE
RANK = 256               # columns that the passages and items are sketched to
SKETCH = 50_000          # terms that are added to the sketch at a time
OUTSIDE = 0.05           # most of an item's length outside the space
COSINE = 0.3
SHARE, ANSWER = 0.6, 0.5
ITEMS = 1000


class Items:
    """A block of benchmark items: words of each, of its answer, and the vocabulary."""

    def __init__(self, rows: list[tuple]):
        self.ids = [i for i, _ in rows]
        self.words = [self._words(t) for _, t in rows]
        self.answers = [self._answer(t) for _, t in rows]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]))
        # as numbers in the vocabulary; an answer's words are its item's
        self.terms = [terms_of(w, self.vocabulary) for w in self.words]
        self.answer_terms = [terms_of(w, self.vocabulary) for w in self.answers]

    @staticmethod
    def _words(text: str | None) -> np.ndarray:
        return tb.plain_words(pa.array([text or ""])).hashes()

    @classmethod
    def _answer(cls, text: str | None) -> np.ndarray:
        """Words of the last sentence that has three."""
        parts = (text or "").replace("!", ".").replace("?", ".").split(".")
        return next((w for w in map(cls._words, reversed(parts)) if len(w) >= 3), cls._words(text))

    def vectors(self, weights: np.ndarray) -> np.ndarray:
        """Unit TF-IDF vectors of the items."""
        x = np.zeros((len(self.words), len(self.vocabulary)), np.float32)
        for i, w in enumerate(self.words):
            np.add.at(x[i], np.searchsorted(self.vocabulary, w), 1)
        x *= weights[None, :]
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def terms_of(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Number of each word in the vocabulary, or -1."""
    i = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[i] == hashes, i, -1)


HITS = "doc_id long, words int, terms binary, places binary"


def _hits(vocabulary: np.ndarray):
    """Task: of each document its terms and their places among its words, as 32-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            w = tb.plain_words(batch.column("text"))
            term = terms_of(w.hashes(), vocabulary)
            hit = np.flatnonzero(term >= 0)
            ends = pa.py_buffer(np.append(0, 4 * np.cumsum(np.bincount(w.doc[hit], minlength=w.docs))).astype(np.int32))
            packed = lambda v: pa.Array.from_buffers(pa.binary(), w.docs, [None, ends, pa.py_buffer(v.astype(np.int32))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w.counts.astype(np.int32)), packed(term[hit]), packed(hit - w.first[w.doc[hit]])],
                                             names=[x.split()[0] for x in HITS.split(", ")])
    return run


def read_hits(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(words of each document; document, place and number of each term)."""
    raw, off = tb.strings(batch.column("terms"))
    term = np.frombuffer(raw.tobytes(), np.int32)
    place = np.frombuffer(tb.strings(batch.column("places"))[0].tobytes(), np.int32)
    return np.asarray(batch.column("words")).astype(np.int64), np.repeat(np.arange(batch.num_rows), np.diff(off) // 4), place, term


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, passages = np.zeros(size, np.int64), 0, 0
        for batch in tb.slices(batches, "terms"):
            words, doc, _, term = read_hits(batch)
            docs += len(words)
            passages += int((-(-words // STRIDE)).sum())
            df += np.bincount(np.unique(doc * size + term) % size, minlength=size)
        keys = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, [-1, -2]), pa.int64()), pa.array(np.append(df[keys], [docs, passages]), pa.int64())], names=["term", "n"])
    return run


MANY = 64                # places of a term in a piece, from which it is summed by itself


class Passages:
    """The passages of a slice that have terms, with their terms."""

    def __init__(self, batch: pa.RecordBatch, vocabulary: np.ndarray, weights: np.ndarray):
        self.words = w = tb.plain_words(batch.column("text"))
        self.hashes = w.hashes()
        term = terms_of(self.hashes, vocabulary)
        hit = np.flatnonzero(term >= 0)
        self._cut(w.counts, w.doc[hit], hit - w.first[w.doc[hit]], term[hit], weights)

    @classmethod
    def read(cls, batch: pa.RecordBatch, weights: np.ndarray) -> "Passages":
        """From documents whose terms are written."""
        self = object.__new__(cls)
        self._cut(*read_hits(batch), weights)
        return self

    def _cut(self, counts: np.ndarray, of: np.ndarray, place: np.ndarray, term: np.ndarray, weights: np.ndarray) -> None:
        blocks = -(-counts // STRIDE)
        base = np.cumsum(blocks) - blocks
        block = base[of] + place // STRIDE
        n = int(blocks.sum())
        whole = np.bincount(block, weights[term] ** 2, n)
        # a passage is a block and the next one of the same text
        doc = np.repeat(np.arange(len(counts)), blocks)
        pair = np.zeros(n, bool)
        pair[:-1] = doc[1:] == doc[:-1]
        self.whole = whole + np.where(pair, np.append(whole[1:], 0), 0)
        alone = ~pair & (np.append(True, ~pair[:-1])[:n] if n else pair)      # a text of one block
        good = np.flatnonzero((pair | alone) & (self.whole > 0))
        self.doc, self.start = doc[good], (good - base[doc[good]]) * STRIDE
        self.length = np.sqrt(self.whole[good])
        # passages as their first blocks, and the terms of all blocks one after the other
        self.first, self.pair = good, pair[good]
        self.term, self.block = term, block
        # words of the slice before each document, and before each term
        self.before = np.append(0, np.cumsum(counts))
        self.at = self.before[of] + place

    def _blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first block of each passage, terms, block of each term), from the first passage's block on."""
        lo, end = (int(self.first[0]), int(self.first[-1]) + 2) if len(self.first) else (0, 0)
        a, z = np.searchsorted(self.block, (lo, end))
        return self.first - lo, self.term[a:z], self.block[a:z] - lo

    def projected(self, basis: np.ndarray) -> np.ndarray:
        """Passages times basis, whose rows are weighted already: each block once, and
        a passage is the sum of its two."""
        first, term, block = self._blocks()
        start = runs(block)
        size = np.diff(np.append(start, len(term)))
        o = np.argsort(-size, kind="stable")
        sums = _added_rows(basis, term, start[o], size[o], 1)          # the last row: a block without terms
        row = np.full(int(first[-1]) + 2 if len(first) else 0, len(start))
        row[block[start[o]]] = np.arange(len(start))
        out = sums[row[first]]
        out[self.pair] += sums[row[first[self.pair] + 1]]
        return out / self.length[:, None].astype(np.float32)

    def spread(self, y: np.ndarray, total: np.ndarray) -> None:
        """Adds each passage's row of ``y`` to the rows of ``total`` of its terms."""
        first, term, block = self._blocks()
        if not len(term):
            return
        of_block = np.zeros((int(first[-1]) + 2, y.shape[1]), np.float32)
        of_block[first] += y
        of_block[first[self.pair] + 1] += y[self.pair]
        o = np.argsort(term.astype(np.uint16) if len(total) <= 65536 else term, kind="stable")
        term, block = term[o], block[o]
        start = runs(term)
        size = np.diff(np.append(start, len(term)))
        o = np.argsort(-size, kind="stable")
        start, size = start[o], size[o]
        many = int(np.searchsorted(-size, -MANY, "right"))
        for a, n in zip(start[:many], size[:many]):
            total[term[a]] += of_block[block[a:a + n]].sum(axis=0)
        total[term[start[many:]]] += _added_rows(of_block, block, start[many:], size[many:])

    def pieces(self, most: int = 50_000) -> Iterator["Passages"]:
        """Self in parts of limited numbers of terms."""
        at, before = 0, np.searchsorted(self.block, self.first)
        while at < len(self.doc):
            stop = max(at + 1, int(np.searchsorted(before, before[at] + most)))
            part = object.__new__(Passages)
            part.term, part.block, part.before, part.at = self.term, self.block, self.before, self.at
            part.doc, part.start, part.length = self.doc[at:stop], self.start[at:stop], self.length[at:stop]
            part.first, part.pair = self.first[at:stop], self.pair[at:stop]
            yield part
            at = stop

    def around(self, i: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First term and end of the terms in passages ``i`` and so many words around them."""
        d = self.doc[i]
        begin = self.before[d] + self.start[i]
        return (np.searchsorted(self.at, np.maximum(self.before[d], begin - words)),
                np.searchsorted(self.at, np.minimum(self.before[d + 1], begin + PASSAGE + words)))


def _added_rows(rows: np.ndarray, which: np.ndarray, start: np.ndarray, size: np.ndarray, more: int = 0) -> np.ndarray:
    """Sums of ``rows[which[a:a + n]]`` for every start and size, the largest size first, and
    ``more`` rows of zeros."""
    out = np.zeros((len(start) + more, rows.shape[1]), np.float32)
    for k in range(int(size[0]) if len(size) else 0):       # the k-th of every sum that has as many
        m = int(np.searchsorted(-size, -k))
        out[:m] += rows[which[start[:m] + k]]
    return out


CHUNK = 256              # rows of the sketch in one row of the exchange


def _sketch(weights: np.ndarray, columns: int, most: int):
    """Task: its part of A'(A Omega), in chunks of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = omega(len(weights), columns) * weights[:, None].astype(np.float32)
        total = np.zeros_like(weighted)
        for batch in tb.slices(batches, "terms"):
            for p in Passages.read(batch, weights).pieces(most):
                p.spread(p.projected(weighted) / p.length[:, None].astype(np.float32), total)
        total *= weights[:, None].astype(np.float32)
        parts = [(i, total[i * CHUNK:(i + 1) * CHUNK].astype(np.float32).tobytes()) for i in range(-(-len(total) // CHUNK)) if total[i * CHUNK:(i + 1) * CHUNK].any()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in parts], pa.int32()), pa.array([x[1] for x in parts], pa.binary())], names=["chunk", "part"])
    return run


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in b.column("part"):
            v = np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
            total = v if total is None else total + v
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["chunk", "part"])


def omega(rows: int, columns: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((rows, columns)).astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit of a number for each word of ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = where.get(x)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


LEAKS = "doc_id long, item_id long, start_word long, cosine double, lcs long, item_words long, answer_lcs long, answer_words long"


def latent_space(sketch: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal basis of the sketch and of the unit vectors ``items`` that are not in its
    span, and the length of each item's part outside the basis."""
    basis = np.linalg.qr(sketch)[0].astype(np.float32)
    outside = items - (items @ basis) @ basis.T
    far = np.linalg.norm(outside, axis=1) > OUTSIDE
    if far.any():
        basis = np.linalg.qr(np.concatenate([basis, outside[far].T], axis=1))[0]
        outside = items - (items @ basis) @ basis.T
    return basis, np.linalg.norm(outside, axis=1)


CANDIDATES = 20_000      # whose words are counted at a time


class _Shared:
    """Words that an item and the text around a passage have in common, each as often as both
    have it: a bound on their common subsequence."""

    def __init__(self, terms: list[np.ndarray], vocabulary: int):
        self.size = np.array([len(w) for w in terms])
        self.has = np.zeros((len(terms), vocabulary), bool)
        item = np.repeat(np.arange(len(terms)), self.size)
        self.key, self.count = np.unique(item * vocabulary + np.concatenate(terms), return_counts=True)
        self.has.ravel()[self.key] = True

    def __call__(self, p: Passages, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, width = np.zeros(len(i), np.int64), self.has.shape[1]
        for k in range(0, len(i), CANDIDATES):
            item = j[k:k + CANDIDATES]
            a, z = p.around(i[k:k + CANDIDATES], self.size[item])
            of = np.repeat(np.arange(len(a)), z - a)
            term = p.term[np.repeat(a, z - a) + tb.ragged(z - a)]
            found = np.sort((of * width + term)[self.has[item[of], term]])
            start = runs(found)
            of, term = np.divmod(found[start], width)
            wanted = self.count[np.searchsorted(self.key, item[of] * width + term)]
            out[k:k + CANDIDATES] = np.bincount(of, np.minimum(np.diff(np.append(start, len(found))), wanted), len(a))
        return out


def _search(items: Items, weights: np.ndarray, weighted: np.ndarray, query: np.ndarray, least: np.ndarray):
    """Task: the leaks of its documents, each item at its best passage. ``weighted`` is the
    weighted basis, ``query`` the items in the latent space, ``least`` their least cosine."""
    size = np.array([len(w) for w in items.terms])
    direct = len(query) <= weighted.shape[1]
    if direct:      # (passage basis) item = passage (basis item), which has fewer columns
        weighted = np.ascontiguousarray((weighted @ query.T).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = _Shared(items.terms, len(weights))
        for batch in tb.slices(batches, "terms"):
            ids = batch.column("doc_id").to_pylist()
            best: dict[tuple[int, int], tuple] = {}
            for p in Passages.read(batch, weights).pieces():
                cosine = p.projected(weighted)
                if not direct:
                    cosine = cosine @ query.T
                i, j = np.nonzero(cosine >= least)
                use = shared(p, i, j) >= SHARE * size[j]
                i, j = i[use], j[use]
                for i, j, a, z in zip(i.tolist(), j.tolist(), *p.around(i, size[j])):
                    n, d, text = len(items.terms[j]), int(p.doc[i]), p.term[a:z]
                    lcs = common_subsequence(items.terms[j], text)
                    if lcs < SHARE * n:
                        continue
                    answer = common_subsequence(items.answer_terms[j], text)
                    if answer < ANSWER * len(items.answers[j]):
                        continue
                    found = (lcs, answer, float(cosine[i, j]), -int(p.start[i]))
                    if found > best.get((d, j), (0,)):
                        best[d, j] = found
            if best:
                rows = [(ids[d], items.ids[j], -s, c, lcs, len(items.words[j]), a, len(items.answers[j])) for (d, j), (lcs, a, c, s) in sorted(best.items())]
                types = [pa.int64()] * 3 + [pa.float64()] + [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=[x.split()[0] for x in LEAKS.split(", ")])
    return run


def leaks_of_block(texts: DataFrame, rows: list[tuple]) -> DataFrame | None:
    """Leaks of one block of items."""
    items = Items(rows)
    size = len(items.vocabulary)
    if not size:
        return None
    hits = tb.checkpointed(texts.mapInArrow(_hits(items.vocabulary), HITS), "terms")
    found = dict(hits.mapInArrow(_frequencies(size), "term long, n long").groupBy("term").sum("n").collect())
    docs, passages = found.pop(-1, 0), found.pop(-2, 0)
    df = np.array([found.get(i, 0) for i in range(size)])
    weights = np.log((2 + docs) / (1 + df))
    columns = min(RANK, size)
    y = np.zeros((size, columns))
    for chunk, part in (hits.mapInArrow(_sketch(weights, columns, SKETCH), "chunk int, part binary")
                        .groupBy("chunk").applyInArrow(_added, "chunk int, part binary").collect()):
        y[chunk * CHUNK:(chunk + 1) * CHUNK] = np.frombuffer(bytes(part), np.float32).reshape(-1, columns)
    x = items.vectors(weights)
    y += (1 + passages) * (x.T @ (x @ omega(size, columns)).astype(float))
    basis, outside = latent_space(y, x)
    weighted = basis * weights[:, None].astype(np.float32)
    least = (COSINE - outside - 1e-5).astype(np.float32)      # less what 32-bit sums may lose
    return hits.mapInArrow(_search(items, weights, weighted, x @ basis, least), LEAKS)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark items (item_id, text) found in documents (doc_id, text): one row for each
    document and item, with the passage's first word, the latent cosine and both common
    subsequences."""
    spark = tb.text_session(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    blocks = max(1, -(-items.count() // (ITEMS // 2)))      # hashed evenly, so that none is over ITEMS
    out = spark.createDataFrame([], LEAKS)
    for b in range(blocks):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()]
        found = leaks_of_block(texts, rows)
        out = out if found is None else found if blocks == 1 else out.union(found)
    return out


def op1_latent_retrieval(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
