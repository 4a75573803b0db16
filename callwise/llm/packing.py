"""Packing token sequences by Karmarkar-Karp multiway differencing.

Texts are tokenised with a public tokenizer and end with the separator id. Windows'
worth of tokens are cut off the front of a document and are sequences of their own;
the remainder is cut into parts of at most ``PART`` tokens. Blocks of parts are
partitioned into k windows: every part starts as a partial partition with one
non-empty window, and the two partial partitions with the largest imbalance are
merged, the fullest windows of one with the emptiest of the other, until one is left.
Its windows are nearly equal; k starts at the fewest windows that could hold the block
and rises while any window exceeds the capacity.

Every input partition packs its own documents in one pass without a shuffle, so the
work splits over any number of executors and a lost task is repeated alone; the
price is one underfilled block for each partition. Sequence ids carry the partition
number in their upper bits.

Defined results: a null text is empty (its separator is still packed); null ids stay
null; repeated rows are packed each; a text of any length is cut; other columns are
ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.llm import textbytes as tb

PART = 128               # most tokens of a part of a remainder
BLOCK = 1024             # parts that are balanced together
MEMO = 1_000_000         # text chunks whose ids a task remembers


def wide_blank(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Whether three bytes are one of Unicode's white-space characters beyond ASCII, U+0085 and
    U+00A0 at the two bytes ``y``, ``z`` aside."""
    return ((x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE2) & (y == 0x80) & ((z >= 0x80) & (z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
            | (x == 0xE2) & (y == 0x81) & (z == 0x9F) | (x == 0xE3) & (y == 0x80) & (z == 0x80))


def short_blank(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == 0xC2) & ((y == 0x85) | (y == 0xA0))


class Encoder:
    """Ids of many texts. A text is cut before each single space between two characters
    that are not white space, in ASCII or beyond it: the tokenizer's own pattern always starts a new piece
    there, so the ids of the chunks, one after the other, are the ids of the text. Each
    distinct chunk is encoded once.

    ``path`` names a vocabulary of byte-pair ranks; its ids are those of the ``.json`` file
    of the same name under ``tokenizers``, but the rank file is read by a library that
    encodes short chunks several times faster. Texts that hold one of the file's added
    tokens are encoded by ``tokenizers`` itself."""

    def __init__(self, path: str, pattern: str):
        import base64
        import json
        import tiktoken
        from tokenizers import Tokenizer
        named = path.removesuffix(".tiktoken") + ".json"
        with open(named, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f).get("added_tokens", []) if t["content"]]
        self.named = Tokenizer.from_file(named) if self.added else None
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.one = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._forget()

    def _forget(self):
        self.row: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)

    def _learn(self, hashes: list[int], texts: list[str]) -> None:
        found = list(map(self.one, texts))
        first = len(self.row)
        length = np.fromiter(map(len, found), np.int64, len(found))
        need, end = first + len(found), self.at[first] + length.sum()
        while len(self.at) <= need:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while len(self.ids) < end:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.at[first + 1:need + 1] = self.at[first] + np.cumsum(length)
        self.ids[self.at[first]:end] = np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum()))
        self.row.update(zip(hashes, range(first, need)))

    def encode(self, raw: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets), each text followed by ``end_id``."""
        data = raw.tobytes()
        if not any(t.encode() in data for t in self.added):
            return self._ordinary(raw, off, end_id)
        texts = [data[a:b].decode() for a, b in zip(off[:-1], off[1:])]
        found = {i: self.named.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if any(a in t for a in self.added)}
        rest = [b"" if i in found else t.encode() for i, t in enumerate(texts)]
        ids, at = self._ordinary(np.frombuffer(b"".join(rest), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in rest])]), end_id)
        parts = [np.array([*found[i], end_id], np.uint32) if i in found else ids[at[i]:at[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _ordinary(self, raw: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for texts without added tokens."""
        docs, n = len(off) - 1, len(raw)
        blank = tb._SPACE[raw]
        cut = np.zeros(n, bool)
        if n > 2:
            cut[1:-1] = (raw[1:-1] == 0x20) & ~blank[:-2] & ~blank[2:]
            c = np.flatnonzero(cut)
            p = np.concatenate([np.zeros(3, np.uint8), raw, np.zeros(3, np.uint8)])
            b1, b2, b3, a1, a2, a3 = (p[c + i] for i in (0, 1, 2, 4, 5, 6))      # the bytes around each space
            cut[c[wide_blank(b1, b2, b3) | short_blank(b2, b3) | wide_blank(a1, a2, a3) | short_blank(a1, a2)]] = False
        inner = off[(off > 0) & (off < n)]
        cut[inner] = True                       # documents start anew
        cut[inner - 1] &= np.isin(inner - 1, inner)   # a last space stays with its text
        cut[:1] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)[:len(starts)]
        h = tb.span_hash(tb.prefix_sums(tb._BYTE[raw]), starts, ends)
        distinct, one, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.row) + len(distinct) > MEMO:
            self._forget()
        keys = distinct.tolist()
        new = [i for i, x in enumerate(keys) if x not in self.row]
        data = raw.tobytes()
        self._learn([keys[i] for i in new], [data[starts[one[i]]:ends[one[i]]].decode() for i in new])
        row = np.fromiter(map(self.row.__getitem__, keys), np.int64, len(keys))[back]
        length = self.at[row + 1] - self.at[row]
        chunk_doc = np.searchsorted(off, starts, "right") - 1
        per_doc = np.bincount(chunk_doc, length, docs).astype(np.int64) if len(starts) else np.zeros(docs, np.int64)
        at = np.concatenate([[0], np.cumsum(per_doc + 1)])
        out = np.full(at[-1], end_id, np.uint32)
        source = np.repeat(self.at[row], length) + tb.ragged(length)
        out[np.arange(len(source)) + np.repeat(chunk_doc, length)] = self.ids[source]
        return out, at


def differenced(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window 0..k-1 of every size, by multiway differencing."""
    if k == 1:
        return np.zeros(len(sizes), np.int64)
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    merged: list[tuple] = []
    n = len(sizes)

    def take():
        _, i = heapq.heappop(heap)
        if i >= n:
            return i, sums.pop(i)
        v = np.zeros(k, np.int64)     # windows in falling order of their sums
        v[0] = sizes[i]
        return i, v

    while len(heap) > 1:
        (a, x), (b, y) = take(), take()
        v = x + y[::-1]
        order = np.argsort(-v, kind="stable")
        v = v[order]
        v -= v[-1]
        sums[n + len(merged)] = v
        heapq.heappush(heap, (-int(v[0]), n + len(merged)))
        merged.append((a, b, order))
    place = {heap[0][1]: np.arange(k)} if heap else {}
    window = np.zeros(n, np.int64)
    for j in range(len(merged) - 1, -1, -1):
        a, b, order = merged[j]
        own = place.pop(n + j)
        slot = np.empty(k, np.int64)
        slot[order] = own             # slot of each window of ``x``; ``y`` is the other way round
        for child, s in ((a, slot), (b, slot[::-1])):
            if child < n:
                window[child] = s[0]
            else:
                place[child] = s
    if n == 1:
        window[0] = 0
    return window


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of every size, none over the capacity, with as few windows as differencing finds."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        w = differenced(sizes, k)
        if np.bincount(w, sizes).max(initial=0) <= capacity:
            return w
        k += 1


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _packer(path: str, pattern: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, made = Encoder(path, pattern), TaskContext.get().partitionId() << 32
        held: list[tuple] = []       # (ids column, row, start, length, tokens of the document, ids)
        waiting = 0

        def table(doc_id, start, length, ids, total, sequence, offset):
            raw = np.concatenate(ids) if len(ids) else np.zeros(0, np.uint32)
            at = np.concatenate([[0], np.cumsum(length)]) * 4
            binary = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
            return pa.RecordBatch.from_arrays(
                [doc_id, pa.array(start), pa.array(length), binary, pa.array(total), pa.array(sequence), pa.array(offset)],
                names=[x.split()[0] for x in PIECES.split(", ")])

        def balance():
            nonlocal held, waiting, made
            doc_id = pa.concat_arrays([h[0] for h in held])
            start, length, total = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            parts = [p for h in held for p in h[4]]
            w = windows(length, capacity)
            _, w = np.unique(w, return_inverse=True)     # no empty windows
            o = np.argsort(w, kind="stable")
            size = length[o]
            before = np.cumsum(size) - size
            first = np.searchsorted(w[o], np.arange(w.max() + 1))
            offset = before - before[first][w[o]]
            out = table(doc_id.take(pa.array(o)), start[o], size, [parts[i] for i in o], total[o], made + w[o], offset)
            made += int(w.max()) + 1
            held, waiting = [], 0
            return out

        for batch in tb.slices(batches):
            ids, at = encoder.encode(*tb.strings(batch.column("text")), end_id)
            doc_id, total = batch.column("doc_id"), np.diff(at)
            full = total // capacity
            row = np.repeat(np.arange(len(total)), full)
            if len(row):
                start = tb.ragged(full) * capacity
                begin = at[row] + start
                yield table(doc_id.take(pa.array(row)), start, np.full(len(row), capacity), [ids[x:x + capacity] for x in begin],
                            total[row], made + np.arange(len(row)), np.zeros(len(row), np.int64))
                made += len(row)
            rest = total - full * capacity
            count = -(-rest // PART)
            row = np.repeat(np.arange(len(total)), count)
            which = tb.ragged(count)
            # the parts of a remainder are as equal as they can be
            low, more = rest[row] // np.maximum(count[row], 1), rest[row] % np.maximum(count[row], 1)
            length = low + (which < more)
            start = full[row] * capacity + which * low + np.minimum(which, more)
            for s in range(0, len(row), BLOCK):
                i = slice(s, s + BLOCK)
                while len(row[i]):
                    n = min(BLOCK - waiting, len(row[i]))
                    j = slice(i.start, i.start + n)
                    begin = at[row[j]] + start[j]
                    held.append((doc_id.take(pa.array(row[j])), start[j], length[j], total[row[j]], [ids[x:x + y].copy() for x, y in zip(begin, length[j])]))
                    waiting += n
                    if waiting == BLOCK:
                        yield balance()
                    i = slice(i.start + n, i.stop)
        if waiting:
            yield balance()
    return run


def pack(docs: DataFrame, ranks: str, pattern: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of the token sequences of ``docs`` (doc_id, text) in windows of at most
    ``capacity`` tokens: doc_id, start (tokens of the document before the piece), length,
    ids (little-endian unsigned 32-bit), doc_tokens (with the separator), sequence_id and
    offset in the sequence, gapless from 0."""
    tb.text_session(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _packer(ranks, pattern, capacity, end_id), PIECES)


def vocabulary() -> tuple[str, str]:
    """Ranks and pattern of the public 50k byte-pair vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_karmarkar_karp(spark, sf_dir: str) -> DataFrame:
    return digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabulary()))
