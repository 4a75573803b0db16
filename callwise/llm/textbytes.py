"""Vectorised access to Arrow text columns inside Spark tasks.

Texts are looked at as one UTF-8 byte array per slice, so words, shingles and
byte windows of a few thousand documents are found and hashed with a handful of
numpy calls instead of one Python call per word. Slices are cut by bytes
(``SLICE_BYTES``), never by dropping text: a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 2 << 20
# rows handed to Python at a time; long texts make larger batches needlessly big
ARROW_ROWS = 1000

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
_BASE = 0x9FB21C651E98DF27          # odd multiplier of the rolling hashes
_INV = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[128:] = _PLAIN[ord("0"):ord("9") + 1] = _PLAIN[ord("a"):ord("z") + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def text_session(spark: SparkSession) -> SparkSession:
    """Bounds the rows of one Arrow batch for the jobs over whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    return spark


def shards(spark: SparkSession, per_partition: int = 2) -> int:
    """Number of groups that a job deals its blobs to: it follows the session's
    shuffle partitions, which are sized from the input."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpointed(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage
    and keeps column pruning for later readers. ``options`` are the writer's."""
    from callwise.session import new_output_path
    path = new_output_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: spreads hashes evenly; different seeds are independent."""
    x = np.asarray(x, np.uint64) + np.uint64((seed * _STEP + _STEP) & (2 ** 64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 77)


class _Powers:
    """Powers of the base and of its inverse, made where they are used: they do not
    travel with the functions that are sent to executors."""

    def __init__(self):
        self.made = [np.ones(1, np.uint64)] * 2

    def __reduce__(self):
        return _Powers, ()

    def __call__(self, n: int) -> list[np.ndarray]:
        if len(self.made[0]) < n:
            n = max(n, SLICE_BYTES + 4096)
            self.made = []
            for base in (_BASE, _INV):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                self.made.append(np.cumprod(p))
        return self.made


_powers = _Powers()


def prefix_sums(v: np.ndarray) -> np.ndarray:
    """Prefix sums for ``span_hash`` over 64-bit values."""
    out = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v * _powers(len(v) + 1)[0][:len(v)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end): equal spans have equal hashes."""
    return mix((sums[ends] - sums[starts]) * _powers(len(sums))[1][starts])


def rolling(v: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values."""
    if len(v) < k:
        return np.zeros(0, np.uint64)
    s, n = prefix_sums(v), len(v) - k + 1
    return mix((s[k:] - s[:-k]) * _powers(len(s))[1][:n], k)


def strings(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    size = 8 if wide else 4
    off = np.frombuffer(off, np.int64 if wide else np.int32, len(col) + 1, col.offset * size) if off else np.zeros(1)
    off = off.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.diff(strings(batch.column(column))[1]) + 16)
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def longs(col: pa.Array) -> np.ndarray:
    """A bigint column as numpy; nulls (no usable id) become the smallest long."""
    return np.asarray(pc.fill_null(col.cast(pa.int64()), -2 ** 63).to_numpy(zero_copy_only=False), np.int64)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def plain_words(col: pa.Array) -> "Words":
    """Lower-cased words of a string column, without ASCII punctuation."""
    raw, off = strings(pc.utf8_lower(col))
    return Words(raw, off, _PLAIN[raw])


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice: byte spans, document of each word, hashes."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, solid: np.ndarray | None = None):
        """``solid``: which bytes belong to words; all but white space by default."""
        self.raw, self.off, n = raw, off, len(raw)
        self.docs = len(off) - 1
        solid = ~_SPACE[raw] if solid is None else solid
        before, after = np.ones(n, bool), np.ones(n, bool)
        np.logical_not(solid[:-1], out=before[1:])
        np.logical_not(solid[1:], out=after[:-1])
        edge = off[(off > 0) & (off < n)]
        before[edge] = True
        after[edge - 1] = True
        self.starts = np.flatnonzero(solid & before)
        self.ends = np.flatnonzero(solid & after) + 1
        # words of document d: first[d] .. first[d + 1]
        self.first = np.searchsorted(self.starts, off)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.docs), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_sums(_BYTE[self.raw]), self.starts, self.ends)

    def windows(self, k: int) -> np.ndarray:
        """Starts (word numbers) of the runs of ``k`` words inside one document."""
        if len(self.starts) < k:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[:len(self.doc) - k + 1] == self.doc[k - 1:])


def byte_windows(raw: np.ndarray, q: int) -> np.ndarray:
    """Hash of every run of ``q`` bytes."""
    return rolling(_BYTE[raw], q)


def order_by(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Permutation sorting by (major, minor); ``major`` holds small numbers."""
    o = np.argsort(minor)
    m = major[o]
    m = m.astype(np.uint16) if len(m) and m.max() < 65536 else m
    return o[np.argsort(m, kind="stable")]


def dealt(shard: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, indices) for every shard that has any, indices in their old order."""
    o = np.argsort(shard.astype(np.uint16) if count <= 65536 else shard, kind="stable")
    cut = np.searchsorted(shard[o], np.arange(count + 1))
    for s in np.flatnonzero(np.diff(cut)):
        yield int(s), o[cut[s]:cut[s + 1]]


def shard_of(h: np.ndarray, count: int) -> np.ndarray:
    """Even deal of 64-bit hashes to ``count`` shards."""
    return ((h >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def unpack(col: pa.Array, dtype) -> np.ndarray:
    """All values of a binary column of packed numbers, rows in order."""
    raw, _ = strings(col)
    return np.frombuffer(raw.tobytes(), dtype)


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)



def planes(v: np.ndarray) -> bytes:
    """Numbers with their bytes sorted by place: equal upper bytes then lie together and
    vanish in the shuffle's compression."""
    return np.ascontiguousarray(v.view(np.uint8).reshape(len(v), -1).T).tobytes()


def from_planes(col: pa.Array, dtype) -> np.ndarray:
    """All values of a column written by ``planes``, rows in order."""
    width, parts = np.dtype(dtype).itemsize, []
    raw, off = strings(col)
    for a, b in zip(off[:-1], off[1:]):
        parts.append(np.ascontiguousarray(raw[a:b].reshape(width, -1).T).view(dtype).ravel())
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
