"""Exact n-gram Jaccard self-join with PartEnum signatures.

A document is the set of its distinct word shingles. Sets are banded by size, and
two linked sets of one band differ in at most ``k`` elements. The element domain
is cut into ``n1`` parts of ``n2`` sub-parts by a hash; with k < n1 * (k2 + 1) some
part holds at most ``k2`` of the differences, so at least one of its subsets of
``n2 - k2`` sub-parts is equal in both sets. Each set emits the hash of its
elements in every such subset, and linked sets always share a signature.

* A set also signs in every further band that it can link to sets of.
* A subset without elements would gather unrelated sets, so it is not emitted. The
  domain has some more parts (``spare_share``) than the bound asks for, so that a link
  agrees in more than one; a set with more parts than that holding an empty subset
  signs again under another cut of the domain (both ends of a link find each other
  in the first cut in which either does not); after ``CUTS`` cuts the empty ones are
  emitted too. Nothing is lost either way.
* A shard gets ``SIG`` bytes of each signature. Signatures that agree in those only
  make more candidates.
* Equal sets are one class; signatures, candidates and links are between classes.
* Classes that share a signature are compared with a hub first. Only groups still
  holding several components are compared further, in cells (a group, or two blocks of
  a large one). Sizes and parity sketches (about one bit for each element; its
  differing bits are never more than the differing elements) say which classes of a
  cell may link to another component. Every class is verified with the nearest of
  those; after that, what may still link (some of those that had a nearest) is sent to
  its cells with its whole set, once for cells of the same classes. A cell verifies pairs
  not yet connected there and gives out a forest of links. So no table of pairs has more
  rows than there are classes in groups.
* Links only join classes of one component. When the components are known, every pair of
  classes of one is counted in the one cell that holds both (a component, or two blocks of a
  large one), by lists of the classes that hold an element, or of those that lack it. What
  leaves a cell is a number for each class.

Defined results: null, empty or blank text has no shingles, links with nothing and is
its own component; a null id stays in the result, links with nothing and has a null
component; repeated rows stay and share a component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.llm import textbytes as tb
from callwise.llm.graph import components

K2, N2 = 1, 3            # PartEnum: differences allowed in a part, sub-parts of a part
CUTS = 6                 # cuts of the domain tried before empty subsets are emitted
SPARE = 0.06             # share of parts beyond those that the bound asks for, at least
SIG = 5                  # lower bytes of a signature that a shard gets
BAND = 1.4               # ratio of largest to smallest set size in a band
SKETCH = 128             # bits of the smallest parity sketch
BLOCK = 2048             # classes of a block of a group on average ...
ELEMENTS = 2_000_000     # ... and their shingles
TOGETHER = 1_000_000     # shingles of the cells verified in one group on average
PAIRED = 4_000_000       # shingles looked up at once in a cell
CROWD = 8192             # classes of a block of a component on average, where links are counted
FAR = 1 << 40            # differing bits of a pair that cannot be linked
FLUSH = 1_500_000        # signatures a task holds before it hands them on
FEW = 1_000_000          # ids that are sent to the texts; for more, the texts go to the ids


def spare_share(percent: int) -> float:
    """Share of spare parts with which the smallest sets of a band (those that reach it
    from below) have no more parts with an empty subset than there are spare ones, on
    average. Thresholds that no such share suits have ``SPARE``."""
    part = percent / BAND * (K2 + 1) * (100 + percent) / max(200 * (100 - percent), 1)    # elements of a needed part
    for share in np.arange(SPARE, 0.5, 0.01):
        if N2 * np.exp(-part / (1 + share) * (N2 - K2) / N2) <= share / (1 + share):
            return float(share)
    return SPARE


class Bands:
    """Size bands and their PartEnum parameters for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent, self.low, lo = percent, [], 1
        while lo < 1 << 40:
            self.low.append(lo)
            lo = max(lo, int(lo * BAND)) + 1
        self.low = np.array(self.low)
        high = np.append(self.low[1:] - 1, lo)
        self.k = 2 * high * (100 - percent) // (100 + percent)
        needed = self.k // (K2 + 1) + 1
        self.spare = (needed * spare_share(percent) + 0.5).astype(int)
        self.n1 = needed + self.spare

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, "right") - 1

    def reach(self, size: np.ndarray) -> np.ndarray:
        """Band of the largest set that a set of this size can link to."""
        return self.of(size * 100 // self.percent)


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, offsets). A text of fewer than
    ``k`` words has its whole word sequence as the one shingle."""
    w = tb.Words(tb.lower_ascii(raw), off)
    h = w.hashes()
    at = w.windows(k)
    shingle = tb.rolling(h, k)[at] if len(at) else np.zeros(0, np.uint64)
    doc = w.doc[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        whole = tb.span_hash(tb.prefix_sums(h), w.first[short], w.first[short + 1])
        shingle = np.concatenate([shingle, tb.mix(whole ^ w.counts[short].astype(np.uint64), 1000)])
        doc = np.concatenate([doc, short])
    o = tb.order_by(doc, shingle)
    shingle, doc = shingle[o], doc[o]
    keep = np.ones(len(doc), bool)
    keep[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    shingle, doc = shingle[keep], doc[keep]
    return shingle, np.searchsorted(doc, np.arange(w.docs + 1))


def class_hashes(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One hash per set; equal sets have equal hashes."""
    sums = tb.prefix_sums(sets)
    return tb.mix(tb.span_hash(sums, off[:-1], off[1:]) ^ np.diff(off).astype(np.uint64), 3)


def sketches(sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the parity sketches: a power of two of bits, at least as
    many as the set has elements."""
    size = np.diff(off)
    wide = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(wide)])
    bit = (tb.mix(sets, 5) >> np.uint64(20)).astype(np.int64) & np.repeat(wide - 1, size)
    odd = np.bincount(bit + np.repeat(at[:-1], size), minlength=at[-1]).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little"), at // 8


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of ``size`` bytes that the same set would have."""
    while len(sketch) > size:
        sketch = sketch[:len(sketch) // 2] ^ sketch[len(sketch) // 2:]
    return sketch


def signatures(sets: np.ndarray, off: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature) of every set, for its own band and those it reaches."""
    size = np.diff(off)
    own = bands.of(np.maximum(size, 1))
    far = bands.reach(size)
    who, sigs = [], []
    for further in range(int((far - own).max(initial=0)) + 1):
        band = np.minimum(own + further, len(bands.k) - 1)
        todo = np.flatnonzero((size > 0) & (own + further <= np.maximum(far, own)) & (bands.k[band] > 0))
        for cut in range(CUTS):
            if not len(todo):
                break
            n1, length = bands.n1[band[todo]], size[todo]
            element = np.repeat(off[todo], length) + tb.ragged(length)
            x = sets[element]
            cells = n1 * N2
            base = np.cumsum(cells) - cells
            place = ((tb.mix(x, 100 + cut) >> np.uint64(32)) * np.repeat(cells, length).astype(np.uint64)
                     >> np.uint64(32)).astype(np.int64) + np.repeat(base, length)
            total = int(cells.sum())
            count = np.bincount(place, minlength=total).reshape(-1, N2)
            low = np.bincount(place, (x & np.uint64(0xFFFFFFFF)).astype(float), total)
            top = np.bincount(place, (x >> np.uint64(32)).astype(float), total)
            value = (low.astype(np.uint64) + (top.astype(np.uint64) << np.uint64(32))).reshape(-1, N2)
            owner = np.repeat(todo, n1)
            label = (np.repeat(band[todo], n1).astype(np.uint64) << np.uint64(40)) + (tb.ragged(n1).astype(np.uint64) << np.uint64(8)) + np.uint64(cut << 4)
            empty = np.zeros(len(owner), np.int64)
            for j in range(N2):         # the subset without sub-part j
                left = count.sum(1) - count[:, j]
                sig = tb.mix(value.sum(1) - value[:, j] + tb.mix(label + np.uint64(j), 7), 8)
                empty |= left == 0
                use = (left > 0) | (cut == CUTS - 1)
                who.append(owner[use])
                sigs.append(sig[use])
            todo = todo[np.bincount(np.repeat(np.arange(len(todo)), n1), empty > 0, len(todo)) > bands.spare[band[todo]]]
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(who), np.concatenate(sigs)


def short(sig: np.ndarray) -> bytes:
    """Signatures without their upper bytes (shards are dealt by those), which vanish in
    the shuffle's compression."""
    return tb.planes(sig & np.uint64((1 << 8 * SIG) - 1))


DEALT = "shard int, ids binary, sizes binary, docs binary, lengths binary, sketches binary, classes binary, counts binary, sigs binary"


def _deal(k: int, percent: int, count: int):
    """Task: documents and the signatures of their classes, as blobs for the shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen, held, n = Bands(percent), set(), [], 0

        def flush():
            ids, sizes, cls, length, sk, owner, sig = (np.concatenate(x) for x in zip(*held))
            start = np.cumsum(length) - length
            rows: dict[int, list] = {}
            for s, i in tb.dealt(tb.shard_of(tb.mix(cls, 11), count), count):
                rows.setdefault(s, [b""] * 8)[:5] = [
                    ids[i].tobytes(), sizes[i].astype(np.int32).tobytes(), cls[i].tobytes(), length[i].astype(np.int32).tobytes(),
                    sk[np.repeat(start[i], length[i]) + tb.ragged(length[i])].tobytes()]
            for s, i in tb.dealt(tb.shard_of(sig, count), count):
                o = owner[i]            # signatures of one set stay together: its hash is sent once
                first = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
                rows.setdefault(s, [b""] * 8)[5:] = [o[first].tobytes(), np.diff(np.append(first, len(o))).astype(np.int32).tobytes(), short(sig[i])]
            keys = list(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), *(pa.array([rows[s][c] for s in keys], pa.binary()) for c in range(8))],
                names=[x.split()[0] for x in DEALT.split(", ")])

        for batch in tb.slices(batches):
            sets, off = shingle_sets(*tb.strings(batch.column("text")), k)
            size, cls = np.diff(off), class_hashes(sets, off)
            known = ~np.asarray(pc.is_null(batch.column("doc_id")).to_numpy(zero_copy_only=False), bool)
            _, first = np.unique(cls, return_index=True)
            new = np.array([i for i in first if size[i] and cls[i] not in seen], np.int64)
            seen.update(cls[new].tolist())
            if len(seen) > 1_000_000:   # only saves repeated signatures of copies
                seen.clear()
            sub = np.concatenate([[0], np.cumsum(size[new])])
            own = sets[np.repeat(off[new], size[new]) + tb.ragged(size[new])]
            who, sig = signatures(own, sub, bands)
            o = np.argsort(who, kind="stable")
            sk, at = sketches(sets, off)
            held.append((tb.longs(batch.column("doc_id")), np.where(known, size, -1 - size), cls, np.diff(at), sk, cls[new][who[o]], sig[o]))
            n += len(sig) + 4 * len(size)
            if n > FLUSH:
                yield flush()
                held.clear()
                n = 0
        if held:
            yield flush()
    return run


GATHERED = "kind int, gid long, cls long, doc_id long, n long, sketch binary"


def _gather(table: pa.Table) -> pa.Table:
    """Shard: its documents (kind 0) and the groups of classes sharing a signature (kind 1)."""
    col = {c: table.column(c).combine_chunks() for c in table.column_names}
    ids, size = tb.unpack(col["ids"], np.int64), tb.unpack(col["sizes"], np.int32).astype(np.int64)
    cls, sk = tb.unpack(col["docs"], np.int64), tb.unpack(col["sketches"], np.uint8)
    at = np.concatenate([[0], np.cumsum(tb.unpack(col["lengths"], np.int32))])
    known = size >= 0
    size = np.where(known, size, -1 - size)
    has = known & (size > 0)
    member = np.repeat(tb.unpack(col["classes"], np.uint64), tb.unpack(col["counts"], np.int32))
    gid, member = shared_groups(tb.from_planes(col["sigs"], np.uint64), member)
    nd, ng = len(ids), len(gid)
    mask = np.concatenate([~known, np.ones(ng, bool)])
    none = np.zeros(ng, np.int64)
    sketch = packed(sk, np.concatenate([at, np.full(ng, at[-1])]))
    return pa.table({
        "kind": pa.array(np.repeat([0, 1], [nd, ng]), pa.int32()),
        "gid": pa.array(np.concatenate([np.zeros(nd, np.int64), gid.view(np.int64)])),
        "cls": pa.array(np.concatenate([cls, member.view(np.int64)]), mask=np.concatenate([~has, none > 0])),
        "doc_id": pa.array(np.concatenate([ids, none]), mask=mask),
        "n": pa.array(np.concatenate([size, none])),
        "sketch": sketch})


def packed(raw: np.ndarray, off: np.ndarray) -> pa.Array:
    """Binary column of the pieces of ``raw`` between byte offsets."""
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def shared_groups(sig: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, member) of the signatures that several members have; groups of the
    same members are one."""
    o = np.argsort(sig)
    s = sig[o]
    same = s[1:] == s[:-1]
    keep = np.zeros(len(s), bool)
    keep[1:] |= same
    keep[:-1] |= same
    o = o[keep]
    s, m = sig[o], member[o]
    o = np.lexsort((m, s))
    s, m = s[o], m[o]
    if len(s):
        keep = np.append(True, (s[1:] != s[:-1]) | (m[1:] != m[:-1]))
        s, m = s[keep], m[keep]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    end = np.append(first[1:], len(s))
    big = end - first > 1
    first, end = first[big], end[big]
    group = tb.span_hash(tb.prefix_sums(m), first, end)
    group, one = np.unique(group, return_index=True)
    first, length = first[one], (end - first)[one]
    return np.repeat(group, length), m[np.repeat(first, length) + tb.ragged(length)]


def _sets(k: int):
    """Task: (class, its sorted shingles) of the given texts."""
    def run(batches):
        for batch in tb.slices(batches):
            sets, off = shingle_sets(*tb.strings(batch.column("text")), k)
            cls = class_hashes(sets, off)
            yield pa.RecordBatch.from_arrays([pa.array(cls.view(np.int64)), packed(sets, off * 8)], names=["cls", "shingles"])
    return run


PAIRS = "a long, b long, ca long, cb long"


def _verified(percent: int):
    """Task: the pairs whose whole sets are similar enough."""
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b", "ca", "cb"]).filter(pa.array(ok, pa.bool_()))
    return run


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of every row of ``a`` against every row of ``b``."""
    d = np.zeros((len(a), len(b)), np.int64)
    for w in range(a.shape[1]):
        d += np.bitwise_count(a[:, w][:, None] ^ b[:, w][None, :])
    return d


def _plausible(percent: int):
    """Task: the pairs that the sketches do not rule out."""
    def run(batches):
        for batch in batches:
            na, nb = (np.asarray(batch.column(c)) for c in ("na", "nb"))
            ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            for i in np.flatnonzero(ok):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("ka", "kb"))
                size = min(len(x), len(y))
                d = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
                ok[i] = d <= (100 - percent) * (na[i] + nb[i]) // (100 + percent)
            yield batch.select(["a", "b", "ca", "cb"]).filter(pa.array(ok))
    return run


class Cells:
    """The cells of a shard, each with the classes of (at most two blocks of) a group."""

    def __init__(self, table: pa.Table, percent: int):
        self.percent = percent
        self.key, self.cls, self.comp, self.n, self.side = (np.asarray(table.column(c)) for c in ("key", "cls", "comp", "n", "side"))
        raw, at = tb.strings(table.column("sketch"))
        self.raw, self.at = np.frombuffer(raw.tobytes(), np.uint64), at // 8

    def __iter__(self) -> Iterator[np.ndarray]:
        """Rows of every cell that holds several components."""
        o = np.argsort(self.key, kind="stable")
        cut = np.append(np.flatnonzero(np.append(True, self.key[o][1:] != self.key[o][:-1])), len(o)) if len(o) else [0]
        for s, e in zip(cut[:-1], cut[1:]):
            comp = self.comp[o[s:e]]
            if (comp != comp[0]).any():
                yield o[s:e]

    def plausible(self, i: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(left rows, right rows, whether sizes and sketches allow a link between
        different components, differing bits), as numbers within the cell, some rows at
        a time."""
        width = int((self.at[i + 1] - self.at[i]).min())
        sk = np.stack([folded(self.raw[self.at[j]:self.at[j + 1]], width) for j in i])
        n, comp = self.n[i], self.comp[i]
        left, right = np.flatnonzero(self.side[i] <= 1), np.flatnonzero(self.side[i] >= 1)
        for first in range(0, len(left), 256):
            x = left[first:first + 256]
            total = n[x][:, None] + n[right][None, :]
            d = _differing(sk[x], sk[right])
            ok = d <= (100 - self.percent) * total // (100 + self.percent)
            ok &= 100 * np.minimum(n[x][:, None], n[right][None, :]) >= self.percent * np.maximum(n[x][:, None], n[right][None, :])
            yield x, right, ok & (comp[x][:, None] != comp[right][None, :]), d


NEAREST = PAIRS + ", d long"
CELL = "key long, cls long, comp long, n long, side int, sketch binary"


def _nearest(percent: int):
    """Shard: for the classes of each cell, the nearest one of another component that
    may be linked (``d``: differing bits)."""
    def run(table: pa.Table) -> pa.Table:
        cells, out = Cells(table, percent), []
        for i in cells:
            least, to = np.full(len(i), FAR), np.zeros(len(i), np.int64)
            for left, right, ok, d in cells.plausible(i):
                d[~ok] = FAR
                for mine, others, away in ((left, right, d), (right, left, d.T)):
                    at = away.argmin(1)
                    best = away[np.arange(len(mine)), at]
                    closer = best < least[mine]
                    least[mine[closer]], to[mine[closer]] = best[closer], others[at[closer]]
            x = np.flatnonzero(least < FAR)
            a, b = i[x], i[to[x]]
            out.append(np.stack([cells.cls[a], cells.cls[b], cells.comp[a], cells.comp[b], least[x]]))
        pair = np.concatenate(out, 1) if out else np.zeros((5, 0), np.int64)
        return pa.table({c.split()[0]: pa.array(pair[j], pa.int64()) for j, c in enumerate(NEAREST.split(", "))})
    return run


def _seekers(percent: int):
    """Shard: the classes of each cell that may link to another component there. At
    most the rows that came in, however many pairs are behind them. Cells of which the
    same classes are left (on the same sides) get the same key."""
    def run(table: pa.Table) -> pa.Table:
        cells, found = Cells(table, percent), []
        for i in cells:
            use = np.zeros(len(i), bool)
            for left, right, ok, _ in cells.plausible(i):
                use[left[ok.any(1)]] = True
                use[right[ok.any(0)]] = True
            x = i[use]
            found.append(x[np.argsort(cells.cls[x])])
        length = np.array([len(x) for x in found], np.int64)
        length, rows = length[length > 0], np.concatenate(found) if found else np.zeros(0, np.int64)
        sums = tb.prefix_sums(tb.mix(cells.cls[rows].view(np.uint64) ^ tb.mix(cells.side[rows].astype(np.uint64), 13), 14))
        end = np.cumsum(length)
        key = np.repeat(tb.span_hash(sums, end - length, end), length).view(np.int64)
        out = table.select([c.split()[0] for c in CELL.split(", ")]).take(pa.array(rows))
        return out.set_column(0, "key", pa.array(key, pa.int64()))
    return run


def _forest(percent: int):
    """Shard: links between the components of each cell, verified on the whole sets. A
    pair is not looked at once the cell's links connect it, so a cell gives fewer links
    than it has components."""
    def run(table: pa.Table) -> pa.Table:
        cells, out = Cells(table, percent), []
        raw, at = tb.strings(table.column("shingles"))
        shingles, at = np.frombuffer(raw.tobytes(), np.uint64), at // 8
        for i in cells:
            size = at[i + 1] - at[i]
            start = np.cumsum(size) - size
            _, element = np.unique(shingles[np.repeat(at[i], size) + tb.ragged(size)], return_inverse=True)
            mark = np.zeros(int(element.max()) + 1, bool)
            comp = cells.comp[i].copy()
            for left, right, ok, _ in cells.plausible(i):
                for x in np.flatnonzero(ok.any(1)):
                    a = left[x]
                    other = right[ok[x]]
                    other = other[comp[other] != comp[a]]
                    if not len(other):
                        continue
                    mine = element[start[a]:start[a] + size[a]]
                    mark[mine] = True
                    for some in np.array_split(other, 1 + int(size[other].sum()) // PAIRED):
                        length = size[some]
                        hit = mark[element[np.repeat(start[some], length) + tb.ragged(length)]]
                        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(length) - length)
                        for b in some[100 * common >= percent * (size[a] + length - common)]:
                            if comp[a] != comp[b]:
                                out.append((cells.cls[i[a]], cells.cls[i[b]], cells.comp[i[a]], cells.comp[i[b]]))
                                comp[comp == comp[b]] = comp[a]
                    mark[mine] = False
        pair = np.array(out, np.int64).reshape(-1, 4)
        return pa.table({c.split()[0]: pa.array(pair[:, j], pa.int64()) for j, c in enumerate(PAIRS.split(", "))})
    return run


def common(sets: np.ndarray, off: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(left set, its common elements with each of the right sets) of the sets between
    offsets. An element that most of the right sets hold is known by those that lack it, so
    near copies cost what they differ in."""
    size = np.diff(off)
    _, element = np.unique(sets, return_inverse=True)
    n = len(right)
    of = np.repeat(np.arange(n), size[right])
    held = element[np.repeat(off[right], size[right]) + tb.ragged(size[right])]
    often = np.bincount(held, minlength=int(element.max(initial=-1)) + 1)
    most = 2 * often > n
    number = np.cumsum(most) - 1
    lacks = np.ones((int(most.sum()), n), bool)         # under twice as many cells as ``held`` has
    lacks[number[held[most[held]]], of[most[held]]] = False
    row, lacking = np.nonzero(lacks)
    held, of = held[~most[held]], of[~most[held]]
    held, of = np.concatenate([held, np.flatnonzero(most)[row]]), np.concatenate([of, lacking])
    of = of[np.argsort(held, kind="stable")]
    length = np.bincount(held, minlength=len(most))
    start = np.cumsum(length) - length

    def listed(e: np.ndarray) -> np.ndarray:
        return np.bincount(of[np.repeat(start[e], length[e]) + tb.ragged(length[e])], minlength=n)

    for x in left:
        e = element[off[x]:off[x + 1]]
        usual = most[e]
        yield x, listed(e[~usual]) + int(usual.sum()) - listed(e[usual])


LINKS = "cls long, n_links long"


def _links(percent: int):
    """Shard: for each class of each cell, how many others there it is linked with."""
    def run(table: pa.Table) -> pa.Table:
        key, cls, side = (np.asarray(table.column(c)) for c in ("key", "cls", "side"))
        raw, at = tb.strings(table.column("shingles"))
        shingles, at = np.frombuffer(raw.tobytes(), np.uint64), at // 8
        # a class with a text under a repeated id may come twice
        o = np.lexsort((cls, key))
        o = o[np.append(True, (key[o][1:] != key[o][:-1]) | (cls[o][1:] != cls[o][:-1]))[:len(o)]]
        edge = np.flatnonzero(np.append(True, key[o][1:] != key[o][:-1])[:len(o)])
        links = np.zeros(len(o), np.int64)
        for s, e in zip(edge, np.append(edge[1:], len(o))):
            i = o[s:e]
            size = at[i + 1] - at[i]
            off = np.concatenate([[0], np.cumsum(size)])
            left, right = np.flatnonzero(side[i] <= 1), np.flatnonzero(side[i] >= 1)
            if not len(left) or not len(right):
                continue
            for x, both in common(shingles[np.repeat(at[i], size) + tb.ragged(size)], off, left, right):
                ok = (100 * both >= percent * (size[x] + size[right] - both)) & (right != x)
                links[s + x] += ok.sum()
                if side[i[x]] == 0:         # other blocks: the pair is looked at from here only
                    links[s + right[ok]] += 1
        return pa.table({"cls": pa.array(cls[o], pa.int64()), "n_links": pa.array(links, pa.int64())})
    return run


def _sent(ids: DataFrame) -> DataFrame:
    """Ids to be joined with the texts. Up to ``FEW`` go to the texts' tasks; the other way
    round every text would be shuffled for a few of them."""
    ids = tb.checkpointed(ids, "ids")
    return F.broadcast(ids) if ids.count() <= FEW else ids


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Documents (doc_id, text) linked when the Jaccard similarity of their ``k``-word
    shingle sets is at least ``percent`` / 100. Returns one row per document: doc_id,
    n_shingles, component_id (smallest doc_id reachable by links, its own included),
    class_id (smallest doc_id with the same set), n_copies (documents of the class) and
    n_links_found (all links of the class to other classes)."""
    spark = tb.text_session(docs.sparkSession)
    count = tb.shards(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = tb.checkpointed(
        texts.mapInArrow(_deal(k, percent, count), DEALT).groupBy("shard").applyInArrow(_gather, GATHERED), "jaccard")
    rows = found.where("kind = 0")
    classes = tb.checkpointed(
        rows.where("cls is not null").groupBy("cls")
        .agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    members = tb.checkpointed(found.where("kind = 1").select("gid", "cls").distinct(), "members")

    def whole_sets(ends: DataFrame) -> DataFrame:
        """(cls, shingles) of the given classes, made again from one text of each."""
        ids = _sent(ends.join(classes, "cls").select(F.col("class_id").alias("doc_id")))
        return tb.checkpointed(
            texts.join(ids, "doc_id").select("text").mapInArrow(_sets(k), "cls long, shingles binary").dropDuplicates(["cls"]), "sets")

    # every class with the hub it shares most groups with
    hubs = members.groupBy("gid").agg(F.min("cls").alias("hub"))
    first = (members.join(hubs, "gid").where("cls <> hub").groupBy("cls", "hub").count()
             .groupBy("cls").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
             .select(F.col("cls").alias("a"), F.col("hub").alias("b")))
    for side in "ab":
        first = first.join(classes.select(F.col("cls").alias(side), F.col("class_id").alias("c" + side), F.col("n").alias("n" + side),
                                          F.col("sketch").alias("k" + side)), side)
    sets = None                     # whole sets of the classes met so far

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among the pairs (a row or so for each class), on their whole sets."""
        nonlocal sets
        ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        sets = whole_sets(ends) if sets is None else sets.union(whole_sets(ends.join(sets.select("cls"), "cls", "left_anti")))
        return tb.checkpointed(
            pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
            .mapInArrow(_verified(percent), PAIRS), "links")

    def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
        """Classes with their components after the links between components."""
        label = components(links, "ca", "cb")
        return tb.checkpointed(comp.join(label, F.col("comp") == F.col("node"), "left")
                               .select("cls", "class_id", "n", "n_copies", "sketch", F.coalesce("component", "comp").alias("comp")), "comp")

    shard = F.pmod(F.col("key"), F.lit(count)).alias("shard")
    columns = [c.split()[0] for c in CELL.split(", ")]

    def blocked(inside: DataFrame, group: str) -> DataFrame:
        """The classes of groups of ``blocks`` blocks, in every cell that theirs is in."""
        return (inside.withColumn("x", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
                .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .withColumn("key", F.xxhash64(group, F.least("x", "y"), F.greatest("x", "y")))
                # 0: left side of the cell, 2: right side, 1: both
                .withColumn("side", F.when(F.col("x") < F.col("y"), 0).when(F.col("x") > F.col("y"), 2).otherwise(1)))

    def cells(comp: DataFrame, members: DataFrame) -> DataFrame:
        """Groups that still hold several components, in cells of at most two blocks."""
        inside = members.join(comp.select("cls", "comp", "n", "sketch"), "cls")
        open_ = (inside.groupBy("gid").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("elements"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                 .where("lo <> hi").select("gid", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("elements") / ELEMENTS)).cast("int").alias("blocks")))
        return blocked(inside.join(open_, "gid"), "gid").select(shard, *columns).groupBy("shard")

    hub_links = verified(tb.checkpointed(first.mapInArrow(_plausible(percent), PAIRS), "hubs"))
    comp = joined(classes.withColumn("comp", F.col("class_id")), hub_links)
    nearest = tb.checkpointed(
        cells(comp, members).applyInArrow(_nearest(percent), NEAREST).groupBy("a")
        .agg(F.min_by(F.struct("b", "ca", "cb"), F.struct("d", "b")).alias("to")).select("a", "to.*"), "nearest")
    near_links = verified(nearest)
    comp = joined(comp, near_links)
    # components only grow: both ends of what may still link had a nearest, and their sets are there
    left = members.join(nearest.select(F.col("a").alias("cls")), "cls", "left_semi")
    seekers = tb.checkpointed(cells(comp, left).applyInArrow(_seekers(percent), CELL).dropDuplicates(["key", "cls"]), "seekers")
    # whole sets are large and go to several cells: cells are dealt to groups that hold TOGETHER
    # shingles on average, whatever the number of partitions
    shingles = seekers.agg(F.sum("n")).first()[0] or 0
    part = F.pmod(F.xxhash64("key"), F.lit(max(count, -(-shingles // TOGETHER)))).alias("part")
    more = tb.checkpointed(
        seekers.join(sets, "cls").select(part, *columns, "shingles").groupBy("part").applyInArrow(_forest(percent), PAIRS), "links")
    label = components(more, "ca", "cb")

    ends = tb.checkpointed(
        comp.join(label, F.col("comp") == F.col("node"), "left")
        .select("cls", "class_id", "n", "n_copies", F.coalesce("component", "comp").alias("component_id")), "components")

    # all links: two classes of one component have theirs, three or more are counted on their
    # sets, which are there (a class joins a component by a link verified on them)
    several = ends.groupBy("component_id").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("elements")).where("m > 1")
    blocks = F.ceil(F.greatest(F.col("m") / CROWD, F.col("elements") / ELEMENTS)).cast("int")
    inside = ends.join(several.withColumn("blocks", blocks), "component_id")
    shingles = several.where("m > 2").agg(F.sum(F.col("elements") * blocks)).first()[0] or 0
    part = F.pmod(F.xxhash64("key"), F.lit(max(count, -(-shingles // TOGETHER)))).alias("part")
    counted = (blocked(inside.where("m > 2"), "component_id").join(sets, "cls").select(part, "key", "cls", "side", "shingles")
               .groupBy("part").applyInArrow(_links(percent), LINKS))
    degree = (counted.union(inside.where("m = 2").select("cls", F.lit(1).cast("long"))).groupBy("cls").agg(F.sum("n_links").alias("n_links_found")))
    return (rows.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(ends.drop("n"), "cls", "left").join(degree, "cls", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                    F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
                    F.coalesce("n_links_found", F.lit(0)).cast("long").alias("n_links_found")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are not the first (smallest id) of their
    component. A repeated row of a kept document stays; a null id stays."""
    found = jaccard_components(docs, k, percent)
    gone = _sent(found.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti")


def op3_partenum_jaccard(spark, sf_dir: str) -> DataFrame:
    """Production parameters: four-word shingles, similarity 0.85, all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
