"""Paths of done states are let go while a search descends, without another result."""
import numpy as np
import pyarrow as pa

from callwise.llm import ranked_search as rs
from callwise.llm.hard_negatives import Best


def test_pools_keep_what_is_open(monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 60)))) for _ in range(3000)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    w = rs.terms(batch.column("text"))
    h, d, impact = rs.postings(batch, len(texts), int(w.counts.sum()))
    s = rs.Shard(rs.shard(np.arange(len(texts)) * 7, h, d, impact))
    items = rs.Items([(i, " ".join(rng.choice(words, 12))) for i in range(10)])
    weight = rng.integers(1, 9, len(items.terms))[items.of]
    found, largest = [], []
    real = rs._Pool.add
    monkeypatch.setattr(rs._Pool, "add", lambda self, *v: largest.append(self.n + len(v[0])) or real(self, *v))
    for spare in (10 ** 9, 0):
        monkeypatch.setattr(rs, "SPARE", spare)
        largest.clear()
        best = Best(rs.TOP, np.ones(len(items.ids)))
        rs.descend(s, items.item, s.rows_of(items.term), weight, best)
        found.append([c.tolist() for c in best.rows] + [max(largest)])
    assert found[0][:-1] == found[1][:-1] and len(found[0][0]) == 10 * rs.TOP
    assert found[1][-1] < found[0][-1]


def test_kept_rows_of_a_pool():
    p = rs._Pool(np.int64, np.int32)
    p.add(np.arange(5), np.arange(5) * 2)
    p.keep(np.array([4, 1]))
    assert p.add(np.array([9]), np.array([8])).tolist() == [2]
    assert p.columns[0][:p.n].tolist() == [4, 1, 9] and p.columns[1][:p.n].tolist() == [8, 2, 8]
