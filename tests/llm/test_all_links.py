"""The join's links: every one is counted, at every threshold."""

import numpy as np
import pyarrow as pa
import pytest

from callwise.llm import jaccard_join as jj
from test_jaccard_groups import texts


def brute(rows, k, percent):
    """Links of each document's set to other sets that a document with an id has."""
    sets = []
    for i, t in rows:
        w = (t or "").split()
        sets.append(frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    different = {s for (i, _), s in zip(rows, sets) if s and i is not None}
    links = {s: sum(100 * len(s & o) >= percent * len(s | o) for o in different if o != s) for s in different}
    return sorted((i if i is not None else -1, links.get(s, 0) if i is not None else 0) for (i, _), s in zip(rows, sets))


@pytest.mark.parametrize("crowd, elements, percent", [(8192, 2_000_000, 85), (16, 2_000_000, 85), (8192, 3000, 50)])
def test_every_link_is_counted(spark, monkeypatch, crowd, elements, percent):
    """Before, classes that were connected already were not compared, and most links of a
    large group had no part in its documents' numbers."""
    monkeypatch.setattr(jj, "CROWD", crowd)
    monkeypatch.setattr(jj, "ELEMENTS", elements)
    rows = texts()
    of = dict(rows)
    rows += [(None, of[3]), (None, "an unseen text of six words"), (5, of[3]), (7, of[5]), (7, of[9])]    # ids that repeat, over different texts
    found = jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, percent).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_links_found) for r in found) == brute(rows, 4, percent)


@pytest.mark.parametrize("percent", [30, 50, 65, 85])
def test_sets_sign_in_every_band_between(percent):
    """Below 0.72 a set reaches more than the next band; the bands between were left out."""
    bands, r = jj.Bands(percent), np.random.default_rng(2)
    for n in range(5, 200, 7):
        for m in {n * 100 // percent, (n + n * 100 // percent) // 2, n * 5 // 4, n * 3 // 2}:
            if m <= n or 100 * n < percent * m:
                continue
            y = r.choice(1 << 60, m, replace=False).astype(np.uint64)
            who, sig = jj.signatures(np.concatenate([np.sort(y[:n]), np.sort(y)]), np.array([0, n, n + m]), bands)
            assert len(np.intersect1d(sig[who == 0], sig[who == 1])), (n, m)


@pytest.mark.parametrize("seed", range(4))
def test_common_elements(seed):
    r = np.random.default_rng(seed)
    base = r.choice(10 ** 6, 40, replace=False)
    sets = [np.unique(np.append(r.choice(base, r.integers(0, 41), replace=False), r.integers(0, 10 ** 6, r.integers(0, 5)))).astype(np.uint64) for _ in range(25)]
    off = np.cumsum([0, *map(len, sets)])
    for left, right in ((np.arange(25), np.arange(25)), (np.arange(9), np.arange(9, 25)), (np.arange(3), np.array([20]))):
        got = {x: both.tolist() for x, both in jj.common(np.concatenate(sets), off, left, right)}
        assert got == {x: [len(np.intersect1d(sets[x], sets[y])) for y in right] for x in left}


def test_a_class_that_comes_twice_counts_once():
    sets = [np.arange(i, i + 100, dtype=np.uint64) for i in (0, 1, 1, 2, 500)]
    off = np.arange(6) * 100
    table = pa.table({"key": pa.array([4, 4, 4, 4, 9], pa.int64()), "cls": pa.array([1, 2, 2, 3, 4], pa.int64()), "side": pa.array([1] * 5, pa.int32()),
                      "shingles": jj.packed(np.concatenate(sets), off * 8)})
    got = jj._links(85)(table).to_pylist()
    assert {r["cls"]: r["n_links"] for r in got} == {1: 2, 2: 2, 3: 2, 4: 0} and len(got) == 4
    assert jj._links(85)(table.slice(0, 0)).num_rows == 0


def test_links_are_not_counted_where_nobody_reads_them(spark):
    """The pipeline only asks who is removed."""
    docs = spark.createDataFrame(texts()[:60], "doc_id long, text string")
    found = jj.jaccard_components(docs)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan(found)
    assert "FlatMapGroupsInArrow" not in plan(found.where("doc_id <> component_id").select("doc_id").distinct())
