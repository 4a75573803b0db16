"""How much the near-copy join deals, sends and verifies."""

import numpy as np
import pyarrow as pa
import pytest

from callwise.llm import jaccard_join as jj


def random_sets(sizes, seed=1):
    r = np.random.default_rng(seed)
    sets = [np.sort(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in sizes]
    return np.concatenate(sets), np.cumsum([0, *sizes])


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_sets_that_reach_a_band_from_below_sign_about_once(percent):
    """Before, at 0.8 most of these signed again and again under other cuts, at last with
    their empty subsets."""
    bands = jj.Bands(percent)
    edge = int(bands.low[bands.of(np.array([1000]))[0]])
    sizes = np.arange(-(-edge * percent // 100), edge)
    assert (bands.reach(sizes) > bands.of(sizes)).all()
    flat, off = random_sets(sizes)
    who, _ = jj.signatures(flat, off, bands)
    once = jj.N2 * (bands.n1[bands.of(sizes)] + bands.n1[bands.reach(sizes)])
    assert len(who) < 1.2 * once.sum()


def test_spare_parts_follow_the_threshold():
    assert jj.spare_share(85) == jj.spare_share(90) == jj.spare_share(100) == jj.SPARE
    assert jj.SPARE < jj.spare_share(80) < 0.3
    assert jj.spare_share(50) == jj.SPARE      # no share suits; the cuts do it
    bands = jj.Bands(80)
    assert (bands.k < (bands.n1 - bands.spare) * (jj.K2 + 1)).all()


def test_linked_sets_share_a_signature_as_dealt():
    """Sets at the threshold, whichever band they are in: none of the links is lost."""
    r = np.random.default_rng(3)
    sets = []
    for n in [6, 9, 20, 45, 63, 100, 177, 260, 420, 777, 1300]:
        for _ in range(6):
            a = r.choice(1 << 60, n, replace=False).astype(np.uint64)
            cut = n - n * 80 // 100             # the second set is the first without a fifth
            sets += [np.sort(a), np.sort(a[cut:])]
    flat, off = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    who, sig = jj.signatures(flat, off, jj.Bands(80))
    blob = pa.array([jj.short(sig)], pa.binary())
    assert not any(blob[0].as_py()[jj.SIG * len(sig):])     # nothing to send above them
    sent = jj.tb.from_planes(blob, np.uint64)
    assert (sent == sig & np.uint64((1 << 8 * jj.SIG) - 1)).all()
    for i in range(0, len(sets), 2):
        x, y = sets[i], sets[i + 1]
        if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)):
            assert len(np.intersect1d(sent[who == i], sent[who == i + 1]))


def test_cells_of_the_same_classes_get_one_key():
    """Two groups of which the same classes may link are verified once."""
    near = [np.sort(np.append(np.arange(200, dtype=np.uint64), np.uint64(1000 + i))) for i in range(3)]
    far = [np.arange(10_000 * j, 10_000 * j + 200, dtype=np.uint64) for j in (1, 2)]
    cells = [(7, [0, 1, 2, 3]), (8, [4, 2, 1, 0]), (9, [0, 1])]
    which = [(key, i) for key, members in cells for i in members]
    flat = near + far
    off = np.cumsum([0, *(len(flat[i]) for _, i in which)])
    sk, at = jj.sketches(np.concatenate([flat[i] for _, i in which]), off)
    ids = np.array([i for _, i in which])
    table = pa.table({"key": pa.array([k for k, _ in which], pa.int64()), "cls": pa.array(ids), "comp": pa.array(ids),
                      "n": pa.array([len(flat[i]) for i in ids], pa.int64()), "side": pa.array(np.ones(len(ids), np.int32)), "sketch": jj.packed(sk, at)})
    got = jj._seekers(85)(table)
    assert got.column_names == [c.split()[0] for c in jj.CELL.split(", ")]
    of = {}
    for r in got.to_pylist():
        of.setdefault(r["key"], []).append(r["cls"])
    assert sorted(sorted(set(v)) for v in of.values()) == [[0, 1], [0, 1, 2]]
    sides = table.set_column(4, "side", pa.array([0, 0, 2, 2, 0, 2, 2, 0, 1, 1], pa.int32()))
    assert len(set(jj._seekers(85)(sides)["key"].to_pylist())) == 3     # other sides, other pairs
    assert jj._seekers(85)(table.slice(0, 0)).num_rows == 0


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_texts_are_fetched_by_either_join(spark, monkeypatch, few):
    monkeypatch.setattr(jj, "FEW", few)
    words = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-3])), (3, " ".join(words[4:])), (4, "other words"), (None, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jj.jaccard_components(docs, 5, 80).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, None: None}
    kept = jj.keep_one(docs, 5, 80)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (few > 0)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4]
