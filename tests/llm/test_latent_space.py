"""The latent space of the benchmark search: fitted to all passages; its bounds lose nothing."""
from collections import Counter

import numpy as np
import pyarrow as pa

from callwise.llm import decontaminate as dc


def corpus(seed=5, n=300):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [(i, text(int(rng.integers(15, 45)))) for i in range(20)]
    return items, [(i, text(int(rng.integers(0, 200)))) for i in range(n)] + [(None, None), (7, ""), (8, "nothing of it")]


def test_the_space_is_fitted_to_all_passages(spark, monkeypatch):
    items, rows = corpus()
    seen = []
    real = dc.latent_space
    monkeypatch.setattr(dc, "SKETCH", 20)
    monkeypatch.setattr(dc, "latent_space", lambda y, x: seen.append(y.copy()) or real(y, x))
    dc.leaks_of_block(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), items)
    block = dc.Items(items)
    number = {h: i for i, h in enumerate(block.vocabulary.tolist())}
    docs = [block._words(t).tolist() for _, t in rows]
    df = Counter(t for d in docs for t in {number[h] for h in d if h in number})
    weights = np.log((2 + len(rows)) / (1 + np.array([df[i] for i in range(len(number))])))
    passages, a = 0, []
    for d in docs:
        starts = range(0, len(d), dc.STRIDE)
        passages += len(starts)
        for s in starts:
            if s and s + dc.STRIDE >= len(d):
                continue            # the last block belongs to the passage before
            v = np.zeros(len(number))
            for h in d[s:s + dc.PASSAGE]:
                if h in number:
                    v[number[h]] += weights[number[h]]
            # a passage's length adds the squares of its words one by one
            length = np.sqrt(sum(weights[number[h]] ** 2 for h in d[s:s + dc.PASSAGE] if h in number))
            if length:
                a.append(v / length)
    a, x = np.array(a), block.vectors(weights)
    omega = dc.omega(len(number), min(dc.RANK, len(number))).astype(float)
    want = a.T @ (a @ omega) + (1 + passages) * (x.T @ (x @ omega))
    assert np.allclose(seen[0], want, rtol=1e-3, atol=1e-3 * np.abs(want).max())


def test_shared_words_bound_the_common_subsequence():
    items, rows = corpus(6, 40)
    block = dc.Items(items)
    weights = np.ones(len(block.vocabulary))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    (hits,) = dc._hits(block.vocabulary)(iter([batch]))
    p = dc.Passages.read(hits, weights)
    i, j = (x.ravel() for x in np.mgrid[:len(p.doc), :len(items)])
    shared = dc._Shared(block.terms, len(weights))(p, i, j)
    number = {h: n for n, h in enumerate(block.vocabulary.tolist())}
    for i, j, s, a, z in zip(i, j, shared, *p.around(i, np.array([len(w) for w in block.words])[j])):
        w = block._words(rows[p.doc[i]][1]).tolist()
        n = len(block.words[j])
        text = [number[h] for h in w[max(0, p.start[i] - n):p.start[i] + dc.PASSAGE + n] if h in number]
        assert p.term[a:z].tolist() == text
        assert s == sum((Counter(text) & Counter(block.terms[j].tolist())).values())
        assert dc.common_subsequence(block.terms[j], p.term[a:z]) <= s
