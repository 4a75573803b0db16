"""Examples that once went wrong."""
import itertools

import numpy as np
import pyarrow as pa
import pytest

from callwise.llm import decontaminate as dc
from callwise.llm import packing

# fixed values: the characters with the property White_Space
WHITE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


@pytest.fixture(scope="module")
def encoders():
    import public_tokenizers
    from tokenizers import Tokenizer
    return packing.Encoder(*packing.vocabulary()), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def same_ids(encoders, texts):
    mine, theirs = encoders
    data = [t.encode() for t in texts]
    ids, at = mine.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64), 0)
    for i, t in enumerate(texts):
        want = [*theirs.encode(t, add_special_tokens=False).ids, 0]
        assert ids[at[i]:at[i + 1]].tolist() == want, repr(t)


def test_ids_around_every_white_space_character(encoders):
    texts = [f"{a}{w} {v}{b}" for w in WHITE for v in ("", w, " ", "x") for a in ("", "a", w, "é") for b in ("", "b", ".", w + "c")]
    texts += [f"a {w}b" for w in WHITE] + [f"a{w} b" for w in WHITE] + [f"{w} {w} {w}" for w in WHITE]
    texts += ["".join(x) for x in itertools.product("a \xa0　.", repeat=4)]
    texts += ["‐ a", "​ b ​", "\xc2\xa0 \xe2\x80", "ᚁ   ᙿ", "zero⁠ width"]
    same_ids(encoders, texts)
    same_ids(encoders, ["".join(texts), " ".join(texts), "\xa0 ".join(texts)])


def test_projection_is_the_product_of_the_passages(monkeypatch):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 5, 16, 17, 33, 200)] + [None, "other words only"]
    items = dc.Items([(1, " ".join(words[:40]))])
    weights = rng.uniform(0.5, 2, len(items.vocabulary))
    p = dc.Passages(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}), items.vocabulary, weights)
    basis = rng.normal(size=(len(items.vocabulary), 7)).astype(np.float32)
    want = np.zeros((len(p.doc), 7))
    number = {h: i for i, h in enumerate(items.vocabulary.tolist())}
    y, total = rng.normal(size=(len(p.doc), 7)).astype(np.float32), np.zeros((len(items.vocabulary), 7))
    for i, (d, s) in enumerate(zip(p.doc, p.start)):
        w = p.hashes[p.words.first[d] + s:min(p.words.first[d + 1], p.words.first[d] + s + dc.PASSAGE)]
        for t in (number[h] for h in w.tolist() if h in number):
            want[i] += basis[t]
            total[t] += y[i]
    want /= p.length[:, None]
    assert len(p.doc) > 12 and np.allclose(p.projected(basis), want, atol=1e-4)
    for most in (1, 30, 10 ** 6):
        parts, spread, at = list(p.pieces(most)), np.zeros_like(total, dtype=np.float32), 0
        for q in parts:
            assert np.allclose(q.projected(basis), want[at:at + len(q.doc)], atol=1e-4)
            q.spread(y[at:at + len(q.doc)], spread)
            at += len(q.doc)
        assert at == len(p.doc) and np.allclose(spread, total, atol=1e-3)


@pytest.mark.parametrize("sketch", [20, 10 ** 9])
def test_leaks_are_found_whatever_the_sample_of_the_sketch(spark, monkeypatch, sketch):
    """Verbatim items inside other text, and items with every eighth word replaced."""
    monkeypatch.setattr(dc, "SKETCH", sketch)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [(i, text(int(rng.integers(15, 45)))) for i in range(120)]
    docs = [(i, text(int(rng.integers(20, 400)))) for i in range(300)]
    planted = []
    for i, t in items:
        w = t.split()
        if i % 2:
            w[::8] = [f"z{j}" for j in range(len(w[::8]))]
        docs.append((1000 + i, f"{text(60)} {' '.join(w)} {text(60)}"))
        planted.append((1000 + i, i))
    found = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    verbatim = [p for p in planted if p[1] % 2 == 0]
    assert all(p in got for p in verbatim)
    assert len(got & set(planted)) >= 0.9 * len(planted)
    assert all(d >= 1000 for d, _ in got)


def test_rows_that_share_an_id_are_cut_each_by_itself(spark):
    """Words and bytes: two texts of one id, the same row twice, an id that also has a short text."""
    from callwise.llm import lempel_ziv, suffix_dedup
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(4000)]
    passage = lambda n: " ".join(rng.choice(words, n))
    a, b, c = passage(70), passage(70), passage(70)
    rows = [(1, a), (2, f"{passage(30)} {a}"), (2, b), (2, b), (3, f"{b} {passage(5)}"), (3, "short"), (3, f"x {a}"), (4, c), (4, f"{c} tail"), (5, None), (5, c), (6, ""), (6, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for j in range(len(w) - 49):
            k = tuple(w[j:j + 50])
            first[k] = min(first.get(k, i), i)
    want = []
    for i, t in rows:
        w, gone = (t or "").split(), set()
        for j in range(len(w) - 49):
            if first[tuple(w[j:j + 50])] < i:
                gone.update(range(j, j + 50))
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert sorted(tuple(r) for r in lempel_ziv.without_copies(df).collect()) == sorted(want)
    first = {}
    for i, t in rows:
        d = (t or "").encode()
        for j in range(len(d) - 99):
            first[d[j:j + 100]] = min(first.get(d[j:j + 100], (i, j)), (i, j))
    want = []
    for i, t in rows:
        d, gone = (t or "").encode(), set()
        for j in range(len(d) - 99):
            if first[d[j:j + 100]] < (i, j):
                gone.update(range(j, j + 100))
        want.append((i, len(d), len(gone), sum(p - 1 not in gone for p in gone), bytes(x for j, x in enumerate(d) if j not in gone)))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.without_copies(df).collect()) == sorted(want)


def test_texts_of_documents_without_id_are_masked_each_by_itself(spark):
    from callwise.llm import secret_scan
    rows = [(None, "password = hunter2x9"), (None, "the dog hunter2x9 barks alone"), (7, "password = k1ttens4u"), (7, "two k1ttens4u sleep")]
    got = sorted(r.text for r in secret_scan.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([f"password = {secret_scan.MASK}", "the dog hunter2x9 barks alone", f"password = {secret_scan.MASK}", "two k1ttens4u sleep"])


def test_columns_of_any_name_pass_through_the_stages(spark):
    from callwise.llm import quality_rules, secret_scan, sharding
    prose = " ".join(f"Number{i} is a line of word{i} and thing{i}, as name{i} said in year{i}." for i in range(12))
    names = ["_id", "_key", "_doc", "_secrets", "_before", "_n", "_lane", "_rank", "_t", "_w", "_raw", "_one", "_flat", "n_words", "kept", "lane_", "probability"]
    row = (1, prose, 5, *[f"v{i}" for i in range(len(names))])
    df = spark.createDataFrame([row], "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for stage in (secret_scan.redacted, quality_rules.clean, sharding.sharded):
        out = stage(df).first()
        assert [out[n] for n in names] == [f"v{i}" for i in range(len(names))], stage
    assert quality_rules.clean(df).columns == secret_scan.redacted(df).columns == df.columns


def test_warc_headers_as_they_occur():
    import time
    from callwise.llm import warc
    body = b"HTTP/1.1 200 OK\r\nServer:x\r\n\r\n<html><p>a</p></html>"
    record = b"WARC/1.0\r\nWARC-Type:response\r\nWARC-Record-ID: <urn:x>\r\nX-Long: one\r\n two\r\nX-Latin: caf\xe9\r\nodd\r\nContent-Length:%d\r\n\r\n" % len(body) + body
    headers, block = warc.parsed(record)
    assert block == body and headers["WARC-Type"] == "response" and headers["X-Long"] == "one two" and headers["X-Latin"] == "caf\xe9"
    kinds = [kind for kind, *_ in warc.derived(record)]
    assert kinds == ["metadata", "conversion"]
    for kind in (b"request", b"warcinfo", b"revisit"):
        assert warc.derived(record.replace(b"WARC-Type:response", b"WARC-Type: " + kind)) == []
    t = time.time()
    assert warc.plain_text("<head " * 100_000 + "x") is not None
    assert warc.plain_text("<head><title>t</title></head>a<p>b") == "a\nb"
    assert time.time() - t < 10


def test_rows_with_equal_ids_and_texts_are_divided(spark):
    """Two groups of 3,000 equal rows (one without id) and 100 others into 4 shards."""
    from callwise.llm import sharding
    rows = [(7, "a copied row")] * 3000 + [(None, "another row " * 5)] * 3000 + [(100 + i, "x" * i) for i in range(100)]
    out = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 4).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == sorted((i or 0, t) for i, t in rows)
    total = sum(r.size for r in out)
    for s in range(4):
        mine = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / 4) <= 0.01 * total
