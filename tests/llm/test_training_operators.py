"""The training-data operators against brute force, on texts with every awkward case."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from callwise.llm import (decontaminate, jaccard_join, lempel_ziv, ngram_trie, packing, quality_rules, secret_scan, sharding,
                          suffix_dedup, warc)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus():
    base, passage = prose(120), prose(70)
    texts = [base, base, base.upper(), base + " tail", passage + " " + prose(80), prose(60) + "\n" + passage, "", None, "   ", "one", "one two",
             "one two", "x" * 500, "ab " * 200, prose(3000), prose(40) + " é　ü " + prose(30)]
    for i in range(40):
        w = base.split()
        w[rng.randrange(len(w))] = "edit%d" % i
        texts.append(" ".join(w))
    texts += [prose(rng.randint(1, 200)) for _ in range(40)]
    return [(i * 3, t, "n%d" % i, 1, 2) for i, t in enumerate(texts)]


ROWS = corpus()
SCHEMA = "doc_id long, text string, n_words string, shard int, n_chars long"     # clashing names


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(ROWS + [(None, ROWS[0][1], "x", 0, 0)], SCHEMA).repartition(5).cache()
    yield made
    made.unpersist()        # test_nothing_stays_cached looks at the whole session


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard_components(docs, k, percent):
    sets = {i: shingles(t, k) for i, t, *_ in ROWS}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    found = jaccard_join.jaccard_components(docs, k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == {i: (len(s), find(i)) for i, s in sets.items()}
    assert [r.component_id for r in found if r.doc_id is None] == [None]


def test_every_linked_pair_shares_a_signature():
    import numpy as np
    bands, r = jaccard_join.Bands(85), np.random.default_rng(1)
    for _ in range(300):
        n = int(r.integers(7, 400))
        a = r.integers(0, 2 ** 63, n).astype(np.uint64)
        b = a.copy()
        change = int(r.integers(0, max(1, n * 15 // 185) + 1))
        b[:change] = r.integers(0, 2 ** 63, change).astype(np.uint64)
        if 100 * (n - change) < 85 * (n + change):
            continue
        who, sig = jaccard_join.signatures(np.concatenate([np.unique(a), np.unique(b)]), np.array([0, n, 2 * n]), bands)
        assert change == 0 or set(sig[who == 0]) & set(sig[who == 1])


def test_copied_words(docs):
    seen, want = {}, {}
    for i, t, *_ in ROWS:
        w = WORD.findall(t or "")
        windows = [tuple(w[j:j + 50]) for j in range(len(w) - 49)]
        gone = {p for j, x in enumerate(windows) if x in seen for p in range(j, j + 50)}
        for x in windows:
            seen.setdefault(x, i)
        want[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in lempel_ziv.without_copies(docs).collect()}
    assert got.pop(None)[1] == 0
    assert got == want


def test_copied_bytes(docs):
    seen, want = set(), {}
    for i, t, *_ in ROWS:
        b, gone = (t or "").encode(), set()
        for j in range(len(b) - 99):
            if b[j:j + 100] in seen:
                gone.update(range(j, j + 100))
            seen.add(b[j:j + 100])
        want[i] = (len(b), len(gone), sum(p - 1 not in gone for p in gone), bytes(x for p, x in enumerate(b) if p not in gone))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.without_copies(docs).collect()}
    assert got.pop(None)[1] == 0
    assert got == want


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x, *_ in ROWS}
    pieces = packing.pack(docs, *packing.vocabulary()).collect()
    for i, want in ids.items():
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [p.start for p in mine] == [sum(q.length for q in mine[:j]) for j in range(len(mine))]
        assert b"".join(bytes(p.ids) for p in mine) == b"".join(x.to_bytes(4, "little") for x in want)
        assert {p.doc_tokens for p in mine} == {len(want)}
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:j]) for j in range(len(parts))] and sum(n for _, n in parts) <= 1024


def test_differencing_is_balanced():
    import numpy as np
    sizes = np.random.default_rng(2).integers(40, 129, 1024)
    w = packing.windows(sizes, 1024)
    filled = np.bincount(w, sizes)
    assert filled.max() <= 1024 and filled.sum() == sizes.sum() and len(filled) <= 1.05 * math.ceil(sizes.sum() / 1024)


def test_sharding(docs):
    rows = sharding.sharded(docs, 5).collect()
    assert len(rows) == len(ROWS) + 1
    total = sum(r.size for r in rows)
    for s in range(5):
        mine = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        # one text cannot be divided
        assert abs(sum(r.size for r in mine) - total / 5) <= max(r.size for r in rows)


def test_scores(docs):
    want, k = {}, ngram_trie.PRIOR
    texts = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t, *_ in ROWS}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    one, two, start = Counter(), Counter(), 0
    for i, w in texts.items():
        if not held[i]:
            one.update(w)
            two.update(zip(["<s>", *w], w))
            start += 1
    n = sum(one.values())
    size = n + 0.5 * (len(one) + 1)
    for i, w in texts.items():
        base = sum(math.log10((one[x] + 0.5) / size) for x in w)
        score = sum(math.log10((two[v, x] + k * (one[x] + 0.5) / size) / ((start if v == "<s>" else one[v]) + k)) for v, x in zip(["<s>", *w], w))
        want[i] = (held[i], len(w), sum(one[x] > 0 for x in w), n, base, score)
    got = {r.doc_id: tuple(r)[1:] for r in ngram_trie.scored(docs).collect()}
    assert got.pop(None)[0] is None
    for i, w in want.items():
        assert got[i][:4] == w[:4]
        assert got[i][4] == pytest.approx(w[4], abs=1e-6) and got[i][5] == pytest.approx(w[5], abs=2e-4 * w[1])


def test_elias_fano_levels():
    import numpy as np
    r = np.random.default_rng(3)
    for values in (np.zeros(0, np.uint64), np.array([7], np.uint64), np.unique(r.integers(0, 2 ** 63, 70_000).astype(np.uint64)), np.sort(r.integers(0, 50, 900)).astype(np.uint64)):
        level = ngram_trie.EliasFano(ngram_trie.EliasFano.pack(values))
        assert (level.values() == values).all()
        keys = np.unique(np.concatenate([values[::3], values[::5] + np.uint64(1)])) if len(values) else np.array([1], np.uint64)
        where, equal = level.successors(keys)
        assert (where == np.searchsorted(values, keys)).all() and (equal == np.isin(keys, values)).all()


def test_leaks(spark):
    items = [(i, prose(rng.randint(15, 50)) + ". " + prose(6) + ".") for i in range(30)]
    rows = []
    for i, (_, text) in enumerate(items):
        w = text.split()
        for j in range(0, len(w), 9):       # a paraphrase: every ninth word is another
            w[j] = "other%d" % j
        rows += [(3 * i, prose(100) + " " + text.upper() + " " + prose(50)), (3 * i + 1, " ".join(w)), (3 * i + 2, prose(300))]
    found = decontaminate.leaks(spark.createDataFrame(rows + [(None, items[0][1]), (999, None)], "doc_id long, text string"),
                                spark.createDataFrame(items + [(77, None), (78, "")], "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert {(3 * i + a, i) for i, _ in items for a in (0, 1)} | {(None, 0)} <= got
    assert not any(d is not None and d % 3 == 2 for d, _ in got)


def test_secrets_and_redaction(spark):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(120)]
    rows = [(i, f"{prose(20)} token = \"{h}\" {prose(5)}") for i, h in enumerate(hexes)]
    rows += [(1000 + i, f"{prose(9)} {''.join(rng.choice(['ation', 'the', 'ing', 'er']) for _ in range(6))} {rng.randrange(10 ** 15, 10 ** 16)} {prose(9)}") for i in range(120)]
    rows += [(5000, None), (5001, ""), (None, f'token = "{hexes[0]}"')]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in secret_scan.scan(d).where("kept").collect()}
    assert kept == {*range(120), None}
    clean = {r.doc_id: r.text for r in secret_scan.redacted(d).collect()}
    assert all(h not in clean[i] and secret_scan.MASK in clean[i] for i, h in enumerate(hexes))
    assert clean[1000] == dict(rows)[1000] and clean[5000] is None and hexes[0] not in clean[None]


def test_line_rules_keep_prose(spark, docs):
    good = "\n".join(f"{prose(12)}." for _ in range(8))
    junk = "\n".join(" | ".join(prose(1) for _ in range(12)) for _ in range(8))
    rows = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame([(1, good), (2, junk), (3, good + "\n" + "Menu\nHome"), (4, None)], "doc_id long, text string")).collect()}
    assert rows[1].kept and rows[1].cleaned == good and not rows[2].kept and rows[3].cleaned == good and not rows[4].kept
    for r in quality_rules.judged(docs).collect():
        w = WORD.findall(r.text or "")
        seen = Counter(zip(w, w[1:], w[2:]))
        marked = {p for i, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for p in (i, i + 1, i + 2)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(marked))


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a.example/x y", "<html><head><title>T &amp; t</title></head><body><p>One <b>two</b><br>three</p><script>x<</script><a href='/l'>go</a></body></html>"),
             (2, None, None), (3, "http://b.example/", "<p>unclosed <!-- comment"), (1, "http://a.example/x y", "")]
    responses = warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string"))
    rows = warc.derivatives(responses).collect()
    assert len(rows) == 2 * len(pages)
    sources = {warc.parsed(bytes(r.record))[0]["WARC-Record-ID"] for r in responses.collect()}
    for r in rows:
        headers, block = warc.parsed(r.record.encode())
        assert headers["WARC-Refers-To"] == r.refers_to and r.refers_to in sources
        assert headers["WARC-Block-Digest"] == warc.digest(block) and headers["WARC-Source-Payload-Digest"] == r.source_digest
    text = {r.page_id: warc.parsed(r.record.encode())[1].decode() for r in rows if r.record_type == "conversion" and r.source_digest != warc.digest(b"")}
    assert text == {1: "One two\nthree\ngo", 3: "unclosed"}


def test_empty_tables(none, spark):
    assert jaccard_join.jaccard_components(none).count() == 0
    assert lempel_ziv.without_copies(none).count() == suffix_dedup.without_copies(none).count() == 0
    assert packing.pack(none, *packing.vocabulary()).count() == sharding.sharded(none).count() == ngram_trie.scored(none).count() == 0
    assert secret_scan.scan(none).count() == quality_rules.judged(none).count() == 0
    assert decontaminate.leaks(none, spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0
    assert warc.derivatives(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
