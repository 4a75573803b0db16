"""What the second review found missing: each test fails on the code before."""
import random
import re

import pytest

from callwise.llm import decontaminate, jaccard_join, packing, secret_scan

WORD = re.compile(r"[a-z0-9]+")


def leak_rows(items, copied, rng, docs=40, around=30):
    """Documents of common words with exact copies of ``copied`` items, and the pairs."""
    common = ["c%d" % i for i in range(400)]
    rows, pairs = [], set()
    for d in range(docs):
        parts = []
        for i in copied[d::docs]:
            parts += [" ".join(rng.choice(common) for _ in range(around)), items[i][1]]
            pairs.add((d, items[i][0]))
        rows.append((d, " ".join(parts)))
    return rows, pairs


@pytest.mark.parametrize("count", [1000, 2000])
def test_copies_of_many_items_are_found(spark, count):
    """More items than the sketch has columns: their copies are still candidates."""
    rng = random.Random(count)
    words = ["w%d" % i for i in range(6000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(38))) for i in range(count)]
    rows, pairs = leak_rows(items, range(0, count, 5), rng)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    # the block size that held them before, and the one of today
    for found in (decontaminate.leaks_of_block(texts, items), decontaminate.leaks(texts, benchmark)):
        assert {(r.doc_id, r.item_id) for r in found.collect()} == pairs


@pytest.mark.parametrize("count", [100, 4000])
def test_short_items_are_found_however_many_documents(spark, count):
    """Short items verbatim inside words that no item has; an item's words are in a tenth
    of the documents, whatever their number."""
    rng = random.Random(8)
    words = ["w%d" % i for i in range(60)]
    items = [(i, " ".join(rng.sample(words, 15))) for i in range(10)]
    rows = [(1000 + i, " ".join(["z%d" % (i % 7)] + [w for w in words if rng.random() < 0.1])) for i in range(count)]
    rows += [(i, " ".join(["o%d" % (40 * i + j) for j in range(20)] + [t] + ["p%d" % (40 * i + j) for j in range(20)])) for i, t in items]
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"),
                                spark.createDataFrame(items, "item_id long, text string"))
    assert {(i, i) for i, _ in items} <= {(r.doc_id, r.item_id) for r in found.collect()}


def test_packing_knows_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "plain text here", "<|endoftext|><|endoftext|>", None, "é <|endoftext|", "x" * 3000 + "<|endoftext|> y\n"]
    pieces = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1), *packing.vocabulary()).collect()
    for i, x in enumerate(texts):
        want = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in mine) == b"".join(y.to_bytes(4, "little") for y in want)
        assert {p.doc_tokens for p in mine} == {len(want)}


def test_short_and_broken_passwords_are_judged_and_masked(spark):
    rng = random.Random(4)
    letters = "abcdefghijkmnpqrstuvwxyz"
    values = ["hunter2x9", "Tr0ub4dor!3xyz@k", *("".join(rng.choice(letters) for _ in range(4)) + str(rng.randrange(10, 99)) + rng.choice(letters) for _ in range(60))]
    forms = ["password = {}", "my passwd: \"{}\",", "pwd='{}'", "token={}"]
    rows = [(i, f"some plain words max{v}z {forms[i % 4].format(v)} and the rest") for i, v in enumerate(values)]
    rows += [(1000 + i, f"the token: is plain{i} words internationalisation{i} and so on") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.finding) for r in secret_scan.scan(d).where("kept").collect()}
    assert set(enumerate(values)) <= found
    clean = {r.doc_id: r.text for r in secret_scan.redacted(d).collect()}
    for i, v in enumerate(values):
        other = f"max{v}z" if len(v) < secret_scan.SHORTEST else f"max{secret_scan.MASK}z"     # a long one is masked anywhere
        assert secret_scan.MASK in clean[i] and other in clean[i].split() and v not in clean[i].replace(other, "")


def test_counts_of_long_texts_do_not_wrap():
    import numpy as np
    import pyarrow as pa
    words = " ".join(map(str, range(300_000)))
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([words])], names=["doc_id", "text"])
    out = pa.Table.from_batches(jaccard_join._deal(5, 80, 1)(iter([batch])))
    counts = np.frombuffer(out["counts"][0].as_py(), np.int32)
    assert counts.max() > 65_535 and counts.sum() == len(out["sigs"][0].as_py()) // 8
    assert jaccard_join._gather(out).num_rows > 0
