"""Words that sums of mixed parts, or a sum of word hashes, could not tell apart."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from steadyframes.llm import decontaminate, jaccard, lmscore, pii, tokencount
from steadyframes.llm.textbytes import chained, mix, span_hashes

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
T = 0x9E3779B97F4A7C15
M = (1 << 64) - 1


def twins(n, seed=0):
    """Pairs of words of 16 bytes: (x + T, y) and (y + T, x) have one sum of parts mixed with their places."""
    rng = np.random.default_rng(seed)
    out = [(":~v\x7f4{\\\x17*\x01%\x00v\x02)y", "?}o\x7f/|\x60\x17%\x02,\x00{\x01%y")]
    white = {9, 10, 11, 12, 13, 32}
    found = []
    while len(found) < 2 * n:
        x = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) & np.uint64(0x7F7F7F7F007F037F)  # so that most bytes stay below 128
        for one in x.tolist():
            up = (one + T) & M
            data = one.to_bytes(8, "little") + up.to_bytes(8, "little")
            if max(data) < 128 and not set(data) & white:
                found.append((one, up))
    for (x, xt), (y, yt) in zip(found[:n], found[n : 2 * n], strict=True):
        out.append(tuple((a.to_bytes(8, "little") + b.to_bytes(8, "little")).decode() for a, b in ((xt, y), (yt, x))))
    return out


PAIRS = twins(20)


def hashes(words):
    data = [w.encode() for w in words]
    ends = np.cumsum([len(d) for d in data])
    return span_hashes(np.frombuffer(b"".join(data), np.uint8), ends - [len(d) for d in data], ends)


def test_twins_have_hashes_of_their_own():
    assert all(len(a.encode()) == len(b.encode()) == 16 and a != b for a, b in PAIRS)
    flat = [w for p in PAIRS for w in p]
    assert len(set(hashes(flat).tolist())) == len(set(flat))
    # Hashes don't depend on the neighbours, and long spans are told apart by each byte.
    assert hashes(["abc", *flat])[1:].tolist() == hashes(flat).tolist()
    long = ["x" * 300 + c + "y" * 700 for c in "ab"] + ["x" * 300, "x" * 301]
    assert len(set(hashes(long).tolist())) == 4


def test_sequences_are_not_sums():
    odd = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(2)]
    a, b = np.array([12345], np.uint64), np.array([67890], np.uint64)
    with np.errstate(over="ignore"):
        c, d = a + odd[1], b - odd[0]  # a odd0 + b odd1 is as large
    assert chained([a, b]) != chained([c, d]) and chained([a, b]) != chained([b, a]) and chained([a]) != chained([a, a])
    with np.errstate(over="ignore"):
        e = mix(a + np.uint64(T)) ^ mix(c + np.uint64(T)) ^ b  # what a single chained state would take for the same
    assert chained([a, b]) != chained([c, e])


@pytest.mark.parametrize("pair", PAIRS[:4])
def test_texts_of_twins_are_not_linked(spark, pair):
    rows = [(i, f"one two {w} three four") for i, w in enumerate(pair)]
    got = {r.doc_id: r.component_id for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=90).collect()}
    assert got == {0: 0, 1: 1}


def test_counts_of_twins_don_t_depend_on_their_neighbours(spark):
    flat = [w for p in PAIRS for w in p]
    together = {r.doc_id: (r.n_tokens, r.score) for r in tokencount.digest(spark.createDataFrame(list(enumerate(flat)), "doc_id long, text string").coalesce(1), RANKS).collect()}
    for i in (0, 1, 6, 7):
        alone = tokencount.digest(spark.createDataFrame([(i, flat[i])], "doc_id long, text string"), RANKS).first()
        assert together[i] == (alone.n_tokens, alone.score)


def test_twins_keep_their_own_spans(spark):
    texts = [f"mail {w} now a@b.example" for p in PAIRS for w in p]
    together = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()}
    for i in (0, 1, 5):
        assert pii.digest(spark.createDataFrame([(i, texts[i])], "doc_id long, text string")).first().spans == together[i]


def test_items_with_twins_are_told_apart(spark):
    letters = lambda w: "".join(c if c.isalnum() else "é" for c in w)
    a, b = ("".join(chr(97 + (i * k) % 26) for i in range(16)) for k in (3, 5))
    items = spark.createDataFrame([("one", f"{a} two three"), ("two", f"{b} two three"), ("three", letters(PAIRS[0][0]))], "item_id string, text string")
    docs = spark.createDataFrame([(0, f"x {a} two three y"), (1, f"{b} two three"), (2, "two three")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.digest(docs, items).collect()}
    assert got == {0: (3, 1), 1: (3, 1), 2: (0, 0)}


def test_equal_rows_score_alike_among_others(spark):
    r = np.random.default_rng(8)
    one = " ".join(f"w{k}" for k in r.integers(0, 400, 37))
    other = lambda: " ".join(f"w{k}" for k in r.zipf(1.5, int(r.integers(1, 300))) % 700)
    df = spark.createDataFrame([(i, one if i % 2 else other()) for i in range(3000)], "doc_id long, text string").repartition(5)
    got = lmscore.digest(df).where(F.col("doc_id") % 2 == 1)
    assert got.select("log_likelihood").distinct().count() == 1
