import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from steadyframes.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        words = WORD.findall(lower(text or ""))
        hit, ids = set(), set()
        for item, t in items:
            own = WORD.findall(lower(t or ""))
            k = min(window, len(own))
            for a in range(len(own) - k + 1) if own else ():
                for b in range(len(words) - k + 1):
                    if words[b : b + k] == own[a : a + k]:
                        hit.update(range(b, b + k))
                        ids.add(str(item))
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_words", [400_000, 12])
def test_scan_equals_brute_force(spark, shard_words):
    r = random.Random(5)
    vocabulary = ["Ab", "b", "c9", "É", "dd"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 4, 9, 14])))) for i in range(12)] + [(20, None), (3, "x y, z")]
    items = [x for x in items if len((x[1] or "").split()) != 1]
    docs = [(i, " ".join(r.choice([*vocabulary, "zz"]) for _ in range(r.choice([0, 5, 40])))) for i in range(40)] + [(90, None), (91, ""), (92, "..."), (1, "x Y  z"), (1, "x Y  z")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for window in (3, 10):
        found = d.scan(df, it, window=window, shard_words=shard_words).collect()
        got = sorted([(x.doc_id, x.n_words, x.n_hit, len(x.hit_items), hashlib.sha256(",".join(x.hit_items).encode()).hexdigest(), x.n_hit > 0) for x in found], key=str)
        assert got == brute(docs, items, window)


def test_one_word_items_no_items_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", "k")], "doc_id long, text string, n_words string")
    it = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert d.scan(df, it).select("n_words", "n_hit").collect() == [(3, 1)]
    assert d.scan(df, it.where("false")).select("n_words", "n_hit").collect() == [(3, 0)]
    assert d.digest(df.where("false"), it).count() == 0


@pytest.mark.parametrize("shard_words", [400_000, 3])
def test_decontaminate_cuts_spans_and_drops_covered(spark, shard_words):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, f"Keep é this, {item}; and these words here stay too because they are many"), (2, item), (3, "clean"), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_words": F.lit("mine"), "hit_words": F.col("doc_id")})
    it = spark.createDataFrame([(7, item), (8, "x y z"), (9, "u v w")], "item_id long, text string")
    found = d.decontaminate(df, it, shard_words=shard_words)
    assert found.schema == df.schema
    found = found.collect()
    assert all(x.n_words == "mine" and x.hit_words == x.doc_id for x in found)
    got = {x.doc_id: x.text for x in found}
    assert got == {1: "Keep é this, ; and these words here stay too because they are many", 3: "clean", 4: None}
