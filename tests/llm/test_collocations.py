"""Collocations against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest

from steadyframes.llm import collocations


def plain(rows, least, percent, top):
    """By the contract's words."""
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= percent * a for q, b in candidates.items()):
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def made(seed, rows=120):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "new", "york", "city", "é", "x|y", "中文", "of", "a\x0bb", "w\x00z", *[f"w{i}" for i in range(30)]]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! ", "\r\n"]
    out = []
    for i in range(rows):
        parts = []
        for _ in range(int(rng.integers(0, 120))):
            parts += ["new york city"] if rng.random() < 0.1 else [words[min(int(rng.zipf(1.3)), len(words)) - 1]]
            parts.append(marks[rng.integers(len(marks))])
        out.append((["en", "fr", None, ""][i % 4 if i % 3 else 0], "".join(parts)))
    return [*out, ("en", None), ("en", ""), ("xx", "one two"), ("en", " ".join(["long text"] * 5000)), out[0], out[0]]


@pytest.mark.parametrize("block,run,range_,top", [(4 << 20, 1 << 21, 1 << 20, 2000), (700, 300, 200, 5)])
def test_phrases_equal_plain_counting(spark, monkeypatch, block, run, range_, top):
    for name, value in (("BLOCK", block), ("RUN", run), ("RANGE", range_)):
        monkeypatch.setattr(collocations, name, value)
    rows = made(4)
    df = spark.createDataFrame([(*r, "q", 3) for r in rows], "lang string, text string, phrase string, n int")
    got = collocations.collocations(df.repartition(3), least=4, top=top)
    assert sorted(map(tuple, got.collect())) == plain(rows, 4, 50, top)


def test_no_rows_and_no_frequent_words(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")).count() == 0


def test_radix_order_sorts_keys_of_any_width():
    rng = np.random.default_rng(0)
    for width in (1, 2, 3, 5):
        ids = rng.integers(0, min(1 << 8 * width, 1 << 40), (500, 3))
        keys = collocations.packed(ids, width)
        order = collocations.radix_order(keys)
        assert (order == np.lexsort((np.arange(500), ids[:, 2], ids[:, 1], ids[:, 0]))).all()
        assert (collocations.unpacked(keys, width) == ids).all()


def test_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_019, 3_000_000_021, 4_000_000_007)], "a long, l long, r long")
    assert df.select(collocations.score("a", "l", "r")).first()[0] == 1000000 * 3_000_000_019**2 // (3_000_000_021 * 4_000_000_007)


def test_a_block_is_packed_in_small_steps(monkeypatch):
    """Pairs and triples of a block take a few bytes each, never three numbers of eight at once; and none is lost at a step's end."""
    import tracemalloc
    import zlib

    import pyarrow as pa

    rng = np.random.default_rng(2)
    ids = rng.integers(1, 100_000, 600_000) * rng.choice([1, 1, 1, -1, 0], 600_000)
    batch = pa.RecordBatch.from_arrays([pa.array([zlib.compress(ids.astype("<i8").tobytes(), 1)], pa.binary())], names=["ids"])
    monkeypatch.setattr(collocations, "RUN", 1 << 17)
    tracemalloc.start()
    rows = sum(len(x) for x in collocations._runs([batch], np.zeros(0, "S9"), 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < 30e6
    for run in (1, 2, 5, 64):
        monkeypatch.setattr(collocations, "RUN", run)
        found = {}
        for x in collocations._runs([batch.from_arrays([pa.array([zlib.compress(ids[:300].astype("<i8").tobytes())], pa.binary())], names=["ids"])], np.zeros(0, "S9"), 3):
            for n, k, c in zip(x["n"].to_pylist(), x["keys"].to_pylist(), x["counts"].to_pylist(), strict=True):
                keys = collocations.unpacked(np.frombuffer(zlib.decompress(k), np.uint8).reshape(9, n).T, 3)
                for key, count in zip(map(tuple, keys.tolist()), np.frombuffer(zlib.decompress(c), "<i8").tolist(), strict=True):
                    found[key] = found.get(key, 0) + count
        want, some = {}, ids[:300].tolist()
        for i in range(300):
            for k in (2, 3):
                if i + k <= 300 and all(some[i : i + k]) and min(some[i + 1 : i + k]) > 0:
                    key = (*map(abs, some[i : i + k]), 0)[:3]
                    want[key] = want.get(key, 0) + 1
        assert found == want
