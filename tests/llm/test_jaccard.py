import random
import re

import numpy as np
import pytest

from steadyframes.llm import jaccard
from steadyframes.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    root = {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and None not in (rows[x][0], rows[y][0]):
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    a, b = find(rows[x][0]), find(rows[y][0])
                    root[max(a, b)] = min(a, b)
    return sorted([(i, len(s), find(i) if i is not None else None) for (i, _), s in zip(rows, sets, strict=True)], key=str)


def corpus(seed, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    bases = [[r.choice(words) for _ in range(r.choice([1, 2, 3, 12, 40, 120]))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((i, r.choice([" ", "\n", "  "]).join(w).replace("w1", r.choice(["w1", "W1"]))))
    return [*out, (500, None), (501, ""), (502, " \t"), (503, None), (504, "a b"), (505, "A  b"), (506, "a b c"), (None, "a b"), (3, out[3][1])]


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 90, 256), (5, 80, 256), (3, 90, 4), (3, 60, 8)])
def test_components_equal_brute_force(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "GROUP", 2 if block < 10 else 32)
    rows = corpus(words * percent + block)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y")
    got = jaccard.link(df, words=words, percent=percent).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, words, percent)


def similar_pairs(seed=4, n=300):
    rng = np.random.default_rng(seed)
    for percent in (80, 90):
        for _ in range(n):
            size = int(rng.integers(2, 90))
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            b = a[rng.random(len(a)) > rng.random() * 0.2]
            b = np.unique(np.concatenate([b, rng.integers(0, 2**63, int(rng.integers(0, 6))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                yield percent, a, b


def test_every_allocation_catches_every_similar_pair():
    rng = np.random.default_rng(5)
    levels = [np.zeros(1 << jaccard.COUNTER_BITS, np.uint8), rng.integers(0, 9, 1 << jaccard.COUNTER_BITS).astype(np.uint8)]
    for percent, a, b in similar_pairs():
        if a.tolist() == b.tolist():
            continue
        lows = jaccard.bands(percent, 200)
        for k in (0, 1, 99):
            plan = []
            for i, (low, end) in enumerate(zip(lows, lows[1:], strict=False)):
                d = jaccard.largest_difference(end - 1, percent)
                loose = min(k, (d + 1) // 2)
                emit = max(0, d + 1 - 2 * loose)
                if d:
                    plan.append((low, (end - 1) * 100 // percent, loose, emit, emit * 3 // 2, i))
            for level in levels:
                assert len(np.intersect1d(jaccard.signatures(a, plan, level), jaccard.signatures(b, plan, level)))


def test_parities_never_overstate_a_difference():
    for _, a, b in similar_pairs(6):
        assert jaccard.least_difference(jaccard.parities(a), jaccard.parities(b)) <= len(np.setxor1d(a, b))
        assert jaccard.least_difference(jaccard.parities(a), jaccard.parities(a[: len(a) // 3])) <= len(a) - len(a) // 3


def test_groups_of_any_size_stay_together(monkeypatch):
    """Whatever tasks the classes of a signature are dealt to, candidates connect all of them."""
    monkeypatch.setattr(jaccard, "GROUP", 3)
    rng = np.random.default_rng(7)
    for n in (2, 3, 4, 7, 12, 40):
        for tasks in (1, 2, 5):
            owner = rng.integers(0, tasks, n)
            got = [jaccard.combined(np.full(int((owner == t).sum()), 9, np.uint64), np.flatnonzero(owner == t) + 100) for t in range(tasks)]
            sig, a, b = (np.concatenate(x) for x in zip(*got, strict=True))
            link = (b != -1) & (b != a)
            assert (sig[~link] == 9).all()
            x, y, sure = jaccard.met(sig[~link], a[~link], (b != -1)[~link])
            root = {i: i for i in range(100, 100 + n)}

            def find(i, root=root):
                while root[i] != i:
                    i = root[i]
                return i

            for p, q in [*zip(a[link].tolist(), b[link].tolist(), strict=True), *zip(x.tolist(), y.tolist(), strict=True)]:
                root[find(p)] = find(q)
            assert len({find(i) for i in root}) == 1
            if n <= 3:
                assert len(x) == n * (n - 1) // 2 and not sure.any()


def test_allocation_follows_the_costs():
    k, emit, exact = jaccard.allocate(5, 1000, 60.0, 1e-6)
    assert k == 0 and emit == 6 and exact > 6
    k, emit, exact = jaccard.allocate(3, 10**9, 60.0, 0.3)
    assert k > 0 and 2 * k + emit >= 4 and exact >= emit


def test_components_of_a_star_a_path_and_none(spark):
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(200)) and all(got[1000 + i] == 1000 for i in range(61)) and len(got) == 261
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_first(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, "a"), (2, text + " x", "b"), (2, text + " x", "b"), (9, "other words here", "c"), (None, text, "d"), (7, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = jaccard.keep_first(df)
    assert got.columns == df.columns
    assert sorted([r.component_id for r in got.collect()]) == ["b", "c", "d", "e"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.link(df).count() == 0 and jaccard.keep_first(df).count() == 0
