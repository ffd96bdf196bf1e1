"""Centroid clustering and nearest neighbours against plain loops."""

import hashlib
import math

import numpy as np
import pytest

from steadyframes.llm import nearest, yinyang

SCHEMA = "vec_id long, embedding array<float>, cluster string, score string, x int, lists int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "a", "b", 1, 2) for i, v in rows], SCHEMA)


def odd_rows(dims):
    """Rows that are left out."""
    return [(900, None), (901, []), (902, [1.0] * (dims - 1) + [None]), (903, [1.0] * (dims - 1) + [float("nan")]), (904, [float("inf")] * dims)]


def lloyd(rows, k, rounds, dims, scale=256.0, salt="2:"):
    """By the contract's words, one vector at a time."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    vectors = [[math.floor(scale * float(np.float32(c))) for c in v] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, hashlib.sha256(f"{salt}{kept[n][0]}".encode()).hexdigest(), vectors[n]))
    centroids = [vectors[n] for n in order[:k]]

    def nearest_of(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest_of(v)[1] for v in vectors]
        for j in range(len(centroids)):
            mine = [v for v, o in zip(vectors, own, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [(i, j, d, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, [nearest_of(v) for v in vectors], strict=True)]


@pytest.mark.parametrize("k,dims,seed", [(7, 3, 0), (25, 2, 1), (40, 8, 2)])
def test_clusters_equal_plain_rounds(spark, k, dims, seed):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=(120, dims)), 2 if dims > 2 else 1)  # many ties in two dimensions
    rows = [*((i, x.tolist()) for i, x in enumerate(v)), *odd_rows(dims), (3, v[3].tolist()), (500, v[3].tolist()), (None, v[4].tolist())]
    got = yinyang.digest(table(spark, rows), k, 5, dims, 16.0).collect()
    want = lloyd(rows, k, 5, dims, 16.0)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got), key=key) == sorted(want, key=key)
    assert {r.inertia for r in got} == {sum(w[2] for w in want)}
    for r in got:
        assert r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)


def test_bounds_leave_work_out_and_change_nothing():
    rng = np.random.default_rng(5)
    heads = rng.integers(-900, 900, (20, 16))
    x = (heads[rng.integers(0, 20, 3000)] + rng.integers(-60, 60, (3000, 16))).astype(np.int64)
    c = x[:20].copy()
    group = yinyang.grouped(c, 4)
    own, upper, lower, _ = yinyang.first_round(x, c, group)
    seen = 0
    for _ in range(6):
        old, c = c, yinyang.moved(c, yinyang._sums(x, own, 20))
        own, upper, lower, n = yinyang.next_round(x, own, upper, lower, c, np.sqrt(yinyang.paired(old, c).astype(float)), group)
        seen += n
        d = yinyang.squared(x, c)
        far = np.sqrt(d.astype(float))
        assert (own == d.argmin(1)).all() and (upper >= far[np.arange(len(x)), own]).all()
        far[np.arange(len(x)), own] = np.inf
        assert all((lower[:, g] <= far[:, group == g].min(1)).all() for g in range(4))
    assert seen < 0.3 * 6 * d.size


def test_large_components_stay_exact_or_fail_clearly(spark):
    big = (1 << 25) / 256
    x = yinyang.scaled(np.array([[big, -big], [big - 1, 0.0]]), 256.0)
    assert yinyang.squared(x, x)[0, 1] == 256**2 + (1 << 25) ** 2
    with pytest.raises(ValueError, match="64 bits"):
        yinyang.scaled(np.array([[2 * big]]), 256.0)
    assert yinyang.digest(table(spark, [])).count() == 0 and yinyang.digest(table(spark, odd_rows(64))).count() == 0


def plain_search(rows, every, k):
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for q in sorted({i for i, _ in kept if i % every == 0}):
        x = min(tuple(v) for i, v in kept if i == q)
        found = [(-float(np.dot(x[: len(v)], v[: len(x)])), i) for i, v in kept if i != q]
        out[q] = sorted(found)[:k]
    return out


def test_all_lists_give_all_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 40)) * rng.uniform(0.1, 4, (300, 1))  # norms differ
    rows = [*((i, x.tolist()) for i, x in enumerate(v)), *odd_rows(40), (905, [0.0] * 40), (None, v[0].tolist()), (40, v[41].tolist()), (77, v[77].tolist()), (500, v[77].tolist()), (501, [9.0, 1.0])]
    want = plain_search(rows, 20, 20)
    got = nearest.search(table(spark, rows), lists=8, probes=8, part=50).collect()
    assert {r.query_id for r in got} == set(want)
    hits = 0
    for q, best in want.items():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(best) + 1))
        assert [(r.score, -r.vec_id) for r in mine] == sorted(((r.score, -r.vec_id) for r in mine), reverse=True)
        near = {(i, round(-s, 9)) for s, i in best}
        hits += sum((r.vec_id, round(r.score, 9)) in near for r in mine)
    assert hits >= 0.98 * sum(map(len, want.values()))


def test_recall_on_the_default_lists(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want = plain_search(rows, 20, 20)
    got = nearest.search(df).collect()
    assert len(got) == sum(map(len, want.values()))
    pairs = {(q, i) for q, best in want.items() for _, i in best}
    assert len(pairs & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(pairs)


def test_few_vectors_give_all_candidates(spark):
    rng = np.random.default_rng(2)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(12, 5)))] + [(0, [1.0, 2, 3, 4, 5])] * 3
    got = nearest.search(table(spark, rows)).collect()
    assert sorted(r.vec_id for r in got if r.query_id == 0) == list(range(1, 12))
    assert nearest.search(table(spark, [])).count() == 0 and nearest.search(table(spark, odd_rows(64))).count() == 0
    assert nearest.search(table(spark, [(20, [1.0, 2.0])])).count() == 0


def test_abandoned_candidates_are_seldom_near():
    rng = np.random.default_rng(3)
    q, y = rng.normal(size=(30, 64)), rng.normal(size=(4000, 64))
    d = ((q[:, None] - y[None]) ** 2).sum(2)
    limit = np.sort(d, 1)[:, 20]
    i, j = nearest.survivors(q, y, np.zeros(len(y)), limit)
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    near = set(zip(*map(np.ndarray.tolist, np.nonzero(d <= limit[:, None])), strict=True))
    assert len(near & kept) >= 0.97 * len(near) and len(kept) < 3 * len(near)
