"""Approximate nearest neighbours by inner product, with an adaptive scan over dimensions.

Vectors are dealt to lists by centroids that are fitted on a bounded sample; a list of more than PART vectors is split
by a hash. A query probes the lists whose centroids are nearest. Inner products become distances by one further
component that lifts every vector to the largest norm. Within a part vectors and query are rotated by a random
orthogonal matrix and looked at in blocks of columns: from a partial distance a hypothesis test decides whether the whole
distance can still be among a query's best, and abandons the candidate if not. What survives all blocks is scored
exactly on the original vectors. A query's threshold starts from its scores against the sample and tightens with every
tile of candidates.

The rows of a (list, part) are shuffled to one task, vectors before queries; a task holds one part of at most some PART
vectors and streams the queries. Nothing but the sample, the centroids and a few totals reaches the driver.

Defined cases: vectors that are null, empty, zero or have null or non-finite components take no part, nor do rows
without an id; vectors of unlike lengths count as if zeros followed the shorter; each row is a candidate of its own, so
repeated rows come out as often as they stand; rows with the query's id are not candidates; a repeated query id
is searched once, by its smallest vector; fewer candidates than k give all that the probed lists have; ties go to the
smaller id; no rows give no rows. Only id and vector are read, whatever other columns are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from steadyframes.llm.components import new_folder

#: Vectors of the sample on which the lists are fitted and first thresholds are taken; less where vectors are long.
SAMPLE, SAMPLE_NUMBERS = 20_000, 2_000_000
LISTS, PROBES = 32, 24
#: Vectors of a list that go to one task.
PART = 1 << 16
#: Columns looked at between two tests; queries and candidates compared at a time.
COLUMNS, QUERIES, FIRST_TILE, TILE = 16, 256, 64, 2048
#: The test's width: larger abandons later and misses less.
WIDTH = 2.1
#: From this share of live candidates on, a block of columns is looked at for all of them.
DENSE = 0.2
ROUNDING = 1e-9


def usable(vectors: DataFrame, vec_id: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(col).alias("x")).where(F.col("vec_id").isNotNull() & finite & F.exists("x", lambda v: v != 0))


class Space:
    """The rotated space with its lists: scale, lift, rotation and centroids. A few numbers and matrices, sent to the tasks."""

    def __init__(self, dims: int, scale: float, lift: float, sample: list[list[float]], lists: int, seed: int):
        self.dims, self.scale, self.lift = dims, scale, lift
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        self.sample = self.dense([np.array(x) for x in sample])
        self.sample_rotated = y, e = self.rotated(self.sample)
        self.centroids = _fitted(np.column_stack([y, e]), lists)
        self.sample_lists = self.nearest(y, e, 1)[:, 0]

    def dense(self, rows: list[np.ndarray]) -> np.ndarray:
        """Vectors as rows of doubles, with zeros after the shorter."""
        out = np.zeros((len(rows), self.dims))
        for i, x in enumerate(rows):
            out[i, : len(x)] = x
        return out

    def rotated(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled and rotated vectors, and what lifts each of them to the largest norm."""
        y = x / self.scale
        rest = np.sqrt(np.maximum(self.lift - (y * y).sum(1), 0.0))
        return y @ self.rotation, rest

    def nearest(self, y: np.ndarray, e: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector."""
        c = self.centroids
        d = (c * c).sum(1) - 2 * (np.column_stack([y, e]) @ c.T)
        return np.argsort(d, axis=1, kind="stable")[:, :n]


def _fitted(points: np.ndarray, lists: int, turns: int = 10) -> np.ndarray:
    """Centroids by a few turns of plain clustering."""
    heads = points[:lists].copy()
    for _ in range(turns):
        own = ((heads * heads).sum(1) - 2 * points @ heads.T).argmin(1)
        for j in np.unique(own).tolist():
            heads[j] = points[own == j].mean(0)
    return heads


def scores(queries: np.ndarray, vectors: np.ndarray, i: np.ndarray, j: np.ndarray, at_once: int = 1 << 15) -> np.ndarray:
    """The inner products of pairs of rows; the same for equal rows wherever they stand."""
    out = np.empty(len(i))
    for a in range(0, len(i), at_once):
        out[a : a + at_once] = (queries[i[a : a + at_once]] * vectors[j[a : a + at_once]]).sum(1)
    return out


def best_of(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k best, by score and then id."""
    order = np.lexsort((ids, -score, row))
    first = np.searchsorted(row[order], row[order], "left")
    return order[np.arange(len(order)) - first < k]


def alive_after(far: np.ndarray, rest: np.ndarray, limit: np.ndarray, seen: int, dims: int) -> np.ndarray:
    """The test: whether a squared distance, of which the first `seen` of `dims` columns make `far`, may be within the limit."""
    guess = far if seen == dims else far * (dims / seen) / (1 + WIDTH / np.sqrt(seen)) ** 2
    return rest + guess <= limit


def survivors(q: np.ndarray, y: np.ndarray, rest: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no test abandons. limit: each query's largest squared distance, less what lifts nothing."""
    dims = q.shape[1]
    far, alive, pairs = np.zeros((len(q), len(y))), None, None
    for a in range(0, dims, COLUMNS):
        b = min(dims, a + COLUMNS)
        if pairs is None:
            qb, yb = q[:, a:b], y[:, a:b]
            far += np.maximum((qb * qb).sum(1)[:, None] + (yb * yb).sum(1) - 2 * (qb @ yb.T), 0.0)
            now = alive_after(far, rest, limit[:, None], b, dims)
            alive = now if alive is None else alive & now
            if alive.mean() < DENSE or b == dims:
                pairs = np.nonzero(alive)
                left = far[pairs]
        else:
            i, j = pairs
            left = left + ((q[i, a:b] - y[j, a:b]) ** 2).sum(1)
            keep = np.flatnonzero(alive_after(left, rest[j], limit[i], b, dims))
            pairs, left = (i[keep], j[keep]), left[keep]
    return pairs


def scan(space: Space, query_ids, queries, worst, ids, vectors, rotated, k: int, allowed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, candidate's place, score) of the k best of each query among the vectors.

    worst: scores that a candidate must reach. rotated: what Space.rotated gives for the vectors. allowed(i, j): which pairs
    count, where not all do. The first tiles are small, as all their candidates survive where there is no threshold yet.
    """
    q, _ = space.rotated(queries)
    y, e = rotated
    norms, worst = (q * q).sum(1), worst.copy()
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    a, b = 0, FIRST_TILE
    while a < len(vectors):
        limit = norms + space.lift - 2 * worst / space.scale**2
        i, j = survivors(q, y[a:b], e[a:b] ** 2, limit + ROUNDING * (norms + space.lift))
        j = j + a
        a, b = b, b + min(TILE, 4 * (b - a))
        other = query_ids[i] != ids[j]
        if allowed is not None:
            other &= allowed(i, j)
        i, j = i[other], j[other]
        s = scores(queries, vectors, i, j)
        reach = s >= worst[i]
        row, at, score = (np.concatenate([x, z]) for x, z in zip(found, (i[reach], j[reach], s[reach]), strict=True))
        keep = best_of(row, ids[at], score, k)
        found = row[keep], at[keep], score[keep]
        full = np.flatnonzero(np.bincount(found[0], minlength=len(queries)) == k)
        last = np.searchsorted(found[0], full, "right") - 1
        worst[full] = np.maximum(worst[full], found[2][last])
    return found


def fit(base: DataFrame, lists: int, seed: int) -> Space | None:
    """The space of the usable vectors; None where there are none. Its sample is the rows of the smallest hashes."""
    x = F.transform("x", lambda v: v.cast("double"))
    most = F.array_max(F.transform(x, F.abs))
    said = base.agg(F.max(F.size("x")).alias("dims"), F.max(most).alias("scale")).first()
    if said.dims is None:
        return None
    norm = F.aggregate(x, F.lit(0.0), lambda t, v: t + v / said.scale * (v / said.scale))
    lift = base.agg(F.max(norm).alias("n")).first().n
    n = max(lists, min(SAMPLE, SAMPLE_NUMBERS // said.dims))
    sample = base.select("vec_id", x.alias("x")).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id", "x").limit(n).collect()  # SAMPLE rows
    space = Space(said.dims, said.scale, lift, [r.x for r in sample], lists, seed)
    space.sample_ids = np.array([r.vec_id for r in sample], np.int64)
    return space


def search(vectors: DataFrame, every: int = 20, k: int = 20, lists: int = LISTS, probes: int = PROBES, seed: int = 7, vec_id: str = "vec_id", col: str = "embedding", part: int = PART) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each vector whose id is divisible by `every`.

    Of `lists` lists a query probes the `probes` nearest, and more where those hold fewer than k candidates; all of them make
    the search exact but for the tests' errors.
    """
    spark = vectors.sparkSession
    base = usable(vectors, vec_id, col)
    space = fit(base, lists, seed)
    if space is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(space)  # bounded by SAMPLE_NUMBERS
    kind = base.schema["x"].dataType.simpleString()

    def rows_of(batch):
        flat, offsets = batch.column("x"), None
        sizes = np.array(flat.value_lengths())
        values = np.array(flat.flatten()).astype(np.float64)
        if len(sizes) and (sizes == shared.value.dims).all():
            return values.reshape(len(sizes), -1)
        offsets = np.cumsum(sizes) - sizes
        return shared.value.dense([values[a : a + n] for a, n in zip(offsets.tolist(), sizes.tolist(), strict=True)])

    def assign(batches):
        for batch in batches:
            own = shared.value.nearest(*shared.value.rotated(rows_of(batch)), 1)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(own.astype(np.int32))], names=["vec_id", "x", "list"])

    folder = new_folder(spark, "lists")
    base.mapInArrow(assign, f"vec_id long, x {kind}, list int").write.parquet(folder)
    index = spark.read.parquet(folder)
    sizes = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
    def probe(batches):
        for batch in batches:
            s, x = shared.value, rows_of(batch)
            y, _ = s.rotated(x)
            near = s.nearest(y, np.zeros(len(y)), len(s.centroids))
            enough = (np.cumsum(filled[near], 1) < k + np.array(batch.column("own"))[:, None]).sum(1) + 1
            probed = np.maximum(enough, probes)
            taken = np.zeros((len(x), len(s.centroids)), bool)
            np.put_along_axis(taken, near, np.arange(near.shape[1]) < probed[:, None], 1)
            ids, worst = np.array(batch.column("vec_id")), np.full(len(x), -np.inf)
            for a in range(0, len(x), QUERIES):
                # Only candidates in lists that the query probes make a threshold, so what reaches it will be found.
                mine = taken[a : a + QUERIES]
                row, _, score = scan(s, ids[a : a + QUERIES], x[a : a + QUERIES], worst[a : a + QUERIES], s.sample_ids, s.sample, s.sample_rotated, k, lambda i, j, mine=mine: mine[i, s.sample_lists[j]])
                full = np.flatnonzero(np.bincount(row, minlength=len(mine)) == k)
                worst[a + full] = score[np.searchsorted(row, full, "right") - 1]
            lists_ = [n[:m] for n, m in zip(near.astype(np.int32), probed.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(lists_, pa.list_(pa.int32())), pa.array(worst)], names=["vec_id", "x", "lists", "worst"])

    filled = np.array([sizes.get(j, 0) for j in range(len(space.centroids))], np.int64)
    parts = F.element_at(F.create_map(*[F.lit(v) for j in range(len(space.centroids)) for v in (j, max(1, -(-sizes.get(j, 0) // part)))]), F.col("list"))
    held = index.select("list", F.pmod(F.xxhash64("vec_id", "x"), parts).cast("int").alias("part"), F.lit(0).alias("kind"), "vec_id", "x", F.lit(None).cast("double").alias("worst"))
    # A query costs far more than its bytes tell, so tasks must not be merged by their bytes.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = base.where(F.col("vec_id") % every == 0).repartition(tasks, "vec_id").groupBy("vec_id").agg(F.min("x").alias("x"), F.count("*").alias("own"))
    asked = asked.mapInArrow(probe, f"vec_id long, x {kind}, lists array<int>, worst double")
    asked = asked.select("vec_id", "x", "worst", F.explode("lists").alias("list"))
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(1).alias("kind"), "vec_id", "x", "worst")
    dealt = held.unionByName(asked).repartition("list", "part").sortWithinPartitions("list", "part", "kind")

    def answer(batches):
        s, now, ids, vectors_, rotated = shared.value, None, [], [], None
        for batch in batches:
            place = np.stack([np.array(batch.column(c)) for c in ("list", "part", "kind")], 1)
            cut = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            x, all_ids, worst = rows_of(batch), np.array(batch.column("vec_id")), np.array(batch.column("worst").fill_null(0.0))
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(place)], strict=True):
                if a == b:
                    continue
                if now != (key := tuple(place[a, :2])):
                    now, ids, vectors_, rotated = key, [], [], None
                if place[a, 2] == 0:
                    ids.append(all_ids[a:b].copy())
                    vectors_.append(x[a:b].copy())
                    continue
                if len(ids) > 1:
                    ids, vectors_ = [np.concatenate(ids)], [np.concatenate(vectors_)]
                if ids and rotated is None:
                    rotated = s.rotated(vectors_[0])
                for c in range(a, b if ids else a, QUERIES):
                    d = min(b, c + QUERIES)
                    row, at, score = scan(s, all_ids[c:d], x[c:d], worst[c:d], ids[0], vectors_[0], rotated, k)
                    yield pa.RecordBatch.from_arrays([pa.array(all_ids[c:d][row]), pa.array(ids[0][at]), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(answer, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
