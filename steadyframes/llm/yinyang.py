"""Centroid clustering with integer vectors and centroids, by Yinyang grouping.

Vectors lie as blocks in a table that each round reads and writes anew: a row has some thousands of vectors, each
one's centroid, an upper bound of its distance to it, and one lower bound for each group of centroids of its distance
to the group's others. The centroids are grouped once, at the start. In a round a vector whose upper bound stays below
all its lower bounds keeps its centroid unseen; others look only into groups whose bound says so, and there only at
centroids that the bound, less their own move, doesn't rule out, and those are measured exactly. Every block carries the
sums of its vectors by centroid, and Spark adds them up; only sums of k x dims numbers and the k centroids pass through
the driver.

Defined cases: null vectors, those of another length and those with null or non-finite components are left out; repeated
rows count as often as they stand and come out as often; a null id is kept (its hash comes last); fewer vectors than k
give fewer centroids, none give no rows; ties go to the smaller number. A component beyond 2^25 after scaling is an
error, as squared distances would not fit 64 bits. Only id and vector are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadyframes.llm.components import drop_folder, new_folder

#: Components beyond this would take squared distances of 64 of them out of 64 bits.
LARGEST = 1 << 25
#: Up to here a product of matrices in doubles is exact for up to 2^10 components.
EXACT = 1 << 20
#: Bounds are widened by this share, so that rounding never rules a centroid out.
SLACK = 1e-9
FAR = np.iinfo(np.int64).max


def usable(vectors: DataFrame, dims: int, vec_id: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors of the right length whose components are all finite."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(vec_id).alias("vec_id"), F.col(col).alias("x")).where((F.size("x") == dims) & finite)


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    """Components as integers floor(scale * x)."""
    out = np.floor(scale * x.astype(np.float64))
    if len(out) and not np.abs(out).max() <= LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling: squared distances would not fit 64 bits")
    return out.astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT and x.shape[1] <= 1 << 10:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


def paired(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of x to the same row of c, or to its only row."""
    return ((x - c) ** 2).sum(1)


def grouped(centroids: np.ndarray, groups: int, turns: int = 5) -> np.ndarray:
    """The group of each centroid, by a few turns of plain clustering of the centroids themselves."""
    heads = centroids[:groups].astype(np.float64)
    own = np.zeros(len(centroids), np.int64)
    for _ in range(turns):
        own = ((centroids[:, None, :] - heads[None]) ** 2).sum(2).argmin(1)
        heads = np.stack([centroids[own == g].mean(0) if (own == g).any() else heads[g] for g in range(len(heads))])
    return own


def _least(bounds: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of bounds by centroid the least of each group."""
    out = np.full((len(bounds), int(group.max()) + 1), np.inf)
    for j, g in enumerate(group.tolist()):
        np.minimum(out[:, g], bounds[:, j], out=out[:, g])
    return out


def first_round(x: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(own centroid, upper bounds, lower bounds, distances measured) from all distances."""
    d = squared(x, centroids)
    own = d.argmin(1)
    rows = np.arange(len(x))
    far = np.sqrt(d.astype(np.float64))
    upper = far[rows, own] * (1 + SLACK)
    far *= 1 - SLACK
    far[rows, own] = np.inf
    return own, upper, _least(far, group), d.size


def next_round(x, own, upper, lower, centroids, moves, group) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same from the round before, when the centroids have moved by `moves`."""
    moves = moves * (1 + SLACK)
    most = np.array([moves[group == g].max(initial=0) for g in range(lower.shape[1])])
    upper = upper + moves[own]
    before, lower = lower, lower - most
    own, seen = own.copy(), 0
    left = np.flatnonzero(lower.min(1) <= upper)
    upper[left] = np.sqrt(paired(x[left], centroids[own[left]]).astype(np.float64)) * (1 + SLACK)
    seen += len(left)
    left = left[lower[left].min(1) <= upper[left]]
    if not len(left):
        return own, upper, lower, seen
    rows, mine = np.arange(len(left)), own[left]
    d = np.full((len(left), len(centroids)), FAR)
    d[rows, mine] = paired(x[left], centroids[mine])
    bound = before[left][:, group] - moves
    bound[rows, mine] = np.sqrt(d[rows, mine].astype(np.float64)) * (1 - SLACK)
    best = upper[left]
    for g in range(lower.shape[1]):
        open_ = lower[left, g] <= best
        for j in np.flatnonzero(group == g).tolist():
            at = np.flatnonzero(open_ & (bound[:, j] <= best) & (mine != j))
            if len(at):
                d[at, j] = paired(x[left[at]], centroids[j])
                root = np.sqrt(d[at, j].astype(np.float64))
                bound[at, j] = root * (1 - SLACK)
                best[at] = np.minimum(best[at], root * (1 + SLACK))
                seen += len(at)
    new = d.argmin(1)
    bound[rows, new] = np.inf
    own[left], upper[left], lower[left] = new, np.sqrt(d[rows, new].astype(np.float64)) * (1 + SLACK), _least(bound, group)
    return own, upper, lower, seen


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    """Integers in the narrowest type that holds them."""
    most = int(np.abs(x).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4"
    return kind, x.astype(kind).tobytes()


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.array(batch.column("x").flatten()).reshape(-1, dims)


def _sums(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """By centroid, the sums of its vectors' components and their number."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    for j in np.unique(own).tolist():
        out[j, :-1], out[j, -1] = x[own == j].sum(0), (own == j).sum()
    return out


def _block(ids: pa.Array, x: np.ndarray, state: tuple, k: int) -> pa.RecordBatch:
    own, upper, lower, seen = state
    kind, data = _packed(x)
    ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    values = [ids, [kind], [data], [own.astype("<i4").tobytes()], [upper.tobytes()], [lower.tobytes()], [_sums(x, own, k).reshape(-1).tolist()], [seen]]
    kinds = [ids.type, pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["ids", "kind", "x", "own", "upper", "lower", "sums", "seen"])


def _blocks(batches, dims: int) -> Iterator[tuple]:
    """(ids, vectors, own, upper, lower) of each block of a round's table."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = {n: batch.column(n)[i] for n in batch.schema.names if n != "ids"}
            x = np.frombuffer(r["x"].as_py(), r["kind"].as_py()).reshape(-1, dims).astype(np.int64)
            yield batch.column("ids")[i].values, x, np.frombuffer(r["own"].as_py(), "<i4").astype(np.int64), np.frombuffer(r["upper"].as_py()), np.frombuffer(r["lower"].as_py()).reshape(len(x), -1)


def seeds(vectors: DataFrame, k: int, salt: str) -> list[list[float]]:
    """The k vectors whose ids have the smallest hashes, in their order."""
    h = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    found = vectors.select(h.alias("h"), F.col("x").cast("array<double>").alias("x")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()  # k rows
    return [r.x for r in found]


def moved(centroids: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Centroids at the floor of their vectors' means; those without vectors stay."""
    n = sums[:, -1:]
    return np.where(n > 0, sums[:, :-1] // np.maximum(n, 1), centroids)


def total_sums(table: DataFrame, k: int, dims: int) -> np.ndarray:
    """The blocks' sums added up: k x (dims + 1) rows come to the driver."""
    out = np.zeros(k * (dims + 1), np.int64)
    for pos, total in table.select(F.posexplode("sums").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v")).collect():
        out[pos] = total
    return out.reshape(k, dims + 1)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, salt: str = "2:", groups: int | None = None, vec_id: str = "vec_id", col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every usable vector after `rounds` rounds and a last assignment, and the centroids.

    k centroids start as the vectors with the smallest hashes of salt and id. groups: about k / 10 unless given.
    """
    spark = vectors.sparkSession
    base = usable(vectors, dims, vec_id, col)
    id_kind = base.schema["vec_id"].dataType.simpleString()
    centroids = scaled(np.array(seeds(base, k, salt), np.float64).reshape(-1, dims), scale)
    k = len(centroids)
    if not k:
        return base.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    group = grouped(centroids, groups or max(1, k // 10))
    schema = f"ids array<{id_kind}>, kind string, x binary, own binary, upper binary, lower binary, sums array<bigint>, seen long"

    def start(batches):
        for batch in batches:
            if batch.num_rows:
                x = scaled(_vectors(batch, dims), scale)
                yield _block(batch.column("vec_id"), x, first_round(x, centroids, group), k)

    folder = new_folder(spark, "clusters")
    base.mapInArrow(start, schema).write.parquet(f"{folder}/0")
    for turn in range(1, rounds + 1):
        table = spark.read.parquet(f"{folder}/{turn - 1}")
        old, centroids = centroids, moved(centroids, total_sums(table, k, dims))
        moves = np.sqrt(paired(old, centroids).astype(np.float64))
        last = turn == rounds

        def step(batches, c=centroids, moves=moves, last=last):
            for ids, x, own, upper, lower in _blocks(batches, dims):
                state = next_round(x, own, upper, lower, c, moves, group)
                if last:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(state[0].astype(np.int32)), pa.array(paired(x, c[state[0]]))], names=["vec_id", "cluster", "distance"])
                else:
                    yield _block(ids, x, state, k)

        table.mapInArrow(step, f"vec_id {id_kind}, cluster int, distance long" if last else schema).write.parquet(f"{folder}/{turn}")
        drop_folder(spark, f"{folder}/{turn - 1}")
    return spark.read.parquet(f"{folder}/{rounds}"), centroids


def digest(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, salt: str = "2:") -> DataFrame:
    """Each vector's cluster with its distance, the sums of distances in the cluster and over all, and the centroid's digest."""
    found, centroids = cluster(vectors, k, rounds, dims, scale, salt)
    spark = vectors.sparkSession
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    rows = [(j, sums.get(j, 0), sum(sums.values()), ",".join(map(str, c))) for j, c in enumerate(centroids.tolist())]
    said = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, parts string")
    said = said.select("cluster", "cluster_inertia", "inertia", F.sha2("parts", 256).alias("centroid_sha256"))
    return found.join(F.broadcast(said), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
