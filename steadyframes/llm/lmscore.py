"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every word from both sides.

Words are letters and digits, lower-cased in A-Z, in BUCKETS hashed buckets. Spark counts each distinct word; the table
of these counts grows with the corpus and stays on Spark. The buckets' sums cut them into CLASSES x LEAVES leaves of
about equal mass. The network sees the WINDOW words on either side through hashed embeddings, one layer of tanh, a
softmax over the classes, and one over the leaves of the word's class; a word's conditional log-probability is its
class's plus its leaf's plus its bucket's share of the leaf plus the word's own share of its bucket. The counts of the
FREQUENT most frequent words go to all workers; each other word is joined with the table. The two shares don't depend
on the context.

Every word of every document is a training target once: in each of ROUNDS rounds each partition descends from the
shared weights over every ROUNDS-th word of its documents, a place further on than in the round before, and Spark
averages the partitions' weights by their number of words. Nothing but counts and weights of fixed number reaches the
driver.

Defined cases: null and empty texts have no words and the score 0; without any words in the corpus all weights stay
as they start; repeated rows score alike, as log-probabilities are summed in units of 2^-20; columns named like an output are replaced; a word that training never met
counts as half a one of its bucket.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from steadyframes.llm.components import new_folder
from steadyframes.llm.textbytes import ALNUM, LOWER, blocks, span_hashes, spans

BUCKETS, CLASSES, LEAVES, INPUTS = 1 << 15, 32, 32, 1 << 12
DIM, HIDDEN, WINDOW = 16, 32, 2
#: RATE is for the sum over a batch's words.
ROUNDS, BATCH, RATE = 2, 1024, 0.0016
STEP = 1 << 12
#: Rows in which a task's weights go out to be averaged.
PACKS, PACKED = 64, "pack int, weights binary, n double"
#: Bound of what goes into an exponential.
MOST = 40
FREQUENT = 1 << 15
WEIGHTS = ("embed", "mix", "hidden", "out", "bias", "low", "low_bias")
#: Logarithms of counts are integers in units of 2^-30, so that sums are exact in any order.
UNIT = 1 << 30
#: Sums of a network's log-probabilities, whose last bits are noise, are in coarser ones.
SUM_UNIT = 1 << 20
#: Steps of a unit to which weights and hidden values are rounded for scoring.
STEPS = float(1 << 20)


@dataclasses.dataclass
class Model:
    """Leaf and log-share of each bucket; the network's weights; each bucket's count, hashes (ascending) and counts of
    the most frequent words, and the folder of the table (word, n) of all words."""

    leaf_of: np.ndarray
    share: np.ndarray
    embed: np.ndarray
    mix: np.ndarray
    hidden: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    low: np.ndarray
    low_bias: np.ndarray
    counts: np.ndarray
    frequent: np.ndarray
    often: np.ndarray
    words: str

    def weights(self) -> list[np.ndarray]:
        return [getattr(self, k) for k in WEIGHTS]


def words_of(texts: pa.Array):
    """Hashes of the words of a block of rows, and the rows' places."""
    for _, _, buf, offsets in blocks(texts):
        low = LOWER[buf]
        starts, ends, rows = spans(ALNUM[low], offsets)
        yield span_hashes(low, starts, ends), rows


def leaves(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequent buckets first, cut into runs of about equal mass; each bucket's log-share of its leaf."""
    mass = counts.astype(np.float64) + 0.5
    order = np.argsort(-mass, kind="stable")
    before = np.concatenate(([0], np.cumsum(mass[order])[:-1])) / mass.sum()
    leaf_of = np.empty(len(counts), np.int64)
    leaf_of[order] = np.minimum((before * CLASSES * LEAVES).astype(np.int64), CLASSES * LEAVES - 1)
    total = np.bincount(leaf_of, weights=mass, minlength=CLASSES * LEAVES)
    return leaf_of, np.log(mass / total[leaf_of])


def start(counts: np.ndarray, frequent: np.ndarray, often: np.ndarray, words: str, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    leaf_of, share = leaves(counts)
    mass = np.maximum(np.bincount(leaf_of, weights=counts + 0.5, minlength=CLASSES * LEAVES), 1e-9).reshape(CLASSES, LEAVES)
    f = np.float32
    return Model(
        leaf_of, share, rng.normal(0, 0.3, (INPUTS + 1, DIM)).astype(f), rng.normal(0, 0.2, (2 * WINDOW, DIM, HIDDEN)).astype(f),
        np.zeros(HIDDEN, f), np.zeros((HIDDEN, CLASSES), f), np.log(mass.sum(1) / mass.sum()).astype(f),
        np.zeros((CLASSES, HIDDEN, LEAVES), f), np.log(mass / mass.sum(1, keepdims=True)).astype(f), counts, frequent, often, words,
    )


def contexts(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Input numbers of the words around each word (words x 2 WINDOW); INPUTS stands for what is beyond the text."""
    n = len(hashes)
    number = (hashes & np.uint64(INPUTS - 1)).astype(np.int16)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    out = np.full((n, 2 * WINDOW), INPUTS, np.int16)
    for k, shift in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        to, of = (slice(-shift, None), slice(None, shift)) if shift < 0 else (slice(None, -shift), slice(shift, None))
        out[to, k] = np.where(row[to] == row[of], number[of], INPUTS)
    return out


def dealt(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A table, a row for each class, of the places of its words (len(group) where there is none); and each word's
    place in that table, rows one after another."""
    order = np.argsort(group.astype(np.uint8), kind="stable")
    counts = np.bincount(group, minlength=CLASSES)
    width = max(16, -(-int(counts.max(initial=0)) // 16) * 16)
    place = np.empty(len(group), np.int64)
    place[order] = group[order] * width + np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
    table = np.full(CLASSES * width, len(group), np.int64)
    table[place] = np.arange(len(group))
    return table.reshape(CLASSES, width), place


def stepped(x: np.ndarray) -> np.ndarray:
    """Doubles rounded to multiples of 2^-20 within +-8. Sums of up to 64 products of such numbers are exact, in whatever order
    a library adds them up."""
    return np.rint(np.clip(x, -8, 8).astype(np.float64) * STEPS) / STEPS


def scoring_weights(m: Model) -> tuple[np.ndarray, ...]:
    """embed, mix, out and low as they are used for scoring."""
    return stepped(m.embed), stepped(m.mix.reshape(-1, HIDDEN)), stepped(m.out), stepped(m.low)


def log_probabilities(m: Model, hashes: np.ndarray, rows: np.ndarray, weights: tuple | None = None) -> np.ndarray:
    """Of each word's bucket given the word's neighbours; the same for equal words among equal neighbours, wherever they stand."""
    embed, mix, out_, low = weights or scoring_weights(m)
    bucket = (hashes >> np.uint64(40) & np.uint64(BUCKETS - 1)).astype(np.int64)
    n = len(hashes)
    # The last step is filled up, so that what is done number by number has one shape.
    room = -(-n // STEP) * STEP
    context, leaf = np.zeros((room, 2 * WINDOW), np.int16), np.zeros(room, np.int64)
    context[:n], leaf[:n] = contexts(hashes, rows), m.leaf_of[bucket]
    out, at, f = np.empty(room, np.float64), np.arange(STEP), np.float32
    y = np.empty((STEP, LEAVES), f)
    for a in range(0, room, STEP):
        group, inner = np.divmod(leaf[a : a + STEP], LEAVES)
        h = np.tanh((embed[context[a : a + STEP]].reshape(STEP, -1) @ mix).astype(f) + m.hidden).astype(np.float64)
        h *= STEPS
        np.rint(h, out=h)
        h *= 1 / STEPS
        z = np.clip((h @ out_).astype(f) + m.bias, -MOST, MOST)
        out[a : a + STEP] = z[at, group] - np.log(np.exp(z).sum(1))
        order = np.argsort(group.astype(np.uint8), kind="stable")
        h, sorted_ = h[order], group[order]
        cuts = np.searchsorted(sorted_, np.arange(CLASSES + 1)).tolist()
        for g, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            y[lo:hi] = h[lo:hi] @ low[g]
        y += m.low_bias[sorted_]
        np.clip(y, -MOST, MOST, out=y)
        out[a + order] += y[at, inner[order]] - np.log(np.exp(y).sum(1))
    return out[:n] + m.share[bucket]


def own_shares(m: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm, in units, of each word's share of its bucket, without the word's count where it isn't frequent; and
    whether it isn't."""
    bucket = (hashes >> np.uint64(40) & np.uint64(BUCKETS - 1)).astype(np.int64)
    out = -units(m.counts)[bucket]
    if not len(m.frequent):
        return out, np.ones(len(hashes), bool)
    at = np.minimum(np.searchsorted(m.frequent, hashes), len(m.frequent) - 1)
    known = m.frequent[at] == hashes
    out[known] += units(m.often)[at[known]]
    return out, ~known


def units(counts: np.ndarray) -> np.ndarray:
    return np.rint(np.log(np.maximum(counts, 0.5)) * UNIT).astype(np.int64)


def ones(n: int) -> np.ndarray:
    return np.ones(n, np.float32)


def _error(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Softmax of the rows, less 1 at the targets."""
    z = np.exp(np.clip(z, -MOST, MOST))
    z *= (1 / (z @ ones(z.shape[1])))[:, None]
    z[np.arange(len(z)), target] -= 1
    return z


def descend(m: Model, context: np.ndarray, leaf: np.ndarray) -> None:
    """One pass of gradient descent in place."""
    for a in range(0, len(leaf), BATCH):
        c, (group, inner) = context[a : a + BATCH], np.divmod(leaf[a : a + BATCH], LEAVES)
        n = len(c)
        x = m.embed[c].reshape(n, -1)
        mix = m.mix.reshape(-1, HIDDEN)
        h = np.zeros((n + 1, HIDDEN), m.out.dtype)
        np.tanh(x @ mix + m.hidden, out=h[:n])
        p = _error(h[:n] @ m.out + m.bias, group)
        table, place = dealt(group)
        own = h[table]
        q = np.zeros((table.size, LEAVES), m.low.dtype)
        q[place] = _error((own @ m.low).reshape(-1, LEAVES)[place] + m.low_bias[group], inner)
        q = q.reshape(CLASSES, -1, LEAVES)
        back = (p @ m.out.T + (q @ m.low.transpose(0, 2, 1)).reshape(-1, HIDDEN)[place]) * (1 - h[:n] * h[:n])
        grad = (mix @ back.T).reshape(2 * WINDOW, DIM, n)
        m.out -= RATE * (h[:n].T @ p)
        m.bias -= RATE * (ones(n) @ p)
        m.low -= RATE * (own.transpose(0, 2, 1) @ q)
        m.low_bias -= RATE * q.sum(1)
        m.hidden -= RATE * (ones(n) @ back)
        mix -= RATE * (x.T @ back)
        flat = c.T.reshape(-1).astype(np.int64)
        for k in range(DIM):
            m.embed[:, k] -= RATE * np.bincount(flat, weights=grad[:, k].reshape(-1), minlength=len(m.embed))


def chosen(rows: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Places of the words that train in a round: every rounds-th of each row from the turn-th on. All rounds together
    have each word once."""
    inside = np.arange(rows[-1]) - np.repeat(rows[:-1], np.diff(rows))
    return np.flatnonzero(inside % rounds == turn)


def packed(weights: np.ndarray, n: float) -> pa.RecordBatch:
    """A task's weights times its words, in PACKS rows."""
    weights = weights.astype(np.float64) * n
    return pa.RecordBatch.from_arrays([pa.array(np.arange(PACKS, dtype=np.int32)), pa.array([x.tobytes() for x in np.array_split(weights, PACKS)], pa.binary()), pa.array(np.full(PACKS, n))], names=["pack", "weights", "n"])


def added(batches):
    """The sums of the rows of each pack."""
    sums: dict[int, list] = {}
    for batch in batches:
        for pack, weights, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = sums.setdefault(pack, [0.0, 0.0])
            own[0], own[1] = own[0] + np.frombuffer(weights), own[1] + n
    packs = sorted(sums)
    yield pa.RecordBatch.from_arrays([pa.array(packs, pa.int32()), pa.array([sums[k][0].tobytes() for k in packs], pa.binary()), pa.array([sums[k][1] for k in packs], pa.float64())], names=["pack", "weights", "n"])


def fit(docs: DataFrame, *, text: str = "text", rounds: int = ROUNDS) -> Model:
    spark = docs.sparkSession
    base = docs.select(F.col(text).cast("string").alias("text"))

    def count(batches):
        held, size = [], 0

        def flush():
            h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            word, at = np.unique(h, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bincount(at, weights=n).astype(np.int64))], names=["word", "n"])

        for batch in batches:
            for h, _ in words_of(batch.column(0)):
                if len(h):
                    held.append(np.unique(h, return_counts=True))
                    size += len(held[-1][0])
                if size > 1 << 20:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    folder = new_folder(spark, "words")
    base.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).write.parquet(folder)
    table = spark.read.schema("word long, n long").parquet(folder)
    bucket = F.shiftrightunsigned("word", 40).bitwiseAND(BUCKETS - 1).alias("bucket")
    counts = np.zeros(BUCKETS, np.int64)
    found = table.groupBy(bucket).agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    top = table.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    frequent, often = (top.column(c).to_numpy() for c in ("word", "n"))
    frequent = frequent.astype(np.int64).view(np.uint64)
    order = np.argsort(frequent)
    m = start(counts, frequent[order], often[order], folder)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(m)

        def learn(batches, shared=shared, turn=turn):
            base_ = shared.value
            own = dataclasses.replace(base_, **{k: getattr(base_, k).copy() for k in WEIGHTS})
            seen, held, size = 0, [], 0

            def step():
                nonlocal seen, held, size
                context, target = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.random.default_rng(len(target)).permutation(len(target))
                descend(own, context[order], target[order])
                seen, held, size = seen + len(target), [], 0

            for batch in batches:
                for h, rows in words_of(batch.column(0)):
                    at = chosen(rows, turn, rounds)
                    if len(at):
                        bucket = (h[at] >> np.uint64(40) & np.uint64(BUCKETS - 1)).astype(np.int64)
                        held.append((contexts(h, rows)[at], own.leaf_of[bucket]))
                        size += len(at)
                    if size > 1 << 18:
                        step()
            if held:
                step()
            if seen:
                yield packed(np.concatenate([w.reshape(-1) for w in own.weights()]), float(seen))

        flat = np.concatenate([w.reshape(-1) for w in m.weights()]).astype(np.float64)
        parts = np.array_split(flat, PACKS)
        for row in base.mapInArrow(learn, PACKED).repartition("pack").mapInArrow(added, PACKED).collect():  # PACKS rows
            parts[row.pack][:] = np.frombuffer(row.weights) / row.n  # views of flat
        parts, at = [], 0
        for w in m.weights():
            parts.append(flat[at : at + w.size].reshape(w.shape).astype(np.float32))
            at += w.size
        m = dataclasses.replace(m, **dict(zip(WEIGHTS, parts, strict=True)))
    return m


def score(docs: DataFrame, model: Model, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns (without keep_text, all but the text) and n_words, log_likelihood (sum over words), per_word (its mean,
    null without words). The rows lie in files below the checkpoint folder till the counts of rare words are joined."""
    names = ["n_words", "log_likelihood", "per_word"]
    spark = docs.sparkSession
    base = docs.drop(*[c for c in docs.columns if c in names])
    place = base.columns.index(text)
    kept = [i for i in range(len(base.columns)) if keep_text or i != place]
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        weights = scoring_weights(shared.value)
        for batch in batches:
            n, total, known, rare, many = [], [], [], [], []
            for h, rows in words_of(batch.column(place)):
                own, absent = own_shares(shared.value, h)
                said = np.rint(log_probabilities(shared.value, h, rows, weights) * SUM_UNIT).astype(np.int64)
                for out, x in ((total, said), (known, own), (many, absent.astype(np.int64))):
                    out.append(np.diff(np.concatenate((np.zeros(1, x.dtype), np.cumsum(x)))[rows]))
                n.append(np.diff(rows))
                rare.append(h[absent].view(np.int64))
            n, total, known, rare, many = (np.concatenate(x) if x else np.zeros(0) for x in (n, total, known, rare, many))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32()), pa.array(rare, pa.int64()))
            more = [pa.array(n.astype(np.int64)), pa.array(total / SUM_UNIT, pa.float64()), pa.array(known.astype(np.int64)), lists]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *more], names=[*[batch.schema.names[i] for i in kept], "n_words", "sum_", "known_", "rare_"])

    extra = StructType.fromDDL("n_words long, sum_ double, known_ long, rare_ array<long>").fields
    folder = new_folder(spark, "scores")
    base.mapInArrow(run, StructType([base.schema.fields[i] for i in kept] + extra)).withColumn("row_", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    rows = spark.read.parquet(folder)
    table = spark.read.schema("word long, n long").parquet(model.words)
    log = F.coalesce(F.round(F.log("n") * UNIT).cast("long"), F.lit(int(units(np.zeros(1))[0])))
    rare = rows.select("row_", F.explode("rare_").alias("word")).join(table, "word", "left").groupBy("row_").agg(F.sum(log).alias("joined_"))
    total = F.col("sum_") + (F.col("known_") + F.coalesce("joined_", F.lit(0))) / UNIT
    out = rows.drop("rare_").join(rare, "row_", "left").withColumn("log_likelihood", total)
    out = out.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))
    return out.select(*[base.columns[i] for i in kept], *names)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_likelihood, per_word of every whole text, by a network trained on all of them."""
    return score(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs), keep_text=False)
