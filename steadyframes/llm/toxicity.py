"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of rows of one hashed table: two for the whole word (two hashes, so that a rare word
and a telling one rarely share both), and one for each of its beginnings and its ending of fixed byte lengths.
Filters of several widths run over the words, the largest value of each filter over the whole text feeds a logistic output. One dimension of the table starts as the smoothed log-odds of its words, the rest at
random; all of it is then trained by Adam through the max pooling.

Labels are learnt from every labelled row outside those held out, by all its words. Two thirds of the ids train: Spark sums the
counts of a bucket's rows, then in each of EPOCHS rounds each partition descends from the shared weights over its rows,
and Spark averages the partitions' weights by their number of rows; of the table only changed rows go out. The last third
calibrates: the scale of the score, and by language the threshold of the decision, from counts of rows by steps of
1 / GRID of a logit. Nothing but counts and weights of fixed number reaches the driver. The score sees nothing but the
text; only the decision looks up a language.

Defined cases: null or empty texts score as texts without words; rows with a null label are not learnt from; of labels that
share a doc_id the larger counts; labels of one class or none gives the same score to all; repeated rows score alike; an unknown or null language
uses the threshold of all languages; columns named like an output are replaced.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from steadyframes.llm.components import drop_folder, new_folder
from steadyframes.llm.textbytes import ALNUM, LOWER, blocks, distinct, free, mix, ragged, span_hashes, spans

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
BEGINNINGS, ENDING = (3, 4, 6), 4
EPOCHS, BATCH, RATE = 4, 64, 0.01
#: Rows or words that a task hashes before it descends over them in random order.
HOLD_ROWS, HOLD_WORDS = 1024, 1 << 20
#: Rows in which a task's changes of the table go out to be averaged; one more has the other weights.
PACKS, PACKED = 64, "pack int, task int, at binary, change binary, n double"
#: Steps of a logit in which cuts are placed.
GRID = 1000
THRESHOLD = 0.7
LEAST = 10


@dataclasses.dataclass
class Model:
    """Weights, and the threshold of each language; '' holds for all others."""

    table: np.ndarray
    filters: list[np.ndarray]
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: float
    scale: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] = dataclasses.field(default_factory=lambda: {"": THRESHOLD})


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct words, the rows of the table (int32, one column a part); each word's number; the rows' places."""
    low = LOWER[buf]
    starts, ends, rows = spans(ALNUM[low], offsets)
    whole = span_hashes(low, starts, ends)
    first, inverse = distinct(whole)
    a, b, whole = starts[first], ends[first], whole[first]
    parts = [whole, whole >> np.uint64(32)]
    parts += [mix(span_hashes(low, a, np.minimum(a + n, b)) + np.uint64(n)) for n in BEGINNINGS]
    parts.append(mix(span_hashes(low, np.maximum(b - ENDING, a), b) + np.uint64(99)))
    return np.stack([(p & np.uint64(BUCKETS - 1)).astype(np.int32) for p in parts], 1), inverse, rows


def _padded(numbers: np.ndarray, rows: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers with blanks after each row, as many as the widest filter looks ahead; and the rows' new places."""
    gap = max(WIDTHS) - 1
    counts = np.diff(rows)
    at = rows[:-1] + gap * np.arange(len(counts))
    seq = np.full(len(numbers) + gap * len(counts), blank, np.int64)
    seq[np.arange(len(numbers)) + gap * np.repeat(np.arange(len(counts)), counts)] = numbers
    return seq, at


def pooled(model: Model, embedded: np.ndarray, numbers: np.ndarray, rows: np.ndarray, where: bool = False):
    """The largest response of each filter in each row; where: also the word at which its window begins, else -1.

    embedded: the embeddings of distinct words; numbers: each word's number among them.
    """
    counts = np.diff(rows)
    value = np.zeros((len(counts), len(WIDTHS) * FILTERS), np.float32)
    place = np.full(value.shape, -1, np.int64)
    table = np.vstack([embedded, np.zeros((1, DIM), np.float32)])
    seq, at = _padded(numbers, rows, len(embedded))
    full = np.flatnonzero(counts)
    if not len(full):
        return value, place
    owner = np.repeat(full, counts[full])
    words = np.arange(len(numbers)) + (max(WIDTHS) - 1) * owner  # where a window may begin
    begin = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
    for k, width in enumerate(WIDTHS):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        response = np.zeros((len(words), FILTERS), np.float32)
        for shift in range(width):
            response += (table @ model.filters[k][shift])[seq[words + shift]]
        best = np.maximum.reduceat(response, begin, axis=0)
        value[full, cols] = np.maximum(best + model.shifts[k], 0)
        if where:
            for j in range(FILTERS):
                hit = np.flatnonzero(response[:, j] == np.repeat(best[:, j], counts[full]))
                first = hit[np.searchsorted(hit, begin)]
                place[full, k * FILTERS + j] = np.where(value[full, k * FILTERS + j] > 0, first, -1)
    return value, place


def _embed(model: Model, parts: np.ndarray) -> np.ndarray:
    return model.table[parts].sum(1)


def logits(model: Model, parts: np.ndarray, numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Before scale and offset."""
    value, _ = pooled(model, _embed(model, parts), numbers, rows)
    return value @ model.out + model.bias


def scores(model: Model, parts: np.ndarray, numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = logits(model, parts, numbers, rows) * model.scale + model.offset
    # Rounded, as the last bits of a product depend on how many rows a block has.
    return np.round(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))), 6)


def _seen(parts: np.ndarray, numbers: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many toxic and how many other rows have each bucket, added up over the parts of a word."""
    owner = np.repeat(np.arange(len(y)), np.diff(rows))
    pairs = np.unique(owner * len(parts) + numbers)
    owner, numbers = pairs // max(1, len(parts)), pairs % max(1, len(parts))
    seen = np.zeros((2, BUCKETS))
    for column in parts.T:
        pair = np.unique(owner * BUCKETS + column[numbers])
        bad = np.bincount(pair % BUCKETS, weights=y[pair // BUCKETS], minlength=BUCKETS)
        seen += bad, np.bincount(pair % BUCKETS, minlength=BUCKETS) - bad
    return seen


def _from_counts(seen: np.ndarray, bad: int, good: int, rng: np.random.Generator) -> Model:
    """A table whose first dimension is the log-odds of a bucket's rows; filters that begin near it."""
    table = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    odds = np.log((seen[0] + 1) / (bad + 2)) - np.log((seen[1] + 1) / (good + 2))
    prior = np.log(1 / (bad + 2)) - np.log(1 / (good + 2))
    few = seen.sum(0) / (seen.sum(0) + 5)
    table[:, 0] = np.clip((odds - prior * (1 - few)) * few * (seen.sum(0) > 0) / 3, -2, 2)
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0, :] += 0.5
    return Model(table, filters, [np.full(FILTERS, -1.0, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32) + 0.1, -2.0)


def _start(parts: np.ndarray, rows: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Model:
    return _from_counts(_seen(parts, np.arange(len(parts)), rows, y), int(y.sum()), int(len(y) - y.sum()), rng)


class Adam:
    """Descent on the logistic loss, both classes weighing the same (weights: of other and of toxic rows)."""

    def __init__(self, m: Model, weights: tuple[float, float]):
        self.m, self.weights, self.step = m, np.array(weights, np.float32), 0.0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self._dense()]
        self.bias_moments = [0.0, 0.0]

    def _dense(self) -> list[np.ndarray]:
        return [*self.m.filters, *self.m.shifts, self.m.out]

    def flat(self) -> np.ndarray:
        """All but the table, in one list of numbers."""
        return np.concatenate([*(x.reshape(-1).astype(np.float64) for x in [*self._dense(), *(y for pair in self.moments for y in pair)]), [self.m.bias, *self.bias_moments, self.step]])

    def set_flat(self, flat: np.ndarray) -> None:
        at = 0
        for x in [*self._dense(), *(y for pair in self.moments for y in pair)]:
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        self.m.bias, *self.bias_moments, self.step = flat[at:].tolist()

    def epoch(self, parts: np.ndarray, numbers: np.ndarray, rows: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        """Once over the rows in random order; numbers: of each word, among the distinct ones that parts has."""
        y = y.astype(np.float32)
        order = rng.permutation(len(y))
        for batch in np.array_split(order, max(1, len(y) // BATCH)):
            counts = rows[batch + 1] - rows[batch]
            distinct_words, own = np.unique(numbers[ragged(rows[batch], counts)], return_inverse=True)
            self._batch(parts[distinct_words], own, np.concatenate(([0], np.cumsum(counts))), y[batch])

    def _batch(self, parts: np.ndarray, numbers: np.ndarray, rows: np.ndarray, y: np.ndarray) -> None:
        m = self.m
        self.step += 1
        embedded = _embed(m, parts)
        value, place = pooled(m, embedded, numbers, rows, where=True)
        p = 1 / (1 + np.exp(-np.clip(value @ m.out + m.bias, -30, 30)))
        error = (p - y) * self.weights[(y > 0).astype(int)] / len(y)
        grads = [np.zeros_like(f) for f in m.filters] + [np.zeros_like(s) for s in m.shifts] + [value.T @ error]
        back = error[:, None] * m.out[None, :]
        by_word = np.zeros_like(embedded)
        for k, width in enumerate(WIDTHS):
            for j in range(FILTERS):
                at = place[:, k * FILTERS + j]
                rowsel = np.flatnonzero(at >= 0)
                if not len(rowsel):
                    continue
                g = back[rowsel, k * FILTERS + j]
                grads[len(WIDTHS) + k][j] += g.sum()
                for shift in range(width):
                    inside = at[rowsel] + shift < rows[rowsel + 1]
                    w = numbers[at[rowsel][inside] + shift]
                    grads[k][shift][:, j] += embedded[w].T @ g[inside]
                    np.add.at(by_word, w, g[inside][:, None] * m.filters[k][shift][:, j])
        fix1, fix2 = 1 - 0.9**self.step, 1 - 0.999**self.step
        for param, grad, (m1, m2) in zip(self._dense(), grads, self.moments, strict=True):
            m1 += 0.1 * (grad - m1)
            m2 += 0.001 * (grad * grad - m2)
            param -= RATE * (m1 / fix1) / (np.sqrt(m2 / fix2) + 1e-8)
        g = float(error.sum())
        self.bias_moments = [0.9 * self.bias_moments[0] + 0.1 * g, 0.999 * self.bias_moments[1] + 0.001 * g * g]
        m.bias -= RATE * (self.bias_moments[0] / fix1) / (np.sqrt(self.bias_moments[1] / fix2) + 1e-8)
        touched = np.flatnonzero(np.abs(by_word).sum(1))
        for column in parts[touched].T:
            np.add.at(m.table, column, -RATE * by_word[touched])


def _weights(bad: int, good: int) -> tuple[float, float]:
    return 0.5 * (bad + good) / good, 0.5 * (bad + good) / bad


def train(parts: np.ndarray, rows: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """All rounds over one list of rows, as a single partition makes them."""
    rng = np.random.default_rng(seed)
    m = _start(parts, rows, y, rng)
    if not len(y) or y.min() == y.max():
        return m
    adam = Adam(m, _weights(int(y.sum()), int(len(y) - y.sum())))
    for _ in range(EPOCHS):
        adam.epoch(parts, np.arange(len(parts)), rows, y, rng)
    return m


def _cut(z: np.ndarray, bad: np.ndarray, good: np.ndarray) -> float:
    """The cut of fewest errors, if rows below it count as good; between equal ones the middle of the widest gap.

    z: distinct logits, ascending; bad and good: how many rows of either class have each.
    """
    errors = np.concatenate(([0], np.cumsum(bad))) + good.sum() - np.concatenate(([0], np.cumsum(good)))
    edge = np.concatenate(([z[0] - 1], z, [z[-1] + 1]))
    best = np.flatnonzero(errors == errors.min())
    k = best[np.argmax(np.diff(edge)[best])]
    return float((edge[k] + edge[k + 1]) / 2)


def calibrate(m: Model, found: pa.Table) -> Model:
    """Place the score so that THRESHOLD is the best cut over all languages; then a cut for each language.

    found: (lang, z, bad, good), z in steps of 1 / GRID. A language with fewer than 20 rows of either class keeps the cut of all.
    """
    langs = np.array(found.column("lang").to_pylist(), object)
    z, bad, good = (found.column(c).to_numpy() for c in ("z", "bad", "good"))
    if not bad.sum() or not good.sum():
        return m

    def cut(which) -> float:
        steps, at = np.unique(z[which], return_inverse=True)
        return _cut(steps / GRID, np.bincount(at, weights=bad[which]), np.bincount(at, weights=good[which]))

    logit = np.log(THRESHOLD / (1 - THRESHOLD))
    m.scale = float(min(1.0, 8 / max(1e-6, np.abs(z).max() / GRID)))
    m.offset = float(logit - cut(np.ones(len(z), bool)) * m.scale)
    m.thresholds = {"": THRESHOLD}
    for lang in sorted(set(langs)):
        own = langs == lang
        if lang and bad[own].sum() >= 20 and good[own].sum() >= 20:
            m.thresholds[lang] = float(1 / (1 + np.exp(-(cut(own) * m.scale + m.offset))))
    return m


def _hashed(batches, calibrates: bool | None):
    """(parts of distinct words, numbers, rows, labels, languages) of a task's rows, HOLD_ROWS or HOLD_WORDS and one block at a time.
    calibrates: only rows that do, or don't; None: all."""
    held, size, words = [], 0, 0

    def out():
        before = np.cumsum([0, *(len(p) for p, *_ in held)])
        numbers = np.concatenate([n + b for (_, n, *_), b in zip(held, before[:-1], strict=True)])
        counts = np.concatenate([np.diff(r) for _, _, r, *_ in held])
        return np.concatenate([p for p, *_ in held]), numbers, np.concatenate(([0], np.cumsum(counts))), np.concatenate([y for *_, y, _ in held]), [x for *_, own in held for x in own]

    for batch in batches:
        if calibrates is not None:
            batch = batch.filter(pc.equal(batch.column("calibrates"), calibrates))
        y, langs = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("lang").to_pylist()
        for a, b, buf, offsets in blocks(batch.column("text")):
            parts, numbers, rows = word_hashes(buf, offsets)
            held.append((parts, numbers, rows, y[a:b], langs[a:b]))
            size, words = size + b - a, words + len(numbers)
            if size >= HOLD_ROWS or words >= HOLD_WORDS:
                yield out()
                held, size, words = [], 0, 0
    if held:
        yield out()


def _averaged(batches, n_rows: int):
    """The means of changes over n_rows rows of each pack, summed in the order of the tasks: of the table in single precision, as it has."""

    def row(pack, total):
        mean = total / n_rows
        return pa.RecordBatch.from_arrays([pa.array([pack], pa.int32()), pa.array([(mean.astype(np.float32) if pack < PACKS else mean).tobytes()], pa.binary())], names=["pack", "mean"])

    now, total = None, None
    for batch in batches:
        for pack, _, at, change, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if pack != now:
                if now is not None:
                    yield row(now, total)
                now, total = pack, np.zeros((BUCKETS // PACKS, DIM)) if pack < PACKS else 0.0
            if pack < PACKS:
                total[np.frombuffer(at, np.int32)] += np.frombuffer(change, np.float32).reshape(-1, DIM) * n
            else:
                total = total + np.frombuffer(change) * n
    if now is not None:
        yield row(now, total)


def _round(rows: DataFrame, adam: Adam, turn: int, total: int) -> None:
    """Each partition descends once over its training rows; the mean of what changes, by their numbers, is put in place."""
    shared = rows.sparkSession.sparkContext.broadcast(adam)

    def learn(batches):
        free()
        base = shared.value
        m = base.m
        own = Adam(dataclasses.replace(m, table=m.table.copy(), filters=[f.copy() for f in m.filters], shifts=[x.copy() for x in m.shifts], out=m.out.copy()), tuple(base.weights))
        own.set_flat(base.flat())
        task, n = TaskContext.get().partitionId(), 0
        rng = np.random.default_rng([turn, task])
        for parts, numbers, at, y, _ in _hashed(batches, False):
            own.epoch(parts, numbers, at, y, rng)
            n += len(y)
        if n:
            changed = np.flatnonzero((own.m.table != m.table).any(1))
            cuts = np.searchsorted(changed, np.arange(PACKS + 1) * (BUCKETS // PACKS))
            packs = [k for k in range(PACKS) if cuts[k] < cuts[k + 1]]
            spots = [changed[cuts[k] : cuts[k + 1]] for k in packs]
            at = [(x - k * (BUCKETS // PACKS)).astype(np.int32).tobytes() for k, x in zip(packs, spots, strict=True)]
            change = [(own.m.table[x] - m.table[x]).tobytes() for x in spots]
            columns = [pa.array([*packs, PACKS], pa.int32()), pa.array([task] * (len(packs) + 1), pa.int32()), pa.array([*at, b""], pa.binary()), pa.array([*change, own.flat().tobytes()], pa.binary()), pa.array([float(n)] * (len(packs) + 1))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PACKED.split(", ")])

    table = adam.m.table.reshape(PACKS, BUCKETS // PACKS, DIM)
    means = rows.mapInArrow(learn, PACKED).repartition("pack").sortWithinPartitions("pack", "task").mapInArrow(lambda batches: _averaged(batches, total), "pack int, mean binary")
    # PACKS + 1 rows at most. As Arrow the driver's JVM passes them on as they come; as rows it copies each some six times.
    for pack, mean in zip(*means.toArrow().columns, strict=True):
        if (pack := pack.as_py()) < PACKS:
            table[pack] += np.frombuffer(mean.as_buffer(), np.float32).reshape(-1, DIM)
        else:
            adam.set_flat(np.frombuffer(mean.as_buffer()))
    shared.destroy()  # unpersisted only, the driver would keep each round's table


def fit(docs: DataFrame, labels: DataFrame, *, held_out: str = "crc32(cast(doc_id as string)) % 3 = 1") -> Model:
    """Train on all labelled rows outside held_out; of these, a third (by another hash) calibrates, or all
    where that third has under LEAST rows of either class. held_out: an expression of doc_id."""
    spark = docs.sparkSession
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = labels.where(f"toxic is not null and doc_id is not null and not ({held_out})").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.where(f"not ({held_out})").select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(lang, F.lit("")).alias("lang"))
    folder = new_folder(spark, "labelled")
    # Labels grow with the documents: they are never sent whole to all executors, however few they are.
    texts.join(own.hint("merge"), "id").withColumn("calibrates", F.pmod(F.xxhash64("id"), F.lit(3)) == 2).sortWithinPartitions(F.xxhash64("id", F.lit(1)), "text").write.option("compression", "zstd").parquet(folder)
    rows = spark.read.schema("id long, text string, lang string, toxic int, calibrates boolean").parquet(folder)
    numbers = {(r.calibrates, r.toxic): r["count"] for r in rows.groupBy("calibrates", (F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    good, bad = numbers.get((False, 0), 0), numbers.get((False, 1), 0)
    rows = rows.select("text", "lang", (F.col("toxic") > 0).cast("int").alias("toxic"), "calibrates")

    def count(batches):
        free()
        seen = np.zeros((2, BUCKETS))
        for parts, words, at, y, _ in _hashed(batches, False):
            seen += _seen(parts, words, at, y)
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at].astype(np.int64)) for x in seen)], names=["bucket", "bad", "good"])

    found = rows.mapInArrow(count, "bucket long, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()  # BUCKETS rows at most
    seen = np.zeros((2, BUCKETS))
    seen[:, found.column("bucket").to_numpy()] = found.column("bad").to_numpy(), found.column("good").to_numpy()
    model = _from_counts(seen, bad, good, np.random.default_rng(7))
    if bad and good:
        adam = Adam(model, _weights(bad, good))
        for turn in range(EPOCHS):
            _round(rows, adam, turn, bad + good)
    third = None if min(numbers.get((True, k), 0) for k in (0, 1)) < LEAST else True  # too few to place a cut by
    shared = spark.sparkContext.broadcast(model)

    def place(batches):
        free()
        for parts, words, at, y, langs in _hashed(batches, third):
            z = np.round(np.clip(logits(shared.value, parts, words, at).astype(np.float64), -30, 30) * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(z), pa.array(y), pa.array(1 - y)], names=["lang", "z", "bad", "good"])

    found = rows.mapInArrow(place, "lang string, z long, bad long, good long").groupBy("lang", "z").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()  # 60 x GRID rows of a language at most
    model = calibrate(model, found)
    shared.destroy()
    drop_folder(spark, folder)
    return model


def score(docs: DataFrame, model: Model, *, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """All columns and score double (from the text alone), threshold double (of the language), toxic boolean."""
    spark = docs.sparkSession
    names = ["score", "threshold", "toxic"]
    base = docs.drop(*[c for c in docs.columns if c in names])
    shared = spark.sparkContext.broadcast(model)  # of fixed size: the table has BUCKETS rows
    by_lang = lang if lang in base.columns else None

    def run(batches):
        free()
        m = shared.value
        for batch in batches:
            parts = []
            for _, _, buf, offsets in blocks(batch.column(batch.schema.get_field_index(text))):
                parts.append(scores(m, *word_hashes(buf, offsets)))
            s = np.concatenate(parts) if parts else np.zeros(0)
            langs = batch.column(batch.schema.get_field_index(by_lang)).to_pylist() if by_lang else [""] * len(s)
            t = np.array([m.thresholds.get(x or "", m.thresholds[""]) for x in langs], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array(t), pa.array(s >= t)], names=[*batch.schema.names, *names])

    return base.mapInArrow(run, StructType(base.schema.fields + StructType.fromDDL("score double, threshold double, toxic boolean").fields))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7); threshold of the row's language, and over_threshold (score >= threshold)."""
    model = fit(docs, labels)
    found = score(docs.select("doc_id", "text", *[c for c in ("lang",) if c in docs.columns]), model)
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", predicted.alias("predicted"), "threshold", F.col("toxic").alias("over_threshold"))
