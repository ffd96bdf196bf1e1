"""Phrases whose words stand together more often than their parts' counts suggest, mined by language.

Words are counted by language on Spark; those that stand often enough get numbers, and others break pieces, as no phrase
that is frequent can hold them. A block of documents first goes out as its distinct words and a sequence of their places;
the words are joined with the numbers and come back to the sequence, so a word crosses the network once a block and not
once an occurrence. Pairs and triples of numbers are packed into binary keys of a fixed width, sorted by radix and
counted by run lengths in each task, cut at the borders of ranges and shuffled as packed runs; a range is sorted
and counted again in bounded steps. Scores are exact decimals. Joins of the frequent pairs with their words
and of the triples with their pairs are ordinary joins.

Defined cases: null texts are empty; a null language is `und`; repeated rows count again; ties are settled by the phrase's
bytes; no rows give no rows. Only the columns lang and text are read, whatever others are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from steadyframes.llm.components import drop_folder, new_folder
from steadyframes.llm.textbytes import LOWER, Strings, blocks, distinct_spans, free, spans, trim

BLOCK = 4 << 20
#: Half of the keys that a task sorts at a time, and those meant for one range.
RUN, RANGE = 1 << 19, 1 << 20
#: Shares of a language's phrases that are ranked before all of them are.
DEALS = 32
#: Keys that the borders of ranges are taken from, at most.
BORDERS = 100_000
SPLIT = np.zeros(256, bool)
SPLIT[[*b".,;:!?", *range(10, 14)]] = True
WORD = ~SPLIT
WORD[[9, 32]] = False
_BATCH = "block long, lang string, word string, no int, n long, seq binary"


def block_words(buf: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> tuple:
    """Of lower-cased texts: (language, bytes, count) of each distinct word of a language, and the sequence of their places.

    A word that begins a piece has its place as -1 - place. langs: a number for each row.
    """
    starts, ends, places = spans(WORD[buf], offsets)
    if not len(starts):
        return np.zeros(0, np.int64), (buf, starts, ends), np.zeros(0, np.int64), np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(places))
    piece = np.cumsum(SPLIT[buf], dtype=np.int32)[starts]
    begins = np.ones(len(starts), bool)
    begins[1:] = (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])
    first, inverse = distinct_spans(buf, starts, ends)
    both, at, number, counts = np.unique(langs[row] * len(first) + inverse, return_index=True, return_inverse=True, return_counts=True)
    seq = np.where(begins, -1 - number, number).astype(np.int32)
    return both // len(first), (buf, starts[at], ends[at]), counts, seq


def _split_batches(batches) -> Iterator[pa.RecordBatch]:
    """Each block as a row for each distinct word and one with the sequence."""
    free()
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        named = batch.column("lang").dictionary_encode()
        names, langs_all = named.dictionary, np.array(named.indices).astype(np.int64)
        for a, b, buf, offsets in blocks(batch.column("text"), BLOCK):
            lang, (data, starts, ends), counts, seq = block_words(LOWER[buf], offsets, langs_all[a:b])
            if len(seq):
                m = len(counts)
                words = pa.array([data[x:y].tobytes() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), names.take(pa.array(lang)), words, pa.array(np.arange(m, dtype=np.int32)), pa.array(counts.astype(np.int64)), pa.nulls(m, pa.binary())], names=[c.split()[0] for c in _BATCH.split(", ")])
                yield pa.RecordBatch.from_arrays([pa.array([number]), *[pa.nulls(1, t) for t in (pa.string(), pa.string(), pa.int32(), pa.int64())], pa.array([zlib.compress(seq.tobytes(), 1)], pa.binary())], names=[c.split()[0] for c in _BATCH.split(", ")])
                number += 1
            trim()


def packed(ids: np.ndarray, width: int) -> np.ndarray:
    """Rows of three numbers as big-endian keys of 3 x width bytes."""
    return np.ascontiguousarray(ids.astype(">u8")).view(np.uint8).reshape(len(ids), 3, 8)[:, :, 8 - width :].reshape(len(ids), 3 * width)


def unpacked(keys: np.ndarray, width: int) -> np.ndarray:
    full = np.zeros((len(keys), 3, 8), np.uint8)
    full[:, :, 8 - width :] = keys.reshape(-1, 3, width)
    return full.reshape(len(keys), 24).view(">u8").astype(np.int64)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of fixed-width keys, by stable passes over two bytes each from the last to the first (radix passes in numpy)."""
    order = None
    for b in range(keys.shape[1], 0, -2):
        digit = keys[:, b - 1].astype(np.uint16)
        if b > 1:
            digit |= keys[:, b - 2].astype(np.uint16) << np.uint16(8)
        if digit.min(initial=0) == digit.max(initial=0) == 0 and order is not None:
            continue
        step = np.argsort(digit if order is None else digit[order], kind="stable")
        order = step if order is None else order[step]
    return np.zeros(0, np.int64) if order is None else order


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts added up; without counts each key counts once."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = radix_order(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(1)
    at = np.flatnonzero(new)
    return keys[at], np.diff(at, append=len(keys)) if counts is None else np.add.reduceat(counts[order], at)


def grams(ids: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Packed keys of the pairs (a, b, 0) and triples of neighbours within pieces, up to RUN a time; 0 stands for no frequent
    word, negatives begin a piece."""
    step = max(1, RUN // 2)
    for a in range(0, len(ids), step):
        own = ids[a : a + step + 2]  # the two that follow end what begins here
        two = (own[:-1] != 0) & (own[1:] > 0)
        pair, triple = np.flatnonzero(two[:step]), np.flatnonzero((two[:-1] & two[1:])[:step])
        words = np.abs(own).astype(">u8").view(np.uint8).reshape(len(own), 8)[:, 8 - width :]
        keys = np.zeros((len(pair) + len(triple), 3, width), np.uint8)
        for k in range(2):
            keys[: len(pair), k] = words[pair + k]
        for k in range(3):
            keys[len(pair) :, k] = words[triple + k]
        if len(keys):
            yield keys.reshape(len(keys), 3 * width)


def _encoded(batches) -> Iterator[pa.RecordBatch]:
    """Sequences of places into sequences of numbers; a block's (place, number) rows come before it."""
    free()
    now, places, ids = None, [], []
    for batch in batches:
        block, seqs = np.array(batch.column("block")), batch.column("seq")
        cut = np.flatnonzero(block[1:] != block[:-1]) + 1
        is_seq = np.array(seqs.is_valid())
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(block)], strict=True):
            if a == b:
                continue
            if block[a] != now:
                now, places, ids = block[a], [], []
            words = np.flatnonzero(~is_seq[a:b]) + a
            if len(words):
                places.append(np.array(batch.column("no").take(pa.array(words))))
                ids.append(np.array(batch.column("id").take(pa.array(words))))
            for i in (np.flatnonzero(is_seq[a:b]) + a).tolist():
                seq = np.frombuffer(zlib.decompress(seqs[i].as_py()), np.int32)
                begins = seq < 0
                place = np.where(begins, -1 - seq, seq)
                number = np.zeros(int(place.max()) + 1, np.int64)
                if places:
                    number[np.concatenate(places)] = np.concatenate(ids)
                out = number[place]
                out = np.where(begins, -out, out)  # an infrequent word breaks a piece on both sides
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([zlib.compress(out.astype("<i8").tobytes(), 1)], pa.binary())], names=["block", "ids"])


def _ids(batch) -> Iterator[np.ndarray]:
    for x in batch.column("ids"):
        yield np.frombuffer(zlib.decompress(x.as_buffer()), "<i8")


def _run(part: int, keys: np.ndarray, counts: np.ndarray) -> tuple:
    """A range's sorted run; columns of bytes compress better than rows."""
    return part, len(keys), zlib.compress(np.ascontiguousarray(keys.T).tobytes(), 1), zlib.compress(counts.astype("<i8").tobytes(), 1)


def _runs(batches, borders: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Sorted and counted keys of a task, from 2 to 3 RUN at a time, cut at the borders."""
    free()

    def flush(held):
        raw = np.concatenate(held)
        held.clear()
        keys, counts = counted(raw)
        del raw
        as_text = np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").reshape(-1)
        cuts = [0, *np.searchsorted(as_text, borders).tolist(), len(keys)]
        rows = [_run(p, keys[a:b], counts[a:b]) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "n", "keys", "counts"])

    held, size = [], 0
    for batch in batches:
        for ids in _ids(batch):
            for keys in grams(ids, width):
                held.append(keys)
                size += len(keys)
                if size >= 2 * RUN:
                    yield flush(held)
                    size = 0
                    trim()
    if held:
        yield flush(held)


def _totals(batches, width: int, least: int) -> Iterator[pa.RecordBatch]:
    """Keys of whole ranges that count `least` or more. Runs of a range are merged whenever RUN keys have gathered."""

    def out(keys, counts):
        ids = unpacked(keys[counts >= least], width)
        return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(ids[:, j])) for j in range(3)], pa.array(counts[counts >= least])], names=["i1", "i2", "i3", "a"])

    free()
    now, keys, counts, size, merged = None, [], [], 0, 0
    for batch in batches:
        for part, n, k, c in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), batch.column("keys"), batch.column("counts"), strict=True):
            if part != now and keys:
                yield out(*counted(np.concatenate(keys), np.concatenate(counts)))
                keys, counts, size, merged = [], [], 0, 0
                trim()
            now = part
            keys.append(np.frombuffer(zlib.decompress(k.as_buffer()), np.uint8).reshape(3 * width, n).T)
            counts.append(np.frombuffer(zlib.decompress(c.as_buffer()), "<i8").astype(np.int64))
            size += n
            if size - merged >= RUN:
                one = counted(np.concatenate(keys), np.concatenate(counts))
                keys, counts = [one[0]], [one[1]]
                size = merged = len(one[0])
    if keys:
        yield out(*counted(np.concatenate(keys), np.concatenate(counts)))


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)), exactly, for counts below 10^16."""
    a, left, right = (f"cast({c} as decimal(19,0))" for c in (a, left, right))
    return F.expr(f"(1000000 * ({a} * {a})) div ({left} * {right})")


def word_counts(docs: DataFrame, folder: str) -> DataFrame:
    """The documents as blocks in a folder; (lang, word, n) by block."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    texts.mapInArrow(_split_batches, _BATCH).write.parquet(f"{folder}/blocks")
    return docs.sparkSession.read.schema(_BATCH).parquet(f"{folder}/blocks")


def dictionary(words: DataFrame, least: int, folder: str) -> DataFrame:
    """(id, lang, word, f) of words that stand `least` times or more in a language; ids are written once, from 1 on, and nearly dense."""
    spark = words.sparkSession
    counts = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    counts.select(F.monotonically_increasing_id().alias("place"), "lang", "word", "f").write.parquet(f"{folder}/words")
    written = spark.read.schema("place long, lang string, word string, f long").parquet(f"{folder}/words")
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    parts = (written.agg(F.max(part)).first()[0] or 0) + 1
    return written.select((row * parts + part + 1).alias("id"), "lang", "word", "f")


def phrase_counts(words: DataFrame, known: DataFrame, least: int, folder: str) -> DataFrame:
    """(i1, i2, i3, a) of the pairs (i3 = 0) and triples of known words that stand `least` times or more."""
    spark = words.sparkSession
    found = words.where("no is not null").select("block", "lang", "word", "no").join(known.select("lang", "word", "id"), ["lang", "word"])
    rows = found.select("block", "no", "id", F.lit(None).cast("binary").alias("seq"))
    rows = rows.unionByName(words.where("seq is not null").select("block", F.lit(None).cast("int").alias("no"), F.lit(None).cast("long").alias("id"), "seq"))
    rows = rows.repartition("block").sortWithinPartitions("block", F.col("seq").isNotNull())
    rows.mapInArrow(_encoded, "block long, ids binary").write.parquet(f"{folder}/ids")
    ids = spark.read.schema("block long, ids binary").parquet(f"{folder}/ids")
    top, total = known.agg(F.max("id"), F.sum("f")).first()
    if not top:
        return spark.createDataFrame([], "i1 long, i2 long, i3 long, a long")
    width = (int(top).bit_length() + 7) // 8
    parts = 2 * int(total) // RANGE + 1

    def some(batches):
        for batch in batches:
            for x in _ids(batch):
                for g in grams(x, width):
                    yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in g[:: max(1, len(g) // 64)]], pa.binary())], names=["key"])

    # Only where ranges end depends on this sample.
    sample = ids.mapInArrow(some, "key binary").orderBy(F.xxhash64("key")).limit(BORDERS).collect() if parts > 1 else []
    keys = np.sort(np.array([bytes(r.key) for r in sample], f"S{3 * width}"))
    borders = np.unique(keys[np.linspace(0, len(keys), parts, endpoint=False).astype(np.int64)[1:]]) if len(keys) else keys
    runs = ids.mapInArrow(lambda batches: _runs(batches, borders, width), "part int, n long, keys binary, counts binary")
    dealt = runs.repartition(len(borders) + 1, "part").sortWithinPartitions("part")
    dealt.mapInArrow(lambda batches: _totals(batches, width, least), "i1 long, i2 long, i3 long, a long").write.parquet(f"{folder}/phrases")
    return spark.read.schema("i1 long, i2 long, i3 long, a long").parquet(f"{folder}/phrases")


def collocations(docs: DataFrame, least: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` phrases of two and three words.

    A phrase that stands inside a longer one of at least `percent` per cent of its count is left out.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "phrases")
    words = word_counts(docs, folder)
    counts = words.where("no is not null").select("lang", "word", "n")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    known = dictionary(counts, least, folder)
    found = phrase_counts(words, known, least, folder)
    drop_folder(spark, f"{folder}/ids")

    def word(k: int) -> DataFrame:
        return known.select(F.col("id").alias(f"i{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"), *([F.col("lang")] if k == 1 else []))

    pairs = found.where("i3 = 0").drop("i3").join(word(1), "i1").join(word(2), "i2")
    head = pairs.select("i1", "i2", "lang", F.col("f1"), F.col("a").alias("a12"), F.concat_ws(" ", "w1", "w2").alias("p12"))
    tail = pairs.select(F.col("i1").alias("i2"), F.col("i2").alias("i3"), F.col("a").alias("a23"), F.col("w2").alias("w3"), F.col("f2").alias("f3"))
    triples = found.where("i3 > 0").join(head, ["i1", "i2"]).join(tail, ["i2", "i3"])
    inside = found.where("i3 > 0").select(F.explode(F.array(F.struct("i1", "i2"), F.struct(F.col("i2").alias("i1"), F.col("i3").alias("i2")))).alias("p"), "a")
    inside = inside.groupBy(F.col("p.i1").alias("i1"), F.col("p.i2").alias("i2")).agg(F.max("a").alias("longer"))
    two = pairs.join(inside, ["i1", "i2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("a", "f1", "f2").alias("score"))
    cut1, cut2 = F.struct(score("a", "f1", "a23").alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("a23").alias("r")), F.struct(score("a", "a12", "f3").alias("score"), F.lit(2).alias("k"), F.col("a12").alias("l"), F.col("f3").alias("r"))
    three = triples.select("lang", F.concat_ws(" ", "p12", "w3").alias("phrase"), "a", F.least(cut1, cut2).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = (F.desc("score"), F.desc("a"), "phrase")
    # The first of each share of a language first, so that no task ranks more than DEALS x top rows of one.
    share = F.pmod(F.xxhash64("phrase"), F.lit(DEALS))
    ranked = two.unionByName(three).withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order)))
    ranked = ranked.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
