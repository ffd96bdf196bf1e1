"""Token ids in files: frequency-ranked, byte-aligned variable-length coding with separate control bytes.

First all texts are encoded where they lie; their ids and the counts of ids go to a table. The counts over all
documents rank the ids (ties: by id): the table `ranks` has a row for each id that occurs. Then documents are dealt by
ranges of doc_id (and of a hash of the text and the row's number, so a repeated doc_id can be split) and coded. A
file is a Parquet part of block rows; a block holds whole documents, about BLOCK_TOKENS ids. A rank takes 1 to 4
bytes; two bits in the control bytes give the length, four ids to a control byte. The blocks go through Spark's
writer, so any store that Spark writes to will do.

Columns: part, block (order of files and blocks), before (ids of the part's earlier blocks), doc_ids (int64),
lengths (uint32: ids of each document), count, control, data; numbers are little-endian.

Defined cases: null and empty texts are the end id alone; repeated rows are coded as often as they stand; rows with
a null doc_id come first and keep it; equal doc_ids are ordered by a hash of the text; no rows give no blocks.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from steadyframes.llm.components import drop_folder, new_folder
from steadyframes.llm.textbytes import LOWER, WHITE, Pool, blocks, distinct_spans, held, ragged, spans

BLOCK_TOKENS = 1 << 19
#: Words that a worker remembers; longer ones are encoded anew.
MAX_WORDS, REMEMBERED = 400_000, 64
CODED = "doc_id long, h long, row long, n int, ids binary, counts binary"
SCHEMA = "part int, block int, before long, n_docs int, doc_ids binary, has_id binary, lengths binary, count long, control binary, data binary"

#: For each control byte, the lengths of its four values.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    size = (1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)).astype(np.uint8)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    control = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    raw = v.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again: lengths by table lookup, then the bytes in their places."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count].astype(np.int64)
    raw = np.zeros((count, 4), np.uint8)
    raw[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return raw.reshape(-1).view("<u4")


def ranking(counts: np.ndarray) -> np.ndarray:
    """The ids that occur, most frequent first."""
    order = np.argsort(-counts, kind="stable")
    return order[: int((counts > 0).sum())]


def code_block(ids: np.ndarray, rank: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of a block's ids; rank: each id's."""
    return pack(rank[ids])


def decode_block(ranked: np.ndarray, control: bytes, data: bytes, count: int) -> np.ndarray:
    return ranked[unpack(control, data, count)]


class WordEncoder:
    """A tokenizers file whose pre-tokens lie between white space; each distinct word is encoded once and kept.

    Words of a-z alone skip the file's normaliser and splitter where these leave such words as they are (that is tried
    once): the model alone gives their ids, and the mark of a word's last token parts them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.last[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        probe = "the quick brown fox abcdefghijklmnopqrstuvwxyz s t re ve m ll d zqxj"
        self.fast = bool(suffix) and self.bare.encode(probe, add_special_tokens=False).ids == self.tokenizer.encode(probe, add_special_tokens=False).ids
        self.known = Pool(MAX_WORDS)
        #: Bytes that hold any id.
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one word's after another's, and how many each has; many in one call."""
        at: list[int] = []
        flat, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        kind = np.array([2 if b"|" in w else 0 if self.fast and w.isalpha() and w.islower() else 1 for w in words])
        (bar,) = self.tokenizer.encode("|", add_special_tokens=False).ids
        plain, barred, rest = (np.flatnonzero(kind == which).tolist() for which in range(3))
        for a in range(0, len(plain), 5_000):
            part = plain[a : a + 5_000]
            ids = np.array(self.bare.encode_batch_fast([b" ".join([words[i] for i in part]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            at += part
            flat.append(ids)
            counts.append(np.diff(np.flatnonzero(self.last[ids]), prepend=-1))
        for a in range(0, len(barred), 5_000):
            part = barred[a : a + 5_000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" | ".join([words[i] for i in part]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            at += part
            flat.append(ids[ids != bar])
            counts.append(np.diff(np.append(np.flatnonzero(ids == bar), len(ids)), prepend=-1) - 1)
        for i in rest:
            at.append(i)
            flat.append(np.array(self.tokenizer.encode(words[i].decode(), add_special_tokens=False).ids, np.uint32))
            counts.append(np.array([len(flat[-1])]))
        order, count, ids = np.argsort(at), np.concatenate(counts), np.concatenate(flat)
        return ids[ragged((np.cumsum(count) - count)[order], count[order])], count[order]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and each row's place in them.

        White space of one byte always parts two words. So does a place between a small Latin letter and a
        punctuation mark that follows it. A-Z are lowered here as the file's own normaliser does, except in words with a
        bar, since its special tokens have bars.
        """
        word = ~WHITE[buf]
        low = LOWER[buf]
        starts, ends, rows = spans(word, offsets)
        bars = np.flatnonzero(buf == 124)
        if len(bars):
            own = np.unique(np.searchsorted(starts, bars, "right") - 1)
            kept = ragged(starts[own], ends[own] - starts[own])
            low[kept] = buf[kept]
        letter = (low >= 97) & (low < 123)
        cut = np.zeros(len(buf), bool)
        cut[1:] = letter[:-1] & ((buf[1:] == 44) | (buf[1:] == 46) | (buf[1:] == 59) | (buf[1:] == 58) | (buf[1:] == 33) | (buf[1:] == 63))
        cut[starts] = True
        cut &= word
        cut[offsets[:-1][offsets[:-1] < len(buf)]] &= word[offsets[:-1][offsets[:-1] < len(buf)]]
        begin = np.flatnonzero(cut)
        owner = np.searchsorted(starts, begin, "right") - 1
        end = np.append(begin[1:], 0)
        end = np.where(np.append(owner[1:] == owner[:-1], False), end, ends[owner]) if len(begin) else end[:0]
        rows = np.searchsorted(begin, offsets)
        first, inverse = distinct_spans(low, begin, end)
        data = low.tobytes()
        words = [data[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        short = end[first] - begin[first] < REMEMBERED
        number = self.known.numbers([w for w, k in zip(words, short.tolist(), strict=True) if k], self._learn)
        where, counts, flat = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), self.known.pool
        where[short], counts[short] = self.known.begin[number], self.known.count[number]
        if not short.all():
            more, own = self._learn([w for w, k in zip(words, short.tolist(), strict=True) if not k])
            where[~short], counts[~short] = self.known.used + np.cumsum(own) - own, own
            flat = np.concatenate([flat[: self.known.used], more])
        each = counts[inverse]
        return flat[ragged(where[inverse], each)], np.concatenate(([0], np.cumsum(each))).astype(np.int64)[rows]


def _encoder(path: str) -> WordEncoder:
    return held(("words", path), lambda: WordEncoder(path))


def _encode(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> np.ndarray:
    """Write each text's ids; gives how often each id occurs. A task's last row has its counts, at most one an id."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.select("doc_id", F.xxhash64("text"), F.monotonically_increasing_id(), "text")

    def run(batches):
        encoder, total = _encoder(tokenizer), np.zeros(0, np.int64)
        names = [c.split()[0] for c in CODED.split(", ")]

        def row(keys, n, ids, counts):
            return pa.RecordBatch.from_arrays([*keys, pa.array(n, pa.int32()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=names)

        for batch in batches:
            for a, b, buf, offsets in blocks(batch.column(3)):
                ids, at = encoder.encode(buf, offsets)
                n = np.diff(at)
                full = np.full(len(ids) + len(n), end_id, np.uint32)
                at = at + np.arange(len(at))
                mask = np.ones(len(full), bool)
                mask[at[1:] - 1] = False
                full[mask] = ids
                seen = np.bincount(full, minlength=len(total))
                seen[: len(total)] += total
                total, raw, at = seen, memoryview(full.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : encoder.width].tobytes()), (at * encoder.width).tolist()
                yield row([c.slice(a, b - a) for c in batch.columns[:3]], n + 1, [raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], [None] * (b - a))
        if total.any():
            yield row([pa.nulls(1, pa.int64())] * 3, [0], [None], [total.astype("<i8").tobytes()])

    base.mapInArrow(run, CODED).write.option("compression", "zstd").parquet(folder)

    def add(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                one = np.frombuffer(x, "<i8").copy()
                short, total = sorted((one, total), key=len)
                total[: len(short)] += short
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = docs.sparkSession.read.schema(CODED).parquet(folder).where("counts is not null").select("counts")
    found = rows.mapInArrow(add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row an id of the vocabulary
    counts = np.zeros(max(found.column("id").to_pylist(), default=-1) + 1, np.int64)
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return counts


def write(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 1) -> None:
    """Write every whole text's ids, each with end_id after them, in ascending doc_id order: {folder}/blocks, {folder}/ranks."""
    spark = docs.sparkSession
    counts = _encode(docs, f"{folder}/ids", tokenizer, end_id)
    ranked = ranking(counts)
    rank = np.zeros(len(counts), np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    table = pa.table({"rank": np.arange(len(ranked)), "id": ranked.astype(np.int64), "n": counts[ranked]})
    spark.createDataFrame(table).write.parquet(f"{folder}/ranks")
    shared = spark.sparkContext.broadcast(rank)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.read.schema(CODED).parquet(f"{folder}/ids").where("counts is null")
    ordered = rows.repartitionByRange(parts, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "n", "ids")

    def run(batches):
        part, number, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush():
            nonlocal number, before
            keys = pa.concat_arrays([k for k, _, _ in held])
            lengths = np.concatenate([n for _, n, _ in held]).astype("<u4")
            ids = np.concatenate([x for _, _, x in held])
            control, data = code_block(ids, shared.value)
            there = np.array(keys.is_valid()).astype(np.uint8)
            values = (part, number, before, len(keys), np.array(keys.fill_null(0)).astype("<i8").tobytes(), there.tobytes(), lengths.tobytes(), len(ids), control, data)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.int64(), *[pa.binary()] * 2)
            number, before = number + 1, before + len(ids)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            n = np.array(batch.column(1)).astype(np.int64)
            ends, a = np.cumsum(n), 0
            while a < len(n):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] - n[a] + BLOCK_TOKENS, "right")))
                raw = np.frombuffer(b"".join(batch.column(2).slice(a, b - a).to_pylist()), np.uint8)
                total = int(n[a:b].sum())
                full = np.zeros((total, 4), np.uint8)
                full[:, : len(raw) // total] = raw.reshape(total, -1)
                held.append((batch.column(0).slice(a, b - a), n[a:b], full.reshape(-1).view("<u4")))
                a = b
                if sum(len(x) for _, _, x in held) >= BLOCK_TOKENS:
                    yield flush()
        if held:
            yield flush()

    ordered.mapInArrow(run, SCHEMA).write.parquet(f"{folder}/blocks")
    drop_folder(spark, f"{folder}/ids")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The block rows, each with `start`: the ids of all blocks before it."""
    rows = spark.read.schema(SCHEMA).parquet(f"{folder}/blocks")
    # One row for each written part: as many as there were shuffle partitions.
    parts = rows.groupBy("part").agg(F.sum("count").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", earlier.alias("earlier"))
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("earlier") + F.col("before")).drop("earlier")


def documents(spark: SparkSession, folder: str, *, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, token_ids array<int> of each document in the files."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["token_ids"] * with_ids
    table = spark.read.schema("rank long, id long").parquet(f"{folder}/ranks").toArrow()  # a row an id of the vocabulary
    ranked = np.zeros(table.num_rows, np.uint32)
    ranked[table.column("rank").to_numpy()] = table.column("id").to_numpy()
    shared = spark.sparkContext.broadcast(ranked)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = decode_block(shared.value, row["control"], row["data"], row["count"])
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                keys = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["has_id"], np.uint8) == 0)
                cols = [keys, pa.array(ends - lengths + row["start"]), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * with_ids
    return read(spark, folder).mapInArrow(run, schema)


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from files written below the checkpoint folder and read back."""
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    write(docs, folder, tokenizer)
    return documents(spark, folder, with_ids=False)
