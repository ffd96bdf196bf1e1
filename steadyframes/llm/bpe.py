"""Byte-level BPE encoding and decoding by a lazily determinised finite-state transducer.

The merges (ranks of byte strings) are compiled into a trie of tokens and a test of which tokens may stand side by
side in a result of the merges. The transducer reads bytes. Its state holds the places from which a token may still
begin or run on, each with the token before it; every byte says which token would end the result there, and tokens
are emitted once all places agree on them, by a bounded look back. States and moves are made when first met, and kept up to
MAX_STATES; then they are dropped and made anew, so memory stays bounded. All pre-tokens that a block has anew go
through the transducer side by side, a byte of each at a time; one longer than the look back goes alone.

Decoding joins tokens' bytes through an incremental UTF-8 state machine whose state is the pending bytes of an
unfinished character; malformed bytes become U+FFFD.

Defined cases: a null or empty text has no tokens; rows are encoded one by one, so repeated rows give repeated
results; extra columns are ignored by the query and kept by ``encode_column``.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType
from pyspark.sql.types import StructType

from steadyframes.llm.textbytes import WHITE, Pool, Strings, blocks, chunk_spans, distinct_spans, held, ragged

MAX_STATES = 150_000
MAX_PAIRS = 150_000
#: Pieces and pre-tokens that a worker remembers; the longer ones are encoded anew.
MAX_PIECES, MAX_WORDS, REMEMBERED = 200_000, 160_000, 64
DECODE_BYTES = 1 << 16
#: Of these, a table's encoder keeps a part and takes smaller blocks, as it runs in workers of a pipeline beside a JVM that is full.
SHARED, SHARED_BLOCK = 0.3, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank from a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """Ranks compiled for the transducer: a trie of tokens, each token's last merge, and adjacency."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.depth: list[int] = [0]
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.pairs: dict[int, bool] = {}
        self.most_pairs = MAX_PAIRS
        for word, rank in ranks.items():
            node = 0
            for b in word:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][b] = nxt
                    self.children.append({})
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token_at[node] = rank

    def split_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte, or one that no merge reaches."""
        if token not in self.halves:
            parts = self.merge(self.bytes_of[token], token)
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else (-1, -1)
        got = self.halves[token]
        return None if got[0] < 0 else got

    def merge(self, word: bytes, below: int | None = None) -> list[int]:
        """The plain merge loop: join the leftmost pair of lowest rank. below: only ranks under it."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best) and (below is None or r < below):
                    best, where = r, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens apart when they stand side by side.

        Undo the merges of both from the last: at each step look whether a merge across the border would have come
        before the merge that is undone.
        """
        key = left << 32 | right
        if (known := self.pairs.get(key)) is not None:
            return known
        if len(self.pairs) > self.most_pairs:
            self.pairs.clear()
        a, b, limit, apart = left, right, 1 << 62, True
        while True:
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < limit:
                apart = False
                break
            sa, sb = self.split_of(a), self.split_of(b)
            if sa is None and sb is None:
                break
            # The later merge is undone first; of equal ranks the right one, as the leftmost pair merges first.
            if sb is None or (sa is not None and a > b):
                limit, a = a, sa[1]
            else:
                limit, b = b + 1, sb[0]
        self.pairs[key] = apart
        return apart


class Moves:
    """(state, byte) -> (next state, token), in open addressing, so that many are looked up in one step."""

    def __init__(self, room: int = 1 << 16):
        self.keys, self.to, self.said, self.used = np.full(room, -1, np.int64), np.zeros(room, np.int32), np.zeros(room, np.int32), 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        return (h & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, -1 where it is not there."""
        at = self._place(keys)
        got = self.keys[at]
        left = np.flatnonzero(got != keys)
        while len(left):
            left = left[got[left] >= 0]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            got[left] = self.keys[at[left]]
            left = left[got[left] != keys[left]]
        at[got != keys] = -1
        return at

    def put(self, key: int, to: int, said: int) -> None:
        if 2 * self.used > len(self.keys):
            old = [x[self.keys >= 0].tolist() for x in (self.keys, self.to, self.said)]
            self.__init__(4 * len(self.keys))
            for k, t, x in zip(*old, strict=True):
                self.put(k, t, x)
        room = len(self.keys) - 1
        at = (key * 0x9E3779B97F4A7C15 % (1 << 64) >> 32) & room
        while self.keys[at] >= 0:
            at = (at + 1) & room
        self.keys[at], self.to[at], self.said[at] = key, to, said
        self.used += 1


class Transducer:
    """The lazily determinised transducer over one pre-token's bytes.

    A place is (trie node, last token before the place); a state is a tuple of places, oldest first. Each move also
    says which token ends the result up to here; the tokens themselves are read back along these ends, once all
    places agree on them or the pre-token is over.
    """

    LOOK_BACK = 1024

    def __init__(self, merges: Merges):
        self.m = merges
        self.most_states = MAX_STATES
        self.step = {node << 8 | b: child for node, kids in enumerate(merges.children) for b, child in kids.items()}
        self.inner = [bool(kids) for kids in merges.children]
        self.length = {r: len(w) for r, w in merges.bytes_of.items()}
        self.lengths = np.ones(max(self.length) + 1, np.int64)
        self.lengths[list(self.length)] = list(self.length.values())
        self._clear()

    def _clear(self) -> None:
        self.number: dict[tuple[tuple[int, int], ...], int] = {}
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.moves = Moves()
        self._state(((0, -1),))

    def _state(self, places: tuple[tuple[int, int], ...]) -> int:
        got = self.number.get(places)
        if got is None:
            got = self.number[places] = len(self.states)
            self.states.append(places)
        return got

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        live, found, step, m = [], -1, self.step, self.m
        for node, last in self.states[state]:
            child = step.get(node << 8 | byte)
            if child is not None:
                if self.inner[child]:
                    live.append((child, last))
                if found < 0:
                    token = m.token_at[child]
                    if token >= 0 and (last < 0 or m.may_follow(last, token)):
                        found = token
        if found >= 0:
            live.append((0, found))
        got = self._state(tuple(live)), found
        self.moves.put(state << 8 | byte, *got)
        return got

    def moved(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and the tokens that end there; moves that are not known yet are made."""
        keys = state << 8 | byte
        at = self.moves.find(keys)
        if (at < 0).any():
            for k in dict.fromkeys(keys[at < 0].tolist()):
                self._move(k >> 8, k & 255)
            at = self.moves.find(keys)
        return self.moves.to[at].astype(np.int64), self.moves.said[at]

    def encode_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of distinct pre-tokens, one pre-token's after another's, and how many each has."""
        alone = {}
        for i, w in enumerate(words):
            whole = self.m.ranks.get(w)
            if whole is not None or len(w) >= self.LOOK_BACK or not w:
                alone[i] = [whole] if whole is not None else self.encode(w)
        rest = [i for i in range(len(words)) if i not in alone]
        rest.sort(key=lambda i: -len(words[i]))
        size = np.array([len(words[i]) for i in rest], np.int64)
        begin = np.cumsum(size) - size
        buf = np.frombuffer(b"".join([words[i] for i in rest]), np.uint8).astype(np.int64)
        if len(self.states) > self.most_states:
            self._clear()
        ends, state = np.zeros(len(buf), np.int32), np.zeros(len(rest), np.int64)
        for depth in range(int(size[0]) if len(rest) else 0):
            live = int(np.searchsorted(-size, -depth, "left"))  # the longer ones stand first
            state = state[:live]
            if len(self.states) > 2 * self.most_states:
                own, state = np.unique(state, return_inverse=True)
                keep = [self.states[k] for k in own.tolist()]
                self._clear()
                state = np.array([self._state(k) for k in keep], np.int64)[state]
            state, ends[begin[:live] + depth] = self.moved(state, buf[begin[:live] + depth])
        count, steps = np.zeros(len(rest), np.int64), []
        at, live = size.copy(), np.arange(len(rest))
        while len(live):
            token = ends[begin[live] + at[live] - 1]
            if (token < 0).any():
                raise ValueError("the vocabulary lacks a byte of this text")
            steps.append((live, token))
            count[live] += 1
            at[live] -= self.lengths[token]
            live = live[at[live] > 0]
        counts = np.zeros(len(words), np.int64)
        counts[rest] = count
        for i, ids in alone.items():
            counts[i] = len(ids)
        first = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        last = first[rest] + count - 1
        for k, (live, token) in enumerate(steps):
            out[last[live] - k] = token
        for i, ids in alone.items():
            out[first[i] : first[i] + len(ids)] = ids
        return out, counts

    def _back(self, ends: list[int], at: int) -> list[int]:
        """Tokens of the result for the first `at` bytes."""
        out = []
        while at:
            token = ends[at - 1]
            if token < 0:
                raise ValueError("the vocabulary lacks a byte of this text")
            out.append(token)
            at -= self.length[token]
        out.reverse()
        return out

    def _agreed(self, ends: list[int], state: int) -> tuple[list[int], list[int]]:
        """Tokens that all places of a state agree on, and the ends of the bytes after them."""
        chains = [self._back(ends, len(ends) - self.m.depth[node]) for node, _ in self.states[state]]
        same = 0
        while same < min(map(len, chains)) and len({c[same] for c in chains}) == 1:
            same += 1
        return chains[0][:same], ends[sum(self.length[t] for t in chains[0][:same]) :]

    def encode(self, word: bytes) -> list[int]:
        """Tokens of one pre-token; one that is a token itself is that token."""
        whole = self.m.ranks.get(word)
        if whole is not None:
            return [whole]
        if len(self.states) > self.most_states:
            self._clear()
        state, out, moves, ends = 0, [], {}, []
        for b in word:
            got = moves.get(state << 8 | b)
            if got is None:
                if len(self.states) > 2 * self.most_states:  # in the midst of one very long pre-token
                    keep = self.states[state]
                    self._clear()
                    moves, state = {}, self._state(keep)
                at = int(self.moves.find(np.array([state << 8 | b]))[0])
                got = moves[state << 8 | b] = self._move(state, b) if at < 0 else (int(self.moves.to[at]), int(self.moves.said[at]))
            state, token = got
            ends.append(token)
            if len(ends) == self.LOOK_BACK:
                agreed, ends = self._agreed(ends, state)
                out += agreed
        return out + self._back(ends, len(ends))


class StreamDecoder:
    """Token ids in, text out: whole characters leave at once, an unfinished one waits in the machine's state."""

    def __init__(self, bytes_of: dict[int, bytes]):
        strings = [b""] * (max(bytes_of) + 1)
        for i, w in bytes_of.items():
            strings[i] = w
        self.bytes_of = Strings(strings)
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, *tokens: int) -> str:
        return self.machine.decode(self.bytes_of.gather(np.array(tokens, np.int64))[0].tobytes())

    def feed_bytes(self, data: bytes | memoryview) -> str:
        return self.machine.decode(data)

    def finish(self) -> str:
        rest = self.machine.decode(b"", True)
        self.machine.reset()
        return rest


class Coder:
    """Encodes and decodes texts; one per Python worker. pattern splits text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, share: float = 1.0):
        self.merges = Merges(ranks)
        self.transducer = Transducer(self.merges)
        self.merges.children = []  # the transducer has them as its steps
        self.pattern = regex.compile(pattern)
        self.decoder = StreamDecoder(self.merges.bytes_of)
        self.said = Strings([b"%d " % i for i in range(max(ranks.values()) + 1)])
        self.pieces, self.words = Pool(int(MAX_PIECES * share)), Pool(int(MAX_WORDS * share))
        self.transducer.most_states, self.merges.most_pairs = int(MAX_STATES * share), int(MAX_PAIRS * share)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after another, and how many each has."""
        number = self.words.numbers(words, self.transducer.encode_many)
        return self.words.gather(number), self.words.count[number]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of ``chunk_spans``, one after another, and how many each has.

        Pieces that begin with white space and end without are split together, as no match crosses from one to
        the next; the others by themselves.
        """
        joined = [i for i, p in enumerate(pieces) if p and WHITE[p[0]] and 32 < p[-1] < 127]
        taken = set(joined)
        order = joined + [i for i in range(len(pieces)) if i not in taken]
        find = self.pattern.findall
        words = [w.encode() for w in find(b"".join([pieces[i] for i in joined]).decode())]
        for i in order[len(joined) :]:
            words += [w.encode() for w in find(pieces[i].decode())]
        flat, counts = self._words(words)
        # Where each piece's words end, by bytes, and their ids with them.
        past = np.cumsum([len(w) for w in words])
        over = np.cumsum([len(pieces[i]) for i in order])
        last = np.searchsorted(past, over, "right") if len(words) else np.zeros(len(order), np.int64)
        ids = np.concatenate(([0], np.cumsum(counts)))[last]
        own = np.zeros(len(pieces), np.int64)
        own[order] = np.diff(ids, prepend=0)
        begin = np.zeros(len(pieces), np.int64)
        begin[order] = ids - own[order]
        return flat[ragged(begin, own)], own

    def block(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of rows, and each row's place in them."""
        starts, ends, rows = chunk_spans(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), rows
        first, inverse = distinct_spans(buf, starts, ends)
        data = buf.tobytes()
        short = ends[first] - starts[first] < REMEMBERED
        pieces = [data[a:b] for a, b in zip(starts[first[short]].tolist(), ends[first[short]].tolist(), strict=True)]
        number = self.pieces.numbers(pieces, self.encode_pieces)
        flat, counts = self.pieces.pool, np.zeros(len(first), np.int64)
        begin = np.zeros(len(first), np.int64)
        begin[short], counts[short] = self.pieces.begin[number], self.pieces.count[number]
        if not short.all():
            long = first[~short]
            more, own = self.encode_pieces([data[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
            flat = np.concatenate([flat[: self.pieces.used], more])
            begin[~short], counts[~short] = self.pieces.used + np.cumsum(own) - own, own
        each = counts[inverse]
        return flat[ragged(begin[inverse], each)], np.concatenate(([0], np.cumsum(each)))[rows]

    def ids(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.block(raw, np.array([0, len(raw)]))[0].tolist()

    def text(self, ids: list[int]) -> str:
        return self.decoder.feed(*ids) + self.decoder.finish()

    def said_digests(self, ids: np.ndarray, rows: np.ndarray) -> list[str]:
        """Of each row's ids as decimal numbers with one space between."""
        data, at = self.said.gather(ids)
        view, at = memoryview(data), at[rows].tolist()
        return [hashlib.sha256(view[a : b - 1] if b > a else b"").hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]

    def decoded_digests(self, ids: np.ndarray, rows: np.ndarray) -> list[str]:
        """Of the UTF-8 bytes of the text that each row's ids decode to."""
        data, at = self.decoder.bytes_of.gather(ids)
        view, at, out = memoryview(data), at[rows].tolist(), []
        for a, b in zip(at[:-1], at[1:], strict=True):
            sha = hashlib.sha256()
            for k in range(a, b, DECODE_BYTES):
                sha.update(self.decoder.feed_bytes(view[k : min(b, k + DECODE_BYTES)]).encode())
            sha.update(self.decoder.finish().encode())
            out.append(sha.hexdigest())
        return out


def coder(path: str, pattern: str, share: float = 1.0) -> Coder:
    """The worker's own coder, with that share of the usual memory; the rank file must be on every machine, as the tokenizer
    package is."""
    gc.set_threshold(200_000, 50, 1000)  # the tables are large and free of cycles
    return held(("bpe", path, pattern, share), lambda: Coder(read_ranks(path), pattern, share))


def _lists(arrays: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    """Rows of ids from blocks of (ids, places of rows)."""
    ids = np.concatenate([x for x, _ in arrays]) if arrays else np.zeros(0, np.uint32)
    counts = np.concatenate([np.diff(rows) for _, rows in arrays]) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids.astype(np.int32)))


def encode_column(df: DataFrame, text: str, path: str, pattern: str, out: str = "token_ids", back: str | None = None) -> DataFrame:
    """Add the token ids of a text column as array<int>; back: also the text decoded from them. Null: no tokens."""

    def run(texts):
        import pandas as pd

        c = coder(path, pattern)
        for series in texts:
            ids = [x for _, _, buf, offsets in blocks(pa.array(series, pa.large_string(), from_pandas=True)) for x in _lists([c.block(buf, offsets)]).to_pylist()]
            yield pd.DataFrame({"ids": ids, "back": [c.text(x) for x in ids]})

    udf = F.pandas_udf(run, "ids array<int>, back string", PandasUDFType.SCALAR_ITER)
    cols = df.withColumn("__bpe", udf(F.col(text)))
    cols = cols.withColumn(out, F.col("__bpe.ids"))
    return (cols.withColumn(back, F.col("__bpe.back")) if back else cols).drop("__bpe")


def encode_table(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, lang, source (those there are), n_tokens, token_ids array<int> and decoded_sha256 of each text."""
    kept = [F.col(c) for c in ("doc_id", "lang", "source") if c in docs.columns]

    def run(batches):
        c = coder(path, pattern, SHARED)
        for batch in batches:
            for a, b, buf, offsets in blocks(batch.column(batch.num_columns - 1), SHARED_BLOCK):
                ids, rows = c.block(buf, offsets)
                own = [x.slice(a, b - a) for x in batch.columns[:-1]]
                more = [pa.array(np.diff(rows).astype(np.int64)), _lists([(ids, rows)]), pa.array(c.decoded_digests(ids, rows), pa.string())]
                yield pa.RecordBatch.from_arrays([*own, *more], names=[*batch.schema.names[:-1], "n_tokens", "token_ids", "decoded_sha256"])

    base = docs.select(*kept, F.col("text").cast("string").alias("text"))
    extra = StructType.fromDDL("n_tokens long, token_ids array<int>, decoded_sha256 string")
    return base.mapInArrow(run, StructType(base.schema.fields[:-1] + extra.fields))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""

    def run(batches):
        c = coder(path, pattern)
        for batch in batches:
            for a, b, buf, offsets in blocks(batch.column(1)):
                ids, rows = c.block(buf, offsets)
                cols = [pa.array(np.diff(rows).astype(np.int64)), pa.array(c.said_digests(ids, rows), pa.string()), pa.array(c.decoded_digests(ids, rows), pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
