"""Benchmark decontamination by a generalised suffix automaton of the normalised items.

Texts are lower-cased in A-Z and cut into words of letters and digits. The automaton of all items' words is built
once per Python worker. Documents stream through it: at each word it holds the longest suffix that is part of an
item. Where that length reaches the window, the words are hit; an item shorter than the window must occur whole.
A filter drops stretches in which no window can lie (a word or a pair of neighbours that no item has), so the
automaton steps only through the rest; the filter can let through too much, never too little.

The items go to every worker. Their size is checked first: items are dealt by a hash to shards of about SHARD_WORDS
words, one shard at a time comes to the driver and is broadcast, and each is a pass of its own over the documents, so no
worker holds more than one shard's automaton.

Defined cases: null or empty texts have no words and no hits; items without words never match; items with the
same id count once; no items: nothing is hit; repeated documents give repeated rows; columns named like an output
are replaced.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from steadyframes.llm.components import drop_folder, new_folder
from steadyframes.llm.textbytes import ALNUM, LOWER, blocks, held, span_hashes, spans

WINDOW = 10
SHARD_WORDS = 400_000
MAX_COVERAGE = 0.5


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the items that hold each state's strings."""

    def __init__(self, items: list[list[int]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[list[int]] = []
        for words in items:
            last, path = 0, []
            for w in words:
                last = self._extend(last, w)
                path.append(last)
            ends.append(path)
        self.window = window
        #: For each state: the numbers of the items that hold its strings; kept where a window can end.
        self.items: list[set[int]] = [set() for _ in self.next]
        #: For each state: (length, item) of short items that are suffixes of its longest string.
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for k, words in enumerate(items):
            seen: set[int] = set()
            v = 0
            for w in words:
                v = self.next[v][w]
                u = v
                while u > 0 and u not in seen and self.len[u] >= window:
                    seen.add(u)
                    self.items[u].add(k)
                    u = self.link[u]
            if 0 < len(words) < window:
                self.whole[v].append((len(words), k))
        for v in sorted(range(1, len(self.next)), key=self.len.__getitem__):
            if up := self.whole[self.link[v]]:
                self.whole[v] = self.whole[v] + up

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def hits(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Ranges of hit words, and the items whose windows occur; a number under 0 is in no item."""
        state = length = 0
        ranges, found, checked = [], set(), set()
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            else:
                state = length = 0
            if length >= self.window:
                ranges.append((i - length + 1, i + 1))
                u = state
                while self.len[self.link[u]] >= self.window:
                    u = self.link[u]
                if u not in checked:
                    checked.add(u)
                    found |= self.items[u]
            for k, item in self.whole[state]:
                if k <= length:
                    ranges.append((i - k + 1, i + 1))
                    found.add(item)
        return ranges, found


def words_of(buf: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, and starts, ends and rows of the words."""
    low = LOWER[buf]
    return low, *spans(ALNUM[low], offsets)


class Matcher:
    """One shard of items, ready to scan blocks of texts."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = pa.array([t for _, t in items], pa.string())
        self.ids = [i for i, _ in items]
        self.numbers: dict[bytes, int] = {}
        lists: list[list[int]] = []
        hashes: dict[int, int] = {}
        for _, _, buf, offsets in blocks(texts):
            low, starts, ends, rows = words_of(buf, offsets)
            data = low.tobytes()
            found = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            for word, h in zip(found, span_hashes(low, starts, ends).tolist(), strict=True):
                hashes[h] = self.numbers.setdefault(word, len(self.numbers))
            lists += [[self.numbers[w] for w in found[a:b]] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
        self.automaton = SuffixAutomaton(lists, window)
        self.hashes = np.array(sorted(hashes), np.uint64)
        self.number_of = np.array([hashes[h] for h in sorted(hashes)], np.int64)
        size = max(1, len(self.numbers))
        self.size = size
        #: By window length: the pairs of neighbours in items that have such windows, and the single words.
        self.filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for words in lists:
            if words:
                k = min(window, len(words))
                pairs, single = self.filters.setdefault(k, (set(), set()))
                pairs.update(a * size + b for a, b in zip(words, words[1:], strict=False))
                single.update(words)
        self.filters = {k: (np.array(sorted(p), np.int64), np.array(sorted(s), np.int64)) for k, (p, s) in self.filters.items()}

    def _possible(self, numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Words that may lie in a window."""
        out = np.zeros(len(numbers), bool)
        first = np.zeros(len(numbers) + 1, bool)
        first[rows] = True
        first = first[:-1]
        for k, (pairs, single) in self.filters.items():
            if k == 1:
                out |= np.isin(numbers, single)
                continue
            at = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0) & ~first[1:])
            at = at[member(numbers[at] * self.size + numbers[at + 1], pairs)]
            if not len(at):
                continue
            breaks = np.flatnonzero(np.diff(at) != 1)
            lo, hi = at[np.append(0, breaks + 1)], at[np.append(breaks, len(at) - 1)] + 2
            long = hi - lo >= k
            for a, b in zip(lo[long].tolist(), hi[long].tolist(), strict=True):
                out[a:b] = True
        return out

    def scan(self, buf: np.ndarray, offsets: np.ndarray):
        """For each row: its number of words, ranges of hit words as numbers in the row, items; and the words' spans."""
        low, starts, ends, rows = words_of(buf, offsets)
        numbers = np.full(len(starts), -1, np.int64)
        if len(self.hashes) and len(starts):
            h = span_hashes(low, starts, ends)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            numbers = np.where(self.hashes[at] == h, self.number_of[at], -1)
        found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        possible = self._possible(numbers, rows) if len(numbers) else np.zeros(0, bool)
        a, b, _ = spans(possible, rows)
        data = low.tobytes() if len(a) else b""
        row_of = np.searchsorted(rows, a, "right") - 1
        for s, e, r in zip(a.tolist(), b.tolist(), row_of.tolist(), strict=True):
            # By the words themselves, so equal hashes of unequal words can't count.
            words = [self.numbers.get(data[x:y], -1) for x, y in zip(starts[s:e].tolist(), ends[s:e].tolist(), strict=True)]
            ranges, items = self.automaton.hits(words)
            if ranges:
                have = found.setdefault(r, ([], set()))
                have[0].extend((x + s - int(rows[r]), y + s - int(rows[r])) for x, y in ranges)
                have[1].update(items)
        return np.diff(rows), found, starts, ends, rows


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges merged where they meet."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _matcher(name: str, shared, window: int) -> Matcher:
    """The worker's automaton of one shard; name tells shards apart."""
    return held(("items", name), lambda: Matcher(shared.value, window))


def _pieces(items: DataFrame, item_id: str, text: str, shard_words: int):
    """The items in lists of about shard_words words, one list at a time on the driver."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.length("t") / 2 + 1)).first()[0] or 0
    many = int(size // shard_words) + 1
    for k in range(many):
        yield [(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(many)) == k).collect()], k == many - 1


HITS = "n_words long, n_hit long, hit_words array<struct<a:long,b:long>>, hit_items array<string>, hit_bytes array<struct<a:long,b:long>>"
_PAIR = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _hit_columns(found: list[tuple]) -> list[pa.Array]:
    five = list(zip(*found, strict=True)) if found else [()] * 5
    ranges = [[[{"a": a, "b": b} for a, b in one] for one in five[k]] for k in (2, 4)]
    return [pa.array(v, t) for v, t in zip((five[0], five[1], ranges[0], five[3], ranges[1]), (pa.int64(), pa.int64(), _PAIR, pa.list_(pa.string()), _PAIR), strict=True)]


def _passes(docs: DataFrame, items: DataFrame, window: int, item_id: str, text: str, shard_words: int, finish, schema: StructType) -> DataFrame:
    """finish(columns of docs, (n_words, n_hit, word ranges, item ids, byte ranges) of each row) gives the columns of schema.

    What earlier shards hit is carried from pass to pass in two columns after those of docs; the last pass finishes. Between
    passes the rows lie below the checkpoint folder, so a task has one Python worker, and that one shard's automaton.
    """
    folder = None
    spark, out, width, place = docs.sparkSession, docs, len(docs.columns), docs.columns.index(text)
    carried = StructType(docs.schema.fields + StructType.fromDDL("hit_words__ array<struct<a:long,b:long>>, hit_items__ array<string>").fields)
    for turn, (part, last) in enumerate(_pieces(items, item_id, text, shard_words)):
        shared = spark.sparkContext.broadcast(part)

        def run(batches, name=uuid.uuid4().hex, shared=shared, turn=turn, last=last):
            m = _matcher(name, shared, window)
            for batch in batches:
                before = list(zip(*[batch.column(width + k).to_pylist() for k in (0, 1)], strict=True)) if turn else None
                rows_out = []
                for first, _, buf, offsets in blocks(batch.column(place)):
                    counts, found, starts, ends, rows = m.scan(buf, offsets)
                    for r, n in enumerate(counts.tolist()):
                        ranges, hit = found.get(r, ((), ()))
                        ids = {m.ids[k] for k in hit}
                        if before and before[first + r][0]:
                            ranges = [*ranges, *((x["a"], x["b"]) for x in before[first + r][0])]
                            ids |= set(before[first + r][1])
                        ranges = union(ranges) if ranges else []
                        z, o = int(rows[r]), int(offsets[r])
                        rows_out.append((n, sum(b - a for a, b in ranges), ranges, sorted(ids), [(int(starts[z + a]) - o, int(ends[z + b - 1]) - o) for a, b in ranges]))
                own = batch.columns[:width]
                arrays = finish(own, rows_out) if last else [*own, *_hit_columns(rows_out)[2:4]]
                yield pa.RecordBatch.from_arrays(arrays, names=(schema if last else carried).names)

        out = out.mapInArrow(run, schema if last else carried)
        if not last:
            done, folder = folder, new_folder(spark, "hits")
            out.write.parquet(folder)
            out = spark.read.schema(carried).parquet(folder)
            shared.unpersist()
            if done:
                drop_folder(spark, done)
    return out


def scan(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, item_id: str = "item_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """All columns of docs and n_words, n_hit, hit_words (ranges of word numbers), hit_items, hit_bytes (ranges of UTF-8 bytes)."""
    extra = StructType.fromDDL(HITS)
    kept = docs.drop(*[c for c in docs.columns if c in extra.names])
    return _passes(kept, items, window, item_id, text, shard_words, lambda own, found: [*own, *_hit_columns(found)], StructType(kept.schema.fields + extra.fields))


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, item_id: str = "item_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents with hit spans cut out, each leaving one space; a document whose hit words are over max_coverage of all goes."""
    place = docs.columns.index(text)

    def finish(own, found):
        texts = own[place]
        if any(n_hit for _, n_hit, *_ in found):
            texts = texts.to_pylist()
            for i, (*_, ranges) in enumerate(found):
                if ranges:
                    data, at, parts = texts[i].encode(), 0, []
                    for a, b in ranges:
                        parts.append(data[at:a].rstrip(b" "))
                        at = b
                    texts[i] = b" ".join([*parts, data[at:].lstrip(b" ")]).decode()
            texts = pa.array(texts, own[place].type)
        keep = pa.array([n_hit <= max_coverage * n for n, n_hit, *_ in found], pa.bool_())
        return [(texts if i == place else c).filter(keep) for i, c in enumerate(own)]

    return _passes(docs, items, window, item_id, text, shard_words, finish, docs.schema)


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select("doc_id", "text"), items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
