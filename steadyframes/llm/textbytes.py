"""Vectorised work on the UTF-8 bytes of an Arrow string column.

All operators that read whole texts use these helpers inside Spark tasks: rows come in blocks of a few
megabytes, words are runs of bytes found by masks, and equal words are found by 64-bit hashes. Memory is
bounded by the block, or by one text where that is longer; Spark bounds the Arrow batch around it by bytes.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 2 << 20
#: Spans of more bytes are hashed one by one, by a library's hash.
LONG_SPAN = 256
_TWEAK, _LENGTHS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: For 0 to 8 bytes, a mask of that many low ones.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of the white space \x20 \x09-\x0D.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words that are made of letters and digits; all bytes from 0x80 count as letters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def blocks(texts: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
    trim()


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut between rows, and each row's place in that list (rows + 1)."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    inner = offsets[(offsets < n)]
    before[inner] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    after[inner[inner > 0] - 1] = False
    return starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a little-endian number; zeros follow the end."""
    padded = np.zeros(len(buf) + 16, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 8,), "<u8", padded, strides=(1,))


def chained(columns) -> np.ndarray:
    """A 64-bit hash of each row of columns of 64-bit numbers, which may be written over.

    Two states take every number in unlike ways and end in one, so no number can be chosen to cancel another's change, as it can
    in sums of hashes or where a single state is handed on.
    """
    one = two = None
    for x in columns:
        if one is None:
            one = mix(x + _TWEAK)
            two = one * _LENGTHS
        else:
            one = mix(one ^ x)
            two = (two ^ (two >> np.uint64(29))) * _LENGTHS + x
    return mix(one ^ (two ^ (two >> np.uint64(31))))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes give equal hashes wherever they stand.

    Up to eight bytes are mixed with their number; more go eight by eight through the two states of `chained`; long spans
    through BLAKE2. Unlike spans are equal by chance only, but 64 bits are no proof: who needs one compares bytes.
    """
    lengths = ends - starts
    at = _words_at(buf)
    out = mix((at[starts] & _LOW_BYTES[np.minimum(lengths, 8)]) + _TWEAK)
    left = np.flatnonzero((lengths > 8) & (lengths <= LONG_SPAN))
    one = out[left]
    two, done = one * _LENGTHS, 8
    while len(left):
        x = at[starts[left] + done] & _LOW_BYTES[np.minimum(ends[left] - starts[left] - done, 8)]
        one = mix(one ^ x)
        two = (two ^ (two >> np.uint64(29))) * _LENGTHS + x
        done += 8
        over = lengths[left] <= done
        if over.any():
            out[left[over]] = one[over] ^ (two[over] ^ (two[over] >> np.uint64(31)))
            more = ~over
            left, one, two = left[more], one[more], two[more]
    for i in np.flatnonzero(lengths > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return mix(out ^ lengths.astype(np.uint64) * _LENGTHS)


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each distinct span, ascending, and for each span the number of its distinct one.

    Spans of equal hashes are compared byte by byte with the first of them; where they differ, all spans are told
    apart by their bytes.
    """
    first, inverse = distinct(span_hashes(buf, starts, ends))
    lengths, like = ends - starts, starts[first][inverse]
    same = np.array_equal(lengths, lengths[first][inverse])
    if same:
        at = _words_at(buf)
        left, done = np.flatnonzero((like != starts) & (lengths <= LONG_SPAN)), 0
        while same and len(left):
            low = _LOW_BYTES[np.minimum(lengths[left] - done, 8)]
            same = not (((at[starts[left] + done] ^ at[like[left] + done]) & low) != 0).any()
            done += 8
            left = left[lengths[left] > done]
        for i in np.flatnonzero((like != starts) & (lengths > LONG_SPAN)).tolist():
            same = same and np.array_equal(buf[starts[i] : ends[i]], buf[like[i] : like[i] + lengths[i]])
    if same:
        return first, inverse
    number: dict[bytes, int] = {}
    data = buf.tobytes()
    inverse = np.array([number.setdefault(data[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return distinct(inverse.astype(np.uint64))


def chunk_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces that cover each row and begin where white space follows a character that isn't.

    No match of the tokenizers' split patterns crosses such a place, so a text's tokens are its pieces' tokens one
    after another, and a piece that repeats is encoded once. White space of several bytes never ends a piece's
    body here: a cut right after it is left out.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    white = WHITE[buf]
    cut = np.zeros(n, bool)
    cut[1:] = white[1:] & ~white[:-1] & ((buf[:-1] > 32) & (buf[:-1] != 127))
    at = np.flatnonzero(cut)
    at = at[buf[at - 1] >= 128]
    two, three = buf[at - 2], buf[np.maximum(at - 3, 0)]
    wide = ((two == 0xC2) & np.isin(buf[at - 1], (0x85, 0xA0))) | (np.isin(three, (0xE1, 0xE2, 0xE3)) & np.isin(two, (0x80, 0x81, 0x9A)))
    cut[at[wide]] = False
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut[filled] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(starts, offsets)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each distinct value, ascending, and for each value the number of its distinct one."""
    inverse, values = pd.factorize(hashes)
    first = np.empty(len(values), np.int64)
    first[inverse[::-1]] = np.arange(len(hashes) - 1, -1, -1)
    return first, inverse.astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each range, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)


_HELD: dict[tuple, object] = {}


def held(key: tuple, make):
    """A worker's one large table. Workers outlive stages, so asking for another key frees the table before it."""
    if key not in _HELD:
        free()
        _HELD[key] = make()
    return _HELD[key]


def free() -> None:
    """Drop the large table that an earlier stage has left in this worker, and the memory that Arrow keeps for reuse."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    trim()


_LIBC = ctypes.CDLL(None)


def trim() -> None:
    """Give freed memory back to the system, where the C library can; else a worker keeps the most that any of its stages took."""
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


class Pool:
    """Number sequences by byte string, as a worker's memory of what it has encoded.

    Beyond `most` entries the half that was not used for longest goes, so frequent ones are not learnt again.
    """

    def __init__(self, most: int, dtype: type = np.uint32):
        self.most, self.clock = most, 0
        self.number: dict[bytes, int] = {}
        self.begin, self.count, self.stamp = (np.zeros(1 << 10, np.int64) for _ in range(3))
        self.pool, self.used = np.zeros(1 << 12, dtype), 0

    def add(self, words: list[bytes], flat: np.ndarray, counts: np.ndarray) -> None:
        """New words; flat has their sequences one after another."""
        n = len(self.number)
        while n + len(words) > len(self.begin):
            self.begin, self.count, self.stamp = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count, self.stamp))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.begin[n : n + len(words)] = self.used + np.cumsum(counts) - counts
        self.count[n : n + len(words)] = counts
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.number.update(zip(words, range(n, n + len(words)), strict=True))

    def numbers(self, words: list[bytes], learn) -> np.ndarray:
        """The words' numbers, good until the next call; learn(missing) gives sequences, one after another, and counts."""
        self.clock += 1
        if len(self.number) > self.most:
            self._drop()
        out = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(out < 0)
        if len(at):
            missing, before = list(dict.fromkeys([words[i] for i in at.tolist()])), len(self.number)
            self.add(missing, *learn(missing))
            # The words are mostly distinct: then the new numbers follow the old ones.
            new = range(before, before + len(at)) if len(missing) == len(at) else [self.number[words[i]] for i in at.tolist()]
            out[at] = np.asarray(new, np.int64)
        self.stamp[out] = self.clock
        return out

    def _drop(self) -> None:
        n = len(self.number)
        order = np.argsort(-self.stamp[:n], kind="stable")[: self.most // 2]
        order.sort()
        kept = np.zeros(n, bool)
        kept[order] = True
        words = [w for w, k in zip(self.number, kept.tolist(), strict=True) if k]
        flat, counts, stamps = self.gather(order), self.count[order], self.stamp[order]  # copies
        self.number, self.used = {}, 0
        self.add(words, flat, counts)
        self.stamp[: len(words)] = stamps

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The sequences one after another."""
        return self.pool[ragged(self.begin[numbers], self.count[numbers])]


class Strings:
    """Byte strings by number, for gathering many at once."""

    def __init__(self, strings: list[bytes]):
        self.count = np.array([len(x) for x in strings], np.int64)
        self.begin = np.cumsum(self.count) - self.count
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings one after another, and where each begins, with the end of the last."""
        counts = self.count[numbers]
        return self.data[ragged(self.begin[numbers], counts)], np.concatenate(([0], np.cumsum(counts)))
