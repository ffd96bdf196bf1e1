"""Token counts under a unigram vocabulary, by dynamic programming over a trie of the distinct pre-tokens.

Pre-tokens are pieces of the text that no split crosses (a body with the white space before it). The distinct ones
of a block go into a trie, built a level at a time: a node is a distinct prefix. Each node's forward score, the best
sum of log-probabilities over all ways to cut its prefix into vocabulary entries, is computed once, whatever the
number of pre-tokens that share the prefix; pre-tokens read their count and score at their terminal nodes. Among cuts
of equal score the one of fewest tokens counts.

An entry of rank r has the log-probability of Zipf's law, -ln(r + 2) less the norm, in units of 2^-20 as an integer, so
that sums are exact in any order. A byte that is no entry scores like one of twice the vocabulary's size.

Defined cases: null and empty texts have no tokens and the score 0; repeated rows count alike; extra columns are
ignored by the query, and kept by ``count_column`` unless named like an output.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from steadyframes.llm.bpe import read_ranks
from steadyframes.llm.textbytes import blocks, chunk_spans, distinct_spans, held, mix

UNIT = 1 << 20
#: Entries of every length count.
LONGEST = sys.maxsize
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def entry_scores(ranks: dict[bytes, int], longest: int = LONGEST) -> tuple[dict[bytes, int], int]:
    """Integer log-probabilities of entries of at most `longest` bytes, and that of an unknown byte."""
    norm = math.log(sum(1 / (r + 2) for r in ranks.values()))
    score = lambda r: -round((math.log(r + 2) + norm) * UNIT)
    return {w: score(r) for w, r in ranks.items() if len(w) <= longest}, score(2 * len(ranks))


class Vocabulary:
    """Entries by length, as sorted hashes of their bytes with scores."""

    def __init__(self, scores: dict[bytes, int], unknown: int):
        self.unknown = unknown
        self.by_length: list[tuple[int, np.ndarray, np.ndarray]] = []
        for n in sorted({len(w) for w in scores}):
            words = [w for w in scores if len(w) == n]
            h = np.zeros(len(words), np.uint64)
            for k in range(n):
                h = h * _STEP + np.array([w[k] for w in words], np.uint64) + np.uint64(1)
            h = mix(h)
            order = np.argsort(h)
            self.by_length.append((n, h[order], np.array([scores[w] for w in words], np.int64)[order]))
        self.powers = [np.uint64(pow(int(_STEP), n, 1 << 64)) for n in range(max(n for n, _, _ in self.by_length) + 1)]


def forward(v: Vocabulary, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of tokens of the best cut of each span, by levels of the spans' trie."""
    count = len(starts)
    score_out, tokens_out = np.zeros(count, np.int64), np.zeros(count, np.int64)
    length = ends - starts
    alive = np.flatnonzero(length > 0)
    order = alive[np.argsort(-length[alive], kind="stable")]
    node = np.zeros(len(order), np.int64)  # the node of each span that is still in the trie, at this level
    levels = max(n for n, _, _ in v.by_length)
    # Of the last levels: hash of the whole prefix, parent, score and tokens of each node.
    kept = [(np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    depth = 0
    while len(order):
        byte = buf[starts[order] + depth].astype(np.int64)
        key, node = np.unique(node * 256 + byte, return_inverse=True)
        parent, last = key >> 8, (key & 255).astype(np.uint64)
        depth += 1
        prefix = kept[-1][0][parent] * _STEP + last + np.uint64(1)
        best = kept[-1][2][parent] + v.unknown
        fewest = kept[-1][3][parent] + 1
        up, at = np.arange(len(key)), 0
        for n, hashes, scores in v.by_length:
            if n > depth:
                break
            while at < n:  # ancestors n levels up
                up = parent if at == 0 else kept[-at][1][up]
                at += 1
            old = kept[-n]
            h = mix(prefix - old[0][up] * v.powers[n])
            found = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[found] == h)
            if len(hit):
                s = old[2][up[hit]] + scores[found[hit]]
                t = old[3][up[hit]] + 1
                better = (s > best[hit]) | ((s == best[hit]) & (t < fewest[hit]))
                best[hit[better]], fewest[hit[better]] = s[better], t[better]
        kept.append((prefix, parent, best, fewest))
        if len(kept) > levels:
            kept.pop(0)
        done = int(np.searchsorted(-length[order], -depth, "left"))
        score_out[order[done:]], tokens_out[order[done:]] = best[node[done:]], fewest[node[done:]]
        order, node = order[:done], node[:done]
    return score_out, tokens_out


def vocabulary(path: str) -> Vocabulary:
    return held(("entries", path), lambda: Vocabulary(*entry_scores(read_ranks(path))))


def count_column(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """All columns and n_pretokens, n_tokens, score (sum of log-probabilities in units of 2^-20)."""
    names = ["n_pretokens", "n_tokens", "score"]
    base = docs.drop(*[c for c in docs.columns if c in names])
    place = base.columns.index(text)

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            out = []
            for _, _, buf, offsets in blocks(batch.column(place)):
                starts, ends, rows = chunk_spans(buf, offsets)
                first, inverse = distinct_spans(buf, starts, ends)
                score, tokens = forward(v, buf, starts[first], ends[first])
                sums = [np.concatenate(([0], np.cumsum(x[inverse]))) if len(inverse) else np.zeros(1, np.int64) for x in (tokens, score)]
                out.append((np.diff(rows), *[np.diff(s[rows]) for s in sums]))
            cols = [np.concatenate([o[k] for o in out]).astype(np.int64) if out else np.zeros(0, np.int64) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, cols)], names=[*batch.schema.names, *names])

    return base.mapInArrow(run, StructType(base.schema.fields + StructType.fromDDL("n_pretokens long, n_tokens long, score long").fields))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, score."""
    return count_column(docs.select("doc_id", F.col("text").cast("string").alias("text")), path).select("doc_id", "n_pretokens", "n_tokens", "score")
