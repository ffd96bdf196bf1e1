"""N-gram Jaccard join by universe partition and pigeonhole.

A text's set holds the hashes of its distinct word n-grams. Sets of t per cent similarity differ in at most
(|a| + |b|) (100 - t) / (100 + t) elements. For each band of sizes the universe of hashes is cut into segments, some
matched exactly and some up to one deletion, how many of each is chosen by cost. Let D be the largest difference and k
the number of segments of the second kind: two similar sets agree up to one element on one of the k, or differ in D - 2k
of the exact ones at most. So of m exact segments they share all but D - 2k, and in any order of all signatures each
one's first D - 2k + 1 have a common one. The order puts rare signatures first: the rarest element of a segment counts,
by counts of hashed elements over all sets; then segments of many elements; empty ones come last. A signature is the
hash of a segment's subset, and for the second kind also of the subset less each of its elements.

Equal sets are one class from the start. Classes with a common signature are candidates: in groups of up to GROUP all
pairs of which parity bitmaps (one bit of each element's hash, summed modulo 2) don't rule out similarity, in larger
groups each class and one of them. Candidates form clusters, and in each cluster all pairs are verified on the whole
sets, in blocks of bounded bytes; only as many links leave a block as keep its components together. Components of these
links are the result: no link between different texts is lost, and no large group is ever listed as pairs.

Defined cases: null and empty texts have the empty set, which links with nothing; fewer words than n make one
shingle; repeated rows are copies of one another; a row with a null doc_id links with nothing; rows of one doc_id
with unlike texts count as one node; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadyframes.llm import counters
from steadyframes.llm.components import components, cut_lineage
from steadyframes.llm.textbytes import LOWER, WHITE, blocks, chained, free, mix, span_hashes, spans

BAND_RATIO = 1.25
#: Exact segments for each one that is emitted.
SPARE = 1.5
#: Counters of hashed elements, and places of the filter of needed documents.
COUNTER_BITS = 22
GROUP = 32
BLOCK_SETS, BLOCK_BYTES = 256, 16 << 20
SEEN_CLASSES = 200_000
SIGN_ROWS, COUNT_AT_ONCE, LOAD_BYTES = 1 << 19, 1 << 18, 8 << 20


def sets_of(texts: pa.Array, words: int):
    """For each text: its set as sorted distinct 64-bit hashes."""
    for _, _, buf, offsets in blocks(texts):
        low = LOWER[buf]
        starts, ends, rows = spans(~WHITE[low], offsets)
        h = span_hashes(low, starts, ends)
        n = max(0, len(h) - words + 1)
        grams = chained(h[k : k + n] for k in range(words))
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                yield chained([np.array([b - a], np.uint64), *(h[k : k + 1] for k in range(a, b))])
            else:
                yield np.zeros(0, np.uint64)


def bands(percent: int, largest: int) -> list[int]:
    """Lower ends of the size bands, and one past the last."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return out


def largest_difference(top: int, percent: int) -> int:
    """Between similar sets of which the smaller has at most `top` elements."""
    return (top + top * 100 // percent) * (100 - percent) // (100 + percent)


def allocate(difference: int, sets: int, mean: float, agree: float) -> tuple[int, int, int]:
    """(segments matched up to one deletion, exact ones that are emitted, all exact ones) of least cost: rows of the
    index and pairs met by chance.

    agree: the chance that two sets share the element at a given place. Sizes of segments are about Poisson.
    """
    best = None
    most = (difference + 1) // 2
    for k in sorted({0, 1, 2, most // 4, most // 2, most} & set(range(most + 1))):
        emit = max(0, difference + 1 - 2 * k)
        exact = emit and max(emit + 1, int(emit * SPARE))
        each = mean / (k + exact)
        rows = sets * (emit + k * (1 + each))
        meet = math.exp(-each * (1 - agree))
        cost = rows + float(sets) * sets / 2 * (emit * (meet - math.exp(-each)) + k * (1 + each) * meet)
        if best is None or cost < best[0]:
            best = (cost, k, emit, exact)
    return best[1:]


def signatures(s: np.ndarray, plan: list[tuple[int, int, int, int, int, int]], level: np.ndarray) -> np.ndarray:
    """Signatures of one set in its own band and, where a smaller partner may stand there, the bands below.

    plan: for each band its lower end, the size of the largest partner of its sets, segments up to one deletion, exact
    ones to emit, all exact ones, and its number. level: how common the elements of each counter are.
    """
    out = []
    common = level[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
    place = mix(s) >> np.uint64(20)
    # A sum of mixed hashes stands for a subset, so that taking an element away is a subtraction.
    mixed = mix(mix(s) + np.uint64(0x632BE59BD9B4E019))
    for low, top, loose, emit, exact, number in plan:
        if not low <= len(s) <= top:
            continue
        segments = loose + exact
        where = (place % np.uint64(segments)).astype(np.int64)
        total = np.zeros(segments, np.uint64)
        np.add.at(total, where, mixed)
        tag = mix((np.arange(segments, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F) + np.uint64(number))
        whole = mix(total + tag)
        rarest = np.full(segments, 255, np.uint8)
        np.minimum.at(rarest, where, common)
        order = np.lexsort((whole[loose:], -np.bincount(where, minlength=segments)[loose:], rarest[loose:]))
        out.append(whole[loose:][order[:emit]])
        if loose:
            part = where < loose
            out += [whole[:loose], mix(total[where[part]] - mixed[part] + tag[where[part]])]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def parities(s: np.ndarray) -> bytes:
    """How many elements fall on each place, modulo 2; as many places as the next power of two of twice the elements."""
    width = max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64
    count = np.bincount((mix(s + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits(count & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """At least so many elements are in one of two sets only, by their parities; the longer is folded onto the shorter."""
    x, y = sorted((a, b), key=len)
    p, q, width = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x)
    while q.bit_length() > width:
        q = (q & ((1 << width) - 1)) ^ (q >> width)
    return (p ^ q).bit_count()


def combined(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, class, other) of a task's rows. other is -1 for a member of its signature's group. Of a group of
    over GROUP classes one stays, as its own other, and the rest are links to it, dealt by their own number."""
    order = np.lexsort((ids, sig))
    sig, ids = sig[order], ids[order]
    fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1]))) if len(sig) else np.zeros(0, bool)
    sig, ids = sig[fresh], ids[fresh]
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(sig)))
    head = np.repeat(first, count)
    large = np.repeat(count > GROUP, count)
    out = np.where(large, mix(ids.view(np.uint64)), sig)
    out[first] = sig[first]
    return out, ids, np.where(large, ids[head], -1)


def met(sig: np.ndarray, ids: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (a, b, whether b stands for a large group) of whole groups; rows of a group stand together."""
    order = np.lexsort((ids, sig))
    sig, ids, large = sig[order], ids[order], large[order]
    start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
    star = np.add.reduceat(large.astype(np.int64), start) > 0 if len(start) else np.zeros(0, bool)
    fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1]))) if len(sig) else np.zeros(0, bool)
    first = np.cumsum(fresh)[start] - 1
    ids = ids[fresh]
    count = np.diff(np.append(first, len(ids)))
    star |= count > GROUP
    rest = np.repeat(star, count)
    a, b = [ids[rest]], [ids[np.repeat(first, count)][rest]]
    stars = len(a[0])
    for n in np.unique(count[~star]).tolist():
        members = ids[first[~star & (count == n)][:, None] + np.arange(n)]
        x, y = np.triu_indices(n, 1)
        a.append(members[:, y].reshape(-1))
        b.append(members[:, x].reshape(-1))
    a, b = np.concatenate(a), np.concatenate(b)
    sure = np.arange(len(a)) < stars
    ok = a != b
    return a[ok], b[ok], sure[ok]


def _cid(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _forest(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that keep together what is linked between the left and the right sets (all, where all are left)."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column, minlength=len(values)) > 1
    rank = np.cumsum(often) - 1
    keep = often[column]
    owner, column = owner[keep], rank[column[keep]]
    shared = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(256, (8 << 20) // max(1, n))
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (c, c + width))
        m = np.zeros((n, min(width, int(column[-1]) + 1 - c)), np.float32)
        m[owner[a:b], column[a:b] - c] = 1
        shared += m @ m.T
    inter = shared.astype(np.int64)
    linked = (100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)) & (sizes > 0)[:, None] & (sizes > 0)[None, :]
    if not left.all():
        linked &= left[:, None] ^ left[None, :]
    np.fill_diagonal(linked, False)
    out, seen = [], np.zeros(n, bool)
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        front = [root]
        while front:
            at = front.pop()
            new = np.flatnonzero(linked[at] & ~seen)
            seen[new] = True
            out += [(int(ids[at]), int(ids[x])) for x in new]
            front += new.tolist()
    return out


def link(docs: DataFrame, *, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row; rows link when 100 |a & b| >= percent |a | b|."""
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    described = "doc_id long, n_shingles long, k1 long, k2 long, low long, bits binary, chunk int, counts binary"

    def describe(batches):
        names = [c.split()[0] for c in described.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.int32(), pa.binary()]
        free()
        total = np.zeros(1 << COUNTER_BITS, np.int32)
        for batch in batches:
            out, held, size = [], [], 0
            for s in sets_of(batch.column(1), words):
                out.append((len(s), *_cid(s), int(s[0].astype(np.int64)) if len(s) else None, parities(s), None, None))
                held.append(s >> np.uint64(64 - COUNTER_BITS))
                size += len(s)
                if size > COUNT_AT_ONCE:
                    counters.add(total, np.concatenate(held))
                    held, size = [], 0
            if held:
                counters.add(total, np.concatenate(held))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)
        chunk, counts = zip(*counters.packed(total), strict=True) if total.any() else ((), ())
        empty = [pa.nulls(len(chunk), k) for k in [pa.int64(), *kinds[:-2]]]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(chunk, pa.int32()), pa.array(counts, pa.binary())], names=names)

    everything = cut_lineage(base.mapInArrow(describe, described))
    rows = everything.where("chunk is null").select("doc_id", "n_shingles", "k1", "k2", "low", "bits")
    # A counter above the mean load by 2, 4, 8 ... counts as common.
    load = counters.gathered(everything.where("chunk is not null"), COUNTER_BITS)
    level = spark.sparkContext.broadcast(np.log2(1 + load / (2 * max(load.mean(), 1e-9))).astype(np.uint8))  # a byte a counter
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("low").alias("low"), F.first("bits").alias("bits"))
    classes = cut_lineage(classes)

    # Counts over all classes: by band for the costs, and how often two sets agree on their smallest hash.
    largest = classes.agg(F.max("n")).first()[0] or 0
    lows = bands(percent, largest)
    band = F.lit(0)
    for i, low in enumerate(lows):
        band = F.when(F.col("n") >= low, i).otherwise(band)
    stats = {r.band: (r.sets, r.mean) for r in classes.groupBy(band.alias("band")).agg(F.count("*").alias("sets"), F.avg("n").alias("mean")).collect()}
    same = classes.groupBy("low").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.sum(F.col("c").cast("double") * (F.col("c") - 1)).alias("pairs")).first()
    agree = (same.pairs or 0) / max(1.0, float(same.n or 0) * (float(same.n or 0) - 1))
    plan = []
    for i, (low, end) in enumerate(zip(lows, lows[1:], strict=False)):
        sets, mean = stats.get(i, (0, 0.0))
        if sets:
            d = largest_difference(end - 1, percent)
            if d:
                plan.append((low, (end - 1) * 100 // percent, *allocate(d, sets, mean, agree), i))

    def sign(batches):
        seen: set[int] = set()
        held, ids, size = [], [], 0

        def rows_of():
            many = [len(x) for x in held]
            cols = combined(np.concatenate(held), np.repeat(np.array(ids, np.int64), many))
            held.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), pa.array(cols[1]), pa.array(cols[2])], names=["sig", "a", "b"])

        for batch in batches:
            for s in sets_of(batch.column(0), words):
                if not len(s) or (k := _cid(s)[0]) in seen:
                    continue
                if len(seen) < SEEN_CLASSES:
                    seen.add(k)
                held.append(signatures(s, plan, level.value))
                ids.append(k)
                size += len(held[-1])
                if size >= SIGN_ROWS:
                    yield rows_of()
                    size = 0
        if held:
            yield rows_of()

    def meet(batches):
        # The last group of a batch goes on in the next; once it is large, one class stands for it.
        left = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)]

        def pairs(sig, ids, large):
            a, b, sure = met(sig, ids, large)
            pair = np.unique(np.rec.fromarrays([np.maximum(a, b), np.minimum(a, b), sure], names="a,b,sure"))
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[c])) for c in ("a", "b", "sure")], names=["a", "b", "sure"])

        for batch in batches:
            sig, a, b = (np.array(c) for c in batch.columns)
            linked = (b != -1) & (b != a)
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)[linked]), pa.array(np.minimum(a, b)[linked]), pa.array(np.ones(int(linked.sum()), bool))], names=["a", "b", "sure"])
            new = [sig[~linked].view(np.uint64), a[~linked], (b != -1)[~linked]]
            now = [np.concatenate(x) for x in zip(left, new, strict=True)]
            if not len(now[0]):
                continue
            open_ = now[0] == now[0][-1]
            yield pairs(*[x[~open_] for x in now])
            left = [x[open_] for x in now]
            if len(left[0]) > 8 * GROUP:
                left = [left[0], left[1], np.ones(len(left[0]), bool)]
                yield pairs(*left)
                left = [x[left[1] == left[1].min()][:1] for x in left]
        if len(left[0]):
            yield pairs(*left)

    signed = base.where("doc_id is not null").select("text").mapInArrow(sign, "sig long, a long, b long").repartition("sig").sortWithinPartitions("sig")
    pairs = cut_lineage(signed.mapInArrow(meet, "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure")))

    def possible(batches):
        for batch in batches:
            a, b, *sides = [c.to_pylist() for c in batch.columns]
            ok = [(n + m) * (100 - percent) >= least_difference(x, y) * (100 + percent) for n, m, x, y in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = [classes.select(F.col("k1").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab"]
    both = pairs.where("not sure").join(side[0], "a").join(side[1], "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    clusters = components(both.mapInArrow(possible, "a long, b long").unionByName(pairs.where("sure").select("a", "b")))

    # Every class of a cluster, once, with its set from the text, is sent to each pair of blocks it takes part in.
    member = cut_lineage(clusters.join(classes, clusters.node == classes.k1).select("k1", "rep", "component", "n"))
    size = member.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    needed = spark.sparkContext.broadcast(counters.places(member.select("rep"), COUNTER_BITS))  # a bit a place; more documents than asked for may pass

    def load(batches):
        seen: set[int] = set()
        ids, keys, items, size = [], [], [], 0

        def rows_of():
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(items, pa.binary())], names=["rep", "k1", "items"])
            for x in (ids, keys, items):
                x.clear()
            return out

        for batch in batches:
            batch = batch.filter(counters.there(needed.value, np.array(batch.column(0))))
            for i, s in zip(batch.column(0).to_pylist(), sets_of(batch.column(1), words), strict=True):
                if len(s) and (k := _cid(s)[0]) not in seen:
                    ids.append(i)
                    keys.append(k)
                    items.append(s.tobytes())
                    size += 8 * len(s)
                    if len(seen) < SEEN_CLASSES:
                        seen.add(k)
                    if size > LOAD_BYTES:
                        yield rows_of()
                        size = 0
        yield rows_of()

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")
    sets = base.where("doc_id is not null").mapInArrow(load, "rep long, k1 long, items binary")
    sent = (
        sets.join(member.drop("n"), ["k1", "rep"]).join(size, "component").select("component", "blocks", block, F.col("rep").alias("doc_id"), "items").withColumn("other", other)
        .select("component", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "doc_id", "items")
        .repartition("component", "x", "y").sortWithinPartitions("component", "x", "y")
    )

    def verify(batches):
        key, ids, sets, left = None, [], [], []
        edges: list[tuple[int, int]] = []

        def flush():
            if len(sets) > 1:
                edges.extend(_forest(np.array(ids), sets, np.array(left), percent))

        def out():
            got = list(zip(*edges, strict=True)) if edges else [(), ()]
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], names=["a", "b"])

        for batch in batches:
            for c, x, y, block, i, items in zip(*[col.to_pylist() for col in batch.columns], strict=True):
                if key != (c, x, y):
                    flush()
                    key, ids, sets, left = (c, x, y), [], [], []
                ids.append(i)
                sets.append(np.frombuffer(items, np.uint64))
                left.append(block == x)
            yield out()
        flush()
        yield out()

    found = components(sent.mapInArrow(verify, "a long, b long"))
    reps = classes.join(found, classes.rep == found.node, "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(reps, ["k1", "k2"], "left").select("doc_id", "n_shingles", own.alias("component_id"))


def keep_first(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents less all but the first (by doc_id) of each component; of rows that repeat an id and text the one stays whose
    other columns, as JSON, come first."""
    found = cut_lineage(link(docs, words=words, percent=percent))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    once = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(F.struct(*docs.columns), order).alias("one")).select("one.*")
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
