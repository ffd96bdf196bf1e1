"""Operators on motion tables: (video_id, frame_idx, width, height, A, B, TX, TY, ok), no pixels.

A video may be long, so nothing gathers or orders a whole video in one task: rows are numbered on two levels, windows are taken in
chunks with a halo, and the decay scan runs along pieces of a segment at once.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from steadyframes.functions import transforms as T
from steadyframes.functions.params import StabParams
from steadyframes.operators.sequence import PART_ROWS, begins, number_rows, part_of, size_runs, whole_groups, with_halo
from steadyframes.sources.folders import new_folder

TRANSFORM = ("A", "B", "TX", "TY")


def video_window():
    """Rows of a video in order."""
    return Window.partitionBy("video_id").orderBy("frame_idx")


def as_struct(prefix: str = "") -> Column:
    """The four columns as a transform."""
    return T.transform(*[F.col(prefix + c) for c in TRANSFORM])


def size_segments(frames: DataFrame, part: int = PART_ROWS) -> DataFrame:
    """Number the runs of equal frame size within a video; `n` counts from 0 in each."""
    return size_runs(frames, part).drop("prev_idx")


def pair_frames(frames: DataFrame, part: int = PART_ROWS) -> DataFrame:
    """For each frame but a segment's first: keyframe, template, and whether the result is to be inverted."""
    odd = F.col("n") % 2 == 1
    return size_runs(frames, part).where("n >= 1").withColumns({
        "key_idx": F.when(odd, F.col("frame_idx")).otherwise(F.col("prev_idx")),
        "tmpl_idx": F.when(odd, F.col("prev_idx")).otherwise(F.col("frame_idx")),
        "invert": ~odd,
    })


def motion_windows(motion: DataFrame, lag: int, memory: int, part: int = PART_ROWS) -> DataFrame:
    """The transforms of frames i - lag to i + memory around each frame i whose last one is there; `middle` is i's place."""
    rows = with_halo(number_rows(motion, part=part), lag, memory, part)
    w = Window.partitionBy("video_id", "chunk").orderBy("k").rowsBetween(-lag, memory)
    out = rows.select("video_id", "frame_idx", F.collect_list(as_struct()).over(w).alias("window"), F.least("k", F.lit(lag)).cast("int").alias("middle"), (F.col("own") & (F.col("k") + memory < F.col("rows_"))).alias("final"))
    return out.where("final").drop("final")


#: Windows that are smoothed together: as many as fit a core's cache.
WINDOWS_TOGETHER = 2048


def tv_smooth(x: np.ndarray, lam: float, iterations: int) -> np.ndarray:
    """Total-variation smoothing of rows of numbers: relax towards the data, then draw neighbours together in order.

    x: rows x places x numbers. The sweep over places carries each place's result into the next, so it is the rows
    that are handled together. Rows that an iteration leaves as they are stay so, and the rest of it is left out.
    """
    out = np.empty_like(x)
    for at in range(0, len(x), WINDOWS_TOGETHER):
        some = x[at : at + WINDOWS_TOGETHER]
        # Both steps leave numbers between the least and the largest of their window, so where those are within lam no gap is wide.
        calm = ((some.max(1) - some.min(1)) <= lam).all(0)
        for near, sweep in ((True, _sweep_calm), (False, _sweep)):
            cols = np.flatnonzero(calm == near)
            if len(cols):
                out[at : at + WINDOWS_TOGETHER, :, cols] = _relax(some[:, :, cols].swapaxes(0, 1), lam, iterations, sweep).swapaxes(0, 1)
    return out


def _relax(data: np.ndarray, lam: float, iterations: int, sweep) -> np.ndarray:
    now = data.copy("C")
    half, before = 0.5 * now, np.empty_like(now)
    for _ in range(iterations):
        np.copyto(before, now)
        now *= 0.5
        now += half
        sweep(now, lam)
        if np.array_equal(before, now):
            break
    return now


def _sweep_calm(now: np.ndarray, lam: float) -> None:
    """_sweep where no gap is wider than lam."""
    for left, right in zip(now, now[1:], strict=False):
        left += right
        left *= 0.5
        right[...] = left


def _sweep(now: np.ndarray, lam: float) -> None:
    """Neighbours nearer than lam meet in the middle, others come nearer. Of the two results one is taken by bits, as masked copies
    cost several times a step of arithmetic."""
    gap, less, far, other = (np.empty_like(now[0]) for _ in range(4))
    wide, bits = np.empty(gap.shape, np.int64), now.view(np.int64)
    middle, taken = gap.view(np.int64), other.view(np.int64)
    for i, (left, right) in enumerate(zip(now, now[1:], strict=False)):
        np.subtract(right, left, out=gap)
        np.abs(gap, out=far)
        np.subtract(lam, far, out=less)
        np.right_shift(less.view(np.int64), 63, out=wide)  # -1 where the gap is wider than lam, else 0
        np.maximum(far, lam, out=far)  # the divisor; where it isn't the gap's size, the move isn't used
        less /= far
        less *= 0.5
        less *= gap
        np.add(left, right, out=gap)
        gap *= 0.5
        for side, moved in ((i, np.subtract), (i + 1, np.add)):
            moved(now[side], less, out=other)
            np.bitwise_xor(middle, taken, out=taken)
            np.bitwise_and(taken, wide, out=taken)
            np.bitwise_xor(middle, taken, out=bits[side])


def smooth_windows(windows: DataFrame, lam: float, iterations: int = 100) -> DataFrame:
    """Each window smoothed; the frame's own place in it is the result."""

    def run(batches):
        for batch in batches:
            cols = {n: batch.column(n) for n in ("video_id", "frame_idx", "window", "middle")}
            flat, sizes = cols["window"].flatten(), np.array(cols["window"].value_lengths()).astype(np.int64)
            values = np.stack([np.array(flat.field(c)) for c in TRANSFORM], 1) if len(flat) else np.zeros((0, 4))
            begin, middle, out = np.cumsum(sizes) - sizes, np.array(cols["middle"]), np.zeros((len(sizes), 4))
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                out[at] = tv_smooth(values[begin[at][:, None] + np.arange(n)], lam, iterations)[np.arange(len(at)), middle[at]]
            yield pa.RecordBatch.from_arrays([cols["video_id"], cols["frame_idx"].cast(pa.int64()), *map(pa.array, out.T.copy())], names=["video_id", "frame_idx", *TRANSFORM])

    kind = windows.schema["video_id"].dataType.simpleString()
    return windows.mapInArrow(run, f"video_id {kind}, frame_idx long, A double, B double, TX double, TY double")


def smooth_runs(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray, middle: np.ndarray, lam: float, iterations: int) -> np.ndarray:
    """Of runs of rows, all in one flat array, the smoothed row in the middle of each; windows of one size go together."""
    out = np.zeros((len(begin), values.shape[1]))
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        for a in range(0, len(at), WINDOWS_TOGETHER):
            some = at[a : a + WINDOWS_TOGETHER]
            out[some] = tv_smooth(values[begin[some][:, None] + np.arange(n)], lam, iterations)[np.arange(len(some)), middle[some]]
    return out


def _by_chunk(rows: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ("video_id", "chunk")) -> DataFrame:
    """Rows of with_halo, a task's chunks one after another in order. Smoothing costs far more than its bytes tell, so tasks
    are as many as shuffle partitions."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*keys, "k", "rows_", "own", *columns).repartition(tasks, *keys).sortWithinPartitions(*keys, "k")


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def smooth_motion(motion: DataFrame, lag: int, memory: int, lam: float, iterations: int = 100, part: int = PART_ROWS) -> DataFrame:
    """W3 over W2's windows without building them: smoothed motion of all frames that have `memory` frames after them."""
    rows = _by_chunk(with_halo(number_rows(motion, part=part), lag, memory, part), ("frame_idx", *TRANSFORM))

    def run(batches):
        for table, _ in whole_groups(batches, ("video_id", "chunk")):
            k, count, own = _columns(table, "k", "rows_", "own")
            at = np.flatnonzero(own & (k + memory < count))
            before = np.minimum(k[at], lag)
            values = np.stack(_columns(table, *TRANSFORM), 1)
            out = smooth_runs(values, at - before, before + memory + 1, before, lam, iterations)
            taken = table.select(["video_id", "frame_idx"]).take(pa.array(at)).combine_chunks()
            for batch in taken.to_batches():
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), *map(pa.array, np.ascontiguousarray(out.T))], names=["video_id", "frame_idx", *TRANSFORM])

    kind = motion.schema["video_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"video_id {kind}, frame_idx long, A double, B double, TX double, TY double")


def attach_smoothed(motion: DataFrame, smoothed: DataFrame, lag: int, memory: int, align: bool = False, part: int = PART_ROWS) -> DataFrame:
    """Frame k with the smoothed motion of frame k + lag - memory (of k itself if align), identity where that is before the start.

    Only frames that come out: those with `lag` frames after them. Row order in the video counts, not frame_idx.
    """
    m = number_rows(motion, part=part).where(F.col("k") + lag < F.col("rows_"))
    s = number_rows(smoothed, part=part).select("video_id", F.col("k").alias("j"), as_struct().alias("smoothed"))
    shift = 0 if align else lag - memory
    joined = m.withColumn("j", F.col("k") + shift).join(s, ["video_id", "j"], "left")
    return joined.withColumn("smoothed", F.coalesce("smoothed", T.t_identity())).drop("j", "rows_")


def reset_segments(motion: DataFrame, lag: int, part: int = PART_ROWS) -> DataFrame:
    """Number of failures among the arrivals up to frame k + lag (or the last there is), as `reset`."""
    rows = with_halo(number_rows(motion, {"failed": (~F.col("ok")).cast("long")}, part), 0, lag, part)
    later = Window.partitionBy("video_id", "chunk").orderBy("k").rowsBetween(0, lag)
    return rows.withColumn("reset", F.max("failed").over(later)).where("own").drop("failed", "k", "rows_", "chunk", "own")


def _ahead(p: StabParams) -> int:
    """How far after a frame the row stands that its smoothed motion is found for."""
    return 0 if p.align_smoothed else p.lag - p.memory


def with_smoothed(motion: DataFrame, p: StabParams, part: int = PART_ROWS) -> DataFrame:
    """W2 to W4 and J6 in one pass over chunks: each frame that comes out, with `reset` and `smoothed` (identity if not p.smooth)."""
    return smoothed_by_settings(motion, [p], part).drop("setting")


def smoothed_by_settings(motion: DataFrame, settings: list[StabParams], part: int = PART_ROWS) -> DataFrame:
    """with_smoothed for several parameters at once, each in tasks of its own; `setting` is the place in the list."""
    before = max(max(0, p.lag - _ahead(p)) if p.smooth else 0 for p in settings)
    after = max(max(p.lag, p.memory + _ahead(p)) for p in settings)
    rows = with_halo(number_rows(motion, {"failed": (~F.col("ok")).cast("long")}, part), before, after, part)
    rows = rows.withColumn("setting", F.explode(F.sequence(F.lit(0), F.lit(len(settings) - 1))))
    keys, kept = ("setting", "video_id", "chunk"), ["setting", "video_id", "frame_idx", "width", "height", *TRANSFORM]
    rows = _by_chunk(rows, ("frame_idx", "width", "height", "failed", *TRANSFORM), keys)

    def one(table: pa.Table, p: StabParams):
        k, count, own, failed = _columns(table, "k", "rows_", "own", "failed")
        at = np.flatnonzero(own & (k + p.lag < count))
        smoothed, shift = np.zeros((len(at), 4)), _ahead(p)
        j = k[at] + shift
        there = np.flatnonzero((j >= 0) & (j + p.memory < count[at]))
        if p.smooth and len(there):
            middle = np.minimum(j[there], p.lag)
            values = np.stack(_columns(table, *TRANSFORM), 1)
            smoothed[there] = smooth_runs(values, at[there] + shift - middle, middle + p.memory + 1, middle, p.lam, p.iterations)
        taken = table.select(kept).take(pa.array(at)).combine_chunks()
        for batch in taken.to_batches():
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed[at + p.lag]), *map(pa.array, np.ascontiguousarray(smoothed.T))], names=[*kept, "reset", *[f"s{c}" for c in TRANSFORM]])

    def run(batches):
        for table, _ in whole_groups(batches, keys):
            setting = table.column("setting").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(setting)) + 1).tolist(), len(setting)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield from one(table.slice(a, b - a), settings[setting[a]])

    kinds = ", ".join(f"{c} {'int' if c == 'setting' else motion.schema[c].dataType.simpleString()}" for c in kept)
    found = rows.mapInArrow(run, f"{kinds}, reset long, sA double, sB double, sTX double, sTY double")
    return found.withColumn("smoothed", as_struct("s")).drop(*[f"s{c}" for c in TRANSFORM])


def residual_motion(attached: DataFrame, smooth: bool = True) -> DataFrame:
    """What of each motion is jitter: the motion followed by the inverse of the smoothed one, or itself."""
    return attached.withColumn("jitter", T.t_compose(as_struct(), T.t_inverse("smoothed")) if smooth else as_struct())


#: From so many segments on, a step of all of them together costs less than one of each.
TOGETHER = 8
LIMITS = ("min_disp", "max_disp", "min_decay", "max_decay")


def decay_scan(a: np.ndarray, w: np.ndarray, h: np.ndarray, p: StabParams | np.ndarray, state: tuple = (0.0, 0.0, 0.0, 0.0)) -> np.ndarray:
    """Accumulate rows of one segment in order, each sum shrunk by its displacement's decay. p: the same for all, or LIMITS of each row."""
    out = np.empty_like(a)
    limits = np.tile([float(getattr(p, c)) for c in LIMITS], (len(a), 1)) if isinstance(p, StabParams) else p
    A, B, X, Y = state
    rows = zip(a.tolist(), (0.5 * w).tolist(), (0.5 * h).tolist(), limits.tolist(), strict=True)
    for i, ((a2, b2, x2, y2), cx, cy, (near, far, little, much)) in enumerate(rows):
        p1, p2 = 1.0 + A, 1.0 + a2
        A, B, X, Y = p2 * p1 - b2 * B - 1.0, p2 * B + b2 * p1, p2 * X - b2 * Y + x2, b2 * X + p2 * Y + y2
        most = 0.0
        for px, py in ((-cx, -cy), (cx, -cy), (-cx, cy), (cx, cy)):
            dx, dy = A * px - B * py + X, B * px + A * py + Y
            most = max(most, math.sqrt(dx * dx + dy * dy))
        if most > far:
            d = much
        elif most > near:
            f = (most - near) / (far - near)
            d = little * (1.0 - f) + much * f
        else:
            d = little
        A, B, X, Y = A * d, B * d, X * d, Y * d
        out[i] = A, B, X, Y
    return out


def scan_segments(a: np.ndarray, w: np.ndarray, h: np.ndarray, limits: np.ndarray, begin: np.ndarray, state: np.ndarray) -> np.ndarray:
    """decay_scan of many segments, rows one segment after another from each of begin on; state: what each starts from.

    A step takes the next row of every segment that has one, longest first; what is left of the few longest goes alone.
    """
    out, size = np.empty_like(a), np.diff(np.append(begin, len(a)))
    order = np.argsort(-size, kind="stable")
    begin, size, now = begin[order], size[order], state[order].copy()
    cx, cy = 0.5 * w, 0.5 * h
    t = 0
    while (live := int(np.searchsorted(-size, -t, "left"))) >= TOGETHER:
        at = begin[:live] + t
        A, B, X, Y = now[:live].T
        a2, b2, x2, y2 = a[at].T
        p1, p2 = 1.0 + A, 1.0 + a2
        A, B, X, Y = p2 * p1 - b2 * B - 1.0, p2 * B + b2 * p1, p2 * X - b2 * Y + x2, b2 * X + p2 * Y + y2
        most = np.zeros(live)
        for sx, sy in ((-1, -1), (1, -1), (-1, 1), (1, 1)):
            px, py = sx * cx[at], sy * cy[at]
            dx, dy = A * px - B * py + X, B * px + A * py + Y
            most = np.maximum(most, np.sqrt(dx * dx + dy * dy))
        near, far, little, much = limits[at].T
        f = np.clip((most - near) / np.where(far > near, far - near, 1.0), 0.0, 1.0)
        d = np.where(most > far, much, np.where(most > near, little * (1.0 - f) + much * f, little))
        now[:live] = out[at] = np.stack([A, B, X, Y], 1) * d[:, None]
        t += 1
    for k in range(live):
        rows = slice(begin[k] + t, begin[k] + size[k])
        out[rows] = decay_scan(a[rows], w[rows], h[rows], limits[rows], tuple(now[k]))
    return out


#: Rows of a segment that are scanned one after another; longer segments are cut.
SCAN_ROWS = 8192


def _scan_pieces(rows: DataFrame, starts: DataFrame | None, by: tuple[str, ...], ends_only: bool) -> DataFrame:
    """The decay scan of pieces of segments. starts: (by, piece, A, B, TX, TY), what pieces start from where not from identity.

    Pieces are dealt by a hash and stream through a task in order, all of a batch together; a start comes as a row before its
    piece's. ends_only: a row for each piece with what it ends in, else a row for each frame.
    """
    keys = (*by, "piece")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if starts is not None:
        rows = rows.unionByName(starts.select(*keys, *TRANSFORM), allowMissingColumns=True)
    names = list(keys) if ends_only else [*by, "frame_idx"]

    def run(batches):
        last, state = None, np.zeros(4)
        for batch in batches:
            if not batch.num_rows:
                continue
            begin, n = begins(batch, keys), batch.num_rows
            flat = np.stack(_columns(batch, *TRANSFORM), 1)
            own, start = np.array(batch.column("frame_idx").is_valid()), np.zeros((len(begin), 4))
            key = tuple(batch.column(k)[0].as_py() for k in keys)
            if key == last:
                start[0] = state
            given = np.flatnonzero(~own)
            start[np.searchsorted(begin, given)] = flat[given]
            # A given start stands first of its piece; without those rows pieces begin as many rows earlier.
            at = np.flatnonzero(own)
            first = begin - np.searchsorted(given, begin)
            size = np.diff(np.append(first, len(at)))
            filled = size > 0
            out = np.zeros((len(at), 4))
            w, h, *limits = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("width", "height", *LIMITS)]
            if len(at):
                out = scan_segments(flat[at], w[at], h[at], np.stack(limits, 1)[at], first[filled], start[filled])
            end = start.copy()
            end[filled] = out[(first + size)[filled] - 1]
            last, state = tuple(batch.column(k)[n - 1].as_py() for k in keys), end[-1]
            if ends_only:
                # A piece that goes on in the next batch gives one more row there; the last one counts.
                cols = [batch.column(c).take(pa.array(begin)) for c in names]
                reached = batch.column("order_").take(pa.array(np.append(begin[1:], n) - 1))
                yield pa.RecordBatch.from_arrays([*cols, reached, *map(pa.array, np.ascontiguousarray(end.T))], names=[*names, "order_", *TRANSFORM])
            elif len(at):
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at)) for c in names], *map(pa.array, np.ascontiguousarray(out.T))], names=[*names, *TRANSFORM])

    rows = rows.withColumn("order_", F.coalesce(F.col("frame_idx").cast("long"), F.lit(-(1 << 62))))
    dealt = rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "order_")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    found = dealt.mapInArrow(run, f"{kinds}, {'order_ long, ' if ends_only else ''}A double, B double, TX double, TY double")
    if ends_only:
        found = found.groupBy(*keys).agg(F.max_by(F.struct(*TRANSFORM), "order_").alias("e")).select(*keys, *[F.col(f"e.{c}").alias(c) for c in TRANSFORM])
    return found


def scan_in_rounds(residual: DataFrame, p: StabParams | None, by: tuple[str, ...] = ("video_id", "reset"), piece: int = SCAN_ROWS, store: bool = True) -> tuple[DataFrame, int]:
    """W6 in parallel along a segment, and the number of rounds that it took (0 where no segment is longer than a piece).

    A segment is cut into pieces by frame_idx. All pieces of long segments are scanned from a guessed start, identity; then
    each from the end of the piece before it, until no end differs from the round before in any bit: then each piece has
    started from where the one before it ended, which is the sum in one go. As sums decay, a guess is forgotten within some
    hundred rows and two rounds do; without decay rounds may be as many as pieces. The rows are written first, as they are read
    several times; store=False is for rows that a written table gives anew at little cost.
    """
    limits = [F.lit(float(getattr(p, c))).alias(c) if p else F.col(c).cast("double").alias(c) for c in LIMITS]
    kept = residual.select(*by, part_of("frame_idx", piece).alias("piece"), "frame_idx", "width", "height", *[F.col(f"jitter.{c}").alias(c) for c in TRANSFORM], *limits)
    spark = residual.sparkSession
    folder = new_folder(spark, "scan")
    rows = kept
    if store:
        kept.write.parquet(f"{folder}/rows")
        rows = spark.read.schema(kept.schema).parquet(f"{folder}/rows")
    order = Window.partitionBy(*by).orderBy("piece")
    pieces = rows.groupBy(*by, "piece").agg(F.count("*").alias("n"))
    pieces = pieces.select(*by, "piece", F.count("*").over(Window.partitionBy(*by)).alias("of"), F.lead("piece").over(order).alias("next_piece")).where("of > 1")
    pieces.write.parquet(f"{folder}/pieces")
    pieces = spark.read.schema(pieces.schema).parquet(f"{folder}/pieces")
    if pieces.isEmpty():
        return _scan_pieces(rows, None, by, False), 0
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in (*by, "piece")]
    long_rows = rows.alias("r").join(pieces.select(*by, "piece").alias("q"), _all(same("r", "q")), "left_semi")
    bits = lambda side: F.concat_ws(",", *[F.col(f"{side}.{c}").cast("string") for c in TRANSFORM])
    starts, turn, before = None, 0, None
    while True:
        _scan_pieces(long_rows, starts, by, True).write.parquet(f"{folder}/ends{turn}")
        ends = spark.read.schema(", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*by, "piece", *TRANSFORM))).parquet(f"{folder}/ends{turn}")
        turn += 1
        if before is not None:
            differ = ends.alias("a").join(before.alias("b"), _all(same("a", "b"))).where(bits("a") != bits("b"))
            if differ.isEmpty():
                break
        followed = ends.alias("e").join(pieces.where("next_piece is not null").alias("q"), _all(same("e", "q")))
        starts = followed.select(*[F.col(f"e.{c}").alias(c) for c in by], F.col("q.next_piece").alias("piece"), *[F.col(f"e.{c}").alias(c) for c in TRANSFORM])
        before = ends
    return _scan_pieces(rows, starts, by, False), turn


def _all(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions)


def accumulate_motion(residual: DataFrame, p: StabParams | None, by: tuple[str, ...] = ("video_id", "reset"), piece: int = SCAN_ROWS, store: bool = True) -> DataFrame:
    """The decayed sum of jitter, from identity at each segment's start. Without p the rows have their own LIMITS."""
    return scan_in_rounds(residual, p, by, piece, store)[0]


def corrections(accumulated: DataFrame) -> DataFrame:
    """The inverse of the accumulated motion."""
    return accumulated.select("video_id", "frame_idx", T.t_inverse(as_struct()).alias("c")).select("video_id", "frame_idx", *[F.col(f"c.{c}").alias(c) for c in TRANSFORM])


def stabilize_motion(motion: DataFrame, p: StabParams = StabParams(), part: int = PART_ROWS, piece: int = SCAN_ROWS) -> DataFrame:
    """The correction of every frame that comes out: (video_id, frame_idx, A, B, TX, TY)."""
    return corrections(accumulate_motion(residual_motion(with_smoothed(motion, p, part), p.smooth), p, piece=piece))


def failure_stats(motion: DataFrame) -> DataFrame:
    """Frames, failed alignments and their share of each video."""
    return motion.groupBy("video_id").agg(F.count("*").alias("frames"), F.count_if(~F.col("ok")).alias("failures"), F.avg((~F.col("ok")).cast("double")).alias("failure_rate"))
