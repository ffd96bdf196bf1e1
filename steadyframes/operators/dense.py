"""Operators on dense frames: one row a frame, pixels as row-major bytes (BGR where channels = 3).

Spark bounds an Arrow batch by bytes (spark.sql.execution.arrow.maxBytesPerBatch), however many frames that makes.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadyframes.operators import kernels as K
from steadyframes.operators.motion import size_segments

CHUNK = 32
META_ROWS = 2_000_000


def image_of(pixels: bytes, width: int, height: int, channels: int) -> np.ndarray:
    a = np.frombuffer(pixels, np.uint8)
    return a.reshape((height, width) if channels == 1 else (height, width, channels))


def _map(frames: DataFrame, fn: Callable[[np.ndarray, dict], np.ndarray], channels: int | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Replace each frame by fn(image, row); sizes follow the result, columns in `drop` go."""
    kept = [c for c in frames.columns if c not in drop]

    def run(batches):
        for pdf in batches:
            images = [fn(image_of(r["pixels"], r["width"], r["height"], r["channels"]), r) for r in pdf.to_dict("records")]
            yield pdf.assign(pixels=[i.tobytes() for i in images], width=[i.shape[1] for i in images], height=[i.shape[0] for i in images], channels=[1 if i.ndim == 2 else i.shape[2] for i in images])[kept]

    return frames.mapInPandas(run, frames.select(*kept).schema)


def to_gray(frames: DataFrame) -> DataFrame:
    """P1."""
    return _map(frames, lambda a, _: K.gray(a))


def pyr_down(frames: DataFrame) -> DataFrame:
    """P2 of gray frames."""
    return _map(frames, lambda a, _: K.half(a))


def build_pyramid(frames: DataFrame, min_w: int = 20, min_h: int = 20) -> DataFrame:
    """A row for each level of each gray frame, with `level`."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                for level, a in enumerate(K.pyramid(image_of(r["pixels"], r["width"], r["height"], r["channels"]), min_w, min_h)):
                    out.append({**r, "pixels": a.tobytes(), "width": a.shape[1], "height": a.shape[0], "level": level})
            if out:
                yield pd.DataFrame(out)

    return frames.mapInPandas(run, frames.withColumn("level", F.lit(0)).schema)


def warp_frames(frames: DataFrame, transforms: DataFrame) -> DataFrame:
    """The content of each frame moved by its transform (video_id, frame_idx, A, B, TX, TY); others are left out.

    J7: transforms of up to META_ROWS rows go to the frames; more, and both are shuffled by frame.
    """
    t = transforms.select("video_id", "frame_idx", "A", "B", "TX", "TY")
    joined = frames.join(if_small(t), ["video_id", "frame_idx"])
    return _map(joined, lambda a, r: K.warp_frame(a, (r["A"], r["B"], r["TX"], r["TY"])), drop=("A", "B", "TX", "TY"))


def crop_frames(frames: DataFrame, c: int) -> DataFrame:
    """P9."""
    return _map(frames, lambda a, _: np.ascontiguousarray(a[c : a.shape[0] - c, c : a.shape[1] - c])) if c > 0 else frames


def normalize_minmax(frames: DataFrame) -> DataFrame:
    """P10 of gray frames."""

    def fn(a: np.ndarray, _) -> np.ndarray:
        low, high = int(a.min()), int(a.max())
        return np.floor((a.astype(float) - low) / (high - low) * 255 + 0.5).astype(np.uint8) if high > low else np.zeros_like(a)

    return _map(frames, fn)


def mean_difference(frames: DataFrame, other: str) -> DataFrame:
    """`difference`: the mean absolute difference of a frame's pixels and those in another column; null where sizes differ."""

    def run(batches):
        for pdf in batches:
            pairs = [(np.frombuffer(a, np.uint8).astype(int), np.frombuffer(b, np.uint8)) for a, b in zip(pdf["pixels"], pdf[other], strict=True)]
            yield pdf.drop(columns=other).assign(difference=[float(np.abs(a - b).mean()) if a.shape == b.shape else None for a, b in pairs])

    return frames.mapInPandas(run, frames.drop(other).withColumn("difference", F.lit(None).cast("double")).schema)


@functools.lru_cache(16)
def _place_weights(n: int) -> np.ndarray:
    return (np.arange(n) * 7919 % 10007).astype(float)


def pixel_sums(frames: DataFrame) -> DataFrame:
    """`pixel_sum` and `placed_sum` in place of pixels: two sums of a frame's bytes, of which the second tells places apart."""
    kept = [c for c in frames.columns if c != "pixels"]

    def run(batches):
        for batch in batches:
            sums = []
            for raw in batch.column("pixels"):
                # Whole numbers far below 2^53, so sums of doubles are exact.
                a = None if raw.as_py() is None else np.frombuffer(raw.as_buffer(), np.uint8).astype(float)
                sums.append((None, None) if a is None else (int(a.sum()), int(a @ _place_weights(len(a)))))
            found = [pa.array([s[k] for s in sums], pa.int64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *found], names=[*kept, "pixel_sum", "placed_sum"])

    kinds = ", ".join(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in kept)
    return frames.mapInArrow(run, f"{kinds}, pixel_sum long, placed_sum long")


def if_small(df: DataFrame) -> DataFrame:
    """Marked for broadcast where it has no more than META_ROWS rows."""
    return F.broadcast(df) if df.count() <= META_ROWS else df


def chunk_numbers(frames: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(video_id, frame_idx, segment, n, chunk) by the frames' metadata; a frame where a chunk ends belongs to the next one too."""
    meta = size_segments(frames.select("video_id", "frame_idx", "width", "height")).select("video_id", "frame_idx", "segment", "n")
    own, after = F.floor((F.col("n") - 1) / chunk), F.floor(F.col("n") / chunk)
    return meta.withColumn("chunk", F.explode(F.when(F.col("n") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.array(own, after)))))


def chunks(frames: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """J1's co-location: gray frames with `segment`, n and `chunk`; a chunk holds its own frames and the one before.

    Numbers are found on the metadata alone; pixels are shuffled once, by the grouping that follows. The frame where
    a chunk ends is sent to the next one too, so pixel traffic grows by one part in `chunk`.
    """
    gray = to_gray(frames.select("video_id", "frame_idx", "width", "height", "channels", "pixels"))
    return gray.join(if_small(chunk_numbers(frames, chunk)), ["video_id", "frame_idx"])


def by_chunk(rows: DataFrame):
    """Rows of `chunks` grouped by chunk, in as many tasks as the session has shuffle partitions.

    A chunk costs seconds for megabytes, so tasks must not be merged by their bytes as adaptive execution does.
    """
    keys = ["video_id", "segment", "chunk"]
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys)


def in_chunks(frames: DataFrame, fn: Callable[[pd.DataFrame, int], pd.DataFrame], schema: str, chunk: int = CHUNK) -> DataFrame:
    """fn(rows in order of n, chunk number) for each chunk; fn returns rows of the chunk's own frames."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values("n", kind="stable"), int(pdf["chunk"].iloc[0]))

    return by_chunk(chunks(frames, chunk)).applyInPandas(run, schema)
