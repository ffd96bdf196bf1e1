"""Motion, patch and frame tables derived from the given tables by integer rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _motion_columns(key):
    def part(factor: int, size: int, middle: int, scale: float):
        return ((key * factor) % size - middle).cast("double") / scale

    return [part(37, 201, 100, 10000.0).alias("A"), part(53, 201, 100, 10000.0).alias("B"), part(71, 2001, 1000, 100.0).alias("TX"), part(89, 2001, 1000, 100.0).alias("TY")]


def motion(spark: SparkSession, sf_dir: str, resize: bool = False) -> DataFrame:
    """From events: a video for each user, a frame for each event in time order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.row_number().over(w) - 1).cast("long").alias("frame_idx"))
    small = (F.floor(F.col("frame_idx") / 20) % 2 == 1) if resize else F.lit(False)
    return e.select(
        F.col("user_id").alias("video_id"), "frame_idx", F.when(small, 640).otherwise(1280).alias("width"), F.when(small, 360).otherwise(720).alias("height"),
        *_motion_columns(F.col("event_id")), ((F.col("event_type") != "error") & (F.col("frame_idx") > 0)).alias("ok"),
    )


MOTION_SQL = """
SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, 1280 AS width, 720 AS height,
  CAST((event_id * 37) % 201 - 100 AS DOUBLE) / 10000.0::DOUBLE AS A, CAST((event_id * 53) % 201 - 100 AS DOUBLE) / 10000.0::DOUBLE AS B,
  CAST((event_id * 71) % 2001 - 1000 AS DOUBLE) / 100.0::DOUBLE AS TX, CAST((event_id * 89) % 2001 - 1000 AS DOUBLE) / 100.0::DOUBLE AS TY,
  event_type <> 'error' AND row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 AS ok
FROM events
"""


def clip_motion(spark: SparkSession, sf_dir: str, length: int = 10) -> DataFrame:
    """From embeddings: videos of `length` frames, a frame for each vector; the source of dense frames."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    return e.select(F.floor(F.col("vec_id") / length).cast("long").alias("video_id"), (F.col("vec_id") % length).cast("long").alias("frame_idx"), F.lit(1280).alias("width"), F.lit(720).alias("height"), *_motion_columns(F.col("vec_id")), (F.col("vec_id") % length > 0).alias("ok"))


CLIP_SQL = """
SELECT vec_id // 10 AS video_id, vec_id % 10 AS frame_idx, CAST((vec_id * 71) % 2001 - 1000 AS DOUBLE) / 100.0::DOUBLE AS TX, CAST((vec_id * 89) % 2001 - 1000 AS DOUBLE) / 100.0::DOUBLE AS TY
FROM embeddings
"""


def large_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From lineitem, for timing: a video for each supplier."""
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    e = table(spark, sf_dir, "lineitem").select("l_suppkey", key.alias("key"), (F.row_number().over(w) - 1).cast("long").alias("frame_idx"))
    return e.select(F.col("l_suppkey").alias("video_id"), "frame_idx", F.lit(1280).alias("width"), F.lit(720).alias("height"), *_motion_columns(F.col("key")), ((F.col("key") % 29 != 0) & (F.col("frame_idx") > 0)).alias("ok"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From embeddings: 8 x 8 gray images in long form."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e"))
    v = F.floor((F.col("e").cast("double") + 1.0) * 127.5).cast("int")
    return e.select(
        F.floor(F.col("vec_id") / 10).cast("long").alias("video_id"), (F.col("vec_id") % 10).cast("long").alias("frame_idx"),
        (F.col("pos") % 8).cast("int").alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), F.least(F.lit(255), F.greatest(F.lit(0), v)).alias("v"),
    )


PATCHES_SQL = """
SELECT vec_id // 10 AS video_id, vec_id % 10 AS frame_idx, CAST(pos % 8 AS INT) AS x, CAST(pos // 8 AS INT) AS y,
  least(255, greatest(0, CAST(floor((CAST(e AS DOUBLE) + 1.0) * 127.5) AS INT))) AS v
FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS pos FROM embeddings)
"""


#: Frames of a batch that goes back to Spark, whose own batches are bounded by rows and not by what comes out for them.
TOGETHER = 256


def rendered(frames_: DataFrame, render, *columns: str) -> DataFrame:
    """`pixels` added: render(*values of the columns) of each row, null where one of them is. A column function, so steps on frames'
    numbers alone render nothing; rows are dealt first, since rendering costs far more than a row's bytes tell."""

    @F.arrow_udf("binary")
    def pixels(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for cols in batches:
            for at in range(0, len(cols[0]), TOGETHER):
                rows = zip(*[c.slice(at, TOGETHER).to_pylist() for c in cols], strict=True)
                yield pa.array([None if None in r else render(*r) for r in rows], pa.binary())

    tasks = int(frames_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frames_.repartition(tasks, "video_id", "frame_idx").withColumn("pixels", pixels(*columns))


def _render(sx: int, sy: int, width: int, height: int) -> bytes:
    """The pattern moved by (sx, sy)."""
    tri = lambda u, p: np.abs(u % (2 * p) - p)
    u, v = np.arange(width) - sx + 1000, np.arange(height)[:, None] - sy + 1000
    return np.minimum(255, 20 + tri(u, 23) * tri(v, 19) // 3 + tri(2 * u + v, 61)).astype(np.uint8).tobytes()


def frames(motion_df: DataFrame, width: int = 96, height: int = 64) -> DataFrame:
    """Gray frames of a known motion: content moves by whole pixels (dx, dy), of -3 to 3, from each frame to the next.

    A frame is one row of bytes.
    """
    part = lambda c: F.when(F.floor(c) < 0, -(-F.floor(c) % 4)).otherwise(F.floor(c) % 4)
    w = Window.partitionBy("video_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    m = motion_df.select("video_id", "frame_idx", F.when(F.col("frame_idx") > 0, part(F.col("TX"))).otherwise(0).cast("int").alias("dx"), F.when(F.col("frame_idx") > 0, part(F.col("TY"))).otherwise(0).cast("int").alias("dy"))
    m = m.select("*", F.sum("dx").over(w).alias("sx"), F.sum("dy").over(w).alias("sy"))
    m = m.withColumns({"width": F.lit(width), "height": F.lit(height), "channels": F.lit(1)})
    return rendered(m, _render, "sx", "sy", "width", "height").select("video_id", "frame_idx", "width", "height", "channels", "pixels", "dx", "dy")
