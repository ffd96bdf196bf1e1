"""Frame tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_videos(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the .mp4 files of a folder; an error if there are none. Contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").load(path).select("path", "length")
    if found.isEmpty():
        raise ValueError(f"no .mp4 files in {path}")
    return found


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame rows of a Parquet table, less those without pixels or of a wrong size."""
    return usable(spark.read.parquet(path))


def read_stills(spark: SparkSession, path: str) -> DataFrame:
    """S2 of image files: each a video of one frame, keyed by its path."""
    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return usable(i.select(F.col("origin").alias("video_id"), F.lit(0).cast("long").alias("frame_idx"), "width", "height", F.col("nChannels").alias("channels"), F.col("data").alias("pixels")))


def usable(frames: DataFrame) -> DataFrame:
    return frames.where("pixels is not null and width > 0 and height > 0 and octet_length(pixels) = width * height * channels")


def output_meta(videos: DataFrame, crop: int) -> DataFrame:
    """S3: fps of 0 or less becomes 30; the size less the crop on every side."""
    return videos.withColumn("fps", F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0)).withColumn("out_width", F.col("width") - 2 * crop).withColumn("out_height", F.col("height") - 2 * crop)


def write_frames(df: DataFrame, path: str) -> None:
    """A folder for each video, its frames in order within and across files.

    Rows are dealt by ranges of (video, frame), so a video is in one file, or in a few where it is long.
    """
    df.repartitionByRange("video_id", "frame_idx").sortWithinPartitions("video_id", "frame_idx").write.partitionBy("video_id").parquet(path)


def report_line(df: DataFrame) -> DataFrame:
    """S5's line: path, tab, median_jitter_px=value."""
    return df.select(F.concat_ws("\t", F.col("video_id").cast("string"), F.concat(F.lit("median_jitter_px="), F.format_string("%.6f", F.round("jitter", 6)))).alias("value"))


def write_jitter_report(df: DataFrame, path: str) -> None:
    """S5 as text files."""
    report_line(df).write.text(path)
