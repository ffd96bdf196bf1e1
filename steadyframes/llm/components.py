"""Connected components of an edge table by alternating large and small stars, on Spark."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Where it names none, a new one on a single machine, else an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder below the shared one, when nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


EDGES_PER_TASK = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of edges (a, b) the smallest node that it reaches; nodes without edges are absent.

    Each turn a node's larger neighbours move to its smallest one, then its smaller ones do. A node's smallest
    neighbour is found by a grouping that combines before the shuffle, and joined back, so a star with very many
    points is split like any skewed join. The turns grow with the logarithm of the largest component's size. Tasks are
    as many as the edges need, so that few edges don't leave thousands of small shuffle files.
    """

    def largest_first(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")

    def smallest_last(e: DataFrame) -> DataFrame:
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    said = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        tasks = mark[0] // EDGES_PER_TASK + 1
        if mark == said or not mark[0]:
            break
        said = mark
        moved = largest_first(now.coalesce(tasks)).coalesce(tasks)
        now = cut_lineage(smallest_last(moved).coalesce(tasks))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
