"""Order within videos of any length: two-level running numbers, chunks with a halo, and whole groups of sorted rows.

A video's rows fall into parts by frame_idx, so a part has at most PART_ROWS rows (frame_idx tells a video's rows apart).
Running numbers are found within parts; a table with a row for each part carries them on, so the only window over a
whole video has a row for each of its parts. Gaps in frame_idx make smaller parts and change nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART_ROWS = 4096
_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, 0)


def part_of(col: str, rows: int) -> Column:
    return F.expr(f"cast({col} as bigint) div {rows}")


def _with_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Each row with its part's columns; a null video is a video of its own."""
    parts = parts.withColumnsRenamed({"video_id": "video_", "part_": "of_"})
    return rows.join(parts, rows["video_id"].eqNullSafe(parts["video_"]) & (rows["part_"] == parts["of_"])).drop("video_", "of_")


def number_rows(rows: DataFrame, sums: dict[str, Column] | None = None, part: int = PART_ROWS) -> DataFrame:
    """k: each row's place in its video, from 0; rows_: how many the video has; by name, running sums of columns up to the row."""
    sums = sums or {}
    local, videos = Window.partitionBy("video_id", "part_").orderBy("frame_idx"), Window.partitionBy("video_id").orderBy("part_")
    dealt = rows.withColumn("part_", part_of("frame_idx", part))
    totals = dealt.groupBy("video_id", "part_").agg(F.count("*").alias("n_"), *[F.sum(c).alias(f"{name}_") for name, c in sums.items()])
    base = {"base_": F.coalesce(F.sum("n_").over(videos.rowsBetween(*_BEFORE)), F.lit(0)), "rows_": F.sum("n_").over(Window.partitionBy("video_id"))}
    base |= {f"{name}_": F.coalesce(F.sum(f"{name}_").over(videos.rowsBetween(*_BEFORE)), F.lit(0)) for name in sums}
    parts = totals.select("video_id", "part_", *[c.alias(n) for n, c in base.items()])
    own = {"k": F.row_number().over(local) - 1} | {name: F.sum(c).over(local.rowsBetween(*_SO_FAR)) for name, c in sums.items()}
    out = _with_parts(dealt.withColumns(own), parts)
    return out.withColumns({"k": (F.col("k") + F.col("base_")).cast("long")} | {name: F.col(name) + F.col(f"{name}_") for name in sums}).drop("part_", "base_", *[f"{name}_" for name in sums])


def size_runs(frames: DataFrame, part: int = PART_ROWS) -> DataFrame:
    """segment: the number of a row's run of equal frame size in its video; n: its place in the run; prev_idx: the row before it in the video."""
    local, videos = Window.partitionBy("video_id", "part_").orderBy("frame_idx"), Window.partitionBy("video_id").orderBy("part_")
    unlike = (F.lag("width").over(local) != F.col("width")) | (F.lag("height").over(local) != F.col("height"))
    dealt = frames.withColumn("part_", part_of("frame_idx", part))
    rows = dealt.withColumns({"i_": F.row_number().over(local) - 1, "new_": F.coalesce(unlike, F.lit(False)), "prev_idx": F.lag("frame_idx").over(local)})
    size = F.struct("width", "height")
    ends = rows.groupBy("video_id", "part_").agg(
        F.count("*").alias("n_"), F.sum(F.col("new_").cast("long")).alias("runs_"), F.max(F.when(F.col("new_"), F.col("i_"))).alias("last_"),
        F.min_by(size, "frame_idx").alias("first_size"), F.max_by(size, "frame_idx").alias("last_size"), F.max("frame_idx").alias("end_idx"),
    )
    before = F.lag("last_size").over(videos)
    ends = ends.withColumns({
        "base_": F.coalesce(F.sum("n_").over(videos.rowsBetween(*_BEFORE)), F.lit(0)), "end_idx": F.lag("end_idx").over(videos),
        "cut_": F.coalesce((before["width"] != F.col("first_size.width")) | (before["height"] != F.col("first_size.height")), F.lit(False)), "first_": F.row_number().over(videos) == 1,
    })
    # Where the run that reaches into a part has begun.
    ends = ends.withColumn("begun_", F.when(F.col("cut_") | F.col("first_"), F.col("base_"))).withColumn("ending_", F.coalesce(F.col("base_") + F.col("last_"), "begun_"))
    runs = F.coalesce(F.sum("runs_").over(videos.rowsBetween(*_BEFORE)), F.lit(0)) + F.sum(F.col("cut_").cast("long")).over(videos.rowsBetween(*_SO_FAR))
    begun = F.coalesce("begun_", F.last("ending_", ignorenulls=True).over(videos.rowsBetween(*_BEFORE)))
    parts = ends.select("video_id", "part_", "base_", runs.alias("runs_"), begun.alias("begun_"), "end_idx")
    so_far = local.rowsBetween(*_SO_FAR)
    out = _with_parts(rows.withColumns({"segment": F.sum(F.col("new_").cast("long")).over(so_far), "from_": F.max(F.when(F.col("new_"), F.col("i_"))).over(so_far)}), parts)
    begin = F.coalesce(F.col("base_") + F.col("from_"), "begun_")
    return out.withColumns({"segment": F.col("segment") + F.col("runs_"), "n": (F.col("base_") + F.col("i_") - begin).cast("long"), "prev_idx": F.coalesce("prev_idx", "end_idx")}).drop("part_", "i_", "new_", "from_", "base_", "runs_", "begun_", "end_idx")


def with_halo(numbered: DataFrame, before: int, after: int, chunk: int = PART_ROWS) -> DataFrame:
    """Rows of number_rows in chunks of their k: `chunk`, and whether a row is the chunk's own; the others stand up to `before` rows
    before its own or `after` rows after them."""
    first, last = f"greatest(0L, k - {after}) div {chunk}", f"least(rows_ - 1, k + {before}) div {chunk}"
    return numbered.withColumn("chunk", F.explode(F.expr(f"sequence({first}, {last})"))).withColumn("own", F.expr(f"k div {chunk} = chunk"))


def begins(table: pa.Table | pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    """Where each run of rows with equal keys begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    columns = [table.column(k) for k in keys]
    while columns:
        col = columns.pop()
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        if pa.types.is_struct(col.type):
            columns += col.flatten()
            continue
        code = np.array(pc.dictionary_encode(col, null_encoding="encode").indices)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def whole_groups(batches, keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows sorted by the keys, and where groups begin; a group that goes on is held until it ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        at = begins(table, keys)
        if len(at) > 1:
            yield table.slice(0, int(at[-1])), at[:-1]
            table = table.slice(int(at[-1]))
        held = table.to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, begins(table, keys)
