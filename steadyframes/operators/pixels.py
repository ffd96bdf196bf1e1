"""Pixel operators in long form: a row for each pixel, (video_id, frame_idx, x, y, v), for checks and small images.

They are joins, windows and groupings on (image, place). Dense frames go through `dense`, which gives equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from steadyframes.functions import transforms as T

IMAGE = ["video_id", "frame_idx"]


def _clamped(offset: Column, at: str, size: Column | int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(size) - 1 if isinstance(size, int) else size - 1, F.col(at) + offset))


def _offsets(low: int, high: int) -> Column:
    return F.explode(F.sequence(F.lit(low), F.lit(high)))


def to_gray(bgr: DataFrame) -> DataFrame:
    """Of rows (b, g, r) the gray value, by fixed-point weights."""
    return bgr.withColumn("v", ((F.col("r") * 9798 + F.col("g") * 19235 + F.col("b") * 3735 + 16384) / 32768).cast("int"))


def pyr_down(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Half resolution by the taps 1 4 6 4 1 both ways, clamped at the edges, without rounding.

    Every source pixel goes to the outputs that read it, so there is one grouping and no join.
    """
    w, h = width // 2, height // 2

    def reach(at: str, size: int, out: int) -> Column:
        """(output, weight) pairs of a source coordinate, edge clamping included."""
        places = F.sequence(F.greatest(F.lit(0), F.floor((F.col(at) - 2) / 2).cast("int")), F.least(F.lit(out - 1), F.floor((F.col(at) + 3) / 2).cast("int")))

        def weight(o):
            # The taps of output o that read this coordinate, clamped ones at the edges too.
            taps = F.array(*[F.when(F.greatest(F.lit(0), F.least(F.lit(size - 1), 2 * o + k - 2)) == F.col(at), c).otherwise(0) for k, c in enumerate((1, 4, 6, 4, 1))])
            return F.struct(o.alias("o"), F.aggregate(taps, F.lit(0), lambda a, b: a + b).alias("w"))

        return F.filter(F.transform(F.filter(places, lambda o: o < out), weight), lambda s: s["w"] > 0)

    out = pixels.select(*IMAGE, "x", "y", "v").withColumn("px", F.explode(reach("x", width, w))).withColumn("py", F.explode(reach("y", height, h)))
    total = F.sum(F.col("v").cast("long") * F.col("px.w") * F.col("py.w"))
    return out.groupBy(*IMAGE, F.col("px.o").alias("x"), F.col("py.o").alias("y")).agg(F.floor(total / 256).cast("int").alias("v"))


def pyramid_levels(width, height, min_w: int = 20, min_h: int = 20) -> Column:
    """Number of levels: the sizes halve, rounding down, as long as both sides stay at the least size."""
    w, h = (F.col(c) if isinstance(c, str) else F.lit(c) for c in (width, height))
    halves = F.filter(F.sequence(F.lit(1), F.lit(30)), lambda i: (F.floor(w / F.pow(F.lit(2.0), i)) >= min_w) & (F.floor(h / F.pow(F.lit(2.0), i)) >= min_h))
    return F.size(halves) + 1


def tile_size(width, height, min_tiles: int = 1000, max_tile: int = 20) -> Column:
    """P5: the largest even tile, from 2 to max_tile, up to which every size keeps min_tiles whole tiles."""
    w, h = (F.col(c) if isinstance(c, str) else F.lit(c) for c in (width, height))
    start = F.struct(F.lit(2).alias("best"), F.lit(True).alias("go"))

    def step(acc, i):
        go = acc["go"] & (F.floor(w / i) * F.floor(h / i) >= min_tiles)
        return F.struct(F.when(go, i).otherwise(acc["best"]).alias("best"), go.alias("go"))

    return F.aggregate(F.sequence(F.lit(4), F.lit(max_tile), F.lit(2)), start, step, lambda acc: acc["best"])


def grad_xy(pixels: DataFrame) -> DataFrame:
    """Central differences gx and gy, a pixel standing in for its neighbour beyond the edge."""
    row, col = Window.partitionBy(*IMAGE, "y").orderBy("x"), Window.partitionBy(*IMAGE, "x").orderBy("y")
    across = lambda w: (F.coalesce(F.lead("v").over(w), F.col("v")) - F.coalesce(F.lag("v").over(w), F.col("v"))) * F.lit(0.5)
    return pixels.withColumn("gx", across(row).cast("double")).withColumn("gy", across(col).cast("double"))


def tile_argmax(grads: DataFrame, tile: int, width: int, height: int) -> DataFrame:
    """A1: for each whole tile and axis the place of the largest |gradient|, of equal ones the first by rows."""
    inside = grads.where((F.col("x") < width // tile * tile) & (F.col("y") < height // tile * tile))
    one = inside.select(*IMAGE, "x", "y", F.floor(F.col("x") / tile).cast("int").alias("tile_x"), F.floor(F.col("y") / tile).cast("int").alias("tile_y"), F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("gx").alias("g")), F.struct(F.lit("y").alias("axis"), F.col("gy").alias("g")))).alias("a"))
    best = one.groupBy(*IMAGE, F.col("a.axis").alias("axis"), "tile_x", "tile_y").agg(F.max(F.struct(F.abs("a.g").alias("m"), (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"), F.col("a.g").alias("g"))).alias("b"))
    return best.select(*IMAGE, "axis", "tile_x", "tile_y", (-F.col("b.nx")).alias("px"), (-F.col("b.ny")).alias("py"), F.col("b.g").alias("g"))


def sparse_jacobian(keypoints: DataFrame, width: int, height: int) -> DataFrame:
    """j0..j3 of each keypoint from its axis's gradient g and its offset from the middle."""
    u, v = F.col("px") - width * 0.5, F.col("py") - height * 0.5
    g, x, s = 2.0 * F.col("g"), F.col("axis") == "x", 1.0 / width
    return keypoints.withColumns({
        "j0": F.when(x, g * u * s).otherwise(g * v * s), "j1": F.when(x, g * (-v) * s).otherwise(g * u * s),
        "j2": F.when(x, g).otherwise(0.0), "j3": F.when(x, 0.0).otherwise(g),
    })


def lanczos_sample(points: DataFrame, pixels: DataFrame, width: int, height: int) -> DataFrame:
    """The image at (wx, wy): 5 x 5 taps about the floor, clamped, weighted sum over sum of weights, as `sample`.

    points: image keys, wx, wy, and columns that tell the points of an image apart.
    """
    keys = points.columns
    tap = points.withColumn("fx", F.floor("wx").cast("int")).withColumn("fy", F.floor("wy").cast("int"))
    tap = tap.withColumn("dx", _offsets(-2, 2)).withColumn("dy", _offsets(-2, 2))
    tap = tap.withColumn("w", T.lanczos2(F.col("dx") - (F.col("wx") - F.col("fx"))) * T.lanczos2(F.col("dy") - (F.col("wy") - F.col("fy"))))
    tap = tap.withColumn("x", _clamped(F.col("dx"), "fx", width)).withColumn("y", _clamped(F.col("dy"), "fy", height))
    got = tap.join(pixels.select(*IMAGE, "x", "y", "v"), [*IMAGE, "x", "y"])
    return got.groupBy(*keys).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("sample"))


def warp_points(keypoints: DataFrame, t: Column, width: int, height: int) -> DataFrame:
    """Where a transform about the image's middle brings each keypoint: wx, wy."""
    m = T.t_to_affine(t, F.lit(width), F.lit(height), "half")
    x, y = F.col("px"), F.col("py")
    return keypoints.withColumn("wx", m[0] * x + m[1] * y + m[2]).withColumn("wy", m[3] * x + m[4] * y + m[5])


def sparse_warp_diff(keypoints: DataFrame, tmpl: DataFrame, key: DataFrame, t: Column, width: int, height: int) -> DataFrame:
    """At each keypoint the template's pixel, the keyframe's sample where t brings it, residual and whole |difference|."""
    k = warp_points(keypoints, t, width, height)
    got = lanczos_sample(k, key, width, height)
    tv = tmpl.select(*IMAGE, F.col("x").alias("px"), F.col("y").alias("py"), F.col("v").alias("tmpl"))
    return got.join(tv, [*IMAGE, "px", "py"]).withColumn("residual", F.col("tmpl") - F.col("sample")).withColumn("abs_delta", F.floor(F.abs("residual")).cast("int"))


def smallest_fraction(kp: DataFrame, fraction: float) -> DataFrame:
    """K1: of each image and axis the floor(n fraction) keypoints of least abs_delta; ties by tile row, then column."""
    w = Window.partitionBy(*IMAGE, "axis")
    ranked = kp.withColumn("rank", F.row_number().over(w.orderBy("abs_delta", "tile_y", "tile_x"))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("rank") <= F.floor(F.col("n") * F.lit(fraction).cast("float"))).drop("rank", "n")


def gather_selected(keypoints: DataFrame, selected: DataFrame) -> DataFrame:
    """The keypoints whose tile is among the selected ones."""
    return keypoints.join(selected.select(*IMAGE, "axis", "tile_x", "tile_y"), [*IMAGE, "axis", "tile_x", "tile_y"], "left_semi")


def union_axes(kx: DataFrame, ky: DataFrame) -> DataFrame:
    """Keypoints of both axes as one set."""
    return kx.unionByName(ky)


def normal_matrix(jac: DataFrame) -> DataFrame:
    """A2: the ten sums of products of j0..j3 of each image."""
    return jac.groupBy(*IMAGE).agg(*[F.sum(F.col(f"j{a}") * F.col(f"j{b}")).alias(f"h{a}{b}") for a in range(4) for b in range(a, 4)])


def residual_projection(kp: DataFrame) -> DataFrame:
    """A3: half the sums of j times residual of each image."""
    return kp.groupBy(*IMAGE).agg(*[(F.sum(F.col(f"j{a}") * F.col("residual")) * 0.5).alias(f"b{a}") for a in range(4)])


def warp_gray(pixels: DataFrame, t: Column, width: int, height: int) -> DataFrame:
    """Each pixel read from where t brings it, between four neighbours, clamped at the edges; `w` is a double."""
    m = T.t_to_affine(t, F.lit(width), F.lit(height), "pixel")
    at = pixels.select(*IMAGE, "x", "y").withColumn("wx", m[0] * F.col("x") + m[1] * F.col("y") + m[2]).withColumn("wy", m[3] * F.col("x") + m[4] * F.col("y") + m[5])
    at = at.withColumn("fx", F.floor("wx").cast("int")).withColumn("fy", F.floor("wy").cast("int")).withColumn("dx", _offsets(0, 1)).withColumn("dy", _offsets(0, 1))
    share = lambda d, f, w: F.when(F.col(d) == 1, F.col(w) - F.col(f)).otherwise(1.0 - (F.col(w) - F.col(f)))
    at = at.withColumn("share", share("dx", "fx", "wx") * share("dy", "fy", "wy"))
    source = pixels.select(*IMAGE, F.col("x").alias("sx"), F.col("y").alias("sy"), "v")
    got = at.withColumn("sx", _clamped(F.col("dx"), "fx", width)).withColumn("sy", _clamped(F.col("dy"), "fy", height)).join(source, [*IMAGE, "sx", "sy"])
    return got.groupBy(*IMAGE, "x", "y").agg(F.sum(F.col("share") * F.col("v")).alias("w"))


def crop_frames(pixels: DataFrame, c: int, width: int, height: int) -> DataFrame:
    """C pixels off each side, if c is over 0."""
    if c <= 0:
        return pixels
    inside = F.col("x").between(c, width - 1 - c) & F.col("y").between(c, height - 1 - c)
    return pixels.where(inside).withColumn("x", F.col("x") - c).withColumn("y", F.col("y") - c)


def normalize_minmax(df: DataFrame, value: str) -> DataFrame:
    """P10: a value's place between an image's least and most, as 0 to 255; 0 where they are equal. Combined before the shuffle."""
    ends = df.groupBy(*IMAGE).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    share = F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo"))
    return df.join(ends, IMAGE).withColumn("u8", F.coalesce(F.floor(share * 255.0 + 0.5), F.lit(0)).cast("int")).drop("lo", "hi")
