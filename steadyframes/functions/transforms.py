"""Similarity transforms as column expressions.

A transform is a struct of doubles A, B, TX, TY for the matrix [[1 + A, -B], [B, 1 + A]] and a translation in pixels,
x to the right, y down. All functions take columns or names and stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the even polynomial for the Lanczos-2 weight, from x^0 to x^12.
LANCZOS2 = (0.999861, -2.05238, 1.52229, -0.583468, 0.128693, -0.0158853, 0.000858519)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def transform(a, b, tx, ty) -> Column:
    """A transform from four numbers."""
    return F.struct(*[_col(v).cast("double").alias(n) for v, n in ((a, "A"), (b, "B"), (tx, "TX"), (ty, "TY"))])


def t_identity() -> Column:
    return transform(0.0, 0.0, 0.0, 0.0)


def _parts(t) -> tuple[Column, Column, Column, Column]:
    t = _col(t)
    return t["A"], t["B"], t["TX"], t["TY"]


def t_inverse(t) -> Column:
    """Null where the matrix is singular."""
    a, b, tx, ty = _parts(t)
    p = 1.0 + a
    norm = F.nullif(p * p + b * b, F.lit(0.0))
    return transform(p / norm - 1.0, -b / norm, (-p * tx - b * ty) / norm, (b * tx - p * ty) / norm)


def t_compose(first, second) -> Column:
    """The transform that applies `first` and then `second`."""
    a1, b1, x1, y1 = _parts(first)
    a2, b2, x2, y2 = _parts(second)
    p1, p2 = 1.0 + a1, 1.0 + a2
    return transform(p2 * p1 - b2 * b1 - 1.0, p2 * b1 + b2 * p1, p2 * x1 - b2 * y1 + x2, b2 * x1 + p2 * y1 + y2)


def point(x, y) -> Column:
    return F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y"))


def t_warp(t, x, y) -> Column:
    """Where a point goes, turning about the origin."""
    a, b, tx, ty = _parts(t)
    x, y = _col(x), _col(y)
    return point((1.0 + a) * x - b * y + tx, b * x + (1.0 + a) * y + ty)


def t_warp_center(t, x, y, cx, cy) -> Column:
    """Where a point goes, turning about (cx, cy)."""
    a, b, tx, ty = _parts(t)
    cx, cy = _col(cx), _col(cy)
    x, y = _col(x) - cx, _col(y) - cy
    return point((1.0 + a) * x - b * y + cx + tx, b * x + (1.0 + a) * y + cy + ty)


def p_distance(p, q) -> Column:
    p, q = _col(p), _col(q)
    dx, dy = p["x"] - q["x"], p["y"] - q["y"]
    return F.sqrt(dx * dx + dy * dy)


def _corners(w, h) -> list[tuple[Column, Column]]:
    zero = F.lit(0.0)
    return [(zero, zero), (w, zero), (zero, h), (w, h)]


def max_corner_displacement(t, w, h) -> Column:
    """The farthest that a corner of the w x h image moves, turning about its middle."""
    w, h = _col(w).cast("double"), _col(h).cast("double")
    return F.greatest(*[p_distance(t_warp_center(t, x, y, w * 0.5, h * 0.5), point(x, y)) for x, y in _corners(w, h)])


def step_displacement(t1, t2, w, h) -> Column:
    """The farthest apart that two transforms bring a corner pixel."""
    w, h = _col(w).cast("double"), _col(h).cast("double")
    cx, cy = w * 0.5, h * 0.5
    return F.greatest(*[p_distance(t_warp_center(t1, x, y, cx, cy), t_warp_center(t2, x, y, cx, cy)) for x, y in _corners(w - 1.0, h - 1.0)])


def t_to_affine(t, w, h, center: str = "pixel") -> Column:
    """The 2 x 3 matrix about the origin, as an array of 6, of a transform about the image's middle.

    center: "pixel" for ((w - 1) / 2, (h - 1) / 2), "half" for (w / 2, h / 2).
    """
    a, b, tx, ty = _parts(t)
    less = {"pixel": 1.0, "half": 0.0}[center]
    cx, cy = (_col(w).cast("double") - less) * 0.5, (_col(h).cast("double") - less) * 0.5
    return F.array(1.0 + a, -b, tx - a * cx + b * cy, b, 1.0 + a, ty - b * cx - a * cy)


def t_upscale(t) -> Column:
    """The same motion in an image of twice the size."""
    a, b, tx, ty = _parts(t)
    return transform(a, b, tx * 2.0, ty * 2.0)


def t_from_step(v, w) -> Column:
    """A transform from a solver's step: an array of 4, of which the first two are in units of the image's width."""
    v = _col(v)
    scale = 1.0 / _col(w).cast("double")
    return transform(v[0] * scale, v[1] * scale, v[2], v[3])


def t_to_string(t) -> Column:
    """A=.., B=.., TX=.., TY=.. with six decimals."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), F.format_string("%.6f", F.round(v, 6))) for n, v in zip(("A", "B", "TX", "TY"), _parts(t), strict=True)])


def lanczos2(x) -> Column:
    """The Lanczos-2 weight by its polynomial in x^2, 0 from |x| = 2 on."""
    x = _col(x)
    square, value = x * x, F.lit(LANCZOS2[-1])
    for c in LANCZOS2[-2::-1]:
        value = F.lit(c) + value * square
    return F.when(F.abs(x) >= 2.0, F.lit(0.0)).otherwise(value)


def decay_factor(d, min_disp: float, max_disp: float, min_decay: float, max_decay: float) -> Column:
    """How much of an accumulated motion stays, by its displacement: min_decay up to min_disp, max_decay beyond max_disp."""
    d = _col(d)
    f = (d - min_disp) / ((max_disp - min_disp) or 1.0)
    return F.when(d > max_disp, F.lit(max_decay)).when(d > min_disp, min_decay * (1.0 - f) + max_decay * f).otherwise(F.lit(min_decay))
