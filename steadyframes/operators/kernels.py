"""Dense image steps in NumPy, used inside Arrow functions. No Spark here; images are height x width arrays."""

from __future__ import annotations

import ctypes
import math
from dataclasses import dataclass

import numpy as np

from steadyframes.functions.params import AlignParams
from steadyframes.functions.transforms import LANCZOS2

Transform = tuple[float, float, float, float]
IDENTITY: Transform = (0.0, 0.0, 0.0, 0.0)

# Each step takes and frees arrays of an image's size. glibc would return their pages each time, to get them cleared at the next
# step; up to 64 MB of them stay with the process.
if hasattr(_libc := ctypes.CDLL(None), "mallopt"):
    _libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    _libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD


def compose(first: Transform, second: Transform) -> Transform:
    a1, b1, x1, y1 = first
    a2, b2, x2, y2 = second
    p, q = 1 + a1, 1 + a2
    return q * p - b2 * b1 - 1, q * b1 + b2 * p, q * x1 - b2 * y1 + x2, b2 * x1 + q * y1 + y2


def inverse(t: Transform) -> Transform:
    a, b, x, y = t
    p = 1 + a
    n = p * p + b * b
    return p / n - 1, -b / n, (-p * x - b * y) / n, (b * x - p * y) / n


def gray(image: np.ndarray) -> np.ndarray:
    """BGR bytes to gray by the fixed-point weights of the long form."""
    if image.ndim == 2:
        return image
    b, g, r = (image[..., k].astype(np.int64) for k in range(3))
    return ((r * 9798 + g * 19235 + b * 3735 + 16384) >> 15).astype(np.uint8)


def half(image: np.ndarray) -> np.ndarray:
    """Half resolution by 1 4 6 4 1 both ways, clamped, truncated."""
    taps = (1, 4, 6, 4, 1)
    h, w = image.shape
    rows = np.pad(image.astype(np.uint16), ((2, 2), (0, 0)), "edge")  # 255 * 256 at most
    tall = sum(c * rows[k : k + 2 * (h // 2) : 2] for k, c in enumerate(taps))
    cols = np.pad(tall, ((0, 0), (2, 2)), "edge")
    return (sum(c * cols[:, k : k + 2 * (w // 2) : 2] for k, c in enumerate(taps)) >> 8).astype(np.uint8)


def pyramid(image: np.ndarray, min_w: int = 20, min_h: int = 20) -> list[np.ndarray]:
    out = [image]
    while out[-1].shape[1] // 2 >= min_w and out[-1].shape[0] // 2 >= min_h:
        out.append(half(out[-1]))
    return out


def gradients(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(image.astype(np.float64), 1, "edge")
    return 0.5 * (p[1:-1, 2:] - p[1:-1, :-2]), 0.5 * (p[2:, 1:-1] - p[:-2, 1:-1])


def tile_size(w: int, h: int, min_tiles: int = 1000, max_tile: int = 20) -> int:
    best = 2
    for i in range(4, max_tile + 1, 2):
        if (w // i) * (h // i) < min_tiles:
            break
        best = i
    return best


def strongest(grad: np.ndarray, tile: int) -> np.ndarray:
    """Places (x, y) of each tile's largest |gradient|, first by rows; tiles row by row."""
    ny, nx = grad.shape[0] // tile, grad.shape[1] // tile
    cells = np.abs(grad[: ny * tile, : nx * tile]).reshape(ny, tile, nx, tile).transpose(0, 2, 1, 3).reshape(ny * nx, tile * tile)
    at = cells.argmax(1)
    ty, tx = np.divmod(np.arange(ny * nx), max(nx, 1))
    return np.stack([tx * tile + at % tile, ty * tile + at // tile], 1)


def jacobians(at: np.ndarray, grad: np.ndarray, axis: str) -> np.ndarray:
    h, w = grad.shape
    u, v = at[:, 0] - w * 0.5, at[:, 1] - h * 0.5
    g = 2.0 * grad[at[:, 1], at[:, 0]]
    s, zero = 1.0 / w, np.zeros(len(at))
    return np.stack([g * u * s, g * -v * s, g, zero], 1) if axis == "x" else np.stack([g * v * s, g * u * s, zero, g], 1)


def lanczos(x: np.ndarray) -> np.ndarray:
    square = x * x
    value = np.full_like(square, LANCZOS2[-1])
    for c in LANCZOS2[-2::-1]:
        value *= square
        value += c
    value[np.abs(x) >= 2.0] = 0.0
    return value


def moved(at: np.ndarray, t: Transform, w: int, h: int, less: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Where t about the image's middle brings points."""
    a, b, x, y = t
    cx, cy = (w - less) * 0.5, (h - less) * 0.5
    return (1 + a) * at[:, 0] - b * at[:, 1] + x - a * cx + b * cy, b * at[:, 0] + (1 + a) * at[:, 1] + y - b * cx - a * cy


#: Places of taps about the floor; the weight of the one at -2 is 0 wherever the point is.
NEAR = np.arange(-1.0, 3.0)[:, None, None]


def widened(image: np.ndarray) -> np.ndarray:
    """The image as numbers with its edge repeated, so that all taps of a point are there."""
    return np.pad(image.astype(np.float64), ((4, 3), (4, 3)), "edge")


def lanczos_sample(image: np.ndarray, wx: np.ndarray, wy: np.ndarray, wide: np.ndarray | None = None) -> np.ndarray:
    """Between 4 x 4 neighbours, clamped at the edges. wide: widened(image), where it is there already."""
    h, w = image.shape
    wide = widened(image) if wide is None else wide
    fx, fy = np.floor(wx), np.floor(wy)
    kx, ky = lanczos(NEAR - np.stack([wx - fx, wy - fy])).swapaxes(0, 1)
    at = ((np.clip(fy, -3, h) + 3) * wide.shape[1] + (np.clip(fx, -3, w) + 3)).astype(np.int64)
    flat, out = wide.reshape(-1), np.zeros_like(wx)
    for j in range(4):
        for i in range(4):
            tap = flat[j * wide.shape[1] + i :].take(at)
            tap *= ky[j]
            tap *= kx[i]
            out += tap
    return out / (ky.sum(0) * kx.sum(0))


def bilinear(image: np.ndarray, wx: np.ndarray, wy: np.ndarray, fill: float | None = None) -> np.ndarray:
    """Between four neighbours; beyond the edge the edge's value, or `fill`. Channels, if any, are kept."""
    h, w = image.shape[:2]
    fx, fy = np.floor(wx).astype(np.int64), np.floor(wy).astype(np.int64)
    out = 0.0
    for dy in (0, 1):
        for dx in (0, 1):
            x, y = fx + dx, fy + dy
            share = np.where(dx, wx - fx, 1 - (wx - fx)) * np.where(dy, wy - fy, 1 - (wy - fy))
            v = image[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)].astype(np.float64)
            if fill is not None:
                there = (x >= 0) & (x < w) & (y >= 0) & (y < h)
                v = np.where(there if v.ndim == share.ndim else there[..., None], v, fill)
            out = out + (share if v.ndim == share.ndim else share[..., None]) * v
    return out


def grid(w: int, h: int) -> np.ndarray:
    y, x = np.divmod(np.arange(w * h), w)
    return np.stack([x, y], 1)


def warp_gray(image: np.ndarray, t: Transform) -> np.ndarray:
    """Each pixel read from where t brings it, clamped at the edges."""
    h, w = image.shape
    return bilinear(image, *moved(grid(w, h), t, w, h, 1.0)).reshape(h, w)


def warp_frame(image: np.ndarray, t: Transform) -> np.ndarray:
    """The content moved by t, same size, 0 where nothing comes from."""
    h, w = image.shape[:2]
    a, b, x, y = inverse(t)
    cx, cy = (w - 1.0) * 0.5, (h - 1.0) * 0.5
    px, py = np.arange(w), np.arange(h)[:, None]
    wx = (1 + a) * px - b * py + x - a * cx + b * cy
    wy = b * px + (1 + a) * py + y - b * cx - a * cy
    fx, fy = np.floor(wx), np.floor(wy)
    wx -= fx
    wy -= fy
    # Two rows and columns of 0 about the image: all that is beyond its edges reads those.
    at = (np.clip(fy.astype(np.int64), -2, h) + 2) * (w + 4) + np.clip(fx.astype(np.int64), -2, w) + 2
    shares = [(dy * (w + 4) + dx, (wx if dx else 1 - wx) * (wy if dy else 1 - wy)) for dy in (0, 1) for dx in (0, 1)]
    done = []
    for plane in [image] if image.ndim == 2 else [image[..., c] for c in range(image.shape[2])]:
        flat, out = np.pad(plane.astype(np.float64), 2).reshape(-1), np.zeros((h, w))
        for off, share in shares:
            out += share * flat[off:].take(at)
        done.append(np.clip(np.rint(out, out=out), 0, 255, out=out).astype(np.uint8))
    return done[0] if image.ndim == 2 else np.stack(done, 2)


def _corner_distance(s: Transform, t: Transform, w: int, h: int) -> float:
    cx, cy, most = w * 0.5, h * 0.5, 0.0
    for px, py in ((0.0, 0.0), (w - 1.0, 0.0), (0.0, h - 1.0), (w - 1.0, h - 1.0)):
        (ax, ay), (bx, by) = (((1 + a) * px - b * py + x - a * cx + b * cy, b * px + (1 + a) * py + y - b * cx - a * cy) for a, b, x, y in (s, t))
        most = max(most, (ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    return math.sqrt(most)


@dataclass
class Keyframe:
    """What alignment needs of a keyframe, by level, whatever the other frame and the parameters."""

    levels: list[np.ndarray]
    points: list[tuple[np.ndarray, np.ndarray]]
    jac: list[tuple[np.ndarray, np.ndarray]]
    wide: list[np.ndarray]

    @classmethod
    def of(cls, levels: list[np.ndarray]) -> Keyframe:
        points, jac = [], []
        for image in levels:
            h, w = image.shape
            tile = tile_size(w, h)
            gx, gy = gradients(image)
            px, py = strongest(gx, tile), strongest(gy, tile)
            points.append((px, py))
            jac.append((jacobians(px, gx, "x"), jacobians(py, gy, "y")))
        return cls(levels, points, jac, [widened(image) for image in levels])


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Shift from a to b by phase correlation, with a centroid about the peak, and the share of energy there."""
    h, w = a.shape
    f = np.fft.fft2(a.astype(np.float64)).conj() * np.fft.fft2(b.astype(np.float64))
    size = np.abs(f)
    c = np.fft.fftshift(np.real(np.fft.ifft2(f / np.where(size > 0, size, 1))))
    y, x = np.unravel_index(c.argmax(), c.shape)
    y0, y1, x0, x1 = max(y - 2, 0), min(y + 3, h), max(x - 2, 0), min(x + 3, w)
    part = np.maximum(c[y0:y1, x0:x1], 0)
    total = part.sum() or 1.0
    yy, xx = np.mgrid[y0:y1, x0:x1]
    return float((xx * part).sum() / total - w // 2), float((yy * part).sum() / total - h // 2), float(c[y0:y1, x0:x1].sum())


def align(key: Keyframe, template: list[np.ndarray], p: AlignParams, current_is_key: bool = True) -> tuple[Transform, bool, list[tuple[int, int, float]]]:
    """The motion from template to keyframe, whether it converged, and (level, iterations, displacement) of each level.

    On failure the motion is what was reached, at the scale of the level that failed.
    """
    t, said = IDENTITY, []
    n = len(key.levels)
    if p.phase_correlate and n >= 3:
        images = (template[2], key.levels[2]) if current_is_key else (key.levels[2], template[2])
        x, y, response = phase_shift(*images)
        if response > p.phase_threshold:
            scale = 2.0 ** (2 - (n - 1 if p.fix_phase_seed else n))
            sign = (1 if current_is_key else -1) * (1 if p.fix_phase_seed else -1)
            t = (0.0, 0.0, sign * x * scale, sign * y * scale)
    for i in range(n - 1, -1, -1):
        image, tmpl, wide = key.levels[i], template[i], key.wide[i]
        h, w = image.shape
        at, jac = [], []
        for points, j in zip(key.points[i], key.jac[i], strict=True):
            delta = np.floor(np.abs(tmpl[points[:, 1], points[:, 0]] - lanczos_sample(image, *moved(points, t, w, h), wide)))
            keep = np.argsort(np.minimum(delta, 32767).astype(np.int16), kind="stable")[: int(np.floor(np.float32(p.smallest_fraction) * np.float32(len(points))))]
            at.append(points[keep])
            jac.append(j[keep])
        at, jac = np.concatenate(at), np.concatenate(jac)
        value = tmpl[at[:, 1], at[:, 0]].astype(np.float64)
        at, jac_t = np.asfortranarray(at, dtype=np.float64), np.ascontiguousarray(jac.T)
        normal = jac.T @ jac
        s = np.linalg.svd(normal, compute_uv=False)
        if s[0] / (s[-1] + 1e-10) > 1e6:
            normal = normal + np.eye(4) * (1e-6 * s[0])
        solve = np.linalg.pinv(normal)
        before = last = t
        for turn in range(p.max_iters):
            step = (solve @ (0.5 * (jac_t @ (value - lanczos_sample(image, *moved(at, t, w, h), wide))))).tolist()
            t = compose((step[0] / w, step[1] / w, step[2], step[3]), t)
            move, last = _corner_distance(t, last, w, h), t
            if move < p.threshold:
                break
        else:
            return t, False, [*said, (i, p.max_iters, _corner_distance(t, before, w, h))]
        total = _corner_distance(t, before, w, h)
        said.append((i, turn + 1, total))
        if total > p.max_displacement:
            return t, False, said
        if i:
            t = (t[0], t[1], t[2] * 2, t[3] * 2)
    return t, True, said


def _edged(x: np.ndarray, r: int, axis: int) -> np.ndarray:
    """The edges along an axis repeated r times."""
    n, at = x.shape[axis], axis % x.ndim
    out = np.empty((*x.shape[:at], n + 2 * r, *x.shape[at + 1 :]))
    _part(out, r, n, axis)[...] = x
    _part(out, 0, r, axis)[...] = _part(x, 0, 1, axis)
    _part(out, r + n, r, axis)[...] = _part(x, n - 1, 1, axis)
    return out


def _part(x: np.ndarray, i: int, n: int, axis: int) -> np.ndarray:
    return x[(slice(None),) * (axis % x.ndim) + (slice(i, i + n),)]


def _moments(x: np.ndarray, g: np.ndarray, axis: int, degree: int) -> list[np.ndarray]:
    """Of neighbours along an axis, clamped: sums weighted by g, by g and the offset, and by g and its square, up to a degree."""
    r, n = len(g) // 2, x.shape[axis]
    p = _edged(x, r, axis)
    out = [g[r] * _part(p, r, n, axis), 0.0, 0.0]
    for o in range(1, r + 1):
        near, far = _part(p, r - o, n, axis), _part(p, r + o, n, axis)
        both = g[r + o] * (near + far)
        out[0] += both
        if degree > 0:
            out[1] = out[1] + (g[r + o] * o) * (far - near)
        if degree > 1:
            out[2] = out[2] + (o * o) * both
    return out[: degree + 1]


def _box_sums(x: np.ndarray, window: int, axis: int) -> np.ndarray:
    """Sums of `window` neighbours along an axis, clamped: out of sums of 1, 2, 4 and so on. Rows stand one after another in
    memory, so a step along the axis is one of a fixed number of places; what runs over a row's end falls where the edge was."""
    edged = _edged(x, window // 2, axis)
    step = edged.strides[axis] // edged.itemsize
    runs, size, sums = edged.reshape(-1), 1, []
    while size <= window:
        sums.append((size, runs))
        if 2 * size <= window:
            runs = runs[: -size * step] + runs[size * step :]
        size *= 2
    total, m, done = np.empty_like(edged), edged.size - (window - 1) * step, 0
    out = total.reshape(-1)[:m]
    for size, runs in reversed(sums):
        if window & size:
            part = runs[done * step : done * step + m]
            if done:
                out += part
            else:
                out[:] = part
            done += size
    return _part(total, 0, x.shape[axis], axis)


def expansion(image: np.ndarray, n: int, sigma: float) -> np.ndarray:
    """Quadratic polynomials x'Ax + b'x about each pixel by weighted least squares: planes of A's xx, yy and xy / 2 and of b's x and y."""
    r = np.arange(-n, n + 1, dtype=float)
    g = np.exp(-r * r / (2 * sigma * sigma))
    g /= g.sum()
    m2, m4 = (g * r**2).sum(), (g * r**4).sum()
    level, slope, bend = _moments(image.astype(np.float64), g, 0, 2)
    one, sx, sxx = _moments(level, g, 1, 2)
    (sy, sxy), (syy,) = _moments(slope, g, 1, 1), _moments(bend, g, 1, 0)
    solve = np.linalg.inv(np.array([[1, m2, m2], [m2, m4, m2 * m2], [m2, m2 * m2, m4]]))
    xx = solve[1, 0] * one + solve[1, 1] * sxx + solve[1, 2] * syy
    yy = solve[2, 0] * one + solve[2, 1] * sxx + solve[2, 2] * syy
    return np.stack([xx, yy, sxy * (0.5 / (m2 * m2)), sx / m2, sy / m2])


def expansions(image: np.ndarray, levels: int = 3, n: int = 5, sigma: float = 1.2) -> list[np.ndarray]:
    """What flow needs of an image, whatever the other one: its expansion at each level."""
    scaled = [image]
    while len(scaled) < levels and min(scaled[-1].shape) >= 32:
        scaled.append(half(np.clip(scaled[-1], 0, 255).astype(np.uint8)))
    return [expansion(a, n // 2, sigma) for a in scaled]


def flow_between(a: list[np.ndarray], b: list[np.ndarray], window: int = 15, turns: int = 3) -> np.ndarray:
    """Dense motion (2: x, y; ..) between two images, given as their expansions, coarse to fine."""
    d, scale = None, float(window) ** 4
    for one, two in zip(a[::-1], b[::-1], strict=True):
        h, w = one.shape[1:]
        if d is None:
            d = np.zeros((2, h, w))
        else:
            y, x = np.minimum(np.arange(h) // 2, d.shape[1] - 1), np.minimum(np.arange(w) // 2, d.shape[2] - 1)
            d = 2 * d.take(y, 1).take(x, 2)
        yy, xx = np.arange(float(h))[:, None], np.arange(float(w))
        for _ in range(turns):
            ty, tx = np.clip(np.rint(yy + d[1]), 0, h - 1), np.clip(np.rint(xx + d[0]), 0, w - 1)
            there = two.reshape(5, -1).take((ty * w + tx).astype(np.int64), 1)
            bx, by = tx - xx, ty - yy
            p, q, r = 0.5 * (one[:3] + there[:3])
            db = 0.5 * (one[3:] - there[3:])
            db[0] += p * bx + r * by
            db[1] += r * bx + q * by
            gs, rr = np.empty_like(one), r * r
            np.add(p * p, rr, out=gs[0])
            np.add(q * q, rr, out=gs[1])
            np.multiply(r, p + q, out=gs[2])
            np.add(p * db[0], r * db[1], out=gs[3])
            np.add(r * db[0], q * db[1], out=gs[4])
            # Sums over windows, not means: the determinant's least value grows alike.
            s = _box_sums(_box_sums(gs, window, 1), window, 2)
            det = s[0] * s[1] - s[2] ** 2 + 1e-9 * scale
            d = np.stack([s[1] * s[3] - s[2] * s[4], s[0] * s[4] - s[2] * s[3]])
            d /= det
    return d


def flow(a: np.ndarray, b: np.ndarray, levels: int = 3, window: int = 15, turns: int = 3, n: int = 5, sigma: float = 1.2) -> np.ndarray:
    """Dense motion from a to b (.., 2: x, y) by polynomial expansion, coarse to fine."""
    return np.moveaxis(flow_between(expansions(a, levels, n, sigma), expansions(b, levels, n, sigma), window, turns), 0, -1)


def upper_median(v: np.ndarray) -> float:
    """Of an even number of values the larger middle one."""
    v = v.reshape(-1)
    return float(np.partition(v, len(v) // 2)[len(v) // 2]) if len(v) else 0.0


def median_of_flow(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """Upper median of the motion's magnitude between two images, given as their expansions."""
    x, y = flow_between(a, b)
    return upper_median(np.sqrt(x * x + y * y))


def flow_median(a: np.ndarray, b: np.ndarray) -> float:
    """The same of the images."""
    return median_of_flow(expansions(a), expansions(b))
