"""Images: Netpbm and BMP decoded to numpy arrays, resized by area, written as NPY tiles with difference hashes.

Netpbm: P1 to P6 (bits, gray and colour; plain and raw; 8 or 16 bits). BMP: uncompressed, 1, 4, 8, 24 and 32 bits,
bottom-up or top-down. Area resizing takes each output pixel's mean over its exact source rectangle, parts of pixels
included, from an integral image: one pass over the source, whatever the scale.

Defined cases: null content gives nulls and the error "null"; content that is not such an image gives nulls and the
error's text, and the row stays; equal content gives equal values; columns named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from steadyframes.llm.components import new_folder
from steadyframes.llm.textbytes import blocks

PAD = 64
TILE = 16
_TOKEN = re.compile(rb"(?:[ \t\r\n\v\f]|#[^\n]*\n)*([^ \t\r\n\v\f#]+)")
#: Rows of an image that are summed at a time.
STRIP = 4096


def decode_netpbm(data: bytes) -> np.ndarray:
    """Height x width (x 3 where colour), uint8 or uint16; bits as 0 for black and 255 for white."""
    kind, at, head = data[:2], 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m or not m[1].isdigit():
            raise ValueError("bad Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h, top = head[0], head[1], head[2] if len(head) > 2 else 1
    # No header makes more pixels than the data have bits.
    if not 0 < w * h <= 8 * len(data) or not 0 < top < 65536:
        raise ValueError("bad Netpbm size")
    channels = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P1":
        bits = re.sub(rb"#[^\n]*", b"", data[at:])
        v = np.frombuffer(bits, np.uint8)
        v = v[(v == 48) | (v == 49)][: w * h]
        if len(v) < w * h:
            raise ValueError("short Netpbm")
        return ((49 - v) * 255).astype(np.uint8).reshape(h, w)
    if kind in (b"P2", b"P3"):
        try:
            v = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: w * h * channels], np.int64)
        except OverflowError:
            raise ValueError("bad Netpbm values") from None
        if len(v) < w * h * channels or v.min() < 0 or v.max() > top:
            raise ValueError("bad Netpbm values")
        v = v.astype(np.uint8 if top < 256 else np.uint16)
    else:
        at += 1
        if kind == b"P4":
            row = (w + 7) // 8
            v = np.frombuffer(data, np.uint8, row * h, at).reshape(h, row)
            return ((1 - np.unpackbits(v, axis=1)[:, :w]) * 255).astype(np.uint8)
        v = np.frombuffer(data, np.uint8 if top < 256 else ">u2", w * h * channels, at)
        v = v if top < 256 else v.astype(np.uint16)
    return v.reshape((h, w, 3) if channels == 3 else (h, w))


def brightest(data: bytes) -> int:
    """The value of white in what decode gives: a Netpbm header's third number, else 255."""
    if data[:2] not in (b"P2", b"P3", b"P5", b"P6"):
        return 255
    at = 2
    for _ in range(3):
        m = _TOKEN.match(data, at)
        at = m.end()
    return int(m[1])


def encode_pgm(image: np.ndarray) -> bytes:
    """Raw gray Netpbm of 8 bits."""
    h, w = image.shape
    return b"P5\n%d %d\n255\n" % (w, h) + image.astype(np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Height x width for a gray palette, else height x width x 3 in the order red, green, blue."""
    if len(data) < 54 or data[:2] != b"BM":
        raise ValueError("not a BMP")
    start, head = int.from_bytes(data[10:14], "little"), int.from_bytes(data[14:18], "little")
    w, h = int.from_bytes(data[18:22], "little", signed=True), int.from_bytes(data[22:26], "little", signed=True)
    bits, packed = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    if packed not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32) or (packed == 3 and bits not in (16, 32)):
        raise ValueError("BMP of another kind")
    if w <= 0 or h == 0 or w * abs(h) > 8 * len(data):
        raise ValueError("bad BMP size")
    row = (w * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)
    raw = raw[::-1] if h > 0 else raw
    if bits == 16 or packed == 3:
        return _masked(raw[:, : w * bits // 8].copy().view(f"<u{bits // 8}"), data, bits, packed)
    if bits >= 24:
        return raw[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1].copy()
    used = int.from_bytes(data[46:50], "little") or 1 << bits
    palette = np.zeros((1 << bits, 4), np.uint8)
    found = np.frombuffer(data, np.uint8, min(used, 1 << bits) * 4, 14 + head).reshape(-1, 4)
    palette[: len(found)] = found
    if bits == 8:
        index = raw[:, :w]
    elif bits == 4:
        index = np.stack([raw >> 4, raw & 15], 2).reshape(abs(h), -1)[:, :w]
    else:
        index = np.unpackbits(raw, axis=1)[:, :w]
    colour = palette[index][:, :, 2::-1]
    return colour[:, :, 0].copy() if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all() else colour.copy()


def _masked(pixels: np.ndarray, data: bytes, bits: int, packed: int) -> np.ndarray:
    """Red, green and blue by their bit masks, stretched to 255; without masks a pixel of 16 bits has five for each."""
    if packed == 3 and len(data) < 66:
        raise ValueError("short BMP")
    masks = [int.from_bytes(data[k : k + 4], "little") for k in (54, 58, 62)] if packed == 3 else [0x7C00, 0x3E0, 0x1F]
    out = np.zeros((*pixels.shape, 3), np.uint8)
    for k, mask in enumerate(masks):
        if mask >> bits:
            raise ValueError("bad BMP masks")
        if mask:
            low = (mask & -mask).bit_length() - 1
            v = (pixels.astype(np.uint64) & np.uint64(mask)) >> np.uint64(low)
            out[:, :, k] = np.minimum(np.rint(v * (255 / (mask >> low))), 255)
    return out


def decode(data: bytes) -> np.ndarray:
    if data[:1] == b"P" and data[1:2] in b"123456":
        return decode_netpbm(data)
    return decode_bmp(data)


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of an image of any kind, a gray one as it is."""
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def _between(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of running sums at places between rows."""
    low = np.minimum(at.astype(np.int64), len(a) - 2)
    part = (at - low)[:, None]
    return a[low] * (1 - part) + a[low + 1] * part


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of each output pixel's source rectangle, by an integral image read between its corners.

    Of the integral image only the rows about the rectangles' edges are kept; it is summed a strip at a time, so the memory
    of a long image is a strip's.
    """
    h, w = image.shape
    at = np.arange(height + 1) * h / height
    low = np.minimum(at.astype(np.int64), h - 1)
    need = np.unique(np.concatenate([low, low + 1]))
    rows, total = np.zeros((len(need), w)), np.zeros(w)
    for a in range(0, h, STRIP):
        sums = np.cumsum(image[a : a + STRIP], 0, dtype=np.float64)
        here = np.flatnonzero((need > a) & (need <= a + len(sums)))
        rows[here] = total + sums[need[here] - a - 1]
        total = total + sums[-1]
    part = (at - low)[:, None]
    edge = rows[np.searchsorted(need, low)] * (1 - part) + rows[np.searchsorted(need, low + 1)] * part
    whole = np.zeros((w + 1, height + 1))
    np.cumsum(edge.T, 0, out=whole[1:])
    return np.diff(np.diff(_between(whole, np.arange(width + 1) * w / width).T, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 area means is under its right neighbour, row by row, first bit highest."""
    small = np.round(area_resize(image, 8, 9), 6)
    return int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1]).tobytes(), "big")


def npy(tile: np.ndarray) -> bytes:
    """NPY 1.0 bytes of an array."""
    import io

    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tile), version=(1, 0))
    return out.getvalue()


def tiles(df: DataFrame, *, content: str = "content", size: int = 64, tile: int = TILE, keep: bool = False) -> DataFrame:
    """All columns but the content (with keep, all), and a row for each tile of the image resized by area to size x size.

    width, height, dhash (hex), tile_y, tile_x, tile (NPY bytes, uint8), error; one row of nulls and the error where
    content can't be read.
    """
    names = ["width", "height", "dhash", "tile_y", "tile_x", "tile", "error"]
    base = df.drop(*[c for c in df.columns if c in names])
    place = base.columns.index(content)
    kept = [i for i in range(len(base.columns)) if keep or i != place]

    def run(batches):
        for batch in batches:
            take, out = [], []
            for r, data in enumerate(batch.column(place).to_pylist()):
                try:
                    if data is None:
                        raise ValueError("null")
                    image, top = gray(decode(data)), brightest(data)
                    image = image if top == 255 else image * (255 / top)
                    h, w = image.shape
                    hashed = f"{difference_hash(image):016x}"
                    small = np.clip(np.rint(area_resize(image, size, size)), 0, 255).astype(np.uint8)
                    for y in range(0, size, tile):
                        for x in range(0, size, tile):
                            take.append(r)
                            out.append((w, h, hashed, y // tile, x // tile, npy(small[y : y + tile, x : x + tile]), None))
                except ValueError as e:
                    take.append(r)
                    out.append((None, None, None, None, None, None, str(e)))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            rows = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[rows.column(i) for i in kept], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[*[batch.schema.names[i] for i in kept], *names])

    extra = StructType.fromDDL("width int, height int, dhash string, tile_y int, tile_x int, tile binary, error string")
    return base.mapInArrow(run, StructType([base.schema.fields[i] for i in kept] + extra.fields))


def text_media(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each whole text's UTF-8 bytes, padded by 0 to a positive multiple of 64, as a raw gray
    Netpbm image of 64 pixels a row."""

    def run(batches):
        for batch in batches:
            sizes, media = [], []
            for _, _, buf, offsets in blocks(batch.column(1)):
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    image = np.zeros((max(1, -(-(b - a) // PAD)), PAD), np.uint8)
                    image.reshape(-1)[: b - a] = buf[a:b]
                    sizes.append(b - a)
                    media.append(encode_pgm(image))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def store(docs: DataFrame, folder: str) -> None:
    """Write each whole text's media, its difference hash and the NPY tile of its 16 x 16 area means as Parquet."""
    rows = tiles(text_media(docs), content="media", size=TILE, keep=True)
    rows.select("doc_id", "n_bytes", "media", "dhash", "tile").write.option("compression", "zstd").parquet(folder)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_bytes long, media binary, dhash string, tile binary").parquet(folder)


def features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the digests of the stored bytes as read back; feature: difference hash, and the crc32 of the
    NPY tile. Media that can't be decoded, or whose tile or hash isn't the stored one, stop the query."""

    def run(batches):
        for batch in batches:
            out = []
            for data, hashed, tile in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                image = decode(data)
                payload = image.tobytes()
                small = np.clip(np.rint(area_resize(image, TILE, TILE)), 0, 255).astype(np.uint8)
                if npy(small) != tile or f"{difference_hash(image):016x}" != hashed:
                    raise ValueError("stored tile or hash is not its media's")
                feature = f"{hashed}:{zlib.crc32(tile):08x}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def digest(docs: DataFrame) -> DataFrame:
    """The texts as media in files below the checkpoint folder, and the digests of what is read back from there."""
    spark = docs.sparkSession
    folder = new_folder(spark, "media")
    store(docs, folder)
    return features(stored(spark, folder))
