"""Counts of hashed values in a fixed number of counters, summed on Spark: a task's counters go out in packed chunks.

The size is a parameter and doesn't grow with the input; more input fills the counters more. Defined cases: no rows give
zeros, repeated values count as often as they stand.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from steadyframes.llm.textbytes import mix

CHUNKS = 256


def add(total: np.ndarray, places: np.ndarray) -> None:
    """Count places in int32 counters, in place."""
    at, n = np.unique(places.astype(np.int64), return_counts=True)
    total[at] += n.astype(np.int32)


def packed(total: np.ndarray) -> list[tuple[int, bytes]]:
    """(chunk, bytes) of the chunks that have counts."""
    parts = total.reshape(CHUNKS, -1)
    return [(c, zlib.compress(parts[c].tobytes(), 1)) for c in range(CHUNKS) if parts[c].any()]


def gathered(packs: DataFrame, bits: int) -> np.ndarray:
    """The sums, to a sixth of their size, of packs with `chunk` and `counts`: a byte a counter comes to the driver."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = np.frombuffer(zlib.decompress(x), np.int32)
                sums[c] = sums[c] + one if c in sums else one.astype(np.int64)
        logs = [np.minimum(np.rint(4 * np.log2(1 + x)), 255).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(logs, pa.binary())], names=["chunk", "logs"])

    out = np.zeros((CHUNKS, (1 << bits) // CHUNKS), np.float64)
    for row in packs.select("chunk", "counts").repartition("chunk").mapInArrow(run, "chunk int, logs binary").collect():  # CHUNKS rows
        out[row.chunk] = 2 ** (np.frombuffer(row.logs, np.uint8) / 4) - 1
    return out.reshape(-1)


def _place(values: np.ndarray, bits: int) -> np.ndarray:
    return mix(values.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)


def places(values: DataFrame, bits: int) -> np.ndarray:
    """A bit for each place on which a value of the only column falls."""

    def run(batches):
        total = np.zeros(1 << bits, np.int32)
        for batch in batches:
            total[_place(np.array(batch.column(0)), bits).astype(np.int64)] = 1
        chunk, counts = zip(*packed(total), strict=True) if total.any() else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(counts, pa.binary())], names=["chunk", "counts"])

    return np.packbits(gathered(values.mapInArrow(run, "chunk int, counts binary"), bits) > 0)


def there(bits: np.ndarray, values: np.ndarray) -> pa.Array:
    """Which values may be among those whose places were taken."""
    at = _place(values, (len(bits) * 8 - 1).bit_length()).astype(np.int64)
    return pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))
