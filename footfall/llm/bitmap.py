"""A set of 64-bit hashes as a bitmap of fixed size, which lets some others through."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = 1 << 27
SLICE = 1 << 20  # bytes


class Packed:
    """A large array that travels compressed; most of its places are alike."""

    def __init__(self, array: np.ndarray):
        self.array = array

    def __getstate__(self):
        return zlib.compress(self.array.tobytes(), 1), self.array.dtype.str, self.array.shape

    def __setstate__(self, state):
        data, kind, shape = state
        size = int(np.prod(shape)) * np.dtype(kind).itemsize  # known, so it isn't put together twice
        self.array = np.frombuffer(zlib.decompress(data, bufsize=max(1, size)), kind).reshape(shape)


def marks(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the bitmap for each hash."""
    h = hashes.view(np.uint64)
    return ((h & np.uint64(MARKS - 1)).astype(np.int64),
            (h >> np.uint64(32) & np.uint64(MARKS - 1)).astype(np.int64))


def bitmap(hashes: DataFrame) -> Packed:
    """The bitmap of all ``hashes``, a column of longs; of fixed size, so it may be sent around."""
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(MARKS >> 3, np.uint8)
        for batch in batches:
            for at in marks(batch.column(0).to_numpy()):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for i in range(0, len(bits), SLICE):
            if (part := bits[i:i + SLICE]).any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i // SLICE], pa.int32()),
                     pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["slice", "bits"])

    def joined(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLICE, np.uint8)
        for frame in rows:
            for bits in frame["bits"]:
                total |= np.frombuffer(zlib.decompress(bits), np.uint8)
        yield pd.DataFrame({"slice": [key[0]], "bits": [zlib.compress(total.tobytes(), 1)]})

    schema = "slice int, bits binary"
    parts = hashes.mapInArrow(marked, schema).withColumn("turn", F.spark_partition_id() % 64)
    parts = parts.groupBy("slice", "turn").applyInPandas(joined, schema)
    out = np.zeros(MARKS >> 3, np.uint8)
    for row in parts.groupBy("slice").applyInPandas(joined, schema).toLocalIterator():
        out[row.slice * SLICE:(row.slice + 1) * SLICE] = np.frombuffer(
            zlib.decompress(row.bits), np.uint8)
    return Packed(out)


def marked(found: Packed, hashes: np.ndarray) -> np.ndarray:
    """Which ``hashes`` may be in the set."""
    bits, (a, b) = found.array, marks(hashes)
    return (bits[a >> 3] >> (a & 7) & 1 & (bits[b >> 3] >> (b & 7))).astype(bool)
