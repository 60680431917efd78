"""Bit maps of fixed size over 64-bit keys: what is not in one need not be shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits of a map, as a power of two: 2 MB, whatever the data. A full map prunes nothing and changes no result.
BITS = 24
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def place(keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Where the map holds a key."""
    return (keys.view(np.uint64) * _SPREAD) >> np.uint64(64 - bits)


def _pack(seen: np.ndarray) -> bytes:
    return pa.compress(np.packbits(seen).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, bits: int) -> np.ndarray:
    packed = pa.decompress(data, decompressed_size=(1 << bits) // 8, codec="zstd", asbytes=True)
    return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)


def fan_in(df: DataFrame) -> tuple[DataFrame, int]:
    """df in at most four tasks a core, and the number of groups in which their results are merged first.

    What every task sends is of fixed size; fewer tasks send less, and two steps keep what one merging task takes at the
    root of their number.
    """
    tasks = max(4 * df.sparkSession.sparkContext.defaultParallelism, 8)
    groups = max(1, int(tasks**0.5) // 8)
    return df.coalesce(tasks), groups


def bit_map(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """The map of all keys of a one-column table, merged on the executors in two steps."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[place(batch.column(0).to_numpy(), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([_pack(seen)], pa.binary())], ["bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                seen |= _unpack(data, bits)
        yield pa.RecordBatch.from_arrays([pa.array([_pack(seen)], pa.binary())], ["bits"])

    some, groups = fan_in(keys)
    parts = some.mapInArrow(mark, "bits binary").repartition(8 * groups).mapInArrow(merge, "bits binary")
    merged = parts.repartition(1).mapInArrow(merge, "bits binary").first()
    return np.zeros(1 << bits, bool) if merged is None else _unpack(bytes(merged[0]), bits)


def prune(df: DataFrame, key: str, seen: np.ndarray, bits: int = BITS) -> DataFrame:
    """The rows whose key the map holds, and some others."""
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(seen))
    at = df.columns.index(key)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(held[place(batch.column(at).to_numpy(), bits)]))

    return df.mapInArrow(keep, df.schema)
