"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tessera.operators.components import Scratch, shared_dir  # noqa: F401

#: Text bytes that one numpy pass looks at; bounds a worker's memory whatever the batch holds.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batch: pa.RecordBatch, column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with about ``budget`` bytes in ``column`` each, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + budget, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def per_slice(function: Callable[[pa.RecordBatch], pa.RecordBatch], column: str) -> Callable:
    """A mapInArrow function that applies ``function`` to bounded slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield function(part)

    return run


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads all bits (splitmix64's finish)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_LONG = 64  # bytes of a word from which on it is hashed by itself


def word_hashes(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of words, and their lengths in bytes. Words of at most eight bytes and one length never share one."""
    _, offsets, data = words.buffers()
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    starts, lengths = ends[:-1], np.diff(ends)
    raw = np.concatenate([np.frombuffer(data or b"", np.uint8)[: ends[-1]], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # from each byte on
    hashes = mixed(lengths.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    left = np.flatnonzero(lengths <= _LONG)
    for at in range(0, _LONG, 8):
        left = left[lengths[left] > at]
        if not len(left):
            break
        over = np.maximum(0, 8 - (lengths[left] - at)).astype(np.uint64) * np.uint64(8)
        hashes[left] = mixed(hashes[left] ^ (eight[starts[left] + at] << over))
    for n in np.flatnonzero(lengths > _LONG):
        hashes[n] = xxhash.xxh3_64_intdigest(raw[starts[n] : ends[n + 1]])
    return hashes, lengths
