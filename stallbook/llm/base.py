"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of all operators here: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
#: The same class for DuckDB's regular expressions.
WORD_SQL = r"[^\x20\x09-\x0D]+"

#: Bits of the smallest filter that goes to the tasks: 1 MiB.
FILTER_BITS = 1 << 23

#: Texts are handled in slices of about this many bytes, so that memory follows the longest text and not the batch.
SLICE_BYTES = 1 << 20


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, also where body names it inside loops over arrays."""
    return F.element_at(F.transform(F.array(value), body), 1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after the other, and the n + 1 borders; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    borders = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[borders[0]:borders[-1]], borders - borders[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of a slice have at most `most` bytes or are a single text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = utf8(batch.column(text))[1][1:]
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(ends, done + most, "right")), at + 1)
            yield batch.slice(at, to - at)
            at, done = to, int(ends[to - 1])
    pa.default_memory_pool().release_unused()  # the worker may sit idle next
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_GAP = np.zeros(256, bool)
_GAP[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of the texts starts and ends, and how many words lie before each border."""
    inside = ~_GAP[data]
    first = np.zeros(len(data) + 1, bool)
    first[borders] = True
    starts = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return starts, ends, np.searchsorted(starts, borders, "left")


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (the finaliser of a common public generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    powers = np.cumprod(np.full(int(sizes.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    parts = (data[np.repeat(starts, sizes) + at].astype(np.uint64) + np.uint64(1)) * powers[at]
    return mix(np.add.reduceat(parts, np.cumsum(sizes) - sizes))


def filter_bits(n: int) -> int:
    """Bits of a filter of n hashes: 16 a hash, which lets one other in a hundred pass; 1 MiB at least, 16 MiB at most."""
    return min(max(1 << (16 * n).bit_length(), FILTER_BITS), FILTER_BITS << 4)


def hash_filter(hashes: DataFrame, n_bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of n_bits bits, two for each hash, built by an aggregate of at most n_bits / 32 rows."""
    probes = F.array(F.col("hash").bitwiseAND(n_bits - 1), F.shiftrightunsigned("hash", 32).bitwiseAND(n_bits - 1))
    bits = hashes.select(F.explode(probes).alias("at")).select(F.shiftright("at", 5).alias("word"), F.expr("shiftleft(1L, cast(at & 31 as int))").alias("bit"))
    rows = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    parts = np.zeros(n_bits // 32, np.uint32)
    parts[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return parts


def passes(parts: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Where the values may be in the filter."""
    mask = np.uint64(32 * len(parts) - 1)
    at = np.arange(len(value))
    for shift in (0, 32):
        bit = ((value[at] >> np.uint64(shift)) & mask).astype(np.int64)
        at = at[((parts[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1)).astype(bool)]
    return at
