"""Helpers shared by the text operators: shared storage, Arrow text buffers and vectorised word hashing."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_dir, stage, unstage  # noqa: F401

_U = np.uint64
WHITESPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_SPAN = 1 << 18


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@functools.cache
def bucket_labels(n: int) -> np.ndarray:
    """For each of n partitions an int that Spark's hash partitioning (Murmur3, seed 42) sends there, so buckets never share one."""
    found: dict[int, int] = {}
    i = 0
    while len(found) < n:
        k = i * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) & 0xFFFFFFFF
        h = 42 ^ (k * 0x1B873593 & 0xFFFFFFFF)
        h = (h << 13 | h >> 19) & 0xFFFFFFFF
        h = (h * 5 + 0xE6546B64 & 0xFFFFFFFF) ^ 4
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        h ^= h >> 16
        found.setdefault((h - (1 << 32) if h >> 31 else h) % n, i)
        i += 1
    return np.array([found[x] for x in range(n)], np.int32)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sampled(share, *columns: str):
    """Whether a row is among about ``share`` of all rows (a number or a Column), by 64 bits of hash: no share is too small."""
    unit = F.xxhash64(*columns).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return unit < share


# --------------------------------------------------------------------------- memory

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def freeing(run):
    """``run``, after which its worker gives memory back to the system: workers stay and serve later stages."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


# --------------------------------------------------------------------------- Arrow text


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, one after the other, and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    kind, width = (np.int64, 8) if large else (np.int32, 4)
    offsets = np.frombuffer(off, kind, len(column) + 1, column.offset * width).astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    data = np.frombuffer(data, np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def doc_slices(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows with at most ``most`` bytes each, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


# --------------------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_RADIX = 0x9E3779B97F4A7C15
with np.errstate(over="ignore"):
    _BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
    _POW = np.concatenate([[_U(1)], np.full(_SPAN, _RADIX, _U)]).cumprod(dtype=_U)
    _INV = np.concatenate([[_U(1)], np.full(_SPAN, pow(_RADIX, -1, 1 << 64), _U)]).cumprod(dtype=_U)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def separators(*codes: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


SPACE = separators(*WHITESPACE)


def word_bounds(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, which end where a row ends, and for each row the range of its words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~sep[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[True], ~inside[:-1]]) | cut[:-1]
    after = np.concatenate([~inside[1:], [True]]) | cut[1:]
    starts = np.flatnonzero(inside & before)
    return starts, np.flatnonzero(inside & after) + 1, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A hash of each word's bytes; A-Z count as a-z if ``lower``."""
    out = np.zeros(len(starts), _U)
    table = _BYTES[LOWER] if lower else _BYTES
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = int(np.searchsorted(ends, at + _SPAN, "right"))
        if j <= i:  # one very long word
            word = data[at : ends[i]]
            out[i] = xxhash.xxh3_64_intdigest((LOWER[word] if lower else word).tobytes())
            i += 1
            continue
        x = table[data[at : ends[j - 1]]]
        x *= _POW[: len(x)]
        p = np.cumsum(x)
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (p[e - 1] - p[s] + x[s]) * _INV[s] + (e - s).astype(_U) * _U(0xA0761D6478BD642F)
        i = j
    return mix(out)


# --------------------------------------------------------------------------- packed arrays


def planes(x: np.ndarray) -> bytes:
    """Byte planes: equal high bytes stand together, which the shuffle's compression removes."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() if len(x) else b""


def unplanes(b, dtype, n: int, at: int = 0) -> np.ndarray:
    k = np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, n * k, at).reshape(k, n).T).view(dtype).ravel()


def by_bucket(bucket: np.ndarray):
    """(bucket, positions) of each bucket that occurs."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(sorted_[a]), order[a:b]
