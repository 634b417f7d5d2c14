"""Packed columns and the keyed exchange that several text operators share.

A *chunk* is one row that holds some consecutive documents of a task in packed form (at most `CHUNK_CHARS`
characters, or one document if that is longer). Chunks are pre-aggregated: a key that many documents of a chunk
hold is sent once. Each chunk sends one row per *bucket* of the key space; the task that gets a bucket sees every
chunk's share of it, and answers each chunk with one row in the order of the keys it was sent. A very frequent key
therefore costs one entry per chunk, never one per occurrence, and no task holds more than a bucket or a chunk.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import SparkSession

CHUNK_CHARS = 16_000_000


def bucket_count(spark: SparkSession) -> int:
    """Buckets follow the session's shuffle partitions, which a cluster sets in proportion to its data."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack(values: np.ndarray) -> bytes:
    """Byte planes of a number array, compressed: small numbers have empty planes."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes() if len(values) else b""
    return zstandard.ZstdCompressor(level=3).compress(planes)


def unpack(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all ranges start..start+size, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of every run of equal neighbours."""
    if not len(values):
        return []
    cuts = (np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(values)], strict=True))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions of its keys in the order of `keys`) for every bucket that has keys."""
    of = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(buckets + 1))
    for b in range(buckets):
        if ends[b] < ends[b + 1]:
            yield b, order[ends[b] : ends[b + 1]]


def chunked(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[dict]]]:
    """(chunk id, rows) of a task. The id is made of the task's partition and a running number."""
    base, number = TaskContext.get().partitionId() << 24, 0
    rows: list[dict] = []
    held = 0
    for batch in batches:
        for row in (row for at in range(0, batch.num_rows, 256) for row in batch.slice(at, 256).to_pylist()):
            row[text] = row[text] or ""
            rows.append(row)
            held += len(row[text]) + 64
            if held >= limit:
                yield base + number, rows
                rows, held, number = [], 0, number + 1
    if rows:
        yield base + number, rows


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, as UTF-8: bytes know just these white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def at_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass batches on; when a task ends, give its memory back to the system: workers live on beside the next stage."""
    yield from batches
    give_back()


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)
