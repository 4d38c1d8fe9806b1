"""Helpers shared by the corpus operators: byte views of text columns, tokens and hashes in NumPy."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
CHUNK_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that no other column of the input can clash."""
    return docs.select(*[docs[c] for c in columns])


def safe_text(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` text bytes; one long text is one piece."""
    buf, offs = text_bytes(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offs, offs[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def tidy(run: Callable) -> Callable:
    """``run``, giving memory back to the system after each task: a worker is kept and serves other stages."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # other C libraries have no such call
            pass

    return wrapped


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string or binary column and the row offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], kind)[column.offset: column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0]: offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


class _Powers:
    """Powers of an odd multiplier modulo 2**64 and of its inverse, grown to the longest chunk met."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            inverse = pow(_MULTIPLIER, -1, 1 << 64)
            self.up, self.down = (np.concatenate([np.ones(1, U), np.full(size - 1, m, U)]).cumprod(dtype=U)
                                  for m in (_MULTIPLIER, inverse))
        return self.up, self.down


POWERS = _Powers()
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer, so that every bit of a hash depends on all of its input."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any byte range follows."""
    up, _ = POWERS.upto(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(BYTE_VALUES[buf] * up[: len(buf)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = POWERS.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 1 for digits, lower-case ASCII letters and every non-ASCII byte.
WORD_CLASS = np.zeros(256, np.uint8)
WORD_CLASS[48:58] = WORD_CLASS[97:123] = 1
WORD_CLASS[128:] = 1


def runs(buf: np.ndarray, offs: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the maximal runs of one non-zero byte class; runs never cross rows."""
    if len(buf) == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    c = classes[buf]
    first = np.empty(len(buf) + 1, bool)
    first[0] = first[-1] = True
    np.not_equal(c[1:], c[:-1], out=first[1:-1])
    first[offs] = True
    edges = np.flatnonzero(first)
    keep = c[edges[:-1]] != 0
    start, end = edges[:-1][keep], edges[1:][keep]
    return start, end, np.searchsorted(offs, start, "right") - 1


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and 64-bit hash of each lower-cased word."""
    low = LOWER[buf]
    start, end, row = runs(low, offs, WORD_CLASS)
    return start, end, row, range_hash(prefix_hash(low), start, end)


def row_offsets(row: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each row's tokens in arrays that are ordered by row."""
    return np.searchsorted(row, np.arange(n + 1))


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [lo, hi): the index of the range and the position, one entry for each position."""
    n = hi - lo
    owner = np.repeat(np.arange(len(lo)), n)
    return owner, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what the given edges connect; the root is the smallest id."""
    if len(a) == 0:
        return a, b
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    child = np.flatnonzero(label != np.arange(len(ids)))
    return ids[child], ids[label[child]]
