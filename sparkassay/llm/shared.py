"""Places and small helpers that all operators of this subpackage use."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch as materialize
from ..sources.scratch import scratch_path, shared_dir

#: Bytes of text that a numpy kernel takes at a time; it bounds a worker's memory whatever the Arrow batch holds.
SLICE_BYTES = 1 << 20

__all__ = ["ALNUM", "SPACED", "Texts", "Words", "by_row", "code_points", "documents", "lowered", "map_rows", "materialize", "mix", "only", "partitions", "released", "row_ids", "scratch_path", "shared_dir", "span_hash"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone: further columns, clashing names included, never enter a plan."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def _trim() -> None:
    """Gives memory that is free inside the process back to the machine; what numpy and Arrow have freed may stay with their allocators otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker, which goes on to other tasks, holds no free memory."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _trim()

    return whole


def map_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *more: tuple[str, T.DataType]) -> DataFrame:
    """``docs`` mapped by ``run``, which keeps its columns in place and may add ``more``. Columns go by place, so any names do, also dotted or repeated ones."""
    fields = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)] + [T.StructField(*x) for x in more]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, [f.name for f in fields])
        _trim()

    plain = docs.toDF(*[f.name for f in fields[: len(docs.columns)]])
    return plain.mapInArrow(named, T.StructType(fields)).toDF(*docs.columns, *[name for name, _ in more])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Texts:
    """A string column as one byte buffer; null texts are empty. ``offs`` has n + 1 byte offsets."""

    __slots__ = ("buf", "null", "offs")

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary())
        n = len(column)
        self.null = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else np.zeros(n, bool)
        offs = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        if self.null.any() and (np.diff(offs)[self.null] > 0).any():  # a null may own bytes
            size = np.where(self.null, 0, np.diff(offs))
            raw = np.concatenate([raw[a : a + k] for a, k in zip(offs[:-1], size)] or [raw[:0]])
            offs = np.concatenate([[0], np.cumsum(size)])
        self.buf, self.offs = raw[offs[0] : offs[-1]], offs - offs[0]

    def __len__(self) -> int:
        return len(self.offs) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()

    def slices(self, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, bytes, offsets) of runs of whole rows of about ``limit`` bytes; a longer row comes alone."""
        at, n = 0, len(self)
        while at < n:
            to = int(np.searchsorted(self.offs, self.offs[at] + limit, "right")) - 1
            to = min(n, max(at + 1, to))
            yield at, to, self.buf[self.offs[at] : self.offs[to]], self.offs[at : to + 1] - self.offs[at]
            at = to


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words split at ASCII white space, and of words of letters and digits; bytes over 127 belong to words in both.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_CHUNK_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def span_hash(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes. Runs of eight bytes are each mixed with their place before they are summed, so unlike a polynomial's, no pattern of bytes cancels out."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    with np.errstate(over="ignore"):
        salt = mix(np.array([seed], np.uint64) + _P)[0]
        count = np.maximum(1, -(-sizes // 8))
        if int(count.max()) == 1:
            return mix(mix((eight[starts] & _CHUNK_MASK[sizes]) ^ mix(salt + np.zeros(1, np.uint64))) + sizes.astype(np.uint64) * _P)
        cut = np.cumsum(count) - count
        inside = np.arange(int(count.sum())) - np.repeat(cut, count)
        value = eight[np.repeat(starts, count) + 8 * inside] & _CHUNK_MASK[np.minimum(8, np.repeat(sizes, count) - 8 * inside)]
        return mix(np.add.reduceat(mix(value ^ mix(salt + inside.astype(np.uint64))), cut) + sizes.astype(np.uint64) * _P)


class Words:
    """The words of a slice: byte starts and ends, row, and a 64-bit hash of each; words never span rows."""

    __slots__ = ("ends", "first", "hash", "row", "starts")

    def __init__(self, buf: np.ndarray, offs: np.ndarray, member: np.ndarray = SPACED, lower: bool = True, hashed: bool = True):
        mask = member[buf]
        n = len(buf)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = mask[:-1], mask[1:]
        full = offs[1:] > offs[:-1]
        before[offs[:-1][full]] = False
        after[offs[1:][full] - 1] = False
        begins = mask & ~before
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(mask & ~after) + 1
        self.row = np.searchsorted(offs, self.starts, "right") - 1
        #: for each row its first word; one more than rows
        self.first = np.searchsorted(self.starts, offs)
        self.hash = np.zeros(0, np.uint64)
        if hashed and len(self.starts):
            self.hash = span_hash(_LOWER[buf] if lower else buf, self.starts, self.ends - self.starts)

    def __len__(self) -> int:
        return len(self.starts)


def lowered(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of UTF-8 bytes, how many begin before each byte and in all). Bytes that are no UTF-8 give some code point; none is lost."""
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    cps = buf[at].astype(np.int32)
    wide = np.flatnonzero(cps > 0x7F)  # few in most texts
    if len(wide):
        padded = np.concatenate([buf, np.zeros(3, np.uint8)])
        a = cps[wide]
        b, c, d = ((padded[at[wide] + k] & 63).astype(np.int32) for k in (1, 2, 3))
        cps[wide] = np.minimum(0x10FFFF, np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d)))
    return cps, np.concatenate([[0], np.cumsum(lead)])


def row_ids(column: pa.Array) -> pa.Array:
    return column.cast(pa.int64())


def by_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums of integer ``values`` for each of ``n`` rows."""
    return np.bincount(row, weights=values, minlength=n).astype(np.int64) if len(values) else np.zeros(n, np.int64)
