"""Shared pieces of the operators on texts: Arrow buffers seen as numpy arrays, words, and exact 64-bit hashes.

All functions work on one slice of a record batch (``slices``), so the memory of a Python worker follows
``SLICE_BYTES`` and the longest single text, not the partition. Null texts read as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are worked on at a time.
SLICE_BYTES = 1 << 20
U = np.uint64
#: Odd multipliers of the polynomial hashes (bytes, words), and of a second family for 128 bits.
BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def no_clash(columns: list[str] | tuple[str, ...], added: list[str]) -> None:
    """Raises if a carried column has the name of one that the operator adds, or comes twice."""
    if bad := sorted(set(columns) & set(added)) or sorted({c for c in columns if list(columns).count(c) > 1}):
        raise ValueError(f"columns called {', '.join(bad)} cannot be carried; rename them")


def with_fields(schema: T.StructType, columns: list[str] | tuple[str, ...], added: str) -> T.StructType:
    """The carried columns' fields, whatever their names, and the added ones, given as DDL."""
    return T.StructType([*(T.StructField(c, schema[c].dataType) for c in columns), *T.StructType.fromDDL(added).fields])


def _field(name: str, of: str = "") -> Column:
    return F.col(of + "`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame) -> DataFrame:
    """text, and a struct own of all other columns: what is carried along goes to Python without a second copy of the texts."""
    rest = [_field(c) for c in docs.columns if c != "text"]
    return docs.select(*([F.struct(*rest).alias("own")] if rest else []), "text")


def unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from rows of ``packed``."""
    return df.select(*(F.col("text") if c == "text" else _field(c, "own.").alias(c) for c in docs.columns))


def as_long(df: DataFrame, column: str) -> DataFrame:
    """df, checked: the operator compares ids as 64-bit integers."""
    kind = dict(df.dtypes)[column]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} is {kind}; ids are whole numbers of up to 64 bits (hash others with xxhash64 first)")
    return df.withColumn(column, F.col(column).cast("long")) if kind != "bigint" else df


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew where its scan has fewer partitions than the session has cores, so that none stands idle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def crc_is(column: str, modulus: int, remainder: int):
    """True where crc32 of the id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == remainder, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads a hash over all 64 bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U) * U(BYTE_BASE))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = 1 << max(10, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(n, b, U)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        have = (out[0], out[1])
        if n <= 1 << 22:
            _powers[base] = have
    return have


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """P with P[i] = sum over j < i of values[j] * base**j."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of each span; equal spans get equal hashes wherever they stand."""
    return mix((p[ends] - p[starts]) * powers(base, len(p))[1][starts])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after the other, and the offsets of their n + 1 borders."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, at = len(column), column.offset
    if not n or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    borders = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[borders[0] : borders[-1]], borders - borders[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice has at most ``limit`` bytes of text, or one row."""
    limit = limit or SLICE_BYTES
    for batch in batches:
        _, borders = utf8(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, min(int(np.searchsorted(borders, borders[at] + limit, "right")) - 1, at + 8192, n))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the texts of a slice.

    start, end: byte positions; of: the row of each word; first: n + 1 borders of the rows' words.
    """

    def __init__(self, data: np.ndarray, borders: np.ndarray, lower: bool = False) -> None:
        if lower:
            data = LOWER[data]
        self.data, self.rows = data, len(borders) - 1
        inside = ~SPACE[data]
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:] = ~inside[:-1]
        after[:-1] = ~inside[1:]
        cut = borders[borders < len(data)]
        before[cut] = True
        after[cut[cut > 0] - 1] = True
        self.start = np.flatnonzero(inside & before)
        self.end = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.start, borders)
        self.of = np.repeat(np.arange(self.rows), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return span_hash(prefix(BYTE_CODE[self.data], BYTE_BASE), self.start, self.end, BYTE_BASE)

    def windows(self, size: int) -> np.ndarray:
        """Positions (as word numbers) at which a window of so many words starts within one row."""
        n = len(self.start)
        if n < size:
            return np.zeros(0, np.int64)
        i = np.arange(n - size + 1)
        return i[self.of[: n - size + 1] == self.of[size - 1 :]]


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each x stands in the sorted values, or -1."""
    if not len(sorted_values):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at, -1)


def release() -> None:
    """Gives memory that a task no longer needs back to the machine, as the worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)


#: What an operator keeps in a worker from task to task: its name, and what drops it.
KEPT: dict[str, Callable[[], None]] = {}


def forget(but: str | None = None) -> None:
    """Drops what other operators keep in this worker, which would otherwise stay beside what the next task needs."""
    if others := [name for name in KEPT if name != but]:
        for name in others:
            KEPT.pop(name)()
        release()


def by_slice(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text", limit: int | None = None, keeps: str | None = None):
    """A function for mapInArrow that applies fn to each slice; keeps: the name in KEPT that the operator goes by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        for part in slices(batches, column, limit):
            out = fn(part)
            if out is not None and out.num_rows:
                yield out
        release()

    return run
