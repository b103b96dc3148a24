"""Sequences of unsigned 64-bit numbers in headerless little-endian files.

Spark has no such type: a value v is the BIGINT ``k`` = v with its top bit flipped, whose signed order is v's unsigned
order. ``shown`` gives it as DECIMAL(20,0). Files are read in parts of ``PART`` values by offset through ``pyarrow.fs``,
so a large file is many tasks. Bytes after the last whole value are ignored. A sequence may also be a folder of such files,
as ``write_u64`` leaves it: its ``MANIFEST`` has the parts in order and their numbers of values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART = 1 << 20
_BATCH = 1 << 16
_FLIP = np.uint64(1 << 63)


def flip(values: np.ndarray) -> np.ndarray:
    """uint64 to ordered int64."""
    return (values ^ _FLIP).view(np.int64)


def unflip(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.uint64) ^ _FLIP


def shown(key: Column) -> Column:
    return (key.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def parts_of(path: str) -> list[tuple[str, int]]:
    """The files of a sequence, in order, and how many values each has."""
    store, name = _place(path)
    info = store.get_file_info(name)
    if info.is_file:
        return [(path, info.size // 8)]
    if not store.get_file_info(f"{name}/MANIFEST").is_file:
        raise FileNotFoundError(path)
    with store.open_input_stream(f"{name}/MANIFEST") as f:
        rows = [line.split() for line in f.read().decode().splitlines()]
    return [(f"{path}/{part}", int(n)) for part, n in rows]


def count(path: str) -> int:
    return sum(n for _, n in parts_of(path))


@dataclass
class _Part(InputPartition):
    path: str
    first: int
    at: int
    n: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, part: int) -> None:
        self.path, self.part = path, part

    def partitions(self) -> list[InputPartition]:
        out, first = [], 0
        for path, n in parts_of(self.path):
            out += [_Part(path, first, at, min(self.part, n - at)) for at in range(0, n, self.part)]
            first += n
        return out or [_Part(self.path, 0, 0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.n:
            return
        store, name = _place(partition.path)
        end = partition.at + partition.n
        with store.open_input_file(name) as f:
            for at in range(partition.at, end, _BATCH):
                values = np.frombuffer(f.read_at(8 * min(_BATCH, end - at), 8 * at), "<u8")
                places = np.arange(partition.first + at, partition.first + at + len(values))
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(flip(values))], ["place", "k"])


class U64Source(DataSource):
    """format("u64"): place BIGINT, k BIGINT."""

    @classmethod
    def name(cls) -> str:
        return "u64"

    def schema(self) -> str:
        return "place bigint, k bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("part", PART)))


def read_u64(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """place (from 0) and k of all values of a file."""
    spark.dataSource.register(U64Source)
    return spark.read.format("u64").option("part", part).load(path)


def write_u64(df: DataFrame, path: str, single: bool = False) -> int:
    """Writes column k in the order of df's partitions and rows; the number of values.

    Each partition becomes a part in the folder ``path``, under a temporary name until it is whole, and the manifest, written
    last, names those of this run; what the folder held before goes. With single the driver puts the parts together in one
    file instead, which is for files that one machine can write.
    """
    store, name = _place(path)
    folder = f"{name}.parts" if single else name
    store.create_dir(folder)
    store.delete_dir_contents(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, n = f"{folder}/part-{context.partitionId():06d}", 0
        temporary = f"{folder}/.part-{context.partitionId():06d}.{context.taskAttemptId()}"
        target = _place(path)[0]
        with target.open_output_stream(temporary) as f:
            for b in batches:
                f.write(unflip(b.column(0).to_numpy()).astype("<u8").tobytes())
                n += b.num_rows
        target.move(temporary, part)
        yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()]), pa.array([n])], ["part", "n"])

    done = sorted(tuple(r) for r in df.select("k").mapInArrow(run, "part bigint, n bigint").collect())  # a row a partition
    if single:
        with store.open_output_stream(name) as out:
            for number, n in done:
                with store.open_input_stream(f"{folder}/part-{number:06d}") as f:
                    left = 8 * n
                    while left:
                        block = f.read(min(left, 1 << 22))
                        out.write(block)
                        left -= len(block)
        store.delete_dir(folder)
    else:
        with store.open_output_stream(f"{folder}/.MANIFEST") as out:
            out.write("".join(f"part-{number:06d} {n}\n" for number, n in done).encode())
        store.move(f"{folder}/.MANIFEST", f"{folder}/MANIFEST")
    return sum(n for _, n in done)


def external_sort(spark: SparkSession, source: str, target: str, single: bool = False) -> int:
    """Sorts a sequence's values, ascending and unsigned, repeats kept; the number of values. Memory is Spark's to manage."""
    return write_u64(read_u64(spark, source).select("k").orderBy("k"), target, single)


def sorted_in_order(df: DataFrame) -> bool:
    """Whether column k never falls along column place, where each partition holds a run of consecutive places.

    Partitions are checked on their own; the driver compares their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = low = None
        ok = True
        for b in batches:
            if b.num_rows:
                k, place = b.column("k").to_numpy(), b.column("place").to_numpy()
                ok = ok and bool((k[1:] >= k[:-1]).all()) and (last is None or last <= k[0])
                if first is None:
                    first, low = int(k[0]), int(place[0])
                last = int(k[-1])
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (low, first, last, ok)], ["place", "first", "last", "ok"])

    ends = sorted(tuple(r) for r in df.select("place", "k").mapInArrow(run, "place bigint, first bigint, last bigint, ok boolean").collect())
    return all(e[3] for e in ends) and all(a[2] <= b[1] for a, b in zip(ends, ends[1:], strict=False))


def is_sorted(spark: SparkSession, path: str) -> bool:
    return sorted_in_order(read_u64(spark, path))


def xorshift(n: int, seed: int = 88172645463325252) -> Iterator[int]:
    """n pseudo-random 64-bit numbers (shifts 13, 7, 17; the values of fixture files)."""
    x, whole = seed, (1 << 64) - 1
    for _ in range(n):
        x ^= x << 13 & whole
        x ^= x >> 7
        x ^= x << 17 & whole
        yield x


def generate(path: str, n: int) -> None:
    """A file of the first n of them."""
    store, name = _place(path)
    with store.open_output_stream(name) as out:
        block: list[int] = []
        for x in xorshift(n):
            block.append(x)
            if len(block) == _BATCH:
                out.write(np.array(block, "<u8").tobytes())
                block = []
        out.write(np.array(block, "<u8").tobytes())
