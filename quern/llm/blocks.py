"""Texts in numbered blocks, so that several passes can read them and name a row by its block and its place there.

``store`` writes the rows once, compressed, in blocks of about ``BLOCK_BYTES`` of text, a file for each task in the shared
folder; a small table says where each block lies. Later passes move only that table and what refers to it: texts are read
where they are needed and never shuffled, and every row has a name of its own, whatever its doc_id.

Files carry the attempt in their name, and the table, which is checkpointed, holds those of one attempt of each task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checkpoints import fresh
from .text import release, slices, utf8

BLOCK_BYTES, BLOCKS_A_TASK = 1_000_000, 32
REFS = "block long, file string, place long, size long, bytes long"


@dataclass
class Blocks:
    """refs: REFS; schema: of the stored columns; total: bytes of text; tasks: a fitting number of tasks."""

    uri: str
    refs: DataFrame
    schema: T.StructType
    total: int
    tasks: int

    def reader(self) -> Callable[[str, int, int], pa.RecordBatch]:
        uri = self.uri

        def read(file: str, place: int, size: int) -> pa.RecordBatch:
            store, folder = fs.FileSystem.from_uri(uri)
            with store.open_input_file(f"{folder}/{file}") as f:
                data = f.read_at(size, place)
            return pa.ipc.open_stream(data).read_all().combine_chunks().to_batches()[0]

        return read

    def each(self, fn: Callable[[int, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What fn(block, rows) gives for each block."""
        read = self.reader()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, file, place, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield from fn(block, read(file, place, size))
            release()

        return self.refs.select("block", "file", "place", "size").mapInArrow(run, schema)

    def beside(self, more: DataFrame, fn: Callable[[int, Callable[[], pa.RecordBatch], list[tuple]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
        """What fn(block, read, rows) gives for each block, where rows are more's rows of that block (block, part, ..), by part."""
        read = self.reader()
        kinds = dict(more.dtypes)
        others = [c for c in more.columns if c not in ("block", "part")]
        refs = self.refs.select("block", F.lit(-1).cast("long").alias("part"), "file", "place", "size", *(F.lit(None).cast(kinds[c]).alias(c) for c in others))
        none = (F.lit(None).cast(t).alias(c) for c, t in (("file", "string"), ("place", "long"), ("size", "long")))
        rows = refs.union(more.select("block", F.col("part").cast("long"), *none, *others))
        rows = rows.repartition(self.tasks, "block").sortWithinPartitions("block", "part")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, where, held = None, None, []

            def done() -> Iterator[pa.RecordBatch]:
                yield from fn(now, lambda: read(*where), held)

            for batch in batches:
                block, part, file, place, size = (c.to_pylist() for c in batch.columns[:5])
                rest = batch.columns[5:]
                for i, b in enumerate(block):
                    if part[i] < 0:
                        if now is not None:
                            yield from done()
                        now, where, held = b, (file[i], place[i], size[i]), []
                    else:
                        held.append((part[i], *(c[i] for c in rest)))
            if now is not None:
                yield from done()
            release()

        return rows.mapInArrow(run, schema)


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for part in slices(batches, limit=limit):
        own = len(utf8(part.column("text"))[0])
        if held and size + own > limit:
            yield held
            held, size = [], 0
        held.append(part)
        size += own
    if held:
        yield held


def store(docs: DataFrame) -> Blocks:
    """All rows of docs, which have a column text."""
    uri, limit, names = fresh(docs.sparkSession, "blocks"), BLOCK_BYTES, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, out, at, rows = context.partitionId(), None, 0, []
        store, folder = fs.FileSystem.from_uri(uri)
        name = f"{part:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))
        for group in _groups(batches, limit):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, group[0].schema, options=options) as w:
                w.write_table(pa.Table.from_batches(group).combine_chunks())
            data = sink.getvalue()
            if out is None:
                out = store.open_output_stream(f"{folder}/{name}")
            out.write(data)
            rows.append(((part << 32) + len(rows), name, at, data.size, sum(len(utf8(b.column("text"))[0]) for b in group)))
            at += data.size
        if out is not None:
            out.close()
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "file", "place", "size", "bytes"])
        release()

    refs = docs.select(*names).mapInArrow(run, REFS).checkpoint()
    n, total = refs.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return Blocks(uri, refs, docs.schema, total, max(1, min(n, 2 * cores), n // BLOCKS_A_TASK))
