"""WARC archives: a deterministic sharded writer and the reader of what it committed.

1. Shards are ranges of page_id, cut where the running sum of payloads in the ids' order passes a multiple of ``shard_bytes``.
   The sum is exact (sorted by range, one sum a partition comes to the driver), so the same rows give the same shards however
   they are partitioned and however the ids are spread. Rows without an id go to shards of their own, by digest.
2. Equal payloads (SHA-1, at least ``min_bytes`` long): the smallest page_id is the response, the others revisit it. Ids
   are pre-aggregated by digest and joined back without the payloads, which are shuffled once, to their shard.
3. Each shard is sorted by page_id and written in one pass: one gzip member a record, headers and digests made anew, a new
   file whenever the compressed size reaches ``roll_bytes``. Files are written under a temporary name of the attempt and
   renamed when complete; a repeated or speculative attempt makes the same bytes. The list of files (records, bytes,
   SHA-256) is the manifest, written last through Spark's committer; a reader sees only what a committed manifest names.

Files go through ``pyarrow.fs`` to a folder that driver and executors share (a file:, hdfs:, s3: or gs: URI).

Defined cases: a null html is an empty payload; a null url gives no WARC-Target-URI; line breaks in a url are
percent-encoded. A null page_id is the response only if no row with an id has its payload. Rows that
share id and payload are all responses if theirs is the smallest id, else all revisits; they lie in one shard. An empty table gives a manifest
without files. Extra columns stay out. Ids are whole numbers of up to 64 bits; others raise an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import checkpoints
from .checkpoints import fresh
from .text import as_long, table

SHARD_BYTES, ROLL_BYTES = 32 << 20, 8 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID(int=0x51AEC0DE)
MANIFEST = "shard int, file string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, ordinal: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}:{ordinal}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, ordinal: int) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, ordinal)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}", f"Refers-To-Page-ID: {first}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _size() -> Column:
    return F.sum((F.coalesce(F.octet_length("html"), F.lit(0)) + 600).cast("long"))  # 600: headers


def shard_starts(pages: DataFrame, shard_bytes: int) -> np.ndarray:
    """The first page_id of each shard but the first: as many as the payloads' bytes over shard_bytes, at most."""
    sizes = pages.where("page_id is not null").groupBy("page_id").agg(_size().alias("size")).orderBy("page_id").checkpoint()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = last = 0
        for b in batches:
            if b.num_rows:
                size = b.column("size").to_numpy()
                total, last = total + int(size.sum()), int(size[-1])
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (TaskContext.get().partitionId(), total, last)], ["part", "total", "last"])

    before, at, last = {}, 0, 0
    for part, total, own in sorted(tuple(r) for r in sizes.mapInArrow(ends, "part long, total long, last long").collect()):  # a row a partition
        before[part] = at, at - last
        at, last = at + total, own if total else last

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, previous = before[TaskContext.get().partitionId()]
        for b in batches:
            if b.num_rows:
                done = start + np.cumsum(b.column("size").to_numpy())
                own = np.r_[start, done[:-1]]  # where each id begins
                new = own // shard_bytes > np.r_[previous, own[:-1]] // shard_bytes
                start, previous = int(done[-1]), int(own[-1])
                yield pa.RecordBatch.from_arrays([b.column("page_id").filter(pa.array(new))], ["page_id"])

    rows = sizes.mapInArrow(cuts, "page_id long").toPandas()
    return np.sort(rows["page_id"].to_numpy(np.int64))


class _File:
    """A file under a temporary name; close() gives it its own."""

    def __init__(self, store: fs.FileSystem, folder: str, name: str) -> None:
        self.store, self.name, self.path = store, name, f"{folder}/{name}"
        self.temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.out, self.sha, self.bytes, self.records = store.open_output_stream(self.temporary), hashlib.sha256(), 0, 0

    def write(self, raw: bytes) -> None:
        member = gzip.compress(raw, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        self.store.move(self.temporary, self.path)
        return self.name, self.records, self.bytes, self.sha.hexdigest()


def _writer(uri: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(uri)
        file, shard, number, now, firsts, same = None, None, 0, None, {}, {}

        def closed() -> pa.RecordBatch:
            row = (shard, *file.close())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["shard", "file", "records", "bytes", "sha256"])

        for batch in batches:
            for lo in range(batch.num_rows):  # a row at a time: one payload in memory besides the batch
                s, page_id, kind, digest, first, url, html = (c[lo].as_py() for c in batch.columns)
                if s != shard:
                    if file:
                        yield closed()
                    file, shard, number, now = None, s, 0, None
                if now != (page_id,):
                    now, firsts, same = (page_id,), {}, {}
                if kind == 0:
                    firsts[digest] = first
                    continue
                payload = (html or "").encode()
                digest = base64.b32encode(bytes(digest)).decode()
                first = firsts.get(base64.b32decode(digest))
                same[digest] = ordinal = same.get(digest, -1) + 1
                if not file:
                    file = _File(store, folder, f"part-{shard:06d}-{number:05d}.warc.gz")
                    number += 1
                file.write(record(page_id, url, payload, digest, first, first is not None, ordinal))
                if file.bytes >= roll_bytes:
                    yield closed()
                    file = None
        if file:
            yield closed()

    return run


def write(pages: DataFrame, uri: str, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) to the folder, commits the manifest there, and returns it."""
    spark = pages.sparkSession
    checkpoints.folder(spark)
    pages = as_long(pages, "page_id")
    store, folder = fs.FileSystem.from_uri(uri)
    store.create_dir(folder)
    starts = shard_starts(pages, shard_bytes)
    nameless = pages.where("page_id is null").agg(_size()).first()[0] or 0
    first = -(-nameless // shard_bytes)  # shards of rows without an id
    shared = spark.sparkContext.broadcast(starts)

    @F.pandas_udf("int")
    def ranged(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        return pd.Series(np.where(known, np.searchsorted(shared.value, ids.where(known, 0).astype("int64"), "right") + first, -1).astype("int32"))

    digest = F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    keyed = pages.select("page_id", digest.alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size")).where(F.col("size") >= min_bytes)
    # written first, so that both sides of the join are plain shuffles, of which Spark splits the large partitions
    least = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first").checkpoint()
    again = keyed.select("page_id", "digest").join(least, "digest").where("page_id is null or page_id <> first")
    def number(digest: Column) -> Column:
        return F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64(digest), F.lit(max(1, first))).cast("int")).otherwise(ranged(F.coalesce("page_id", F.lit(0)))).alias("shard")

    rows = again.select(number(F.col("digest")), "page_id", F.lit(0).alias("kind"), "digest", "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    rows = rows.union(pages.select(number(digest), "page_id", F.lit(1), digest, F.lit(None).cast("long"), "url", "html"))
    rows = rows.repartitionById(len(starts) + 1 + first, "shard").sortWithinPartitions("shard", "page_id", "kind", "digest", "url")
    rows.mapInArrow(_writer(uri, roll_bytes), MANIFEST).write.json(f"{uri}/manifest")
    return spark.read.schema(MANIFEST).json(f"{uri}/manifest")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    held, inflate, out = b"", zlib.decompressobj(31), io.BytesIO()
    while True:
        held = held or stream.read(1 << 20)
        if not held:
            return
        out.write(inflate.decompress(held))
        held = b""
        if inflate.eof:
            held = inflate.unused_data
            yield out.getvalue()
            inflate, out = zlib.decompressobj(31), io.BytesIO()


def parse(raw: bytes) -> tuple:
    """A record's page_id, url, payload_bytes, payload_digest, type, refers_to and payload; digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.decode().split("Content-Length: ")[1].split("\r\n")[0])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("Page-ID"), fields.get("WARC-Target-URI"), size, digest, kind, number("Refers-To-Page-ID"), payload if kind == "response" else None


def read(spark: SparkSession, uri: str, payloads: bool = True) -> DataFrame:
    """The records of all files that the folder's manifest names (RECORD; payload only if asked for)."""
    manifest = spark.read.schema(MANIFEST).json(f"{uri}/manifest")
    n = max(1, manifest.count())
    schema = RECORD if payloads else RECORD.rpartition(", ")[0]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())[: None if payloads else 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, records in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, held, seen = [], 0, 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        rows.append(parse(raw))
                        seen += 1
                        held += len(raw) * payloads + 200
                        if held > 4 << 20:
                            yield _batch(rows, kinds, schema)
                            rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{name} has {seen} records, its manifest {records}")
                if rows:
                    yield _batch(rows, kinds, schema)

    return manifest.select("file", "records").repartition(min(n, 10_000), "file").mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in schema.split(", ")])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = fresh(spark, "warc")
    write(table(spark, sf_dir, "pages"), uri)
    return read(spark, uri, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


SQL = {
    "op7_warc": r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, upper(sha1(html)) AS hex, min(page_id) OVER (PARTITION BY html) AS least FROM p),
x AS (SELECT *, list_transform(range(0, 8), lambda i: (position(hex[5 * i + 1] IN '0123456789ABCDEF') - 1) * 65536 + (position(hex[5 * i + 2] IN '0123456789ABCDEF') - 1) * 4096
  + (position(hex[5 * i + 3] IN '0123456789ABCDEF') - 1) * 256 + (position(hex[5 * i + 4] IN '0123456789ABCDEF') - 1) * 16 + position(hex[5 * i + 5] IN '0123456789ABCDEF') - 1) AS v FROM d)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v[j // 4 + 1] // [32768, 1024, 32, 1][j % 4 + 1]) % 32 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to, url
FROM x"""
}
QUERIES = {"op7_warc": op7_warc}
