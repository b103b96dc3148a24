"""Suffix-array dedup of bytes: removes each byte covered by a string of ``length`` bytes that also starts anywhere else.

The suffixes are ordered by most-significant-digit passes through ``length`` bytes only; groups of one are dropped after
each pass, and the groups that are left at full depth are exactly the repeated strings.

1. First digit: the smallest hashed ``GRAM``-byte string within the window (its anchor, the first one on ties). Equal
   windows have equal anchors at equal places, and neighbouring windows mostly share an anchor, so one row stands for a
   stretch of about fifty suffixes. A count-min sketch (``sketch.py``) of the anchors drops those that occur once. The
   anchor only deals suffixes out; what decides are the other bytes.
2. The stretches left meet by anchor, with the bytes around it. Where the bytes around all anchors of a group are equal,
   compared byte by byte, its suffixes are equal as they stand. In the rest the suffixes are put in order by digits of
   eight bytes, most significant first, within (anchor, place of the anchor in the window).
3. An anchor that is estimated frequent (a 65,536th of all stretches, or 16,384) could gather without bound in one task.
   There the stretches are written out once and equal surroundings are counted first (grouped by their bytes, with partial counts before the shuffle), and the suffixes of the different ones
   are grouped by (anchor, place, remaining bytes): the same order, made by Spark's sort.

Texts are read from blocks (``blocks.py``) by each pass; a removal names its block and place.

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` lose none; matches never cross texts, and a
text may match itself at another place, overlapping or not. Rows that share an id or have none are different documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch
from .blocks import Blocks, store
from .checkpoints import fresh
from .text import BYTE_BASE, BYTE_CODE, mix, no_clash, powers, prefix, runs, spread, table, utf8, with_fields

LENGTH, GRAM = 200, 100
#: An anchor is frequent from a SHARE-th of all stretches on, but from HOT[0] at least and HOT[1] at most.
SHARE, HOT = 1 << 16, (32, 1 << 14)
_PLACE = 22  # bits of a place within a chunk
_CHUNK = (1 << _PLACE) - 4096
_ROWS = 1 << 14  # stretches that are handed on, or put in order, at a time
U = np.uint64
_TOP = ~U((1 << _PLACE) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values."""
    n = len(x)
    padded = np.full(-(-n // width) * width, ~U(0), U)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


class Anchors:
    """The anchors of a slice's windows.

    place: of the anchor; key: its hash; first, last: the first and the last window start that it stands for.
    """

    def __init__(self, data: np.ndarray, borders: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> None:
        self.data, self.borders, self.length, self.gram = data, borders, length, gram
        parts = []
        for at in range(0, max(1, len(data)), _CHUNK):
            parts.append(self._chunk(at, min(len(data), at + _CHUNK + length - 1)))
        place, key, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.place, self.key, self.first, self.last = place, key, first, last
        self.row = np.searchsorted(borders, first, "right") - 1 if len(first) else np.zeros(0, np.int64)

    def _chunk(self, at: int, to: int) -> tuple[np.ndarray, ...]:
        none = np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        data, k, n = self.data[at:to], self.gram, to - at
        if n < self.length:
            return none
        # windows may start where their row goes on for ``length`` bytes
        rows = np.searchsorted(self.borders, at, "right") - 1
        inside = self.borders[rows:]
        ends = inside[(inside > at) & (inside < to)] - at
        ok = np.ones(n - self.length + 1, bool)
        for e in ends.tolist():
            ok[max(0, e - self.length + 1) : e] = False
        starts = np.flatnonzero(ok)
        if not len(starts):
            return none
        p = prefix(BYTE_CODE[data], BYTE_BASE)
        g = mix((p[k:] - p[:-k]) * powers(BYTE_BASE, len(p))[1][: n - k + 1])
        low = sliding_min((g & _TOP) | np.arange(len(g), dtype=U), self.length - k + 1)
        where = (low[starts] & ~_TOP).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)])
        first, last = starts[cut], starts[np.r_[cut[1:], len(starts)] - 1]
        return where[cut] + at, g[where[cut]], first + at, last + at


def _around(a: Anchors, which: np.ndarray) -> pa.Array:
    """The bytes of the windows before the anchor and after it, without the anchor."""
    left, right = a.place[which] - a.first[which], a.last[which] + a.length - a.place[which] - a.gram
    sizes = left + right
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) - np.repeat(ends - sizes, sizes)
    skip = np.repeat(left, sizes)
    src = np.repeat(a.first[which], sizes) + at + np.where(at >= skip, a.gram, 0)
    return pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(a.data[src])])


def stretches(blocks: Blocks, length: int) -> DataFrame:
    """key, block, at (place of the first window in the block's bytes), before (bytes before the anchor), n (windows), around,
    hot: the stretches whose anchor is estimated to repeat."""
    about = blocks.total * 2 // (length - GRAM + 2) + 1
    bits = sketch.width_bits(about)
    answers = sketch.answers(blocks, lambda part: Anchors(*utf8(part.column("text")), length).key, bits, min(HOT[1], max(HOT[0], about // SHARE)))

    def find(block: int, read: Callable, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not any(np.frombuffer(r[1].as_py(), np.uint8).any() for r in rows):
            return
        a = Anchors(*utf8(read().column("text")), length)
        yes, hot = sketch.look(a.key, bits, rows)
        every = np.flatnonzero(yes)
        for lo in range(0, len(every), _ROWS):
            which = every[lo : lo + _ROWS]
            n, before = a.last[which] - a.first[which] + 1, a.place[which] - a.first[which]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.key[which].view(np.int64)), pa.array(np.full(len(which), block)), pa.array(a.first[which].astype(np.int32)), pa.array(before.astype(np.int16)), pa.array(n.astype(np.int16)), _around(a, which), pa.array(hot[which])],
                ["key", "block", "at", "before", "n", "around", "hot"],
            )

    return blocks.beside(answers, find, "key long, block long, at int, before short, n short, around binary, hot boolean")


def _words(buffer: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The eight (or fewer) bytes from each place as a number, the first byte most significant."""
    view = np.ndarray((len(buffer) - 7,), ">u8", buffer, 0, (1,))
    got = view[at].astype(U)
    return got if size == 8 else got >> U(8 * (8 - size))


def equal_windows(buffer: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Radix passes over the strings of ``depth`` bytes that start at ``at``: the numbers of those that are equal to
    another one of their group. Only groups of two or more go on to the next digit."""
    live = np.arange(len(at))
    digit = group.astype(U)
    group = np.zeros(len(at), np.int64)
    for d in range(-1, -(-depth // 8)):
        if d >= 0:
            digit = _words(buffer, at[live] + 8 * d, min(8, depth - 8 * d))
        order = np.lexsort((digit, group))
        g, x = group[order], digit[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (x[1:] != x[:-1])] if len(order) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        keep = np.bincount(number)[number] > 1 if len(order) else new
        live, group = live[order[keep]], number[keep]
        if not len(live):
            break
    return live


def _offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column (eight more at the end) and the rows' borders."""
    data, borders = utf8(column)
    return np.r_[data, np.zeros(8, np.uint8)], borders


def _ranges(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts within a row: row, first, last. Arguments sorted by row and start."""
    cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]) if len(row) else np.zeros(0, np.int64)
    return row[cut], start[cut], start[np.r_[cut[1:], len(row)] - 1] if len(row) else start


def _different(buffer: np.ndarray, borders: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether the bytes of each row differ from those of row of[row], which are as many."""
    size = np.diff(borders)
    at = np.arange(borders[-1])
    other = at - np.repeat(borders[:-1] - borders[of], size)
    wrong = np.r_[0, np.cumsum(buffer[at] != buffer[other])]
    return wrong[borders[1:]] > wrong[borders[:-1]]


def _finish(length: int):
    """On cold stretches sorted by key: block, at, n of the windows that repeat."""
    depth = length - GRAM

    def block(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks().to_batches()[0]
        col = lambda c: t.column(c).to_numpy()
        key, at, before, n = col("key"), col("at").astype(np.int64), col("before").astype(np.int64), col("n").astype(np.int64)
        buffer, borders = _offsets(t.column("around"))
        first = runs(key)
        size = np.diff(np.r_[first, len(key)])
        number = np.repeat(np.arange(len(first)), size)
        lead = first[number]
        alike = (before == before[lead]) & (n == n[lead])
        alike &= ~_different(buffer, borders, np.where(alike, lead, np.arange(len(key))))
        same = np.logical_and.reduceat(alike, first)
        done = np.flatnonzero((same & (size > 1))[number])
        rest = np.flatnonzero(~same[number])
        rows, starts, many = [done], [at[done]], [n[done]]
        if len(rest):
            k = np.repeat(rest, n[rest])
            j = np.arange(len(k)) - np.repeat(np.cumsum(n[rest]) - n[rest], n[rest])
            hit = equal_windows(buffer, borders[k] + j, number[k] * 1024 + (before[k] - j), depth)
            hit.sort()
            r, a, b = _ranges(k[hit], j[hit])
            rows.append(r)
            starts.append(at[r] + a)
            many.append(b - a + 1)
        rows = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays([t.column("block").take(rows), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(many).astype(np.int32))], ["block", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                key = part.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
                if cut:
                    yield block(pa.Table.from_batches([*held, part.slice(0, cut)]))
                    held = []
                held.append(part.slice(cut))
        if held:
            yield block(pa.Table.from_batches(held))

    return run


def _expand(length: int):
    """The windows of stretches: the anchor's place in each, and the bytes without the anchor."""
    depth = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                t = whole.slice(lo, 256)
                n, before, at = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "before", "at"))
                data, borders = _offsets(t.column("around"))
                k = np.repeat(np.arange(len(n)), n)
                j = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                left = data[(borders[k] + j)[:, None] + np.arange(depth)]
                tail = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer((np.arange(len(k) + 1) * depth).astype(np.int32)), pa.py_buffer(left.tobytes())])
                rows = pa.array(k)
                yield pa.RecordBatch.from_arrays([t.column("key").take(rows), pa.array((before[k] - j).astype(np.int16)), tail, t.column("block").take(rows), pa.array((at[k] + j).astype(np.int32)), t.column("many").take(rows)], ["key", "place", "tail", "block", "at", "many"])

    return run


def _semi(rows: DataFrame, kinds: DataFrame, on: list[str], count: str, share: int) -> DataFrame:
    """The rows whose kind is among kinds. Kinds of over ``share`` rows, SHARE at most, are broadcast, and their rows judged where
    they are; so no group that a shuffle brings together is larger than that."""
    frequent = kinds.where(F.col(count) > share + HOT[0]).select(*on, F.lit(True).alias("_frequent"))
    marked = rows.join(F.broadcast(frequent), on, "left")
    rest = kinds.where(F.col(count) <= share + HOT[0]).select(*on)
    return marked.where("_frequent").drop("_frequent").unionByName(marked.where("_frequent is null").drop("_frequent").join(rest, on))


def removals(blocks: Blocks, length: int) -> DataFrame:
    """block, spans: (place of the first repeated window in the block's bytes, number of windows)."""
    found = stretches(blocks, length)
    cold = found.where(~F.col("hot")).select("key", "block", "at", "before", "n", "around")
    cold = cold.repartition("key").sortWithinPartitions("key").mapInArrow(_finish(length), "block long, at int, n int")
    path = fresh(found.sparkSession, "stretches")
    found.where("hot").write.mode("overwrite").parquet(path)
    hot = found.sparkSession.read.schema(found.schema).parquet(path)
    # equal surroundings are counted first; those that occur once carry their only place
    same, by = ["key", "before", "n", "around"], ["key", "place", "tail"]
    first = hot.groupBy(*same).agg(F.count("*").alias("many"), F.first("block").alias("block"), F.first("at").alias("at")).checkpoint()
    share = (first.agg(F.sum("many")).first()[0] or 0) // SHARE  # so at most SHARE kinds have more than a share of the rows
    whole = _semi(hot, first.where("many > 1"), same, "many", share).select("block", "at", F.col("n").cast("int").alias("n"))
    some = first.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key")
    windows = first.join(some, "key").select("key", "before", "n", "around", "block", "at", "many")
    windows = windows.mapInArrow(_expand(length), "key long, place short, tail binary, block long, at int, many long")
    again = windows.groupBy(*by).agg(F.count("*").alias("kinds")).where("kinds > 1").checkpoint()
    # a stretch has at most (length - GRAM + 1) windows
    single = _semi(windows.where("many = 1"), again, by, "kinds", share * (length - GRAM + 1)).select("block", "at", F.lit(1).alias("n"))
    gone = cold.union(whole).union(single)
    return gone.groupBy("block").agg(F.collect_list(F.struct(F.col("at").alias("start"), "n")).alias("spans"))  # at most a block's bytes


def deduplicated(docs: DataFrame, length: int = LENGTH, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns, n_bytes, n_removed, n_spans, kept (the remaining bytes) of each row."""
    no_clash(columns, ["n_bytes", "n_removed", "n_spans", "kept"])
    blocks = store(docs.select(F.struct(*columns).alias("own"), "text"))
    gone = removals(blocks, length).withColumn("part", F.lit(0))

    def run(block: int, read: Callable, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        part = read()
        data, borders = utf8(part.column("text"))
        step = np.zeros(len(data) + 1, np.int32)
        if rows:
            spans = rows[0][1].values
            start = spans.field("start").to_numpy().astype(np.int64)
            np.add.at(step, start, 1)
            np.add.at(step, start + spans.field("n").to_numpy() + length - 1, -1)
        gone = np.cumsum(step[:-1]) > 0
        c = np.r_[0, np.cumsum(gone)]
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        edge = borders[:-1][borders[:-1] < len(data)]
        begin[edge] = gone[edge]
        b = np.r_[0, np.cumsum(begin)]
        left = data[~gone]
        ends = borders - c[borders]
        kept = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(left)])
        per = lambda x: pa.array(x[borders[1:]] - x[borders[:-1]])
        yield pa.RecordBatch.from_arrays([part.column("own"), pa.array(np.diff(borders)), per(c), per(b), kept], ["own", "n_bytes", "n_removed", "n_spans", "kept"])

    out = blocks.beside(gone, run, with_fields(blocks.schema, ["own"], "n_bytes long, n_removed long, n_spans long, kept binary"))
    return out.select("own.*", "n_bytes", "n_removed", "n_spans", "kept")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(spread(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op3_suffix_array_dedup": op3_suffix_array_dedup}
SQL = {
    "op3_suffix_array_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM d WHERE len(x) >= 400)),
k AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
w AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p, lead(i) OVER (PARTITION BY r ORDER BY i) AS q FROM s JOIN k USING (k)),
g AS (SELECT w.r, sum(CASE WHEN p IS NULL THEN 200 ELSE least(200, i - p) END) AS n_removed, count(*) FILTER (WHERE p IS NULL OR i - p > 200) AS n_spans,
        substr(any_value(x), 1, 2 * min(i)) || coalesce(string_agg(substr(x, 2 * (p + 200) + 1, 2 * (i - p - 200)), '' ORDER BY i) FILTER (WHERE i - p > 200), '') || substr(any_value(x), 2 * (max(i) + 200) + 1) AS kept
      FROM w JOIN d ON d.r = w.r GROUP BY w.r)
SELECT d.doc_id, (len(d.x) // 2)::BIGINT AS n_bytes, coalesce(g.n_removed, 0)::BIGINT AS n_removed, coalesce(g.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(g.kept, d.x))) AS kept_sha256
FROM d LEFT JOIN g ON g.r = d.r"""
}
