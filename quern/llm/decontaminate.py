"""Benchmark decontamination: documents that hold a benchmark item within an edit budget.

Texts are compared as bytes after A-Z are lower-cased and runs of white space become one blank. An item of m bytes may
have e = floor(rate * m) edits (insertions, deletions, substitutions of bytes).

1. Q-gram lemma: a region within e edits shares at least m + 1 - q (e + 1) q-grams with the item, all on diagonals that
   lie within e of each other. So shared q-grams are counted in diagonal bands 2 (e + 1) wide that overlap by half, and
   bands below the bound are dropped. Items too short for the bound at ``q`` are indexed by shorter grams, the longest for
   which it is at least 1, so that each has its whole budget.
2. Each remaining band is verified by an alignment restricted to its diagonals and e more on either side.

The items are a query set: they are streamed to the driver in blocks of at most ``block_bytes`` and each block is
broadcast to a scan over all documents, so memory follows the block and not the number of items. Shared q-grams are
expanded at most ``POSTINGS`` at a time, by ranges of items and of places, and counts of a band are added up, so that a
q-gram that many items have takes no more memory than another.

Defined cases: null or empty texts match nothing; items that are empty or blank match nothing; items shorter than q
bytes without a budget match where they occur. Repeated rows give repeated results; items with the same text each give a
row. Of overlapping matches of one item the one with the fewest edits stays (ties: the first). Null ids are carried
through. No match is dropped for its frequency. Carried columns called item_id, start, end or edits raise an error.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import BYTE_BASE, BYTE_CODE, LOWER, SPACE, as_long, by_slice, mix, no_clash, packed, powers, prefix, runs, spread, table, unpacked, utf8, with_fields

Q, RATE, BLOCK_BYTES = 9, 0.08, 4 << 20
POSTINGS, ALIGN_BYTES = 1 << 21, 4 << 20
SCHEMA = "item_id long, start long, end long, edits int"
_NONE = 255  # a byte that UTF-8 never has


def normal(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes as compared, and where each stands in the text."""
    space = SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = np.flatnonzero(keep)
    out = LOWER[data[at]]
    out[space[at]] = 32
    return out, at


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q bytes from each position."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    p = prefix(BYTE_CODE[data], BYTE_BASE)
    return mix((p[q:] - p[:-q]) * powers(BYTE_BASE, len(p))[1][: len(p) - q])


class Grams:
    """The q-grams of some of a block's items: gram (sorted hashes), and at first[i] to first[i + 1] its items and places."""

    def __init__(self, texts: list[bytes], which: np.ndarray, q: int) -> None:
        self.q = q
        per = [gram_hashes(np.frombuffer(texts[i], np.uint8), q) for i in which.tolist()]
        sizes = np.array([len(h) for h in per], np.int64)
        h = np.concatenate(per)
        order = np.argsort(h, kind="stable")
        h = h[order]
        self.item = np.repeat(which, sizes)[order]
        self.pos = (np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
        self.gram, first = np.unique(h, return_index=True)
        self.first = np.append(first, len(h))
        bits = max(16, int(len(self.gram) * 16).bit_length())
        self.shift = np.uint64(64 - bits)
        self.bloom = np.zeros(1 << bits, bool)
        self.bloom[self.gram >> self.shift] = True

    def shared(self, data: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the text at which one of the grams stands, and its number."""
        h = gram_hashes(data, self.q)
        at = np.flatnonzero(self.bloom[h >> self.shift])
        at = at[row[at] == row[at + self.q - 1]]
        found = np.minimum(np.searchsorted(self.gram, h[at]), len(self.gram) - 1)
        ok = self.gram[found] == h[at]
        return at[ok], found[ok]


@dataclass
class Items:
    """A block of items with indexes of their q-grams, by q."""

    ids: list[int | None]
    texts: list[bytes]
    q: int
    rate: float

    def __post_init__(self) -> None:
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.edits = (self.length * self.rate + 1e-9).astype(np.int64)
        own = np.minimum(self.q, self.length // (self.edits + 1))
        self.bound = self.length + 1 - own * (self.edits + 1)
        brief = (self.length < self.q) & (self.edits == 0)
        self.short = np.flatnonzero(brief & (self.length > 0)).tolist()
        self.indexes = [Grams(self.texts, np.flatnonzero(~brief & (own == q)), q) for q in np.unique(own[~brief]).tolist()]

    def bands(self, data: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, item, first diagonal) of the bands that meet the lemma's bound, some at a time; all of an item together."""
        for grams in self.indexes:
            at, found = grams.shared(data, row)
            # a match has at least ``least`` of its q-grams within ``reach`` bytes
            own = np.unique(grams.item)
            reach, least = int((self.length[own] + self.edits[own]).max()) + 1, int(self.bound[own].min())
            near = np.searchsorted(at, at + reach) - np.searchsorted(at, at - reach) >= least
            at, found = at[near], found[near]
            if len(at):
                yield from self._counted(grams, row, at, found, reach)

    def _counted(self, grams: Grams, row: np.ndarray, at: np.ndarray, found: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, ...]]:
        n = grams.first[found + 1] - grams.first[found]
        cuts = [0, len(self.texts)]
        if int(n.sum()) > POSTINGS:
            # ranges of items, each with as many postings as fit, or one item
            often = np.bincount(found, minlength=len(grams.gram))
            each = np.bincount(grams.item, np.repeat(often, np.diff(grams.first)), len(self.texts))
            cuts, held = [0], 0.0
            for i, x in enumerate(each.tolist()):
                if held and held + x > POSTINGS:
                    cuts.append(i)
                    held = 0.0
                held += x
            cuts.append(len(self.texts))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            start, stop = grams.first[found], grams.first[found + 1]
            if len(cuts) > 2:  # a gram's postings are in order of their items
                rank = grams.item + np.repeat(np.arange(len(grams.gram)) * len(self.texts), np.diff(grams.first))
                start, stop = (np.searchsorted(rank, found * len(self.texts) + x) for x in (lo, hi))
            size = stop - start
            ends = np.cumsum(size)
            key, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            a = 0
            while a < len(at):
                done = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, done + POSTINGS, "right")))
                key, count = self._added(grams, row, at[a:b], start[a:b], size[a:b], reach, key, count)
                a = b
            item = (key >> np.uint64(31) & np.uint64((1 << 20) - 1)).astype(np.int64)
            ok = count >= self.bound[item]
            key, item = key[ok], item[ok]
            if len(key):
                band = (key & np.uint64((1 << 31) - 1)).astype(np.int64) - 1
                yield (key >> np.uint64(51)).astype(np.int64), item, band * (self.edits[item] + 1) - reach

    def _added(self, grams: Grams, row: np.ndarray, at: np.ndarray, start: np.ndarray, size: np.ndarray, reach: int, key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bands and their counts, with those of the postings that start at start added."""
        k = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        item, where = grams.item[k], np.repeat(at, size)
        diagonal = where - grams.pos[k] + reach  # not negative
        step = self.edits[item] + 1
        own = (row[where].astype(np.uint64) << np.uint64(51)) | (item.astype(np.uint64) << np.uint64(31))
        # a diagonal d lies in the bands that start at floor(d / step) * step and one step before
        keys = [own | (diagonal // step + 1 - half).astype(np.uint64) for half in (0, 1)]
        new, more = np.unique(np.concatenate(keys), return_counts=True)
        if not len(key):
            return new, more
        both = np.concatenate([key, new])
        order = np.argsort(both, kind="stable")
        both = both[order]
        first = runs(both)
        return both[first], np.add.reduceat(np.concatenate([count, more])[order], first)


def align(patterns: list[np.ndarray], texts: list[np.ndarray], budgets: list[int], anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Banded alignment of each pattern of m bytes with a text of m + w bytes, w + 1 diagonals wide.

    The edits of the best alignment that takes the whole pattern, and the text position at which it ends; it starts at
    any diagonal, or at the text's start if anchored. Ties: the first end. Alignments over their budget are given up.
    """
    m, most = np.array([len(p) for p in patterns]), np.array(budgets)
    width = max(len(t) - n for t, n in zip(texts, m, strict=True)) + 1
    top, n = int(m.max()), len(patterns)
    p = np.full((n, top), 254, np.uint8)
    t = np.full((n, top + width), _NONE, np.uint8)
    for i, (a, b) in enumerate(zip(patterns, texts, strict=True)):
        p[i, : len(a)] = a
        t[i, : len(b)] = b
    k = np.arange(width, dtype=np.int32)
    far = np.int32(1 << 29)
    d = np.tile(np.where(k == 0, 0, k) if anchored else np.zeros(width, np.int32), (n, 1)).astype(np.int32)
    best, end, live = np.full(n, far, np.int32), np.zeros(n, np.int64), np.arange(n)
    for i in range(top):
        x = d + (t[:, i : i + width] != p[:, i : i + 1])
        x[:, :-1] = np.minimum(x[:, :-1], d[:, 1:] + 1)
        d = np.minimum.accumulate(x - k, axis=1) + k
        over = m[live] == i + 1
        for r in np.flatnonzero(over):
            at = int(d[r].argmin())
            best[live[r]], end[live[r]] = d[r, at], i + 1 + at
        if i % 32 == 31 or over.any():
            go = ~over & (d.min(axis=1) <= most[live])
            if not go.all():
                live, d, t, p = live[go], d[go], t[go], p[go]
                if not len(live):
                    break
    return best, end


def _batches(size: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of candidates, by size, so many at a time that a padded batch has about ALIGN_BYTES, 512 at most."""
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):
        hi = min(len(order), lo + 512)
        while hi > lo + 1 and (hi - lo) * size[order[hi - 1]] > ALIGN_BYTES:
            hi = lo + (hi - lo) // 2
        yield order[lo:hi]
        lo = hi


def find(part: pa.RecordBatch, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) of all matches in a slice; bytes of the text as given."""
    raw, raw_borders = utf8(part.column("text"))
    if not len(raw):
        return []
    row = np.repeat(np.arange(part.num_rows), np.diff(raw_borders))
    space = SPACE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (row[1:] == row[:-1]))
    at = np.flatnonzero(keep)
    data = LOWER[raw[at]]
    data[space[at]] = 32
    row = row[at]
    borders = np.searchsorted(row, np.arange(part.num_rows + 1))
    hits: list[tuple[int, int, int, int, int]] = []
    for rows, which, first in items.bands(data, row):
        for some in _batches(items.length[which] + 4 * items.edits[which]):
            hits += _verified(data, borders, items, rows[some], which[some], first[some])
    for i in items.short:
        whole, n = data.tobytes(), int(items.length[i])
        x = whole.find(items.texts[i])
        while x >= 0:
            if row[x] == row[x + n - 1]:
                hits.append((int(row[x]), i, x, x + n, 0))
            x = whole.find(items.texts[i], x + 1)
    out: list[tuple[int, int, int, int, int]] = []
    taken: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
    for r, i, a, b, e in sorted(set(hits), key=lambda h: (h[0], h[1], h[4], h[2], h[3])):
        starts, ends = taken.setdefault((r, i), ([], []))  # do not overlap, in order
        k = bisect.bisect_right(starts, a)
        if (not k or ends[k - 1] <= a) and (k == len(starts) or b <= starts[k]):
            starts.insert(k, a)
            ends.insert(k, b)
            out.append((r, i, int(at[a] - raw_borders[r]), int(at[b - 1] + 1 - raw_borders[r]), e))
    return out


def _verified(data: np.ndarray, borders: np.ndarray, items: Items, rows: np.ndarray, which: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The bands within the budget, as (row, item, start, end, edits) in normalised bytes."""
    patterns, texts, place, budgets = [], [], [], []
    for r, i, d in zip(rows.tolist(), which.tolist(), first.tolist(), strict=True):
        e, m = int(items.edits[i]), int(items.length[i])
        a, b = d - e, d + 2 * (e + 1) + e + m
        text = np.full(b - a, _NONE, np.uint8)
        x, y = max(a, int(borders[r])), min(b, int(borders[r + 1]))
        if x < y:
            text[x - a : y - a] = data[x:y]
        patterns.append(np.frombuffer(items.texts[i], np.uint8))
        texts.append(text)
        place.append((r, i, a))
        budgets.append(e)
    edits, end = align(patterns, texts, budgets)
    good = [j for j in range(len(place)) if edits[j] <= budgets[j]]
    if not good:
        return []
    # the start: the same alignment from the end backwards
    _, length = align([patterns[j][::-1] for j in good], [_before(texts[j], int(end[j]), len(patterns[j]) + budgets[j]) for j in good], [budgets[j] for j in good], anchored=True)
    hits = []
    for j, n in zip(good, length.tolist(), strict=True):
        r, i, a = place[j]
        stop = a + int(end[j])
        hits.append((r, i, max(stop - n, int(borders[r])), min(stop, int(borders[r + 1])), int(edits[j])))
    return hits


def _before(text: np.ndarray, end: int, n: int) -> np.ndarray:
    """The n bytes before end, backwards."""
    got = text[max(0, end - n) : end][::-1]
    return np.concatenate([got, np.full(n - len(got), _NONE, np.uint8)])


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items with their normalised bytes, so many at a time that they fit the block (or one)."""
    block, size = [], 0
    for r in as_long(benchmark.select("item_id", "text"), "item_id").where("text is not null").toLocalIterator():
        data = normal(np.frombuffer(r.text.encode(), np.uint8))[0].tobytes() if r.text else b""
        data = data if data.strip() else b""
        if data and (size + len(data) > block_bytes or len(block) >= 1 << 20) and block:
            yield block
            block, size = [], 0
        if data:
            block.append((r.item_id, data))
            size += len(data)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, columns: list[str], q: int = Q, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each match of an item in a text: the named columns of docs, item_id, start, end (bytes), edits."""
    session = docs.sparkSession
    no_clash(columns, ["item_id", "start", "end", "edits"])
    chosen = docs.select(*columns, "text") if "text" not in columns else docs.select(*columns)
    kinds = with_fields(chosen.schema, columns, SCHEMA)
    out = None
    for block in blocks(benchmark, block_bytes):
        shared = session.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items([i for i, _ in shared.value], [t for _, t in shared.value], q, rate)

            def one(part: pa.RecordBatch) -> pa.RecordBatch:
                found = find(part, items)
                rows = pa.array([f[0] for f in found], pa.int64())
                return pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(rows) for c in columns), pa.array([items.ids[f[1]] for f in found], pa.int64()), *(pa.array([f[j] for f in found], kind) for j, kind in ((2, pa.int64()), (3, pa.int64()), (4, pa.int32())))],
                    [*columns, "item_id", "start", "end", "edits"],
                )

            yield from by_slice(one)(batches)

        part = chosen.where("text is not null").mapInArrow(run, kinds)
        out = part if out is None else out.union(part)
    return out if out is not None else session.createDataFrame([], kinds)


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs whose text holds no item; one pass for each block of items, nothing is shuffled."""
    out = packed(docs)
    for block in blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items([i for i, _ in shared.value], [t for _, t in shared.value], q, rate)

            def one(part: pa.RecordBatch) -> pa.RecordBatch:
                keep = np.ones(part.num_rows, bool)
                keep[[f[0] for f in find(part, items)]] = False
                return part.filter(pa.array(keep))

            yield from by_slice(one)(batches)

        out = out.mapInArrow(run, out.schema)
    return unpacked(out, docs)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages found, one row each; documents without any have no row."""
    return matches(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), ["doc_id"]).withColumn("contaminated", F.lit(True))


QUERIES = {"op5_decontamination": op5_decontamination}
SQL: dict[str, str] = {}
