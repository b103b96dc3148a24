"""A count-min sketch over all rows, built from partition sketches, merged by part, and asked by shuffle.

Two scans, whatever the input's size, and no broadcast:

1. Each block of texts (``blocks.py``) turns its keys into the indexes of two rows of counters and emits, for each part of
   2**PART_BITS counters, the distinct indexes as gaps with their counts: a sparse partition sketch.
2. The sketches of a part meet in one task, which adds them up at the indexes that they name (a merge holds one part) and
   answers each block at once with two bits an index: whether its counter is at least 2, and at least ``hot``. The second
   scan of a block, beside its answers, knows the estimate of each of its keys.

Counters only ever grow, so an estimate is never below the true count. The width follows the number of keys, so the share
of false alarms is the same at every size; what is shuffled is a byte or two for each key and row, and answers an eighth.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Blocks
from .text import mix, runs

PART_BITS, LOAD = 22, 6
_SALT = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xC2B2AE3D27D4EB4F))
_MOST = np.uint32(1 << 30)
ANSWERS = "block long, part long, yes binary, hot binary"


def width_bits(keys: int) -> int:
    """Bits of a row's index for at least LOAD counters a key."""
    return max(PART_BITS, int(max(1, keys) * LOAD - 1).bit_length())


def rows_of(keys: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of counters: the distinct indexes, which of them each key has, and how many keys have it."""
    for salt in _SALT:
        at = (mix(keys ^ salt) >> np.uint64(64 - bits)).astype(np.int64)
        yield np.unique(at, return_inverse=True, return_counts=True)


def pack(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending places within a part and their counts. Gaps are bytes (255 adds 255 without a place) where that is shorter
    than four bytes a place; counts are left out where all are 1, and end at 65,535."""
    gaps = np.diff(at, prepend=0)
    more = gaps // 255
    wide = len(gaps) + int(more.sum()) > 4 * len(gaps)
    if wide:
        places = at.astype("<u4").tobytes()
    else:
        out = np.full(len(gaps) + int(more.sum()), 255, np.uint8)
        out[np.cumsum(more + 1) - 1] = gaps % 255
        places = out.tobytes()
    top = int(counts.max())
    kind = 0 if top == 1 else 1 if top < 256 else 2
    tail = b"" if not kind else np.minimum(counts, 65535).astype("u1" if kind == 1 else "<u2").tobytes()
    return bytes((wide, kind)) + len(at).to_bytes(4, "little") + tail + places


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray | int]:
    wide, kind, n = data[0], data[1], int.from_bytes(data[2:6], "little")
    counts = 1 if not kind else np.frombuffer(data, "u1" if kind == 1 else "<u2", n, 6).astype(np.uint32)
    if wide:
        return np.frombuffer(data, "<u4", n, 6 + kind * n).astype(np.int64), counts
    gaps = np.frombuffer(data, np.uint8, offset=6 + kind * n)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255], counts


def partition_sketch(block: int, keys: np.ndarray, bits: int) -> pa.RecordBatch:
    """block, part, places: the sparse counters of a block's keys."""
    parts, packed = [], []
    for j, (at, _, counts) in enumerate(rows_of(keys, bits)):
        part = at >> PART_BITS
        cut = np.r_[runs(part), len(part)]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            parts.append((j << bits - PART_BITS) + int(part[a]))
            packed.append(pack(at[a:b] & (1 << PART_BITS) - 1, counts[a:b]))
    return pa.RecordBatch.from_arrays([pa.array([block] * len(parts), pa.int64()), pa.array(parts, pa.int64()), pa.array(packed, pa.binary())], ["block", "part", "places"])


def _answers(hot: int) -> Callable:
    """For mapInArrow on partition sketches sorted by part: the answers to their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << PART_BITS, np.uint32)
        now, held = None, []

        def done() -> pa.RecordBatch:
            own = [unpack(data) for _, data in held]
            for at, n in own:
                counts[at] = np.minimum(counts[at] + n, _MOST)
            bits = [[np.packbits(counts[at] >= least).tobytes() for at, _ in own] for least in (2, hot)]
            for at, _ in own:
                counts[at] = 0
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int64()), pa.array([now] * len(held), pa.int64()), *(pa.array(b, pa.binary()) for b in bits)], ["block", "part", "yes", "hot"])

        for batch in batches:
            for block, part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part != now:
                    if held:
                        yield done()
                    now, held = part, []
                held.append((block, data.as_py()))
        if held:
            yield done()

    return run


def answers(blocks: Blocks, keys: Callable[[pa.RecordBatch], np.ndarray], bits: int, hot: int) -> DataFrame:
    """ANSWERS of the merged sketch of all blocks' keys, kept in the checkpoint folder."""

    def sketch(block: int, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = keys(part)
        if len(own):
            yield partition_sketch(block, own, bits)

    parts = blocks.each(sketch, "block long, part long, places binary")
    return parts.repartition("part").sortWithinPartitions("part", "block").mapInArrow(_answers(hot), ANSWERS).checkpoint()


def look(keys: np.ndarray, bits: int, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Whether the estimate of each key of a block is at least 2, and at least ``hot``; rows: (part, yes, hot), by part."""
    yes, hot, i = np.ones(len(keys), bool), np.ones(len(keys), bool), 0
    for at, which, _ in rows_of(keys, bits):
        cut = np.r_[runs(at >> PART_BITS), len(at)]
        found: list[list[np.ndarray]] = [[], []]
        for n in np.diff(cut).tolist():
            for out, data in zip(found, rows[i][1:], strict=True):
                out.append(np.unpackbits(np.frombuffer(data.as_py(), np.uint8), count=n))
            i += 1
        yes &= np.concatenate(found[0]).astype(bool)[which]
        hot &= np.concatenate(found[1]).astype(bool)[which]
    return yes, hot
