"""Substring dedup: removes the words covered by a window of ``size`` words that also starts in a document with a
smaller id.

1. Prefilter. Each window is represented by the smallest of its hashed parts of about half its length; equal windows
   have equal representatives, so the number of documents with a window is at most the count of its representative. A
   count-min sketch (``sketch.py``) counts the representatives of all documents, each once a document; only windows
   estimated at two or more go on, so none that repeats is lost.
2. The exact pass groups those windows by 96 bits of hash to find the smallest id of each, a row for each document and
   window. Of a window that a 65,536th of all words or more start, there can be 65,536 times a small factor at most: those
   are counted first, among the windows estimated frequent, with sums before the shuffle; their smallest ids are broadcast,
   and their rows are judged where they are. So no group that meets in a task is larger than that share.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; what is kept is joined by one blank. Texts are read from blocks
(``blocks.py``) by each pass; only hashes, places and removals are shuffled.

Defined cases: null and empty texts have no words; texts with fewer than ``size`` words lose none. A null id counts as
larger than every id. Rows that share an id do not count as smaller for each other. Windows are judged on the input, not on
what is left. Extra columns may be carried along. Ids are whole numbers of up to 64 bits; others raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sketch
from .blocks import Blocks, store
from .text import WORD_BASE, WORD_BASE_2, Words, as_long, member, mix, no_clash, prefix, span_hash, spread, table, utf8, with_fields

SIZE = 13
#: Estimated documents from which a window is counted beforehand, and the parts of all words that make one frequent.
HOT, SHARE = 32, 1 << 16
U = np.uint64


class Repeats:
    """The windows of a block: where each starts, its row, and its stretch of windows with one representative (key)."""

    def __init__(self, part: pa.RecordBatch, size: int) -> None:
        data, borders = utf8(part.column("text"))
        self.words, self.size = Words(data, borders), size
        h = self.words.hashes()
        self.sums = [(prefix(h, b), b) for b in (WORD_BASE, WORD_BASE_2)]
        self.at = self.words.windows(size)
        self.row = self.words.of[self.at]
        self.stretch, self.key = np.zeros(0, np.int64), np.zeros(0, U)
        if not len(self.at):
            return
        half = size // 2 + 1
        i = np.arange(len(h) - half + 1)
        g = span_hash(self.sums[0][0], i, i + half, WORD_BASE)
        low = g[: len(h) - size + 1].copy()
        for k in range(1, size - half + 1):
            np.minimum(low, g[k : k + len(low)], out=low)
        key = mix(low[self.at])
        first = np.r_[True, (key[1:] != key[:-1]) | (self.row[1:] != self.row[:-1])]
        self.stretch, self.key = np.cumsum(first) - 1, key[first]
        self.key_row = self.row[first]

    def keys(self) -> np.ndarray:
        """Each document's distinct representatives."""
        if not len(self.key):
            return self.key
        order = np.lexsort((self.key, self.key_row))
        k, r = self.key[order], self.key_row[order]
        return k[np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])]]

    def hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of hash."""
        at = self.at[which]
        h, g = (span_hash(p, at, at + self.size, b) for p, b in self.sums)
        return h, (g >> U(32)).astype(np.uint32).view(np.int32)

    def kinds(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One of each document's equal windows: its number, hashes, and whether the document has more of them."""
        h, g = self.hashes(which)
        row = self.row[which]
        order = np.lexsort((g, h, row))
        r, x, y = row[order], h[order], g[order]
        first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(order) else np.zeros(0, np.int64)
        return which[order[first]], x[first], y[first], np.diff(np.r_[first, len(order)]) > 1


def _ids(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """doc_id of each row, and whether it is null."""
    column = part.column("doc_id")
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _frequent(blocks: Blocks, answers: DataFrame, size: int, bits: int) -> DataFrame:
    """h, g, least: the windows of a SHARE-th of all words or more, with their smallest id."""

    def count(block: int, read: Callable, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not any(np.frombuffer(r[2].as_py(), np.uint8).any() for r in rows):
            return
        part = read()
        w = Repeats(part, size)
        yes, hot = sketch.look(w.key, bits, rows)
        which, h, g, _ = w.kinds(np.flatnonzero((yes & hot)[w.stretch]))
        ids, none = _ids(part)
        row = w.row[which]
        ids = np.where(none[row], np.iinfo(np.int64).max, ids[row])
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.zeros(0, np.int64)
        if len(first):
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(g[first]), pa.array(np.minimum.reduceat(ids[order], first)), pa.array(np.diff(np.r_[first, len(h)]))], ["h", "g", "least", "n"])

    each = blocks.beside(answers, count, "h long, g int, least long, n long")
    least = max(HOT, blocks.total // 6 // SHARE)
    return each.groupBy("h", "g").agg(F.min("least").alias("least"), F.sum("n").alias("n")).where(F.col("n") >= least).select("h", "g", "least")


def removals(blocks: Blocks, size: int) -> DataFrame:
    """block, words: numbers (in the block) of the words at which a removed window starts; -1 - number where the document has
    more windows equal to it, which go too."""
    # about one word in six bytes; two representatives for each (size - half + 2) windows
    bits = sketch.width_bits(blocks.total // 6 * 2 // (size - size // 2 + 1) + 1)
    answers = sketch.answers(blocks, lambda part: Repeats(part, size).keys(), bits, HOT)
    known = _frequent(blocks, answers, size, bits).toPandas().sort_values("h")  # about SHARE rows at most
    shared = blocks.refs.sparkSession.sparkContext.broadcast((known["h"].to_numpy(np.int64).view(U), known["g"].to_numpy(np.int32), known["least"].to_numpy(np.int64)))

    def find(block: int, read: Callable, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not any(np.frombuffer(r[1].as_py(), np.uint8).any() for r in rows):
            return
        part = read()
        w = Repeats(part, size)
        yes, _ = sketch.look(w.key, bits, rows)
        which, h, g, more = w.kinds(np.flatnonzero(yes[w.stretch]))
        ids, none = _ids(part)
        row = w.row[which]
        ids, none = ids[row], none[row]
        fh, fg, least = shared.value
        at = member(fh, h)
        frequent = (at >= 0) & (fg[at] == g) if len(fh) else np.zeros(len(h), bool)
        low = np.where(frequent, least[at], 0) if len(fh) else np.zeros(len(h), np.int64)
        go = ~frequent | (none & (low != np.iinfo(np.int64).max)) | (~none & (low < ids))
        # a judged row meets no other: its hash is its own name
        name = mix((np.full(len(which), block).astype(U) << U(24)) ^ w.at[which].astype(U))
        h, word = np.where(frequent, name, h), w.at[which]
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[go].view(np.int64)), pa.array(np.where(frequent, word, g)[go].astype(np.int32)), pa.array(ids[go], mask=none[go]), pa.array(low[go], mask=~frequent[go]), pa.array(np.full(int(go.sum()), block)), pa.array(np.where(more, -1 - word, word)[go].astype(np.int32))],
            ["h", "g", "doc_id", "low", "block", "word"],
        )

    found = blocks.beside(answers, find, "h long, g int, doc_id long, low long, block long, word int")
    least = F.min(F.coalesce("low", "doc_id")).over(Window.partitionBy("h", "g"))
    gone = found.withColumn("least", least).where("least is not null and (doc_id is null or doc_id > least)")
    return gone.groupBy("block").agg(F.collect_list("word").alias("words"))  # at most a block's words


def kept(docs: DataFrame, size: int, columns: list[str], finish: Callable, schema: str) -> DataFrame:
    """Finds the removals and applies finish(rows, flags of removed words, Words) to each block; columns are carried."""
    no_clash(columns, [s.split()[0] for s in schema.split(", ")])
    docs = as_long(docs, "doc_id")
    blocks = store(docs.select(F.struct(*columns).alias("own"), "doc_id", "text"))
    gone = removals(blocks, size).withColumn("part", F.lit(0))

    def run(block: int, read: Callable, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        part = read()
        starts = rows[0][1].values.to_numpy().astype(np.int64) if rows else np.zeros(0, np.int64)
        if len(starts) and starts.min() < 0:
            w = Repeats(part, size)
            words = w.words
            h, g = w.hashes(np.arange(len(w.at)))
            place = np.searchsorted(w.at, -1 - starts[starts < 0])
            key = mix(mix(h ^ w.row.astype(U)) ^ g.astype(np.int64).view(U))
            starts = np.r_[starts[starts >= 0], w.at[np.isin(key, key[place])]]
        else:
            words = Words(*utf8(part.column("text")))
        step = np.zeros(len(words.start) + size + 1, np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + size, -1)
        yield finish(part, words, np.cumsum(step)[: len(words.start)] > 0)

    return blocks.beside(gone, run, with_fields(blocks.schema, ["own"], schema)).select("own.*", *[s.split()[0] for s in schema.split(", ")])


def _texts(w: Words, gone: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of each row, joined by one blank: all rows' bytes, and their borders."""
    data, kept = w.data.copy(), np.flatnonzero(~gone)
    last = np.r_[w.of[kept][1:] != w.of[kept][:-1], True] if len(kept) else np.zeros(0, bool)
    step = np.zeros(len(data) + 1, np.int8)
    step[w.start[kept]] += 1
    # the blank after a word that is not a row's last kept one
    stop = w.end[kept] + ~last
    step[stop] -= 1
    data[w.end[kept[~last]]] = 32
    inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    count = np.r_[0, np.cumsum(inside)]
    edge = np.r_[w.start, len(data)][w.first]
    return data[inside].tobytes(), count[edge]


def digest(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""

    def finish(part: pa.RecordBatch, w: Words, gone: np.ndarray) -> pa.RecordBatch:
        c = np.r_[0, np.cumsum(gone)]
        whole, at = _texts(w, gone)
        sha = [hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([part.column("own"), pa.array(np.diff(w.first)), pa.array(c[w.first[1:]] - c[w.first[:-1]]), pa.array(sha)], ["own", "n_words", "n_removed", "kept_sha256"])

    return kept(docs, size, ["doc_id"], finish, "n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of docs with the text left, and lost; texts that lose nothing stay as they are, bytes and all. No column may
    be called kept_text or lost."""

    def finish(part: pa.RecordBatch, w: Words, gone: np.ndarray) -> pa.RecordBatch:
        c = np.r_[0, np.cumsum(gone)]
        lost = (c[w.first[1:]] - c[w.first[:-1]]) > 0
        texts = part.column("text").to_pylist()
        if lost.any():
            whole, at = _texts(w, gone)
            for r in np.flatnonzero(lost).tolist():
                texts[r] = whole[at[r] : at[r + 1]].decode("utf-8", "replace")
        return pa.RecordBatch.from_arrays([part.column("own"), pa.array(texts, pa.string()), pa.array(lost)], ["own", "kept_text", "lost"])

    out = kept(docs, size, [c for c in docs.columns if c != "text"], finish, "kept_text string, lost boolean")
    return out.withColumnRenamed("kept_text", "text").select(*docs.columns, "lost")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spread(table(spark, sf_dir, "documents")))


SQL = {
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM p),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT DISTINCT g.doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN m USING (k) WHERE g.doc_id > least),
a AS (SELECT d.doc_id, u.j, d.w[u.j] AS word FROM d, LATERAL (SELECT unnest(range(1, len(d.w) + 1)) AS j) u),
s AS (SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.j) FILTER (WHERE r.j IS NULL) AS kept, count(*) AS n, count(r.j) AS gone
      FROM a LEFT JOIN r ON a.doc_id = r.doc_id AND a.j = r.j GROUP BY a.doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_words, coalesce(s.gone, 0)::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)"""
}
QUERIES = {"op10_substring_dedup": op10_substring_dedup}
