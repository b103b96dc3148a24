"""Exact top-k search by BM25 over an inverted index with block-max pruning, per shard, merged exactly.

Scores use statistics of all documents (their number, mean length, and each term's document frequency), so a document's
score does not depend on its shard; each shard gives its k best for each query, and the k best of those are the answer.

1. One scan builds the index: shards of at most ``SHARD_BYTES`` of text and ``SHARD_ROWS`` documents, each a file in the
   shared folder with its terms, their lists, lengths and ids. A checkpointed table names the files.
2. Queries are a stated set: they come to the driver in blocks of at most ``BLOCK_TERMS`` terms, each of which is broadcast
   to two scans of the index, not of the texts: one of the shards' term directories for document frequencies, one to search.
3. In a shard, documents are put in an order in which like ones are near each other. Block-max MaxScore: lists in over
   1 / ``DENSE`` of a shard, which have most of the postings, are kept as rows in blocks of ``BLOCK`` documents with their
   maximum in each; the others are added up by document, one query at a time. A block can hold an answer only where its
   best sum of rare lists and the maxima of the frequent ones reach the k-th best score so far. The blocks with the best
   sums are scored first, which raises the threshold, then those that still reach it; frequent lists of all other blocks
   are never touched. Within a block they are first multiplied in single precision, rounded up by what that can lose, and
   in double precision only for documents that still reach the threshold, so scores and answers are exact.
   Queries go through a shard ``CHUNK_CELLS`` (query, document) pairs at a time, and thresholds are carried on to a task's next shard.

score = sum over the query's words of idf(t) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)),
idf(t) = ln(1 + (N - df + 0.5) / (df + 0.5)); words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Scores are rounded to
six places before they are ranked; ties go to the smaller doc_id (a null one is largest).

Defined cases: null and blank texts count as documents of length 0 and are never found; as queries they find nothing. A
document without a word of the query is no answer, so a query may have fewer than k. Repeated document rows are separate
documents; repeated query rows are answered each. Extra columns stay out. Ids are whole numbers of up to 64 bits; others raise
an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .checkpoints import fresh
from .text import Words, as_long, by_slice, member, release, slices, spread, table, utf8

K, K1, B = 10, 1.2, 0.75
BLOCK, DENSE, CHUNK_CELLS, SHARD_BYTES, SHARD_ROWS, BLOCK_TERMS = 64, 16, 1 << 21, 24 << 20, 1 << 16, 2_000_000
TASKS_A_CORE = 2
_ROUND = 6
_KINDS = ("<u8", "<u4", "<u4", "<u4", "<u4", "<i8", "u1")


def bags(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of the distinct terms of each row (by row), and the rows' lengths in words."""
    data, borders = utf8(part.column("text"))
    w = Words(data, borders, lower=True)
    h = w.hashes()
    order = np.lexsort((h, w.of))
    row, h = w.of[order], h[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
    return row[first], h[first], np.diff(np.r_[first, len(h)]), np.diff(w.first)


@dataclass
class Queries:
    """A block of queries over the block's sorted terms; the terms of query i are at first[i] to first[i + 1]."""

    ids: np.ndarray
    unnamed: np.ndarray
    numbers: np.ndarray
    terms: np.ndarray
    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    documents: int = 0
    mean_length: float = 1.0


def blocks(queries: DataFrame, limit: int) -> Iterator[Queries]:
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        row, h, n, _ = bags(part)
        first = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x.astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64))) for x in (h, n)]
        return pa.RecordBatch.from_arrays([part.column("query_id"), *lists], ["query_id", "terms", "counts"])

    held, size, number = [], 0, 0
    packed = queries.select(F.col("query_id").cast("long").alias("query_id"), "text").where("text is not null").mapInArrow(by_slice(run), "query_id long, terms array<long>, counts array<long>")
    for r in packed.toLocalIterator():
        if not r.terms:
            continue
        if held and size + len(r.terms) > limit:
            yield _block(held, number)
            number += len(held)
            held, size = [], 0
        held.append((r.query_id, np.array(r.terms, np.int64).view(np.uint64), np.array(r.counts, np.float64)))
        size += len(r.terms)
    if held:
        yield _block(held, number)


def _block(held: list[tuple], number: int) -> Queries:
    every = np.concatenate([h for _, h, _ in held])
    terms, term = np.unique(every, return_inverse=True)
    first = np.r_[0, np.cumsum([len(h) for _, h, _ in held])]
    return Queries(np.array([-1 if i is None else i for i, _, _ in held]), np.array([i is None for i, _, _ in held]), np.arange(number, number + len(held)), terms, first, term, np.concatenate([c for _, _, c in held]))


def _saved(uri: str, arrays: list[np.ndarray]) -> str:
    """Writes the arrays of _KINDS as a file of the folder; its name."""
    store, folder = fs.FileSystem.from_uri(uri)
    name, codec = uuid.uuid4().hex, pa.Codec("zstd", compression_level=1)
    with store.open_output_stream(f"{folder}/{name}") as out:
        for x, kind in zip(arrays, _KINDS, strict=True):
            raw = x.astype(kind).tobytes()
            data = codec.compress(raw).to_pybytes()
            out.write(np.array([len(raw), len(data)], "<u8").tobytes() + data)
    return name


def _loaded(uri: str, name: str, some: int = len(_KINDS)) -> list[np.ndarray]:
    """The first arrays of a file."""
    store, folder = fs.FileSystem.from_uri(uri)
    codec, out = pa.Codec("zstd"), []
    with store.open_input_file(f"{folder}/{name}") as f:
        for kind in _KINDS[:some]:
            raw, size = np.frombuffer(f.read(16), "<u8").tolist()
            out.append(np.frombuffer(codec.decompress(f.read(size), raw), kind))
    return out


@dataclass
class Index:
    """files: file, documents, words of each shard."""

    uri: str
    files: DataFrame
    documents: int
    words: int

    def dealt(self) -> DataFrame:
        """The files, some to a task: a scan's later shards gain from the thresholds of its first, and counts are added up."""
        return self.files.select("file").coalesce(TASKS_A_CORE * self.files.sparkSession.sparkContext.defaultParallelism)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, size, rows = [], 0, 0
    for part in slices(batches):
        for lo in range(0, part.num_rows, SHARD_ROWS):
            piece = part.slice(lo, SHARD_ROWS)
            if held and rows + piece.num_rows > SHARD_ROWS:
                yield held
                held, size, rows = [], 0, 0
            held.append(piece)
            rows += piece.num_rows
            size += len(utf8(piece.column("text"))[0])
            if size >= SHARD_BYTES:
                yield held
                held, size, rows = [], 0, 0
    if held:
        yield held


def index(docs: DataFrame) -> Index:
    """Builds the index of docs (doc_id, text) in the shared folder."""
    uri = fresh(docs.sparkSession, "bm25")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for parts in _shards(batches):
            every, n = [], 0
            for part in parts:
                row, h, tf, length = bags(part)
                every.append((row + n, h, tf, length, part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), part.column("doc_id").is_null().to_numpy(zero_copy_only=False)))
                n += part.num_rows
            doc, h, tf, length, ids, none = (np.concatenate(x) for x in zip(*every, strict=True))
            order = np.argsort(h, kind="stable")
            h = h[order]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            rows.append((_saved(uri, [h[start], np.r_[start, len(h)], doc[order], tf[order], length, ids, none]), n, int(length.sum())))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "documents", "words"])
        release()

    files = as_long(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, "file string, documents long, words long").checkpoint()
    total = files.agg(F.sum("documents"), F.sum("words")).first()
    return Index(uri, files, total[0] or 0, total[1] or 0)


def frequencies(of: Index, q: Queries) -> None:
    """Sets the block's weights (count in the query * idf) from the term directories of all shards."""
    shared, uri = of.files.sparkSession.sparkContext.broadcast(q.terms), of.uri

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                terms, start = _loaded(uri, name, 2)
                at = member(terms, shared.value)
                some = np.flatnonzero(at >= 0)
                df[some] += np.diff(start.astype(np.int64))[at[some]]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "n"])

    got = of.dealt().mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(len(q.terms), np.int64)
    for r in got.toLocalIterator():  # at most a row for each term of the block
        df[r.term] = r.n
    q.documents, q.mean_length = of.documents, max(of.words, 1) / max(of.documents, 1)
    q.weight = q.weight * np.log(1 + (q.documents - df + 0.5) / (df + 0.5))[q.term]


class Shard:
    """A shard's lists for a block's terms; impacts are what multiplies a term's weight.

    Documents are ordered by their strongest frequent term, so that a block's documents are alike and its maxima tight.
    exact, rows, maxima: the frequent lists by document, by block in single precision, and their maxima by block. The
    postings of the others stand together by term, from first[term] to first[term + 1].
    """

    def __init__(self, n: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int) -> None:
        size = np.bincount(term, minlength=terms)
        self.dense = np.flatnonzero(size * DENSE > n)
        self.number = np.full(terms, -1, np.int64)
        self.number[self.dense] = np.arange(len(self.dense))
        frequent = self.number[term] >= 0
        self.n, self.wide = n, -(-n // BLOCK) * BLOCK
        at, own = doc[frequent], self.number[term[frequent]]
        strength = np.zeros((n, len(self.dense)), np.float32)
        strength[at, own] = impact[frequent] * np.log(1 + n / size[term[frequent]])
        strongest = strength.argmax(axis=1) if len(self.dense) else np.zeros(n, np.int64)
        del strength
        self.order = np.argsort(strongest, kind="stable")  # place to document
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.exact = np.zeros((self.wide, len(self.dense)))  # by place
        self.exact[place[at], own] = impact[frequent]
        self.blocks = self.wide // BLOCK
        self.maxima = self.exact.reshape(self.blocks, BLOCK, len(self.dense)).max(axis=1).T
        # single precision for the bounds; each product and sum may lose a rounding
        self.rows = np.ascontiguousarray(self.exact.reshape(self.blocks, BLOCK, len(self.dense)).transpose(0, 2, 1), np.float32)
        self.loss = 1 + (len(self.dense) + 8) * 2.0**-23
        where, term, impact = place[doc[~frequent]], term[~frequent], impact[~frequent]
        order = np.argsort(term, kind="stable")
        self.place, self.impact = where[order], impact[order]
        self.first = np.r_[0, np.cumsum(np.bincount(term, minlength=terms))]

    def rare(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What a query's rare terms add to each place."""
        lo = self.first[term]
        n = self.first[term + 1] - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        added = self.impact.take(at)
        added *= np.repeat(weight, n)
        return np.bincount(self.place.take(at), added, self.wide)

    def best(self, q: Queries, lo: int, hi: int, k: int, threshold: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query from lo to hi: its number, and all documents that may be among its k best and reach its
        threshold, with their scores. Raises the thresholds."""
        a, b, many = q.first[lo], q.first[hi], hi - lo
        term, weight = q.term[a:b], q.weight[a:b]
        cut = q.first[lo : hi + 1] - a
        query = np.repeat(np.arange(many), np.diff(cut))
        number = self.number[term]
        frequent = np.flatnonzero(number >= 0)
        w = np.zeros((many, len(self.dense)))
        w[query[frequent], number[frequent]] = weight[frequent]
        narrow = w.astype(np.float32)
        # rare lists in full, one query at a time, so that what is worked on stays in the cache
        rare = np.empty((many, self.blocks, BLOCK))
        for i in range(many):
            rare[i] = self.rare(term[cut[i] : cut[i + 1]], weight[cut[i] : cut[i + 1]]).reshape(self.blocks, BLOCK)
        # what a block's documents can reach
        bound = rare.max(axis=2) + w @ self.maxima
        possible = bound > 0
        slack, rank, done, step = 10.0**-_ROUND, np.argsort(-bound, axis=1), 0, 2
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in range(many)]
        while done < self.blocks:
            # each query's next blocks by bound; thresholds rise between the rounds
            now = np.zeros_like(possible)
            np.put_along_axis(now, rank[:, done : done + step], True, axis=1)
            now &= possible & (bound >= threshold[lo:hi, None] - slack)
            done, step = done + step, step * 4
            columns, rows = np.nonzero(now.T)  # by block
            if not len(rows):
                continue
            # the frequent lists of these blocks alone, rounded up, then in full for the documents that still reach it
            scores = rare[rows, columns]
            at = np.searchsorted(columns, np.arange(self.blocks + 1)).tolist()
            for j, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if len(self.dense) else ():
                if x < y:
                    scores[x:y] += (narrow[rows[x:y]] @ self.rows[j]) * self.loss
            r, x = np.nonzero((scores >= threshold[lo + rows, None] - slack) & (scores > 0))
            by = np.argsort(rows[r], kind="stable")
            r, x = r[by], x[by]
            row, s, x = rows[r], rare[rows[r], columns[r], x], columns[r] * BLOCK + x
            for i in range(0, len(row), 4096):
                some = slice(i, i + 4096)
                s[some] += np.einsum("ij,ij->i", w[row[some]], self.exact[x[some]])
            ends = np.searchsorted(row, np.arange(many + 1))
            for i in np.flatnonzero(np.diff(ends)).tolist():
                each = slice(ends[i], ends[i + 1])
                old, places = found[i]
                values, places = np.r_[old, s[each]], np.r_[places, x[each]]
                if len(values) >= k:
                    threshold[lo + i] = max(threshold[lo + i], float(np.partition(values, -k)[-k]))
                    ok = values >= threshold[lo + i] - slack
                    values, places = values[ok], places[ok]
                found[i] = values, places
        for i, (values, places) in enumerate(found):
            ok = (places < self.n) & (values > 0) & (values >= threshold[lo + i] - slack)
            if ok.any():
                yield lo + i, self.order[places[ok]], np.round(values[ok], _ROUND)


def _postings(start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists at (-1: none): the places of all their postings, and each one's list."""
    some = np.flatnonzero(at >= 0)
    lo = start[at[some]].astype(np.int64)
    n = start[at[some] + 1] - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), np.repeat(some, n)


def search(docs: DataFrame, queries: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """query_id, rank (from 1), doc_id, score for docs (doc_id, text) and queries (query_id, text)."""
    return ask(index(docs), queries, k, block_terms)


def ask(of: Index, queries: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The same from an index."""
    spark, out, uri = of.files.sparkSession, None, of.uri
    schema = "number long, query_id long, doc_id long, score double"
    for q in blocks(as_long(queries.select("query_id", "text"), "query_id"), block_terms):
        frequencies(of, q)
        shared = spark.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q = shared.value
            threshold = np.zeros(len(q.ids))
            for batch in batches:
                for name in batch.column("file").to_pylist():
                    terms, start, doc, tf, length, ids, none = _loaded(uri, name)
                    at, term = _postings(start, member(terms, q.terms))
                    doc, tf, n = doc[at].astype(np.int64), tf[at].astype(np.float64), len(length)
                    norm = K1 * (1 - B + B * length / q.mean_length)
                    shard = Shard(n, doc, term, tf * (K1 + 1) / (tf + norm[doc]), len(q.terms))
                    rank = np.lexsort((ids, none))
                    rank[rank] = np.arange(n)  # a document's place by id, null ones last
                    held: list[tuple] = []
                    many = min(256, max(16, CHUNK_CELLS // max(shard.wide, 1)))
                    for lo in range(0, len(q.ids), many):
                        for i, found, scores in shard.best(q, lo, min(lo + many, len(q.ids)), k, threshold):
                            if len(found) > k:
                                best = np.lexsort((rank[found], -scores))[:k]
                                found, scores = found[best], scores[best]
                            held.append((np.full(len(found), i), found, scores))
                    if held:
                        i, found, scores = (np.concatenate(x) for x in zip(*held, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(q.numbers[i]), pa.array(q.ids[i], mask=q.unnamed[i]), pa.array(ids[found], mask=none[found].astype(bool)), pa.array(scores)], ["number", "query_id", "doc_id", "score"])
            release()

        found = of.dealt().mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    out = out.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(32)))
    # the k best of each 32nd, then of those: no task sees all shards' answers to a query
    for by in (["number", "part"], ["number"]):
        w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100, in full, as a query against all documents."""
    docs = table(spark, sf_dir, "documents")
    return search(spread(docs), docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"))


SQL = {
    "op6_exact_topk": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS term FROM d),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
s AS (SELECT term, count(*) AS df FROM f GROUP BY term),
g AS (SELECT count(*) AS n, greatest(sum(len(w)), 1) / count(*) AS mean FROM d),
q AS (SELECT doc_id AS query_id, term, tf AS qtf FROM f WHERE doc_id % 100 = 0),
c AS (SELECT q.query_id, f.doc_id, round(sum(q.qtf * ln(1 + (g.n - s.df + 0.5) / (s.df + 0.5)) * f.tf * 2.2 / (f.tf + 1.2 * (0.25 + 0.75 * len(d.w) / g.mean))), 6) AS score
      FROM q JOIN f USING (term) JOIN s USING (term) JOIN d ON d.doc_id = f.doc_id CROSS JOIN g GROUP BY q.query_id, f.doc_id),
r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c)
SELECT query_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10"""
}
QUERIES = {"op6_exact_topk": op6_exact_topk}
