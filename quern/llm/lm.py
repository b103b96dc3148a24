"""Language-model scoring with an Elias-Fano n-gram trie of order 3.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end token; the end token is also the context of a text's
first word. With counts c over the training texts, N tokens and V distinct ones:

- base probability  p1(w) = (c(w) + 1) / (N + V + 1), from exact counts;
- p2(w | v) = (c(v w) + m2 p1(w)) / (c(v) + m2), and p3(w | u v) = (c(u v w) + m3 p2(w | v)) / (c(u v) + m3): Dirichlet
  smoothing towards the shorter context; each sums to one. A text's first token takes p2, all others p3.

The trie has levels of files in the folder that driver and executors share; a scoring task memory-maps them, and nothing
that grows with the corpus is broadcast, collected or held in memory, but for two figures a shard.

- Level 1, by ranges of the word's hash: the hashes (Elias-Fano; a word's id is its shard's base and its place) and running
  sums of counts (Elias-Fano).
- Levels 2 and 3 of a context u lie in one file, by ranges of u's id: the contexts; monotone pointers to each one's
  successors v; these, relative to their context, i.e. with the end of the range before added, so that they ascend;
  monotone pointers from each pair u v to its successors w; and these, relative to the pair. A query looks its context up,
  takes the range from the pointers, adds the end of the range before, and searches the successor within the range.
- Each pair has two bytes, each triple one: log10 of c(v|u) / (c(u) + m2), of the pair's weight m3 / (c(u v) + m3) for what it
  hands to p2, and of c(w|u v) / (c(u v) + m3), each by a code book of 256 values for its level and file. p2 and p3 are sums of these.
- The pairs of a context that makes up a 65,536th of all tokens (there are 65,536 at most) lie by a hash of the pair.
- Triples are counted in one scan, in sorted, packed blocks; a shard's blocks meet in one task. Shards follow the input's size.

A file is written under a temporary name and renamed; repeated attempts make the same bytes.

Defined cases: null and empty texts have the end token only. Without training rows every token is unknown,
N = V = 0 and p1 = 1. Rows with a null id are scored and not learned from. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import mmap
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import eliasfano
from .checkpoints import fresh
from .text import Words, crc_is, mix, no_clash, release, runs, slices, spread, table, utf8, with_fields

U = np.uint64
END = np.uint64(0x5BF0_3635_DCF6_1F2B)
MU, HOT_CONTEXT, SHARE = (50.0, 10.0), 100_000, 1 << 16
SLICE, FLUSH = 3 << 20, 1 << 21
VOCABULARY_SHARD, GRAM_SHARD = 1 << 23, 1 << 21  # tokens of the input a shard


def tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all rows, each row's end token last, and the rows' borders."""
    data, borders = utf8(part.column("text"))
    w = Words(data, borders, lower=True)
    first = w.first + np.arange(part.num_rows + 1)
    out = np.full(first[-1], END, U)
    out[np.arange(len(w.start)) + w.of] = w.hashes()
    return out, first


def before(values: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """The value of the token before each token; end before a row's first."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[first[:-1]] = end
    return out


def after(values: np.ndarray, first: np.ndarray, none: int) -> np.ndarray:
    """The value of the token after each token; none after a row's last."""
    out = np.empty_like(values)
    out[:-1] = values[1:]
    out[first[1:] - 1] = none
    return out


def _narrow(x: np.ndarray, sizes: tuple[int, ...]) -> tuple[int, bytes]:
    """The values in the fewest bytes each that sizes offer."""
    top = int(x.max()) if len(x) else 0
    size = next(b for b in sizes if top < 1 << 8 * b)
    raw = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return size, raw[:, :size].tobytes()


def _wide(data: bytes, n: int, size: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
    return out.view("<u8").ravel()


def pack(a: np.ndarray, w: np.ndarray, counts: np.ndarray) -> bytes:
    """Distinct (a, w) in order with their counts: the gaps of the distinct a, how many w each has, the w, the counts."""
    first = runs(a)
    parts = [np.diff(a[first], prepend=U(0)), np.diff(np.r_[first, len(a)]), w, counts]
    packed = [_narrow(x, s) for x, s in zip(parts, ((4, 8), (1, 4, 8), (1, 2, 3, 4, 5, 8), (1, 8)), strict=True)]
    return np.array([len(first), len(a), *(s for s, _ in packed)], "<u8").tobytes() + b"".join(b for _, b in packed)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, n, *sizes = np.frombuffer(data, "<u8", 6).astype(int).tolist()
    out, at = [], 48
    for many, size in zip((k, k, n, n), sizes, strict=True):
        out.append(_wide(data, many, size, at))
        at += many * size
    return np.repeat(np.cumsum(out[0], dtype=U), out[1].astype(np.int64)), out[2], out[3].astype(np.int64)


def counted(a: np.ndarray, w: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (a, w) in order, and the sums of their counts."""
    bits = int(w.max()).bit_length()
    if int(a.max()).bit_length() + bits <= 64:
        key = a << U(bits) | w
        if counts is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
        first = runs(key)
        a, w = key[first] >> U(bits), key[first] & U((1 << bits) - 1)
    else:
        order = np.lexsort((w, a))
        a, w = a[order], w[order]
        counts = None if counts is None else counts[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])])
        a, w, size = a[first], w[first], len(a)
        return a, w, np.diff(np.r_[first, size]) if counts is None else np.add.reduceat(counts, first)
    return a, w, np.diff(np.r_[first, len(key)]) if counts is None else np.add.reduceat(counts, first)


def merge(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return counted(*(np.concatenate(x) for x in zip(*map(unpack, blocks), strict=True)))


def _blocks(find: Callable) -> Callable:
    """For mapInArrow: find(part) gives keys (a, w) and each one's shard; emits counted blocks."""

    def flush(held: list) -> pa.RecordBatch:
        a, w, shard = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(shard, kind="stable")
        a, w, shard = a[order], w[order], shard[order]
        cut = np.r_[runs(shard), len(shard)]
        packed = [pack(*counted(a[x:y], w[x:y])) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]].astype(np.int32)), pa.array(packed, pa.binary())], ["shard", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in slices(batches, limit=SLICE):
            got = find(part)
            held.append(got)
            n += len(got[0])
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)
        held = []
        release()

    return run


_BUILT = "shard int, n long, total long, places array<long>, counts array<long>"


def _by_shard(build: Callable[[int, list[bytes]], tuple]) -> Callable:
    """For mapInArrow on rows sorted by shard: build(shard, blocks) writes a file and gives _BUILT without the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, size = None, [], 0

        def done() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((now, *build(now, blocks)), kinds, strict=True)], [c.split()[0] for c in _BUILT.split(", ")])

        for batch in batches:
            for shard, block in zip(batch.column("shard").to_pylist(), batch.column("block"), strict=True):
                if shard != now:
                    if now is not None:
                        yield done()
                    now, blocks, size = shard, [], 0
                blocks.append(block.as_py())
                size += len(blocks[-1])
                if size > 24 << 20 and len(blocks) > 8:  # add up what has come, so that repeats take no room
                    blocks = [pack(*merge(blocks))]
                    size = len(blocks[0]) // 2
        if now is not None:
            yield done()
        blocks = []
        release()

    return run


def save(uri: str, name: str, data: list[bytes]) -> None:
    store, folder = fs.FileSystem.from_uri(uri)
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        for part in data:
            out.write(part)
    store.move(temporary, f"{folder}/{name}")


def _opened(uri: str, name: str):
    store, folder = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        with open(f"{folder}/{name}", "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    with store.open_input_file(f"{folder}/{name}") as f:
        return f.read()


def relative(values: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    """The values of each range, which ascend, with the end of the range before added: they ascend throughout."""
    size = np.diff(pointers)
    some = np.flatnonzero(size)
    ends = np.zeros(len(size), U)
    ends[some] = values[pointers[1:][some] - 1].astype(U) + U(1)
    return values.astype(U) + np.repeat(np.cumsum(ends, dtype=U) - ends, size)


def within(values: eliasfano.Sequence, pointers: eliasfano.Sequence, of: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of x among the successors of each context (by number), or -1. Equal contexts are looked up once where they
    stand together."""
    first = runs(of)
    lo, hi = (pointers.get(of[first] + i).astype(np.int64) for i in (0, 1))
    start = np.where(lo > 0, values.get(np.maximum(lo - 1, 0)) + U(1), U(0)) if values.n else np.zeros(len(lo), U)
    size = np.diff(np.r_[first, len(of)])
    return values.find(np.repeat(start, size) + x, np.repeat(lo, size), np.repeat(hi, size))


def code_book(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of one byte, and the 256 values that they stand for: means of as many distinct values each."""
    known = np.unique(x)
    if len(known) > 256:
        cut = known[np.arange(1, 256) * len(known) // 256]
        code = np.searchsorted(cut, x, "right")
        of = np.searchsorted(cut, known, "right")
        book = np.bincount(of, known, 256) / np.maximum(1, np.bincount(of, minlength=256))
    else:
        code, book = np.searchsorted(known, x), np.r_[known, np.zeros(256 - len(known))]
    return code.astype(np.uint8), book.astype("<f4")


class Trie:
    """What a task needs to know: where the files are, small figures of each shard, and the frequent contexts."""

    def __init__(self, uri: str, bits: int, vocabulary: list[tuple], shards: int, least: int, mu: tuple[float, float]) -> None:
        self.uri, self.bits, self.mu, self.shards = uri, bits, mu, shards
        self.sizes = np.zeros((1 << bits) + 1, np.int64)
        for shard, n, *_ in vocabulary:
            self.sizes[shard + 1] = n
        self.base = np.cumsum(self.sizes)
        self.v, self.n = int(self.base[-1]), sum(r[2] for r in vocabulary)
        hot = sorted((int(self.base[r[0]]) + p, c) for r in vocabulary for p, c in zip(r[3], r[4], strict=True) if c >= least)
        self.hot, self.hot_counts = np.array([h for h, _ in hot], np.int64), np.array([c for _, c in hot], np.int64)
        self.range = self.v // shards + 2  # ids a shard, at most
        self.end: tuple[int, int] = (-1, 0)
        if self.v:
            (i,), (c,) = self.words(np.array([END]))
            self.end = int(i), int(c)

    def words(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """id (-1: unknown) and count of each hash; hashes ascend."""
        ids, counts = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        shard = (distinct >> U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(distinct), np.int64)
        cut = np.r_[runs(shard), len(shard)]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            s = int(shard[a])
            if not self.sizes[s + 1]:
                continue
            (known, sums), _ = _file(self.uri, f"words-{s:06d}", 2)
            at = known.find(distinct[a:b] << U(self.bits) >> U(self.bits + 1))
            ok = np.flatnonzero(at >= 0)
            ids[a + ok] = at[ok] + self.base[s]
            x = at[ok]
            counts[a + ok] = (sums.get(x + 1) - sums.get(x)).astype(np.int64)
        return ids, counts

    def base_probability(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.n + self.v + 1)

    def places(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard of each pair, and the context's number there."""
        shard = u * self.shards // max(1, self.v)
        code = u - -(-shard * self.v // self.shards)
        rank = np.searchsorted(self.hot, u)
        hot = rank < len(self.hot)
        hot[hot] = self.hot[rank[hot]] == u[hot]
        shard[hot] = (mix(mix(u[hot].astype(U)) ^ v[hot].astype(U)) % U(self.shards)).astype(np.int64)
        code[hot] = self.range + rank[hot]
        return shard, code

    def shard(self, s: int) -> tuple | None:
        """contexts, pointers, pairs, pointers of pairs, triples; their three code books; and three arrays of codes."""
        got = _file(self.uri, f"grams-{s:06d}", 5)
        if got is None:
            return None
        levels, rest = got
        books = np.frombuffer(rest, "<f4", 768).reshape(3, 256)
        k, n = levels[2].n, levels[4].n
        return levels, books, (rest[3072 : 3072 + k], rest[3072 + k : 3072 + 2 * k], rest[3072 + 2 * k : 3072 + 2 * k + n])


@lru_cache(1024)
def _file(uri: str, name: str, sequences: int):
    """The Elias-Fano sequences of a memory-mapped file and the bytes after them; None if no token led to the file."""
    try:
        data, at, out = _opened(uri, name), 0, []
    except FileNotFoundError:
        return None
    for _ in range(sequences):
        out.append(eliasfano.Sequence(data, at))
        at = out[-1].end
    return out, np.frombuffer(data, np.uint8, offset=at)


def learn(docs: DataFrame, uri: str, mu: tuple[float, float] = MU) -> Trie:
    """Builds the trie of all texts of docs in the folder."""
    store, folder = fs.FileSystem.from_uri(uri)
    store.create_dir(folder)
    docs = docs.select("text")
    size = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    about = (size[0] or 0) // 6 + size[1]
    bits = max(0, int(about // VOCABULARY_SHARD).bit_length())
    shift = U(64 - bits)
    least = max(HOT_CONTEXT, about // SHARE)

    def find(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        t, _ = tokens(part)
        return t, np.zeros(len(t), U), (t >> shift).astype(np.int32) if bits else np.zeros(len(t), np.int32)

    def build(shard: int, blocks: list[bytes]) -> tuple:
        keys, _, counts = merge(blocks)
        low = keys << U(bits) >> U(bits + 1)  # without the shard's bits, and 63 bits at most
        first = runs(low)  # two hashes that differ in the last bit alone count as one word
        low, counts = low[first], np.add.reduceat(counts, first)
        sums = np.r_[0, np.cumsum(counts)].astype(U)
        save(uri, f"words-{shard:06d}", [eliasfano.encode(low, 1 << 63 - bits), eliasfano.encode(sums, int(sums[-1]) + 1)])
        hot = np.flatnonzero(counts >= least)
        return len(low), int(counts.sum()), hot.tolist(), counts[hot].tolist()

    def shards(n: int, find: Callable, build: Callable) -> DataFrame:
        parts = docs.mapInArrow(_blocks(find), "shard int, block binary")
        return parts.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_by_shard(build), _BUILT)

    vocabulary = [tuple(r) for r in shards(1 << bits, find, build).collect()]  # a row a shard of 2**23 tokens
    trie = Trie(uri, bits, vocabulary, max(1, int(about // GRAM_SHARD)), least, mu)

    def find_triples(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        t, first = tokens(part)
        distinct, back = np.unique(t, return_inverse=True)
        ids = trie.words(distinct)[0][back]
        u = before(ids, first, trie.end[0])
        shard, code = trie.places(u, ids)
        return code.astype(U) * U(trie.v) + ids.astype(U), after(ids, first, trie.v).astype(U), shard.astype(np.int32)

    def build_grams(shard: int, blocks: list[bytes]) -> tuple:
        a, w, counts = merge(blocks)
        first = runs(a)
        pair, own = a[first], np.add.reduceat(counts, first)
        u, v = (pair // U(trie.v)).astype(np.int64), pair % U(trie.v)
        context = runs(u)
        of = np.repeat(np.arange(len(context)), np.diff(np.r_[context, len(u)]))
        total, hot = np.add.reduceat(own, context), u[context] >= trie.range
        total[hot] = trie.hot_counts[u[context][hot] - trie.range]
        real = w < U(trie.v)  # else nothing follows
        follows = np.add.reduceat(np.where(real, counts, 0), first)
        number = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(a)]))[real]
        ends = np.r_[0, np.cumsum(np.bincount(number, minlength=len(first)))]
        starts = np.r_[context, len(u)]
        m2, m3 = trie.mu
        codes, books = zip(*map(code_book, (np.log10(own / (total[of] + m2)), np.log10(m3 / (follows + m3)), np.log10(counts[real] / (follows[number] + m3)))), strict=True)
        pairs, triples = relative(v, starts), relative(w[real], ends)
        above = lambda x: int(x[-1]) + 1 if len(x) else 1
        levels = [(u[context].astype(U), int(u[-1]) + 1), (starts.astype(U), len(u) + 1), (pairs, above(pairs)), (ends.astype(U), len(number) + 1), (triples, above(triples))]
        save(uri, f"grams-{shard:06d}", [*(eliasfano.encode(x, n) for x, n in levels), *(b.tobytes() for b in books), *(c.tobytes() for c in codes)])
        return len(u), len(number), [], []

    if trie.v:
        shards(trie.shards, find_triples, build_grams).agg(F.sum("total")).first()
    return trie


def probabilities(part: pa.RecordBatch, trie: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows' borders, and count, base and model probability of each token."""
    t, first = tokens(part)
    distinct, local = np.unique(t, return_inverse=True)
    ids, counts = trie.words(distinct) if trie.v else (np.full(len(distinct), -1), np.zeros(len(distinct), np.int64))
    n = len(distinct)
    end = int(np.searchsorted(distinct, END))  # each row has one
    prior = before(local, first, end)
    base = trie.base_probability(counts[local])
    m2, m3 = trie.mu
    p = m2 / (counts[prior] + m2) * base
    pairs, pair = np.unique(prior * n + local, return_inverse=True)
    u, v = ids[pairs // n], ids[pairs % n]
    shard, place, weight, own = np.full(len(pairs), -1), np.full(len(pairs), -1), np.ones(len(pairs)), np.zeros(len(pairs))
    known = np.flatnonzero((u >= 0) & (v >= 0))
    shard[known], code = trie.places(u[known], v[known])
    numbers = np.empty(len(pairs), np.int64)
    numbers[known] = code
    # the tokens that follow a pair of their row
    later = np.ones(len(t), bool)
    later[first[:-1]] = False
    later = np.flatnonzero(later)
    wanted, triple = np.unique(pair[later - 1] * n + local[later], return_inverse=True)
    from_pair, w = wanted // n, ids[wanted % n]
    third = np.zeros(len(wanted))
    order, of = np.argsort(shard, kind="stable"), np.argsort(shard[from_pair], kind="stable")
    present = np.unique(shard[known])
    cut, cut3 = (np.stack([np.searchsorted(shard[x], present, side) for side in ("left", "right")]).T.tolist() for x in (order, from_pair[of]))
    for s, (lo, hi), (lo3, hi3) in zip(present.tolist(), cut, cut3, strict=True):
        got = trie.shard(s)
        if got is None:
            continue
        (contexts, starts, seconds, ends, thirds), books, codes = got
        at = order[lo:hi]
        context = numbers[at]
        once = runs(context)
        c = np.repeat(contexts.find(context[once].astype(U)), np.diff(np.r_[once, len(at)]))
        at, c = at[c >= 0], c[c >= 0]
        i = within(seconds, starts, c, v[at].astype(U))
        at, i = at[i >= 0], i[i >= 0]
        place[at], own[at], weight[at] = i, 10.0 ** books[0][codes[0][i]], 10.0 ** books[1][codes[1][i]]
        at = of[lo3:hi3]
        at = at[(place[from_pair[at]] >= 0) & (w[at] >= 0)]
        i = within(thirds, ends, place[from_pair[at]], w[at].astype(U))
        at, i = at[i >= 0], i[i >= 0]
        third[at] = 10.0 ** books[2][codes[2][i]]
    p = p + own[pair]
    p[later] = third[triple] + weight[pair[later - 1]] * p[later]
    return first, counts[local], base, p


def score(docs: DataFrame, trie: Trie, columns: list[str]) -> DataFrame:
    """The named columns, n_tokens, n_known, train_tokens, base_score, score."""
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    no_clash(columns, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            first, counts, base, model = probabilities(part, trie)
            rows = first[:-1]
            out = [np.diff(first), np.add.reduceat((counts > 0).astype(np.int64), rows), np.full(part.num_rows, trie.n, np.int64), np.add.reduceat(np.log10(base), rows), np.add.reduceat(np.log10(model), rows)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *map(pa.array, out)], [*columns, *added])
        release()

    chosen = docs.select(*columns, "text") if "text" not in columns else docs.select(*columns)
    return chosen.mapInArrow(run, with_fields(chosen.schema, columns, "n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    trie = learn(docs.where(F.col("doc_id").isNotNull() & ~crc_is("doc_id", 7, 2)), fresh(spark, "lm"))
    return score(docs.select("doc_id", crc_is("doc_id", 7, 2).alias("held_out"), "text"), trie, ["doc_id", "held_out"])


QUERIES = {"op8_lm_scoring": op8_lm_scoring}
SQL: dict[str, str] = {}
