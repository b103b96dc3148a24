"""Near-duplicate documents by an LSH forest of MinHash signatures, with links confirmed on full shingle sets.

Documents are sets of five-word shingles (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``); two are linked if
100 * intersection >= percent * union, and a component is what links connect.

1. Documents with equal sets form a class, numbered; one of them stands for it. Only these go on, so copies are never paired.
2. Forest: ``TREES`` sorted orders, each of its own run of the signature's values. A tree's region is the documents that
   share its first ``DEPTH`` values. A pair at similarity s is in a common region with probability
   1 - (1 - s^3)^20, i.e. all but 6e-9 of the pairs at 0.85 and all but 6e-7 of those at 0.8.
3. Round one: candidates are each document's neighbours in the sorted order of a tree, which have the longest common prefix
   with it, and the first document of its region. Each document is verified against the candidates that it meets in most
   trees, and links are joined to components.
4. Round two: in regions whose documents lie in several components, each document's shingles that occur in another
   component are counted. Documents are verified against the region's most central one, that with the most of them.
5. Round three, so that no link is lost: what still lies in several components of a region is compared across components,
   every pair, in blocks. Here the forest is descended: a region of over ``DENSE`` documents is split by its next value, and
   so on for up to ``DEEPER`` values, until it is small. (A pair that is split in every tree and that no chain of links
   joins is missed: of the pairs in regions that are one deeper at most 4e-7 at 0.85 and 3e-5 at 0.8, at the full depth 4e-4
   and 9e-3.) Pairs are left
   out only where a link is ruled out by the sizes, by the counts of round two, by how many shingles a document shares with
   its main component as a whole, or by the parities (the sets differ by at least as many shingles as there are buckets that
   hold an odd number in one and an even number in the other, a bound that holds for certain), or where as few of the 60
   signature values agree as 8 standard deviations below the threshold (of pairs at 0.85 less than 1e-12). With two buckets a
   shingle or more, few pairs further than 0.03 below the threshold are left, however many documents a region has.
6. Components come from min-label propagation with pointer jumping over the links, in checkpointed rounds.

Texts lie in blocks (``blocks.py``); only those of documents that share a region are read again, compressed, and sent to
their pairs.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; texts of fewer than five words
have one shingle, the whole sequence. Rows that share an id are linked each by its own set. Rows with a null id get a null
component, are linked with nothing and are kept. Each row reports its own n_shingles. Thresholds below 80 % are refused, as
20 trees of three values would miss too many links. Ids are whole numbers of up to 64 bits; others raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Blocks, store
from .checkpoints import folder
from .text import BYTE_BASE, WORD_BASE, Words, as_long, mix, prefix, runs, span_hash, spread, table, utf8, with_fields

WORDS, PERCENT, TREES, DEPTH = 5, 85, 20, 3
DEEPER, DENSE, PAIR_BLOCK, BUCKETS = 4, 2048, 1024, 2048
_ROW_BITS = 13
_SEEDS = mix(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(BYTE_BASE))


def sets(part: pa.RecordBatch, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, by row and ascending (51 bits), and the rows' borders."""
    data, borders = utf8(part.column("text"))
    w = Words(data, borders, lower=True)
    p = prefix(w.hashes(), WORD_BASE)
    at = w.windows(size)
    h, row = span_hash(p, at, at + size, WORD_BASE), w.of[at]
    n = np.diff(w.first)
    few = np.flatnonzero((n > 0) & (n < size))
    h = np.concatenate([h, span_hash(p, w.first[few], w.first[few + 1], WORD_BASE)])
    row = np.concatenate([row, few])
    key = np.sort((row.astype(np.uint64) << np.uint64(64 - _ROW_BITS)) | (h >> np.uint64(_ROW_BITS)))
    key = key[runs(key)]
    row = (key >> np.uint64(64 - _ROW_BITS)).astype(np.int64)
    return key & np.uint64((1 << 64 - _ROW_BITS) - 1), np.searchsorted(row, np.arange(part.num_rows + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values (rows x TREES * DEPTH, 32 bits); rows with an empty set have zeros."""
    some = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, TREES * DEPTH), np.uint32)
    h = mix(h)
    for i in range(out.shape[1]):
        v = ((h ^ _SEEDS[2 * i]) * (_SEEDS[2 * i + 1] | np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
        if len(some):
            out[some, i] = np.minimum.reduceat(v, first[some])
    return out


def _sum_by_row(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def fingerprints(blocks: Blocks, size: int) -> DataFrame:
    """doc_id, block, row, n, f1, f2 (of the set), sig of each row."""

    def run(block: int, whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, whole.num_rows, 1 << _ROW_BITS):
            part = whole.slice(lo, 1 << _ROW_BITS)
            h, first = sets(part, size)
            f = [_sum_by_row(mix(h ^ np.uint64(s)), first).view(np.int64) for s in (11, 12)]
            packed = pa.array([r.tobytes() for r in signatures(h, first)], pa.binary())
            where = [pa.array(np.full(part.num_rows, block)), pa.array(np.arange(lo, lo + part.num_rows, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *where, pa.array(np.diff(first)), *map(pa.array, f), packed], ["doc_id", "block", "row", "n", "f1", "f2", "sig"])

    return blocks.each(run, "doc_id long, block long, row int, n long, f1 long, f2 long, sig binary")


def forest(reps: DataFrame) -> DataFrame:
    """tree, key (hash of the first DEPTH values), rest, more (the DEEPER values after them, in order), rep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(n, -1).astype(np.uint64)
            out = []
            for t in range(TREES):
                order = np.roll(sig, -t * DEPTH, axis=1)
                key = np.zeros(n, np.uint64)
                for j in range(DEPTH):
                    key = mix(key ^ (order[:, j] + np.uint64(j + 1)))
                next_ = [(order[:, DEPTH + j] << np.uint64(32) | order[:, DEPTH + j + 1]) ^ np.uint64(1 << 63) for j in (0, 2)]
                out.append((np.full(n, t, np.int32), key.view(np.int64), *(x.view(np.int64) for x in next_)))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.chunked_array([b.column("rep")] * TREES).combine_chunks()], ["tree", "key", "rest", "more", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "tree int, key long, rest long, more long, rep long")


def descended(rows: DataFrame) -> DataFrame:
    """tree, part, rep: the regions of rows (tree, key, rest, more, rep, many), those of over DENSE documents split by their next
    values until they are small or no value is left."""
    high = lambda c: F.shiftright(c, 32)
    paths = [("key", high("rest")), ("key", "rest"), ("key", "rest", high("more")), ("key", "rest", "more")][:DEEPER]
    out, big = rows.where(F.col("many") <= DENSE).select("tree", F.col("key").alias("part"), "rep"), rows.where(F.col("many") > DENSE)
    if not big.limit(1).count():
        return out
    big = big.select("tree", "rep", *(F.xxhash64(F.lit(d), *path).alias(f"p{d}") for d, path in enumerate(paths)))
    sizes = [big.groupBy("tree", f"p{d}").agg(F.count("*").alias(f"n{d}")) for d in range(len(paths))]
    for d, size in enumerate(sizes):
        big = big.join(size, ["tree", f"p{d}"])
    last = len(paths) - 1
    choice = F.coalesce(*(F.when(F.col(f"n{d}") <= DENSE, F.struct(F.col(f"p{d}").alias("part"), F.col(f"n{d}").alias("n"))) for d in range(last)), F.struct(F.col(f"p{last}").alias("part"), F.col(f"n{last}").alias("n")))
    big = big.select("tree", "rep", choice.alias("chosen")).where("chosen.n > 1")
    return out.union(big.select("tree", "chosen.part", "rep"))


def neighbours(rows: DataFrame) -> DataFrame:
    """a, b: documents that stand next to each other in a tree's order and share its region. The order is cut into ranges, so
    that a large region is many tasks; two that a cut parts meet in other trees or rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            tree, key, rep = (b.column(c).to_numpy() for c in ("tree", "key", "rep"))
            if last is not None:
                tree, key, rep = (np.r_[x, y] for x, y in zip(last, (tree, key, rep), strict=True))
            last = tree[-1:], key[-1:], rep[-1:]
            ok = (tree[1:] == tree[:-1]) & (key[1:] == key[:-1])
            x, y = rep[1:][ok], rep[:-1][ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

    order = ["tree", "key", "rest", "more", "rep"]
    return rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def texts_of(blocks: Blocks, used: DataFrame) -> DataFrame:
    """rep, z: the compressed texts of used (rep, block, row)."""
    wanted = used.groupBy("block").agg(F.collect_list(F.struct("row", "rep")).alias("rows")).withColumn("part", F.lit(0))  # at most a block's rows

    def run(block: int, read: Callable, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        own, codec = rows[0][1].values, pa.Codec("zstd", compression_level=1)
        raw = [t.encode() for t in read().column("text").take(own.field("row")).to_pylist()]
        z = [len(r).to_bytes(8, "little") + codec.compress(r).to_pybytes() for r in raw]
        yield pa.RecordBatch.from_arrays([own.field("rep"), pa.array(z, pa.binary())], ["rep", "z"])

    return blocks.beside(wanted, run, "rep long, z binary")


def _sets_of(column: pa.Array, size: int) -> list[np.ndarray]:
    known: dict[bytes, np.ndarray] = {}
    out = []
    for z in column.to_pylist():
        got = known.get(z)
        if got is None:
            raw = pa.Codec("zstd").decompress(z[8:], int.from_bytes(z[:8], "little")).to_pybytes()
            part = pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["text"])
            if len(known) > 64:
                known.clear()
            got = known[z] = sets(part, size)[0]
        out.append(got)
    return out


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold."""
    texts = texts.select("rep", "z")
    both = pairs.select("a", "b").join(texts.select(F.col("rep").alias("a"), F.col("z").alias("za")), "a")
    both = both.join(texts.select(F.col("rep").alias("b"), F.col("z").alias("zb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                ok = []
                for x, y in zip(_sets_of(b.column("za"), size), _sets_of(b.column("zb"), size), strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
                b = b.filter(pa.array(ok, pa.bool_()))
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def settled(df: DataFrame, rows: int = 250_000) -> DataFrame:
    """df written to the shared folder and read in partitions of about so many rows, for small tables that are used again."""
    out = df.checkpoint()
    return out.coalesce(max(1, -(-out.count() // rows)))


def components(links: DataFrame) -> DataFrame:
    """v, comp: the smallest vertex that links lead to, for each vertex of links (a, b); links is read twice."""
    edges = settled(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    parts = edges.rdd.getNumPartitions()
    labels = edges.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("comp")).coalesce(parts).checkpoint()
    while True:
        near = edges.join(labels.select(F.col("v").alias("u"), "comp"), "u").coalesce(parts).groupBy("v").agg(F.min("comp").alias("m"))
        step = labels.join(near, "v").select("v", F.col("comp").alias("old"), F.least("comp", "m").alias("comp")).coalesce(parts)
        up = labels.select(F.col("v").alias("comp"), F.col("comp").alias("top"))
        new = step.join(up, "comp", "left").select("v", "old", F.least("comp", F.coalesce("top", "comp")).alias("comp")).coalesce(parts).checkpoint()
        changed = new.where("old <> comp").limit(1).count()
        labels = new.select("v", "comp")
        if not changed:
            return labels


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components found, joined by more links."""
    for end in ("a", "b"):
        links = links.join(found.select(F.col("v").alias(end), F.col("comp").alias(f"c{end}")), end, "left").withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
    over = components(links.where("a <> b").checkpoint()).select("v", F.col("comp").alias("to"))
    old = found.join(over.withColumnRenamed("v", "comp"), "comp", "left").select("v", F.coalesce("to", "comp").alias("comp"))
    new = over.join(found.select("v"), "v", "left_anti").select("v", F.col("to").alias("comp"))
    return settled(old.union(new))


def shingles(texts: DataFrame, of: DataFrame, size: int) -> DataFrame:
    """The rows of of (rep, comp), each with every shingle s of rep's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                own = _sets_of(b.column("z"), size)
                rows = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
                yield pa.RecordBatch.from_arrays([b.column("rep").take(rows), b.column("comp").take(rows), pa.array(np.concatenate(own).view(np.int64))], ["rep", "comp", "s"])

    return texts.select("rep", "z").join(of.select("rep", "comp").distinct(), "rep").select("rep", "comp", "z").mapInArrow(run, "rep long, comp long, s long")


def shared_shingles(texts: DataFrame, held: DataFrame, size: int) -> DataFrame:
    """rep, m: how many of a document's shingles occur in another component, for the documents of held (rep, comp)."""
    each = shingles(texts, held, size)
    common = settled(each.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("s"), 1_000_000)
    return each.join(common, "s").groupBy("rep").agg(F.count("*").alias("m"))


def parities(texts: DataFrame, of: DataFrame, size: int) -> DataFrame:
    """rep, odd: for each rep of of, a bit a bucket of its shingles, set where their number is odd; ``BUCKETS`` or, for
    larger sets, two to four a shingle, a power of two, so that those of a larger set can be folded to fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                odd = [_odd(s).tobytes() for s in _sets_of(b.column("z"), size)]
                yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(odd, pa.binary())], ["rep", "odd"])

    return texts.select("rep", "z").join(of.select("rep").distinct(), "rep").mapInArrow(run, "rep long, odd binary")


def _odd(s: np.ndarray) -> np.ndarray:
    buckets = max(BUCKETS, 1 << (2 * len(s) - 1).bit_length())
    count = np.bincount((mix(s) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view("<u8")


def _folded(odd: np.ndarray, words: int) -> np.ndarray:
    """Rows of parities as of so many times 64 buckets, a number they have at least."""
    return np.bitwise_xor.reduce(odd.reshape(len(odd), -1, words), axis=1)


def shared_with_main(texts: DataFrame, left: DataFrame, size: int) -> DataFrame:
    """rep, main, mm: the largest component beside its own in most of a document's regions (tree, part, rep, comp), and how
    many of its shingles occur there."""
    sizes = left.groupBy("tree", "part", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("tree", "part").agg(F.max(F.struct("c", (-F.col("comp")).alias("comp"))).alias("x")).select("tree", "part", (-F.col("x.comp")).alias("main"))
    wanted = settled(_favourites(left.join(main, ["tree", "part"]).where("comp <> main").select(F.col("rep").alias("a"), F.col("main").alias("b"))).select(F.col("a").alias("rep"), F.col("b").alias("comp")))
    members = left.select("rep", "comp").distinct().join(wanted.select("comp").distinct(), "comp", "left_semi")
    known = shingles(texts, members, size).select("comp", "s").distinct()
    found = shingles(texts, wanted, size).join(known, ["comp", "s"]).groupBy("rep").agg(F.count("*").alias("mm"))
    return wanted.join(found, "rep", "left").select("rep", F.col("comp").alias("main"), F.coalesce("mm", F.lit(0)).alias("mm"))


def _in_blocks(left: DataFrame) -> DataFrame:
    """Rows of a region in blocks of about ``PAIR_BLOCK``; a row goes to each pair of blocks that has its own, so that a
    task holds two blocks. Sorted by tree, part and pair."""
    many = settled(left.groupBy("tree", "part").agg(F.count("*").alias("many")).where(F.col("many") > PAIR_BLOCK))
    left = left.join(many, ["tree", "part"], "left")
    last = F.coalesce(F.floor(F.col("many") / PAIR_BLOCK), F.lit(0)).cast("int")
    left = left.withColumn("block", F.pmod(F.xxhash64("rep"), last + 1).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    left = left.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("many", "other")
    key = ["tree", "part", "lo", "hi"]
    return left.select(*key, "block", "rep", "comp", "n", "m", "main", "mm", "sig", "odd").repartition(*key).sortWithinPartitions(*key)


def _cross(percent: int):
    """Within each region (rows arrive sorted by it), the pairs of different components that may be linked."""
    least = int(TREES * DEPTH * percent / 100 - 8 * np.sqrt(TREES * DEPTH * percent / 100 * (1 - percent / 100)))

    before = [(np.arange(t)[:, None] * DEPTH + np.arange(DEPTH + DEEPER)) % (TREES * DEPTH) for t in range(TREES)]

    def near(i, j, n, odd, words):
        """Which of the rows j may have a link with row i by the parities."""
        ok = np.zeros(len(j), bool)
        for w in np.unique(words[j]):
            at = np.flatnonzero(words[j] == w)
            least = min(w, words[i])
            apart = np.bitwise_count(_folded(np.stack([odd[k] for k in j[at]]), least) ^ _folded(odd[i][None], least)).sum(axis=1, dtype=np.int64)
            # J >= p/100 needs (100 + p) * difference <= (100 - p) * (sum of sizes)
            ok[at] = (100 + percent) * apart <= (100 - percent) * (n[j[at]] + n[i])
        return ok

    def pairs(tree, alone, block, rep, comp, n, m, main, mm, sig, odd) -> Iterator[pa.RecordBatch]:
        words = np.array([len(x) for x in odd])
        for i in range(len(rep)):
            # J >= p/100 needs (100 + p) * intersection >= p * (sum of sizes); an intersection has at most m shingles of
            # either document, and mm of one with a member of its main component
            most = np.minimum(np.where(comp[:i] == main[i], mm[i], m[i]), np.where(main[:i] == comp[i], mm[:i], m[:i]))
            j = np.flatnonzero((comp[:i] != comp[i]) & (alone | (block[:i] != block[i])) & ((100 + percent) * np.minimum(most, np.minimum(n[:i], n[i])) >= percent * (n[:i] + n[i])))
            if len(j):
                same = sig[j] == sig[i]
                # a pair that shares a tree's longer prefix has met in that tree, whatever its region's depth
                j = j[(same.sum(axis=1) >= least) & ~same[:, before[tree]].all(axis=2).any(axis=1)]
            if len(j):
                j = j[near(i, j, n, odd, words)]
            if len(j):
                a, b = np.minimum(rep[j], rep[i]), np.maximum(rep[j], rep[i])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def columns(rows):
        *plain, sig, odd = zip(*rows, strict=True)
        return *map(np.array, plain), np.frombuffer(b"".join(sig), np.uint32).reshape(len(sig), -1), [np.frombuffer(x, "<u8") for x in odd]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != now:
                    if len(held) > 1:
                        yield from pairs(now[0], now[2] == now[3], *columns(held))
                    now, held = row[:4], []
                held.append(row[4:])
        if len(held) > 1:
            yield from pairs(now[0], now[2] == now[3], *columns(held))

    return run


def _spread(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows, with their component, of regions that hold several."""
    held = rows.join(found.select(F.col("v").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    held = settled(held, 1_000_000)
    # written first, so that the join's sides are plain shuffles, of which Spark splits the large partitions
    several = settled(held.groupBy("tree", "part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("tree", "part"))
    return settled(held.join(several, ["tree", "part"]), 1_000_000)


def _favourites(star: DataFrame) -> DataFrame:
    """For each a the b that it meets most often (ties: the smallest)."""
    best = star.groupBy("a", "b").agg(F.count("*").alias("c")).groupBy("a").agg(F.max(F.struct("c", (-F.col("b")).alias("b"))).alias("x"))
    return best.select("a", (-F.col("x.b")).alias("b"))


def linked(blocks: Blocks, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """v, comp: the component of each linked class of reps (rep, block, row, n, sig)."""
    rows = forest(reps)
    heads = settled(rows.groupBy("tree", "key").agg(F.min("rep").alias("head"), F.count("*").alias("many")).where("many > 1"))
    rows = settled(rows.join(heads, ["tree", "key"]), 1_000_000)
    used = settled(rows.select("rep").distinct().join(reps.select("rep", "block", "row"), "rep"))
    texts = settled(texts_of(blocks, used), 20_000)
    # round one: the region's first document, and the neighbours in the sorted order
    star = rows.where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    found = components(settled(verified(settled(_favourites(star.union(neighbours(rows)))), texts, size, percent)))
    # round two: the most central document of regions that hold several components
    regions = rows.select("tree", F.col("key").alias("part"), "rep")
    held = _spread(regions, found)
    if not held.limit(1).count():
        return found
    shared = settled(shared_shingles(texts, held, size))
    held = held.join(shared, "rep").join(reps.select("rep", "n"), "rep")
    centre = settled(held.groupBy("tree", "part").agg(F.max(F.struct((F.col("m") - F.col("n")).alias("own"), "m", "rep", "comp")).alias("c")))
    star = held.join(centre, ["tree", "part"]).where("comp <> c.comp").select(F.col("rep").alias("a"), F.col("c.rep").alias("b"))
    found = extended(found, settled(verified(settled(_favourites(star)), texts, size, percent)))
    # round three: all pairs of different components that may be linked
    left = _spread(descended(rows), found).join(shared, "rep").join(reps.select("rep", "n", "sig"), "rep")
    left = settled(left.where(100 * F.col("m") >= percent * F.col("n")), 250_000)
    left = left.join(shared_with_main(texts, left, size), "rep", "left").join(settled(parities(texts, left, size), 250_000), "rep")
    none = F.lit(-1).cast("long")
    left = left.select("tree", "part", "rep", "comp", "n", "m", F.coalesce("main", none).alias("main"), F.coalesce("mm", none).alias("mm"), "sig", "odd")
    more = settled(_in_blocks(left).mapInArrow(_cross(percent), "a long, b long").distinct())
    return extended(found, settled(verified(more, texts, size, percent))) if more.limit(1).count() else found


def _classified(blocks: Blocks, size: int, percent: int) -> DataFrame:
    """block, row, doc_id, n_shingles, component_id, first (whether the row is the one of its component that stays)."""
    if percent < 80:
        raise ValueError("thresholds below 80 % need more trees")
    prints = fingerprints(blocks, size).checkpoint()
    some = prints.where("n > 0 and doc_id is not null")
    reps = some.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "block", "row")).alias("x"), F.first("sig").alias("sig"))
    reps = reps.select(F.monotonically_increasing_id().alias("rep"), "f1", "f2", "n", "x.doc_id", "x.block", "x.row", "sig").checkpoint()
    found = linked(blocks, reps, size, percent)
    # of each component the row with the smallest id (ties: by its place), for all classes
    of = reps.select("rep", "f1", "f2", "n", "doc_id", "block", "row").join(found.select(F.col("v").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    least = of.groupBy("comp").agg(F.min(F.struct("doc_id", "block", "row")).alias("least"))
    of = of.join(least, "comp").select("f1", "f2", "n", "least")
    out = prints.drop("sig").join(of, ["f1", "f2", "n"], "left")
    # null ids and empty sets have a component of their own
    alone = F.col("least").isNull() | F.col("doc_id").isNull()
    first = alone | ((F.col("block") == F.col("least.block")) & (F.col("row") == F.col("least.row")))
    return out.select("block", "row", "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), first.alias("first"))


def classes(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and first (one row of each component: the smallest id, ties by place) of each row."""
    blocks = store(as_long(docs, "doc_id").select("doc_id", "text"))
    return _classified(blocks, size, percent).drop("block", "row")


def deduplicated(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each component."""
    others = [c for c in docs.columns if c != "text"]
    blocks = store(as_long(docs, "doc_id").select(F.struct(*(docs[f"`{c}`"] for c in others)).alias("own"), F.col("doc_id"), "text"))
    stay = _classified(blocks, size, percent).where("first").groupBy("block").agg(F.sort_array(F.collect_list("row")).alias("rows")).withColumn("part", F.lit(0))

    def run(block: int, read: Callable, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield read().select(["own", "text"]).take(rows[0][1].values)

    out = blocks.beside(stay, run, with_fields(blocks.schema, ["own"], "text string"))
    return out.select(*(F.col("text") if c == "text" else F.col(f"own.`{c}`").alias(c) for c in docs.columns))


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder(spark)
    out = classes(spread(table(spark, sf_dir, "documents"))).drop("first")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = {
    "op9_minhash_neardup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS v, doc_id AS t FROM documents UNION SELECT r.v, e.y FROM r JOIN e ON r.t = e.x),
k AS (SELECT v, min(t) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
FROM documents d JOIN k ON k.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
}
QUERIES = {"op9_minhash_neardup": op9_minhash_neardup}
