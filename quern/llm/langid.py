"""Language identification by rank-order n-gram profiles (out-of-place distance).

A profile is the list of a language's ``K`` most frequent character n-grams (n = 1 to 3, within words, a word's
edges counting as one symbol). A document is compared by its own ``K`` most frequent n-grams: each adds the
difference between its rank there and its rank in the profile, or ``K`` if the profile lacks it. The smallest sum wins.

Defined cases: a null text, a text without letters, or no profile at all gives ``und`` with score 0. Letters are
those of ``str.isalpha``, lower-cased; characters beyond the basic plane count as one common symbol. Ties between
n-grams go to the smaller code, ties between languages to the smaller name. Repeated rows give repeated results; extra
columns stay out of the result. Rows with a null language are not learned from. A model of over ``MAX_LANGUAGES`` languages
is refused: profiles are part of every task, so their number is bounded by contract, not cut.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import by_slice, crc_is, member, no_clash, runs, spread, table, with_fields

K = 300
MAX_LANGUAGES = 1000
#: Bytes of text that are compared at a time: their n-grams take some hundred times as much.
PREDICT_BYTES = 1 << 18
_ASTRAL = 0xFFFF
_fold: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code unit of the basic plane to its lower-case letter, or 0 if it is no letter."""
    if not _fold:
        out = np.zeros(0x10000, np.uint16)
        for i in range(0x10000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _fold.append(out)
    return _fold[0]


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded symbols of all texts with runs of non-letters as one 0 (one before and after each text), and their rows."""
    texts = [t or "" for t in texts]
    joined = "\0".join(["", *texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = fold_table()[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        folded[far] = [_ASTRAL if chr(c).isalpha() else 0 for c in points[far]]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    of = np.repeat(np.arange(len(texts) + 1), np.r_[lengths, 0] + 1)  # the 0 before a text is its own
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 0) | (folded[:-1] != 0)
    return folded[keep].astype(np.uint64), of[keep]


def grams(s: np.ndarray, n_max: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n, the positions of the n-grams and their codes (16 bits a symbol, n above them)."""
    out = []
    for n in range(1, n_max + 1):
        if len(s) < n:
            break
        parts = [s[i : len(s) - n + 1 + i] for i in range(n)]
        ok = parts[0] != 0 if n == 1 else np.ones(len(parts[0]), bool)
        for p in parts[1:-1]:
            ok &= p != 0
        if n == 2:
            ok &= (parts[0] != 0) | (parts[1] != 0)
        code = np.full(len(parts[0]), n, np.uint64)
        for p in parts:
            code = (code << np.uint64(16)) | p
        at = np.flatnonzero(ok)
        out.append((at, code[at] & np.uint64((1 << 50) - 1)))
    return out


def top_grams(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's k most frequent n-grams: row, rank, code; by row and rank."""
    s, of = symbols(texts)
    rows, codes = [], []
    for n, (at, code) in enumerate(grams(s)):
        # a gram belongs to the text of its last letter: the 0 that ends one text starts the next
        last = at + n
        row = of[np.where(s[last] == 0, last - 1, last)]
        rows.append(row)
        codes.append(code)
    if not rows:
        e = np.zeros(0, np.int64)
        return e, e, e.astype(np.uint64)
    key = np.sort((np.concatenate(rows).astype(np.uint64) << np.uint64(50)) | np.concatenate(codes))
    first = runs(key)
    count, key = np.diff(np.r_[first, len(key)]), key[first]
    row = (key >> np.uint64(50)).astype(np.int64)
    if len(key) < 1 << 25 and (not len(count) or count.max() < 1 << 25):
        order = (key >> np.uint64(50) << np.uint64(50)) | (np.uint64((1 << 25) - 1) - count.astype(np.uint64) << np.uint64(25)) | np.arange(len(key), dtype=np.uint64)
        order = (np.sort(order) & np.uint64((1 << 25) - 1)).astype(np.int64)
    else:
        order = np.lexsort((key, -count, row))
    key, row = key[order], row[order]
    rank = np.arange(len(row)) - np.repeat(f := runs(row), np.diff(np.r_[f, len(row)]))
    ok = rank < k
    return row[ok], rank[ok], key[ok] & np.uint64((1 << 50) - 1)


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows; each slice is counted before the shuffle."""

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, langs = part.column("text").to_pylist(), part.column("lang").to_pylist()
        out: dict[str, list] = {"lang": [], "gram": [], "n": []}
        for lang in sorted(set(langs)):
            s, _ = symbols([t for t, x in zip(texts, langs, strict=True) if x == lang])
            for _, code in grams(s):
                code, n = np.unique(code, return_counts=True)
                out["lang"] += [lang] * len(code)
                out["gram"].append(code.astype(np.int64))
                out["n"].append(n)
        flat = [np.concatenate(out[c]) if out[c] else np.zeros(0, np.int64) for c in ("gram", "n")]
        return pa.RecordBatch.from_arrays([pa.array(out["lang"], pa.string()), pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64())], ["lang", "gram", "n"])

    parts = docs.select("lang", "text").mapInArrow(by_slice(count), "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Profiles:
    """Ranks of the learned languages' n-grams: at most MAX_LANGUAGES x K numbers, so small enough for each task."""

    def __init__(self, rows: list[tuple[str, int, int]], k: int) -> None:
        self.k = k
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[1] for r in rows], np.uint64))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), k, np.int64)
        where = {x: i for i, x in enumerate(self.langs)}
        for lang, code, rank in rows:
            self.ranks[where[lang], np.searchsorted(self.codes, np.uint64(code))] = rank

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and the margin to the second best; score = 1 - distance / the largest possible distance."""
        n = len(texts)
        row, rank, code = top_grams(texts, self.k)
        lang, score, margin = ["und"] * n, np.zeros(n), np.zeros(n)
        if not len(row) or not self.langs:
            return lang, score, margin
        at = member(self.codes, code)
        first = runs(row)
        size = np.diff(np.r_[first, len(row)])
        distance = np.empty((len(self.langs), len(first)))
        for i, ranks in enumerate(self.ranks):
            r = ranks[at]
            distance[i] = np.add.reduceat(np.where(r < self.k, np.abs(r - rank), self.k), first)
        near = 1 - distance / (size * self.k)
        best = near.argmax(0)
        seen = row[first]
        score[seen] = near[best, np.arange(len(first))]
        if len(self.langs) > 1:
            margin[seen] = score[seen] - np.partition(near, -2, axis=0)[-2]
        for r, b in zip(seen, best, strict=True):
            lang[r] = self.langs[b]
        return lang, score, margin


def learn(docs: DataFrame, k: int = K, max_languages: int = MAX_LANGUAGES) -> Profiles:
    """Profiles of all languages in docs (lang, text); rows whose lang is null are left out."""
    counted = gram_counts(docs.where("lang is not null")).withColumn("part", F.pmod("gram", F.lit(64)))
    # the k first of each 64th of a language's n-grams, then the k first of those: no task sees them all
    for by in (["lang", "part"], ["lang"]):
        w = Window.partitionBy(*by).orderBy(F.desc("n"), "gram")
        counted = counted.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)
    top = counted.select("lang", "gram", "n", "rank")
    rows = [tuple(r) for r in top.limit(max_languages * k + 1).collect()]
    if len({r[0] for r in rows}) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    return Profiles([(r[0], r[1], r[3]) for r in rows], k)


def predict(docs: DataFrame, profiles: Profiles, columns: list[str]) -> DataFrame:
    """The named columns with lang_pred, score and margin, names that no carried column may have."""
    no_clash(columns, ["lang_pred", "score", "margin"])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, margin = profiles.predict(part.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(lang, pa.string()), pa.array(score), pa.array(margin)], [*columns, "lang_pred", "score", "margin"])

    chosen = docs.select(*columns, F.col("text").alias("text")) if "text" not in columns else docs.select(*columns)
    return chosen.mapInArrow(by_slice(run, limit=PREDICT_BYTES), with_fields(chosen.schema, columns, "lang_pred string, score double, margin double"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    profiles = learn(docs.where(F.col("doc_id").isNotNull() & ~crc_is("doc_id", 3, 1)))
    held = docs.select("doc_id", crc_is("doc_id", 3, 1).alias("held_out"), "text")
    return predict(held, profiles, ["doc_id", "held_out"])


QUERIES = {"op1_language_id": op1_language_id}
SQL: dict[str, str] = {}

if sys.byteorder != "little":
    raise ImportError("the Arrow buffers are read as little-endian")
