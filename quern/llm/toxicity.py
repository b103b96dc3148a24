"""Toxicity by maximum-scoring segments over token log-odds.

Learning (a bounded sample of labelled rows, ``max_rows``, those with the smallest hash of doc_id):

1. Half of the sample gives each word, and each beginning of four, five or six letters, its log-odds between toxic and
   other documents, with a Dirichlet prior in proportion to its count in both. Documents are counted, each by one over the
   number of those whose smallest shingle is the same (copies, most near copies). All features are kept whose z-score is at
   least ``min_z`` and whose log-odds are at least ``min_odds`` either way. A word's score is its own log-odds, else those of its
   longest beginning that has any, less a drift that makes the expected score of clean text negative.
2. lambda solves sum p exp(lambda s) = 1 over clean tokens; the other half of the sample gives K (from its clean
   documents' best segments) and a logistic curve from the evidence x to P(toxic).

Scoring: a linear scan over every occurrence of every word finds each document's maximal segments; E = K n exp(-lambda S) is the number of segments as good
that n clean tokens would have. All segments with E <= ``max_e`` are reported as passages and summed by the sum
statistic for several segments, x = max over r of lambda (S1 + .. + Sr) - r ln(K n) + ln r!.

Defined cases: a null or empty text has no tokens, hence no passages, and the score of x = -ln K. Null ids and null
labels are not learned from; a doc_id labelled several times counts as toxic if any of its rows says so. Without rows of
both labels every score is the smoothed share of toxic rows. Repeated rows give repeated results, extra columns stay out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import by_slice, crc_is, no_clash, spread, table, with_fields

MAX_ROWS = 20_000
_ONE = 1 << 20  # a document's count
TOKEN = re.compile(r"[^\W_]+")
STEMS = (6, 5, 4)
UNIT = 1000  # scores are whole thousandths
_CACHE = 200_000


def features(tokens: set[str]) -> set[str]:
    return {f"w{t}" for t in tokens} | {f"p{t[:k]}" for t in tokens for k in STEMS if len(t) >= k}


@dataclass
class Model:
    """Its features occur in the sample of labelled rows, so it is bounded by max_rows."""

    weights: dict[str, int] = field(default_factory=dict)
    default: int = -500
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, float] = (0.0, 0.0)
    max_e: float = 0.01
    informed: bool = False

    def scorer(self) -> _Scores:
        return _Scores(self)

    def evidence(self, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        """x, and the significant segments as (first token, token after the last, E)."""
        kn = math.log(self.k * max(1, len(scores)))
        best = _best(scores) / UNIT
        x = self.lam * best - kn
        if -x > math.log(self.max_e):
            return x, []
        found = [(a, b, self.lam * s / UNIT - kn) for a, b, s in maximal_segments(scores)]
        found = [f for f in found if -f[2] <= math.log(self.max_e)]
        total = 0.0
        for r, e in enumerate(sorted((f[2] for f in found), reverse=True), 1):
            total += e
            x = max(x, total + math.lgamma(r + 1))
        return x, [(a, b, math.exp(-e)) for a, b, e in found]

    def probability(self, x: float) -> float:
        z = self.curve[0] + self.curve[1] * min(max(x, -40.0), 60.0) * self.informed
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


class _Scores(dict):
    """Word to score, filled as words come; emptied when large."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> int:
        w = self.model.weights
        s = w.get("w" + word)
        if s is None:
            s = next((w[p] for k in STEMS if len(word) >= k and (p := "p" + word[:k]) in w), self.model.default)
        if len(self) >= _CACHE:
            self.clear()
        self[word] = s
        return s

    def of(self, text: str) -> np.ndarray:
        tokens = TOKEN.findall(text.lower())
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def _best(scores: np.ndarray) -> int:
    """The largest sum of a run of scores, 0 for none."""
    if not len(scores):
        return 0
    c = np.concatenate([[0], np.cumsum(scores)])
    return int((c - np.minimum.accumulate(c)).max())


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, int]]:
    """All maximal-scoring segments (start, end, score) in time linear in the tokens (Ruzzo and Tompa's scan)."""
    stack: list[tuple[int, int, int, int]] = []  # start, end, sum before start, sum at end
    total, at = 0, 0
    for i in np.flatnonzero(scores > 0).tolist():
        total += int(scores[at:i].sum())
        start, left = i, total
        total += int(scores[i])
        end, right = i + 1, total
        at = i + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - x) for a, b, x, r in stack]


def smallest_shingle(text: str | None) -> int:
    """A hash of the five tokens (all, if there are fewer) with the smallest crc32."""
    tokens = TOKEN.findall((text or "").lower())
    shingles = [" ".join(tokens[i : i + 5]).encode() for i in range(max(1, len(tokens) - 4))]
    return int.from_bytes(blake2b(min(shingles, key=lambda x: (crc32(x), x)), digest_size=8).digest(), "little", signed=True)


def _keyed(part: pa.RecordBatch) -> pa.RecordBatch:
    keys = [smallest_shingle(t) for t in part.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.int64()), part.column("toxic").cast(pa.int32())], ["doc_id", "key", "toxic"])


def _count(part: pa.RecordBatch) -> pa.RecordBatch:
    """Sums of the weights of the documents that have each feature, toxic and other; "" counts all documents."""
    counts: dict[bool, Counter] = {False: Counter(), True: Counter()}
    for text, toxic, weight in zip(*(part.column(c).to_pylist() for c in ("text", "toxic", "weight")), strict=True):
        own = counts[toxic > 0]
        for f in (*features(set(TOKEN.findall((text or "").lower()))), ""):
            own[f] += weight
    keys = [*{**counts[False], **counts[True]}]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([counts[t][k] for k in keys], pa.int64()) for t in (True, False))], ["feature", "n1", "n0"])


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, prior: float = 0.1, min_z: float = 3.0, min_odds: float = 1.5, drift: float = 0.5, max_e: float = 0.01) -> Model:
    """Fits a model on labels (doc_id, toxic) of docs (doc_id, text)."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")  # at most max_rows ids
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    keyed = sample.where(half).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(by_slice(_keyed), "doc_id long, key long, toxic int").persist()
    group = keyed.groupBy("key").agg(F.count("*").alias("n"))
    weights = keyed.join(group, "key").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("n").alias("n"))
    weighted = weights.select("doc_id", "toxic", F.round(F.lit(_ONE) / F.col("n")).cast("long").alias("weight"))
    # again at most max_rows ids
    counted = docs.select("doc_id", "text").join(F.broadcast(weighted), "doc_id").select("text", "toxic", "weight").mapInArrow(by_slice(_count), "feature string, n1 long, n0 long")
    counted = counted.groupBy("feature").agg((F.sum("n1") / _ONE).alias("n1"), (F.sum("n0") / _ONE).alias("n0")).persist()
    try:
        n1, n0 = next(((r.n1, r.n0) for r in counted.where("feature = ''").collect()), (0, 0))
        model = Model(max_e=max_e, curve=(math.log((n1 + 0.5) / (n0 + 0.5)), 0.0))
        if not n1 or not n0:
            return model
        # shares of documents that have the feature; the prior's share is that of all documents
        n, a = float(n1 + n0), F.col("n1") + F.col("n0")
        w = counted.where("feature <> ''").select(
            "feature", "n1", "n0", a.alias("df"),
            (F.log((F.col("n1") + prior * a) / (n1 + prior * n)) - F.log((F.col("n0") + prior * a) / (n0 + prior * n))).alias("odds"),
            F.sqrt(1 / (F.col("n1") + prior * a) + 1 / (F.col("n0") + prior * a)).alias("sd"),
        )
        w = w.where((F.abs(F.col("odds")) >= min_z * F.col("sd")) & (F.abs(F.col("odds")) >= min_odds))
        rows = w.collect()
    finally:
        counted.unpersist()
        keyed.unpersist()
    if not rows:
        return model
    model.default = -round(drift * UNIT)
    model.weights = {r.feature: max(-6 * UNIT, min(6 * UNIT, round(r.odds * UNIT))) - round(drift * UNIT) for r in rows}
    # tokens of clean documents by score, counted on the other half
    rest = sample.where(~half).select("text", "toxic")
    if not _calibrate(rest, model):
        return Model(max_e=max_e, curve=model.curve)
    return model


def _calibrate(rest: DataFrame, model: Model) -> bool:
    def scan(part: pa.RecordBatch) -> pa.RecordBatch:
        tokens, best = Counter(), Counter()
        of = model.scorer()
        for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
            s = of.of(text or "")
            if toxic == 0:
                v, c = np.unique(s // 100, return_counts=True)
                for a, b in zip(v.tolist(), c.tolist(), strict=True):
                    tokens[a] += b
            best[(int(toxic > 0), min(_best(s) // 100, 10_000), min(len(s).bit_length(), 40))] += 1
        rows = [(0, a, 0, 0, n) for a, n in tokens.items()] + [(1, b, t, l, n) for (t, b, l), n in best.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["kind", "value", "toxic", "bits", "n"])

    # values of scores in steps of 0.1, best sums up to 1,000, lengths by powers of two: a bounded number of rows
    got = rest.mapInArrow(by_slice(scan), "kind long, value long, toxic long, bits long, n long").groupBy("kind", "value", "toxic", "bits").agg(F.sum("n").alias("n")).collect()
    tokens = [(r.value / 10, r.n) for r in got if r.kind == 0]
    docs = [(r.value / 10, r.toxic, r.bits, r.n) for r in got if r.kind == 1]
    if not docs or len({d[1] for d in docs}) < 2 or not tokens:
        return False
    v, p = np.array([t[0] for t in tokens]), np.array([t[1] for t in tokens], float)
    top = max(model.weights.values()) / UNIT
    v, p = np.append(v, top), np.append(p, 0.5)  # the best score is possible in clean text too
    p /= p.sum()
    if top <= 0 or (v * p).sum() >= 0:
        return False
    low, high = 1e-6, 1.0
    while (p * np.exp(high * v)).sum() < 1:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * v)).sum() < 1 else (low, mid)
    model.lam = low
    # the mean of a Gumbel variable lambda S - ln n is ln K + Euler's constant; documents without any positive score pull it down
    s, y, bits, n = (np.array(c, float) for c in zip(*docs, strict=True))
    length = np.maximum(1, 0.75 * 2.0**bits)
    clean = y == 0
    model.k = float(np.exp(np.average((model.lam * s - np.log(length))[clean], weights=n[clean]) - 0.5772))
    x = np.clip(model.lam * s - np.log(model.k * length), -40, 60)
    # logistic curve: Newton's method on the penalised loss, each step halved until the loss falls (labels may be separable)
    def loss(c: np.ndarray) -> float:
        z = c[0] + c[1] * x
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * c[1] ** 2 + 0.005 * c[0] ** 2)

    c = np.zeros(2)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(c[0] + c[1] * x, -40, 40)))
        g = np.array([(n * (q - y)).sum() + 0.01 * c[0], (n * (q - y) * x).sum() + c[1]])
        h = n * q * (1 - q)
        step = np.linalg.solve(np.array([[h.sum() + 0.01, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 1]]), g)
        scale = 1.0
        while scale > 1e-6 and loss(c - scale * step) > loss(c):
            scale /= 2
        if scale <= 1e-6 or np.abs(scale * step).max() < 1e-8:
            break
        c = c - scale * step
    a, b = c
    model.curve, model.informed = (float(a), float(b)), True
    return True


def score(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """The named columns with score, predicted, evidence, and passages (start, end: token numbers; e_value)."""
    no_clash(columns, ["score", "predicted", "evidence", "passages"])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        of = model.scorer()
        scores, evidence, passages = [], [], []
        for text in part.column("text").to_pylist():
            x, found = model.evidence(of.of(text or ""))
            scores.append(model.probability(x))
            evidence.append(x)
            passages.append([{"start": a, "end": b, "e_value": e} for a, b, e in found])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("e_value", pa.float64())]))
        return pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in columns), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, pa.float64()), pa.array(passages, kind)],
            [*columns, "score", "predicted", "evidence", "passages"],
        )

    chosen = docs.select(*columns, "text") if "text" not in columns else docs.select(*columns)
    added = "score double, predicted int, evidence double, passages array<struct<start: long, end: long, e_value: double>>"
    return chosen.mapInArrow(by_slice(run), with_fields(chosen.schema, columns, added))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(F.col("doc_id").isNotNull() & ~crc_is("doc_id", 5, 0)))
    held = docs.select("doc_id", crc_is("doc_id", 5, 0).alias("held_out"), "text")
    out = score(held, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


QUERIES = {"op4_toxicity": op4_toxicity}
SQL: dict[str, str] = {}
