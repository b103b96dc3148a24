"""A corpus pipeline of five stages; each works on all that the one before kept.

1. Language ID: profiles are learned from the rows with a lang; documents without letters, or whose score (1 - distance /
   largest distance) is below ``MIN_SCORE`` for every language, go.
2. MinHash near-dedup: of each component at a similarity of 0.8 or more on five-word shingles one row stays, that with the
   smallest doc_id (ties: one of them).
3. Substring dedup: words in a window of 13 words that also starts in a smaller doc_id go; n_chars follows the text, and
   documents of which nothing is left go.
4. Benchmark decontamination: documents that hold a benchmark item within its edit budget go.
5. SentencePiece: the ids of what is left (doc_id, n_tokens, token_ids, round_trip).

Rows that share a doc_id are judged each by its own text. Rows with a null doc_id stay in stage 2 and count as larger
than all others in stage 3. Null texts go in stage 1. An empty table stays empty. Extra columns are carried along through
stage 4, whatever their names; stage 5 returns the four named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, langid, neardup, pieces, substring
from quern.llm.checkpoints import fresh, removed
from quern.llm.text import packed, table, unpacked

MIN_SCORE, SIMILARITY_PERCENT = 0.25, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = langid.learn(docs)
    own = packed(docs)
    marked = langid.predict(own, profiles, own.columns)
    return unpacked(marked.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs, percent=SIMILARITY_PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("own")
    left = substring.deduplicated(docs.select("doc_id", "text", own))
    n_chars = F.when(F.col("lost"), F.length("text")).otherwise(F.col("own.n_chars"))
    new = {"text": F.col("text"), "n_chars": n_chars}
    return left.where("not lost or text <> ''").select(*(new.get(c, F.col(f"own.`{c}`")).cast(t).alias(c) for c, t in docs.dtypes))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again, and go once the next
    stage's rows are there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(f"{path}/rows")
        docs = spark.read.parquet(f"{path}/rows")
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: An edit distance to a substring, rank-order profiles and the segmentation have no SQL form; tests/llm has a brute-force version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL}
