"""The pipeline's stages against brute-force versions, on the smallest table and on odd rows."""

import collections
import re
import tracemalloc

import corpus_pipeline as pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from quern.llm import decontaminate, langid, pieces, text
from quern.llm.registry import QUERIES, SQL
from test_ops import brute_components, brute_windows, words

SF = "/root/testdata/sf0.001"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def normal(t):
    return re.sub(rb"[\x20\x09-\x0d]+", b" ", t.encode().translate(LOWER))


def edits(pattern, t):
    """Fewest edits that turn pattern into some part of t; a whole row of the table at a time."""
    t = np.frombuffer(t, np.uint8)
    k = np.arange(len(t) + 1)
    d = np.zeros(len(t) + 1, np.int64)
    for p in pattern:
        x = d + 1
        x[1:] = np.minimum(x[1:], d[:-1] + (t != p))
        d = np.minimum.accumulate(x - k) + k
    return int(d.min())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [(None, "a text in this table without id", "en", "s", 3), (900001, None, "en", "s", 0), (900002, "", None, "s", 0), (900003, "12 34 !!", "de", None, 8), rows[5], (900004, "   ", None, None, None)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
    return spark.createDataFrame([(*r, 0.5, "clash") for r in rows + odd], kinds)


def test_stages(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        before = [tuple(r) for r in kept.collect()]
        kept = stage(spark, kept, SF).cache()
        after = [tuple(r) for r in kept.collect()]
        assert kept.dtypes == docs.dtypes or [c for c, _ in kept.dtypes] == docs.columns, name
        key = lambda r: str(r)
        if name == "language_id":
            profiles = langid.learn(docs)
            lang, score, _ = profiles.predict([r[1] for r in before])
            expected = [r for r, x, s in zip(before, lang, score) if x != "und" and s >= pipeline.MIN_SCORE]
            assert {900001, 900002, 900003, 900004} & {r[0] for r in after} == set() and len(after) >= len(rows) - 6
        elif name == "minhash_near_dedup":
            found = {i: c for i, _, c in brute_components([r[:2] for r in {r[0]: r for r in before if r[0] is not None}.values()], 80)}
            expected = [r for r in {str(r): r for r in before}.values() if r[0] is None or found[r[0]] == r[0]]  # a repeated row stays once
        elif name == "substring_dedup":
            gone = {i: (n, m) for i, n, m, _ in brute_windows([r[:2] for r in before])}
            assert all(len(words(r[1])) == gone[r[0]][0] - gone[r[0]][1] for r in after)
            assert {r[0] for r in after} == {i for i, (n, m) in gone.items() if m < n or n == 0}
            assert all(r[4] == len(r[1]) for r in after if gone[r[0]][1])
            continue
        elif name == "benchmark_decontamination":
            c = duckdb.connect()
            items = [normal(t) for (t,) in c.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
            budget = decontaminate.Items(list(range(len(items))), items, decontaminate.Q, decontaminate.RATE).edits
            expected = [r for r in before if not any(edits(p, normal(r[1])) <= e for p, e in zip(items, budget))]
            assert any(len(r[1]) > 4000 for r in before) and len(expected) < len(before)
        assert sorted(after, key=key) == sorted(expected, key=key), name
    out = pipeline.STAGES[-1][1](spark, kept, SF).collect()
    m = pieces.model(pieces.MODEL)
    texts = collections.Counter((r[0], r[1]) for r in kept.select("doc_id", "text").collect())
    assert collections.Counter((r.doc_id, m.decode(r.token_ids)) for r in out) == texts


def test_run(spark):
    """The registered query: the stages over documents, each on what the one before left."""
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    out = pipeline.QUERIES["pipeline"](spark, SF).collect()
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert out and {r.doc_id for r in out} <= ids and len({r.doc_id for r in out}) == len(out)
    assert [*out[0].asDict()] == ["doc_id", "n_tokens", "token_ids", "round_trip"] and all(r.round_trip for r in out)


def test_empty(spark, docs):
    none = docs.limit(0)
    for _, stage in pipeline.STAGES:
        none = stage(spark, none, SF)
        assert none.collect() == []


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 11)) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n, s in SQL.items() if s])
def test_sql(spark, name):
    from pathlib import Path

    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    wanted = c.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(wanted, key=str)


def test_texts_go_to_python_once(spark, docs, monkeypatch):
    """Stages that carry whole rows along: what they hand to Python has each text once, and the rows come back as they were."""
    odd = docs.withColumnRenamed("kept", "a`b.c")
    frame = type(docs)
    seen, real = [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **b: (seen.append(self.schema), real(self, *a, **b))[1])
    for stage in (pipeline.language, pipeline.decontamination):
        seen.clear()
        got = stage(spark, odd, SF)
        assert seen and all(s.simpleString().count("text:") == 1 for s in seen)
        assert got.columns == odd.columns and {tuple(r) for r in got.collect()} <= {tuple(r) for r in odd.collect()} and got.count()
    alone = decontaminate.clean(docs.select("text"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert alone.columns == ["text"] and alone.count()


def test_workers_forget_pieces():
    """A worker's pieces stay for tasks that encode, and go when a task of another operator starts."""
    batch = pa.RecordBatch.from_pydict({"text": ["some text"]})
    pieces.model(pieces.MODEL).encode("some text")
    assert list(text.by_slice(lambda part: part, keeps="pieces")(iter([batch]))) == [batch]
    assert pieces.model.cache_info().currsize == 1
    assert list(text.by_slice(lambda part: part)(iter([batch]))) == [batch]
    assert pieces.model.cache_info().currsize == 0
    pieces.model(pieces.MODEL)
    text.forget()
    assert pieces.model.cache_info().currsize == 0


def test_language_id_memory(spark, docs, monkeypatch):
    """Comparing a megabyte of text takes some tens of megabytes in a worker."""
    frame, held = type(docs), []
    profiles = langid.learn(docs)
    monkeypatch.setattr(frame, "mapInArrow", lambda self, fn, schema: held.append(fn) or self)
    langid.predict(docs.select("doc_id", "text"), profiles, ["doc_id"])
    words = ["".join(chr(97 + i // 26**j * 7919 % 26) for j in range(4)) + "ndings" for i in range(150_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": [" ".join(words[i * 150 : i * 150 + 150]) for i in range(1000)]})
    langid.fold_table()
    tracemalloc.start()
    got = sum(part.num_rows for part in held[0](iter([batch])))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert got == 1000 and peak < 64 << 20
