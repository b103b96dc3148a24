"""Each operator on a small fixture against brute force, with nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import blocks, bm25, decontaminate, eliasfano, langid, lm, neardup, pieces, sketch, substring, suffixes, text, toxicity, warc
from quern.llm.checkpoints import folder, fresh

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, text2 string, key long, own string"


def words(t, lower=False):
    raw = (t or "").encode()
    return WORD.findall(raw.translate(LOWER) if lower else raw)


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, hot passages, nulls, blanks, a long text, odd characters."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, hot = sentence(60), sentence(40)
    out = [None, "", "  \t\n ", "one", "two words", "É x ÀB🙂", "a " * 500, "a" * 700, "Straße 日本語 text", passage, sentence(5), sentence(4)]
    base = sentence(120)
    out += [base, base, base.upper(), base + " end"]
    for _ in range(40):
        w = base.split()
        for _ in range(rng.choice([1, 2, 3, 8, 20])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    out += [sentence(rng.randint(1, 80)) + " " + passage + "\n" + sentence(rng.randint(1, 50)) for _ in range(6)]
    out += [sentence(rng.randint(0, 30)) + "  " + hot + " " + sentence(rng.randint(0, 30)) for _ in range(60)]
    out += [sentence(rng.randint(1, 200)) for _ in range(60)] + [sentence(6000)] + [sentence(20)] * 3
    rng.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


def frame(spark, corpus, partitions=5):
    rows = [(i, t, ["en", "de", None][(i or 0) % 3], "s", 0, 0.5, "clash", 7, "x") for i, t in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return frame(spark, corpus).cache()


@pytest.fixture(scope="module")
def odd(spark, docs, corpus):
    """The same with repeated rows and a null id."""
    more = [corpus[20], corpus[20], (None, corpus[20][1]), (None, None)]
    return docs.union(frame(spark, more, 1)).cache()


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(text, "SLICE_BYTES", 3000)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- shared pieces


def test_words_and_hashes():
    part = pa.RecordBatch.from_arrays([pa.array([None, " a  bc\t", "", "bc", " é\x0b"])], ["text"])
    data, borders = text.utf8(part.column("text"))
    w = text.Words(data, borders)
    got = [data[a:b].tobytes() for a, b in zip(w.start, w.end)]
    assert got == [b"a", b"bc", b"bc", " é".encode()] and w.first.tolist() == [0, 0, 2, 2, 3, 4]
    h = w.hashes()
    assert h[1] == h[2] and len(set(h.tolist())) == 3
    assert [b.num_rows for b in text.slices(iter([part]), limit=1)] == [2, 2, 1] or sum(b.num_rows for b in text.slices(iter([part]), limit=1)) == 5


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, u in [(0, 10), (1, 1), (5, 9), (1000, 1000), (3000, 1 << 40), (70000, 1 << 62), (2000, 1 << 63)]:
        v = np.sort(rng.choice(u, n, replace=False).astype(np.uint64)) if u < 1 << 30 else np.unique(rng.integers(0, u, n, dtype=np.uint64))
        s = eliasfano.Sequence(b"head1234" + eliasfano.encode(v, u) + b"tail", 8)
        if len(v):
            assert (s.get(np.arange(len(v))) == v).all() and (s.find(v) == np.arange(len(v))).all()
        q = rng.integers(0, u, 1000, dtype=np.uint64)
        assert (s.successor(q) == np.searchsorted(v, q)).all() and ((s.find(q) >= 0) == np.isin(q, v)).all()


def test_sketch_never_underestimates(spark, monkeypatch):
    monkeypatch.setattr(sketch, "PART_BITS", 12)
    rng = np.random.default_rng(2)
    for at, n in (([0, 0, 254, 255, 256, 4000], [1] * 6), ([7, 4095], [3, 70000]), ([5], [300])):
        got, counts = sketch.unpack(sketch.pack(np.array(at), np.array(n)))
        assert got.tolist() == at and (counts == np.minimum(n, 65535)).all()
    keys = text.mix(rng.integers(0, 3000, 6000).astype(np.uint64))
    own = np.array_split(keys, 7)
    bits = 15
    parts = pa.Table.from_batches([sketch.partition_sketch(i, k, bits) for i, k in enumerate(own)]).sort_by("part")
    back = pa.Table.from_batches(list(sketch._answers(3)(iter(parts.to_batches())))).sort_by([("block", "ascending"), ("part", "ascending")])
    count = collections.Counter(keys.tolist())
    for i, k in enumerate(own):
        rows = [(p, y, h) for b, p, y, h in zip(back["block"].to_pylist(), back["part"].to_pylist(), back["yes"], back["hot"]) if b == i]
        yes, hot = sketch.look(k, bits, rows)
        true = np.array([count[x] for x in k.tolist()])
        assert yes[true >= 2].all() and hot[true >= 3].all() and yes[true < 2].mean() < 0.1
    assert sketch.width_bits(1 << 45) == 48 and sketch.width_bits(10) == 12


# --- 1


def test_langid(spark, odd):
    langs = {"aa": "bababa tatata", "bb": "xyxyxy zozozo", "cc": "ñandú café"}
    rows = [(i, f"{t} {i}" if i % 7 else t.upper(), lang) for lang, t in langs.items() for i in range(20)] + [(None, None, None), (90, "none", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.learn(df)
    assert profiles.langs == ["aa", "bb", "cc"]
    lang, score, margin = profiles.predict([None, "", "123 !?", "TATA baba", "zozo", "ñ ñandú", "🙂", "日本"])
    assert lang[:6] == ["und", "und", "und", "aa", "bb", "cc"] and lang[6] == "und" and lang[7] != "und"
    assert score[0] == 0 and ((score >= 0) & (score <= 1)).all() and (margin >= 0).all()
    out = langid.predict(odd, profiles, ["doc_id", "lang", "key"]).collect()
    assert len(out) == odd.count() and out[0].asDict().keys() == {"doc_id", "lang", "key", "lang_pred", "score", "margin"}
    assert langid.learn(empty(spark)).predict(["abc"])[0] == ["und"] and langid.predict(empty(spark), profiles, ["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        langid.learn(df, max_languages=2)


def test_langid_distance(corpus):
    """Against plain dictionaries."""
    def top(t, k=langid.K):
        low = "".join(c.lower() if c.isalpha() else " " for c in (t or ""))
        count = collections.Counter()
        for w in low.split():
            padded = f" {w} "
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    g = padded[i : i + n]
                    if g.strip() and not (n == 1 and g == " "):
                        count[g] += 1
        code = lambda g: sum(ord(c if c != " " else "\0") << 16 * (len(g) - 1 - i) for i, c in enumerate(g)) + (len(g) << 16 * len(g))
        return [code(g) for g in sorted(count, key=lambda g: (-count[g], code(g)))[:k]]

    texts = [t for _, t in corpus if t and all(ord(c) < 0x10000 and len(c.lower()) == 1 for c in t)][:60] + [None, ""]
    row, rank, code = langid.top_grams(texts, langid.K)
    for r, t in enumerate(texts):
        assert code[row == r].tolist() == top(t), t


def test_langid_prediction(spark, corpus):
    """Profiles, distances and predictions against plain dictionaries."""
    def grams(t):
        count = collections.Counter()
        for w in "".join(c.lower() if c.isalpha() else " " for c in (t or "")).split():
            padded = f" {w} "
            count.update(g for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != " ")
        return count

    code = lambda g: sum(ord(c if c != " " else "\0") << 16 * (len(g) - 1 - i) for i, c in enumerate(g)) + (len(g) << 16 * len(g))
    ranked = lambda count: {g: r for r, g in enumerate(sorted(count, key=lambda g: (-count[g], code(g)))[: langid.K])}
    texts = [(i, t) for i, t in corpus if t is None or all(ord(c) < 0x10000 and len(c.lower()) == 1 for c in t)]
    lang = lambda i, t: ["aa", "bb", "cc", None][(len(t or "") + i) % 4]
    rows = [(i, t, lang(i, t)) for i, t in texts]
    profiles, total = {}, collections.defaultdict(collections.Counter)
    for i, t, x in rows:
        if x is not None:
            total[x] += grams(t)
    profiles = {x: ranked(c) for x, c in total.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.learn(df)
    assert model.langs == sorted(profiles)
    for r in langid.predict(df, model, ["doc_id", "text"]).collect():
        own = ranked(grams(r.text))
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        far = {x: sum(abs(rank - p[g]) if g in p else langid.K for g, rank in own.items()) for x, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 - far[best] / (len(own) * langid.K))
    with pytest.raises(ValueError):
        langid.predict(df.withColumn("score", F.lit(1)), model, ["doc_id", "score"])


# --- 2


def best_split(m, s):
    """The best segmentation by trying all."""
    best = {0: (0.0, [])}
    for end in range(1, len(s) + 1):
        options = [(best[a][0] + m.pieces[m.ids[s[a:end]]][1], best[a][1] + [m.ids[s[a:end]]]) for a in range(end) if s[a:end] in m.ids]
        if not any(len(s[a:end]) == 1 for a in range(end) if s[a:end] in m.ids):
            options.append((best[end - 1][0] + m.low, best[end - 1][1] + [m.bytes[b] for b in s[end - 1].encode()]))
        best[end] = max(options, key=lambda o: o[0])
    return best[len(s)][0]


def test_unigram_is_the_best_segmentation():
    rng = random.Random(3)
    own = [("<unk>", 0.0, 2), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    own += [(p, -rng.uniform(1, 9), 1) for p in sorted({"▁", "a", "b", "c", *("".join(rng.choice("▁abc" if i == 0 else "abc") for i in range(rng.randint(2, 5))) for _ in range(40))})]
    m = pieces.Model(own)
    for _ in range(300):
        t = "".join(rng.choice("abcd é") for _ in range(rng.randint(0, 15)))
        ids = m.encode(t).tolist()
        assert m.decode(ids) == t
        marked = (" " + t).replace(" ", "▁") if t else ""
        score, byte_run = 0.0, b""
        for i in ids:
            byte_run += bytes([m.byte_of[i]]) if i in m.byte_of else b""
            score += 0.0 if i in m.byte_of else m.pieces[i][1]
        score += m.low * len(byte_run.decode())
        assert score == pytest.approx(best_split(m, marked)) if t else ids == []


def test_bpe_equals_the_library(corpus):
    import sentencepiece

    m, library = pieces.Model.load(pieces.MODEL), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(4)
    texts = [t for _, t in corpus if t] + ["".join(rng.choice("abcdeinorst  AEé▁日本🙂\t\n1234,.!") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for t in texts:
        assert m.encode(t).tolist() == library.encode(t), t
        assert m.decode(m.encode(t)) == t.replace("▁", " ")


def test_pieces_cache(monkeypatch):
    m, plain = pieces.Model.load(pieces.MODEL), pieces.Model.load(pieces.MODEL)
    monkeypatch.setattr(pieces, "CACHE", 7)
    rng = random.Random(15)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 40))) for _ in range(40)]
    for _ in range(50):
        t = " ".join(rng.choice(vocabulary) for _ in range(30))
        assert m.encode(t).tolist() == plain.encode(t).tolist() and m.decode(m.encode(t)) == t
        plain.cache.clear()
        assert len(m.cache) <= 7 and len(m.older) <= 7


def test_pieces_frames(spark, odd):
    out = pieces.encode(odd, columns=("doc_id", "key"))
    rows = out.collect()
    assert len(rows) == odd.count() and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows)
    back = {r.doc_id: r.text for r in pieces.decode(out).where("doc_id is not null").collect()}
    assert back == {r.doc_id: r.text or "" for r in odd.where("doc_id is not null").collect()}
    assert pieces.encode(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        pieces.Model([("a▁b", 0.0, 1)])


# --- 3


def brute_bytes(rows, length=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[s : s + length] for _, b in raw for s in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [2, 8, 1 << 15])
def test_suffixes(spark, odd, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", (hot, hot))
    monkeypatch.setattr(suffixes, "_CHUNK", 9000)
    monkeypatch.setattr(suffixes, "_ROWS", 50)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = suffixes.deduplicated(odd).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes(rows)
    assert suffixes.deduplicated(empty(spark)).collect() == []


def test_radix_passes():
    rng = random.Random(6)
    raw = bytes(rng.choice(b"ab") for _ in range(400))
    buffer = np.r_[np.frombuffer(raw, np.uint8), np.zeros(8, np.uint8)]
    for depth in (3, 8, 13):
        at = np.arange(400 - depth)
        group = at % 3
        count = collections.Counter((int(g), raw[a : a + depth]) for a, g in zip(at.tolist(), group.tolist()))
        expected = [a for a, g in zip(at.tolist(), group.tolist()) if count[g, raw[a : a + depth]] > 1]
        assert sorted(suffixes.equal_windows(buffer, at, group, depth).tolist()) == expected


# --- 4


def brute_segments(s):
    """All maximal segments by their definition: best of a range, then left and right of it."""
    def best(a, b):
        options = [(sum(s[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
        return max(options, default=(0,))

    out, todo = [], [(0, len(s))]
    while todo:
        a, b = todo.pop()
        x = best(a, b)
        if x[0] > 0:
            out.append((x[3], x[4], x[0]))
            todo += [(a, x[3]), (x[4], b)]
    return sorted(out)


def test_maximal_segments():
    rng = random.Random(8)
    for _ in range(300):
        s = [rng.choice([-7.5, -3.1, -2.3, 1.7, 2.9, 5.3]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        s = [round(x * 1000) for x in s]
        assert toxicity.maximal_segments(np.array(s, np.int64)) == brute_segments(s)


def test_toxicity(spark, odd):
    rng = random.Random(9)
    calm, bad = [f"w{i}" for i in range(200)], ["scum", "idiot", "vile"]
    rows, labels = [], []
    for i in range(600):
        t = [rng.choice(calm) for _ in range(rng.randint(3, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(bad))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None), (9999, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 0), (100000, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels.where("doc_id is null or doc_id < 400"))
    assert model.informed and model.lam > 0
    out = {r.doc_id: r for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = range(400, 600)
    assert sum(out[i].predicted == (i % 6 == 0) for i in held) >= 196
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values()) and out[9999].predicted == 0
    for i in held:
        if out[i].predicted:
            tokens = toxicity.TOKEN.findall(rows[i][1])
            assert any(set(tokens[p.start : p.end]) & set(bad) for p in out[i].passages)
    assert toxicity.score(odd, model, ["doc_id", "key"]).count() == odd.count() and toxicity.score(empty(spark), model, ["doc_id"]).collect() == []
    for some in (labels.where("toxic = 0"), labels.limit(0)):
        flat = toxicity.learn(docs, some)
        assert len({r.score for r in toxicity.score(docs, flat, ["doc_id"]).collect()}) == 1


def test_toxicity_against_brute_force(spark):
    """Log-odds, lambda, K, evidence and scores by plain Python."""
    rng = random.Random(14)
    calm, bad = [f"calm{i}" for i in range(60)], ["scum", "idiot", "vile", "rotten"]
    rows, labels = [], {}
    for i in range(400):
        t = [rng.choice(calm) for _ in range(rng.randint(0, 40))]
        labels[i] = int(i % 5 == 0)
        for _ in range(4 * labels[i]):
            t.insert(rng.randrange(len(t) + 1), rng.choice(bad))
        rows.append((i, " ".join(t) or None))
    rows += [(i, rows[10][1]) for i in range(400, 440)]  # copies
    labels |= {i: i % 2 for i in range(400, 440)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = toxicity.learn(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    half = {r.doc_id: r.h for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0).alias("h")).collect()}
    tokens = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in rows}
    group = collections.Counter(toxicity.smallest_shingle(t) for i, t in rows if half[i])
    count = {0: collections.Counter(), 1: collections.Counter()}
    for i, t in rows:
        if half[i]:
            own = {f"w{w}" for w in tokens[i]} | {f"p{w[:k]}" for w in tokens[i] for k in (4, 5, 6) if len(w) >= k} | {""}
            for f in own:
                count[labels[i]][f] += round(2**20 / group[toxicity.smallest_shingle(t)]) / 2**20
    n1, n0 = count[1][""], count[0][""]
    weights = {}
    for f in {*count[0], *count[1]} - {""}:
        a, x, y = count[1][f] + count[0][f], count[1][f], count[0][f]
        odds = math.log((x + 0.1 * a) / (n1 + 0.1 * (n1 + n0))) - math.log((y + 0.1 * a) / (n0 + 0.1 * (n1 + n0)))
        if abs(odds) >= max(1.5, 3 * math.sqrt(1 / (x + 0.1 * a) + 1 / (y + 0.1 * a))):
            weights[f] = max(-6000, min(6000, round(odds * 1000))) - 500
    assert weights and weights == model.weights
    word = lambda w: weights.get(f"w{w}", next((weights[f"p{w[:k]}"] for k in (6, 5, 4) if len(w) >= k and f"p{w[:k]}" in weights), -500))
    scores = {i: [word(w) for w in ws] for i, ws in tokens.items()}
    # lambda: the expectation of exp(lambda s) over clean tokens of the other half (in steps of 0.1) is one
    seen = collections.Counter(x // 100 for i in scores if not half[i] and not labels[i] for x in scores[i])
    top = max(weights.values()) / 1000
    total = sum(seen.values()) + 0.5
    assert (sum(n * math.exp(model.lam * v / 10) for v, n in seen.items()) + 0.5 * math.exp(model.lam * top)) / total == pytest.approx(1, abs=1e-6)
    best = lambda x: max((s for *_, s in brute_segments(x)), default=0)
    clean = [i for i in scores if not half[i] and not labels[i]]
    mean = sum(model.lam * (best(scores[i]) // 100) / 10 - math.log(max(1, 0.75 * 2 ** len(scores[i]).bit_length())) for i in clean) / len(clean)
    assert model.k == pytest.approx(math.exp(mean - 0.5772))
    for r in toxicity.score(docs, model, ["doc_id"]).collect():
        own = scores[r.doc_id]
        kn = math.log(model.k * max(1, len(own)))
        es = sorted((model.lam * s / 1000 - kn for *_, s in brute_segments(own)), reverse=True)
        es = [e for e in es if -e <= math.log(0.01)]
        x = model.lam * best(own) / 1000 - kn
        for k in range(1, len(es) + 1):
            x = max(x, sum(es[:k]) + math.lgamma(k + 1))
        assert r.evidence == pytest.approx(x) and len(r.passages) == len(es)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * min(max(x, -40), 60))))) and r.predicted == (r.score >= 0.5)


def test_toxicity_repeated_words():
    model = toxicity.Model(weights={"wvile": 3000, "wscum": 3000}, k=0.01)
    calm = "so it goes on and on " * 5
    scores = model.scorer().of(f"{calm}Vile scum. {calm}vile scum {calm}")
    _, found = model.evidence(scores)
    assert [f[:2] for f in found] == [(30, 32), (62, 64)] and found[0][2] == found[1][2]


# --- 5


def edits_within(pattern, t):
    """Fewest edits that turn pattern into some part of t."""
    d = [0] * (len(t) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(t, 1):
            new.append(min(d[j - 1] + (p != c), d[j] + 1, new[j - 1] + 1))
        d = new
    return min(d)


def test_decontamination(spark, odd):
    rng = random.Random(10)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, sentence(rng.randint(6, 30))) for i in range(12)] + [(20, "tiny"), (21, ""), (22, None), (23, "  "), (24, None)]
    items += [(25, items[3][1]), (26, "fourteen bytes"), (27, "twenty-seven bytes or so, x"), (28, "one or two edits are to be")]
    rows = [(0, None), (1, ""), (2, "a tiny thing"), (3, "of fourteXn bytes"), (4, "of foXrteXn bytes"), (5, "so twenty-sexen byts or so, x it was"), (6, "one ortwo edits are be"), (7, "one or two edits arx tx be")]
    for n in range(60):
        item = list(rng.choice(items[:12])[1])
        for _ in range(rng.choice([0, 0, 1, 3, 6, 12, 30])):
            k = rng.randrange(len(item))
            item[k : k + 1] = rng.choice([[], [rng.choice("abcdefgh")], [item[k], "x"]])
        own = "".join(item)
        own = own.upper() if n % 5 == 0 else own.replace(" ", " \n", 2)
        rows.append((10 + n, f"{sentence(rng.randint(0, 20))} {own} {sentence(rng.randint(0, 20))}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    normal = lambda t: re.sub(rb"[\x20\x09-\x0d]+", b" ", t.encode().translate(LOWER))
    expected = {}
    for i, item in items:
        p = normal(item or "")
        if not p.strip():
            continue
        block = decontaminate.Items([i], [p], decontaminate.Q, decontaminate.RATE)
        for d, t in rows:
            e = edits_within(p, normal(t or ""))
            if e <= block.edits[0]:
                expected[d, i] = e
    for limit in (1 << 20, 300):
        got = decontaminate.matches(docs, benchmark, ["doc_id"], block_bytes=limit).collect()
        assert {(r.doc_id, r.item_id): min(x.edits for x in got if (x.doc_id, x.item_id) == (r.doc_id, r.item_id)) for r in got} == expected
        left = decontaminate.clean(docs, benchmark, block_bytes=limit)
        assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {r.doc_id for r in got} and left.columns == docs.columns
    assert {(3, 26), (5, 27), (7, 28)} <= set(expected) and (4, 26) not in expected
    exact = next(r for r in got if r.edits == 0 and r.item_id < 12)
    assert normal(dict(rows)[exact.doc_id].encode()[exact.start : exact.end].decode()) == normal(dict(items)[exact.item_id])
    assert decontaminate.matches(odd, benchmark.limit(0), ["doc_id"]).collect() == [] and decontaminate.clean(odd, benchmark.limit(0)).count() == odd.count()
    assert decontaminate.matches(empty(spark), benchmark, ["doc_id", "key"]).columns == ["doc_id", "key", "item_id", "start", "end", "edits"]
    assert decontaminate.clean(odd, benchmark).columns == odd.columns


def test_decontamination_hot_gram(monkeypatch):
    """Many items with a common opening, a text that repeats it, and items and texts of one letter, in small chunks."""
    rng = random.Random(13)
    opening = "the following question has one answer: "
    ends = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(300)]
    texts = [(opening + e).encode() for e in ends] + [b"a" * 70]
    long = (" ".join([opening * 20, ends[7], opening + ends[9], "a" * 300, opening + ends[12][:30] + "x" + ends[12][30:]])).replace("  ", " ")
    part = pa.RecordBatch.from_arrays([pa.array([long, "none", opening * 3])], ["text"])
    texts = [decontaminate.normal(np.frombuffer(t, np.uint8))[0].tobytes() for t in texts]
    items = decontaminate.Items(list(range(len(texts))), texts, decontaminate.Q, decontaminate.RATE)
    wanted = {(r, i) for r, t in enumerate(part.column("text").to_pylist()) for i, x in enumerate(texts) if edits_within(x, re.sub(rb"[\x20\x09-\x0d]+", b" ", t.encode())) <= items.edits[i]}
    whole = decontaminate.find(part, items)
    assert {f[:2] for f in whole} == wanted and (0, 300) in wanted and (0, 9) in wanted
    monkeypatch.setattr(decontaminate, "POSTINGS", 500)
    monkeypatch.setattr(decontaminate, "ALIGN_BYTES", 2000)
    assert decontaminate.find(part, items) == whole


def test_clashing_columns(spark, docs):
    one = docs.select("doc_id", "text", F.lit(1).alias("item_id"))
    with pytest.raises(ValueError):
        decontaminate.matches(one, spark.createDataFrame([(1, "x")], "item_id long, text string"), ["doc_id", "item_id"])
    with pytest.raises(TypeError):
        decontaminate.matches(docs, spark.createDataFrame([("a", "x")], "item_id string, text string"), ["doc_id"])


# --- 6


@pytest.mark.parametrize(("block", "shard"), [(2_000_000, 8 << 20), (300, 4000)])
def test_search(spark, odd, monkeypatch, block, shard):
    monkeypatch.setattr(bm25, "SHARD_BYTES", shard)
    rows = [(r.doc_id, words(r.text, True)) for r in odd.collect()]
    n, mean = len(rows), sum(len(w) for _, w in rows) / len(rows)
    df = collections.Counter(t for _, w in rows for t in set(w))
    idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    queries = odd.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "text")
    expected = []
    for q in queries.collect():
        scores = []
        for d, w in rows:
            tf = collections.Counter(w)
            s = sum(m * idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, m in collections.Counter(words(q.text, True)).items() if tf[t])
            if s > 0:
                scores.append((-round(s, 6), math.inf if d is None else d, d))
        expected += [(q.query_id, k, x[2], pytest.approx(-x[0], abs=2e-6)) for k, x in enumerate(sorted(scores)[:10], 1)]
    got = bm25.search(odd, queries, block_terms=block).collect()
    key = lambda r: (r[0], r[1], str(r[2]))
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert bm25.search(empty(spark), queries).collect() == [] and bm25.search(odd, queries.limit(0)).collect() == []


def test_search_many_empty_rows(spark):
    """Shards are bounded by rows too, and documents without words cost next to nothing."""
    docs = spark.range(0, 400_000, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100_000 == 7, F.concat(F.lit("rare words "), "id")).otherwise(F.lit("")).alias("text"))
    of = bm25.index(docs)
    assert of.documents == 400_000 and of.files.count() >= 400_000 // bm25.SHARD_ROWS
    queries = spark.createDataFrame([(1, "rare"), (2, "words 200007"), (3, "none")], "query_id long, text string")
    got = bm25.ask(of, queries, k=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.doc_id) for r in got] == [(1, 1, 7), (1, 2, 100_007), (2, 1, 200_007), (2, 2, 7)]


def test_search_touches_few_blocks():
    """A block whose maxima cannot reach the threshold is never scored."""
    n = 6400
    term = np.r_[np.zeros(n, np.int64), np.ones(40, np.int64)]
    doc = np.r_[np.arange(n), np.arange(0, n, 160)]
    impact = np.r_[np.linspace(1, 2, n), np.linspace(3, 4, 40)]
    shard = bm25.Shard(n, doc, term, impact, 2)
    q = bm25.Queries(np.array([5]), np.array([False]), np.array([0]), np.arange(2, dtype=np.uint64), np.array([0, 2]), np.array([0, 1]), np.array([0.1, 10.0]))
    threshold = np.array([0.0])
    ((i, found, scores),) = shard.best(q, 0, 1, 3, threshold)
    exact = np.bincount(doc, impact * np.array([0.1, 10.0])[term])
    best = np.argsort(-exact)[:3]
    assert found[np.argsort(-scores)].tolist() == best.tolist() and np.sort(scores)[::-1] == pytest.approx(exact[best], abs=1e-6)
    assert threshold[0] == pytest.approx(exact[best[2]])


def test_search_scans_some_shards_to_a_task(spark):
    """However many shards an index has, thresholds are carried on: a scan has a few tasks a core."""
    docs = spark.range(0, 300, 1, 60).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id") % 7).alias("text"))
    of = bm25.index(docs)
    assert of.files.rdd.getNumPartitions() == 60 and of.files.count() == 60
    assert of.dealt().rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism and of.dealt().count() == 60
    got = bm25.ask(of, spark.createDataFrame([(1, "a 3")], "query_id long, text string"), k=5).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [3, 10, 17, 24, 31]


def test_search_long_queries():
    """Long queries over frequent and rare lists: exact at near ties, and little beside the shard in memory."""
    rng = np.random.default_rng(6)
    n, terms, many, k = 6400, 5000, 64, 10
    doc = np.repeat(np.arange(n), 220)
    term = np.where(rng.random(len(doc)) < 0.3, rng.integers(0, 40, len(doc)), rng.integers(40, terms, len(doc)))
    doc, term = np.unique(np.c_[doc, term], axis=0).T
    impact = 1 + rng.random(len(doc)) * 1e-4  # scores differ by less than single precision shows
    shard = bm25.Shard(n, doc, term, impact, terms)
    assert 0 < len(shard.dense) < terms
    each = [np.sort(rng.choice(terms, 1000, replace=False)) for _ in range(many)]
    first = np.r_[0, np.cumsum([len(x) for x in each])]
    q = bm25.Queries(np.arange(many), np.zeros(many, bool), np.arange(many), np.arange(terms, dtype=np.uint64), first, np.concatenate(each), 1 + rng.random(first[-1]))
    threshold = np.zeros(many)
    tracemalloc.start()
    got = {i: (found, scores) for i, found, scores in shard.best(q, 0, many, k, threshold)}
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sorted(got) == list(range(many)) and peak < 40 << 20
    for i, (found, scores) in got.items():
        w = np.zeros(terms)
        w[each[i]] = q.weight[first[i] : first[i + 1]]
        exact = np.bincount(doc, impact * w[term], n)
        best = np.argsort(-exact)[:k]
        assert set(best) <= set(found.tolist()) and scores == pytest.approx(exact[found], abs=1e-6) and threshold[i] == pytest.approx(exact[best[-1]], abs=1e-9)


# --- 7


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", None, "", "<p>a</p>", "ü" * 3000, "x", "<p>a</p>", "\r\n\r\nWARC/1.1"]
    rows = [(i, f"http://x/{i}\r\nA: b" if i else None, h, "clash") for i, h in enumerate(html)] + [(None, "u", "x", ""), (3, "http://x/3\r\nA: b", "<p>a</p>", ""), (100, "u", "only", ""), (100, "u", "other", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)

    def first(h):
        return min((i for i, _, x, _ in rows if (x or "") == (h or "") and i is not None), default=None)

    for least in (0, 5):
        uris = []
        for name, parts in (("one", 1), ("two", 4)):
            uri = f"file://{tmp_path}/{name}{least}"
            manifest = warc.write(pages.repartition(parts), uri, min_bytes=least, shard_bytes=3000, roll_bytes=500)
            assert manifest.agg(F.sum("records")).head()[0] == len(rows) and manifest.count() > 2
            uris.append(sorted(map(tuple, manifest.collect())))
        assert uris[0] == uris[1]  # the same bytes from other partitions
        got = warc.read(spark, uri).collect()
        expected = []
        for i, u, h, _ in rows:
            raw = (h or "").encode()
            f = first(h) if len(raw) >= least else i
            again = f is not None and f != i
            url = None if u is None else u.replace("\r", "%0D").replace("\n", "%0A")
            expected.append((i, url, len(raw), warc.base32_sha1(raw), "revisit" if again else "response", f if again else None, None if again else raw))
        key = lambda r: tuple(map(str, r))
        assert sorted(((*r[:6], None if r[6] is None else bytes(r[6])) for r in got), key=key) == sorted(expected, key=key)
    uri = f"file://{tmp_path}/none"
    warc.write(pages.limit(0), uri)
    assert warc.read(spark, uri).collect() == []


def test_warc_many_shards_and_damage(spark, tmp_path):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("p"), F.col("id") % 250).alias("html"))
    uri = f"file://{tmp_path}/many"
    manifest = warc.write(pages, uri, shard_bytes=2000)
    assert manifest.count() > 64
    rows = warc.read(spark, uri, payloads=False).collect()
    assert sorted(r.page_id for r in rows) == list(range(300)) and {r.page_id: r.refers_to for r in rows if r.record_type == "revisit"} == {i: i - 250 for i in range(250, 300)}
    raw = warc.record(1, "u", b"abc", warc.base32_sha1(b"abc"), None, False, 0)
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"abc", b"abd"))


def test_warc_outliers_and_null_ids(spark, tmp_path):
    """Ids far apart, up to both ends of 64 bits, and many rows without an id, give shards of the size asked for."""
    ids = [*range(1000), 10**15, -(2**63), 2**63 - 1, *[None] * 400]
    rows = [(i, "u", f"page {n % 900}") for n, i in enumerate(ids)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = []
    for parts in (2, 5):
        uri = f"file://{tmp_path}/out{parts}"
        manifest = warc.write(pages.repartition(parts), uri, shard_bytes=20 * 610)
        assert manifest.agg(F.max("records")).head()[0] < 60 and 60 < manifest.count() < 110
        files.append(sorted(map(tuple, manifest.collect())))
    assert files[0] == files[1]
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h] = min(least.get(h, i), i)
    got = [(r.page_id, r.payload_digest, r.refers_to) for r in warc.read(spark, uri, payloads=False).collect()]
    expected = [(i, warc.base32_sha1(h.encode()), least[h] if h in least and least[h] != i else None) for i, _, h in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    with pytest.raises(TypeError):
        warc.write(pages.withColumn("page_id", F.col("url")), uri)


# --- 8


@pytest.mark.parametrize("hot", [50, 100_000])
def test_language_model(spark, odd, monkeypatch, tmp_path, hot):
    monkeypatch.setattr(lm, "HOT_CONTEXT", hot)
    monkeypatch.setattr(lm, "GRAM_SHARD", 500)
    monkeypatch.setattr(lm, "VOCABULARY_SHARD", 1000)
    monkeypatch.setattr(lm, "SLICE", 3000)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = lambda t: [*words(t, True), None]
    one, two, three, follows = (collections.Counter() for _ in range(4))
    for t in train:
        own = tokens(t)
        one.update(own)
        two.update(zip([None, *own[:-1]], own))
        three.update(zip([None, *own[:-2]], own[:-1], own[1:]))
        follows.update(zip([None, *own[:-2]], own[:-1]))
    n, v = sum(one.values()), len(one)
    trie = lm.learn(odd.where(F.col("doc_id").isNotNull() & ~text.crc_is("doc_id", 7, 2)), f"file://{tmp_path}/lm")
    assert (trie.n, trie.v) == (n, v) and trie.shards > 1 and trie.bits > 0 and (len(trie.hot) > 0) == (hot == 50)
    m2, m3 = lm.MU
    got = lm.score(odd.select("doc_id", "text", "key"), trie, ["doc_id", "text"]).collect()
    assert sorted(map(str, got)) != [] and collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(rows)
    for r in got:
        own = tokens(r.text)
        p1 = [(one[w] + 1) / (n + v + 1) for w in own]
        context = [None, *own[:-1]]
        p = [(two[u, w] + m2 * x) / (one[u] + m2) for u, w, x in zip(context, own, p1)]
        p[1:] = [(three[u, x, w] + m3 * q) / (follows[u, x] + m3) for u, x, w, q in zip(context, own, own[1:], p[1:])]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(one[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(map(math.log10, p1))) and r.score == pytest.approx(sum(map(math.log10, p)), abs=1e-5 * len(own))
    # the probabilities of what may follow a pair sum to one
    u, x = max((k for k in follows if k[0] is not None), key=follows.get)
    total = sum((three[u, x, w] + m3 * (two[x, w] + m2 * (one[w] + 1) / (n + v + 1)) / (one[x] + m2)) / (follows[u, x] + m3) for w in one)
    assert total + m3 / (follows[u, x] + m3) * m2 / (one[x] + m2) / (n + v + 1) == pytest.approx(1)
    assert lm.score(odd, trie, ["doc_id", "key"]).count() == len(rows)
    with pytest.raises(ValueError):
        lm.score(odd, trie, ["doc_id", "score"])
    none = lm.learn(empty(spark), f"file://{tmp_path}/none")
    (r,) = {tuple(r)[1:] for r in lm.score(odd.where("text = 'one'"), none, ["doc_id"]).collect()}
    assert r == (2, 0, 0, 0.0, 0.0)


def test_language_model_blocks():
    rng = np.random.default_rng(3)
    for top, wide in ((1 << 20, 1 << 22), (1 << 62, 1 << 40), (5, 3)):
        a, w = rng.integers(0, top, 500).astype(np.uint64), rng.integers(0, wide, 500).astype(np.uint64)
        a[:200], w[:200] = a[200:400], w[200:400]
        count = collections.Counter(zip(a.tolist(), w.tolist()))
        one = lm.pack(*lm.counted(a, w))
        assert [*zip(*map(np.ndarray.tolist, lm.unpack(one)))] == sorted((x, y, n) for (x, y), n in count.items())
        assert lm.merge([one, one])[2].tolist() == [2 * n for _, n in sorted(count.items())]
    x = rng.normal(size=5000)
    code, book = lm.code_book(x)
    assert np.abs(book[code] - x).mean() < 0.02 and (np.diff(book[:256]) > 0).all()
    few = lm.code_book(np.array([1.5, -2.0, 1.5]))
    assert few[1][few[0]].tolist() == [1.5, -2.0, 1.5]


# --- 9


def brute_components(rows, percent):
    """doc_id, set size and component of each row; rows are vertices of their own, those with a null id or no words alone."""
    sets = []
    for _, t in rows:
        w = words(t, True)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    some = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    for i, j in itertools.combinations(some, 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            parent[root(i)] = root(j)
    least = {}
    for k in some:
        least[root(k)] = min(least.get(root(k), math.inf), rows[k][0])
    return sorted(((i, len(sets[k]), least.get(root(k), i)) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("percent", "dense", "block"), [(85, 2048, 1024), (80, 2048, 1024), (85, 10, 4), (80, 3, 7)])
def test_near_duplicates(spark, docs, corpus, monkeypatch, percent, dense, block):
    monkeypatch.setattr(neardup, "DENSE", dense)
    monkeypatch.setattr(neardup, "PAIR_BLOCK", block)
    got = neardup.classes(docs, percent=percent).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == brute_components(corpus, percent)


def test_near_duplicates_odd_rows(spark, odd, corpus):
    """Repeated rows, null ids, and an id on two texts that both have copies."""
    base = next(t for _, t in corpus if t and len(t.split()) == 120)
    other = " ".join(reversed(base.split()))
    extra = [(-3, base + " x"), (-3, other), (700, other + " y"), (701, other), (-2, base)]
    rows = [(r.doc_id, r.text) for r in odd.collect()] + extra
    every = odd.union(frame(spark, extra, 1)).withColumn("first", F.lit("own")).withColumn("a b", F.lit(2))
    got = neardup.classes(every).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 85)
    stay = collections.Counter(r.component_id for r in got if r.first and r.component_id is not None and r.n_shingles)
    linked = [r for r in got if r.doc_id is not None and r.n_shingles]
    assert all(r.component_id in stay for r in linked) and stay[-3] == 2 and all(r.first for r in got if r.doc_id is None or not r.n_shingles)
    left = neardup.deduplicated(every)
    assert left.dtypes == every.dtypes
    texts = collections.defaultdict(set)
    for i, t in rows:
        texts[i].add(t)
    kept = [tuple(r) for r in left.collect()]
    assert collections.Counter(r[0] for r in kept) == collections.Counter(r.doc_id for r in got if r.first) and all(r[1] in texts[r[0]] and r[-2:] == ("own", 2) for r in kept)
    assert neardup.classes(empty(spark)).collect() == [] and neardup.deduplicated(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        neardup.classes(odd, percent=50)
    with pytest.raises(TypeError):
        neardup.classes(odd.withColumn("doc_id", F.col("text")))


def edited(rng, base, changes):
    w = list(base)
    for k in rng.choice(len(w), changes, replace=False):
        w[k] = f"new{rng.integers(1 << 40)}"
    return w


def test_near_duplicates_of_a_dense_group(spark, monkeypatch):
    """Copies that differ by about as much as a link allows, and most by more: few of their pairs are verified, no link is lost."""
    rng = np.random.default_rng(5)
    base = [f"word{k}" for k in range(150)]
    rows = [(k, edited(rng, base, 3)) for k in range(240)]
    rows += [(1000 + k, edited(rng, w, 1 + k % 4)) for k, w in rows[::4]]
    rows = [(k, " ".join(w)) for k, w in rows]
    counts, verified = [], neardup.verified

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(neardup, "verified", counted)
    got = neardup.classes(frame(spark, rows, 3), percent=80).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == brute_components(rows, 80)
    assert max(counts) <= 2 * len(rows)  # of 44,850 pairs


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_parities(percent):
    """Sets of one shingle to some thousands, with three numbers of buckets: the bound holds, and round three keeps every link."""
    rng = np.random.default_rng(percent)
    docs = [["a"], ["b"], ["a", "b", "c", "d", "e"]]
    for n in (6, 40, 134, 1028, 2052, 2056):
        base = [f"w{n}x{k}" for k in range(n)]
        docs += [edited(rng, base[rng.integers(3) :], min(n - 2, c * (1 + n // 200))) for c in (0, 1, 2, 3, 4, 6) for _ in range(3)]
    h, first = neardup.sets(pa.RecordBatch.from_arrays([pa.array([" ".join(w) for w in docs])], ["text"]))
    own = [h[a:b] for a, b in itertools.pairwise(first)]
    own = list({s.tobytes(): s for s in own}.values())
    odd = [neardup._odd(s) for s in own]
    assert len({len(x) for x in odd}) == 3
    links = set()
    for i, j in itertools.combinations(range(len(own)), 2):
        apart = len(np.setxor1d(own[i], own[j]))
        least = min(len(odd[i]), len(odd[j]))
        assert np.bitwise_count(neardup._folded(odd[i][None], least) ^ neardup._folded(odd[j][None], least)).sum() <= apart
        if (100 + percent) * apart <= (100 - percent) * (len(own[i]) + len(own[j])):
            links.add((i, j))
    sig = neardup.signatures(np.concatenate(own), np.cumsum([0, *map(len, own)]))
    same, rep, n = np.zeros(len(own), np.int64), np.arange(len(own)), np.array([*map(len, own)])
    columns = [same, same, same, same, same, rep, rep, n, n, same - 1, same - 1, [x.tobytes() for x in sig], [x.tobytes() for x in odd]]
    rows = pa.RecordBatch.from_arrays([*map(pa.array, columns)], [f"c{k}" for k in range(len(columns))])
    got = {(a, b) for x in neardup._cross(percent)(iter([rows])) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)}
    assert links <= got and len(links) > 50 and len(got) < 2 * len(links)


# --- 10


def brute_windows(rows, size=13):
    own = [(i, words(t)) for i, t in rows]
    least = {}
    for i, w in own:
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            least[k] = min(least.get(k, math.inf), math.inf if i is None else i)
    out = []
    for i, w in own:
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if least[tuple(w[s : s + size])] < (math.inf if i is None else i):
                gone[s : s + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "share"), [(2, 1 << 16), (8, 100), (1 << 15, 1 << 16)])
def test_substring(spark, odd, monkeypatch, hot, share):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SHARE", share)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, substring.digest(odd).collect()), key=str) == brute_windows(rows)
    assert substring.digest(empty(spark)).collect() == []


def test_substring_within_a_document(spark, monkeypatch):
    """Windows that a document has many times, and null ids that meet only each other."""
    monkeypatch.setattr(substring, "HOT", 3)
    same = "b c d e f g h i j k l m n o p "
    rows = [(4, "x " * 60), (2, "x " * 200 + same * 3), (9, same * 5 + "y " * 30), (None, "y " * 40), (None, "z " * 40), (None, "z " * 50), (9, "z q " * 30)]
    for hot in (3, 1 << 15):
        monkeypatch.setattr(substring, "HOT", hot)
        assert sorted(map(tuple, substring.digest(frame(spark, rows, 3)).collect()), key=str) == brute_windows(rows)
    with pytest.raises(ValueError):
        substring.deduplicated(frame(spark, rows, 1).withColumn("lost", F.lit(1)))


def test_null_and_shared_ids_are_told_apart(spark):
    passage = " ".join(f"passage{i}" for i in range(30))
    mark = F.xxhash64("t").bitwiseAND((1 << 24) - 1).alias("mark")
    long = spark.range(20000).select(F.concat("id", F.lit(" " + passage)).alias("t")).select(F.col("t").alias("long"), mark)
    short = spark.range(20000).select(F.concat(F.lit("short "), "id").alias("t")).select(F.col("t").alias("short"), mark)
    pairs = long.join(short, "mark").orderBy("long").limit(2).collect()  # their fingerprints agree in 24 bits
    rows = [(1, passage), *((i, t) for i, p in zip([None, 7], pairs, strict=True) for t in (p.long, p.short))]
    docs = frame(spark, rows, 1)
    assert sorted(map(tuple, substring.digest(docs).collect()), key=str) == brute_windows(rows)
    got = suffixes.deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes(rows)


def test_deduplicated_texts(spark, docs, corpus):
    folder(spark)
    own = docs.select("doc_id", "text", "key")
    texts = dict(corpus)
    for r in substring.deduplicated(own).collect():
        assert r.lost or r.text == texts[r.doc_id]
        if r.lost:
            assert len(words(r.text)) < len(words(texts[r.doc_id]))


def test_fresh_paths_differ(spark):
    assert fresh(spark, "a") != fresh(spark, "a") and fresh(spark, "a").startswith(folder(spark))


def test_anchors_in_chunks(monkeypatch):
    """A text longer than a chunk gives windows the same anchors."""
    rng = random.Random(12)
    part = pa.RecordBatch.from_arrays([pa.array(["".join(rng.choice("abc ") for _ in range(n)) for n in (50, 3000, 0, 199, 200, 7000, 201)])], ["text"])
    data, borders = text.utf8(part.column("text"))

    def by_window():
        a = suffixes.Anchors(data, borders)
        return {s: (p, k) for p, k, x, y in zip(a.place.tolist(), a.key.tolist(), a.first.tolist(), a.last.tolist()) for s in range(x, y + 1)}

    whole = by_window()
    assert sorted(whole) == [s for a, b in itertools.pairwise(borders.tolist()) for s in range(a, b - 199)]
    monkeypatch.setattr(suffixes, "_CHUNK", 1500)
    assert by_window() == whole
