"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads each stretch of text once and follows output links, so that it reports
every piece that ends at each position; a Viterbi table relaxes the best score of each position with them. White space
starts a piece and never stands within one (checked when a model is loaded), so a text splits exactly into stretches that
are encoded alone, and a worker keeps the ids of the stretches it has met (a bounded cache).

Unigram models: the best segmentation is that with the largest sum of scores. BPE models: the scores are merge ranks, and
plain sums of ranks would choose other pieces than merging does. There a step from one piece to the next scores minus
infinity unless merging the two pieces' joined text gives just the two, and all other steps the piece's own score; the same
relaxation of best scores then gives the one segmentation all of whose neighbours agree, which is that of the merges, so ids
equal those of the public library.

Characters without a piece become byte pieces, or the unknown piece where the model has none.

Defined cases: null and empty texts have no ids. Decoding gives the text back, except that U+2581 comes back as a
blank, and characters that became the unknown piece as U+2047 with blanks around it. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .text import KEPT, by_slice, no_clash, spread, table, with_fields

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
STRETCH = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Cached stretches of a worker's generation, and the longest that is cached.
CACHE, CACHED_CHARS = 150_000, 32


def _fields(data: bytes):
    """(number, value) of a serialised message; value is an int or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """pieces: (text, score, kind) by id; kind: 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool = False, dummy_prefix: bool = True, trim: bool = False) -> None:
        self.pieces, self.bpe, self.dummy_prefix, self.trim = pieces, bpe, dummy_prefix, trim
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (1, 4)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has white space within")
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == 2), -1)
        self.low = min((p[1] for p in pieces if p[2] == 1), default=0.0) - 10.0
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p), pieces[i][1]))
        if self.ids:
            self.automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        surface = {2: " ⁇ ", 3: ""}
        self.raw = [bytes((self.byte_of[i],)) if kind == 6 else surface.get(kind, p.replace(MARK, " ")).encode() for i, (p, _, kind) in enumerate(pieces)]
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def load(path: str) -> Model:
        pieces, bpe, prefix, trim = [], False, True, True
        for number, value in _fields(Path(path).read_bytes()):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]), f.get(3, 1)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
                if kind not in (1, 2):
                    raise ValueError("neither a unigram nor a BPE model")
                bpe = kind == 2
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2):
                    raise ValueError("the model maps characters; only identity normalisation is supported")
                prefix, trim = bool(f.get(3, 1)), bool(f.get(4, 1))
        return Model(pieces, bpe, prefix, trim)

    # BPE: what merging gives, for two pieces' text; only short strings come here
    def merged(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            best, at = -float("inf"), -1
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and self.pieces[j][1] > best:
                    best, at = self.pieces[j][1], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether right may follow left (-1: nothing or a character without a piece); kept by their joint number."""
        if len(self._fits) > 2_000_000:
            self._fits.clear()
        parts = [self.pieces[i][0] for i in (left, right) if i >= 0]
        got = self._fits[left * len(self.pieces) + right] = self.merged("".join(parts)) == parts
        return got

    def _stretch(self, s: str) -> list[int]:
        n = len(s)
        best: list[float | None] = [None] * (n + 1)
        last, size = [-1] * (n + 1), [1] * (n + 1)
        best[0] = 0.0
        bpe, known, many, done = self.bpe, self._fits.get, len(self.pieces), 0  # positions up to done are final
        for end, (i, length, score) in self.automaton.iter(s) if self.ids else ():
            start = end + 1 - length
            while done < end:
                done += 1
                if best[done] is None:
                    best[done] = best[done - 1] + self.low
            end += 1
            if bpe:  # a step between pieces that do not agree scores minus infinity
                ok = known(last[start] * many + i)
                if not (self.fits(last[start], i) if ok is None else ok):
                    continue
            total, now = best[start] + score, best[end]
            if now is None or total > now:
                best[end], last[end], size[end] = total, i, length
        while done < n:
            done += 1
            if best[done] is None:
                best[done] = best[done - 1] + self.low
        out: list[int] = []
        while n > 0:
            if last[n] >= 0:
                out.append(last[n])
            elif len(self.bytes) == 256:
                out += [self.bytes[b] for b in reversed(s[n - 1].encode())]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            n -= size[n]
        return out[::-1]

    def _known(self, s: str) -> bytes:
        """The ids of a stretch; short ones are kept in two generations, of which the older goes when the younger is full."""
        got = self.older.get(s)
        if got is None:
            got = np.array(self._stretch(s), np.int32).tobytes()
        if len(s) <= CACHED_CHARS:
            if len(self.cache) >= CACHE:
                self.cache, self.older = {}, self.cache
            self.cache[s] = got
        return got

    def encode(self, text: str | None) -> np.ndarray:
        if text and self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return np.zeros(0, np.int32)
        if self.dummy_prefix:
            text = " " + text
        cache, out = self.cache, []
        for s in STRETCH.findall(text.replace(" ", MARK)):
            got = cache.get(s)
            if got is None:
                got = self._known(s)
                cache = self.cache
            out.append(got)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in np.asarray(ids).tolist()]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(2)
def model(path: str) -> Model:
    """One for each path and Python worker, until a task of another operator comes."""
    KEPT["pieces"] = model.cache_clear
    return Model.load(path)


def encode(docs: DataFrame, path: str = MODEL, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns, n_tokens, token_ids, and whether decoding the ids gives the text back."""

    no_clash(columns, ["n_tokens", "token_ids", "round_trip"])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        m = model(path)
        texts = part.column("text").to_pylist()
        ids = [m.encode(t) for t in texts]
        same = [m.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]
        n = np.array([len(x) for x in ids], np.int64)
        flat = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate(ids)))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(n), flat, pa.array(same)], [*columns, "n_tokens", "token_ids", "round_trip"])

    chosen = docs.select(*columns, "text") if "text" not in columns else docs.select(*columns)
    return chosen.mapInArrow(by_slice(run, keeps="pieces"), with_fields(chosen.schema, columns, "n_tokens long, token_ids array<int>, round_trip boolean"))


def decode(ids: DataFrame, path: str = MODEL, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns and the text of token_ids; null ids read as none."""
    no_clash(columns, ["text"])

    def run(batches):
        m = model(path)
        for part in batches:
            texts = [m.decode(x or []) for x in part.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(texts, pa.string())], [*columns, "text"])

    chosen = ids.select(*columns, "token_ids")
    return chosen.mapInArrow(run, with_fields(chosen.schema, columns, "text string"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spread(table(spark, sf_dir, "documents")))


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
SQL: dict[str, str] = {}
