"""Toxicity by a factorization machine over hashed terms.

A text's features are its distinct terms, hashed: words and word beginnings. The
machine scores  w0 + sum w_i + sum_{i<j} <v_i, v_j>,  so that a pair of terms (an insult next to a group
mention) can weigh more than both alone. Texts of any length use all their words: each feature counts once
however often it stands, so neither length nor repetition waters a hit down.

Fitting takes a bounded sample of labelled rows (``sample`` rows, the ones with the smallest hash of their
id), never the held-out fold; the fitted arrays have a fixed size and go to the tasks as a broadcast.
Scoring is one pass over the texts without a shuffle.

Odd input: null and empty texts have no features and get the bias alone; ids without a label are only
scored; a label row with a null label, or an id with both labels, is not fitted on; rows sharing a doc_id
are scored each, and the text that sorts first is fitted on; a null doc_id is never held out; with no usable labels the score is 0 everywhere; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.words import CACHE_WORDS, plain_words, slices, texts

BITS, RANK = 20, 4
#: Features whose first factors are drawn at a time.
DRAWN = 1 << 16
#: Bound on labelled rows that are fitted on.
SAMPLE = 12_000
#: Lengths in characters of the word beginnings that are features.
PREFIXES = (4, 5, 6, 7)


class Terms(dict):
    """Distinct hashed features of a text; a word's own features are remembered."""

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        terms = [b"w" + word, *(b"p" + text[:n].encode() for n in PREFIXES if len(text) >= n)]
        value = self[word] = np.array([xxhash.xxh3_64_intdigest(t) >> (64 - BITS) for t in terms], np.int32).tobytes()
        return value

    def of(self, text: bytes) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, set(plain_words(text)))), np.int32))


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, features: np.ndarray) -> float:
        if self.bias == -np.inf:  # fitted on nothing
            return 0.0
        if not len(features):
            z = self.bias
        else:
            v = self.factors[features]
            total = v.sum(axis=0)
            z = self.bias + self.weights[features].sum() + 0.5 * (total @ total - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 6, rate: float = 1.0, sparse: float = 6.0, seed: int = 9) -> Machine:
    """Single rows in a fixed random order: follow-the-regularised-leader for the linear weights, whose
    absolute penalty keeps terms at zero unless rows agree on them, and Adagrad for the factors of terms
    whose weight is not zero."""
    rng = np.random.default_rng(seed)
    # Features that no row has are not fitted: those of the rows, in order, are numbered from 0.
    here = np.zeros(1 << BITS, bool)
    for x in rows:
        here[x] = True
    known = np.flatnonzero(here)
    place = np.cumsum(here, dtype=np.int32) - 1
    n = len(known)
    share = min(max(float(labels.mean()), 1e-3), 1 - 1e-3)
    z, sq, gv = np.zeros(n), np.zeros(n), np.full((n, RANK), 1.0)
    v = np.concatenate([rng.normal(0, 0.05, (DRAWN, RANK))[here[i : i + DRAWN]] for i in range(0, 1 << BITS, DRAWN)])
    gb, b = 1.0, float(np.log(share / (1 - share)))

    def weights(x: np.ndarray) -> np.ndarray:
        zx = z[x]
        return np.where(np.abs(zx) > sparse, -(zx - np.sign(zx) * sparse) / ((1 + np.sqrt(sq[x])) / rate + 1e-2), 0.0)

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = place[rows[i]]
            w = weights(x)
            on = x[w != 0]
            vx = v[on]
            total = vx.sum(axis=0)
            g = 1 / (1 + np.exp(-np.clip(b + w.sum() + 0.5 * (total @ total - (vx * vx).sum()), -30, 30))) - labels[i]
            gb += g * g
            b -= rate * g / gb**0.5
            step = (np.sqrt(sq[x] + g * g) - np.sqrt(sq[x])) / rate
            z[x] += g - step * w
            sq[x] += g * g
            if len(on) > 1:
                dv = g * (total - vx) + 1e-3 * vx
                gv[on] += dv * dv
                v[on] -= 0.1 * rate * dv / np.sqrt(gv[on])
    del gv
    w = weights(np.arange(n))
    v[w == 0] = 0.0
    every, factors = np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, RANK), np.float32)
    every[known], factors[known] = w, v
    return Machine(b, every, factors)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _packed(x: np.ndarray) -> bytes:
    """Ascending numbers as compressed steps, of which the driver collects many."""
    return zlib.compress(np.diff(x, prepend=np.int32(0)).tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(x), np.int32), dtype=np.int32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array([_packed(terms.of(t)) for t in texts(batch.column(0))], pa.binary()), batch.column(1)], ["x", "y"])


def _ordered(rows: list[np.ndarray], y: np.ndarray) -> list[int]:
    """Rows by the bytes of their terms, then their label; only rows that begin alike are copied as a whole to compare them."""
    begin = lambda i: rows[i][:8].tobytes()
    return [i for _, alike in groupby(sorted(range(len(rows)), key=begin), begin) for i in sorted(alike, key=lambda i: (rows[i].tobytes(), y[i]))]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from a bounded sample of labelled rows outside the held-out fold."""
    y = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("y")).where("lo = y")
    y = y.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.col("y").cast("double").alias("y"))
    found = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(y), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = found.select("text", "y").mapInArrow(_features, "x binary, y double").toArrow()
    rows = [_unpacked(x.as_py()) for x in got["x"]]
    y = got["y"].to_numpy()
    del got
    order = _ordered(rows, y)  # tasks end in any order
    return fit([rows[i] for i in order], y[order]) if rows else Machine(-np.inf, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, RANK), np.float32))


def score_toxicity(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., score: one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, m = Terms(), shared.value
        for batch in slices(batches):
            score = pa.array([m.score(terms.of(t)) for t in texts(batch.column(0))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], score], [*keep, "score"])

    rows = docs.select(F.col("text").cast("string").alias("__text"), *keep)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[1:])
    return rows.mapInArrow(run, f"{schema}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    out = score_toxicity(docs, train(docs, labels, sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, machine: Machine, cut: float = 0.5) -> DataFrame:
    """``docs``, all its columns, without the rows whose text scores ``cut`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, m = Terms(), shared.value
        for batch in slices(batches):
            yield batch.filter(pa.array([m.score(terms.of(t)) < cut for t in texts(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
