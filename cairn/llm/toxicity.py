"""Toxicity: a factorization machine over hashed terms.

A text is the set of its words and of their first ``PREFIX`` bytes, which
stand for a word's inflected forms, hashed into ``BUCKETS``.  The score is the
logistic function of a bias, a weight for each term and, for each pair of
terms, the product of their factor vectors, so terms that are harmless alone
can count together.  It is trained by AdaGrad on a bounded sample of labelled
rows; every row is scored, on its whole text.

Terms of the model are all that tell the labels apart by more than chance;
their number follows the sample.  Words that have no relation to the labels
there have no weight.

Defined results: null and empty texts have no term and score by the bias;
without labelled rows, with labels of one kind only, or where no term tells
them apart, the score is the share of toxic labels (0 without any); repeated labels of a document count
as the largest; of rows that repeat a labelled doc_id the one with the least
MD5 of its text is learned from; a row without a doc_id is scored and not held
out; an empty table has no row; ``scored`` replaces a column named ``score``.
A text is cut into words as a whole, which one worker holds.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import ALNUM, annotate, fold, table

BUCKETS = 1 << 20
PREFIX = 5
#: Labelled rows that the model is fitted on, about; more are sampled by a hash of doc_id.
SAMPLE = 16_000
FACTORS = 4
THRESHOLD = 0.3


class Terms:
    """The hashed terms of texts; words are hashed once while they are in the table."""

    def __init__(self, limit: int = 400_000):
        self.limit, self.known = limit, {}

    def of(self, text: bytes) -> np.ndarray:
        known, words = self.known, set(text.translate(ALNUM).split())
        if len(known) > self.limit:
            known.clear()
        out = []
        for w in words:
            if (both := known.get(w)) is None:
                both = known[w] = zlib.crc32(w) % BUCKETS << 32 | zlib.crc32(b"^" + w[:PREFIX]) % BUCKETS
            out.append(both)
        found = np.array(out, dtype=np.int64)
        return np.unique(np.concatenate((found >> 32, found & 0xFFFFFFFF)).astype(np.int32))


class Machine:
    """The model: which buckets are terms, the bias, the weights and the factors."""

    def __init__(self, buckets: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.buckets, self.bias, self.weights, self.factors = buckets, bias, weights, factors
        self._place: np.ndarray | None = None

    def features(self, terms: np.ndarray) -> np.ndarray:
        """The numbers of the known terms among hashed ones."""
        if self._place is None:
            self._place = np.full(BUCKETS, -1, dtype=np.int32)
            self._place[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        found = self._place[terms]
        return found[found >= 0]

    def score(self, features: np.ndarray) -> float:
        v = self.factors[features]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[features].sum() + pairs, -30, 30))))


def _informative(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The buckets whose presence tells the labels apart, by the likelihood ratio.

    Of those without any relation to the labels a tenth of one is expected to pass.
    """
    n, share = len(rows), labels.sum() / len(rows)
    held, toxic = (np.bincount(np.concatenate(part), minlength=BUCKETS).astype(float) for part in (rows, [r for r, y in zip(rows, labels, strict=True) if y]))
    with np.errstate(divide="ignore", invalid="ignore"):
        term = lambda seen, expected: np.where(seen > 0, seen * np.log(seen / expected), 0.0)
        inside = term(toxic, held * share) + term(held - toxic, held * (1 - share))
        without, rest = n - held, labels.sum() - toxic
        outside = term(rest, without * share) + term(without - rest, without * (1 - share))
    ratio = np.nan_to_num(2 * (inside + outside), nan=0.0, posinf=0.0)
    return np.flatnonzero(ratio > 2 * np.log(10 * max(1, np.count_nonzero(held))))


def fit(rows: list[np.ndarray], labels: np.ndarray, *, factors: int = FACTORS, rounds: int = 20, rate: float = 0.2, decay: float = 1e-5, toxic_weight: float = 3.0, seed: int = 0) -> Machine:
    """A machine for rows of hashed terms and their labels 0 and 1; a toxic row counts ``toxic_weight`` times."""
    n, toxic = len(labels), int(labels.sum())
    share = min(max(toxic / n if n else 0.0, 1e-6), 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    if not n or toxic in (0, n):
        return Machine(np.zeros(0, dtype=np.int32), bias, np.zeros(0), np.zeros((0, factors)))
    buckets = _informative(rows, labels)
    if not len(buckets):
        return Machine(buckets.astype(np.int32), bias, np.zeros(0), np.zeros((0, factors)))
    rng = np.random.default_rng(seed)
    model = Machine(buckets, bias, np.zeros(len(buckets)), rng.normal(0, 0.01, (len(buckets), factors)))
    known = [model.features(r) for r in rows]
    w, v = model.weights, model.factors
    past_w, past_v, past_b = np.full(w.shape, 1e-8), np.full(v.shape, 1e-8), 1e-8
    for _ in range(rounds):
        order = rng.permutation(n)
        for start in range(0, n, 128):
            picked = order[start : start + 128]
            part = [known[i] for i in picked]
            flat = np.concatenate(part)
            row = np.repeat(np.arange(len(part)), [len(x) for x in part])
            vf = v[flat]
            sums = np.zeros((len(part), factors))
            np.add.at(sums, row, vf)
            squares = np.bincount(row, weights=(vf**2).sum(axis=1), minlength=len(part))
            raw = model.bias + np.bincount(row, weights=w[flat], minlength=len(part)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[picked]) / len(part)
            error *= np.where(labels[picked] > 0, toxic_weight, 1.0)
            gw = np.bincount(flat, weights=error[row], minlength=len(w)) + decay * w
            gv = np.zeros_like(v)
            np.add.at(gv, flat, error[row, None] * (sums[row] - vf))
            gv += decay * v
            gb = float(error.sum())
            past_w += gw**2
            past_v += gv**2
            past_b += gb**2
            w -= rate * gw / np.sqrt(past_w)
            v -= 0.2 * rate * gv / np.sqrt(past_v)
            model.bias -= rate * gb / past_b**0.5
    return model


def held_out(key: str = "doc_id") -> Column:
    """The fold that labels are never learned from."""
    return fold(F.col(key), 4, 2)


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, **options) -> Machine:
    """A machine for the labelled documents of ``labels`` (doc_id, label).

    The labels that are learned from are at most about ``sample``; only they
    are broadcast, and only their hashed terms come to the driver.
    """
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(known), "doc_id")
    picked = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text"))

    def start():
        terms = Terms()
        return lambda texts, _: [[terms.of(t).tobytes() for t in texts]]

    found = annotate(picked, start, {"terms": (T.BinaryType(), pa.binary())}, keep=["doc_id", "label"]).toArrow()
    found = found.sort_by("doc_id")
    rows = [np.frombuffer(t, dtype=np.int32) for t in found["terms"].to_pylist()]
    return fit(rows, np.array(found["label"].to_pylist(), dtype=float), **options)


def scored(docs: DataFrame, model: Machine, *, keep: list[str] | None = None) -> DataFrame:
    """The documents with ``score``, the likelihood that a text is toxic."""

    def start():
        terms = Terms()
        return lambda texts, _: [[model.score(model.features(terms.of(t))) for t in texts]]

    return annotate(docs, start, {"score": (T.DoubleType(), pa.float64())}, keep=keep)


def trained_on(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Machine:
    learned = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label")).where(~held_out())
    return train(docs, learned)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, its fold, the score and the decision of every document."""
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, trained_on(spark, docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
