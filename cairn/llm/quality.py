"""Quality classifier: ridge regression on random Fourier features, calibrated.

A text becomes statistics of its characters, words and lines.  Random cosines
of the standardised statistics approximate a Gaussian kernel.  The normal
equations are sums over the labelled rows: each partition adds its own, the
sums are added in a few tasks, and the driver solves one small system.  The
ridge scores are calibrated to shares of label 1 by isotonic regression on
counts per score bin.

Defined results: null and empty texts have the statistics of an empty text;
without labelled rows every score is 0.5; equal texts of a
run score alike; repeated labels of a document count
as the largest, and each row of a labelled doc_id is learned from; a row
without a doc_id is scored and not held out; an empty table has no row; other
columns are not looked at.  The statistics are of whole texts, one of which a
worker holds with its words and lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import SPACED_CASED, annotate, parts, release, table, written
from cairn.llm.toxicity import held_out

COSINES = 256
#: The kernel's width, in standard deviations times the root of the number of statistics.
WIDTH = 1.0
RIDGE = 1e-3
BINS = 1000
THRESHOLD = 0.7

_CLASS = np.zeros(256, dtype=np.int64)  # 0 other: control characters and white space
_CLASS[0x21:0x30] = _CLASS[0x3A:0x41] = _CLASS[0x5B:0x61] = _CLASS[0x7B:0x7F] = 1  # symbols
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = 3
_CLASS[0x61:0x7B] = 4
_CLASS[0x80:] = 5
_ALPHA = bytes(0x20 if _CLASS[b] in (0, 1, 2) else b for b in range(256))

STATISTICS = (
    "log_bytes log_words mean_word symbols digits upper lower other distinct top_word again_word caps_words "
    "symbol_words no_letter_words line_words log_lines repeated_lines packed ends commas bars bangs long_words one_letter"
).split()


def statistics(text: bytes) -> list[float]:
    """The numbers named in ``STATISTICS``; shares of characters, words or lines unless named otherwise."""
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=6)
    words = text.translate(SPACED_CASED).split()
    n, w = max(1, len(text)), max(1, len(words))
    letters = max(1.0, kinds[3] + kinds[4])
    lines = text.split(b"\n")
    tally: dict[bytes, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    bare = text.translate(_ALPHA).split()
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        min(30.0, sum(map(len, words)) / w),
        kinds[1] / n,
        kinds[2] / n,
        kinds[3] / letters,
        kinds[4] / n,
        kinds[5] / n,
        len(tally) / w,
        max(tally.values(), default=0) / w,
        again / w,
        sum(map(bytes.isupper, words)) / w,
        sum(not x[-1:].isalpha() and x[-1] < 0x80 and x[-1:] not in b".,;:" for x in words) / w,
        1 - len(bare) / w if len(bare) < w else 0.0,
        min(500.0, w / len(lines)),
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / len(lines),
        len(zlib.compress(text, 1)) / n,
        (counts[0x2E] + counts[0x3F]) / w,
        counts[0x2C] / w,
        counts[0x7C] / w,
        counts[0x21] / w,
        sum(len(x) > 16 for x in words) / w,
        sum(len(x) == 1 for x in words) / w,
    ]


def described(docs: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """The documents with ``stats``, their statistics as an array of doubles."""

    def start():
        return lambda texts, _: [[statistics(t) for t in texts]]

    return annotate(docs, start, {"stats": (T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))}, keep=keep)


class Ridge:
    """Standardisation, cosines, coefficients and the calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, cosines: int = COSINES, width: float = WIDTH, seed: int = 0):
        rng, size = np.random.default_rng(seed), len(mean)
        self.mean, self.scale = mean, scale
        self.turn = rng.normal(0, 1 / (width * size**0.5), (size, cosines))
        self.phase = rng.uniform(0, 2 * np.pi, cosines)
        self.beta = np.zeros(cosines + 1)
        self.at, self.share = np.array([0.0]), np.array([0.5])

    def _standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -6, 6)

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.cos(self._standard(stats) @ self.turn + self.phase) * (2 / len(self.phase)) ** 0.5
        return np.concatenate((z, np.ones((len(z), 1))), axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        """The scores, row by row: a product of matrices rounds a row by its place among others, and equal texts score alike."""
        weights, base = self.beta[:-1] * (2 / len(self.phase)) ** 0.5, self.beta[-1]
        return np.array([np.cos(x @ self.turn + self.phase) @ weights + base for x in self._standard(stats)])

    def score(self, stats: np.ndarray) -> np.ndarray:
        """The calibrated score; it rises with the raw score, also within a step."""
        raw = self.raw(stats)
        return np.clip(np.interp(raw, self.at, self.share), 0, 1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to ``values``, by pooling neighbours that fall."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else values


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _summed(rows: DataFrame, size: int, add) -> np.ndarray:
    """The sum of ``add(batch)`` over all rows: by partition, then in a few tasks, then here."""
    schema = "sums binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in parts(batches, 2000):
            if len(batch):
                total += add(batch)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(first, schema).repartition(8).mapInArrow(again, schema).collect()
    return np.sum([np.frombuffer(bytes(r[0])) for r in sums], axis=0)


def train(rows: DataFrame, *, ridge: float = RIDGE, bins: int = BINS, **options) -> Ridge:
    """A model of ``rows`` (stats, label); all of them count."""
    size = len(STATISTICS)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column("stats"))
        return np.concatenate(([len(x)], x.sum(axis=0), (x**2).sum(axis=0)))

    sums = _summed(rows.select("stats"), 1 + 2 * size, moments)
    n = max(1.0, sums[0])
    mean = sums[1 : 1 + size] / n
    spread = np.sqrt(np.maximum(sums[1 + size :] / n - mean**2, 0))
    model = Ridge(mean, np.where(spread > 1e-9, spread, 1.0), **options)
    if not sums[0]:
        return model
    width = len(model.beta)

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z, y = model.features(_matrix(batch.column("stats"))), np.asarray(batch.column("label"), dtype=float)
        return np.concatenate(((z.T @ z).ravel(), z.T @ y))

    sums = _summed(rows.select("stats", "label"), width * width + width, equations)
    left = sums[: width * width].reshape(width, width) + ridge * n * np.diag([*[1.0 / width] * (width - 1), 0.0])
    model.beta = np.linalg.lstsq(left, sums[width * width :], rcond=None)[0]

    def tallied(batch: pa.RecordBatch) -> np.ndarray:
        raw, y = model.raw(_matrix(batch.column("stats"))), np.asarray(batch.column("label"), dtype=float)
        at = np.clip(((raw + 0.5) / 2 * bins).astype(int), 0, bins - 1)
        return np.concatenate((np.bincount(at, minlength=bins), np.bincount(at, weights=y, minlength=bins), np.bincount(at, weights=raw, minlength=bins)))

    count, good, raw = _summed(rows.select("stats", "label"), 3 * bins, tallied).reshape(3, bins)
    some = count > 0
    share = isotonic(good[some] / count[some], count[some])
    at = raw[some] / count[some]
    # Steps get a slight slope, so that the order of raw scores stays.
    model.at, model.share = at, np.clip(share * 0.998 + 0.002 * np.linspace(0, 1, len(share)), 0, 1)
    return model


def scored(rows: DataFrame, model: Ridge) -> DataFrame:
    """``rows`` (with stats) without them, with ``score``."""
    names = [c for c in rows.columns if c not in ("stats", "score")]
    taken = rows.select(*names, "stats")
    schema = T.StructType([*[f for f in taken.schema.fields if f.name != "stats"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2000):
            score = model.score(_matrix(batch.column("stats"))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], names=[*names, "score"])

    return taken.mapInArrow(run, schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, its fold, the score and the decision of every document."""
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    stats = written(described(docs, keep=["doc_id"]), "statistics")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    labelled = written(stats.join(known.where(~held_out()), "doc_id"), "labelled")
    model = train(labelled)
    release(labelled)
    return scored(stats, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
