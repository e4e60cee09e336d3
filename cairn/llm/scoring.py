"""Language-model scores: the likelihood of texts over all subword segmentations.

A word's lattice has arcs for the pieces of an existing vocabulary.  Their
scores give the pieces' first probabilities, which expectation maximisation
over the training rows' distinct words adapts.  ``lattice_score`` is the
marginal of that lattice alone: the log-probability of a text as the product
over its words, and the end, of the sum over all segmentations into pieces.

``score`` mixes two models.  In it a word that the training rows have is also
one arc as a whole, with its discounted share of uses; what the discounts
leave is the weight of the pieces.  The shares are those of a class of
training rows.  The classes are the training rows' languages: texts of one
language use one vocabulary, and the column is part of the rows that are
learned from.  A text's own class is not looked at: its probability is the sum
over the classes, of the class's weight times the product over its words.  The
mixture has ``CLASSES`` parts of its own and one for all rarer languages, so
every training row counts in one; without ``group`` it has one part.

The scan turns texts into chunks: the chunk's distinct words, dealt over
buckets by a hash of the word, and each document's word numbers, which stay
together.  Words meet in their bucket once for each chunk, not for each use,
so no word is hot however common it is; a bucket answers each chunk with its
words' counts and probabilities.  Chunks, counts and answers are all that is
moved, and they grow with the corpus.

Defined results: null and empty texts have the end as their only token;
without training rows N is 0 and the pieces keep their first probabilities;
training rows of a rare class or none are one class together; classes of
equal size are taken in the order of their names; rows that
repeat are counted and scored one by one; a row without a doc_id
is not held out; an empty table has no row; columns that are not named are not
looked at; bytes that are no UTF-8 are scored as U+FFFD.  A long text is a
chunk of its own: its words' numbers are held by one worker.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import SPACED, fold, release, spread, table, text_bytes, written
from cairn.llm.common import parts as slices
from cairn.llm.lattice import Lattice, Pieces

#: Bytes of text in a chunk, about, and for each bucket of words.
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
#: Rounds of expectation maximisation; a round is a pass over the distinct words.
ROUNDS = 2
#: Uses that the first probabilities count as, for each piece on average.
PRIOR = 0.1
#: What is taken from the count of each word that a class has, for the pieces.
DISCOUNT = 0.75
#: Classes with counts of their own: the most frequent; the rest is one more.
CLASSES = 7
SMOOTHING = 0.1


def vocabulary() -> str:
    """The place of the pieces' file."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out(key: str = "doc_id") -> Column:
    """The fold that is never learned from."""
    return fold(F.col(key), 10, 0)


_ROW = "chunk long, kind int, bucket int, n_tokens array<long>, n_docs array<long>, a binary, b binary"
_KINDS = [("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n_tokens", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int64())), ("a", pa.binary()), ("b", pa.binary())]
_WORDS, _DOCS, _ANSWER = 2, 0, 1


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _KINDS]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _KINDS, strict=True)], names=[n for n, _ in _KINDS])


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(1).compress(data)


def _stretch(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class _Chunk:
    """Documents and their words until the chunk is full."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.keys, self.groups, self.parts, self.size = [], [], [], 0

    def add(self, key: int | None, group: int, text: bytes) -> None:
        """``group`` is the class that the text counts for, or -1 if it is held out."""
        index = self.index
        words = text.translate(SPACED).split()
        self.parts.append(np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int32))
        self.keys.append(key)
        self.groups.append(group)
        self.size += len(text) + 64

    def rows(self, number: int, buckets: int, classes: int) -> Iterator[tuple]:
        """A row for each bucket that has words of the chunk, and one for its documents."""
        words = list(self.index)
        bucket = np.array([zlib.crc32(w) % buckets for w in words], dtype=np.int32)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), dtype=np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        lengths = np.array([len(p) for p in self.parts], dtype=np.int64)
        flat = place[np.concatenate(self.parts)] if len(words) else np.zeros(0, dtype=np.int32)
        groups = np.array(self.groups, dtype=np.int64)
        group = np.repeat(groups, lengths)
        counts = np.stack([np.bincount(flat[group == k], minlength=len(words)) for k in range(classes)]).astype("<u4")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            start, end = edges[b], edges[b + 1]
            text = b"\n".join([words[i] for i in order[start:end].tolist()])
            yield number, _WORDS, b, None, None, _squeeze(text), _squeeze(counts[:, start:end].tobytes())
        n_docs = np.bincount(groups[groups >= 0], minlength=classes)
        keys = pa.array(self.keys, pa.int64())
        head = np.stack((np.asarray(keys.fill_null(0)), np.asarray(keys.is_null()).astype(np.int64), groups < 0, lengths))
        yield number, _DOCS, -1, (counts.sum(axis=1) + n_docs).tolist(), n_docs.tolist(), _squeeze(head.astype("<i8").tobytes()), _squeeze(flat.astype("<i4").tobytes())


def _chunks(buckets: int, classes: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in slices(batches, 200):
            for key, group, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chunk.add(key, group, text or b"")
                if chunk.size >= chunk_bytes:
                    yield _rows(list(chunk.rows(number, buckets, classes)))
                    number, chunk = number + 1, _Chunk()
        if chunk.keys:
            yield _rows(list(chunk.rows(number, buckets, classes)))

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[tuple[int, list[tuple[int, list[bytes], np.ndarray]]]]:
    """(bucket, [(chunk, words, counts by class)]) of rows in the order of buckets."""
    now, held = None, []
    for batch in slices(batches, 200):
        for chunk, bucket, a, b in zip(*(batch.column(c).to_pylist() for c in ("chunk", "bucket", "a", "b")), strict=True):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append((chunk, _stretch(a).split(b"\n"), np.frombuffer(_stretch(b), dtype="<u4").reshape(classes, -1)))
    if held:
        yield now, held


def _counted(parts: list[tuple[int, list[bytes], np.ndarray]]) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """The bucket's words, where those of each part are among them, and their counts by class."""
    index: dict[bytes, int] = {}
    places = [np.array([index.setdefault(w, len(index)) for w in words]) for _, words, _ in parts]
    total = np.zeros((len(parts[0][2]), len(index)), dtype="<u8")
    for at, (_, _, counts) in zip(places, parts, strict=True):
        total[:, at] += counts  # a part has each word once
    return list(index), places, total


def _count(classes: int):
    """The words of each bucket that the training rows have, and how many each class has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in _by_bucket(batches, classes):
            words, _, total = _counted(parts)
            known = np.flatnonzero(total.any(axis=0))
            text = b"\n".join([words[i] for i in known.tolist()])
            yield _rows([(0, _WORDS, bucket, [len(known)], (total > 0).sum(axis=1).tolist(), _squeeze(text), b"")])

    return run


_lattice: dict[bytes, Lattice] = {}


def _lattice_of(texts: list[str], probabilities: np.ndarray) -> Lattice:
    """The worker's lattice of these probabilities; the one before is dropped."""
    key = hashlib.md5(probabilities.tobytes()).digest()
    if key not in _lattice:
        _lattice.clear()
        _lattice[key] = Lattice(texts, probabilities)
    return _lattice[key]


def _expect(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = _lattice_of(*model.value), None
        for batch in slices(batches, 200):
            for n, a in zip(*(batch.column(c).to_pylist() for c in ("n_tokens", "a")), strict=True):
                if n[0]:
                    words = [w.decode("utf-8", "replace") for w in _stretch(a).split(b"\n")]
                    total = lattice.expect(words, np.ones(len(words))) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0).to_pylist():
            total = np.frombuffer(x) + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})


def adapt(pieces: Pieces, words: DataFrame, rounds: int = ROUNDS, tasks: int = 8) -> np.ndarray:
    """Probabilities of the pieces, the bytes and the end, from the distinct training words.

    Buckets of words are dealt over ``tasks``; what a task adds up has the
    vocabulary's size, and so have the few sums that come here.
    """
    context, p = words.sparkSession.sparkContext, pieces.prior
    dealt = words.select("n_tokens", "a", "bucket").repartition(tasks, "bucket")
    for _ in range(rounds):
        model = context.broadcast((pieces.texts, p))
        sums = dealt.mapInArrow(_expect(model), "sums binary").repartition(8).mapInArrow(_add, "sums binary").collect()
        expected = np.sum([np.frombuffer(bytes(r[0])) for r in sums], axis=0) if sums else np.zeros(len(p))
        p = expected + PRIOR * len(p) * pieces.prior
        p = p / p.sum()
        model.unpersist()
    return p


def _answer(model, classes: int):
    """Each chunk's words in a bucket with their counts by class and the pieces' log10 probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice_of(*model.value)
        for bucket, parts in _by_bucket(batches, classes):
            words, places, total = _counted(parts)
            logs = (lattice.score([w.decode("utf-8", "replace") for w in words]) / math.log(10)).astype("<f8")
            for start in range(0, len(parts), 64):
                rows = []
                for (chunk, _, _), at in zip(parts[start : start + 64], places[start : start + 64], strict=True):
                    rows.append((chunk, _ANSWER, bucket, None, None, _squeeze(total[:, at].astype("<u8").tobytes()), _squeeze(logs[at].tobytes())))
                yield _rows(rows)

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"


def _finish(n_tokens: np.ndarray, n_docs: np.ndarray, n_types: np.ndarray, all_types: int, end_log: float):
    """Sums over each document's words, once the answers to its chunk are there."""
    whole = math.log10(n_tokens.sum() + SMOOTHING * (all_types + 1))
    end_base = math.log10(n_docs.sum() + SMOOTHING) - whole
    used = np.flatnonzero(n_docs > 0)  # a class that has a document has a token: its end
    weight = np.log10(n_docs[used] / n_docs.sum()) if len(used) else np.zeros(1)

    def by_class(uses: np.ndarray, logs: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """Log10 probabilities of the words, and of the end, in each class."""
        if not len(used):
            yield logs, end_log
        for k in used.tolist():
            types = n_types[k] + 1
            rest = math.log10(DISCOUNT * types / n_tokens[k])
            known = uses[k] > 0
            out = logs + rest
            own = np.log10((uses[k][known] - DISCOUNT) / n_tokens[k])
            out[known] = own + np.log10(1 + 10 ** np.minimum(out[known] - own, 300))
            yield out, math.log10((n_docs[k] - DISCOUNT) / n_tokens[k] + DISCOUNT * types / n_tokens[k] * 10**end_log)

    def done(documents: tuple[bytes, bytes], answers: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        key, missing, held, lengths = np.frombuffer(_stretch(documents[0]), dtype="<i8").reshape(4, -1)
        flat = np.frombuffer(_stretch(documents[1]), dtype="<i4")
        empty = np.zeros((len(n_docs), 0), dtype="<u8")
        uses = np.concatenate([np.frombuffer(_stretch(a), dtype="<u8").reshape(len(n_docs), -1) for a, _ in answers] or [empty], axis=1)
        logs = np.concatenate([np.frombuffer(_stretch(b), dtype="<f8") for _, b in answers] or [np.zeros(0)])
        row = np.repeat(np.arange(len(key)), lengths)
        sums = lambda x: np.bincount(row, weights=x[flat], minlength=len(key)) if len(flat) else np.zeros(len(key))
        total = uses.sum(axis=0)
        base, known = sums(np.log10(total + SMOOTHING) - whole), sums((total > 0).astype(float))
        ways = np.stack([w + sums(words) + end for w, (words, end) in zip(weight.tolist(), by_class(uses, logs), strict=True)])
        top = ways.max(axis=0)
        columns = [
            pa.array(key, pa.int64(), mask=missing.astype(bool)),
            pa.array(held.astype(bool)),
            pa.array(lengths + 1, pa.int64()),
            pa.array(known.astype(np.int64) + bool(n_docs.sum()), pa.int64()),
            pa.array(np.full(len(key), int(n_tokens.sum())), pa.int64()),
            pa.array(base + end_base),
            pa.array(top + np.log10((10 ** (ways - top)).sum(axis=0))),
            pa.array(sums(logs) + end_log),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCORED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, answers = None, []
        for batch in slices(batches, 200):
            for kind, a, b in zip(*(batch.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True):
                if kind == _DOCS:
                    if documents is not None:
                        yield done(documents, answers)
                    documents, answers = (a, b), []
                else:
                    answers.append((a, b))
        if documents is not None:
            yield done(documents, answers)

    return run


def score(
    docs: DataFrame,
    path: str,
    held: Column,
    *,
    group: str | None = "lang",
    rounds: int = ROUNDS,
    chunk_bytes: int = CHUNK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and lattice_score of every document.

    ``held`` says which rows are not learned from, ``group`` names the column
    with the classes of the rows that are.
    """
    spark = docs.sparkSession
    buckets = 2 * spread(spark, text_bytes(docs), bucket_bytes)
    own, names = F.lit(None).cast("string") if group is None else F.col(group).cast("string"), []
    if group is not None:
        tally = docs.where(~held).groupBy(own.alias("name")).count().where("name is not null")
        names = [r[0] for r in tally.orderBy(F.col("count").desc(), "name").limit(CLASSES).collect()]
    place = F.lit(len(names))
    for k, name in enumerate(names):
        place = F.when(own == name, k).otherwise(place)
    classes = len(names) + 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(held, -1).otherwise(place).alias("group"), F.col("text").cast("string").cast("binary").alias("text"))
    chunks = written(texts.mapInArrow(_chunks(buckets, classes, chunk_bytes), _ROW), "chunks")
    words = chunks.where(F.col("kind") == _WORDS)
    dealt = words.repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk")
    known = written(dealt.mapInArrow(_count(classes), _ROW), "words")

    def summed(rows: DataFrame, name: str, n: int) -> np.ndarray:
        return np.array([int(x or 0) for x in rows.agg(*[F.sum(F.col(name)[k]) for k in range(n)]).first()])

    documents = chunks.where(F.col("kind") == _DOCS)
    n_tokens, n_docs = summed(documents, "n_tokens", classes), summed(documents, "n_docs", classes)
    n_types, all_types = summed(known, "n_docs", classes), int(summed(known, "n_tokens", 1)[0]) + bool(n_docs.sum())
    pieces = Pieces(path)
    p = adapt(pieces, known, rounds, buckets)
    release(known)

    answers = dealt.mapInArrow(_answer(spark.sparkContext.broadcast((pieces.texts, p)), classes), _ROW)
    gathered = documents.unionByName(answers).repartition(buckets, "chunk").sortWithinPartitions("chunk", "kind", "bucket")
    return gathered.mapInArrow(_finish(n_tokens, n_docs, n_types, all_types, math.log10(p[-1])), _SCORED)


def op8_lattice_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of every document."""
    return score(table(spark, sf_dir, "documents"), vocabulary(), held_out())
