"""Token ids of whole texts, in ascending doc_id order, in wavelet matrix files.

Texts are ranged by doc_id; each range is encoded in order and cut into
shards, and a shard's ids are one wavelet matrix.  The files are rows of a
Parquet table, written by Spark's own committer: a lost executor or a task
that runs twice leaves no half of a file, and any store that Spark writes to
will do.  The table is in the folder that the caller names, where it stays,
or without one in the shared folder until the driver ends.

Layout, one row a shard: ``shard`` (the range's number times 2**32 and the
shard's in it), ``before`` (ids of the range before it), ``n_ids``, ``doc_ids``
and ``lengths`` of its documents in order, and ``file``, the wavelet matrix of
its ids.  ``read_shards`` decodes, ``count_ids`` and ``locate_ids`` answer by
rank and select without decoding.

A text is encoded by pieces between ASCII white space where the tokenizer is
known to drop white space before it splits, so that a piece has the same ids
alone as in its text; each distinct piece of a block of texts is looked at once
and encoded once while it is in the table of pieces.  Texts of other tokenizers
are encoded whole.

Defined results: null and empty texts are the end id alone; rows that repeat
are written as often as they come; rows without a doc_id come first; rows of
one doc_id come in the order of their texts' XXH64, so that one doc_id can be
many tasks'; an empty table has no shard; other columns are not looked at.  A
text's ids are held by one worker, and a text is never cut over two shards.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import pairwise
from struct import pack as _pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import kept, spread, table, text_bytes, written
from cairn.llm.common import parts as slices
from cairn.llm.wavelet import WaveletMatrix, build

END = 1
#: Ids in a shard, unless one document has more.
SHARD_IDS = 1 << 19
#: Bytes of text in a range, about.
RANGE_BYTES = 128 << 20
#: Distinct pieces in a worker's table of pieces, beside those of the last block, and bytes of one with its ids, of which most have fewer.
PIECES, PIECE_BYTES = 500_000, 80
#: Bytes of texts that are encoded together, up to twice that or one text.
BLOCK_BYTES = 8 << 20
#: Pieces that the tokenizer gets at once.
PASS = 10_000
#: ASCII marks that split off a word's end, without the apostrophe and the brackets of special tokens.
MARKS = b".,;:!?%$#&*|()\"-"
#: A character that is not printable, so in no piece that is encoded beside others.
MARK = "\x01"


def vocabulary() -> str:
    """The place of the tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _normal(text: str) -> bool:
    """Whether composing and joining white space leave text as it is, and lower-casing is the same everywhere."""
    simple = text.isascii() or (unicodedata.is_normalized("NFC", text) and (_FAR.search(text) is None or text == text.lower()))
    return simple and "<" not in text and text.isprintable()


#: Characters behind the Latin blocks; lower-casing those before does not depend on their neighbours.
_FAR = re.compile("[^\\x00-\u024f]")


#: The steps of tokenizers that drop white space between pieces and are blind to case (fixed values of the tokenizer's file).
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def _apart(steps: dict) -> bool:
    """Whether pieces between white space have the same ids alone as in their text, in any case of ASCII letters."""
    first = (steps["pre_tokenizer"] or {}).get("pretokenizers", [None])[0]
    special = all(x["content"].startswith("<") for x in steps["added_tokens"])  # "<" is never cut off or lower-cased here
    return (steps["normalizer"] or {}).get("normalizers") == _NORMAL and first == _SPLIT and special and not steps["truncation"] and not steps["post_processor"]


def _ends(model: dict) -> np.ndarray | None:
    """For each id whether it is the last of a word, where the vocabulary says so and has an id for every byte there."""
    suffix, vocabulary = model.get("end_of_word_suffix"), model["vocab"]
    alone = {k[: -len(suffix)] for k in vocabulary if k.endswith(suffix)} if suffix else set()
    if sum(len(x) == 1 for x in alone) < 256 or model.get("unk_token") is not None:
        return None
    ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    ends[[i for k, i in vocabulary.items() if k.endswith(suffix)]] = True
    return ends


#: The ids of a piece.
_IDS = pa.list_(pa.uint32())
#: Whether a byte is an ASCII letter or digit.
_ALNUM = np.array([bytes([b]).isalnum() for b in range(256)])


def _packed(ids: list[int]) -> bytes:
    return _pack(f"<{len(ids)}I", *ids)


def _lists(ids: list[bytes]) -> pa.Array:
    """Ids as a column of lists."""
    offsets = np.cumsum([0, *map(len, ids)]) // 4
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<u4")), type=_IDS)


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows, from and to, of at most that size or one row."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if sizes:
        yield start, len(sizes)


class Encoder:
    """Texts to ids of the tokenizer in the file ``path``.

    The distinct pieces of a block of texts are looked up together, each as a
    word and the marks behind it, and only those that are not in the table go
    to the tokenizer.  When the table is full, the half that was asked for more
    often stays, so memory is bounded.
    """

    def __init__(self, path: str, pieces: int = PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), pieces
        steps = json.loads(self.tokenizer.to_str())
        self.apart = _apart(steps)
        self.bare = self.ends = None  # for pieces that the normaliser would leave as they are
        if self.apart:
            self.ends = _ends(steps["model"])
            steps["normalizer"] = None
            bare = Tokenizer.from_str(json.dumps(steps))
            mark = bare.encode(MARK, add_special_tokens=False).ids
            if len(mark) == 1:
                self.bare, self.mark = bare, mark[0]
        self.known = pa.array([], pa.binary())
        self.ids = pa.array([], _IDS)
        self.asked = np.zeros(0, dtype=np.int64)

    def _bare(self, pieces: list[str], between: str) -> np.ndarray:
        """The ids of normal pieces in a row."""
        return np.array(self.bare.encode_batch_fast([between.join(pieces).lower()], add_special_tokens=False)[0].ids, dtype="<u4")

    def _words(self, words: list[str]) -> list[bytes] | None:
        """The ids of normal words of letters alone: a word ends where an id that ends a word is, if there are as many as words."""
        ids = self._bare(words, " ")
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) != len(words) or ends[-1] != 4 * len(ids):
            return None
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _marked(self, pieces: list[str]) -> list[bytes]:
        """The ids of normal pieces, in one text with a character between them that none of them has."""
        ids = self._bare(pieces, f" {MARK} ")
        ends = 4 * np.flatnonzero(ids == self.mark)
        raw, cuts = ids.tobytes(), zip([0, *(ends + 4).tolist()], [*ends.tolist(), 4 * len(ids)], strict=True)
        return [raw[a:b] for a, b in cuts]

    def _plain(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces, from the tokenizer."""
        texts, found = [p.decode("utf-8", "replace") for p in pieces], {}
        if self.bare is not None:
            normal = texts if _normal(" ".join(texts)) else [t for t in texts if _normal(t) and "\ufffd" not in t]
            words = [t for t in normal if t.lower().isalpha()] if self.ends is not None else []
            if words and (ids := self._words(words)) is not None:
                found.update(zip(words, ids, strict=True))
            if rest := [t for t in normal if t not in found]:
                found.update(zip(rest, self._marked(rest), strict=True))
        if rest := [t for t in dict.fromkeys(texts) if t not in found]:
            found.update((t, _packed(e.ids)) for t, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        return [found[t] for t in texts]

    def _lookup(self, pieces: pa.Array) -> pa.Array:
        """The ids of distinct pieces, in order; those that are new are in the table afterwards."""
        if len(self.known) > self.limit or self.known.nbytes + self.ids.nbytes > PIECE_BYTES * self.limit:
            often = np.sort(np.argsort(self.asked, kind="stable")[-(min(self.limit, len(self.known)) // 2) :])
            self.known, self.ids, self.asked = self.known.take(often), self.ids.take(often), self.asked[often] // 2
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(at.is_null())
        if len(new):
            made = [_lists(self._plain(new.slice(i, PASS).to_pylist())) for i in range(0, len(new), PASS)]
            first = len(self.known)
            self.known, self.ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.ids, *made])
            self.asked = np.concatenate((self.asked, np.zeros(len(new), dtype=np.int64)))
            at = pc.replace_with_mask(at, at.is_null(), pa.array(np.arange(first, len(self.known), dtype=np.int32)))
        self.asked[at.to_numpy()] += 1
        return self.ids.take(at)

    def _block(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts, by their distinct pieces."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        found = split.values.dictionary_encode()
        pieces = found.dictionary
        # Of pieces without combining mark and special token, ASCII letters can be lower before the tokenizer sees them.
        cased = pc.or_(pc.match_substring(pieces, b"\xcc"), pc.match_substring(pieces, "<"))
        pieces = pc.if_else(cased, pieces, pc.ascii_lower(pieces))
        # Marks after a letter or digit are a piece of their own for the tokenizer.
        offsets, data = np.frombuffer(pieces.buffers()[1], dtype=np.int32)[: len(pieces) + 1], pieces.buffers()[2] or pa.py_buffer(b"")
        ends = offsets[:-1] + pc.binary_length(pc.ascii_rtrim(pieces, characters=MARKS.decode())).to_numpy()
        apart = ends > offsets[:-1]
        apart[apart] = _ALNUM[np.frombuffer(data, dtype=np.uint8)[ends[apart] - 1]]
        cuts = np.empty(2 * len(pieces) + 1, dtype=np.int32)
        cuts[::2], cuts[1::2] = offsets, np.where(apart, ends, offsets[1:])
        parts = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), data]).dictionary_encode()
        twice = self._lookup(parts.dictionary).take(parts.indices)
        ids = pa.ListArray.from_arrays(pa.array(twice.offsets.to_numpy()[::2]), twice.values).take(found.indices)
        raw, places = ids.values.to_numpy().tobytes(), 4 * ids.offsets.to_numpy()[split.offsets.to_numpy()].astype(np.int64)
        return [raw[a:b] for a, b in pairwise(places.tolist())]

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """The ids of UTF-8 texts, as little-endian unsigned 32-bit numbers."""
        if not self.apart:
            found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [_packed(e.ids) for e in found]
        out: list[bytes] = []
        for a, b in _runs([len(t) for t in texts], 2 * BLOCK_BYTES):
            out += self._block(texts[a:b])
        return out

    def encode(self, text: bytes) -> np.ndarray:
        """The ids of one text."""
        return np.frombuffer(self.encode_batch([text])[0], dtype="<u4")


def encoder(path: str) -> Encoder:
    """The worker's encoder, with the pieces that its earlier tasks have met."""
    return kept(("encoder", path), lambda: Encoder(path))


_FIELDS = [
    ("shard", pa.int64()),
    ("before", pa.int64()),
    ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int64())),
    ("file", pa.binary()),
]
_SHARD = "shard long, before long, n_ids long, doc_ids array<long>, lengths array<long>, file binary"
#: A shard's number is its range's number times this, and its number in the range.
_RANGE = 1 << 32


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """doc_ids and texts (null: empty) in order, for a block of texts at a time."""
    keys, texts, held = [], [], 0
    for batch in slices(batches, 100):
        keys += batch.column(0).to_pylist()
        texts += [t or b"" for t in batch.column(1).to_pylist()]
        held += sum(map(len, texts[len(texts) - batch.num_rows :]))
        if held >= BLOCK_BYTES:
            yield keys, texts
            keys, texts, held = [], [], 0
    yield keys, texts


def _shards(path: str, end: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, last = encoder(path).encode_batch, np.array([end], dtype="<u4").tobytes()
        number, before = TaskContext.get().partitionId() * _RANGE, 0
        keys, lengths, parts, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            row = (number, before, held, keys, lengths, build(np.frombuffer(b"".join(parts), dtype="<u4")))
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, (_, kind) in zip(row, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

        for own, texts in _blocks(batches):
            for key, ids in zip(own, encode(texts), strict=True):
                n = len(ids) // 4 + 1
                if parts and held + n > shard_ids:
                    yield out()
                    number, before = number + 1, before + held
                    keys, lengths, parts, held = [], [], [], 0
                keys.append(key)
                lengths.append(n)
                parts += [ids, last]
                held += n
        if parts:
            yield out()

    return run


def write_shards(docs: DataFrame, path: str, *, output: str | None = None, end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The table of shards, written to the new folder ``output``, or without one until the driver ends.

    ``path`` names the tokenizer's file.  Shards in the order of their numbers
    hold the documents in ascending order.
    """
    spark = docs.sparkSession
    ranges = spread(spark, text_bytes(docs), RANGE_BYTES)
    text = F.col("text").cast("string")
    order = F.col("doc_id").asc_nulls_first(), F.col("turn")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("turn"))
    ordered = texts.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    shards = ordered.mapInArrow(_shards(path, end, shard_ids), _SHARD)
    if output is None:
        return written(shards, "tokens")
    shards.write.option("compression", "zstd").parquet(output)
    return spark.read.schema(_SHARD).parquet(output)


_PLACED = ("shard", "first", "doc_ids", "lengths", "file")


def _placed(shards: DataFrame) -> DataFrame:
    """Shards with the number of ids before them.

    The driver sums the ids of the ranges: one number for ``RANGE_BYTES`` of
    text, so what is broadcast is a ten-millionth of the input.
    """
    spark = shards.sparkSession
    range_of = F.floor(F.col("shard") / _RANGE).cast("long")
    starts, before = [], 0
    for number, n in sorted(tuple(r) for r in shards.groupBy(range_of.alias("range")).agg(F.sum("n_ids")).collect()):
        starts.append((number, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(starts, "range long, first long"))
    placed = shards.withColumn("range", range_of).join(offsets, "range").withColumn("first", F.col("first") + F.col("before"))
    return placed.select(*_PLACED)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in slices(batches, 4):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and shard of every document, decoded from the files."""
    return _placed(shards).mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, before, keys, lengths, data in _each(batches):
        ids = WaveletMatrix(data).decode().astype("<u4")
        ends = np.cumsum(lengths)
        starts = ends - lengths
        crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        columns = [pa.array(x, pa.int64()) for x in (keys, starts + before, lengths, crcs, [shard] * len(keys))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])


def count_ids(shards: DataFrame, ids: list[int]) -> DataFrame:
    """(id, n): how often each of a few ids occurs, by rank in every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), dtype=np.int64)
        for batch in slices(batches, 4):
            for data in batch.column(0).to_pylist():
                matrix = WaveletMatrix(data)
                total += [matrix.count(x) for x in ids]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total)], names=["id", "n"])

    return shards.select("file").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def locate_ids(shards: DataFrame, ids: list[int]) -> DataFrame:
    """(id, position, doc_id, place) of all occurrences of a few ids: among all ids, and in the document; by select."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, before, keys, lengths, data in _each(batches):
            matrix, ends = WaveletMatrix(data), np.cumsum(lengths)
            for x in ids:
                at = matrix.positions(x)
                doc = np.searchsorted(ends, at, side="right")
                place = at - (ends - lengths)[doc]
                columns = [pa.array(c, pa.int64()) for c in (np.full(len(at), x), at + before, [keys[i] for i in doc.tolist()], place)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "position", "doc_id", "place"])

    return _placed(shards).mapInArrow(run, "id long, position long, doc_id long, place long")


def ids_at(shards: DataFrame, positions: DataFrame) -> DataFrame:
    """``positions`` (position) with ``id``, the id there, by access: positions are sent to the files that have them."""
    spark = shards.sparkSession
    ranges = shards.select("shard", "before", "n_ids")
    placed = _placed(shards).select("shard", "first", "file")
    spans = placed.select("shard", "first").join(ranges.select("shard", "n_ids"), "shard")
    bounds = sorted((r["first"], r["n_ids"], r["shard"]) for r in spans.collect())  # three numbers for half a million ids
    if not bounds:
        return spark.createDataFrame([], "position long, id long")
    firsts, shard_of = np.array([b[0] for b in bounds]), np.array([b[2] for b in bounds])
    total = bounds[-1][0] + bounds[-1][1]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(shard_of[np.searchsorted(firsts, at, side="right") - 1]), pa.array(at)], names=["shard", "position"])

    def access(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            for first, data, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                matrix = WaveletMatrix(data)
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([matrix.access(p - first) for p in wanted], pa.int64())], names=["position", "id"])

    inside = positions.select(F.col("position").cast("long")).where((F.col("position") >= 0) & (F.col("position") < total))
    asked = inside.mapInArrow(send, "shard long, position long").groupBy("shard").agg(F.collect_set("position").alias("wanted"))
    return placed.join(asked, "shard").select("first", "file", "wanted").mapInArrow(access, "position long, id long")


def op7_wavelet_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files say of every document."""
    return read_shards(write_shards(table(spark, sf_dir, "documents"), vocabulary()))
