"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Every five bytes in a row give six triplets; each is hashed into one of
``BUCKETS`` counters.  Two bits for each bucket say between which quartiles
of all counts its count lies.  A header holds a checksum byte, the length on
a logarithmic scale and the ratios of the quartiles.  The difference of two
digests is bounded, so a likeness from 0 to 1 follows.

Defined results: null and empty texts have the digest of no triplet; texts of
the same bytes have the same digest, whatever their length; a table of one
document is its own next document; rows that repeat a doc_id follow one
another in the order of their texts' XXH64, so that one doc_id can be many
tasks'; rows without a doc_id come first; an empty table has no row; other
columns are not looked at.  Bytes of long texts are counted in pieces of a
megabyte; the text itself and the next are held by one worker.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import parts, spread, table, text_bytes, written

BUCKETS = 128
#: Places in a window of five bytes whose bytes make a triplet.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
RANGE_BYTES = 128 << 20
#: A text is counted in pieces of this many bytes, so memory stays flat for long ones.
PIECE = 1 << 20

_SPREAD = np.random.default_rng(20).integers(0, 1 << 16, (3, 256), dtype=np.uint16)  # three random tables: the triplets' hash


def counts(text: bytes) -> np.ndarray:
    """Triplets in each bucket."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for start in range(0, max(1, len(text) - 4), PIECE):
        raw = np.frombuffer(text, dtype=np.uint8)[start : start + PIECE + 4]
        n = len(raw) - 4
        if n <= 0:
            break
        first, second, third = (t[raw] for t in _SPREAD)
        for k, (a, b, c) in enumerate(TRIPLETS):
            hashed = first[a : a + n] + second[b : b + n] * np.uint16(2 * k + 1) + third[c : c + n]
            total += np.bincount((hashed >> np.uint16(9)).astype(np.uint8), minlength=BUCKETS)
    return total


def digest(text: bytes) -> bytes:
    """Checksum, length, quartile ratios (one byte each), and two bits for each bucket."""
    found = counts(text)
    low, middle, high = np.sort(found)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    length = min(255, int(8 * math.log(len(text), 1.5) / 4)) if len(text) > 1 else 0
    ratios = min(15, 16 * low // high) << 4 | min(15, 16 * middle // high) if high else 0
    codes = ((found > low).astype(np.uint8) + (found > middle) + (found > high)).reshape(-1, 4)
    body = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    return bytes([hashlib.md5(text).digest()[0], length, ratios]) + body.astype(np.uint8).tobytes()


#: The difference of two bytes of four codes: 0, 1, 2 for each code, and 6 where the codes are ends.
_STEP = np.array([0, 1, 2, 6])
_APART = sum(_STEP[np.abs((np.arange(256)[:, None] >> s & 3) - (np.arange(256)[None, :] >> s & 3))] for s in (0, 2, 4, 6)).astype(np.int64)
#: The difference at which texts count as having nothing in common.
UNLIKE = 300


def difference(a: bytes, b: bytes) -> int:
    """The bounded difference: buckets, quartile ratios, length and checksum."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    body = int(_APART[x[3:], y[3:]].sum())
    ratios = abs((a[2] >> 4) - (b[2] >> 4)) + abs((a[2] & 15) - (b[2] & 15))
    return body + ratios + 2 * min(24, abs(a[1] - b[1])) + (a[0] != b[0])


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests, 0 for a difference of ``UNLIKE`` or more."""
    return max(0.0, 1 - difference(a, b) / UNLIKE)


def edited(text: bytes, following: bytes) -> bytes:
    """The last half of the code points replaced by the first as many of the next text."""
    n = code_points(text)
    return text[: _offset(text, n - n // 2)] + following[: _offset(following, n // 2)]


def _starts(text: bytes) -> np.ndarray:
    return (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else int(np.count_nonzero(_starts(text)))


def _offset(text: bytes, n: int) -> int:
    """The byte at which code point n starts, or the end."""
    if text.isascii():
        return min(n, len(text))
    at = np.flatnonzero(_starts(text))
    return int(at[n]) if n < len(at) else len(text)


_OUT = "part long, first boolean, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text binary"
_KIND = [("part", pa.int64()), ("first", pa.bool_()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.binary())]


def _compared(text: bytes, own: bytes, following: bytes, next_digest: bytes) -> tuple:
    changed = edited(text, following)
    other = digest(changed)
    return code_points(text), hashlib.sha256(changed).hexdigest(), own.hex(), other.hex(), likeness(own, other), likeness(own, next_digest)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _KIND]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _KIND, strict=True)], names=[n for n, _ in _KIND])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with its next; the first and the last of the partition go on with their texts."""
    from pyspark import TaskContext

    part, before, edge = TaskContext.get().partitionId(), None, (None,) * 6
    for batch in parts(batches):
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or b""
            own = digest(text)
            if before is None:
                rows.append((part, True, key, *edge, text))
            else:
                rows.append((part, None, before[0], *_compared(before[1], before[2], text, own), None))
            before = key, text, own
        yield _batch(rows)
    if before is not None:
        yield _batch([(part, False, before[0], *edge, before[1])])


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 4):
        rows = []
        for key, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append((0, None, key, *_compared(text, digest(text), following, digest(following)), None))
        yield _batch(rows)


def compared(docs: DataFrame) -> DataFrame:
    """Every document's digest, that of its edited text, and how alike it is to that and to the next.

    Texts are ranged by doc_id once.  A partition compares the documents that
    it has in a row; what lies across two partitions is one pair for each.
    """
    spark = docs.sparkSession
    ranges = spread(spark, text_bytes(docs), RANGE_BYTES)
    text = F.col("text").cast("string")
    order = F.col("doc_id").asc_nulls_first(), F.col("turn")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("turn"))
    ordered = texts.repartitionByRange(ranges, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first()).select("doc_id", "text")
    found = written(ordered.mapInArrow(_in_order, _OUT), "digests")
    numbers = sorted(r[0] for r in found.where("first").select("part").collect())  # one number for each partition
    names = found.columns[2:-1]
    inside = found.where("first is null").select(*names)
    if not numbers:
        return inside
    turns = spark.createDataFrame(list(zip(numbers, [*numbers[1:], numbers[0]], strict=True)), "part long, next_part long")
    last = found.where("not first").select("part", "doc_id", "text").join(turns, "part")
    first = found.where("first").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    edges = last.join(first, "next_part").select("doc_id", "text", "following").mapInArrow(_at_edges, _OUT)
    return inside.unionByName(edges.select(*names))


def op6_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests and likenesses of every document."""
    return compared(table(spark, sf_dir, "documents"))
