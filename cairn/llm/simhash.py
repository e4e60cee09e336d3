"""SimHash near-duplicates, joined on a grid of segment bit counts.

A fingerprint's 64 bits are 32 segments of two bits.  The segments' bit
counts are a point whose Manhattan distance to another fingerprint's point is
at most their Hamming distance, so points of linked fingerprints lie within
``DISTANCE``.  One of the point's two halves then lies within half of that,
and a midpoint of the two halves lies within one step of both: each point
enters its own grid cell and those one step away, in either half, and linked
fingerprints meet in a cell.  What meets is verified on all 64 bits.

Copies meet once, as one fingerprint.  A cell yields the edges of a spanning
forest of its links, not all pairs; components come from those edges.  The
fullest cell has about 17 in 65,536 of all fingerprints.  In a cell of many,
fingerprints meet again by each fifth of their bits: of five fifths at most
four differ, so no link is lost and no cell is compared all with all.

Defined results: null and empty texts and those of white space have the
fingerprint zero and are linked like others; rows without a doc_id have a
fingerprint and take the class of their fingerprint; rows that repeat a
doc_id are in the class of their own text each; an empty table has no row.  A
long text is hashed as a whole, with eight bytes for each of its shingles.
``deduplicate`` keeps one row of each class: of the smallest doc_id (none comes
last), then of the least fingerprint, the least digest of the text, and the
least other columns as JSON.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import SPACED, annotate, free, least_rows, release, spread, table, written
from cairn.llm.components import components

SHINGLE = 4
SEED = 42
#: Fingerprints link at so many differing bits or fewer; the grid's steps are made for it.
DISTANCE = 4
HALF, BASE = 16, 3  # segments in a half, bit counts of a segment
#: Cells with more fingerprints are searched breadth first instead of pair by pair.
WIDE = 8
#: Cells with more are dealt by the fifths of their bits before.
DEAL = 1024
_FIFTHS = [np.uint64(((1 << high) - 1) ^ ((1 << low) - 1)) for low, high in ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))]
#: Bytes of the rows of a fingerprint in all its cells, and of the rows that a task gets.
_ENTERED, TASK_BYTES = 800, 32 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The bits that are set in over half of the shingles' hashes."""
    words = text.translate(SPACED).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: n - 1]]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :], strict=True)]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > n
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """The documents with ``fp``, the fingerprint as a signed 64-bit number."""

    def start():
        return lambda texts, _: [np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64)]

    return annotate(docs, start, {"fp": (T.LongType(), pa.int64())}, keep=keep)


def cells_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, fingerprint) for every cell that a fingerprint enters."""
    pairs = (fps[:, None] >> (2 * np.arange(2 * HALF, dtype=np.uint64))) & np.uint64(3)
    counts = np.array([0, 1, 1, 2], dtype=np.int64)[pairs.astype(np.int64)]
    power = BASE ** np.arange(HALF, dtype=np.int64)
    cells, who = [], []
    for half in range(2):
        part = counts[:, half * HALF : (half + 1) * HALF]
        own = part @ power + half * BASE**HALF
        cells.append(own)
        who.append(fps)
        for step in (-1, 1):
            rows, axis = np.nonzero((part + step >= 0) & (part + step < BASE))
            cells.append(own[rows] + step * power[axis])
            who.append(fps[rows])
    return np.concatenate(cells), np.concatenate(who)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _pairs(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """(left, right, wide): links of the narrow groups of equal ``keys``, which are sorted, and the wide groups."""
    edge = np.flatnonzero(np.diff(keys)) + 1
    starts = np.concatenate(([0], edge))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    left, right = [], []
    narrow = np.repeat(sizes <= WIDE, sizes)
    for shift in range(1, WIDE):
        same = narrow[shift:] & (keys[shift:] == keys[:-shift])
        at = np.flatnonzero(same)
        if not len(at):
            break
        at = at[_bits(fps[at] ^ fps[at + shift]) <= distance]
        left.append(fps[at])
        right.append(fps[at + shift])
    return left, right, [np.unique(fps[starts[k] : starts[k] + sizes[k]]) for k in np.flatnonzero(sizes > WIDE).tolist()]


def _forest(rest: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of different fingerprints, breadth first."""
    queue = []
    while len(rest):
        if queue:
            now = queue.pop()
        else:
            now, rest = rest[0], rest[1:]
        near = _bits(rest ^ now) <= distance
        reached = rest[near]
        if len(reached):
            rest = rest[~near]
            yield np.full(len(reached), now), reached
            queue.extend(reached)


def links_in(cells: np.ndarray, fps: np.ndarray, distance: int = DISTANCE, deal: int = DEAL) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked in each cell; ``cells`` is sorted and holds whole cells."""
    left, right, wide = _pairs(cells, fps, distance)
    for points in wide:
        groups = [points]
        if len(points) > deal and distance < len(_FIFTHS):
            groups = []
            for mask in _FIFTHS:
                by = points[np.argsort(points & mask, kind="stable")]
                more_left, more_right, found = _pairs(by & mask, by, distance)
                left += more_left
                right += more_right
                groups += found
        for group in groups:
            for a, b in _forest(group, distance):
                left.append(a)
                right.append(b)
    if not left:
        return fps[:0], fps[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    found = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
    return found[0], found[1]


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells, fps = cells_of(batch.column(0).to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(fps.view(np.int64))], names=["cell", "fp"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells arrive in order; the last of a batch waits for the next batch."""

    def out(cells: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = links_in(cells, fps)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    kept_cells, kept_fps = [], []
    for batch in batches:
        cells, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(cells):
            continue
        if kept_cells and cells[-1] == kept_cells[0][0]:
            kept_cells.append(cells)
            kept_fps.append(fps)
            continue
        cut = int(np.searchsorted(cells, cells[-1]))
        yield out(np.concatenate([*kept_cells, cells[:cut]]), np.concatenate([*kept_fps, fps[:cut]]))
        kept_cells, kept_fps = [cells[cut:]], [fps[cut:]]
    if kept_cells:
        yield out(np.concatenate(kept_cells), np.concatenate(kept_fps))


def link(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect the fingerprints ``fp`` of a written table, each of which is there once."""
    tasks = spread(distinct.sparkSession, _ENTERED * distinct.count(), TASK_BYTES)
    entered = distinct.select("fp").mapInArrow(_enter, "cell long, fp long")
    met = entered.repartition(tasks, "cell").sortWithinPartitions("cell")
    return met.mapInArrow(_verify, "a long, b long").distinct()


def near_duplicates(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) of every fingerprint of ``prints`` (doc_id, fp).

    ``root`` names the class by one of its fingerprints, component_id is the
    smallest doc_id in it, null if no row of it has one.
    """
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    links = written(link(distinct), "links")
    # Classes are made of fingerprints, so those without any doc_id link as well; the smallest doc_id follows.
    roots = components(links)
    classed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = written(classed.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    out = written(classed.join(least, "root").select("fp", "root", "component_id"), "classes")
    release(distinct, links, roots, least)
    return out


def _prints(docs: DataFrame) -> DataFrame:
    """doc_id, fp and the digest of the text of every row, written."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest"))
    return written(fingerprints(rows, keep=["doc_id", "digest"]), "prints")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``."""
    prints = _prints(docs)
    return prints.join(near_duplicates(prints).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each class, with the columns it came with.

    Which row is defined (see above) by values of the rows alone.  The least
    of a class and of equal rows are aggregates that are made before rows are
    moved, so neither a large class nor a row that repeats is one task's.
    """
    prints = _prints(docs)
    classed = prints.join(near_duplicates(prints).select("fp", "root"), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp", "digest")
    first = classed.groupBy("root").agg(F.min(order).alias("first"))
    kept, digest = free(docs.columns, "__doc_id", "__digest")
    # One key for the join and the aggregate, so texts are moved once.
    named = lambda key: F.coalesce(key.cast("long").cast("string"), F.lit("none"))
    stays = written(first.select(named(F.col("first.doc_id")).alias(kept), F.col("first.digest").alias(digest)), "stays")
    release(prints)

    keyed = docs.withColumns({kept: named(F.col("doc_id")), digest: F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))})
    return least_rows(keyed.join(stays, [kept, digest], "left_semi"), docs.columns, kept, digest)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the fingerprint in hex and the smallest doc_id that its links reach."""
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
