"""Removal of repeated substrings, by sorting the suffixes that could repeat.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a
document with a smaller doc_id.  Sorting all suffixes of a corpus would move
every text many times over, so suffixes are sampled first: in each string of
``LENGTH`` bytes the seed of ``SEED`` bytes with the least hash is its anchor,
and equal strings have equal anchors.  Strings in a row with the same anchor
are a run; there are about sixteen times fewer runs than bytes.

1. The scan gives each run the hash of its seed and of all its bytes.  Within
   a chunk the runs whose hashes come again are ordered by deep-shallow suffix
   sorting; of a class of equal bytes all but the smallest document's runs are
   removed there and then.
2. Runs of different chunks meet by the seed's hash.  They are equal if all
   128 bits of both hashes, the lengths and the anchors are; again only the
   smallest document's stays.  Where different runs stay for one seed, their
   strings may still be equal in part: these are asked for.
3. The texts' owners send the bytes of the runs that are asked for.  They
   meet by the 35 bytes around the anchor that each of their strings has in
   common, and their strings are ordered by deep-shallow suffix sorting.  In a
   class of equal strings all but the smallest document's are removed.
4. The removed strings come back to their texts.

Only step 2 trusts hashes; sending all runs' bytes instead would move the text
some five times over.  What meets is bounded by the number of chunks and of
different runs, not of copies: a bucket is reduced as it is read, so however
many chunks have a run, a task holds it once.

Defined results: null and empty texts have no byte; rows that repeat a doc_id
are documents of equal rank, none of which is smaller than the other; a row
without a doc_id is smaller than all others; an empty table has no row; other
columns are not looked at.  Long texts are hashed in segments of a megabyte,
but a chunk has whole texts, so one text and its runs are held by a worker.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import parts as slices
from cairn.llm.common import spread, table, text_bytes, written
from cairn.llm.suffixes import order

LENGTH = 50
SEED = 20
REACH = LENGTH - SEED  # places of a string's anchor after the first
SIDE = REACH // 2  # bytes beside the seed that strings of one half have in common
_WIDTH = LENGTH + REACH  # bytes of a run at most
_HALF = LENGTH + SIDE  # bytes of the strings of a run that start near the anchor, or far from it
#: Bytes that are hashed at once, of texts in a chunk, and for each bucket or shard.
SEGMENT = 1 << 20
CHUNK_BYTES = 8 << 20
SHARE_BYTES = 16 << 20

_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_FIRST = -(1 << 63)  # the doc_id of rows without one


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    h = (h ^ (h >> np.uint64(32))) * _ODD[2]
    return h ^ (h >> np.uint64(31))


def _eight(raw: np.ndarray) -> np.ndarray:
    """The next eight bytes at each place; ``raw`` has eight more bytes."""
    return np.ndarray((len(raw) - 8,), dtype="<u8", buffer=raw.data, strides=(1,))


class _Powers:
    """Powers of an odd number and of its inverse, for hashes of any stretch."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_ODD[4]), -1, 1 << 64))
            self.up, self.down = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, x)))) for x in (_ODD[4], inverse))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    done, now = 1, key
    while 2 * done <= width:
        now = np.minimum(now[:-done], now[done:])
        done *= 2
    return np.minimum(now[: len(now) - (width - done)], now[width - done :]) if width > done else now


def runs(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first string, strings, anchor's distance, seed hash, run hash) of all runs.

    ``raw`` holds texts in a row, of which ``ends`` are the ends.
    """
    n = len(raw)
    none = np.zeros(0, dtype=np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    padded = np.concatenate((raw, np.zeros(8 + LENGTH, dtype=np.uint8)))
    eight = _eight(padded)
    seeds = n - SEED + 1
    h = _mixed(eight[:seeds] * _ODD[0] + eight[8 : 8 + seeds] * _ODD[3] + eight[SEED - 8 : SEED - 8 + seeds] * _ODD[4])
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(seeds, dtype=np.uint64)
    anchor = (_least(key, REACH + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    end_of = np.repeat(ends, np.diff(np.concatenate(([0], ends))))[: len(anchor)]
    anchor[np.arange(len(anchor)) + LENGTH > end_of] = -1
    edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))
    first, after = edge[:-1], edge[1:]
    some = anchor[first] >= 0
    first, after = first[some], after[some]
    up, down = _powers.of(n)
    total = np.concatenate(([np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))
    own = _mixed((total[after - 1 + LENGTH] - total[first]) * down[first])
    at = anchor[first]
    return first, after - first, at - first, h[at], own


def _text_runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """The same for texts, with each run's text before it and places within the text."""
    out, held, size = [], [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            lengths = np.array([len(b) for _, _, b in held])
            ends = np.cumsum(lengths)
            first, *rest = runs(np.frombuffer(b"".join(b for _, _, b in held), dtype=np.uint8), ends)
            piece = np.searchsorted(ends, first, side="right")
            text, base = (np.array([x[i] for x in held], dtype=np.int64) for i in (0, 1))
            out.append((text[piece], first - (ends - lengths)[piece] + base[piece], *rest))
        held, size = [], 0

    for i, text in enumerate(texts):
        for base in range(0, max(1, len(text)), SEGMENT):  # the strings that start in a segment
            part = text[base : base + SEGMENT + LENGTH - 1]
            if size and size + len(part) > SEGMENT + LENGTH:
                flush()
            held.append((i, base, part))
            size += len(part)
    flush()
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 6


# --- tables of arrays as rows ------------------------------------------------------

_ROW = "share int, kind int, data binary"
_TEXT, _GONE, _ASKED, _RUNS = 1, 0, 2, 3


def _packed(*arrays: np.ndarray, text: bytes | None = None) -> bytes:
    """Arrays of one length, byte plane by byte plane, compressed."""
    head, parts = [len(arrays[0]), len(arrays)], []
    for a in arrays:
        head.append(a.dtype.itemsize)
        parts.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes())
    body = np.array(head, dtype="<i8").tobytes() + b"".join(parts)
    return zstandard.ZstdCompressor(1).compress(body + text if text is not None else body)


def _unpacked(data: bytes, *dtypes: str) -> tuple[list[np.ndarray], bytes]:
    body = zstandard.ZstdDecompressor().decompress(data)
    n, columns = np.frombuffer(body, dtype="<i8", count=2).tolist()
    at, out = 16 + 8 * columns, []
    for kind in dtypes:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(body, dtype=np.uint8, count=n * size, offset=at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * size
    return out, body[at:]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["share", "kind", "data"])


def _dealt(share: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays' rows of each share."""
    by = np.argsort(share, kind="stable")
    share = share[by]
    edges = np.flatnonzero(np.concatenate(([True], share[1:] != share[:-1], [True]))) if len(share) else np.zeros(1, dtype=np.int64)
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(share[low]), [a[by[low:high]] for a in arrays]


def _shard(ids: np.ndarray, shares: int) -> np.ndarray:
    return (_mixed(ids.view(np.uint64) * _ODD[0]) % np.uint64(shares)).astype(np.int64)


def _bucket(h: np.ndarray, shares: int) -> np.ndarray:
    return ((h * _ODD[0] >> np.uint64(20)) % np.uint64(shares)).astype(np.int64)


_ID = ("<i8", "<u4")  # doc_id, and the text's crc32 to tell rows of one doc_id apart
_GONE_AS = (*_ID, "<i8", "<i8")  # first string, strings
_ASKED_AS = (*_ID, "<i8", "<u1", "<u1", "<u8")  # first string, strings, anchor's distance, seed
_RUNS_AS = (*_ASKED_AS, "<u8")  # and the run's hash


def _chunked(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(doc_ids, crc32s, texts) of about ``chunk_bytes``."""
    ids, texts, size = [], [], 0
    for batch in slices(batches, 200):
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(_FIRST if key is None else key)
            texts.append(text or b"")
            size += len(texts[-1]) + 64
            if size >= chunk_bytes:
                yield np.array(ids, dtype="<i8"), np.array([zlib.crc32(t) for t in texts], dtype="<u4"), texts
                ids, texts, size = [], [], 0
    if ids:
        yield np.array(ids, dtype="<i8"), np.array([zlib.crc32(t) for t in texts], dtype="<u4"), texts


def _classes(ids: np.ndarray, first: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the classes of rows that agree in all of ``first`` and ``rest``, and the least id of each row's class."""
    by = np.argsort(first, kind="stable")

    def opens(columns: tuple[np.ndarray, ...]) -> np.ndarray:
        new = np.ones(len(by), dtype=bool)
        if len(by):
            new[1:] = np.logical_or.reduce([c[by][1:] != c[by][:-1] for c in columns])
        return new

    new = opens((first, *rest))
    if np.count_nonzero(new) != np.count_nonzero(opens((first,))):  # rows that agree in the first only
        by = np.lexsort((*rest, first))
        new = opens((first, *rest))
    number = np.empty(len(by), dtype=np.int64)
    number[by] = np.cumsum(new) - 1
    least = np.minimum.reduceat(ids[by], np.flatnonzero(new)) if len(by) else ids
    return number, least[number]


#: Runs that are sorted at once.
_SORTED = 100_000


def _again(texts: list[bytes], docs: np.ndarray, which: np.ndarray, first: np.ndarray, count: np.ndarray, back: np.ndarray, seed: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which runs of a chunk go, as a smaller document of it has the same bytes.

    Only runs whose hashes a smaller document has as well can; these and that
    document's are ordered by suffix sorting, which decides by their bytes.
    """
    gone = np.zeros(len(which), dtype=bool)
    number, least = _classes(docs, own, seed, count, back)
    mixed = np.bincount(number, weights=docs > least) > 0 if len(number) else gone
    some = np.flatnonzero(mixed[number])
    if not len(some):
        return gone
    some = some[np.lexsort((docs[some], number[some]))]
    heads = np.maximum.accumulate(np.where(np.diff(number[some], prepend=-1) != 0, np.arange(len(some)), 0))  # a class's smallest document comes first
    lengths = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts) + bytes(_WIDTH), dtype=np.uint8)
    window = np.lib.stride_tricks.sliding_window_view(raw, _WIDTH)
    starts = (np.cumsum(lengths) - lengths)[which] + first
    for low in range(0, len(some), _SORTED):
        part = some[low : low + _SORTED]
        if heads[low] != low:
            part = np.concatenate((some[heads[low] : heads[low] + 1], part))
        grid = np.zeros((len(part), _WIDTH + 2), dtype=np.uint8)
        grid[:, :_WIDTH] = window[starts[part]]
        grid[:, :_WIDTH][np.arange(_WIDTH) >= (count[part] + LENGTH - 1)[:, None]] = 0
        grid[:, _WIDTH], grid[:, _WIDTH + 1] = count[part], back[part]
        by, group = order(grid.tobytes(), np.arange(len(part)) * (_WIDTH + 2), _WIDTH + 2, 24)
        part = part[by]
        smallest = np.minimum.reduceat(docs[part], np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))))
        gone[part] = docs[part] > smallest[group]
    return gone


def _scan(shares: int, chunk_bytes: int):
    """Step 1: runs for the buckets of their seeds; what goes already, for the texts' shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, crcs, texts in _chunked(batches, chunk_bytes):
            which, first, count, back, seed, own = _text_runs(texts)
            docs = ids[which]
            gone = _again(texts, docs, which, first, count, back, seed, own)
            rows = []
            for share, part in _dealt(_shard(docs[gone], shares), docs[gone], crcs[which][gone], first[gone], count[gone]):
                rows.append((share, _GONE, _packed(*(a.astype(k) for a, k in zip(part, _GONE_AS, strict=True)))))
            kept = ~gone
            columns = docs, crcs[which], first, count, back, seed, own
            for share, part in _dealt(_bucket(seed[kept], shares), *(c[kept] for c in columns)):
                rows.append((share, _RUNS, _packed(*(a.astype(k) for a, k in zip(part, _RUNS_AS, strict=True)))))
            yield _batch(rows)

    return run


def _by_share(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _joined(parts: list[bytes], dtypes: tuple[str, ...]) -> list[np.ndarray]:
    if not parts:
        return [np.zeros(0, dtype=k) for k in dtypes]
    return [np.concatenate(c) for c in zip(*(_unpacked(p, *dtypes)[0] for p in parts), strict=True)]


class _Gathered:
    """A task's rows for each share and kind, put together so that there are few of them."""

    def __init__(self, most: int = 16 << 20):
        self.rows: dict[tuple[int, int], list[bytes]] = {}
        self.size, self.most = 0, most

    def add(self, rows: list[tuple[int, int, bytes]]) -> None:
        for share, kind, data in rows:
            self.rows.setdefault((share, kind), []).append(data)
            self.size += len(data)

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.size >= self.most:
            yield from self.all()

    def all(self) -> Iterator[pa.RecordBatch]:
        rows, self.rows, self.size = self.rows, {}, 0
        for (share, kind), parts in rows.items():
            if len(parts) > 1:
                dtypes = _GONE_AS if kind == _GONE else _ASKED_AS
                parts = [_packed(*_joined(parts, dtypes))]
            yield _batch([(share, kind, parts[0])])


#: Runs of a bucket that are read before they are reduced.
_RUNS_HELD = 1 << 20


def _meet(shares: int):
    """Step 2: what goes as a whole, and which runs have to be asked for."""

    def gone_rows(columns: list[np.ndarray], gone: np.ndarray) -> list[tuple[int, int, bytes]]:
        docs, crcs, first, count = (c[gone] for c in columns[:4])
        return [(share, _GONE, _packed(*(a.astype(k) for a, k in zip(part, _GONE_AS, strict=True)))) for share, part in _dealt(_shard(docs, shares), docs, crcs, first, count)]

    def reduced(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[tuple[int, int, bytes]]]:
        """The smallest documents' runs, and what goes of the others."""
        docs, _, _, count, back, seed, own = columns
        _, least = _classes(docs, own, seed, count, back)
        gone = docs > least
        left = [c[~gone] for c in columns]
        return left, gone_rows(columns, gone)

    def asked_rows(columns: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
        """Left are the smallest documents' runs: alone for their seed, or in question."""
        docs, seed = columns[0], columns[5]
        number, low = _classes(docs, seed)
        high = np.full(int(number.max()) + 1 if len(number) else 0, np.iinfo(np.int64).min)
        np.maximum.at(high, number, docs)
        asked = low != high[number]
        parts = _dealt(_shard(docs[asked], shares), *(c[asked] for c in columns[:6]))
        return [(share, _ASKED, _packed(*(a.astype(k) for a, k in zip(part, _ASKED_AS, strict=True)))) for share, part in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket, n, bound, held = None, [], 0, _RUNS_HELD, _Gathered()

        def reduce() -> list[np.ndarray]:
            left, rows = reduced([np.concatenate(c) for c in zip(*bucket, strict=True)])
            held.add(rows)
            return left

        for share, kind, data in _by_share(batches):
            if kind == _GONE:
                held.add([(share, kind, data)])
            else:
                if share != now and bucket:
                    held.add(asked_rows(reduce()))
                    bucket, n, bound = [], 0, _RUNS_HELD
                now = share
                bucket.append(_unpacked(data, *_RUNS_AS)[0])
                n += len(bucket[-1][0])
                if n > bound:
                    bucket = [reduce()]
                    n = len(bucket[0][0])
                    bound = max(_RUNS_HELD, 2 * n)
            yield from held.full()
        if bucket:
            held.add(asked_rows(reduce()))
        yield from held.all()

    return run


def _texts(shares: int, chunk_bytes: int):
    """The texts for their shards, compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, crcs, texts in _chunked(batches, chunk_bytes):
            lengths = np.array([len(t) for t in texts], dtype="<i8")
            for share, (at, *part) in _dealt(_shard(ids, shares), np.arange(len(ids)), ids, crcs, lengths):
                yield _batch([(share, _TEXT, _packed(*part, text=b"".join([texts[i] for i in at.tolist()])))])

    return run


def _each_text(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    (ids, crcs, lengths), text = _unpacked(data, *_ID, "<i8")
    end = 0
    for key, crc, n in zip(ids.tolist(), crcs.tolist(), lengths.tolist(), strict=True):
        start, end = end, end + n
        yield key, crc, text[start:end]


def _rows_of(parts: list[bytes], dtypes: tuple[str, ...]) -> tuple[dict[tuple[int, int], tuple[int, int]], list[np.ndarray]]:
    """Arrays in the order of their documents, and where each document's rows are."""
    columns = _joined(parts, dtypes)
    by = np.lexsort((columns[2], columns[1], columns[0]))
    columns = [c[by] for c in columns]
    ids, crcs = columns[:2]
    edge = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (crcs[1:] != crcs[:-1]), [True]))) if len(ids) else np.zeros(1, dtype=np.int64)
    keys = zip(ids[edge[:-1]].tolist(), crcs[edge[:-1]].tolist(), strict=True)
    return dict(zip(keys, zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True), strict=True)), columns


def _halves(columns: list[np.ndarray], grid: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Runs by their strings that start up to SIDE bytes before the anchor, and by those that start further before it.

    (docs, crcs, string at the first column, first and last column at which a
    string starts), their bytes, and the hash of the 35 bytes that all strings
    of that half have in common.
    """
    docs, crcs, first, count, back, _ = columns
    first, count, back = (c.astype(np.int64) for c in (first, count, back))
    for low, high, common in ((0, SIDE, SIDE), (SIDE + 1, REACH, REACH - SIDE)):
        t_high, t_low = np.minimum(back, high), np.maximum(back - count + 1, low)
        some = np.flatnonzero(t_high >= t_low)
        t_high, t_low = t_high[some], t_low[some]
        raw = np.zeros((len(some), _HALF + 7), dtype=np.uint8)
        wide = grid[some, REACH - high : REACH - high + _HALF]
        raw[:, : wide.shape[1]] = wide
        shared = np.zeros((len(some), 40), dtype=np.uint8)
        shared[:, : SEED + SIDE] = raw[:, common : common + SEED + SIDE]
        key = np.zeros(len(some), dtype=np.uint64)
        for word in shared.view("<u8").T:
            key = _mixed((key ^ word) * _ODD[3])
        # The string at column 0 starts ``high`` bytes before the anchor.
        yield [docs[some], crcs[some], first[some] + back[some] - high, high - t_high, high - t_low, key], raw[:, :_HALF], key


_HALF_AS = (*_ID, "<i8", "<u1", "<u1", "<u8")  # string at the first column, first and last column of strings, key


def _send(shares: int):
    """Step 3, at the texts: the bytes of the runs that are asked for, with their anchors in one column."""

    def out(held: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate([h[i] for h in held]) for i in range(6)]
        rows = []
        for part, raw, key in _halves(columns, np.concatenate([h[6] for h in held])):
            for share, (*own, bytes_of) in _dealt(_bucket(key, shares), *part, raw):
                rows.append((share, _ASKED, _packed(*(a.astype(k) for a, k in zip(own, _HALF_AS, strict=True)), text=bytes_of.tobytes())))
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, where, columns, held, size = None, [], None, [], [], 0
        for share, kind, data in _by_share(batches):
            if share != now:
                now, parts, where = share, [], None
            if kind != _TEXT:
                parts.append(data)
                continue
            if where is None:
                where, columns = _rows_of(parts, _ASKED_AS)
            for key, crc, text in _each_text(data):
                if (span := where.pop((key, crc), None)) is None:  # equal rows are asked once
                    continue
                part = [c[span[0] : span[1]] for c in columns]
                _, _, first, count, back, _ = part
                raw = np.frombuffer(bytes(REACH) + text + bytes(_WIDTH), dtype=np.uint8)
                # Column REACH is the anchor; what lies outside of the run is set to 0.
                at = first + back
                grid = raw[at[:, None] + np.arange(_WIDTH)]
                place = np.arange(_WIDTH)[None, :] - REACH + back[:, None].astype(np.int64)
                grid = np.where((place >= 0) & (place < (count.astype(np.int64) + LENGTH - 1)[:, None]), grid, 0).astype(np.uint8)
                held.append((*part, grid))
                size += len(grid)
            if size > 50_000:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    return run


def _settle_strings(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(doc_id, crc32, string) of strings that a smaller document has as well, for runs of one bucket."""
    grids, columns = [], []
    for p in parts:
        arrays, text = _unpacked(p, *_HALF_AS)
        columns.append(arrays)
        grids.append(np.frombuffer(text, dtype=np.uint8).reshape(-1, _HALF))
    docs, crcs, zero, low, high, key = (np.concatenate(c) for c in zip(*columns, strict=True))
    grid = np.concatenate(grids)
    # Runs that are alone with the bytes that their strings have in common are done.
    number, least = _classes(docs, key)
    most = np.full(int(number.max()) + 1, np.iinfo(np.int64).min)
    np.maximum.at(most, number, docs)
    some = np.flatnonzero(most[number] != least)
    if not len(some):
        return docs[:0], crcs[:0], zero[:0]
    docs, crcs, zero, grid = docs[some], crcs[some], zero[some], grid[some]
    low, high = low[some].astype(np.int64), high[some].astype(np.int64)
    lengths = high - low + 1
    row = np.repeat(np.arange(len(some)), lengths)
    column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths - low, lengths)
    by, group = order(grid.tobytes(), row * _HALF + column, LENGTH)
    row, column = row[by], column[by]
    least = np.minimum.reduceat(docs[row], np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))))
    gone = docs[row] > least[group]
    row, column = row[gone], column[gone]
    return docs[row], crcs[row], zero[row] + column


def _sort(shares: int):
    """Step 3, at the buckets."""

    def rows(parts: list[bytes]) -> list[tuple[int, int, bytes]]:
        docs, crcs, first = _settle_strings(parts)
        return [(share, _GONE, _packed(*(a.astype(k) for a, k in zip((*part, np.ones(len(part[0]))), _GONE_AS, strict=True)))) for share, part in _dealt(_shard(docs, shares), docs, crcs, first)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], _Gathered()
        for share, _, data in _by_share(batches):
            if share != now and parts:
                held.add(rows(parts))
                parts = []
                yield from held.full()
            now = share
            parts.append(data)
        if parts:
            held.add(rows(parts))
        yield from held.all()

    return run


def kept(text: bytes, first: np.ndarray, count: np.ndarray) -> tuple[bytes, int, int]:
    """(the bytes that stay, how many go, in how many runs), for strings that go."""
    if not len(first):
        return text, 0, 0
    change = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, first + count + LENGTH - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    raw = np.frombuffer(text, dtype=np.uint8)
    n_runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + bool(gone[0])
    return raw[np.flatnonzero(~gone)].tobytes(), int(np.count_nonzero(gone)), n_runs


def _finish(with_text: bool):
    """Step 4: each document with what is left of it."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, where, columns = None, [], None, []
        for share, kind, data in _by_share(batches):
            if share != now:
                now, parts, where = share, [], None
            if kind != _TEXT:
                parts.append(data)
                continue
            if where is None:
                where, columns = _rows_of(parts, _GONE_AS)
            rows = []
            for key, crc, text in _each_text(data):
                low, high = where.get((key, crc), (0, 0))
                left, n, n_runs = kept(text, *(c[low:high] for c in columns[2:]))
                rows.append((None if key == _FIRST else key, len(text), n, n_runs, hashlib.sha256(left).hexdigest(), *([left] if with_text else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def remove_repeats(docs: DataFrame, *, with_text: bool = False, chunk_bytes: int = CHUNK_BYTES, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, and the bytes ``kept`` if asked for."""
    spark = docs.sparkSession
    shares = spread(spark, text_bytes(docs), share_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))

    def at_shares(df: DataFrame) -> DataFrame:
        return df.repartition(shares, "share").sortWithinPartitions("share", "kind")

    scanned = rows.mapInArrow(_scan(shares, chunk_bytes), _ROW)
    met = written(at_shares(scanned).mapInArrow(_meet(shares), _ROW), "runs")
    texts = rows.mapInArrow(_texts(shares, chunk_bytes), _ROW)
    # Questions come before the texts, so their kind has to be less.
    asked = met.where(F.col("kind") == _ASKED).withColumn("kind", F.lit(_GONE))
    sent = at_shares(asked.unionByName(texts)).mapInArrow(_send(shares), _ROW)
    strings = written(at_shares(sent).mapInArrow(_sort(shares), _ROW), "strings")
    gone = met.where(F.col("kind") == _GONE).unionByName(strings)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return at_shares(gone.unionByName(texts)).mapInArrow(_finish(with_text), schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, and the digest of what stays."""
    return remove_repeats(table(spark, sf_dir, "documents"))
