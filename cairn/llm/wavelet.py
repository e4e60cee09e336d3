"""A wavelet matrix: numbers in a compressed file with access, rank and select.

The numbers are stored as bit planes, the highest bit first.  Each plane
orders the numbers by the bits of the planes before it, zeros first, so that
bit, rank and select on the planes answer queries about the numbers.  A file
is a header, the directory, and the planes' blocks of ``BLOCK`` bits, each
compressed on its own.  The directory has for each plane the count of zeros,
the ones before each block, and where the blocks are; so a question about one
number opens one or two blocks of a plane.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"CWM2"
_HEAD = struct.Struct("<4sQB")
#: Bits in a block: the entries of the rank directory are so far apart.
BLOCK = 1 << 15


def build(numbers: np.ndarray, level: int = 1) -> bytes:
    """The file of ``numbers``, which are not negative."""
    now = np.ascontiguousarray(numbers, dtype=np.uint32)
    width = int(now.max()).bit_length() if len(now) else 0
    if width <= 16:
        now = now.astype(np.uint16)
    directory, blocks, pack = [], [], zstandard.ZstdCompressor(level).compress
    for shift in range(width - 1, -1, -1):
        ones = now & now.dtype.type(1 << shift) != 0
        packed = np.packbits(ones)
        step = np.arange(0, len(packed), BLOCK // 8)
        ranks = np.concatenate(([0], np.cumsum(np.add.reduceat(np.bitwise_count(packed).astype(np.int64), step))))
        own = [pack(packed[i : i + BLOCK // 8].tobytes()) for i in step.tolist()]
        zeros = np.flatnonzero(~ones)
        now = now.take(np.concatenate((zeros, np.flatnonzero(ones))))
        directory += [[len(zeros)], ranks, np.array([len(x) for x in own])]
        blocks += own
    table = np.concatenate(directory).astype("<u8").tobytes() if directory else b""
    return b"".join([_HEAD.pack(MAGIC, len(numbers), width), table, *blocks])


class WaveletMatrix:
    """An opened file; blocks are unpacked when they are first asked for."""

    def __init__(self, data: bytes):
        magic, self.size, self.width = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        n = -(-self.size // BLOCK)
        table = np.frombuffer(data[_HEAD.size : _HEAD.size + 8 * self.width * (2 * n + 2)], dtype="<u8").reshape(self.width, 2 * n + 2).astype(np.int64)
        self.zeros, self.ranks = table[:, 0].tolist(), table[:, 1 : n + 2]
        ends = np.cumsum(table[:, n + 2 :].ravel()) + _HEAD.size + table.nbytes
        self._ends = np.concatenate(([_HEAD.size + table.nbytes], ends))
        self._data, self._n, self._unpack = data, n, zstandard.ZstdDecompressor().decompress
        self._open: dict[int, np.ndarray] = {}

    def _block(self, plane: int, b: int) -> np.ndarray:
        k = plane * self._n + b
        if k not in self._open:
            self._open[k] = np.frombuffer(self._unpack(self._data[self._ends[k] : self._ends[k + 1]]), dtype=np.uint8)
        return self._open[k]

    def _plane(self, plane: int) -> np.ndarray:
        """A plane's bits as booleans."""
        packed = np.concatenate([self._block(plane, b) for b in range(self._n)])
        return np.unpackbits(packed, count=self.size).view(bool)

    def _bit(self, plane: int, i: int) -> int:
        inside = i % BLOCK
        return int(self._block(plane, i // BLOCK)[inside >> 3]) >> (7 - (inside & 7)) & 1

    def _rank(self, plane: int, i: int) -> int:
        """Ones before position i of a plane."""
        b, inside = divmod(i, BLOCK)
        n = int(self.ranks[plane, b])
        if inside:
            bits = self._block(plane, b)
            n += int(np.bitwise_count(bits[: inside >> 3]).sum(dtype=np.int64))
            if inside & 7:
                n += (int(bits[inside >> 3]) >> (8 - (inside & 7))).bit_count()
        return n

    def access(self, i: int) -> int:
        """The number at position i."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for p in range(self.width):
            bit, ones = self._bit(p, i), self._rank(p, i)
            value = value << 1 | bit
            i = self.zeros[p] + ones if bit else i - ones
        return value

    def rank(self, value: int, end: int) -> int:
        """How often ``value`` is among the first ``end`` numbers."""
        if value >> self.width:
            return 0
        start, end = 0, min(max(end, 0), self.size)
        for p in range(self.width):
            a, b = self._rank(p, start), self._rank(p, end)
            one = value >> (self.width - 1 - p) & 1
            start, end = (self.zeros[p] + a, self.zeros[p] + b) if one else (start - a, end - b)
        return end - start

    def count(self, value: int) -> int:
        return self.rank(value, self.size)

    def select(self, value: int, k: int) -> int:
        """The position of the k-th ``value``, from 0; -1 if there are fewer."""
        if k < 0 or k >= self.count(value):
            return -1
        start = 0
        for p in range(self.width):
            ones = self._rank(p, start)
            start = self.zeros[p] + ones if value >> (self.width - 1 - p) & 1 else start - ones
        i = start + k
        for p in range(self.width - 1, -1, -1):
            one = value >> (self.width - 1 - p) & 1
            i = self._select_bit(p, one, i - self.zeros[p] if one else i)
        return i

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """The position of the k-th bit of that kind in a plane."""
        before = self.ranks[plane] if bit else np.minimum(np.arange(self._n + 1) * BLOCK, self.size) - self.ranks[plane]
        b = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._block(plane, b), count=min(BLOCK, self.size - b * BLOCK))
        return b * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[b])])

    def _range(self, value: int) -> tuple[int, int]:
        """Where ``value`` is behind the last plane."""
        start, end = (0, 0) if value >> self.width else (0, self.size)
        for p in range(self.width):
            a, b = self._rank(p, start), self._rank(p, end)
            one = value >> (self.width - 1 - p) & 1
            start, end = (self.zeros[p] + a, self.zeros[p] + b) if one else (start - a, end - b)
        return start, end

    def positions(self, value: int) -> np.ndarray:
        """All positions of ``value``, in order."""
        at = np.arange(*self._range(value))
        for p in range(self.width - 1, -1, -1):
            if not len(at):
                break
            one = value >> (self.width - 1 - p) & 1
            at = np.flatnonzero(self._plane(p) == bool(one))[at - self.zeros[p] if one else at]
        return at

    def decode(self) -> np.ndarray:
        """All numbers, in order."""
        now = np.zeros(self.size, dtype=np.uint16 if self.width <= 16 else np.uint32)
        for p in range(self.width - 1, -1, -1):
            ones = self._plane(p)
            now[self.zeros[p] :] |= now.dtype.type(1 << (self.width - 1 - p))
            before = np.empty_like(now)
            before[np.concatenate((np.flatnonzero(~ones), np.flatnonzero(ones)))] = now
            now = before
        return now
