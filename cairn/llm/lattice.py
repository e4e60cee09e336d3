"""All segmentations of words into the pieces of an existing vocabulary.

A word is its characters after the mark of a word's start.  An arc spans the
characters of a piece; a character that is no piece has an arc of its UTF-8
bytes' pieces.  The forward recursion in log space sums the probability of
all paths; with the backward one it gives the pieces' expected counts.

Words of one length are worked on together: substrings are rolling hashes,
looked up in two small tables of the pieces' hashes.  Words of more than
``LONG`` characters are worked on alone, stretch by stretch, so that a word of
millions of characters takes time and memory in proportion to its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

START = "▁"
#: The share of a piece of rank r before training: as of a word of that rank.
ZIPF = 2.7
#: Cells of a block of words: words times characters.
BLOCK = 1 << 19
#: Characters of a word from which it is worked on alone, and of a stretch of it.
LONG, STRETCH = 64, 1 << 14

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Pieces:
    """Piece texts with scores, and the numbers of the 256 byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(names)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.texts = [names[i] for i in plain]
        scores = np.array([model.get_score(i) for i in plain])
        rank = np.empty(len(plain))
        rank[np.argsort(-scores, kind="stable")] = np.arange(len(plain))
        self.size = len(plain) + 256  # the bytes come after the pieces, the end of a text is last
        prior = np.concatenate((1 / (rank + ZIPF), np.full(256, 1 / (len(plain) + ZIPF)), [1 / ZIPF]))
        self.prior = prior / prior.sum()


def _hash(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes), dtype=np.uint64)
    for j in range(codes.shape[1]):
        h = (h + codes[:, j].astype(np.uint64) + np.uint64(1)) * _STEP
    return h


class Lattice:
    """The pieces, found by hash, and their log-probabilities."""

    def __init__(self, texts: list[str], probabilities: np.ndarray, bits: int = 18):
        self.n = len(texts)
        self.log = np.log(probabilities)
        self.longest = max(map(len, texts), default=1)
        hashes = np.zeros(self.n, dtype=np.uint64)
        for length in {len(t) for t in texts}:
            at = np.array([i for i, t in enumerate(texts) if len(t) == length])
            hashes[at] = _hash(np.array([[ord(c) for c in texts[i]] for i in at]))
        if len(np.unique(hashes)) < self.n:
            raise ValueError("two pieces have the same hash")
        self.shift = np.uint64(64 - bits)
        self.hashes = np.concatenate((hashes, [np.uint64(0)]))  # the last stands for no piece
        self.first, self.second = (np.full(1 << bits, self.n, dtype=np.int32) for _ in range(2))
        slot = (hashes >> self.shift).astype(np.int64)
        _, own = np.unique(slot, return_index=True)
        self.first[slot[own]] = own
        rest = np.setdiff1d(np.arange(self.n), own)
        other = self._other(hashes[rest])
        _, fits = np.unique(other, return_index=True)
        self.second[other[fits]] = rest[fits]
        self.spare = {int(hashes[i]): int(i) for i in np.delete(rest, fits)}  # the few that fit in neither table

    def _other(self, h: np.ndarray) -> np.ndarray:
        return ((h * _MIX) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The pieces with these hashes; ``n`` where there is none."""
        piece = self.first[(h >> self.shift).astype(np.int64)]
        wrong = self.hashes[piece] != h
        if wrong.any():
            again = self.second[self._other(h[wrong])]
            again[self.hashes[again] != h[wrong]] = self.n
            piece[wrong] = again
            if self.spare:
                for i in np.flatnonzero(np.isin(h, np.array(list(self.spare), dtype=np.uint64))).tolist():
                    piece[i] = self.spare[int(h[i])]
        return piece

    def _bytes(self, codes: np.ndarray) -> np.ndarray:
        """Log-probability of characters as byte pieces."""
        kinds, place = np.unique(codes, return_inverse=True)
        return np.array([sum(self.log[self.n + b] for b in chr(c).encode("utf-8", "replace")) for c in kinds.tolist()])[place]

    def _arcs(self, codes: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For each end, the arcs to it by length: (piece or n, log-probability or -inf)."""
        rows, n = codes.shape
        rolling = [np.zeros(rows, dtype=np.uint64) for _ in range(n)]
        arcs = []
        padded = np.concatenate((self.log[: self.n], [-np.inf]))
        for end in range(1, n + 1):
            new, here = codes[:, end - 1].astype(np.uint64) + np.uint64(1), []
            for length in range(1, min(end, self.longest) + 1):
                start = end - length
                rolling[start] = (rolling[start] + new) * _STEP
                piece = self.find(rolling[start])
                weight = padded[piece]
                if length == 1 and (lost := piece == self.n).any():
                    weight[lost] = self._bytes(codes[lost, end - 1])
                here.append((piece, weight))
            arcs.append(here)
        return arcs

    def _forward(self, arcs: list, rows: int) -> list[np.ndarray]:
        alpha = [np.zeros(rows)]
        for end, here in enumerate(arcs, 1):
            alpha.append(_logsum([alpha[end - length] + weight for length, (_, weight) in enumerate(here, 1)]))
        return alpha

    def _from(self, codes: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(piece or n, log-probability or -inf) of the arcs that start at a to b, by length and start."""
        n, padded = len(codes), np.concatenate((self.log[: self.n], [-np.inf]))
        pieces = np.full((self.longest, b - a), self.n, dtype=np.int32)
        weights = np.full((self.longest, b - a), -np.inf)
        rolling = np.zeros(b - a, dtype=np.uint64)
        for k in range(self.longest):
            here = max(0, min(b - a, n - a - k))  # starts from which an arc of k + 1 characters ends in the word
            if not here:
                break
            rolling[:here] = (rolling[:here] + codes[a + k : a + k + here].astype(np.uint64) + np.uint64(1)) * _STEP
            pieces[k, :here] = self.find(rolling[:here])
            weights[k, :here] = padded[pieces[k, :here]]
        if (lost := pieces[0] == self.n).any():
            weights[0, lost] = self._bytes(codes[a:b][lost])
        return pieces, weights

    def _steps(self, codes: np.ndarray, backwards: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[list[tuple[int, float]]]]]:
        """(first start, pieces, weights, arcs as (length, weight) of each start) of a word's stretches."""
        starts = range(0, len(codes), STRETCH)
        for a in reversed(starts) if backwards else starts:
            pieces, weights = self._from(codes, a, min(a + STRETCH, len(codes)))
            arcs: list[list[tuple[int, float]]] = [[] for _ in range(pieces.shape[1])]
            at, length = np.nonzero(np.isfinite(weights.T))
            for s, k, w in zip(at.tolist(), length.tolist(), weights.T[at, length].tolist(), strict=True):
                arcs[s].append((k + 1, w))
            yield a, pieces, weights, arcs

    def _ahead(self, codes: np.ndarray) -> np.ndarray:
        """Natural log of the probability of all ways to each place of one word."""
        n = len(codes)
        alpha, log1p, exp = [-math.inf] * (n + self.longest + 1), math.log1p, math.exp
        alpha[0] = 0.0
        for a, _, _, arcs in self._steps(codes):
            for s, here in enumerate(arcs, a):
                base = alpha[s]
                for length, w in here:
                    x, y = base + w, alpha[s + length]
                    if x < y:
                        x, y = y, x
                    alpha[s + length] = x + log1p(exp(y - x))
        return np.array(alpha[: n + 1])

    def _expect_long(self, codes: np.ndarray, out: np.ndarray) -> None:
        """Adds one word's expected counts."""
        n, alpha = len(codes), self._ahead(codes)
        beta = np.full(n + self.longest + 1, -np.inf)
        beta[n] = 0.0
        for a, pieces, weights, arcs in self._steps(codes, backwards=True):
            size = len(arcs)
            after = beta[a : a + size + self.longest].tolist()
            for s in range(size - 1, -1, -1):
                ways = [w + after[s + length] for length, w in arcs[s]]
                top = max(ways)
                after[s] = top + math.log(sum(math.exp(x - top) for x in ways))
            beta[a : a + size] = after[:size]
            for k in range(self.longest):
                share = np.exp(np.minimum(0.0, alpha[a : a + size] + weights[k] + beta[a + k + 1 : a + k + 1 + size] - alpha[n]))
                found = pieces[k] < self.n
                out += np.bincount(pieces[k][found], weights=share[found], minlength=len(out))
                if not k and not found.all():
                    self._spell(codes[a : a + size][~found], share[~found], out)

    def _spell(self, codes: np.ndarray, share: np.ndarray, out: np.ndarray) -> None:
        for c, s in zip(codes.tolist(), share.tolist(), strict=True):
            for b in chr(c).encode("utf-8", "replace"):
                out[self.n + b] += s

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log of the probability of all segmentations of each word."""
        out = np.zeros(len(words))
        for at, codes in blocks(words):
            if codes.shape[1] > LONG:
                out[at] = [self._ahead(c)[-1] for c in codes]
            else:
                out[at] = self._forward(self._arcs(codes), len(at))[-1]
        return out

    def expect(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces and bytes, words weighing their counts."""
        out = np.zeros(self.n + 257)
        for at, codes in blocks(words):
            if codes.shape[1] > LONG:
                for i, c in zip(at.tolist(), codes, strict=True):
                    own = np.zeros(len(out))
                    self._expect_long(c, own)
                    out += counts[i] * own
                continue
            arcs, n = self._arcs(codes), codes.shape[1]
            alpha = self._forward(arcs, len(at))
            beta: list[list[np.ndarray]] = [[] for _ in range(n)]
            after = np.zeros(len(at))
            for end in range(n, 0, -1):
                if end < n:
                    after = _logsum(beta[end])
                for length, (piece, weight) in enumerate(arcs[end - 1], 1):
                    beta[end - length].append(weight + after)
                    share = counts[at] * np.exp(alpha[end - length] + weight + after - alpha[n])
                    found = piece < self.n
                    out += np.bincount(piece[found], weights=share[found], minlength=len(out))
                    if length == 1 and not found.all():
                        self._spell(codes[~found, end - 1], share[~found], out)
        return out


def _logsum(parts: list[np.ndarray]) -> np.ndarray:
    if len(parts) == 1:
        return parts[0]
    stacked = np.stack(parts)
    top = stacked.max(axis=0)
    return top + np.log(np.exp(stacked - top).sum(axis=0))


def blocks(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points with the start mark) of words of one length, in bounded blocks."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    for length in np.unique(lengths).tolist():
        same = np.flatnonzero(lengths == length)
        step = max(1, BLOCK // (length + 1))
        for k in range(0, len(same), step):
            at = same[k : k + step]
            joined = START + START.join([words[i] for i in at.tolist()])
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(at), length + 1)
            yield at, codes
