"""Benchmark decontamination with a generalised suffix automaton.

The items' words build one automaton that accepts every word sequence inside
an item.  Training words stream through it; the longest match that ends at a
word says which windows of items end there.  A window is ``window`` words in a
row of an item; an item of fewer words is one window.

Defined results: a null or empty text has no words, no hit and is not
contaminated; an item without words has no window; items with the same text
are all reported; items without an id are hit like others and are together one
item, null and last, which counts in n_items and is not in the digest of ids;
rows that repeat are judged one by one; without benchmark
rows nothing is hit; an empty table has no row.  A document is judged as a whole, however long it is: its
words are held by one worker.  ``find`` replaces columns that are named like
its results; ``decontaminate`` leaves every column as it is.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import ALNUM, annotate, aside, free, release, table, written

WINDOW = 13
#: One word in so many has to be hit for a document to count as contaminated.
COVERAGE = 20
#: Item words in one automaton, which has about 100 bytes for each: what is broadcast
#: and what a worker holds.  A larger benchmark is dealt over several automata, one
#: pass over the documents each.
BLOCK_WORDS = 1_000_000

_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


class SuffixAutomaton:
    """All word sequences inside the items, with the items that own each window.

    Once built, a state's first step is in two arrays and the steps of
    branching states are in one table.
    """

    def __init__(self, items: list[list[bytes]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.longest = array("i", [-1]), array("i", [0])
        coded = []
        for words in items:
            coded.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
            state = 0
            for c in coded[-1]:
                state = self._extend(state, c)
        self.owners: dict[int, set[int]] = {}
        self.short: dict[int, list[int]] = {}  # states at which an item of few words ends
        for n, codes in enumerate(coded):
            state = 0
            for i, c in enumerate(codes):
                state = self.step[state][c]
                while self.longest[self.link[state]] >= window:
                    state = self.link[state]
                if i + 1 >= window:
                    self.owners.setdefault(state, set()).add(n)
            if 0 < len(codes) < window:
                self.short.setdefault(state, []).append(n)
        self.length = [len(c) for c in coded]
        lengths = [min(len(c), window) for c in coded if c]
        self.least = min(lengths, default=0)
        size = len(self.vocabulary)
        pairs = {a * size + b for c in coded for a, b in zip(c, c[1:])}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.first, self.to = array("i", [-1]) * len(self.step), array("i", [0]) * len(self.step)
        self.more: dict[int, int] = {}
        for state, steps in enumerate(self.step):
            for k, (c, to) in enumerate(steps.items()):
                if k:
                    self.more[state * size + c] = to
                else:
                    self.first[state], self.to[state] = c, to
        del self.step

    def _add(self, longest: int, step: dict[int, int], link: int) -> int:
        self.longest.append(longest)
        self.step.append(step)
        self.link.append(link)
        return len(self.longest) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the strings that are not longer than p's and c."""
        copy = self._add(self.longest[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if (q := self.step[last].get(c)) is not None:
            return q if self.longest[q] == self.longest[last] + 1 else self._split(last, c, q)
        new, p = self._add(self.longest[last] + 1, {}, 0), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.longest[q] == self.longest[p] + 1 else self._split(p, c, q)
        return new

    def _stretches(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where a window can lie: words in a row whose neighbours are neighbours in an item."""
        if self.least == 1:
            good, extra = codes >= 0, 0
        else:
            a, b = codes[:-1], codes[1:]
            pair = a * len(self.vocabulary) + b
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            good, extra = (a >= 0) & (b >= 0) & (self.pairs[at] == pair), 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end + extra - start >= self.least:
                yield start, end + extra

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the numbers of the items whose windows occur."""
        hit, items = np.zeros(len(words), dtype=bool), set()
        if not self.least or len(words) < self.least:
            return hit, items
        get, window, size = self.vocabulary.get, self.window, len(self.vocabulary)
        first, to, more, link, longest = self.first, self.to, self.more, self.link, self.longest
        codes = np.array([get(w, -1) for w in words], dtype=np.int64)
        for start, end in self._stretches(codes):
            state = n = 0
            for i, c in enumerate(codes[start:end].tolist(), start):
                while (after := to[state] if first[state] == c else more.get(state * size + c, -1)) < 0 and state:
                    state = link[state]
                    n = longest[state]
                state = max(after, 0)
                n = n + 1 if state else 0
                s = state
                while s and self.longest[self.link[s]] >= window:
                    s = self.link[s]
                if n >= window:
                    items |= self.owners.get(s, set())
                    hit[i + 1 - window : i + 1] = True
                while self.short and s:
                    for item in self.short.get(s, ()):
                        if (m := self.length[item]) <= n:
                            items.add(item)
                            hit[i + 1 - m : i + 1] = True
                    s = self.link[s]
        return hit, items


def _blocks(benchmark: DataFrame, key: str, text: str, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items, read one at a time, in blocks of at most ``block_words`` words (or one item)."""
    block, held = [], 0
    for name, body in benchmark.select(F.col(key).cast("string"), F.col(text).cast("string").cast("binary")).toLocalIterator():
        words = words_of(bytes(body or b""))
        if not words:
            continue
        if block and held + len(words) > block_words:
            yield block
            block, held = [], 0
        block.append((name, words))
        held += len(words)
    yield block


def spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of hit words, as (first word, word after the last)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
    return list(zip(edge[::2], edge[1::2], strict=True))


_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
_FOUND = {
    "n_words": (T.LongType(), pa.int64()),
    "items": (T.ArrayType(T.StringType()), pa.list_(pa.string())),
    "hit_spans": (_SPANS, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
}


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """The documents with n_words, items (item_ids as text, sorted), hit_spans and n_hit.

    ``hit_spans`` are the maximal runs of hit words.  One block of items is
    one narrow pass.  Further blocks are passes of their own, each over a
    written table, so only one automaton is held at a time.
    """
    out, before, names = None, None, docs.columns if keep is None else keep
    had = dict(zip(("items", "hit_spans"), free([*docs.columns, *_FOUND], "__had_items", "__had_spans"), strict=True))
    for block in _blocks(benchmark, "item_id", "text", block_words):
        if out is None:
            out = _pass(docs, block, window, names, {})
        else:  # the first pass again, now with the texts, for the passes that follow
            if "text" not in out.columns:
                return find(docs, benchmark, window=window, block_words=block_words, keep=[*names, "text"]).drop("text")
            last, before = before, written(out, "decontaminate")
            release(last)
            out = _pass(before.withColumnsRenamed(had), block, window, [*names, *had.values()], had).drop(*had.values())
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return out.withColumn("n_hit", hit)


def _pass(docs: DataFrame, block: list[tuple[str | None, list[bytes]]], window: int, keep: list[str], had: dict[str, str]) -> DataFrame:
    """One automaton over all texts; ``had`` names the columns with what the passes before have found."""
    names = [n for n, _ in block]
    shared = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton([w for _, w in block], window))  # of BLOCK_WORDS words, or one item

    def start():
        automaton = shared.value

        def compute(texts: list[bytes], batch: pa.RecordBatch) -> list:
            before = [batch.column(c).to_pylist() for c in had.values()] or [[()] * len(texts)] * 2
            counts, found, runs = [], [], []
            for text, names_had, spans_had in zip(texts, *before, strict=True):
                words = words_of(text)
                hit, which = automaton.match(words)
                for s in spans_had:
                    hit[s["first"] : s["end"]] = True
                counts.append(len(words))
                found.append(sorted({*names_had, *(names[n] for n in which)}, key=lambda x: (x is None, x or "")))
                runs.append([{"first": a, "end": b} for a, b in spans(hit)] if found[-1] else [])
            return [counts, found, runs]

        return compute

    return annotate(docs, start, _FOUND, keep=keep)


def contaminated(share: int = COVERAGE) -> Column:
    """The rule of coverage: at least one word in ``share`` is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, share: int = COVERAGE, longest: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without those that are contaminated, with the columns they came with.

    A document goes when one word in ``share`` or more is hit.  With
    ``longest``, runs of more than that many hit words are also cut out of
    the documents that stay.
    """
    own, restored = aside(docs, *_FOUND, "n_hit")
    found = find(own, benchmark, window=window, block_words=block_words).where(~contaminated(share))
    if longest is None:
        return restored(found)

    def start():
        def compute(texts: list[bytes], batch: pa.RecordBatch) -> list:
            out = []
            for text, runs in zip(texts, batch.column("hit_spans").to_pylist(), strict=True):
                at = [m.span() for m in _WORD.finditer(text.translate(ALNUM))] if runs else []
                for s in reversed(runs):
                    if s["end"] - s["first"] > longest:
                        text = text[: at[s["first"]][0]] + text[at[s["end"] - 1][1] :]
                out.append(text.decode("utf-8", "replace"))
            return [out]

        return compute

    (clean,) = free(found.columns, "__clean")
    cut = annotate(found, start, {clean: (T.StringType(), pa.string())})
    return restored(cut.withColumn("text", F.when(F.size("hit_spans") > 0, F.col(clean)).otherwise(F.col("text"))))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: counts, the sorted item_ids' sha256 and the verdict of every document."""
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
