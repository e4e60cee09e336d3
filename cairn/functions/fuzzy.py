"""Likeness of names by common subsequences, from 0 to 100."""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn import fixed
from cairn.functions import text


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence; rows of the table are bits of one number."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = mask = (1 << len(a)) - 1
    for c in b:
        both = row & where.get(c, 0)
        row = (row + both | row - both) & mask
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence by the sum of lengths."""
    size = len(a) + len(b)
    return 100.0 * 2 * common_subsequence(a, b) / size if size else 100.0


@lru_cache(maxsize=100_000)
def token_set_ratio(a: str, b: str) -> float:
    """The best likeness of the common words alone and with each side's rest."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both, only_a, only_b = (" ".join(sorted(x)) for x in (left & right, left - right, right - left))
    if both and (not only_a or not only_b):
        return 100.0
    with_a, with_b = (f"{both} {x}".strip() for x in (only_a, only_b))
    best = ratio(with_a, with_b)
    return max(best, ratio(both, with_a), ratio(both, with_b)) if both else best


@lru_cache(maxsize=100_000)
def partial_ratio(a: str, b: str) -> float:
    """The best likeness of the shorter text and a stretch of the longer, up to its length, also at the edges."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n, best = len(short), 0.0
    for start in range(1 - n, len(long)):
        piece = long[max(0, start) : start + n]
        best = max(best, ratio(short, piece))
        if best == 100.0:
            break
    return best


@lru_cache(maxsize=100_000)
def similar_keys(a: str, b: str) -> bool:
    """Whether two name keys are of one entity."""
    return a == b or token_set_ratio(a, b) >= fixed.NAME_RATIO


def close_match(word: str, choices: list[str], cutoff: float) -> str | None:
    found = difflib.get_close_matches(word, choices, n=1, cutoff=cutoff)
    return found[0] if found else None


@F.pandas_udf(T.BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar_keys(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.BooleanType())
def _mentions(body: pd.Series, key: pd.Series, name: pd.Series) -> pd.Series:
    """body: lower case; key: its name key; name: the name's key."""
    return pd.Series(
        [bool(b) and bool(n) and (n in k or partial_ratio(n, b) >= fixed.ALIGNMENT_RATIO) for b, k, n in zip(body, key, name, strict=True)]
    )


def similar_names(a: Column, b: Column) -> Column:
    return _similar(text.name_key(a), text.name_key(b))


def mentions(body: Column, name: Column) -> Column:
    """Whether a text names an entity, exactly or nearly."""
    none = F.lit("")
    return _mentions(F.coalesce(F.lower(body), none), F.coalesce(text.name_key(body), none), F.coalesce(text.name_key(name), none))
