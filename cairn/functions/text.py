"""Text columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a name drops; \p{} classes are read alike by Java and RE2.
NOT_NAME = r"[^\p{L}\p{N}_\s]"


def name_key(s: Column) -> Column:
    """Lower case, without punctuation, single spaces: what names are compared by."""
    bare = F.regexp_replace(F.lower(s), r"(?U)" + NOT_NAME, "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def any_of(text: Column, hints) -> Column:
    """Whether one of the hints is in the text."""
    found = F.lit(False)
    for h in hints:
        found = found | text.contains(h)
    return F.coalesce(found, F.lit(False))


def words(text: Column) -> Column:
    """The distinct runs of letters and digits in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def truncated(text: Column, n: int = 300) -> Column:
    """At most n characters, back to the last space, with an ellipsis."""
    head = F.substring(text, 1, n)
    back = F.position(F.lit(" "), F.reverse(head))  # 0: there is no space
    at_word = F.when((back > 0) & (back < F.length(head)), F.substring(head, F.lit(1), F.length(head) - back)).otherwise(head)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(at_word, F.lit("…")))


def clean(text: str | None) -> str:
    """Compatibility forms composed, white space single, characters outside the basic plane dropped."""
    composed = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or ""))
    return re.sub(r"[^\x20-\x7E -￿]", " ", composed).strip()


@F.pandas_udf(T.StringType())
def cleaned(text: pd.Series) -> pd.Series:
    """``clean`` as a column; there is no built-in for compatibility forms."""
    return text.map(clean)


def cut(text: str, max_tokens: int = 3500, overlap_tokens: int = 100, max_chunks: int | None = None) -> list[str]:
    """Overlapping windows of four characters a token, each to a sentence's end in its second half if there is one."""
    if len(text) // 4 <= max_tokens:
        return [text]
    width, overlap = 4 * max_tokens, 4 * overlap_tokens
    out, at = [], 0
    while at < len(text) and (max_chunks is None or len(out) < max_chunks):
        stop = min(at + width, len(text))
        if stop < len(text) and (dot := text.rfind(". ", at, stop)) > at + width // 2:
            stop = dot + 1
        out.append(text[at:stop].strip())
        if stop == len(text):
            break
        at = max(stop - overlap, at + 1)
    return [x for x in out if x]


def chunks(text: Column, max_tokens: int = 3000, overlap_tokens: int = 100, max_chunks: int | None = 2) -> Column:
    """``cut`` as a column; where a window ends depends on the one before."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t or "", max_tokens, overlap_tokens, max_chunks))

    return run(text)
