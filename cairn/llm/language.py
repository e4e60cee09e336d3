"""Language identification by fusing evidence with Bayes' rule.

For each language the log-likelihood of a page's text (byte trigrams) is
added to those of the declared markup language and of the host.  The text
model is fitted on a sample of documents of known language, of which each
language has its part, so none is left out however rare.  What a
declaration is worth, and which languages a host writes, are sums over all
pages of the text's posteriors: how often each language is declared as each,
and counts for each host, smoothed by its parent domain, that by its own, up
to the address suffix and all pages.  A page's own share is taken out of its
host's counts.

Defined results: a page without text, declaration and host gets the most
frequent language, of equals the first by code; of equal posteriors the first
language by code is given; without documents of known language there is no language
and the result is null; documents whose ``lang`` is no code of two or three
letters (with or without a region) are of no known language; null pages and
addresses are empty; rows that repeat are judged one by one; an empty table
has no row; only the named columns are looked at, and the result has no others.
A page is parsed as a whole, with eight bytes for each of its trigrams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.binding import let
from cairn.llm.common import annotate, parts, shuffle_partitions, table, written

#: Documents that the text model is fitted on, about, and of each language at least;
#: they are sampled by a hash of doc_id.
SAMPLE, LEAST = 20_000, 50
#: Trigram buckets; fewer where the languages would need more than CELLS of them in all.
BUCKETS, CELLS = 1 << 16, 1 << 25
#: Neighbouring trigrams overlap and languages share words, so a text's trigrams count as fewer:
#: as a quarter of them, from where five times their root is less, as that.
OVERLAP, ROOT = 4.0, 5.0
#: Pages that the level above counts as.
WEIGHT = 4.0
#: Labels of a host that have a level of their own, from the suffix on.
LEVELS = 3

_HIDDEN = (b"script", b"style", b"nav", b"header", b"footer", b"aside", b"noscript", b"template")
_OPEN = re.compile(rb"<!--|<(?:" + b"|".join(_HIDDEN) + rb")(?=[\s>/])", re.I)
_TAG = re.compile(rb"<[^<>]*>?")
_ENTITY = re.compile(rb"&#?\w{1,32};")
_DECLARED = re.compile(rb"<html\b[^<>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)
_META = re.compile(rb"<meta\b[^<>]*?content-language[^<>]*?content\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)


def visible(html: bytes) -> bytes:
    """The text of a page without hidden parts, tags and entities, in one pass."""
    lower, parts, at = html.lower(), [], 0
    ends: dict[bytes, int] = {}  # where the next end of each kind is, so an end is searched for once
    while (m := _OPEN.search(html, at)) is not None:
        parts.append(html[at : m.start()])
        name = m.group()[1:].lower()
        close = b"-->" if name == b"!--" else b"</" + name
        if (end := ends.get(close, -2)) != -1 and end < m.end():
            end = ends[close] = lower.find(close, m.end())
        if end < 0:
            at = len(html) if name in (b"script", b"style", b"!--") else m.end()
        else:
            at = html.find(b">", end) + 1 or len(html)
    parts.append(html[at:])
    return _ENTITY.sub(b" ", _TAG.sub(b" ", b" ".join(parts)))


def declared(html: bytes) -> str | None:
    m = _DECLARED.search(html) or _META.search(html)
    return m.group(1).decode().lower() if m else None


def host_of(url: str) -> str:
    try:
        return (urlsplit(url.strip()).hostname or "").strip(".")
    except ValueError:
        return ""


_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def trigrams(text: bytes) -> np.ndarray:
    """The 16-bit hashes of the byte trigrams of the words, with their edges."""
    words = b" " + b" ".join(text.translate(_LETTERS).split()) + b" "
    raw = np.frombuffer(words, dtype=np.uint8).astype(np.uint32)
    return (raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA77) ^ raw[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)


class TextModel:
    """Log-probabilities of trigrams for each language."""

    def __init__(self, names: list[str], counts: np.ndarray, rows: np.ndarray):
        """``counts`` of the trigrams of the sampled documents, ``rows`` of all documents, by language."""
        self.names = names
        self.share = rows / max(1.0, rows.sum())
        self.shift = np.uint32((BUCKETS // max(1, counts.shape[1])).bit_length() - 1)
        smoothed = counts + 0.5
        self.log = np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).astype(np.float32)

    def likelihoods(self, text: bytes) -> np.ndarray:
        """Log-likelihoods of the languages, as much as the text is worth."""
        found = trigrams(text)
        if not len(found):
            return np.zeros(len(self.names))
        sums = self.log[:, found >> self.shift].sum(axis=1, dtype=np.float64)
        return (sums - sums.max()) * min(1 / OVERLAP, ROOT / len(found) ** 0.5)


def code_of(lang: Column) -> Column:
    """The two or three letters of a language code in lower case; null for what is none.  So there are at most 18,252."""
    return F.nullif(F.lower(F.regexp_extract(lang.cast("string"), r"^\s*([A-Za-z]{2,3})(?:[-_][\w-]*)?\s*$", 1)), F.lit(""))


_PART = pa.schema([("lang", pa.int32()), ("places", pa.binary()), ("sums", pa.binary())])


def train(docs: DataFrame, *, sample: int = SAMPLE, least: int = LEAST) -> TextModel:
    """The text model of documents (doc_id, text, lang)."""
    spark = docs.sparkSession
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text"), code_of(F.col("lang")).alias("code")).where("code is not null")
    tally = sorted(tuple(r) for r in labelled.groupBy("code").count().collect())
    names, rows = [t[0] for t in tally], np.array([float(t[1]) for t in tally])
    size = BUCKETS
    while size > 1 and len(names) * size > CELLS:
        size //= 2
    counts = np.zeros((len(names), size))
    if not names:
        return TextModel(names, counts, rows)
    rate = np.minimum(1_000_000, 1_000_000 * np.maximum(sample / rows.sum(), least / rows)).astype(int)
    rates = spark.createDataFrame([(n, i, int(r)) for i, (n, r) in enumerate(zip(names, rate, strict=True))], "code string, place int, rate int")
    part = labelled.join(F.broadcast(rates), "code").where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1_000_000)) < F.col("rate"))
    shift = np.uint32((BUCKETS // size).bit_length() - 1)

    def sparse(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        found = [(lang, np.flatnonzero(x)) for lang, x in sums.items()]
        columns = [lang for lang, _ in found], [at.astype("<u4").tobytes() for _, at in found], [sums[lang][at].tobytes() for lang, at in found]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PART, strict=True)], schema=_PART)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in parts(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    if len(sums) >= 64:
                        yield sparse(sums)
                        sums = {}
                    sums[lang] = np.zeros(size, dtype=np.int64)
                sums[lang] += np.bincount(trigrams(text or b"") >> shift, minlength=size)
        yield sparse(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of each language; the rows come in the order of languages."""
        now, total = None, np.zeros(size, dtype=np.int64)
        for batch in batches:
            for lang, at, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lang != now and now is not None:
                    yield sparse({now: total})
                    total = np.zeros(size, dtype=np.int64)
                now = lang
                total[np.frombuffer(at, dtype="<u4")] += np.frombuffer(x, dtype=np.int64)
        if now is not None:
            yield sparse({now: total})

    schema = "lang int, places binary, sums binary"
    counted = part.select("place", F.col("text").cast("binary").alias("text")).mapInArrow(count, schema)
    tasks = min(len(names), shuffle_partitions(spark))
    for lang, at, x in counted.repartition(tasks, "lang").sortWithinPartitions("lang").mapInArrow(add, schema).collect():  # one row a language
        counts[lang, np.frombuffer(bytes(at), dtype="<u4")] = np.frombuffer(bytes(x), dtype=np.int64)
    return TextModel(names, counts, rows)


def _softmax(logs: Column) -> Column:
    above = lambda s: F.transform(s["logs"], lambda x: F.exp(x - s["top"]))
    shares = lambda s: F.transform(s["parts"], lambda x: x / s["total"])
    topped = lambda s: let({"logs": s["logs"], "top": F.array_max(s["logs"])}, above)
    summed = lambda s: let({"parts": s["parts"], "total": _total(s["parts"])}, shares)
    return let({"parts": let({"logs": logs}, topped)}, summed)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _sums(n: int, name: str) -> Column:
    """The sum of an array column, place by place."""
    return F.array(*[F.coalesce(F.sum(F.col(name)[i]), F.lit(0.0)) for i in range(n)])


def _smoothed(own: Column, above: Column) -> Column:
    """Shares of counts, with the level above as ``WEIGHT`` more pages."""
    shares = lambda s: F.zip_with(s["own"], s["above"], lambda n, p: (n + p * WEIGHT) / s["total"])
    return let({"own": own, "above": above}, lambda s: let({"own": s["own"], "above": s["above"], "total": _total(s["own"]) + WEIGHT}, shares))


def host_priors(evidence: DataFrame, n: int) -> DataFrame:
    """(host, counts, above) of each host: its pages' posteriors summed, and its parent's smoothed shares.

    The levels are sums of sums of hosts, so a frequent host or suffix is
    reduced before it is moved.
    """
    hosts = written(evidence.groupBy("host").agg(_sums(n, "belief").alias("counts")), "hosts")
    whole = hosts.agg(_sums(n, "counts")).first()[0]
    size = sum(whole) + n
    above = F.array(*[F.lit((x + 1) / size) for x in whole])
    placed = hosts.withColumn("above", above)
    for level in range(1, LEVELS + 1):  # suffix, domain, and one label more
        placed = placed.withColumn("zone", F.substring_index("host", ".", -level))
        sums = written(placed.groupBy("zone").agg(_sums(n, "counts").alias("zone_counts")), "zones")
        placed = placed.join(sums, "zone").withColumn("above", _smoothed(F.col("zone_counts"), F.col("above"))).select("host", "counts", "above")
    return written(placed, "priors")


def declaration_weights(evidence: DataFrame, n: int) -> DataFrame:
    """(declared, says): log-probability of a declaration for each language; a missing one is one of them."""
    sums = evidence.groupBy("declared").agg(_sums(n, "belief").alias("counts"))
    rows = {r[0]: np.array(r[1]) for r in sums.collect()}  # two or three letters: at most 18,278 rows
    if not rows:
        return evidence.sparkSession.createDataFrame([], "declared string, says array<double>")
    by_language = sum(rows.values())
    share = {d: (c.sum() + 1) / (by_language.sum() + len(rows)) for d, c in rows.items()}
    table_rows = [(d, np.log((c + share[d]) / (by_language + 1)).tolist()) for d, c in rows.items()]
    return evidence.sparkSession.createDataFrame(table_rows, "declared string, says array<double>")


def identify(pages: DataFrame, model: TextModel, *, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """key, lang, confidence, text_lang, declared, host of every page."""
    n = len(model.names)
    if not n:
        empty = F.lit(None).cast("string")
        return pages.select(F.col(key), empty.alias("lang"), F.lit(0.0).alias("confidence"), empty.alias("text_lang"), empty.alias("declared"), empty.alias("host"))

    shared = pages.sparkSession.sparkContext.broadcast(model)  # at most CELLS numbers

    def start():
        model = shared.value

        def compute(texts: list[bytes], batch: pa.RecordBatch) -> list:
            hosts = [host_of(u or "") for u in batch.column("__url").to_pylist()]
            return [[declared(t) or "" for t in texts], hosts, [model.likelihoods(visible(t)).tolist() for t in texts]]

        return compute

    doubles = T.ArrayType(T.DoubleType()), pa.list_(pa.float64())
    fields = {"declared": (T.StringType(), pa.string()), "host": (T.StringType(), pa.string()), "text_logs": doubles}
    rows = pages.select(F.col(key), F.col(url).cast("string").alias("__url"), F.col(html).alias("__html"))
    read = annotate(rows, start, fields, text="__html", keep=[key, "__url"]).drop("__url")
    prior = F.array(*[F.lit(float(np.log(max(x, 1e-9)))) for x in model.share])
    belief = _softmax(F.zip_with("text_logs", prior, lambda a, b: a + b))
    evidence = written(read.withColumn("belief", belief), "evidence")

    says = F.broadcast(declaration_weights(evidence, n))  # at most 18,278 rows, as declarations are two or three letters
    fused = evidence.join(says, "declared").join(host_priors(evidence, n), "host")
    others = F.zip_with("counts", "belief", lambda c, b: F.greatest(c - b, F.lit(0.0)))
    logs = F.zip_with(F.zip_with("text_logs", "says", lambda a, b: a + b), _smoothed(others, F.col("above")), lambda a, p: a + F.log(p))
    names = F.array(*[F.lit(x) for x in model.names])
    first = lambda c: names[F.array_position(c, F.array_max(c)).cast("int") - 1]
    out = fused.withColumn("posterior", _softmax(logs))
    return out.select(
        F.col(key), first(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"),
        first(F.col("text_logs")).alias("text_lang"), F.nullif(F.col("declared"), F.lit("")).alias("declared"), F.nullif(F.col("host"), F.lit("")).alias("host"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, with the evidence's own answers beside it."""
    return identify(table(spark, sf_dir, "pages"), train(table(spark, sf_dir, "documents")))
