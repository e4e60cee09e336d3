"""What the operators share: input columns, batches of bytes, shared tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.storage import release, written

__all__ = ["ALNUM", "SPACED", "SPACED_CASED", "WORD", "annotate", "aside", "bucket_of", "col", "fold", "forget_kept", "free", "kept", "least_rows", "parts", "release", "spread", "table", "text_bytes", "written"]

#: ASCII letters become lower case, every byte outside 0-9, a-z and the bytes
#: of non-ASCII characters becomes a space.
ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
#: The same for words that end at ASCII white space: space and 0x09 to 0x0D.
SPACED = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
#: White space only, letters as they are.
SPACED_CASED = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))

#: The word of the white-space tokeniser as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of exactly that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores added until no column has them (Spark ignores case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns of these names under free ones, and what gives a result the old names and order back."""
    theirs = {n.lower() for n in names}
    clashing = [c for c in df.columns if c.lower() in theirs]
    hidden = free([*df.columns, *names], *[f"__{c}" for c in clashing])
    back = dict(zip(hidden, clashing, strict=True))
    renamed = [next((h for h, c in back.items() if c == x), x) for x in df.columns]

    def restored(result: DataFrame) -> DataFrame:
        return result.select(*[col(r).alias(c) for r, c in zip(renamed, df.columns, strict=True)])

    return df.select(*[col(c).alias(r) for r, c in zip(renamed, df.columns, strict=True)]), restored


def least_rows(rows: DataFrame, columns: list[str], *keys: str, text: str = "text", more: tuple[Column, ...] = ()) -> DataFrame:
    """``columns`` of one row for each value of ``keys``, which say what the text is: the least by the other columns as JSON.

    An aggregate, so rows that repeat are reduced before they are moved.
    ``more`` are aggregates of the group that go along.
    """
    others = [c for c in columns if c.lower() != text.lower()]
    order = F.struct(col(text).isNull(), F.to_json(F.struct(*[col(c) for c in others])) if others else F.lit(""))
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*[col(c) for c in columns]), order).alias("row"), *more)
    kept = [c for c in one.columns if c not in (*keys, "row")]
    return one.select(*[F.col("row").getField(c).alias(c) for c in columns], *kept)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, so that a batch's texts are not Python objects all at once.

    Spark bounds a batch by spark.sql.execution.arrow.maxBytesPerBatch, or by one row that is longer.
    """
    for batch in batches:
        for start in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(start, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(spark: SparkSession, total_bytes: int, per_task: int) -> int:
    """Tasks so that each gets about ``per_task`` bytes; never under the session's number."""
    return max(shuffle_partitions(spark), -(-total_bytes // per_task))


#: Plan nodes over which the size of the files says how much there is to read.
_SCANS = {"LogicalRelation", "Project", "Filter"}
#: Bytes of text for a byte of a compressed file, about.
_PACKED = 2


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """About how many bytes of text there are: from the files' sizes where ``docs`` is a table, by a sum else."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    node = plan
    while node.nodeName() in _SCANS and node.children().size() == 1:
        node = node.children().apply(0)
    if node.nodeName().startswith("LogicalRelation") or node.nodeName().startswith("Relation"):
        return _PACKED * int(str(node.stats().sizeInBytes()))
    return int(docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0)


def bucket_of(key: Column) -> Column:
    """crc32 of the key as text: what the folds of the contracts are made of."""
    return F.crc32(key.cast("string").cast("binary"))


def fold(key: Column, folds: int, held: int) -> Column:
    """Whether the key is in the fold that is held out; a missing key is not."""
    return F.coalesce(bucket_of(key.cast("long")) % folds == held, F.lit(False))


# --- what a Python worker keeps from task to task ---------------------------------

_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a worker, until a task of another operator begins there."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget_kept() -> None:
    """Gives the memory of what this worker has kept back to the machine: later stages run in the same workers."""
    if not _kept:
        return
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc holds on to freed memory and has a way to say so
        ctypes.CDLL(None).malloc_trim(0)


# --- one Arrow pass over the rows ------------------------------------------------

def annotate(
    df: DataFrame,
    start: Callable[[], Callable[[list[bytes], pa.RecordBatch], list]],
    fields: dict[str, tuple[T.DataType, pa.DataType]],
    *,
    text: str = "text",
    keep: list[str] | None = None,
    rows: int = 500,
) -> DataFrame:
    """``df`` with more columns that are computed from each text, in one narrow pass.

    ``start`` runs once in each task and returns the function that turns the
    texts of ``rows`` rows (null: empty) into one list or array for each field.
    ``keep`` names the columns that go along; columns named like a field are
    replaced.  A text is a whole value of its batch, so one text and its words
    have to fit into a worker; batches are bounded by bytes.  A text that goes
    along is sent once: a batch is in memory several times over, in the
    executor and in the worker.
    """
    new = {n.lower() for n in fields}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    taken = df.select(*[col(c) for c in names])
    along = text in names and isinstance(taken.schema.fields[names.index(text)].dataType, T.StringType)
    schema = T.StructType([*taken.schema.fields, *[T.StructField(n, kind) for n, (kind, _) in fields.items()]])
    kinds = [kind for _, kind in fields.values()]
    at = names.index(text) if along else len(names)
    if not along:
        (hidden,) = free([*df.columns, *fields], "__text")
        taken = df.select(*[col(c) for c in names], col(text).cast("string").cast("binary").alias(hidden))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        compute = start()
        for batch in parts(batches, rows):
            texts = batch.column(at)
            if along:
                texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())  # no copy
            made = compute([t or b"" for t in texts.to_pylist()], batch)
            made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], names=[*names, *fields])

    return taken.mapInArrow(run, schema)
