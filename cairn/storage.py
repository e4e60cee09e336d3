"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder, a cluster an error."""
    global _own
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    _own = _own or tempfile.mkdtemp(prefix="cairn-")
    return f"file://{_own}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet and read again: plans stay small, and what is lost is read instead of computed.

    The table is there until ``release`` or the driver's end.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(forget)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM has gone: nothing is left to ask
        return


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` from which nothing will be read any more."""
    for t in tables:
        path = getattr(t, "_cairn_path", None) if t is not None else None
        if path in _written:
            _delete(_written.pop(path), path)


def forget() -> None:
    """Deletes the tables of ``written``; called when the driver ends."""
    while _written:
        path, spark = _written.popitem()
        _delete(spark, path)
