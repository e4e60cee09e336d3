"""Job states from a stream of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def states(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each job's last status and phase, updated as events come; events later than ``late`` are passed over."""
    at = F.struct("ts", "seq")
    return events.withWatermark("ts", late).groupBy("job_id").agg(F.max_by("status", at).alias("status"), F.max_by("phase", at).alias("phase"), F.max("ts").alias("ts"))


def throughput(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each status in each window; a window is final once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("at"), "status").agg(F.count(F.lit(1)).alias("n")).select("at.start", "at.end", "status", "n")


def drained(stream: DataFrame, what: str) -> DataFrame:
    """All that a stream has now, as the table that its last batch wrote to the shared folder."""
    from cairn.storage import shared_folder

    at = f"{shared_folder(stream.sparkSession)}/{what}-{uuid.uuid4().hex}"
    write = lambda rows, _: rows.write.mode("overwrite").parquet(f"{at}/rows")
    run = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")
