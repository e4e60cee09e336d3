"""Jobs as a log of events; a job's state is its last one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("pending", "running", "done", "failed")


def state(events: DataFrame) -> DataFrame:
    """Each job's last event, with its query, result and error from whenever they were given."""
    at = F.struct("ts", "seq")
    last = lambda name: F.max_by(name, F.when(F.col(name).isNotNull(), at)).alias(name)
    return events.groupBy("job_id").agg(
        F.max_by("status", at).alias("status"), F.max_by("phase", at).alias("phase"), last("query"), last("result"), last("error"),
        F.min("ts").alias("created_at"), F.max(F.when(F.col("status").isin("done", "failed"), F.col("ts"))).alias("completed_at"),
    )


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart what was under way has failed."""
    lost = F.col("status").isin("pending", "running")
    return jobs.withColumn("error", F.when(lost, "interrupted").otherwise(F.col("error"))).withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))


def widened(*versions: DataFrame) -> DataFrame:
    """Tables of earlier forms as one; columns that one lacks are null."""
    out = versions[0]
    for v in versions[1:]:
        out = out.unionByName(v, allowMissingColumns=True)
    return out
