"""Results as JSON documents and CSV lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def responses(ranked_rows: DataFrame, plans: DataFrame) -> DataFrame:
    """One row a query: its plan, its entities in order, and counts; a query without entities has none."""
    row = F.struct("rank_position", "entity_id", "cells", "aggregate_confidence", "sources_count", "canonical_domain", "final_score", "components", "matches")
    rows = ranked_rows.groupBy("query_id").agg(F.array_sort(F.collect_list(row), _by_rank).alias("rows"))
    joined = plans.select("query_id", "query", "normalized_query", "family", "entity_type", "columns", "requirements").join(rows, "query_id", "left")
    return joined.withColumn("n_rows", F.greatest(F.coalesce(F.size("rows"), F.lit(0)), F.lit(0)))


def _by_rank(a: Column, b: Column) -> Column:
    return a["rank_position"] - b["rank_position"]


def as_json(response: DataFrame) -> DataFrame:
    """(query_id, document): all of a response, indented; nulls stay."""
    body = F.struct(*[F.col(x) for x in response.columns])
    return response.select("query_id", F.to_json(body, {"ignoreNullFields": "false", "pretty": "true"}).alias("document"))


def _field(value: Column) -> Column:
    """A CSV field: quoted if it has a comma, a quote or a line's end."""
    v = F.coalesce(value, F.lit(""))
    return F.when(v.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def _number(x: Column) -> Column:
    return x.cast("string")


def csv_lines(response: DataFrame) -> DataFrame:
    """(query_id, line_pos, line): the header of a query's own columns, then its entities."""
    cols, has = F.col("columns"), F.size("requirements") > 0
    three = F.flatten(F.transform(cols, lambda x: F.array(x, F.concat(x, F.lit("_source_url")), F.concat(x, F.lit("_confidence")))))
    extra = F.when(has, F.array(*map(F.lit, ("requirements_satisfied_count", "requirements_total_count", "requirements_summary")))).otherwise(F.array().cast("array<string>"))
    header = F.array_join(F.transform(F.concat(F.array(F.lit("entity_id")), three, F.array(F.lit("sources_count"), F.lit("aggregate_confidence")), extra), _field), ",")
    head = response.select("query_id", F.lit(0).alias("line_pos"), header.alias("line"))
    row = F.col("row")

    def three_of(x: Column) -> Column:
        cell = F.get(F.filter(row["cells"], lambda y: y["col"] == x), F.lit(0))
        return F.array(cell["value"], cell["source_url"], _number(F.bround(cell["confidence"], 2)))

    satisfied = F.size(F.filter(row["matches"], lambda m: m["status"] == "satisfied"))
    summary = F.array_join(F.transform(row["matches"], lambda m: F.concat(m["label"], F.lit(":"), m["status"])), "; ")
    said = F.when(has, F.array(satisfied.cast("string"), F.size(row["matches"]).cast("string"), summary)).otherwise(F.array().cast("array<string>"))
    fields = F.concat(F.array(row["entity_id"]), F.flatten(F.transform(cols, three_of)), F.array(_number(row["sources_count"]), _number(row["aggregate_confidence"])), said)
    body = response.select("*", F.posexplode("rows").alias("pos", "row"))
    return head.unionByName(body.select("query_id", (F.col("pos") + 1).alias("line_pos"), F.array_join(F.transform(fields, _field), ",").alias("line")))


class ExportError(LookupError):
    """Why a job has nothing to export: unknown, unfinished, or without result."""

    def __init__(self, kind: str, job_id: str):
        super().__init__(f"{kind}: {job_id}")
        self.kind, self.job_id = kind, job_id


def exported(latest_jobs: DataFrame, job_id: str) -> tuple[str, str]:
    """(file name, document) of a finished job."""
    row = latest_jobs.where(F.col("job_id") == job_id).select("status", "result").first()
    if row is None:
        raise ExportError("unknown", job_id)
    if row["status"] != "done":
        raise ExportError("unfinished", job_id)
    if not row["result"]:
        raise ExportError("empty", job_id)
    return f"search_{job_id[:8]}.json", row["result"]
