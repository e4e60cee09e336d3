"""Plans of queries: family, type, columns, facets and requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import queries as q


def plans(queries: DataFrame) -> DataFrame:
    """A plan for each query of 2 to 500 characters, all from the text alone."""
    asked = queries.where(F.length(F.trim("query")).between(2, 500)).select("query_id", F.trim("query").alias("query"))
    read = asked.withColumn("normalized_query", q.repaired(F.col("query")))
    kinds = read.withColumn("family", q.family(F.col("normalized_query")))
    based = kinds.withColumns({"entity_type": q.entity_type(F.col("normalized_query"), F.col("family")), "columns": q.template_columns(F.col("family"))})
    faceted = based.withColumn("facets", q.facets(F.col("normalized_query"), F.col("family"), F.col("columns")))
    # The repaired query has lost signs such as >, so it is only read where the original says nothing.
    said = faceted.withColumn("__own", q.requirements(F.col("query"))).withColumn("__repaired", q.requirements(F.col("normalized_query")))
    specs = said.withColumn("requirements", F.when(F.size("__own") > 0, F.col("__own")).otherwise(F.col("__repaired")))
    wide = specs.withColumn("columns", q.augmented(F.col("columns"), F.col("requirements"), F.col("family")))
    bound = wide.withColumn("requirements", q.bound(F.col("requirements"), F.col("columns"), F.col("family")))
    return bound.withColumn("search_angles", F.transform("facets", lambda f: f["query"])).drop("__own", "__repaired")


def discovery(plan: DataFrame) -> DataFrame:
    """The plans with the few columns that candidates are found by."""
    mapped = F.flatten(F.transform("requirements", lambda s: s["mapped_columns"]))
    return plan.withColumn("columns", q.discovery_columns(F.col("columns"), mapped))


def angles(plan: DataFrame) -> DataFrame:
    """A row for each facet, with its place."""
    return plan.select("query_id", F.posexplode("facets").alias("angle_pos", "facet")).select("query_id", "angle_pos", "facet.*")
