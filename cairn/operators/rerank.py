"""Pages by how many of the query's words they have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text

HEAD = 1200


def page_head(title: Column, body: Column) -> Column:
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), 1, HEAD)))


def recall(query: Column, body: Column) -> Column:
    """The share of the query's words that the text has."""
    wanted = text.words(query)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, text.words(body))) / F.size(wanted)).otherwise(0.0)


def top(pages: DataFrame, plans: DataFrame, k: int = 10, score: Column | None = None) -> DataFrame:
    """The k best pages of each query, ties by position; a query with no more than k keeps all, in their order.

    ``score`` replaces the words' recall, for a model that is given as a column.
    """
    own = recall(F.col("query"), page_head(F.col("title"), F.col("cleaned_text"))) if score is None else score
    scored = pages.join(plans.select("query_id", "query"), "query_id").withColumn("rerank_score", own)
    best = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "page_pos")
    return scored.withColumn("rerank_pos", F.row_number().over(best)).where(F.col("rerank_pos") <= max(1, k)).drop("query")
