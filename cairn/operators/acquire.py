"""Hits and pages: first of each address, cached pages, rendering budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import html, pages, url

LEAST_TEXT = 200


def first_hits(hits: DataFrame) -> DataFrame:
    """The useful hits, each normal address of a query once: where it came first."""
    first = Window.partitionBy("query_id", "norm_url").orderBy("angle_pos", "hit_pos")
    found = hits.withColumn("norm_url", url.normalized(F.col("url"))).where(url.useful(F.col("norm_url")))
    return found.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def hits_of(answers: DataFrame, per_angle: int = 5) -> DataFrame:
    """Raw search answers (with description and extra_snippets) as hits: the first of each angle, useful ones only."""
    snippet = F.coalesce(F.nullif("description", F.lit("")), F.get("extra_snippets", F.lit(0)))
    kept = answers.where((F.col("hit_pos") < per_angle) & F.col("url").isNotNull() & url.useful(F.col("url")))
    return kept.select("query_id", "angle_pos", "hit_pos", "url", F.coalesce("title", F.lit("")).alias("title"), snippet.alias("snippet"))


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of each key the last row: what an upsert leaves."""
    last = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def from_cache(wanted: DataFrame, cache: DataFrame, now: Column, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(found, missing): addresses whose page was stored less than ``hours`` ago, and the others."""
    fresh = latest(cache, ["url"], "scraped_at").where(F.col("scraped_at") > now - F.expr(f"INTERVAL {hours} HOURS"))
    return wanted.join(fresh, "url"), wanted.join(fresh.select("url"), "url", "left_anti")


def rendering_budget(rows: DataFrame, most: int = 2) -> DataFrame:
    """Which pages that need scripts are rendered: the first ``most`` of each query."""
    turn = F.row_number().over(Window.partitionBy("query_id", "needs_js").orderBy("page_pos"))
    return rows.withColumn("render", F.col("needs_js") & (turn <= most))


def parsed(fetched: DataFrame, *, least: int = LEAST_TEXT) -> DataFrame:
    """Fetched pages (query_id, page_pos, url, title, html) read and classified; those with little text go.

    The markup is parsed once for each page, before anything is joined.
    """
    read = fetched.withColumn("metadata", html.metadata(F.col("html"), F.col("url")))
    title = F.coalesce(F.nullif(F.col("metadata.title"), F.lit("")), F.col("title"), F.lit(""))
    shown = read.withColumn("title", title).withColumn("cleaned_text", F.col("metadata.visible"))
    kept = shown.where(F.length("cleaned_text") >= least)
    kind = pages.regime(F.col("url"), F.col("title"), F.col("cleaned_text"), F.col("metadata"))
    return kept.withColumn("kind", kind).select(
        "query_id", "page_pos", "url", "title", "cleaned_text", F.col("html").alias("raw_html"), "metadata",
        F.col("kind.regime").alias("regime"), F.col("kind.confidence").alias("regime_confidence"),
    )


def counters(rows: DataFrame, *by: str) -> DataFrame:
    """How many rows each stage or regime has."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
