"""Which page is an entity's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import fixed
from cairn.functions import cells as c
from cairn.functions import pages as kinds
from cairn.functions import text, url, values
from cairn.functions.binding import let


def sanitized(cells: Column, canonical_domain: Column) -> Column:
    """Cells with the website brought to its form, or without it if it is refused."""
    def settled(x: Column) -> Column:
        v = values.website(x["value"], x["source_url"], x["source_title"], canonical_domain)
        return let({"v": v}, lambda b: F.when(b["v"]["ok"], x.withField("value", b["v"]["value"])))

    kept = F.transform(cells, lambda x: F.when(x["col"] == "website", settled(x)).otherwise(x))
    return F.filter(kept, lambda x: x.isNotNull())


def listing(address: Column, title: Column) -> Column:
    return (
        text.any_of(F.lower(url.path(address)), fixed.LISTING_PATHS)
        | text.any_of(F.lower(url.query(address)), fixed.LISTING_PARAMETERS)
        | text.any_of(F.lower(F.coalesce(title, F.lit(""))), fixed.LISTING_TITLES)
    )


def page_score(name: Column, canonical_domain: Column, address: Column, title: Column, body: Column, regime: Column) -> Column:
    """How likely a page is the own page of an entity with that name key, from 0 to 1."""
    key = name
    head = text.name_key(F.substring(F.coalesce(body, F.lit("")), 1, 200))
    named = (F.length(key) >= 2) & (text.name_key(F.coalesce(title, F.lit(""))).contains(key) | head.contains(key))
    hint = F.when(F.coalesce(canonical_domain, F.lit("")) != "", F.concat(F.lit("https://"), canonical_domain, F.lit("/")))
    source = kinds.source(address, title, hint, regime)
    out = ~named | listing(address, title) | regime.isin("directory_listing", "editorial_article", "marketplace_aggregator") | source["kind"].isin("editorial", "marketplace")
    low, path = F.lower(F.coalesce(title, F.lit(""))), F.lower(url.path(address))
    plus = lambda test, n: F.when(test, n).otherwise(0.0)
    hinted = text.any_of(low, fixed.OFFICIAL_HINTS) | text.any_of(path, fixed.OFFICIAL_HINTS)
    shallow = ~F.regexp_replace(path, "^/+|/+$", "").contains("/")
    score = source["quality"] + plus(hinted, 0.15) + plus(path.isin("", "/"), 0.05) + plus(shallow, 0.05)
    return F.when(F.coalesce(out, F.lit(True)), 0.0).otherwise(F.least(score, F.lit(1.0)))


def best_pages(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, row_pos, url, title, score): the first of the best pages of each entity, from the threshold on.

    Entities and pages of a query meet by its id; what has to be compared is
    its few pages with its few entities, and the name test is part of the join.
    """
    named = entities.select("query_id", "row_pos", "canonical_domain", text.name_key(c.value(F.col("cells"), "name")).alias("name")).where("length(name) >= 2")
    here = pages.select("query_id", "page_pos", "url", "title", "cleaned_text", "regime")
    score = page_score(F.col("name"), F.col("canonical_domain"), F.col("url"), F.col("title"), F.col("cleaned_text"), F.col("regime"))
    scored = named.join(here, "query_id").withColumn("score", score).where(F.col("score") >= fixed.OFFICIAL_THRESHOLD)
    first = Window.partitionBy("query_id", "row_pos").orderBy(F.col("score").desc(), "page_pos")
    return scored.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("query_id", "row_pos", "url", "title", "score")


def resolved(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """Entities with their own homepage as website and its domain."""
    clean = entities.withColumn("cells", sanitized(F.col("cells"), F.col("canonical_domain")))
    best = best_pages(clean, pages)
    joined = clean.join(best, ["query_id", "row_pos"], "left")
    home, own = url.homepage(F.col("url")), url.domain(F.col("url"))
    new = F.struct(
        F.lit("website").alias("col"), home.alias("value"), F.col("url").alias("source_url"), F.nullif("title", F.lit("")).alias("source_title"),
        text.truncated(F.coalesce(F.nullif("title", F.lit("")), home), 200).alias("evidence_snippet"), F.bround("score", 3).alias("confidence"), kinds.regime(F.col("url"), F.col("title"))["regime"].alias("source_regime"),
    )
    joined = joined.withColumn("__old", c.cell(F.col("cells"), "website"))
    old = F.col("__old")
    joined = joined.withColumn("__checked", values.website(old["value"], old["source_url"], old["source_title"], own))
    checked = F.col("__checked")
    keeps = old.isNotNull() & checked["ok"] & (url.domain(checked["value"]) == own) & (checked["value"] == home)
    chosen = F.when(keeps, c.better(old.withField("value", checked["value"]), new)).otherwise(new)
    found = F.col("url").isNotNull() & (own != "")
    cells = F.when(found, c.with_cell(F.col("cells"), chosen)).otherwise(F.col("cells"))
    return joined.withColumn("cells", cells).withColumn("canonical_domain", F.when(found, own).otherwise(F.col("canonical_domain"))).drop("url", "title", "score", "__old", "__checked")
