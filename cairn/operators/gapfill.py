"""Missing cells: what to ask for, where, and which answers to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import fixed
from cairn.functions import cells as c
from cairn.functions import fuzzy


def missing(columns: Column, cells: Column) -> Column:
    return F.array_except(columns, c.columns(cells))


def gap_queries(name: Column, lacking: Column, query: Column) -> Column:
    """At most three searches: the name with the query, with its official website, and with the first columns."""
    hints = F.create_map(*[F.lit(x) for pair in fixed.GAP_HINTS.items() for x in pair])
    said = lambda s: F.trim(F.concat(F.lit('"'), name, F.lit('" '), s))
    asked = F.concat(F.array(said(query), said(F.lit("official website"))), F.transform(lacking, lambda x: said(F.coalesce(F.try_element_at(hints, x), F.translate(x, "_", " ")))))
    return F.slice(F.array_distinct(F.filter(asked, lambda s: s != "")), 1, 3)


def official_urls(cells: Column) -> Column:
    """The entity's own address and its page about itself."""
    site = F.coalesce(c.value(cells, "website"), c.value(cells, "homepage"), c.value(cells, "url"))
    base = F.regexp_replace(site, "/+$", "")
    return F.when(F.coalesce(site, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.slice(F.array_distinct(F.array(site, F.concat(base, F.lit("/about")), F.concat(base, F.lit("/contact")))), 1, 2)
    )


def page_priority(family: Column, regime: Column) -> Column:
    """How early a page of that kind is read for a query of that family."""
    out = F.lit(0)
    for name, weights in fixed.GAP_PRIORITY.items():
        own = F.lit(0)
        for kind, weight in zip(fixed.REGIMES, weights, strict=True):
            own = F.when(regime == kind, weight).otherwise(own)
        out = F.when(family == name, own).otherwise(out)
    return out


def wanted(sparse_rows: DataFrame) -> DataFrame:
    """(query_id, row_pos, name, missing, gap_queries, official_urls) of entities that lack something."""
    name = c.value(F.col("cells"), "name")
    rows = sparse_rows.select("query_id", "row_pos", name.alias("name"), missing(F.col("columns"), F.col("cells")).alias("missing"), "query", "cells")
    return rows.where((F.size("missing") > 0) & F.col("name").isNotNull()).select(
        "query_id", "row_pos", "name", "missing", gap_queries(F.col("name"), F.col("missing"), F.col("query")).alias("gap_queries"), official_urls(F.col("cells")).alias("official_urls")
    )


def filled(entities: DataFrame, asked: DataFrame, drafts: DataFrame) -> DataFrame:
    """Entities with cells of ``drafts`` in columns that they lack.

    ``drafts`` are what the pages for an entity gave: query_id, row_pos, its
    page's regime, regime_confidence and page_pos, draft_seq, entity_name and
    cells.  Pages are read by priority; the first that has a column gives it,
    by the ordered fold over that page's drafts.  Drafts of other names and
    marketplaces' pages are passed over.
    """
    own = asked.select("query_id", "row_pos", "name", "missing")
    here = drafts.where(F.col("regime") != "marketplace_aggregator").join(own, ["query_id", "row_pos"])
    named = here.where(fuzzy.similar_names(F.col("entity_name"), F.col("name")))
    family = entities.select("query_id", "row_pos", "family")
    ranked = named.join(family, ["query_id", "row_pos"]).withColumn("priority", page_priority(F.col("family"), F.col("regime")))
    cells = ranked.select("query_id", "row_pos", "priority", "regime_confidence", "page_pos", "draft_seq", "missing", F.posexplode("cells").alias("pos", "cell"))
    usable = cells.where(F.array_contains("missing", F.col("cell.col")))
    place = F.struct((-F.col("priority")).alias("p"), (-F.col("regime_confidence")).alias("c"), "page_pos")
    first = usable.groupBy("query_id", "row_pos", F.col("cell.col").alias("col")).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "draft_seq", "pos", "cell"))).alias("all"))
    same = F.filter("all", lambda x: x["place"] == F.get(F.col("all"), F.lit(0))["place"])
    chosen = first.withColumn("cell", c.folded(F.transform(same, lambda x: x["cell"]))).withColumn("at", F.get("all", F.lit(0))["place"])
    new = chosen.groupBy("query_id", "row_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "col", "cell"))), lambda x: x["cell"]).alias("__new"))
    joined = entities.join(new, ["query_id", "row_pos"], "left")
    with_new = F.when(F.col("__new").isNull(), F.col("cells")).otherwise(F.concat("cells", "__new"))
    mean = F.when(F.col("__new").isNull(), F.col("aggregate_confidence")).otherwise(F.bround(c.mean_confidence(with_new), 3))
    return joined.withColumn("aggregate_confidence", mean).withColumn("gap_filled", F.col("__new").isNotNull()).withColumn("cells", with_new).drop("__new")
