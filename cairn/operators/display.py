"""What a table of entities shows: bands, badges, column order and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import fixed
from cairn.functions import cells as c
from cairn.functions import url
from cairn.functions.binding import let


def confidence_band(confidence: Column) -> Column:
    (high, least_high), (medium, least_medium), (low, _) = fixed.CONFIDENCE_BANDS
    return F.when(confidence >= least_high, high).when(confidence >= least_medium, medium).otherwise(low)


def column_priority(column: Column) -> Column:
    """0 to 3: what gets most space comes first."""
    low, out = F.lower(column), F.lit(2)
    out = F.when(low.contains("description") | low.contains("summary") | low.contains("note"), 3).otherwise(out)
    out = F.when(low.endswith("_url") | low.isin("url", "homepage", "link"), 1).otherwise(out)
    for priority, names in enumerate(fixed.COLUMN_PRIORITY):
        out = F.when(low.isin(*names), priority).otherwise(out)
    return out


def columns_by_priority(columns: Column) -> Column:
    """Columns by priority, in their order where it is equal."""
    keyed = F.transform(columns, lambda x, i: F.struct(column_priority(x).alias("priority"), i.alias("pos"), x.alias("col")))
    return F.transform(F.array_sort(keyed), lambda x: x["col"])


def site_kind(address: Column) -> Column:
    """The kind of a source by its domain alone."""
    site = url.domain(address)
    return (
        F.when(site.isin(*fixed.EDITORIAL_DOMAINS), "editorial")
        .when(site.isin(*fixed.DIRECTORY_DOMAINS), "directory")
        .when(site.isin(*fixed.MARKETPLACE_DOMAINS), "marketplace")
        .otherwise("unknown")
    )


def source_kinds(cells: Column) -> Column:
    """The distinct kinds of an entity's sources, its own site being official; sorted."""
    filled = lambda name: F.nullif(c.value(cells, name), F.lit(""))
    own = url.domain(F.coalesce(filled("website"), filled("url"), filled("homepage"), F.lit("")))
    with_source = F.filter(cells, lambda x: F.coalesce(x["source_url"], F.lit("")) != "")
    return let(
        {"own": own},
        lambda b: F.array_sort(F.array_distinct(F.transform(with_source, lambda x: F.when((b["own"] != "") & (url.domain(x["source_url"]) == b["own"]), "official").otherwise(site_kind(x["source_url"]))))),
    )


def badges(ranked_rows: DataFrame) -> Column:
    """Rank, score, number of sources, band, kinds of sources, and whether all cells come from one domain."""
    cells, kinds = F.col("cells"), source_kinds(F.col("cells"))
    domains = F.array_distinct(F.transform(F.filter(cells, lambda x: F.coalesce(x["source_url"], F.lit("")) != ""), lambda x: url.domain(x["source_url"])))
    said = [
        F.concat(F.lit("#"), F.col("rank_position").cast("string")),
        F.when(F.col("final_score") > 0, F.concat(F.lit("score "), F.format_number("final_score", 2))),
        F.concat(F.col("sources_count").cast("string"), F.lit(" src")),
        F.concat(confidence_band(F.col("aggregate_confidence")), F.lit(" conf")),
        *[F.when(F.array_contains(kinds, k), k) for k in ("official", "editorial", "directory", "marketplace")],
        F.when((F.size(domains) <= 1) & (F.size(cells) > 1), "single-source"),
    ]
    return F.array_compact(F.array(*said))


def requirement_filter(rows: DataFrame, choice: str) -> DataFrame:
    """Entities that meet ``all-req``, ``2plus`` or ``1plus`` requirements; without requirements all are shown."""
    total, met, open_ = F.col("requirements_total"), F.col("requirements_satisfied"), F.col("requirements_unknown")
    tests = {"all-req": (met == total) & (open_ == 0), "2plus": met >= 2, "1plus": met >= 1}
    return rows.where((total == 0) | tests.get(choice, F.lit(True)))


def short_url(address: Column, most: int) -> Column:
    """Host and path, cut with an ellipsis."""
    shown = F.when(url.authority(address) != "", F.concat(url.domain(address), F.when(url.path(address) == "", "/").otherwise(url.path(address)))).otherwise(address)
    return F.when(F.length(shown) > most, F.concat(F.substring(shown, 1, most - 1), F.lit("…"))).otherwise(shown)
