"""Expressions over an entity's array of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn import fixed
from cairn.functions import url


def cell(cells: Column, name: str) -> Column:
    """The cell of a column, or null."""
    return F.get(F.filter(cells, lambda c: c["col"] == name), F.lit(0))


def value(cells: Column, name: str) -> Column:
    return cell(cells, name)["value"]


def columns(cells: Column) -> Column:
    return F.transform(cells, lambda c: c["col"])


def has(cells: Column, *names: str) -> Column:
    return F.exists(cells, lambda c: c["col"].isin(*names))


def own_website(cells: Column, names=fixed.WEBSITE_COLUMNS) -> Column:
    """The first filled column that holds an entity's own address."""
    return F.coalesce(*[F.nullif(value(cells, n), F.lit("")) for n in names])


def better(kept: Column, new: Column) -> Column:
    """The cell with clearly more confidence, or of two alike the one with the longer snippet; the kept one else."""
    size = lambda c: F.coalesce(F.length(c["evidence_snippet"]), F.lit(0))
    clearly = new["confidence"] > kept["confidence"] + 0.05
    alike = (new["confidence"] >= kept["confidence"] - 0.05) & (size(new) > size(kept))
    return F.when(clearly | alike, new).otherwise(kept)


def folded(cells_in_order: Column) -> Column:
    """One cell of several by ``better``, in order; the fold is neither associative nor commutative."""
    first = F.get(cells_in_order, F.lit(0))
    return F.aggregate(F.slice(cells_in_order, F.lit(2), F.greatest(F.size(cells_in_order), F.lit(1))), first, better)


def mean_confidence(cells: Column) -> Column:
    total = F.aggregate(cells, F.lit(0.0), lambda n, c: n + c["confidence"])
    return F.when(F.size(cells) > 0, total / F.size(cells)).otherwise(0.0)


def with_cell(cells: Column, new: Column) -> Column:
    """The cells with one put in the place of its column's, or at the end."""
    here = F.exists(cells, lambda c: c["col"] == new["col"])
    return F.when(here, F.transform(cells, lambda c: F.when(c["col"] == new["col"], new).otherwise(c))).otherwise(F.concat(cells, F.array(new)))


def in_order(cells: Column, plan_columns: Column) -> Column:
    """Cells by the plan's columns; others follow as they came."""
    planned = F.filter(F.transform(plan_columns, lambda p: F.get(F.filter(cells, lambda c: c["col"] == p), F.lit(0))), lambda c: c.isNotNull())
    return F.concat(planned, F.filter(cells, lambda c: ~F.array_contains(plan_columns, c["col"])))


def distinct_sources(cells: Column) -> Column:
    """(url, title) of each source once, with the title of its first cell."""
    urls = F.transform(cells, lambda c: F.coalesce(c["source_url"], F.lit("")))
    firsts = F.filter(cells, lambda c, i: F.array_position(urls, F.coalesce(c["source_url"], F.lit(""))) == i + 1)
    return F.transform(firsts, lambda c: F.struct(c["source_url"].alias("url"), c["source_title"].alias("title"), c["source_regime"].alias("regime")))


def diversity(cells: Column) -> Column:
    """One less the largest share that a domain has of the cells."""
    domains = F.transform(cells, lambda c: F.coalesce(F.nullif(url.domain(c["source_url"]), F.lit("")), F.lit("__unknown__")))
    most = F.array_max(F.transform(domains, lambda d: F.size(F.filter(domains, lambda x: x == d))))
    return F.when(F.size(cells) > 0, F.bround(1.0 - most / F.size(cells), 3)).otherwise(0.0)
