"""Which entities are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import fixed
from cairn.functions import cells as c
from cairn.functions import queries as q
from cairn.functions import text, url, values
from cairn.operators import rank


def call_to_action(name: Column) -> Column:
    """A button's or a timetable's text."""
    s = F.trim(name)
    short = F.size(F.split(s, r"\s+")) <= 6
    return F.coalesce((s != "") & (s.rlike("(?i)" + fixed.CTA_PATTERN) | (short & s.rlike("(?i)" + fixed.OPERATIONAL_PATTERN))), F.lit(False))


def article_title(name: Column) -> Column:
    """A list's heading: it begins with a superlative and has four words or a number."""
    s = F.trim(name)
    long = (F.size(F.split(s, r"\s+")) >= 4) | s.rlike(r"\d")
    return F.coalesce(long & s.rlike("(?i)" + fixed.ARTICLE_TITLE_PATTERN), F.lit(False))


def pseudo_name(name: Column, family: Column) -> Column:
    """A phrase of at least three words with a connector and two words for kinds of entities."""
    key = text.name_key(F.coalesce(name, F.lit("")))
    count = lambda terms: sum((F.when(key.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    own = q.by_family(family, {k: count([t for t in terms if t not in fixed.PSEUDO_TERMS]) for k, terms in fixed.PSEUDO_FAMILY_TERMS.items()}, F.lit(0))
    return (F.size(F.split(key, " ")) >= 3) & text.any_of(key, fixed.PSEUDO_CONNECTORS) & (count(fixed.PSEUDO_TERMS) + own >= 2)


def website_of_others(cells: Column, canonical_domain: Column) -> Column:
    """No valid website, or one that comes from a listing on its own domain."""
    site = c.cell(cells, "website")
    checked = values.website(site["value"], site["source_url"], site["source_title"], canonical_domain)
    same = url.same_domain(checked["value"], site["source_url"])
    path, title = F.lower(url.path(site["source_url"])), F.lower(F.coalesce(site["source_title"], F.lit("")))
    back = same & (text.any_of(path, fixed.PSEUDO_PATHS) | text.any_of(title, fixed.PSEUDO_TITLES))
    return F.when(site.isNull() | ~checked["ok"], True).otherwise(F.coalesce(back, F.lit(False)))


def reject_reason(strict: Column) -> Column:
    """Why an entity is not shown, or null; over entities joined with their plan."""
    cells, domain, sources, family = (F.col(x) for x in ("cells", "canonical_domain", "sources_count", "family"))
    name = F.coalesce(c.value(cells, "name"), F.lit(""))
    actionable = F.size(F.filter(cells, lambda x: ~x["col"].isin(*fixed.UNCOUNTED_COLUMNS)))
    kinds = rank.source_kinds(cells)
    market_only = (F.size(kinds) > 0) & F.forall(kinds, lambda k: k == "marketplace")
    pseudo = (F.coalesce(domain, F.lit("")) == "") & (actionable <= 1) & pseudo_name(name, family) & (website_of_others(cells, domain) | (sources < 3))
    return (
        F.when(rank.obviously_bad(cells, F.col("entity_type"), sources, domain), "not_viable")
        .when(call_to_action(name), "cta_text")
        .when(article_title(name), "article_title")
        .when(pseudo, "pseudo_entity")
        .when(strict & market_only, "marketplace_only")
        .when((rank.source_quality(cells) < 0.2) & (actionable == 0) & (sources < 2), "low_quality_sparse")
    )


def verified(ranked_rows: DataFrame, *, most: int = fixed.MAX_ROWS, most_strict: int = fixed.MAX_STRICT_ROWS) -> DataFrame:
    """The entities of each query without reason against them (all if none is), up to the cap, in their order."""
    strict = q.strict(F.col("query"))
    kept = rank.guarded(ranked_rows, reject_reason(strict).isNull())
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("rank_position"))
    return kept.withColumn("__turn", turn).where(F.col("__turn") <= F.when(strict, most_strict).otherwise(most)).drop("__turn")
