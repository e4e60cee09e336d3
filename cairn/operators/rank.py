"""Entities scored by weighted signals and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import fixed
from cairn.functions import cells as c
from cairn.functions import pages as kinds
from cairn.functions import text
from cairn.functions.binding import let



def source_kinds(cells: Column, regime: bool = False) -> Column:
    """The kind (or regime) of each distinct source of an entity."""
    own = c.own_website(cells)
    if regime:
        return F.transform(c.distinct_sources(cells), lambda s: s["regime"])
    return let({"own": own}, lambda o: F.transform(c.distinct_sources(cells), lambda s: kinds.source(s["url"], s["title"], o["own"], s["regime"])["kind"]))


def source_quality(cells: Column) -> Column:
    """The mean quality of the sources, each cell weighing its confidence, a tenth at least."""
    own = c.own_website(cells)
    weigh = lambda x, o: F.struct(kinds.source(x["source_url"], x["source_title"], o, x["source_regime"])["quality"].alias("q"), F.greatest(x["confidence"], F.lit(0.1)).alias("w"))
    weighed = let({"own": own}, lambda o: F.transform(cells, lambda x: weigh(x, o["own"])))
    sums = F.aggregate(weighed, F.struct(F.lit(0.0).alias("qw"), F.lit(0.0).alias("w")), lambda a, x: F.struct((a["qw"] + x["q"] * x["w"]).alias("qw"), (a["w"] + x["w"]).alias("w")))
    return let({"n": F.size(cells), "s": sums}, lambda b: F.when(b["n"] > 0, F.bround(b["s"]["qw"] / b["s"]["w"], 3)).otherwise(0.0))


def support(sources: Column) -> Column:
    """More with each source, all with ten."""
    return F.least(F.lit(1.0), F.log2(1 + sources) / F.log2(F.lit(11.0)))


def field_importance(cells: Column, columns: Column, family: Column) -> Column:
    """The weights of the filled columns; families without weights count the filled share."""
    named = F.filter(columns, lambda x: x != "name")
    filled = F.size(F.filter(named, lambda n: F.array_contains(c.columns(cells), n)))
    out = F.when(F.size(named) > 0, filled / F.size(named)).otherwise(0.0)
    for name, weights in fixed.FIELD_IMPORTANCE.items():
        total = F.lit(0.0)
        for column, weight in weights.items():
            total = total + F.when(c.has(cells, column), weight).otherwise(0.0)
        out = F.when(family == name, F.bround(total, 3)).otherwise(out)
    return out


def _long_words(s: Column) -> Column:
    return F.filter(text.words(s), lambda w: F.length(w) > 1)


def local_fit(cells: Column, family: Column, query: Column) -> Column:
    """How much of the query's place the entity's place has."""
    phrase = F.lower(F.trim(F.regexp_extract(F.trim(query), "(?i)" + fixed.LOCATION_TAIL, 1)))
    wanted = _long_words(phrase)
    places = F.filter(F.array(*[c.value(cells, n) for n in ("location", "address", "headquarters")]), lambda v: v.isNotNull())
    overlap = F.transform(places, lambda v: F.when((F.size(wanted) > 0) & (F.size(_long_words(v)) > 0), F.size(F.array_intersect(wanted, _long_words(v))) / F.size(wanted)).otherwise(0.0))
    best = F.array_max(overlap)
    fit = F.when(best >= 0.8, 1.0).when(best >= 0.5, 0.8).when(best >= 0.25, 0.55).otherwise(0.2)
    local = family.isin("organization_company", "person_group", "place_venue")
    none = F.when(family == "place_venue", 0.2).otherwise(0.4)
    return F.when(~local | (F.coalesce(phrase, F.lit("")) == ""), 0.5).when(F.size(places) == 0, none).otherwise(fit)


def freshness(cells: Column, query: Column, as_of_year: int) -> Column:
    """How recent the newest year of the sources is, if the query asks for it."""
    year = r"\b(?:19|20)\d{2}\b"
    low = F.lower(F.coalesce(query, F.lit("")))
    wants = low.rlike(year) | text.any_of(low, fixed.FRESHNESS_HINTS)
    said = F.transform(cells, lambda x: F.concat_ws(" ", x["source_url"], x["source_title"]))
    newest = F.array_max(F.flatten(F.transform(said, lambda s: F.transform(F.regexp_extract_all(s, F.lit(year), F.lit(0)), lambda y: y.cast("int")))))
    score = F.when(newest >= as_of_year, 1.0).when(newest == as_of_year - 1, 0.85).when(newest >= as_of_year - 2, 0.7).otherwise(0.45)
    return F.when(wants, score).otherwise(0.5)


def breakdown(as_of_year: int) -> dict[str, Column]:
    """The signals of an entity joined with its plan (columns, family, query) and its requirement counts."""
    cells, family, columns, query = (F.col(x) for x in ("cells", "family", "columns", "query"))
    sources, total = F.col("sources_count"), F.col("requirements_total")
    of, regimes = F.col("__kinds"), F.col("__regimes")
    some = lambda a, x: F.array_contains(a, x)
    actionable = F.exists(cells, lambda x: ~F.lower(x["col"]).isin("name", *fixed.WEAK_COLUMNS))
    reputation = F.when(c.has(cells, "rating", "score"), 1.0).when(sources >= 3, 0.85).when(some(of, "editorial") & (sources >= 2), 0.75).otherwise(0.5)
    software = some(regimes, "software_repo_or_docs")
    owned = some(of, "official") | (F.coalesce(F.col("canonical_domain"), F.lit("")) != "")
    official = (
        F.when(family == "software_project", F.when(software | some(of, "official"), 1.0).otherwise(0.4))
        .when(family.isin("organization_company", "place_venue", "product_offering", "person_group"), F.when(owned, 1.0).when(some(regimes, "official_site"), 0.78).otherwise(0.35))
        .otherwise(0.5)
    )
    listed = some(regimes, "directory_listing")
    structured = (
        F.when(family == "software_project", F.when(software, 1.0).otherwise(0.4))
        .when(family == "place_venue", F.when(some(regimes, "local_business_listing"), 1.0).when(listed, 0.75).otherwise(0.4))
        .when(family.isin("organization_company", "product_offering"), F.when(listed | some(regimes, "editorial_article"), 0.8).otherwise(0.45))
        .otherwise(0.5)
    )
    met = F.when(total > 0, F.bround((F.col("requirements_satisfied") + 0.5 * F.col("requirements_unknown")) / total, 3)).otherwise(1.0)
    return {
        "completeness": F.bround(F.size(cells) / F.greatest(F.size(columns), F.lit(1)), 3),
        "field_importance": F.bround(field_importance(cells, columns, family), 3),
        "avg_confidence": F.bround(c.mean_confidence(cells), 3),
        "source_support": F.bround(support(sources), 3),
        "actionable": F.when(actionable, 1.0).otherwise(0.0),
        "source_quality": source_quality(cells),
        "source_diversity": c.diversity(cells),
        "local_fit": local_fit(cells, family, query),
        "freshness": freshness(cells, query, as_of_year),
        "reputation": reputation,
        "official_fit": official,
        "structured_fit": structured,
        "requirement_satisfaction": met,
    }


def scored(entities: DataFrame, plans: DataFrame, *, as_of_year: int) -> DataFrame:
    """Entities with components (largest first), base_score, penalty and final_score."""
    given = [x for x in ("columns", "family", "query", "entity_type") if x not in entities.columns]
    joined = entities.join(plans.select("query_id", *given), "query_id")
    for name in ("requirements_total", "requirements_satisfied", "requirements_unknown", "hard_failed"):
        if name not in joined.columns:
            joined = joined.withColumn(name, F.lit(0))
    known = joined.withColumn("__kinds", source_kinds(F.col("cells"))).withColumn("__regimes", source_kinds(F.col("cells"), regime=True))
    known = known.withColumn("__signals", F.struct(*[v.cast("double").alias(k) for k, v in breakdown(as_of_year).items()]))
    signals = {k: F.col("__signals")[k] for k, _, _ in fixed.WEIGHTS}
    parts = [
        F.struct(F.bround(F.lit(w) * signals[k], 4).alias("weighted_value"), F.lit(i).alias("pos"), F.lit(k).alias("key"), F.lit(label).alias("label"), signals[k].alias("value"), F.lit(w).alias("weight"))
        for i, (k, label, w) in enumerate(fixed.WEIGHTS)
    ]
    larger = lambda a, b: F.when(a["weighted_value"] > b["weighted_value"], -1).when(a["weighted_value"] < b["weighted_value"], 1).otherwise(a["pos"] - b["pos"])
    out = known.withColumn("components", F.array_sort(F.array(*parts), larger))
    base = F.bround(F.aggregate("components", F.lit(0.0), lambda n, x: n + x["weighted_value"]), 4)
    penalty = F.least(F.col("hard_failed") * 0.1, F.lit(0.3))
    return out.withColumn("base_score", base).withColumn("penalty", F.bround(penalty, 4)).withColumn("final_score", F.bround(F.col("base_score") - F.col("penalty"), 4)).drop("__kinds", "__regimes", "__signals")


def ranked(scored_rows: DataFrame, *before: str) -> DataFrame:
    """rank_position by final score; ties stay in the order of the columns ``before`` and of the rows."""
    order = [F.col("final_score").desc(), *[F.col(x).desc() for x in before], F.col("row_pos")]
    return scored_rows.withColumn("rank_position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def generic_name(cells: Column, entity_type: Column) -> Column:
    name = F.lower(F.trim(c.value(cells, "name")))
    return F.coalesce(name.isin(*fixed.GENERIC_NAMES) | (name == F.lower(F.trim(entity_type))), F.lit(True))


def _others(cells: Column) -> Column:
    return F.filter(cells, lambda x: x["col"] != "name")


def obviously_bad(cells: Column, entity_type: Column, sources: Column, canonical_domain: Column) -> Column:
    """No name; a generic name with nothing to act on; or a name alone from one source."""
    actionable = F.exists(_others(cells), lambda x: ~F.lower(x["col"]).isin("name", *fixed.WEAK_COLUMNS))
    alone = (F.size(_others(cells)) == 0) & (sources < 2) & (F.coalesce(canonical_domain, F.lit("")) == "")
    return ~c.has(cells, "name") | (generic_name(cells, entity_type) & ~actionable) | alone


def viable(cells: Column, entity_type: Column, sources: Column, canonical_domain: Column) -> Column:
    """The positive form: a name with something beside it, or names that several sources give."""
    n = F.size(_others(cells))
    return c.has(cells, "name") & ~(generic_name(cells, entity_type) & (n < 2)) & ((n > 0) | (sources >= 2) | (F.coalesce(canonical_domain, F.lit("")) != ""))


def guarded(rows: DataFrame, keep: Column) -> DataFrame:
    """The rows to keep of each query, or all of a query that would keep none."""
    some = F.max(F.col("__keep")).over(Window.partitionBy("query_id"))
    return rows.withColumn("__keep", F.coalesce(keep, F.lit(False))).withColumn("__some", some).where("__keep or not __some").drop("__keep", "__some")


def pruned(rows: DataFrame) -> DataFrame:
    bad = obviously_bad(F.col("cells"), F.col("entity_type"), F.col("sources_count"), F.col("canonical_domain"))
    return guarded(rows, ~bad)


def sparse(scored_rows: DataFrame, most: int = 3) -> DataFrame:
    """The named entities of each query that lack the most columns, the better scored first."""
    bad = obviously_bad(F.col("cells"), F.col("entity_type"), F.col("sources_count"), F.col("canonical_domain"))
    missing = F.size("columns") - F.size("cells")
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(missing.desc(), F.col("final_score").desc(), "row_pos"))
    return scored_rows.where(~bad).withColumn("missing", missing).withColumn("sparse_pos", turn).where(F.col("sparse_pos") <= most)


