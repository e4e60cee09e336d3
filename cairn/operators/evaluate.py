"""How good results are, with and without labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import fixed
from cairn.functions import cells as c
from cairn.functions import url


def label_key(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"(?U)[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


def names_match(a: Column, b: Column) -> Column:
    """Equal, one in the other, or all words of the shorter in the longer."""
    x, y = label_key(a), label_key(b)
    words = lambda s: F.filter(F.array_distinct(F.regexp_extract_all(s, F.lit("[a-z0-9]+"), F.lit(0))), lambda w: F.length(w) > 1)
    some = F.least(F.size(words(x)), F.size(words(y)))
    covered = (some > 0) & (F.size(F.array_intersect(words(x), words(y))) >= some)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x) | covered)


def query_metrics(entities: DataFrame, plans: DataFrame) -> DataFrame:
    """Means over a query's entities; queries without entities have zeros."""
    cells = F.col("cells")
    actionable = F.size(F.filter(cells, lambda x: F.lower(x["col"]).isin(*fixed.EVALUATED_ACTIONABLE)))
    urls = F.array_distinct(F.transform(cells, lambda x: F.coalesce(x["source_url"], F.lit(""))))
    hosts = F.filter(F.transform(cells, lambda x: url.authority(x["source_url"])), lambda h: h != "")
    most = F.array_max(F.transform(hosts, lambda h: F.size(F.filter(hosts, lambda x: x == h))))
    diversity = F.when(F.size(hosts) > 0, 1.0 - most / F.greatest(F.size(cells), F.lit(1))).otherwise(0.0)
    columns = F.greatest(F.size("columns"), F.lit(1))
    rows = plans.select("query_id", "columns").join(entities, "query_id", "left").withColumn("__filled", F.size("cells"))
    mean = lambda x, n, name: F.coalesce(F.bround(F.avg(x), n), F.lit(0.0)).alias(name)
    here = F.col("cells").isNotNull()
    return rows.groupBy("query_id").agg(
        F.count(F.when(here, 1)).alias("rows_returned"),
        mean(F.when(here, F.col("__filled")), 2, "avg_cells_per_row"),
        mean(F.when(here, F.col("__filled") / columns), 3, "fill_rate"),
        mean(F.when(here, F.when(actionable > 0, 1.0).otherwise(0.0)), 3, "actionable_rate"),
        mean(F.when(here, actionable), 2, "avg_actionable_fields"),
        mean(F.when(here, F.when(F.coalesce("canonical_domain", F.lit("")) != "", 1.0).otherwise(0.0)), 3, "official_site_rate"),
        mean(F.when(here, F.when(F.size(urls) > 1, 1.0).otherwise(0.0)), 3, "multi_source_rate"),
        mean(F.when(here, F.col("aggregate_confidence")), 3, "avg_aggregate_confidence"),
        mean(F.when(here, diversity), 3, "avg_source_diversity"),
    )


def matched(entities: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, expected_pos, row_pos): each expected entity takes the first free entity that one of its names matches.

    ``expected`` has query_id, expected_pos and names.  Names are compared in
    a join; the taking, which depends on what was taken, is a query's own.
    """
    names = entities.select("query_id", "row_pos", c.value(F.col("cells"), "name").alias("name")).where("name <> ''")
    said = expected.select("query_id", "expected_pos", F.explode("names").alias("said"))
    pairs = said.join(names, "query_id").where(names_match(F.col("name"), F.col("said"))).select("query_id", "expected_pos", "row_pos").distinct()

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for pos, group in rows.sort_values(["expected_pos", "row_pos"]).groupby("expected_pos"):
            free = next((r for r in group["row_pos"] if r not in used), None)
            if free is not None:
                used.add(free)
                out.append((rows["query_id"].iloc[0], pos, free))
        return pd.DataFrame(out, columns=["query_id", "expected_pos", "row_pos"])

    return pairs.groupBy("query_id").applyInPandas(take, "query_id string, expected_pos long, row_pos long")


def label_metrics(entities: DataFrame, expected: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """Precision, recall, field accuracy and citation rate of each labelled query.

    ``fields`` has query_id, expected_pos, col and accepted (an array; empty
    accepts any value).
    """
    pairs = matched(entities, expected)
    named = entities.where(F.coalesce(c.value(F.col("cells"), "name"), F.lit("")) != "").groupBy("query_id").agg(F.count(F.lit(1)).alias("named"))
    base = expected.groupBy("query_id").agg(F.count(F.lit(1)).alias("expected")).join(named, "query_id", "left").join(pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("matched")), "query_id", "left")
    out = base.select(
        "query_id", "expected", F.coalesce("matched", F.lit(0)).alias("matched"),
        F.bround(F.coalesce("matched", F.lit(0)) / F.greatest(F.coalesce("named", F.lit(0)), F.lit(1)), 3).alias("entity_precision"),
        F.bround(F.coalesce("matched", F.lit(0)) / F.greatest("expected", F.lit(1)), 3).alias("entity_recall"),
    )
    if fields is None:
        return out
    cells = pairs.join(entities.select("query_id", "row_pos", F.explode("cells").alias("cell")), ["query_id", "row_pos"])
    joined = fields.join(cells.select("query_id", "expected_pos", F.col("cell.col").alias("col"), "cell"), ["query_id", "expected_pos", "col"], "left")
    value = F.trim(F.coalesce("cell.value", F.lit("")))
    right = (value != "") & ((F.size("accepted") == 0) | F.exists("accepted", lambda a: names_match(value, a)))
    cited = right & (F.coalesce("cell.source_url", F.lit("")) != "") & (F.coalesce("cell.evidence_snippet", F.lit("")) != "")
    sums = joined.groupBy("query_id").agg(F.count(F.lit(1)).alias("checks"), F.count_if(right).alias("hits"), F.count_if(cited).alias("cited"))
    rated = sums.select("query_id", F.bround(F.col("hits") / F.greatest("checks", F.lit(1)), 3).alias("field_accuracy"), F.when(F.col("hits") > 0, F.bround(F.col("cited") / F.col("hits"), 3)).otherwise(0.0).alias("citation_presence_rate"))
    return out.join(rated, "query_id", "left").na.fill(0.0, ["field_accuracy", "citation_presence_rate"])


def run_summary(metrics: DataFrame, durations: DataFrame) -> DataFrame:
    """Means over all finished queries, and the median duration.

    The metrics have three digits, so their sums are exact as decimals; a mean
    that lies between two results does not depend on the order of the rows.
    """
    joined = metrics.join(durations, "query_id")
    exact = lambda x: F.sum(F.col(x).cast("decimal(20,3)")) / F.count(x)
    means = [F.bround(exact(x), 3).cast("double").alias(x) for x in ("fill_rate", "actionable_rate", "official_site_rate", "multi_source_rate", "avg_aggregate_confidence")]
    return joined.agg(F.count(F.lit(1)).alias("queries"), F.avg("rows_returned").alias("avg_rows"), *means, F.median("duration_seconds").alias("median_duration"))
