"""Drafts of one entity put together."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import fixed, schemas
from cairn.functions import cells as c
from cairn.functions import fuzzy, text, url

#: The order in which columns are asked for a draft's own address.
ADDRESSED = tuple(x for x in fixed.WEBSITE_COLUMNS if x != "link")


def slug(name: Column) -> Column:
    """An id from a name; a name without letters and digits gets one from its hash."""
    s = F.regexp_replace(F.regexp_replace(text.name_key(name), r"\s+", "-"), r"[^a-z0-9\-]", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.substring(F.sha2(F.coalesce(name, F.lit("")), 256), 1, 8))


def clusters(drafts: DataFrame) -> DataFrame:
    """(query_id, draft_seq, cluster): the drafts of each entity, by the first draft of it.

    A draft joins the first cluster that has its domain or a similar name;
    the cluster's name and address are then those of its merged cells.  As
    each step depends on all before it, a query's drafts are one task's: Spark
    sorts them, and Python holds a batch of them and the clusters of a block of
    queries.  Use ``exact_clusters`` where that takes too long.
    """
    telling = F.filter("cells", lambda x: x["col"].isin("name", *ADDRESSED))  # no other cell changes a cluster's name or address
    marks = F.transform(telling, lambda x: F.struct(x["col"].alias("col"), x["confidence"].alias("confidence"), F.coalesce(F.length(x["evidence_snippet"]), F.lit(0)).alias("size"), url.domain(x["value"]).alias("site")))
    says = F.struct(text.name_key(c.value(F.col("cells"), "name")).alias("name"), url.domain(c.own_website(F.col("cells"), ADDRESSED)).alias("domain"), marks.alias("marks"))
    reduced = drafts.select(
        "query_id", F.col("draft_seq").cast("long").alias("draft_seq"), F.coalesce(text.name_key(F.col("entity_name")), F.lit("")).alias("key"),
        F.when(F.size(telling) > 0, F.to_json(says, {"ignoreNullFields": "false"})).otherwise("").alias("says"), F.pmod(F.xxhash64("query_id"), F.lit(2048)).alias("block"),
    )
    # What a draft says goes as text: for nested columns Spark's Arrow writer counts the batch's bytes anew at each row.  Rows are sorted by the bits of one number.
    place = F.shiftleft("block", 52) + F.shiftright("draft_seq", 12)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, last = {}, None
        for batch in batches:
            out = []
            for i, (block, query, key, says) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("block", "query_id", "key", "says")), strict=True)):
                if (block, query) != last:
                    if last is None or block != last[0]:
                        states = {}
                    found, places = states.setdefault(query, ([], {}))
                    last = (block, query)
                said = json.loads(says) if says else None
                place = None if said else places.get(key)
                if place is None:
                    domain = said and said["domain"]
                    place = next((n for n, f in enumerate(found) if (domain and domain == f["domain"]) or fuzzy.similar_keys(key, f["name"] or "")), len(found))
                if place == len(found):
                    found.append({"first": batch.column("draft_seq")[i].as_py(), "cells": {}, "domain": "", "name": key})
                state = found[place]
                if said is None:
                    places[key] = place  # until a cluster gets another name
                else:
                    named = state["name"]
                    for m in said["marks"]:
                        had = state["cells"].get(m["col"])
                        if had is None or m["confidence"] > had["confidence"] + 0.05 or (m["confidence"] >= had["confidence"] - 0.05 and m["size"] > had["size"]):
                            state["cells"][m["col"]] = m | {"name": said["name"]}
                    state["domain"] = next((state["cells"][k]["site"] for k in ADDRESSED if k in state["cells"]), "")
                    state["name"] = state["cells"]["name"]["name"] if "name" in state["cells"] else named
                    if state["name"] != named:
                        places.clear()
                out.append(state["first"])
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("draft_seq"), pa.array(out, pa.int64())], ["query_id", "draft_seq", "cluster"])

    return reduced.withColumn("place", place).repartition("query_id").sortWithinPartitions("place", "draft_seq").drop("place").mapInArrow(merge, "query_id string, draft_seq long, cluster long")


def exact_clusters(drafts: DataFrame) -> DataFrame:
    """The same for equal name keys only: a grouped minimum, for any number of drafts in a query."""
    key = text.name_key(F.col("entity_name"))
    first = drafts.groupBy("query_id", key.alias("key")).agg(F.min("draft_seq").alias("cluster"))
    return drafts.withColumn("key", key).join(first, ["query_id", "key"]).select("query_id", "draft_seq", "cluster")


def merged(drafts: DataFrame, plans: DataFrame, members: DataFrame) -> DataFrame:
    """Entities: of each cluster's cells one for each column, by the ordered fold, in the plan's order."""
    joined = drafts.join(members, ["query_id", "draft_seq"])
    exploded = joined.select("query_id", "cluster", "draft_seq", F.posexplode("cells").alias("pos", "cell"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("draft_seq", "pos", "cell"))), lambda x: x["cell"])
    per_column = exploded.groupBy("query_id", "cluster", F.col("cell.col").alias("col")).agg(F.min(F.struct("draft_seq", "pos")).alias("first"), c.folded(ordered).alias("cell"))
    per_entity = per_column.groupBy("query_id", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "cell"))), lambda x: x["cell"]).alias("cells"))
    facts = joined.groupBy("query_id", "cluster").agg(F.count_distinct("source_url").alias("sources_count"), F.min_by("entity_name", "draft_seq").alias("entity_name"))
    return (
        facts.join(per_entity, ["query_id", "cluster"])
        .join(plans.select("query_id", "columns"), "query_id")
        .select(
            "query_id", F.col("cluster").alias("row_pos"), slug(F.col("entity_name")).alias("entity_id"), "sources_count",
            F.bround(c.mean_confidence(F.col("cells")), 3).alias("aggregate_confidence"), F.lit(None).cast("string").alias("canonical_domain"),
            c.in_order(F.col("cells"), F.col("columns")).alias("cells"),
        )
    )


def within_pages(drafts: DataFrame) -> DataFrame:
    """Drafts of one page with similar names as one: of each column the cell with more confidence, the first of equals."""
    keyed = drafts.withColumn("key", text.name_key(F.col("entity_name")))

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows, firsts, out = rows.sort_values("draft_seq", kind="stable"), [], []
        for r in rows.itertuples():
            near = next((f for f in firsts if fuzzy.similar_keys(r.key, f[0])), None)
            if near is None:
                near = (r.key, r.draft_seq)
                firsts.append(near)
            out.append((r.query_id, r.draft_seq, near[1]))
        return pd.DataFrame(out, columns=["query_id", "draft_seq", "first"])

    near = keyed.select("query_id", "source_url", "draft_seq", "key").groupBy("query_id", "source_url").applyInPandas(join, "query_id string, draft_seq long, first long")
    joined = drafts.join(near, ["query_id", "draft_seq"])
    cell = joined.select("query_id", "first", "draft_seq", F.posexplode("cells").alias("pos", "cell"))
    best = cell.groupBy("query_id", "first", "cell.col").agg(
        F.min(F.struct((-F.col("cell.confidence")).alias("less"), "draft_seq", "pos", "cell")).alias("best"), F.min(F.struct("draft_seq", "pos")).alias("place")
    )
    cells = best.groupBy("query_id", "first").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "best.cell"))), lambda x: x["cell"]).alias("cells"))
    heads = joined.where("draft_seq = first").select("query_id", "draft_seq", "entity_name", "source_url", "source_title")
    return heads.join(cells.withColumnRenamed("first", "draft_seq"), ["query_id", "draft_seq"]).select(*[x.split()[0] for x in schemas.DRAFTS.split(", ")[:5]], "cells")
