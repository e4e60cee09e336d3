"""From queries to ranked entities, all queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import acquire, align, extract, gapfill, merge, official, plan, rank, requirements, rerank, verify
from cairn.sources.tables import AnswerSource, PageSource, SearchSource, drafts_of
from cairn.storage import written


@dataclass(frozen=True)
class Options:
    """The settings of a run."""

    hits_per_angle: int = 5
    rerank_top_k: int = 10
    gap_entities: int = 5
    max_rows: int = 20
    max_strict_rows: int = 15
    as_of_year: int = 2025
    check_cells: bool = True
    exact_merge: bool = True


def pages_of(plans: DataFrame, search: SearchSource, pages: PageSource, options: Options) -> DataFrame:
    """The pages of all angles of each query, each address once, read and classified."""
    hits = acquire.first_hits(search.hits(plan.angles(plans)))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("angle_pos", "hit_pos")) - 1
    placed = hits.withColumn("page_pos", turn).select("query_id", "page_pos", "url", "title")
    return acquire.parsed(pages.fetch(written(placed, "hits")))


def drafts_of_pages(pages: DataFrame, plans: DataFrame, answers: AnswerSource | None, *, discover: bool) -> DataFrame:
    """The drafts of pages, those of one page with similar names as one.

    Pages whose own drafts are not sufficient are cut into chunks and asked
    about (query_id, query, columns, url, title, chunk_pos, chunk); their
    answers' drafts come after their own.  ``pages`` and ``plans`` are written.
    """
    own = written(extract.deterministic(pages, plans, discover=discover), "own_drafts")
    if answers is None:
        return merge.within_pages(own)
    enough = extract.sufficient(own, pages, plans, discover=discover).where("sufficient").select("query_id", "url")
    lacking = pages.join(enough, ["query_id", "url"], "left_anti").join(plans.select("query_id", "query", "columns"), "query_id")
    chunks = lacking.select("query_id", "query", "columns", "url", "title", F.posexplode(text.chunks(F.col("cleaned_text"))).alias("chunk_pos", "chunk"))
    said = answers.answers(written(chunks, "chunks")).select("query_id", "url", "chunk_pos", "answer")
    base = F.col("chunk_pos").cast("long") * 1_000_000
    given = drafts_of(said.join(pages.select("query_id", "url", "title"), ["query_id", "url"]).withColumn("draft_base", base))
    both = own.withColumn("__asked", F.lit(0)).unionByName(given.withColumn("__asked", F.lit(1)))
    placed = both.join(pages.select("query_id", F.col("url").alias("source_url"), "page_pos"), ["query_id", "source_url"])
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("page_pos", "__asked", "draft_seq")).cast("long")
    return merge.within_pages(written(placed.withColumn("draft_seq", turn).select(*own.columns), "all_drafts"))


def entities(plans: DataFrame, pages: DataFrame, options: Options, answers: AnswerSource | None = None) -> DataFrame:
    """Entities of the best pages, with their own sites."""
    best = written(rerank.top(pages, plans, options.rerank_top_k), "best")
    drafts = written(drafts_of_pages(best, plan.discovery(plans), answers, discover=True), "drafts")
    members = merge.clusters(drafts) if options.exact_merge else merge.exact_clusters(drafts)
    return official.resolved(written(merge.merged(drafts, plans, members), "merged"), pages)


def run(queries: DataFrame, search: SearchSource, pages: PageSource, options: Options = Options(), answers: AnswerSource | None = None) -> DataFrame:
    """Ranked entities (query_id, rank_position, ...) of queries (query_id, query).

    The first ranking decides who is sparse, and so whose gaps are filled, and
    breaks ties of the second; after it rows only go, so positions are counted
    once more at the end.  Each phase is written and read again.  Without
    ``answers`` pages give what their structure says.
    """
    plans = written(plan.plans(queries), "plans")
    found = written(pages_of(plans, search, pages, options), "pages")
    first = rank.scored(written(entities(plans, found, options, answers), "entities"), plans, as_of_year=options.as_of_year)
    first = fill_gaps(written(first, "scored"), plans, search, pages, options, answers).drop("gap_filled")
    first = first.withColumnRenamed("final_score", "first_score").drop("components", "base_score", "penalty")
    for name in ("requirements_total", "requirements_satisfied", "requirements_unknown", "hard_failed"):
        first = first.drop(name)
    checked = align.penalized(written(first, "first")) if options.check_cells else first
    judged = written(requirements.summarized(written(checked, "checked"), plans), "judged")
    second = written(rank.ranked(rank.scored(judged, plans, as_of_year=options.as_of_year), "first_score"), "second")
    shown = rank.pruned(verify.verified(second, most=options.max_rows, most_strict=options.max_strict_rows))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("rank_position"))
    return shown.withColumn("rank_position", turn)


def fill_gaps(rows: DataFrame, plans: DataFrame, search: SearchSource, pages: PageSource, options: Options = Options(), answers: AnswerSource | None = None) -> DataFrame:
    """Scored entities with cells that focused searches for the sparsest of them give."""
    asked = written(gapfill.wanted(rank.sparse(rows, options.gap_entities)), "asked")
    searches = asked.select(
        F.concat_ws("#", "query_id", F.col("row_pos").cast("string")).alias("query_id"), F.posexplode("gap_queries").alias("angle_pos", "query")
    )
    hits = acquire.first_hits(search.hits(searches).where("hit_pos < 2"))
    own = asked.select(F.concat_ws("#", "query_id", F.col("row_pos").cast("string")).alias("query_id"), F.posexplode("official_urls").alias("page_pos", "url"))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("angle_pos", "hit_pos")) + 1
    wanted = own.withColumn("title", F.lit("")).unionByName(hits.withColumn("page_pos", turn).select("query_id", "page_pos", "url", "title"))
    once = acquire.latest(wanted.withColumn("__o", -F.col("page_pos")), ["query_id", "url"], "__o").drop("__o")
    read = written(acquire.parsed(pages.fetch(once)), "gap_pages")
    small = asked.select(F.concat_ws("#", "query_id", F.col("row_pos").cast("string")).alias("query_id"), F.col("name").alias("query"), F.concat(F.array(F.lit("name")), F.array_remove("missing", "name")).alias("columns"))
    drafts = drafts_of_pages(read, small, answers, discover=False).join(read.select("query_id", F.col("url").alias("source_url"), "page_pos", "regime", "regime_confidence"), ["query_id", "source_url"])
    key = F.split("query_id", "#")
    back = drafts.withColumn("row_pos", F.element_at(key, -1).cast("long")).withColumn("query_id", F.regexp_replace("query_id", "#[0-9]+$", ""))
    return gapfill.filled(rows, asked, back)
