"""Searches, pages and model answers from tables; anything with the same methods can take their place."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import schemas
from cairn.functions import text


class SearchSource(Protocol):
    """Hits for searches (query_id, angle_pos, query)."""

    def hits(self, searches: DataFrame) -> DataFrame: ...


class PageSource(Protocol):
    """Pages (url, html) for addresses (url)."""

    def fetch(self, wanted: DataFrame) -> DataFrame: ...


class AnswerSource(Protocol):
    """Raw answers (query_id, url, chunk_pos, answer) for chunks."""

    def answers(self, chunks: DataFrame) -> DataFrame: ...


@dataclass
class TableSearch:
    """Hits of searches that a table (query, hit_pos, url, title, snippet) has, the first ``top_k`` of each."""

    table: DataFrame
    top_k: int = 5

    def hits(self, searches: DataFrame) -> DataFrame:
        found = searches.join(self.table, "query").where(F.col("hit_pos") < self.top_k)
        return found.select("query_id", "angle_pos", "hit_pos", "url", "title", "snippet")


@dataclass
class LexicalSearch:
    """Hits by the words that a search shares with a page's address and title, for corpora without a search service."""

    pages: DataFrame
    top_k: int = 5

    def hits(self, searches: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        asked = searches.select("query_id", "angle_pos", F.explode(text.words(F.col("query"))).alias("word")).where(F.length("word") > 2)
        said = self.pages.select("url", "title", F.explode(text.words(F.concat_ws(" ", "url", "title"))).alias("word"))
        shared = asked.join(said, "word").groupBy("query_id", "angle_pos", "url").agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("title"))
        best = F.row_number().over(Window.partitionBy("query_id", "angle_pos").orderBy(F.col("n").desc(), "url"))
        return shared.select("query_id", "angle_pos", (best - 1).alias("hit_pos"), "url", "title", F.lit(None).cast("string").alias("snippet")).where(F.col("hit_pos") < self.top_k)


@dataclass
class TablePages:
    """Pages of a table (url, html)."""

    table: DataFrame

    def fetch(self, wanted: DataFrame) -> DataFrame:
        return wanted.join(self.table.select("url", "html").dropDuplicates(["url"]), "url")


@dataclass
class Policy:
    """Retries with growing pauses, and a pause for a provider that failed them all."""

    attempts: int = 1
    longest_pause: float = 30.0
    cooldown: float = 60.0
    transient: tuple[type[Exception], ...] = (TimeoutError, ConnectionError)
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    resting: dict[str, float] = field(default_factory=dict)

    def available(self, provider: str) -> bool:
        return self.clock() >= self.resting.get(provider, 0.0)

    def call(self, providers: list[tuple[str, Callable[[], str]]]) -> str | None:
        """The first answer of the providers in order; null if none of them is there."""
        for name, ask in providers:
            if not self.available(name):
                continue
            for attempt in range(max(1, self.attempts)):
                try:
                    return ask()
                except self.transient:
                    if attempt + 1 < self.attempts:
                        self.sleep(min(self.longest_pause, 2.0**attempt) * (0.5 + random.random() / 2))
            self.resting[name] = self.clock() + self.cooldown
        return None


@dataclass
class FetchedPages:
    """Pages from a function of an address; one client for each task, failures are null and go."""

    client: Callable[[], Callable[[str], str | None]]
    partitions: int = 64

    def fetch(self, wanted: DataFrame) -> DataFrame:
        client = self.client

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            get = client()
            for part in parts:
                yield pd.DataFrame({"url": part["url"], "html": [get(u) for u in part["url"]]})

        found = wanted.select("url").distinct().repartition(self.partitions).mapInPandas(run, "url string, html string")
        return wanted.join(found.where("html is not null"), "url")


FENCE = r"(?s)```(?:json)?\s*(.*?)```"
_ANSWER = "entities array<struct<entity_name: string, cells: map<string, struct<value: string, evidence_snippet: string, confidence: double>>>>"


def answer_json(raw: Column) -> Column:
    """The JSON of an answer: all of it, or the body of its first fenced block; null if neither is."""
    parse = lambda s: F.from_json(s, _ANSWER)
    whole, fenced = F.trim(raw), F.trim(F.regexp_extract(raw, FENCE, 1))
    valid = lambda s: F.try_parse_json(s).isNotNull()
    return F.when(valid(whole) & (whole != ""), parse(whole)).when(valid(fenced) & (fenced != ""), parse(fenced))


def drafts_of(answers: DataFrame) -> DataFrame:
    """Drafts of raw answers (query_id, draft_base, url, title, answer): cells with value and snippet, valid, sure between 0 and 1."""
    from cairn.functions import pages, values

    found = answers.withColumn("parsed", answer_json(F.col("answer"))).withColumn(
        "url_regime", pages.regime(F.col("url"), F.col("title"))["regime"]
    )
    found = found.select("query_id", "draft_base", "url", "title", "url_regime", F.posexplode("parsed.entities").alias("pos", "entity"))

    def cell(entry: Column) -> Column:
        v = values.validated(entry["key"], entry["value"]["value"], F.col("url"), F.col("title"))
        sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(entry["value"]["confidence"], F.lit(0.5))))
        made = F.struct(
            entry["key"].alias("col"), v["value"].alias("value"), F.col("url").alias("source_url"), F.col("title").alias("source_title"),
            text.truncated(F.trim(entry["value"]["evidence_snippet"]), 200).alias("evidence_snippet"), sure.alias("confidence"), F.col("url_regime").alias("source_regime"),
        )
        return F.when(v["ok"] & (F.coalesce(F.trim(entry["value"]["evidence_snippet"]), F.lit("")) != ""), made)

    cells = F.filter(F.transform(F.map_entries("entity.cells"), cell), lambda x: x.isNotNull())
    own = F.struct(
        F.lit("name").alias("col"), F.trim("entity.entity_name").alias("value"), F.col("url").alias("source_url"), F.col("title").alias("source_title"),
        F.trim("entity.entity_name").alias("evidence_snippet"), F.lit(0.75).alias("confidence"), F.col("url_regime").alias("source_regime"),
    )
    with_name = F.when(F.exists(cells, lambda x: x["col"] == "name"), cells).otherwise(F.concat(F.array(own), cells))
    rows = found.where(F.coalesce(F.trim("entity.entity_name"), F.lit("")) != "")
    return rows.select("query_id", (F.col("draft_base") + F.col("pos")).alias("draft_seq"), F.trim("entity.entity_name").alias("entity_name"), F.col("url").alias("source_url"), F.col("title").alias("source_title"), with_name.cast(schemas.CELLS).alias("cells"))
