"""Queries over small tables of their own, whose results cover every row."""

import datetime
import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cairn import catalog, schemas
from cairn.functions import fuzzy
from cairn.plans import discovery
from cairn.sources import tables


def put(spark, folder, **tables):
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


NAMES = {1: "hot bolt", 11: "old plate", 401: "hot bolt", 411: "bolt hot", 1001: "blue ring", 25001: "blue ring", 402: "cold plate"}
#: (part, order, supplier, flag, price, quantity, discount)
LINES = [(k, 10 * i + j, 7 * i + 3 * j, "RNA"[(i + j) % 3], 100.0 + 10 * i + j, 1 + (5 * i + j) % 9, 0.01 * ((3 * i + 2 * j) % 10)) for i, k in enumerate(NAMES) for j in range(4)]


@pytest.fixture
def parts(spark, tmp_path):
    day = datetime.date(2024, 1, 1)
    rows = [(o, k, s, 1, float(q), price, d, flag, day) for k, o, s, flag, price, q, d in LINES]
    return put(
        spark, tmp_path, part=("p_partkey int, p_name string", list(NAMES.items())),
        lineitem=("l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate date", rows),
    )


def merged_by_hand(same):
    """{(query, first draft): (sites, {column: (confidence, size, value)})}: each draft joins the first cluster whose first name is the same."""
    drafts = defaultdict(list)
    for k in sorted(NAMES):
        for seq, line in enumerate(sorted((x for x in LINES if x[0] == k), key=lambda x: x[1]), 1):
            drafts[f"q{k % 10}"].append((k * 100000 + seq, NAMES[k], line))
    out = {}
    for q, rows in drafts.items():
        firsts = []
        for key, name, (_, _, supplier, flag, price, quantity, discount) in rows:
            at = next((f for f, n in firsts if same(name, n)), None)
            if at is None:
                firsts.append((at := key, name))
            sites, cells = out.setdefault((q, at), (set(), {}))
            sites.add(supplier % 40)
            now, had = (round(discount * 10, 1), quantity, str(price)), cells.get(flag)
            if had is None or now[0] > had[0] + 0.05 or (now[0] >= had[0] - 0.05 and now[1] > had[1]):
                cells[flag] = now
    return out


def test_exact_merge_takes_every_part(spark, parts):
    found = {(r.query_id, r.row_pos): (r.sources_count, dict(zip(r.columns.split("|"), r.best_values.split("|"), strict=True))) for r in catalog.entity_cell_merge_exact(spark, parts).collect()}
    expected = {k: (len(sites), {col: x[2] for col, x in cells.items()}) for k, (sites, cells) in merged_by_hand(lambda a, b: a == b).items()}
    assert found == expected
    assert ("q1", 100100001) in found


def test_fuzzy_merge_takes_every_draft(spark, parts):
    found = {(r.query_id, r.row_pos): r.sources_count for r in catalog.fuzzy_merge_entities(spark, parts).collect()}
    assert found == {k: len(sites) for k, (sites, _) in merged_by_hand(fuzzy.similar_keys).items()}
    assert ("q1", 41100001) not in found and ("q2", 40200001) in found


def test_discovery_asks_every_host_over_every_page(spark, tmp_path, monkeypatch):
    """Of two pages with one address the first is read; no other page and no host's label goes."""
    rows = [(i, f"https://host{i % 45}.example.org/en/{i}", f"<p>page {i}</p>") for i in range(100)] + [(100, "https://host3.example.org/en/3", "<p>again</p>")]
    at = put(spark, tmp_path, pages=("page_id int, url string, html string", rows))
    given = {}

    def run(queries, search, pages, options, answers):
        given.update(queries=queries, search=search, pages=pages)
        return spark.createDataFrame([], f"query_id string, rank_position int, entity_id string, final_score double, sources_count long, canonical_domain string, aggregate_confidence double, cells {schemas.CELLS}")

    monkeypatch.setattr(catalog.discovery, "run", run)
    catalog.discovery_pipeline(spark, at)
    assert {r.query_id for r in given["queries"].collect()} == {f"host{i}" for i in range(45)}
    assert sorted(r.url for r in given["search"].pages.collect()) == sorted(u for _, u, _ in rows[:100])
    assert sorted((r.url, r.html) for r in given["pages"].table.collect()) == sorted((u, h) for _, u, h in rows[:100])


class Answers:
    """Says of every chunk what ``said`` has for its address."""

    def __init__(self, **said):
        self.said = said

    def answers(self, chunks):
        word = F.regexp_extract("url", "https://([a-z]+)", 1)
        answer = F.element_at(F.create_map(*[F.lit(x) for pair in self.said.items() for x in pair]), word)
        return chunks.select("query_id", "url", "chunk_pos", answer.alias("answer"))


def answer(name, **cells):
    return json.dumps({"entities": [{"entity_name": name, "cells": {k: {"value": v, "evidence_snippet": v, "confidence": 0.9} for k, v in cells.items()}}]})


def test_discovery_asks_for_answers_and_fills_gaps(spark):
    """The first page names an entity, and only the search for its gaps finds the page that says where it is."""
    body = "".join(f"<p>Some words about companies, number {i}, and what they do in the city.</p>" for i in range(12))
    at = {"first": "https://first.example.org/en/1/x", "second": "https://second.example.org/en/2/x"}
    pages = tables.TablePages(spark.createDataFrame([(u, f"<html><title>{k}</title><body>{body}</body></html>") for k, u in at.items()], "url string, html string"))

    class Search:
        def hits(self, searches):
            gap = F.col("query").contains("Acme Widgets")
            url = F.when(gap, F.lit(at["second"])).otherwise(F.lit(at["first"]))
            return searches.select("query_id", "angle_pos", F.lit(0).alias("hit_pos"), url.alias("url"), F.lit("").alias("title"), F.lit(None).cast("string").alias("snippet"))

    asked = spark.createDataFrame([("q", "robotics companies in Berlin")], "query_id string, query string")
    said = Answers(first=answer("Acme Widgets", website="https://acme.example.net/"), second=answer("Acme Widgets", headquarters="Berlin, Germany"))
    rows = discovery.run(asked, Search(), pages, discovery.Options(), said).collect()
    assert [{x["col"]: x["value"] for x in r["cells"]}.get("headquarters") for r in rows] == ["Berlin, Germany"]
    assert {x["source_url"] for x in rows[0]["cells"]} >= set(at.values())


def test_lexical_rerank_takes_every_word(spark, tmp_path):
    """What tells the documents apart stands after the item's sixtieth character."""
    text = "common words that every one of these documents has in its first line and then tangerine umbrella"
    docs = [(0, "common words that every one"), (1, "tangerine umbrella"), (2, "common tangerine umbrella words")]
    at = put(spark, tmp_path, benchmark=("item_id int, text string", [(7, text)]), documents=("doc_id int, text string", docs))
    wanted = set(text.split())
    scores = sorted((-len(wanted & set(x.split())) / len(wanted), i) for i, x in docs)
    found = sorted((r.pos, r.doc_id, round(r.score, 9)) for r in catalog.lexical_rerank_topk(spark, at).collect())
    assert found == [(n, i, round(-s, 9)) for n, (s, i) in enumerate(scores, 1)]


def test_gap_fill_keeps_the_unnamed(spark, tmp_path):
    """Suppliers without a name pass through unfilled, those with a generic one are filled like others."""
    rows = [(k, f"Supplier {k}", k % 5, 100.0 * k) for k in range(1, 40)]
    at = put(spark, tmp_path, supplier=("s_suppkey int, s_name string, s_nationkey int, s_acctbal double", rows))
    found = {r.row_pos: (r.gap_filled, r.cell_values) for r in catalog.gap_fill_accept(spark, at).collect()}
    assert set(found) == set(range(1, 40))
    assert {k for k, (filled, _) in found.items() if not filled} == {13, 26, 39}
    assert found[11][1].startswith("Company|") and found[11][1].endswith("|product_or_service of official_site")
    assert "of official_site" not in found[13][1]


def test_official_site_reads_the_visible_head(spark, tmp_path):
    """The name of another host stands behind 400 characters of markup, in the first 200 that are seen."""
    late = "<html><head><style>" + "p{margin:0} " * 50 + "</style></head><body><p>all about zebrafish here</p></body></html>"
    pages = [(0, "https://alpha.example.org/", late), (1, "https://zebrafish.example.org/", "<p>nothing</p>")]
    at = put(spark, tmp_path, pages=("page_id int, url string, html string", pages))
    assert {r.row_pos: r.url for r in catalog.official_site_argmax(spark, at).collect()} == {0: "https://alpha.example.org/", 1: "https://alpha.example.org/"}


def test_visible_text_is_that_of_its_sql(spark, tmp_path):
    """References that are cut off, as in titles that end after so many characters, stay as they are written."""
    import duckdb

    from cairn import oracle

    bodies = ["cats &amp;&amp;&amp", "cats &amp;amp; dogs &am", "a &lt;b&gt; &quot;c&quot; &copy; &copy2024 &lt", "x && y &amp z &unknown; &notit; &"]
    pages = [(i, f"https://a.org/{i}", f"<html><head><title>{x}</title><script>if (a &amp b) &lt</script></head><body><h1>{x}</h1><a href='/q?a=1&amp;b=2'>to</a> <p>{x}</p> end</body></html>") for i, x in enumerate(bodies)]
    at = put(spark, tmp_path, pages=("page_id int, url string, html string", pages))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{at}/pages.parquet/*.parquet'")
    found = sorted(tuple(r) for r in catalog.html_visible_text(spark, at).select("page_id", "title", "visible", "headings").collect())
    assert found == sorted(con.execute(oracle.SQL["html_visible_text"]).fetchall())
    assert found[0][1] == "cats &&&amp"


def test_decontamination_hits_items_without_an_id(spark, tmp_path):
    """As the SQL has it: their words are hit, together they are one item, and the digest is of the others' ids."""
    import duckdb

    from cairn.llm import catalog as llm

    items = [(None, "one two three"), (None, "four five six"), ("b", "four five six")]
    docs = [(0, "says one two three here"), (1, "one two three four five six"), (2, "nothing of it")]
    at = put(spark, tmp_path, benchmark=("item_id string, text string", items), documents=("doc_id int, text string", docs))
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    name = "op1_benchmark_decontamination"
    expected = con.execute(llm.ORACLE[name])
    names = [x[0] for x in expected.description]
    found = sorted(tuple(r[n] for n in names) for r in llm.QUERIES[name](spark, at).collect())
    assert found == sorted(expected.fetchall())
    assert [dict(zip(names, r, strict=True))["n_items"] for r in found] == [1, 2, 0]
