"""The entity operators on small relations."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cairn import schemas
from cairn.functions import cells as c
from cairn.functions import fuzzy
from cairn.operators import acquire, align, display, evaluate, export, extract, gapfill, jobs, merge, official, rank, requirements, verify
from cairn.sources import tables
from cairn.streaming import jobs as streams


def cell(col, value, url="https://a.org/p", snippet=None, confidence=0.9, title=None, regime="unknown"):
    return (col, value, url, title, value if snippet is None else snippet, confidence, regime)


def drafts(spark, *rows):
    made = [("q", i, name, cells[0][2], None, cells) for i, (name, cells) in enumerate(rows)]
    return spark.createDataFrame(made, schemas.DRAFTS)


def entities(spark, *rows):
    """(cells, sources_count, canonical_domain) each."""
    made = [("q", i, f"e{i}", n, sum(x[5] for x in cells) / max(1, len(cells)), domain, cells) for i, (cells, n, domain) in enumerate(rows)]
    return spark.createDataFrame(made, schemas.ENTITIES)


def planned(df, family="organization_company", columns=("name", "website", "headquarters"), entity_type="startup", query="startups"):
    return df.withColumns({"columns": F.array(*map(F.lit, columns)), "family": F.lit(family), "entity_type": F.lit(entity_type), "query": F.lit(query)})


def plan(spark, columns=("name", "website", "headquarters")):
    return spark.createDataFrame([("q", list(columns))], "query_id string, columns array<string>")


def better(a, b):
    if b[1] > a[1] + 0.05 or (b[1] >= a[1] - 0.05 and b[2] > a[2]):
        return b
    return a


def test_fold_is_ordered(spark):
    rng = random.Random(4)
    rows, expected = [], []
    for i in range(200):
        marks = [(n, rng.randint(0, 10) / 10, rng.randint(0, 3)) for n in range(rng.randint(1, 6))]
        rows.append((i, [("x", str(n), "u", None, "s" * size, sure, None) for n, sure, size in marks]))
        best = marks[0]
        for m in marks[1:]:
            best = better(best, m)
        expected.append(str(best[0]))
    df = spark.createDataFrame(rows, f"i int, cells {schemas.CELLS}")
    assert [r[0] for r in df.orderBy("i").select(c.folded(F.col("cells"))["value"]).collect()] == expected


def test_merge(spark):
    d = drafts(
        spark,
        ("Alpha Robotics", [cell("name", "Alpha Robotics", "https://one.org/"), cell("headquarters", "Brooklyn", "https://one.org/")]),
        ("Alpha Robotics Inc", [cell("name", "Alpha Robotics Inc", "https://two.org/", confidence=0.5), cell("website", "https://alpha.ai", "https://two.org/")]),
        ("Alpha Labs", [cell("name", "Alpha Labs", "https://three.org/", confidence=0.5), cell("website", "https://www.alpha.ai/x", "https://three.org/", confidence=0.5)]),
        ("Beta", [cell("name", "Beta", "https://one.org/")]),
    )
    rows = merge.merged(d, plan(spark), merge.clusters(d)).orderBy("row_pos").collect()
    assert [(r["entity_id"], r["sources_count"], [(x["col"], x["value"]) for x in r["cells"]]) for r in rows] == [
        ("alpha-robotics", 3, [("name", "Alpha Robotics"), ("website", "https://alpha.ai"), ("headquarters", "Brooklyn")]),
        ("beta", 1, [("name", "Beta")]),
    ]
    exact = merge.merged(d, plan(spark), merge.exact_clusters(d))
    assert exact.count() == 4


def greedy(rows):
    """{(query, draft): first draft} of (query, draft, name key, {column: (key or domain, confidence, size)}), each compared with all clusters before it."""
    found, out = {}, {}
    for q, n, key, marks in sorted(rows, key=lambda x: x[1]):
        clusters = found.setdefault(q, [])
        domain = marks.get("website", ("",))[0]
        own = next((f for f in clusters if (domain and domain == f["cells"].get("website", ("",))[0]) or fuzzy.similar_keys(key, f["cells"].get("name", (f["key"],))[0])), None)
        if own is None:
            clusters.append(own := {"first": n, "key": key, "cells": {}})
        for col, now in marks.items():
            own["cells"][col] = better(own["cells"][col], now) if col in own["cells"] else now
        out[q, n] = own["first"]
    return out


def test_merge_holds_no_query_whole(spark):
    """Drafts with and without a name or a site, and without any, in batches of seven and no group."""
    rng, rows, expected = random.Random(9), [], []
    words = ["red", "bolt", "hot", "ring", "gear", "cold"]
    for n in range(900):
        name = None if n % 90 == 5 else " ".join(rng.sample(words, rng.randint(1, 3)))
        marks = {k: (v, rng.randint(0, 10) / 10, rng.randint(0, 4)) for k, v, p in (("name", " ".join(rng.sample(words, 2)), 0.2), ("website", f"{rng.choice('abcdefgh')}.org", 0.1), ("other", "x", 0.9)) if rng.random() < p}
        q = f"q{rng.randint(0, 3)}"
        rows.append((q, n * 5000, name, "u", None, [(k, f"https://{v}/" if k == "website" else v, "u", None, "s" * size, sure, None) for k, (v, sure, size) in marks.items()]))
        expected.append((q, n * 5000, name or "", marks))
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, schemas.DRAFTS)
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        members = merge.clusters(d)
        found = {(r["query_id"], r["draft_seq"]): r["cluster"] for r in members.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
    assert found == greedy(expected) and len(set(found.values())) > 30
    assert "FlatMapGroups" not in members._jdf.queryExecution().toString()


def test_page_merge_keeps_the_surer_cell(spark):
    d = drafts(spark, ("A Corp", [cell("name", "A Corp"), cell("x", "low", confidence=0.3)]), ("A Corp", [cell("name", "A Corp"), cell("x", "high", confidence=0.4), cell("y", "new")]), ("Zeta", [cell("name", "Zeta")]))
    rows = merge.within_pages(d).orderBy("draft_seq").collect()
    assert [(r["draft_seq"], {x["col"]: x["value"] for x in r["cells"]}) for r in rows] == [(0, {"name": "A Corp", "x": "high", "y": "new"}), (2, {"name": "Zeta"})]


def test_slugs(spark):
    df = spark.createDataFrame([("Café  Ñu!",), ("北京",), ("北京",)], "n string")
    found = [r[0] for r in df.select(merge.slug(F.col("n"))).collect()]
    assert found[0] == "caf-u" and len(found[1]) == 8 and found[1] == found[2]


def spec(**given):
    base = {"id": "fund_0", "label": "Funding > 1M", "kind": "numeric", "operator": "greater_than", "target_value": "1M", "target_value_raw": "1M", "source_phrase": "funding > 1M", "priority": "high", "is_hard": True, "mapped_columns": ["funding"]}
    return tuple((base | given).values())


def test_requirements_on_entities(spark):
    from cairn.functions import queries

    e = entities(
        spark,
        ([cell("name", "A"), cell("funding", "$2.5M raised", confidence=0.8), cell("headquarters", "New York, NY")], 1, None),
        ([cell("name", "B"), cell("funding", "$900K raised"), cell("headquarters", "Berlin, Germany", title="In the US")], 1, None),
        ([cell("name", "C"), cell("funding", "well funded")], 1, None),
    )
    specs = [spec(), spec(id="loc_0", label="Location: US", kind="location", operator="contains", target_value="us", mapped_columns=["headquarters"]), spec(id="lic_0", kind="categorical", operator="exists", target_value="open-source", is_hard=False, mapped_columns=[])]
    plans = spark.createDataFrame([("q", specs)], f"query_id string, requirements array<{queries.SPEC.simpleString()}>")
    rows = requirements.summarized(e, plans).orderBy("row_pos").collect()
    assert [[m["status"] for m in r["matches"]] for r in rows] == [["satisfied", "satisfied", "unknown"], ["not_satisfied", "satisfied", "unknown"], ["unknown", "unknown", "unknown"]]
    assert rows[0]["matches"][0]["confidence"] == 0.8 and rows[1]["matches"][1]["confidence"] == 0.72
    assert (rows[0]["requirements_satisfied"], rows[0]["hard_satisfied"], rows[1]["hard_failed"], rows[0]["satisfaction_ratio"]) == (2, 2, 1, 0.667)
    none = requirements.summarized(e, plans.limit(0)).first()
    assert none["matches"] == [] and none["requirements_total"] == 0


def scored(spark, e, **given):
    zeros = {n: F.lit(0) for n in ("requirements_total", "requirements_satisfied", "requirements_unknown", "hard_failed")}
    return rank.scored(planned(e, **given).withColumns(zeros), spark.createDataFrame([("q",)], "query_id string"), as_of_year=2024)


def test_two_domains_outrank_one(spark):
    one = [cell("name", "A", "https://a.org/1"), cell("website", "https://x.net", "https://a.org/2")]
    two = [cell("name", "B", "https://a.org/1"), cell("website", "https://y.net", "https://b.org/2")]
    rows = rank.ranked(scored(spark, entities(spark, (one, 2, None), (two, 2, None)))).orderBy("rank_position").collect()
    assert [r["entity_id"] for r in rows] == ["e1", "e0"]
    r = rows[0]
    assert abs(sum(x["weighted_value"] for x in r["components"]) - r["base_score"]) < 1e-9
    values = [x["weighted_value"] for x in r["components"]]
    assert values == sorted(values, reverse=True) and len(values) == 13


def test_penalty_is_bounded(spark):
    e = planned(entities(spark, ([cell("name", "A")], 1, None))).withColumns({"requirements_total": F.lit(5), "requirements_satisfied": F.lit(0), "requirements_unknown": F.lit(0), "hard_failed": F.lit(5)})
    r = rank.scored(e, spark.createDataFrame([("q",)], "query_id string"), as_of_year=2024).first()
    assert r["penalty"] == 0.3 and abs(r["base_score"] - 0.3 - r["final_score"]) < 1e-9


def test_pruning_and_its_guard(spark):
    bad, good = ([cell("name", "Company")], 1, None), ([cell("name", "Acme"), cell("website", "https://acme.com")], 1, None)
    assert [r["entity_id"] for r in rank.pruned(planned(entities(spark, bad, good))).collect()] == ["e1"]
    assert rank.pruned(planned(entities(spark, bad, bad))).count() == 2


@pytest.mark.parametrize(("n", "query", "most"), [(25, "best startups", 15), (30, "startups", 20), (5, "best startups", 5)])
def test_caps(spark, n, query, most):
    e = entities(spark, *[([cell("name", f"Acme {i}"), cell("website", f"https://acme{i}.com")], 2, None) for i in range(n)])
    assert verify.verified(rank.ranked(scored(spark, e, query=query))).count() == most


def test_marketplaces_only_as_a_last_resort(spark):
    sold = ([cell("name", "A", "https://www.etsy.com/a", regime="marketplace_aggregator"), cell("price", "5", "https://www.etsy.com/a", regime="marketplace_aggregator")], 1, None)
    own = ([cell("name", "B"), cell("website", "https://b.com")], 2, "b.com")
    alone = verify.verified(rank.ranked(scored(spark, entities(spark, sold), query="best things")))
    both = verify.verified(rank.ranked(scored(spark, entities(spark, sold, own), query="best things")))
    assert alone.count() == 1 and [r["entity_id"] for r in both.collect()] == ["e1"]


def test_alignment(spark):
    e = entities(spark, ([cell("name", "Acme Corp"), cell("funding", "5M", snippet="Acme Corp raised 5M"), cell("headquarters", "Paris", snippet="Zeta is in Paris"), cell("focus_area", "AI", snippet="Acmee Corp does AI")], 1, None))
    r = align.penalized(e).first()
    assert [round(x["confidence"], 3) for x in r["cells"]] == [0.9, 0.9, 0.54, 0.9] and (r["cells_checked"], r["cells_penalized"]) == (3, 1)
    assert align.penalized(entities(spark, ([cell("funding", "5M")], 1, None))).first()["cells"][0]["confidence"] == 0.9


def test_official_site(spark):
    e = entities(spark, ([cell("name", "Lucali")], 1, None))
    pages = spark.createDataFrame(
        [("q", 0, "https://eater.com/best-pizza", "Lucali review: best pizza", "Lucali is good", "editorial_article"), ("q", 1, "https://lucali.com/contact", "Contact Lucali", "575 Henry St", "official_site")],
        "query_id string, page_pos int, url string, title string, cleaned_text string, regime string",
    )
    r = official.resolved(e, pages).first()
    assert r["canonical_domain"] == "lucali.com" and {x["col"]: x["value"] for x in r["cells"]}["website"] == "https://lucali.com/"
    refused = entities(spark, ([cell("name", "X"), cell("website", "https://www.yelp.com/biz/x")], 1, None))
    assert [x["col"] for x in official.resolved(refused, pages).first()["cells"]] == ["name"]


def test_gap_filling(spark):
    e = planned(entities(spark, ([cell("name", "Acme")], 1, None)), columns=("name", "website"))
    asked = gapfill.wanted(e)
    a = asked.first()
    assert a["missing"] == ["website"] and a["gap_queries"] == ['"Acme" startups', '"Acme" official website'] and a["official_urls"] == []
    schema = f"query_id string, row_pos long, regime string, regime_confidence double, page_pos int, draft_seq long, entity_name string, cells {schemas.CELLS}"
    got = spark.createDataFrame(
        [("q", 0, "directory_listing", 0.9, 0, 0, "Other", [cell("website", "https://other.com")]), ("q", 0, "unknown", 0.5, 1, 1, "Acme Inc", [cell("website", "https://late.com"), cell("name", "no")]),
         ("q", 0, "official_site", 0.7, 2, 2, "ACME", [cell("website", "https://acme.com")])], schema,
    )
    r = gapfill.filled(e, asked, got).first()
    assert r["gap_filled"] and {x["col"]: x["value"] for x in r["cells"]} == {"name": "Acme", "website": "https://acme.com"}


def test_extraction(spark):
    html = [
        ("https://github.com/acme/pizzadb", "<title>acme/pizzadb: a database</title><h1>pizzadb</h1><p>install this python package version 2, MIT license</p>"),
        ("https://lucali.com/", '<title>Lucali</title><script type="application/ld+json">{"@type":"Restaurant","name":"Lucali","telephone":"+1 718 858 4086","address":"575 Henry St"}</script>'),
        ("https://guide.org/list/x", "".join(f"<p><a href='https://p{i}.com/'>Pizza Place {chr(65 + i)}</a> at {i + 1} Main Street</p>" for i in range(15))),
    ]
    fetched = spark.createDataFrame([("q", i, u, "", h) for i, (u, h) in enumerate(html)], "query_id string, page_pos int, url string, title string, html string")
    columns = ("name", "website", "location", "license", "language_or_stack", "website_or_repo", "contact_or_booking")
    rows = extract.deterministic(acquire.parsed(fetched, least=0), plan(spark, columns)).orderBy("draft_seq").collect()
    values = [{x["col"]: x["value"] for x in r["cells"]} for r in rows]
    assert values[0] == {"name": "pizzadb", "website_or_repo": "https://github.com/acme/pizzadb", "website": "https://github.com/acme/pizzadb", "license": "MIT", "language_or_stack": "python"}
    assert values[1] == {"name": "Lucali", "website": "https://lucali.com", "location": "575 Henry St", "contact_or_booking": "+1 718 858 4086"}
    assert len(rows) == 2 + extract.CANDIDATES and values[2]["location"] == "1 Main Street"


def test_hits_and_cache(spark):
    hits = spark.createDataFrame([("q", 1, 0, "https://a.com/", "late", None), ("q", 0, 3, "https://A.com", "first", None), ("q", 0, 1, "https://a.com/x.pdf", "file", None)], schemas.HITS)
    assert [r["title"] for r in acquire.first_hits(hits).collect()] == ["first"]
    cache = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00', 1), ('a', timestamp'2024-01-02 12:00:00', 2), ('b', timestamp'2024-01-01 00:00:00', 3) as t(url, scraped_at, v)")
    found, missing = acquire.from_cache(spark.createDataFrame([("a",), ("b",), ("c",)], "url string"), cache, F.to_timestamp(F.lit("2024-01-03 00:00:00")))
    assert [(r["url"], r["v"]) for r in found.collect()] == [("a", 2)] and sorted(r[0] for r in missing.collect()) == ["b", "c"]


def events(spark):
    return spark.sql(
        """select * from values ('j', 1L, timestamp'2024-01-01 00:00:00', 'pending', 'queued', 'q', null, null), ('j', 3L, timestamp'2024-01-01 00:00:02', 'done', null, null, '{}', null),
        ('j', 2L, timestamp'2024-01-01 00:00:01', 'running', 'planning', null, null, null), ('k', 4L, timestamp'2024-01-01 00:00:03', 'running', 'search', 'z', null, null)
        as t(job_id, seq, ts, status, phase, query, result, error)"""
    )


def test_jobs_and_export(spark):
    state = jobs.state(events(spark))
    rows = {r["job_id"]: r for r in state.collect()}
    assert (rows["j"]["status"], rows["j"]["query"], rows["j"]["result"], rows["k"]["status"], rows["k"]["completed_at"]) == ("done", "q", "{}", "running", None)
    assert {r["job_id"]: r["status"] for r in jobs.recovered(state).collect()} == {"j": "done", "k": "failed"}
    assert export.exported(state, "j") == ("search_j.json", "{}")
    for job, kind in (("x", "unknown"), ("k", "unfinished")):
        with pytest.raises(export.ExportError) as e:
            export.exported(state, job)
        assert e.value.kind == kind


def test_streamed_states(spark, tmp_path):
    events(spark).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events(spark).schema).parquet(f"{tmp_path}/in")
    q = streams.states(stream).writeStream.outputMode("complete").format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["job_id"]: r["status"] for r in spark.table("states").collect()} == {"j": "done", "k": "running"}


def test_csv(spark):
    e = entities(spark, ([cell("name", 'A "quoted", name', confidence=0.456)], 1, None))
    r = rank.ranked(scored(spark, e, columns=("name", "website"))).withColumn("matches", F.array().cast(requirements._MATCHES))
    from cairn.functions import queries

    p = spark.createDataFrame([("q", "x", "x", "f", "t", ["name", "website"], [])], f"query_id string, query string, normalized_query string, family string, entity_type string, columns array<string>, requirements array<{queries.SPEC.simpleString()}>")
    lines = [x["line"] for x in export.csv_lines(export.responses(r, p)).orderBy("line_pos").collect()]
    assert lines[0] == "entity_id,name,name_source_url,name_confidence,website,website_source_url,website_confidence,sources_count,aggregate_confidence"
    assert lines[1] == 'e0,"A ""quoted"", name",https://a.org/p,0.46,,,,1,0.456'


def test_labels(spark):
    e = entities(spark, ([cell("name", "OpenAI Inc"), cell("website", "https://openai.com")], 1, None), ([cell("name", "DeepMind")], 1, None))
    expected = spark.createDataFrame([("q", 0, ["OpenAI"]), ("q", 1, ["Google DeepMind", "x"])], "query_id string, expected_pos long, names array<string>")
    fields = spark.createDataFrame([("q", 0, "website", ["openai.com"])], "query_id string, expected_pos long, col string, accepted array<string>")
    r = evaluate.label_metrics(e, expected, fields).first()
    assert (r["entity_precision"], r["entity_recall"], r["field_accuracy"], r["citation_presence_rate"]) == (1.0, 1.0, 1.0, 1.0)


def test_answers(spark):
    raw = ['{"entities":[{"entity_name":"A","cells":{"funding":{"value":"5M","evidence_snippet":"raised 5M","confidence":1.7},"x":{"value":"n/a","evidence_snippet":"s","confidence":1}}}]}', 'Sure:\n```json\n{"entities":[{"entity_name":"B","cells":{}}]}\n```', "nonsense"]
    df = spark.createDataFrame([("q", i * 10, "https://a.org", "t", x) for i, x in enumerate(raw)], "query_id string, draft_base long, url string, title string, answer string")
    rows = tables.drafts_of(df).orderBy("draft_seq").collect()
    assert [(r["entity_name"], {x["col"]: x["confidence"] for x in r["cells"]}) for r in rows] == [("A", {"name": 0.75, "funding": 1.0}), ("B", {"name": 0.75})]


def test_policy():
    now, slept = [0.0], []
    p = tables.Policy(attempts=3, clock=lambda: now[0], sleep=slept.append)
    calls = itertools.count()

    def flaky():
        if next(calls) < 2:
            raise TimeoutError
        return "answer"

    def broken():
        raise ConnectionError

    assert p.call([("a", flaky)]) == "answer" and len(slept) == 2
    assert p.call([("b", broken), ("a", lambda: "other")]) == "other" and not p.available("b")
    now[0] = 61.0
    assert p.available("b") and p.call([]) is None


def test_display(spark):
    e = entities(spark, ([cell("name", "A", "https://own.com/x"), cell("website", "https://own.com"), cell("x", "y", "https://www.yelp.com/biz")], 2, None), ([cell("name", "B"), cell("x", "y")], 1, None))
    r = rank.ranked(scored(spark, e)).orderBy("row_pos")
    found = [x[0] for x in r.select(display.badges(r)).collect()]
    assert found[0][2:] == ["2 src", "high conf", "official", "directory"] and found[1][-1] == "single-source"
    wide = spark.createDataFrame([(["notes", "b", "homepage", "name", "a", "site_url"],)], "columns array<string>")
    assert wide.select(display.columns_by_priority(F.col("columns"))).first()[0] == ["name", "homepage", "site_url", "b", "a", "notes"]
    rows = spark.createDataFrame([(0, 0, 0), (2, 2, 0), (2, 1, 1)], "requirements_total int, requirements_satisfied int, requirements_unknown int")
    assert [display.requirement_filter(rows, f).count() for f in ("all", "all-req", "2plus", "1plus")] == [3, 2, 2, 3]
