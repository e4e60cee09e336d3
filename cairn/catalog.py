"""Queries over the driver's tables: every operator on rows that stand in for its own.

Pages are pages.  Parts, suppliers and line items stand in for entities,
their cells and their evidence, events for jobs, names and turns for queries.
``cairn.oracle`` has the SQL that says what they return.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn import fixed, oracle, schemas
from cairn.functions import cells as c
from cairn.functions import html, pages, queries, text, url, values
from cairn.operators import acquire, align, display, evaluate, export, extract, gapfill, jobs, merge, official, plan, rank, requirements, rerank, verify
from cairn.plans import discovery
from cairn.sources.tables import LexicalSearch, TablePages, drafts_of
from cairn.storage import written
from cairn.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE = oracle.SQL


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- addresses ---------------------------------------------------------------------


@query
def url_normalize(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", url.normalized(F.col("url")).alias("norm_url"))


@query
def url_domain(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", url.domain(F.col("url")).alias("domain"))


@query
def url_useful(spark, sf_dir):
    """Addresses of pages, and the same with endings and hosts that are not useful."""
    u = F.col("url")
    forms = F.array(u, F.concat(u, F.lit(".pdf")), F.concat(u, F.lit(".PNG?x=1")), F.replace(u, F.lit("example"), F.lit("netflix")), F.concat(F.lit("ftp://"), u))
    return _table(spark, sf_dir, "pages").select("page_id", F.posexplode(forms).alias("form", "u")).select("page_id", "form", url.useful(F.col("u")).alias("useful"))


@query
def url_dedupe_first_wins(spark, sf_dir):
    hits = _table(spark, sf_dir, "pages").select(F.lit("q").alias("query_id"), F.lit(0).alias("angle_pos"), F.col("page_id").alias("hit_pos"), "url")
    return acquire.first_hits(hits).select(F.col("hit_pos").alias("page_id"), "url", "norm_url")


@query
def hits_union_first_wins(spark, sf_dir):
    """Three angles that find the same pages in other places."""
    p = _table(spark, sf_dir, "pages")
    q = F.concat(F.lit("q"), (F.col("page_id") % 5).cast("string")).alias("query_id")
    one = p.select(q, F.lit(2).alias("angle_pos"), F.col("page_id").alias("hit_pos"), "url")
    two = p.select(q, F.lit(1).alias("angle_pos"), (1000000 - F.col("page_id")).alias("hit_pos"), F.concat("url", F.lit("#again")).alias("url"))
    three = p.where("page_id % 3 = 0").select(q, F.lit(0).alias("angle_pos"), F.col("page_id").alias("hit_pos"), F.upper("url").alias("url"))
    return acquire.first_hits(one.unionByName(two).unionByName(three)).select("query_id", "norm_url", "angle_pos", "hit_pos")


@query
def domain_match_self_join(spark, sf_dir):
    d = _table(spark, sf_dir, "pages").select("page_id", url.domain(F.col("url")).alias("domain")).where("domain <> ''")
    a, b = d.alias("a"), d.alias("b")
    return a.join(b, F.expr("a.domain = b.domain and a.page_id < b.page_id")).select(F.col("a.page_id").alias("left_id"), F.col("b.page_id").alias("right_id"), "a.domain")


@query
def homepage_canonical(spark, sf_dir):
    u = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", url.homepage(u).alias("homepage"), url.bare_homepage(u).alias("bare_homepage"), url.repository_root(u).alias("root"))


@query
def path_segment_features(spark, sf_dir):
    u = F.col("url")
    return _table(spark, sf_dir, "pages").select(
        "page_id", F.size(url.segments(url.path(u))).alias("n_segments"), values.article_page(u).alias("article"), values.directory_page(u).alias("directory"), values.hub_page(u).alias("hub")
    )


@query
def website_normalize(spark, sf_dir):
    """Forms of a page's address as an entity's website."""
    u = F.col("url")
    forms = F.array(u, url.domain(u), F.concat(url.domain(u), F.lit("/about")), F.concat(F.lit("https://www.forbes.com"), url.path(u)), url.authority(F.lit("")), F.lit("n/a"), F.element_at(url.segments(url.path(u)), 1))
    rows = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(forms).alias("form", "v"))
    return rows.withColumn("w", values.validated(F.lit("website"), F.col("v"))).select("page_id", "form", F.col("w.value").alias("website"), F.col("w.ok").alias("ok"))


@query
def cell_values_validate(spark, sf_dir):
    """Telephone numbers, ratings, fillers and plain values."""
    forms = F.array(
        F.struct(F.lit("phone").alias("col"), F.concat(F.lit("+1 "), F.col("s_suppkey") * 7919).alias("v")),
        F.struct(F.lit("rating").alias("col"), F.concat((F.col("s_suppkey") % 14).cast("string"), F.lit(" of 10")).alias("v")),
        F.struct(F.lit("category").alias("col"), F.when(F.col("s_suppkey") % 3 == 0, "Unknown").otherwise(F.concat(F.lit(" "), "s_name", F.lit(" "))).alias("v")),
    )
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.inline(forms)).withColumn("x", values.validated(F.col("col"), F.col("v")))
    return rows.select("s_suppkey", "col", F.col("x.value").alias("value"), F.col("x.ok").alias("ok"))


# --- pages -------------------------------------------------------------------------


def _read_pages(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "pages").withColumn("m", html.metadata(F.col("html"), F.col("url")))


@query
def html_title_headings(spark, sf_dir):
    return _read_pages(spark, sf_dir).select("page_id", F.size("m.headings").alias("n_headings"), F.col("m.script_count").cast("long").alias("script_count"), F.size("m.json_ld_types").alias("n_types"))


@query
def html_anchor_counts(spark, sf_dir):
    return _read_pages(spark, sf_dir).select("page_id", F.size("m.anchors").cast("long").alias("n_anchors"))


@query
def html_visible_text(spark, sf_dir):
    return _read_pages(spark, sf_dir).select("page_id", "m.title", "m.visible", F.array_join("m.headings", "|").alias("headings"))


def _judged(spark, sf_dir) -> DataFrame:
    """Addresses that cover the kinds: the page's own, and paths and hosts of each kind."""
    u, home = F.col("url"), url.homepage(F.col("url"))
    forms = F.array(
        u, home, F.concat(home, F.lit("blog/a")), F.concat(home, F.lit("directory/x")), F.concat(home, F.lit("search?q=a")), F.concat(home, F.lit("docs/intro")),
        F.concat(home, F.lit("checkout")), F.lit("https://github.com/a/b"), F.lit("https://www.etsy.com/shop/a"), F.concat(home, F.lit("2021/05/x")),
    )
    return _table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(forms).alias("form", "address"))


@query
def page_regime_classify(spark, sf_dir):
    r = _judged(spark, sf_dir).withColumn("r", pages.regime(F.col("address")))
    return r.select("page_id", "form", F.col("r.regime").alias("regime"), F.col("r.confidence").alias("confidence"))


@query
def regime_profile_by_lang(spark, sf_dir):
    r = _judged(spark, sf_dir).withColumn("regime", pages.regime(F.col("address"))["regime"]).withColumn("lang", F.element_at(url.segments(url.path(F.col("url"))), 1))
    return r.groupBy("lang").agg(*[F.count_if(F.col("regime") == k).alias(k) for k in fixed.REGIMES])


@query
def source_kind_quality(spark, sf_dir):
    r = _judged(spark, sf_dir).withColumn("s", pages.source(F.col("address"), None, F.concat(F.lit("https://"), url.domain(F.col("url")), F.when(F.col("page_id") % 2 == 0, "").otherwise(".x"))))
    return r.select("page_id", "form", F.col("s.kind").alias("kind"), F.col("s.quality").alias("quality"))


@query
def page_needs_js(spark, sf_dir):
    """Pages cut to different lengths, with different numbers of scripts."""
    rows = _table(spark, sf_dir, "pages").select("page_id", "html", F.substring("html", 1, (F.col("page_id") % 400).cast("int")).alias("body"), (F.col("page_id") % 17).alias("scripts"))
    shell = F.concat("html", F.when(F.col("page_id") % 2 == 0, '<div id="app">').otherwise(""), F.when(F.col("page_id") % 5 == 0, "application/ld+json").otherwise(""))
    return rows.select("page_id", pages.needs_script(shell, F.col("body"), F.col("scripts")).alias("needs_js"))


@query
def js_budget(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select((F.col("page_id") % 9).alias("query_id"), F.col("page_id").alias("page_pos"), (F.col("page_id") % 4 == 0).alias("needs_js"))
    return acquire.rendering_budget(rows, 2)


# --- text --------------------------------------------------------------------------


@query
def text_normalize_name(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text.name_key(F.col("text")).cast("binary")).alias("name_key_md5"))


@query
def truncate_words(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.truncated(F.translate("text", "\n", " "), 120).alias("head"))


@query
def token_estimate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query
def clean_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.cleaned(F.col("text")).alias("cleaned"))


@query
def chunk_text_windows(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", text.chunks(F.col("text"), 300, 50, None).alias("chunks"))
    return rows.select("doc_id", F.posexplode("chunks").alias("pos", "chunk"))


@query
def lexical_rerank_topk(spark, sf_dir):
    """The ten best pages of queries: the words of benchmark items, over documents as pages.

    Candidates share a word with the query, so words meet in a join; a page
    without any has a score of 0 and comes last.
    """
    asked = _table(spark, sf_dir, "benchmark").select("item_id", text.words(F.col("text")).alias("wanted"))
    said = _table(spark, sf_dir, "documents").select("doc_id", F.explode(text.words(F.substring("text", 1, rerank.HEAD))).alias("word"))
    shared = asked.select("item_id", F.size("wanted").alias("n"), F.explode("wanted").alias("word")).join(said, "word").groupBy("item_id", "doc_id", "n").agg(F.count(F.lit(1)).alias("shared"))
    score = shared.withColumn("score", F.col("shared") / F.col("n"))
    best = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id"))
    return score.withColumn("pos", best).where("pos <= 10").select("item_id", "doc_id", "pos", "score")


# --- queries -----------------------------------------------------------------------


def _asked(spark, sf_dir) -> DataFrame:
    """Queries made of part names: with intents, kinds, places and requirements."""
    kinds = ("restaurants in Brooklyn", "startups in Germany with funding > 5M", "open source tools", "brands founded after 1999", "researchers", "ideas", "laptops", "companies with more than 50 employees", "hotels near the park in 2024")
    heads = ("best ", "", "Top ", "leading ", "must visit ")
    k = F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % len(kinds) + 1).cast("int"))
    h = F.element_at(F.array(*map(F.lit, heads)), (F.col("p_size") % len(heads) + 1).cast("int"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("query_id"), F.concat(h, "p_name", F.lit(" "), k).alias("query"))


@query
def query_tokens(spark, sf_dir):
    return _asked(spark, sf_dir).select("query_id", F.array_join(queries.tokens(queries.tidied(F.col("query"))), "|").alias("tokens"))


@query
def query_normalize(spark, sf_dir):
    q = F.replace("query", F.lit("Brooklyn"), F.lit("brookln,, ny!!"))
    return _asked(spark, sf_dir).select("query_id", queries.repaired(q).alias("normalized"))


@query
def query_family_classify(spark, sf_dir):
    return _asked(spark, sf_dir).select("query_id", queries.family(F.col("query")).alias("family"))


@query
def query_strict_flag(spark, sf_dir):
    return _asked(spark, sf_dir).select("query_id", queries.strict(F.col("query")).alias("strict"))


@query
def entity_type_derive(spark, sf_dir):
    return _asked(spark, sf_dir).withColumn("family", queries.family(F.col("query"))).select("query_id", queries.entity_type(F.col("query"), F.col("family")).alias("entity_type"))


@query
def plan_facets_explode(spark, sf_dir):
    p = _asked(spark, sf_dir).withColumn("family", queries.family(F.col("query")))
    f = p.select("query_id", F.posexplode(queries.facets(F.col("query"), F.col("family"), queries.template_columns(F.col("family")))).alias("pos", "f"))
    return f.select("query_id", "pos", F.col("f.type").alias("type"), F.col("f.query").alias("search"), F.array_join("f.expected_fill_columns", "|").alias("fill"))


@query
def requirements_parse(spark, sf_dir):
    r = _asked(spark, sf_dir).select("query_id", F.posexplode(queries.requirements(F.col("query"))).alias("pos", "r"))
    return r.select("query_id", "pos", "r.id", "r.label", "r.kind", "r.operator", "r.target_value", "r.is_hard")


@query
def plan_columns_augmented(spark, sf_dir):
    p = _asked(spark, sf_dir).withColumn("family", queries.family(F.col("query"))).withColumn("specs", queries.requirements(F.col("query")))
    wide = queries.augmented(queries.template_columns(F.col("family")), F.col("specs"), F.col("family"))
    return p.select("query_id", "family", F.array_join(wide, "|").alias("columns"))


# --- requirements ------------------------------------------------------------------


@query
def requirement_money_parse(spark, sf_dir):
    units = F.element_at(F.array(*map(F.lit, ("", "K", " million", "b raised", " members"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    said = F.concat(F.lit("$"), F.round(F.abs("c_acctbal"), 0).cast("long").cast("string"), units)
    return _table(spark, sf_dir, "customer").select("c_custkey", requirements.money(said).alias("amount"), requirements.number(said).alias("number"))


@query
def requirement_numeric_3vl(spark, sf_dir):
    said = F.when(F.col("c_custkey") % 7 == 0, "well funded").otherwise(F.concat(F.lit("raised $"), F.round(F.abs("c_acctbal"), 0).cast("long").cast("string"), F.lit("K")))
    ok = requirements.compared(said, F.lit("greater_than"), F.lit("5M"), F.lit(True))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.when(ok, "satisfied").when(~ok, "not_satisfied").otherwise("unknown").alias("status"))


#: Places for nations, by number.
_PLACES = ("New York, NY", "Berlin, Germany", "Austin", "Paris - France", "Toronto, Canada", "Texas", "Lisbon (Portugal)", "Tokyo", "London, England", "CA", "Boise, ID", "Sydney/Australia")


def _place(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _PLACES)), (key % len(_PLACES) + 1).cast("int"))


@query
def requirement_location_match(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"))
    rows = s.select("s_suppkey", _place(F.col("n_nationkey")).alias("place"), F.explode(F.array(*map(F.lit, ("us", "eu", "uk", "canada", "australia", "tokyo")))).alias("target"))
    return rows.select("s_suppkey", "place", "target", requirements.in_place(F.col("place"), F.col("target")).alias("matches"))


# --- entities ----------------------------------------------------------------------


def _cell(col: str, value: Column, source: Column, confidence: Column, snippet: Column | None = None, title: Column | None = None, when: Column | None = None) -> Column:
    made = F.struct(
        F.lit(col).alias("col"), value.alias("value"), source.alias("source_url"), (F.lit(None).cast("string") if title is None else title).alias("source_title"),
        (value if snippet is None else snippet).alias("evidence_snippet"), confidence.alias("confidence"), F.lit("unknown").alias("source_regime"),
    )
    return made if when is None else F.when(when, made)


def _entities(spark, sf_dir) -> DataFrame:
    """Suppliers as entities of eight queries, with some of six columns each."""
    k = F.col("s_suppkey")
    site = lambda n: F.concat(F.lit("https://s"), (k % n).cast("string"), F.lit(".example.org/p"))
    sure = lambda n: ((k * n) % 10) / 10.0
    cells = F.array(
        _cell("name", F.when(k % 11 == 0, "Company").otherwise(F.col("s_name")), site(3), sure(7), title=F.col("s_name"), when=k % 13 != 0),
        _cell("website", F.concat(F.lit("https://own"), k.cast("string"), F.lit(".example.net/")), site(5), sure(3), when=k % 2 == 0),
        _cell("headquarters", _place(F.col("s_nationkey")), site(2), sure(9), snippet=F.concat("s_name", F.lit(" is here")), when=k % 3 != 1),
        _cell("focus_area", F.concat(F.lit("AI search engine "), k.cast("string")), site(7), sure(1), when=k % 5 > 1),
        _cell("funding", F.concat(F.lit("$"), F.round(F.abs("s_acctbal"), 0).cast("long").cast("string"), F.lit("K")), site(2), sure(4), when=k % 4 != 3),
        _cell("description", F.lit("some words"), site(3), sure(6), when=k % 6 == 0),
    )
    rows = _table(spark, sf_dir, "supplier").withColumn("cells", F.filter(cells, lambda x: x.isNotNull()))
    return rows.select(
        F.concat(F.lit("q"), (k % 8).cast("string")).alias("query_id"), k.alias("row_pos"), merge.slug(F.col("s_name")).alias("entity_id"),
        F.size(F.array_distinct(F.transform("cells", lambda x: x["source_url"]))).cast("long").alias("sources_count"), F.bround(c.mean_confidence(F.col("cells")), 3).alias("aggregate_confidence"),
        F.when(k % 9 == 0, "own.example.net").alias("canonical_domain"), "cells",
    )


def _plans(spark) -> DataFrame:
    rows = [(f"q{i}", ("best " if i % 2 else "") + "search engine startups in the US with funding > 4M") for i in range(8)]
    return written(plan.plans(spark.createDataFrame(rows, "query_id string, query string")), "plans")


def _no_requirements(rows: DataFrame) -> DataFrame:
    return rows.withColumns({n: F.lit(0) for n in ("requirements_total", "requirements_satisfied", "requirements_unknown", "hard_failed")})


_COLUMNS = ("name", "website", "headquarters", "focus_area", "product_or_service", "stage_or_status", "funding")


def _planned(rows: DataFrame) -> DataFrame:
    """Entities with a fixed plan, for operators that need no more of it."""
    return rows.withColumns(
        {"columns": F.array(*map(F.lit, _COLUMNS)), "family": F.lit("organization_company"), "entity_type": F.lit("startup"), "query": F.lit("startups in New York 2024")}
    )


@query
def requirement_summary(spark, sf_dir):
    s = requirements.summarized(_entities(spark, sf_dir), _plans(spark))
    names = ("requirements_total", "requirements_satisfied", "requirements_failed", "requirements_unknown", "hard_satisfied", "hard_failed")
    return s.select("query_id", "row_pos", *[F.col(n).cast("long").alias(n) for n in names], "satisfaction_ratio")


@query
def requirement_hard_penalty(spark, sf_dir):
    rows = _no_requirements(_planned(_entities(spark, sf_dir))).withColumn("hard_failed", F.col("row_pos") % 6)
    s = rank.scored(rows, spark.createDataFrame([(f"q{i}",) for i in range(8)], "query_id string"), as_of_year=2024)
    return s.select(F.col("row_pos").alias("s_suppkey"), F.col("hard_failed").alias("failed"), "penalty")


def _evidence(spark, sf_dir) -> DataFrame:
    """Line items as drafts' cells: part is the entity, supplier the source, return flag the column, discount the confidence."""
    seq = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate"))
    rows = _table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_partkey").alias("entity"), seq.alias("seq"), F.col("l_returnflag").alias("col"), F.col("l_extendedprice").cast("string").alias("value"),
        F.concat(F.lit("https://s"), (F.col("l_suppkey") % 40).cast("string"), F.lit(".example.org/")).alias("source_url"),
        F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("evidence_snippet"), F.round(F.col("l_discount") * 10, 1).alias("confidence"),
    )


@query
def best_cell_ordered_fold(spark, sf_dir):
    cell = F.struct("value", "evidence_snippet", "confidence", "seq")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", cell.alias("cell")))), lambda x: x["cell"])
    best = _evidence(spark, sf_dir).groupBy("entity", "col").agg(c.folded(ordered).alias("b"))
    return best.select("entity", "col", F.col("b.seq").cast("long").alias("seq"), F.col("b.confidence").alias("confidence"), F.length("b.evidence_snippet").alias("size"))


def _drafts(spark, sf_dir) -> DataFrame:
    e = _evidence(spark, sf_dir).join(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), "p_name"), "entity")
    cell = F.struct(F.col("col"), "value", "source_url", F.lit(None).cast("string").alias("source_title"), "evidence_snippet", "confidence", F.lit("unknown").alias("source_regime"))
    key = F.col("entity").cast("long") * 100000 + F.col("seq")
    return e.select(
        F.concat(F.lit("q"), (F.col("entity") % 10).cast("string")).alias("query_id"), key.alias("draft_seq"), F.col("p_name").alias("entity_name"), "source_url",
        F.lit(None).cast("string").alias("source_title"), F.array(cell).cast(schemas.CELLS).alias("cells"),
    )


@query
def entity_cell_merge_exact(spark, sf_dir):
    """Drafts with equal names as one entity each."""
    drafts = _drafts(spark, sf_dir)
    plans = drafts.select("query_id").distinct().withColumn("columns", F.array(F.lit("R"), F.lit("N")))
    m = merge.merged(drafts, plans, merge.exact_clusters(drafts))
    return m.select("query_id", "row_pos", "entity_id", "sources_count", F.array_join(c.columns(F.col("cells")), "|").alias("columns"), F.array_join(F.transform("cells", lambda x: x["value"]), "|").alias("best_values"))


@query
def fuzzy_merge_entities(spark, sf_dir):
    """Drafts with similar names as one entity each, by the greedy merge: a query is one task."""
    drafts = _drafts(spark, sf_dir)
    plans = drafts.select("query_id").distinct().withColumn("columns", F.array(F.lit("R"), F.lit("N")))
    return merge.merged(drafts, plans, merge.clusters(drafts)).select("query_id", "row_pos", "entity_id", "sources_count", "aggregate_confidence")


@query
def source_diversity(spark, sf_dir):
    return _entities(spark, sf_dir).select("query_id", "row_pos", c.diversity(F.col("cells")).alias("diversity"))


@query
def source_support(spark, sf_dir):
    n = _table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n"))
    return n.select("l_partkey", "n", F.bround(rank.support(F.col("n")), 3).alias("support"))


@query
def source_quality_weighted(spark, sf_dir):
    return _entities(spark, sf_dir).select("query_id", "row_pos", rank.source_quality(F.col("cells")).alias("quality"))


@query
def completeness_field_importance(spark, sf_dir):
    e = _planned(_entities(spark, sf_dir))
    return e.select("query_id", "row_pos", F.bround(F.size("cells") / F.size("columns"), 3).alias("completeness"), rank.field_importance(F.col("cells"), F.col("columns"), F.col("family")).alias("importance"))


@query
def local_fit(spark, sf_dir):
    e = _planned(_entities(spark, sf_dir))
    return e.select("query_id", "row_pos", rank.local_fit(F.col("cells"), F.col("family"), F.lit("startups in New York NY")).alias("fit"))


@query
def freshness_as_of(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.struct(F.concat(F.lit("https://x.org/"), F.year("o_orderdate").cast("string"), F.lit("/a")).alias("source_url"), F.lit("t").alias("source_title"))).alias("cells"))
    return o.select("o_orderkey", rank.freshness(F.col("cells"), F.lit("latest news"), 2001).alias("freshness"), rank.freshness(F.col("cells"), F.lit("tools"), 2001).alias("neutral"))


def _scored(spark, sf_dir) -> DataFrame:
    return rank.scored(_no_requirements(_planned(_entities(spark, sf_dir))), spark.createDataFrame([(f"q{i}",) for i in range(8)], "query_id string"), as_of_year=2024)


@query
def ranking_weighted_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("query_id", "row_pos", "base_score", "penalty", "final_score")


@query
def ranking_with_requirements(spark, sf_dir):
    """Entities that meet, miss and leave open some of four requirements."""
    k = F.col("row_pos")
    rows = _planned(_entities(spark, sf_dir)).withColumns({"requirements_total": F.lit(4), "requirements_satisfied": k % 3, "requirements_unknown": k % 2, "hard_failed": k % 6})
    s = rank.scored(rows, spark.createDataFrame([(f"q{i}",) for i in range(8)], "query_id string"), as_of_year=2024)
    met = F.element_at(F.filter("components", lambda x: x["key"] == "requirement_satisfaction"), 1)["value"]
    return s.select("query_id", "row_pos", met.alias("met"), "base_score", "penalty", "final_score")


@query
def source_profiles(spark, sf_dir):
    """How many sources of each kind and regime an entity has."""
    e = _entities(spark, sf_dir)
    kinds = e.select("query_id", "row_pos", F.lit("kind").alias("by"), F.explode(rank.source_kinds(F.col("cells"))).alias("name"))
    regimes = e.select("query_id", "row_pos", F.lit("regime").alias("by"), F.explode(rank.source_kinds(F.col("cells"), regime=True)).alias("name"))
    return acquire.counters(kinds.unionByName(regimes), "query_id", "row_pos", "by", "name")


@query
def rank_topn(spark, sf_dir):
    r = rank.ranked(_scored(spark, sf_dir))
    return r.where("rank_position <= 5").select("query_id", "row_pos", F.col("rank_position").cast("long").alias("rank_position"), "final_score")


@query
def sparse_rows_topn(spark, sf_dir):
    s = rank.sparse(_scored(spark, sf_dir), 3)
    return s.select("query_id", "row_pos", F.col("missing").cast("long").alias("missing"), F.col("sparse_pos").cast("long").alias("sparse_pos"))


@query
def pruned_guarded(spark, sf_dir):
    """Obviously bad entities go; a query whose entities all are keeps them."""
    all_bad = F.when(F.col("query_id") == "q3", F.filter("cells", lambda x: x["col"] != "name")).otherwise(F.col("cells"))
    return rank.pruned(_planned(_entities(spark, sf_dir)).withColumn("cells", all_bad)).select("query_id", "row_pos")


@query
def final_cap_guarded(spark, sf_dir):
    """The cap of strict and other queries, and the guard where all are rejected."""
    r = rank.ranked(_scored(spark, sf_dir)).withColumn("query", F.when(F.col("query_id").isin("q1", "q5"), "best startups").otherwise("startups"))
    named = F.when(F.col("query_id") == "q2", F.transform("cells", lambda x: F.when(x["col"] == "name", x.withField("value", F.lit("Book Now"))).otherwise(x))).otherwise(F.col("cells"))
    v = verify.verified(r.withColumn("cells", named), most=6, most_strict=4)
    return v.select("query_id", "row_pos", F.col("rank_position").cast("long").alias("rank_position"))


_NAMES = ("Book Now", "Order of the Phoenix", "Check Availability", "Top 10 Startups to Watch", "Best Buy", "Open Daily", "AI Tools for Companies", "Lucali")


@query
def cta_article_filter(spark, sf_dir):
    name = F.concat(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int")), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise(""))
    rows = _table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", verify.call_to_action(F.col("name")).alias("cta"), verify.article_title(F.col("name")).alias("article"), verify.pseudo_name(F.col("name"), F.lit("organization_company")).alias("pseudo"))


@query
def verify_reject_reason(spark, sf_dir):
    named = F.transform("cells", lambda x: F.when(x["col"] == "name", x.withField("value", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("row_pos") % 8 + 1).cast("int")))).otherwise(x))
    e = _planned(_entities(spark, sf_dir)).withColumn("cells", named)
    return e.select("query_id", "row_pos", F.coalesce(verify.reject_reason(F.lit(True)), F.lit("ok")).alias("reason"))


@query
def cell_alignment_penalty(spark, sf_dir):
    """The exact tests only; the fuzzy one is tested on its own."""
    p = align.penalized(_entities(spark, sf_dir), fuzzily=False)
    return p.select("query_id", "row_pos", "aggregate_confidence", F.col("cells_checked").cast("long").alias("cells_checked"), F.col("cells_penalized").cast("long").alias("cells_penalized"))


@query
def cell_alignment_fuzzy(spark, sf_dir):
    return align.penalized(_entities(spark, sf_dir)).select("query_id", "row_pos", "aggregate_confidence", "cells_penalized")


@query
def official_site_argmax(spark, sf_dir):
    """Pages whose head names a host's first label, as the official pages of an entity of that name."""
    p = _table(spark, sf_dir, "pages").withColumn("label", F.element_at(F.split(url.domain(F.col("url")), r"\."), -3))
    body = html.metadata(F.col("html"), F.col("url"))["visible"]
    seen = p.select(F.lit("q").alias("query_id"), F.col("page_id").alias("page_pos"), url.homepage(F.col("url")).alias("url"), F.concat("label", F.lit(" official")).alias("title"), body.alias("cleaned_text"), F.lit("official_site").alias("regime"))
    names = p.groupBy("label").agg(F.min("page_id").alias("row_pos"))
    cell = F.array(_cell("name", F.col("label"), F.lit("https://a.org/"), F.lit(0.5))).cast(schemas.CELLS)
    e = names.select(F.lit("q").alias("query_id"), "row_pos", cell.alias("cells"), F.lit(None).cast("string").alias("canonical_domain"))
    return official.best_pages(e, seen).select("row_pos", "url", F.bround("score", 3).alias("score"))


# --- gaps --------------------------------------------------------------------------


@query
def missing_columns_except(spark, sf_dir):
    e = _planned(_entities(spark, sf_dir))
    return e.select("query_id", "row_pos", F.array_join(gapfill.missing(F.col("columns"), F.col("cells")), "|").alias("missing"))


@query
def gap_queries_build(spark, sf_dir):
    lacking = F.element_at(F.array(F.array(F.lit("website"), F.lit("license")), F.array(F.lit("some_field")), F.array().cast("array<string>")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(gapfill.gap_queries(F.col("p_name"), lacking, F.lit("tools")), "|").alias("searches"))


@query
def gap_page_priority(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", *[F.element_at(F.array(*map(F.lit, xs)), (F.col(k) % len(xs) + 1).cast("int")).alias(n) for n, k, xs in (("family", "p_partkey", tuple(fixed.FAMILY_TEMPLATES)), ("regime", "p_size", fixed.REGIMES))])
    return rows.select("p_partkey", "family", "regime", gapfill.page_priority(F.col("family"), F.col("regime")).cast("long").alias("priority"))


@query
def gap_fill_accept(spark, sf_dir):
    """Drafts of an entity's own name, its name with a suffix, and another name, from pages of three kinds."""
    e = _planned(_entities(spark, sf_dir))
    asked = gapfill.wanted(e)
    kinds = F.array(*[F.struct(F.lit(r).alias("regime"), F.lit(s).alias("suffix"), F.lit(i).alias("page_pos")) for i, (r, s) in enumerate((("directory_listing", ""), ("official_site", " Inc"), ("official_site", " other entirely"), ("marketplace_aggregator", "")))])
    cells = F.array(*[_cell(n, F.concat(F.lit(n + " of "), F.col("regime")), F.lit("https://g.org/"), F.lit(0.7)) for n in ("funding", "product_or_service")]).cast(schemas.CELLS)
    drafts = asked.select("query_id", "row_pos", "name", F.inline(kinds)).select(
        "query_id", "row_pos", "regime", F.lit(0.7).alias("regime_confidence"), "page_pos", F.col("page_pos").cast("long").alias("draft_seq"), F.concat("name", "suffix").alias("entity_name"), cells.alias("cells")
    )
    f = gapfill.filled(e, asked, drafts)
    return f.select("query_id", "row_pos", "gap_filled", F.array_join(F.transform("cells", lambda x: x["value"]), "|").alias("cell_values"))


@query
def directory_candidates_top12(spark, sf_dir):
    """The best links of pages, by their texts and addresses."""
    anchors = F.transform(F.regexp_extract_all("html", F.lit(r'<a href="(/[^"]*)">([^<]*)</a>'), F.lit(2)), lambda t: F.struct(t.alias("text"), F.concat(F.lit("https://x.org/"), t).alias("href"), F.lit("").alias("parent_text")))
    found = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(extract.directory_candidates(anchors)).alias("pos", "a"))
    return found.select("page_id", "pos", F.col("a.text").alias("text"), (-F.col("a.less")).alias("score"))


@query
def extract_drafts(spark, sf_dir):
    """Drafts that pages' own structure gives, with their homepages as official pages."""
    p = _table(spark, sf_dir, "pages").select(F.lit("q").alias("query_id"), F.col("page_id").alias("page_pos"), url.homepage(F.col("url")).alias("url"), F.lit("").alias("title"), "html")
    plans = written(plan.plans(spark.createDataFrame([("q", "startups in Berlin")], "query_id string, query string")), "plans")
    read = written(acquire.parsed(p, least=0), "pages")
    return extract.deterministic(read, plans).select("query_id", "draft_seq", "entity_name", F.array_join(c.columns(F.col("cells")), "|").alias("columns"))


@query
def page_drafts_sufficient(spark, sf_dir):
    """Whether pages of all regimes with up to three drafts of up to six cells need a model's answer."""
    k = F.col("page_id")
    rows = _table(spark, sf_dir, "pages").select(F.lit("q").alias("query_id"), k.cast("string").alias("url"), F.element_at(F.array(*map(F.lit, fixed.REGIMES)), (k % len(fixed.REGIMES) + 1).cast("int")).alias("regime"), "page_id")
    names = ("name", "website", "phone", "license", "location", "funding")
    cells = F.slice(F.array(*[_cell(n, F.lit(n), F.lit("https://a.org/"), F.lit(0.5)) for n in names]), F.lit(1), (k % 6).cast("int")).cast(schemas.CELLS)
    drafts = rows.select("query_id", F.col("url").alias("source_url"), cells.alias("cells"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"), "page_id").where(F.col("i") < k % 4)
    plans = spark.createDataFrame([("q", ["name", "website", "license", "location", "funding"])], "query_id string, columns array<string>")
    parts = [extract.sufficient(drafts, rows, plans, discover=d).select("url", F.lit(d).alias("discover"), "sufficient") for d in (True, False)]
    return parts[0].unionByName(parts[1])


@query
def drafts_within_pages(spark, sf_dir):
    """Three drafts of each page, two of them of one name."""
    k, at = F.col("page_id"), F.col("url")
    sure = lambda x: x.cast("double")
    draft = lambda i, name, *cells: F.struct(F.lit(i).alias("i"), F.lit(name).alias("entity_name"), F.array(*cells).cast(schemas.CELLS).alias("cells"))
    drafts = F.array(
        draft(0, "Zebra Quartz", _cell("funding", F.lit("f0"), at, F.lit(0.5)), _cell("website", F.lit("w0"), at, F.lit(0.7))),
        draft(1, "Mellow Harp", _cell("funding", F.lit("f1"), at, F.lit(0.9))),
        draft(2, "Zebra Quartz!", _cell("license", F.lit("l2"), at, F.lit(0.4)), _cell("funding", F.lit("f2"), at, sure(k % 10) / 10)),
    )
    rows = _table(spark, sf_dir, "pages").withColumn("url", k.cast("string")).select("page_id", "url", F.inline(drafts))
    own = rows.select(F.lit("q").alias("query_id"), (k.cast("long") * 10 + F.col("i")).alias("draft_seq"), "entity_name", F.col("url").alias("source_url"), F.lit(None).cast("string").alias("source_title"), "cells")
    return merge.within_pages(own).select("query_id", "draft_seq", "entity_name", F.array_join(F.transform("cells", lambda x: F.concat(x["col"], F.lit("="), x["value"])), "|").alias("cells"))


@query
def answers_to_drafts(spark, sf_dir):
    """Raw answers of a model about pages: plain, fenced and broken, with cells that are valid, invalid and without evidence."""
    k = F.col("page_id").cast("string")
    entry = lambda v, s, c_: F.struct(F.lit(v).alias("value"), F.lit(s).alias("evidence_snippet"), F.lit(c_).alias("confidence"))
    cells = F.create_map(F.lit("funding"), entry("$5M", "raised 5M", 1.5), F.lit("phone"), entry("12", "call 12", 0.9), F.lit("license"), entry("MIT", " ", 0.9))
    whole = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit(" Firm "), k).alias("entity_name"), cells.alias("cells"))).alias("entities")))
    answer = F.when(F.col("page_id") % 3 == 0, whole).when(F.col("page_id") % 3 == 1, F.concat(F.lit("Here it is: ```json\n"), whole, F.lit("\n``` as asked"))).otherwise(F.substring(whole, 1, 40))
    rows = _table(spark, sf_dir, "pages").select(F.lit("q").alias("query_id"), (F.col("page_id").cast("long") * 1000).alias("draft_base"), F.concat(F.lit("https://a.org/"), k).alias("url"), F.lit("t").alias("title"), answer.alias("answer"))
    said = F.transform("cells", lambda x: F.concat_ws("=", x["col"], x["value"], x["confidence"].cast("string")))
    return drafts_of(rows).select("query_id", "draft_seq", "entity_name", F.array_join(said, "|").alias("cells"))


# --- storage and jobs --------------------------------------------------------------


def _events(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "pending").otherwise("running")
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"), F.col("event_type").alias("phase"),
        F.when(F.col("event_id") % 7 == 0, F.col("props")).alias("query"), F.when(status == "done", F.col("props")).alias("result"), F.when(status == "failed", F.col("props")).alias("error"),
    )


@query
def job_latest_state(spark, sf_dir):
    return jobs.state(_events(spark, sf_dir))


@query
def job_recovery(spark, sf_dir):
    return jobs.recovered(jobs.state(_events(spark, sf_dir))).groupBy("status", "error").agg(F.count(F.lit(1)).alias("n"))


def _event_stream(spark, sf_dir) -> DataFrame:
    """The events as a stream; a pattern, as a stream's path has to be a folder or one."""
    return spark.readStream.schema(_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")


@query
def stream_job_states(spark, sf_dir):
    """Job states and hourly counts from the events as a stream."""
    events = _event_stream(spark, sf_dir)
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "pending").otherwise("running")
    log = events.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), F.col("event_type").alias("phase"))
    return streams.drained(streams.states(log), "states").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query
def stream_event_windows(spark, sf_dir):
    events = _event_stream(spark, sf_dir)
    log = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))
    found = streams.drained(streams.throughput(log, "6 hours"), "windows")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query
def upsert_latest_per_key(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return acquire.latest(e, ["user_id", "event_type"], "ts", "event_id")


@query
def cache_ttl_left_anti(spark, sf_dir):
    """Users as addresses: which have no page stored in the day before."""
    cache = _table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("url"), F.col("ts").alias("scraped_at"))
    wanted = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url")).distinct()
    return acquire.from_cache(wanted, cache, F.to_timestamp(F.lit("2024-01-20 00:00:00")))[1]


@query
def cache_lookup(spark, sf_dir):
    """Users as addresses on a day in the middle: those stored in the day before with their time, and the others."""
    now = "2024-01-15 12:00:00"
    e = _table(spark, sf_dir, "events")
    cache = e.where((F.col("event_type") == "purchase") & (F.col("ts") <= F.lit(now).cast("timestamp_ntz"))).select(F.col("user_id").cast("string").alias("url"), F.col("ts").alias("scraped_at"))
    found, missing = acquire.from_cache(e.select(F.col("user_id").cast("string").alias("url")).distinct(), cache, F.to_timestamp(F.lit(now)), hours=48)
    return found.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)), allowMissingColumns=True)


# --- sinks and evaluation ----------------------------------------------------------


def _response(spark, sf_dir) -> DataFrame:
    r = rank.ranked(_scored(spark, sf_dir)).withColumn("matches", F.array().cast(requirements._MATCHES))
    p = spark.createDataFrame([(f"q{i}",) for i in range(8)], "query_id string").select(
        "query_id", F.lit("startups").alias("query"), F.lit("startups").alias("normalized_query"), F.lit("organization_company").alias("family"), F.lit("startup").alias("entity_type"),
        F.array(*map(F.lit, _COLUMNS)).alias("columns"), F.array().cast(f"array<{queries.SPEC.simpleString()}>").alias("requirements"),
    )
    return export.responses(r, p)


@query
def csv_flatten(spark, sf_dir):
    return export.csv_lines(_response(spark, sf_dir))


@query
def json_nested(spark, sf_dir):
    return export.as_json(_response(spark, sf_dir))


@query
def eval_fill_metrics(spark, sf_dir):
    p = spark.createDataFrame([(f"q{i}",) for i in range(9)], "query_id string").withColumn("columns", F.array(*map(F.lit, _COLUMNS)))
    return evaluate.query_metrics(_entities(spark, sf_dir), p)


@query
def eval_label_prf(spark, sf_dir):
    """Suppliers' own names, and names nobody has, as expected entities."""
    e = _entities(spark, sf_dir)
    expected = e.where("row_pos % 4 = 0").select(
        "query_id", F.col("row_pos").alias("expected_pos"),
        F.array(F.when(F.col("row_pos") % 8 == 0, F.concat(F.lit("Supplier#"), F.lpad(F.col("row_pos").cast("string"), 9, "0"))).otherwise("nobody at all"), F.lit("")).alias("names"),
    )
    return evaluate.label_metrics(e, expected)


@query
def eval_run_summary(spark, sf_dir):
    p = spark.createDataFrame([(f"q{i}",) for i in range(8)], "query_id string").withColumn("columns", F.array(*map(F.lit, _COLUMNS)))
    durations = p.select("query_id", (F.substring("query_id", 2, 1).cast("double") * 1.5).alias("duration_seconds"))
    return evaluate.run_summary(evaluate.query_metrics(_entities(spark, sf_dir), p), durations)


# --- display -----------------------------------------------------------------------


@query
def display_confidence_bands(spark, sf_dir):
    """Bands of cells' confidences, and the columns' priorities."""
    x = _entities(spark, sf_dir).select("query_id", "row_pos", F.inline("cells"))
    return x.select("query_id", "row_pos", "col", display.confidence_band(F.col("confidence")).alias("band"), display.column_priority(F.col("col")).alias("priority"))


@query
def display_columns_sorted(spark, sf_dir):
    named = F.concat(F.array("p_type", F.lit("site_url"), F.lit("notes")), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("summary"), F.lit("name"))).otherwise(F.array(F.lit("homepage"))), F.array("p_brand", F.lit("founded")))
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(display.columns_by_priority(named), "|").alias("columns"))


@query
def display_short_urls(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", display.short_url(F.col("url"), 24).alias("shown"))


@query
def display_badges(spark, sf_dir):
    r = rank.ranked(_scored(spark, sf_dir))
    return r.select("query_id", "row_pos", F.array_join(display.badges(r), "|").alias("badges"))


@query
def display_requirement_filter(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", (k % 4).alias("requirements_total"), F.least(k % 3, k % 4).alias("requirements_satisfied"), F.lit(0).alias("requirements_unknown"))
    parts = [display.requirement_filter(rows, choice).select(F.lit(choice).alias("choice"), "s_suppkey") for choice in ("all", "all-req", "2plus", "1plus")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- whole runs --------------------------------------------------------------------


class _HostAnswers:
    """Stands in for a model: a page's answer is its host's label, with its homepage and first words."""

    def answers(self, chunks):
        u = F.col("url")
        entry = lambda v, s: F.struct(v.alias("value"), s.alias("evidence_snippet"), F.lit(0.7).alias("confidence"))
        head = F.substring("chunk", 1, 80)
        found = F.create_map(F.lit("website"), entry(url.homepage(u), url.homepage(u)), F.lit("focus_area"), entry(head, head))
        entity = F.struct(F.element_at(F.split(url.domain(u), r"\."), -3).alias("entity_name"), found.alias("cells"))
        return chunks.select("query_id", "url", "chunk_pos", F.to_json(F.struct(F.array(entity).alias("entities"))).alias("answer"))


@query
def discovery_pipeline(spark, sf_dir):
    """Queries of all page hosts' names over all pages, from hits to ranked entities.

    Pages keep their own addresses; of pages with one address the first counts.
    """
    rows = _table(spark, sf_dir, "pages").groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
    p = written(rows, "corpus")
    label = F.element_at(F.split(url.domain(F.col("url")), r"\."), -3)
    asked = p.select(label.alias("label")).distinct()
    q = asked.select(F.col("label").alias("query_id"), F.concat("label", F.lit(" companies in Berlin")).alias("query"))
    search = LexicalSearch(p.select("url", F.lit("").alias("title")))
    rows = discovery.run(q, search, TablePages(p), discovery.Options(as_of_year=2025), _HostAnswers())
    return rows.select("query_id", "rank_position", "entity_id", "final_score", "sources_count", "canonical_domain", "aggregate_confidence", F.to_json("cells").alias("cells"))
