"""Literal cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import fuzzy, pages, queries, text, url, values
from cairn.functions.html import read
from cairn.operators import requirements, verify


def each(spark, inputs, build):
    """What ``build`` makes of each input, in order; inputs are values or tuples of a row's."""
    rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)]
    names = ["i", *"abcdefg"[: len(rows[0]) - 1]]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'i' else 'string'}" for n in names))
    return [r[0] for r in df.orderBy("i").select(build(*[F.col(n) for n in names[1:]])).collect()]


def test_urls(spark):
    given = ["HTTPS://Example.COM/Path/", "https://a.com/x?b=1#top", "http://a.com", " https://a.com/ ", "not a url", "", None]
    assert each(spark, given, url.normalized) == ["https://example.com/Path", "https://a.com/x?b=1", "http://a.com", "https://a.com", "not a url", "", ""]
    assert each(spark, ["https://www.A.com:80/x", "https://wwww.b.org", "x", None], url.domain) == ["a.com:80", "wwww.b.org", "", ""]
    good = {"https://a.com/x": True, "ftp://a.com": False, "https://a.com/f.PDF": False, "https://a.com/f.pdf?x=1": True, "https://netflix.com/": False, "https://linkedin.com/company/a": True, "HTTPS://a.com": False}
    assert each(spark, list(good), url.useful) == list(good.values())
    assert each(spark, ["https://github.com/a/b/c", "https://x.org/a", "mailto:x"], url.repository_root) == ["https://github.com/a/b", "https://x.org/", "mailto:x"]
    assert each(spark, ["https://a.com/x/|https://A.com/x|ftp://b|https://b.com"], lambda s: url.deduplicated(F.split(s, r"\|"))) == [["https://a.com/x/", "https://b.com"]]


def test_text(spark):
    assert each(spark, ["OpenAI, Inc.", "  Café   Ñandú! ", "a_b-c", ""], text.name_key) == ["openai inc", "café ñandú", "a_bc", ""]
    assert each(spark, ["abc", "aaa bbb ccc", " aaaaaaaa", "aaaaaaaaa", " a bbbbbbb"], lambda s: text.truncated(s, 6)) == ["abc", "aaa…", " aaaaa…", "aaaaaa…", " a…"]
    assert text.clean("ﬁ  x y\n😀z ") == "fi x y  z"
    assert text.cut("short") == ["short"]
    long = "One sentence here. " * 100
    parts = text.cut(long, 50, 10)
    assert all(len(p) <= 200 for p in parts) and parts[0].endswith(".") and len(text.cut(long, 50, 10, 2)) == 2
    assert text.cut("x" * 1000, 50, 60)[1] == "x" * 200  # an overlap larger than the window still advances


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("openai", "openai", True), ("openai inc", "openai", True), ("google deepmind", "deepmind google", True), ("acme corp", "acme", True), ("apple", "microsoft", False), ("", "x", False)],
)
def test_names(a, b, same):
    assert fuzzy.similar_keys(a, b) is same


def test_ratios():
    assert fuzzy.common_subsequence("abcbdab", "bdcaba") == 4
    assert fuzzy.ratio("", "") == 100 and fuzzy.partial_ratio("abc", "xxabcxx") == 100
    assert fuzzy.partial_ratio("lucali", "luccali") > 80 > fuzzy.partial_ratio("lucali", "zzzz")


def test_websites(spark):
    given = [("HTTPS://Lucali.COM/menu", None), ("lucali.com", None), ("www.lucali.com/about", None), ("robertaspizza", None), ("", None), ("https://x.com/about/#top", None),
             ("https://www.nytimes.com/2024/01/02/pizza", None), ("https://own.com/blog/our-story", "https://own.com/blog/our-story"), ("https://own.com/p", "https://own.com/directory/p")]
    found = each(spark, given, lambda v, s: values.website(v, s))
    assert [(r["value"], r["ok"]) for r in found] == [
        ("https://lucali.com", True), ("https://lucali.com", True), ("https://www.lucali.com", True), ("robertaspizza", False), ("", False), ("https://x.com", True),
        ("https://www.nytimes.com/2024/01/02/pizza", False), ("https://own.com", True), ("https://own.com/p", False),
    ]


def test_values(spark):
    fillers = ["N/A", "Not specified", "Unknown", "TBD", "None", "—", "?", "Coming Soon"]
    assert not any(r["ok"] for r in each(spark, fillers, lambda v: values.validated(F.lit("location"), v)))
    assert all(r["ok"] for r in each(spark, ["575 Henry St", "New York, NY"], lambda v: values.validated(F.lit("location"), v)))
    assert [r["ok"] for r in each(spark, ["+1 718 858 4086", "12-34"], lambda v: values.validated(F.lit("phone"), v))] == [True, False]
    assert [r["ok"] for r in each(spark, ["4.5 stars", "11", "good"], lambda v: values.validated(F.lit("rating"), v))] == [True, False, False]


def test_regimes(spark):
    given = {
        ("https://github.com/a/b", ""): ("software_repo_or_docs", 0.94),
        ("https://docs.x.io/", ""): ("software_repo_or_docs", 0.82),
        ("https://www.etsy.com/a", ""): ("marketplace_aggregator", 0.95),
        ("https://x.org/", "Book a table"): ("marketplace_aggregator", 0.78),
        ("https://x.org/2021/05/x", ""): ("editorial_article", 0.82),
        ("https://x.org/a-long-slug", ""): ("editorial_article", 0.82),
        ("https://x.org/companies", ""): ("directory_listing", 0.78),
        ("https://x.org/p?category=a", ""): ("directory_listing", 0.78),
        ("https://x.org/about", "About us"): ("official_site", 0.72),
        ("https://x.org/a/b", ""): ("unknown", 0.5),
    }
    found = each(spark, list(given), lambda u, t: pages.regime(u, t))
    assert [(r["regime"], r["confidence"]) for r in found] == list(given.values())
    own = each(spark, [("https://a.com/x", "https://www.a.com"), ("https://www.doordash.com/c", "https://a.com"), ("https://techcrunch.com/2024/01/x", None)], lambda u, o: pages.source(u, None, o))
    assert [(r["kind"], r["quality"]) for r in own] == [("official", 1.0), ("marketplace", 0.15), ("editorial", 0.82)]


def test_markup():
    page = """<html><head><title> A  Title </title><meta property="og:description" content="said"></head><body><nav>hidden</nav>
    <h2>Second</h2><h1>First</h1><h1>First</h1><p>Text <a href="tel:+1">call</a> <a href="mailto:a@b.c">m</a> <a href="/x">Pizza Place</a> end</p>
    <script type="application/ld+json">{"@graph": [{"@type": "Restaurant", "name": "Lucali", "address": {"streetAddress": "575 Henry St", "addressLocality": "Brooklyn"}, "offers": {"price": 5}}]}</script>
    <script type="application/ld+json">{broken</script></body>"""
    m = read(page, "https://x.org/a", lambda h: h.startswith("http"))
    assert (m["title"], m["headings"], m["meta_description"], m["tel_links"], m["mailto_links"], m["script_count"]) == ("A Title", ["First", "Second"], "said", ["+1"], ["a@b.c"], 2)
    assert m["json_ld_types"] == ["Restaurant"] and m["structured_data"][1]["address"] == "575 Henry St, Brooklyn" and m["structured_data"][1]["offers"] == "5"
    assert m["anchor_count"] == 1 and m["anchors"][2]["href"] == "https://x.org/x" and "Pizza Place" in m["anchors"][2]["parent_text"]
    assert "hidden" not in m["visible"] and m["visible"].startswith("Second First First Text call")
    assert read(None, None, bool)["visible"] == ""


def test_query_repair(spark):
    given = {
        "  top   pizza places in Brooklyn,, NY!!  ": "top pizza places in Brooklyn, NY",
        "best coffee shops in amhersrt MA": "best coffee shops in Amherst MA",
        "best restraunts in brookln": "best restaurants in Brooklyn",
        "tools for me": "tools for ME",
        "!!!": "!!!",
    }
    assert each(spark, list(given), queries.repaired) == list(given.values())


def test_families(spark):
    given = {
        "top pizza restaurants in Brooklyn": "place_venue",
        "AI startups in healthcare": "organization_company",
        "top open source databases for production use": "software_project",
        "best noise cancelling headphone brands": "product_offering",
        "notable climate researchers in 2024": "person_group",
        "interesting phenomena worth knowing": "generic_entity_list",
    }
    assert each(spark, list(given), queries.family) == list(given.values())
    types = each(spark, list(given), lambda s: queries.entity_type(s, queries.family(s)))
    assert types == ["pizza restaurant", "ai startup", "for production use", "cancelling headphone brand", "climate researcher", "phenomena worth knowing"]


def test_requirements(spark):
    found = each(spark, ["search engine startups in the US with funding > 10M", "open source tools", "companies founded before 1999 with less than 50 staff", "valuation at least 2 billion", "Series B firms"], queries.requirements)
    assert [[r["label"] for r in x] for x in found] == [
        ["Location: US", "Funding > 10M", "Stage: startup", "Topic: search engine"], ["License: open-source", "Topic: open source"],
        ["Founded before 1999", "Employees < 50"], ["Funding ≥ 2B"], ["Stage: Series B"],
    ]
    assert [r["operator"] for r in found[3]] == ["at_least"] and found[3][0]["target_value"] == "2B"
    wide = each(spark, ["search engine startups in the US with funding > 10M"], lambda s: queries.augmented(queries.template_columns(queries.family(s)), queries.requirements(s), queries.family(s)))
    assert wide[0][-1] == "funding"


def test_three_values(spark):
    numbers = each(spark, ["$2.5M raised", "$900K raised", "well funded", "10 members"], lambda s: requirements.compared(s, F.lit("greater_than"), F.lit("1M"), F.lit(True)))
    assert numbers == [True, False, None, True]  # the m of members counts as millions
    places = [("New York, NY", "us"), ("Berlin, Germany", "eu"), ("Berlin, Germany", "us"), ("Texas", "us"), ("Austin", "us"), ("CA", "canada")]
    # "us" is a part of "austin"; state names are no "us-..." word but contain none either
    assert each(spark, places, requirements.in_place) == [True, True, False, True, True, True]


def test_names_that_are_none(spark):
    cta = {"Check Availability": True, "Browse All": True, "Apply Now": True, "Mon-Fri 9am-5pm": True, "Open Daily": True, "Free Delivery": True, "Order of the Phoenix": False, "Book Club Cafe": False, "Lucali": False, "": False}
    assert each(spark, list(cta), verify.call_to_action) == list(cta.values())
    article = {"Best Pizza Places in Brooklyn": True, "Top 10 Startups to Watch": True, "The 7 Best Pizza Spots": True, "Best Buy": False, "Top Hat Lounge": False, "Leading Edge Technologies": False}
    assert each(spark, list(article), verify.article_title) == list(article.values())
    pseudo = {"AI Copilots & Agents for Psychiatry": True, "Cuts & Slices": False}
    assert each(spark, list(pseudo), lambda s: verify.pseudo_name(s, F.lit("organization_company"))) == list(pseudo.values())
