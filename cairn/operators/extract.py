"""Drafts of entities from pages whose structure says enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import fixed, schemas
from cairn.functions import cells as c
from cairn.functions import pages as page_kinds
from cairn.functions import text, url, values

CANDIDATES = 12
_ITEM = ", ".join(": ".join(part.split(" ", 1)) for part in schemas.ITEM.split(", "))

def _blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def snippet(body: Column, title: Column, needle: Column, fallback: Column) -> Column:
    """The text around the first place of a value, or the value itself."""
    place = F.position(F.lower(needle), F.lower(body))
    start = F.greatest(place - 40, F.lit(1))
    around = F.trim(F.substring(body, start, place + F.length(needle) + 80 - start))
    found = (_blank(needle) != "") & (place > 0)
    said = F.coalesce(F.nullif(_blank(fallback), F.lit("")), F.nullif(_blank(title), F.lit("")), F.substring(body, 1, 140))
    return text.truncated(F.when(found, around).otherwise(said), 200)


def candidate(columns: str | tuple[str, ...], value: Column, confidence: float, hint: Column | None = None) -> list[Column]:
    names = (columns,) if isinstance(columns, str) else columns
    return [F.struct(F.lit(n).alias("col"), value.alias("value"), (value if hint is None else hint).alias("hint"), F.lit(confidence).alias("confidence")) for n in names]


def accepted(candidates: Column, columns: Column, page_url: Column, title: Column, body: Column) -> Column:
    """The candidates that the plan has a column for and that are valid, as cells."""

    def checked(x: Column) -> Column:
        v = values.validated(x["col"], x["value"], page_url, F.nullif(title, F.lit("")))
        return F.struct(x["col"].alias("col"), x["hint"].alias("hint"), x["confidence"].alias("confidence"), v.alias("v"))

    def made(x: Column) -> Column:
        return F.struct(
            x["col"].alias("col"), x["v"]["value"].alias("value"), page_url.alias("source_url"), F.nullif(title, F.lit("")).alias("source_title"),
            snippet(body, title, x["hint"], x["hint"]).alias("evidence_snippet"), x["confidence"].alias("confidence"), F.col("url_regime").alias("source_regime"),
        )

    wanted = F.filter(candidates, lambda x: F.array_contains(columns, x["col"]) & (_blank(x["value"]) != ""))
    return F.transform(F.filter(F.transform(wanted, checked), lambda x: x["v"]["ok"]), made)


class _Page:
    """What is read off a page."""

    def __init__(self):
        self.url, self.title, self.body = F.col("url"), F.col("title"), F.col("cleaned_text")
        self.meta = F.col("metadata")
        self.items = F.coalesce(self.meta["structured_data"], F.array().cast(f"array<struct<{_ITEM}>>"))

    def item_name(self) -> Column:
        return F.get(F.filter(F.transform(self.items, lambda i: _blank(i["name"])), lambda n: n != ""), F.lit(0))

    def title_head(self) -> Column:
        head = _blank(self.title)
        options = [F.when(head.contains(d), F.nullif(F.trim(F.substring_index(head, d, 1)), F.lit(""))) for d in (" | ", " - ", " :: ", " — ", ": ")]
        return F.coalesce(*options, F.trim(head))

    def name(self) -> Column:
        repo = url.owner_and_name(self.url)
        filled = lambda x: F.nullif(x, F.lit(""))
        return F.coalesce(self.item_name(), filled(F.get(self.meta["headings"], F.lit(0))), filled(self.title_head()), filled(repo["name"]), filled(repo["owner"]), url.domain(self.url))

    def description(self) -> Column:
        return _blank(self.meta["meta_description"])

    def first_sentence(self) -> Column:
        body = _blank(self.body)
        ends = [F.when(body.contains(s), F.trim(F.substring_index(body, s, 1))) for s in (". ", "! ", "? ")]
        return F.coalesce(*ends, F.trim(F.substring(body, 1, 180)))

    def summary(self) -> Column:
        return F.coalesce(F.nullif(self.description(), F.lit("")), self.first_sentence())

    def phone(self) -> Column:
        return F.coalesce(F.nullif(F.get(self.meta["tel_links"], F.lit(0)), F.lit("")), F.regexp_extract(_blank(self.body), fixed.PHONE_PATTERN, 0))

    def address(self) -> Column:
        given = F.get(F.filter(F.transform(self.items, lambda i: _blank(i["address"])), lambda a: a != ""), F.lit(0))
        return F.coalesce(given, F.regexp_extract(_blank(self.body), "(?i)" + fixed.STREET_PATTERN + r"[^.;]{0,50}", 0))

    def language(self) -> Column:
        said = F.lower(F.concat_ws(" ", self.title, self.description(), F.substring(_blank(self.body), 1, 600)))
        return F.coalesce(*[F.when(said.contains(x), F.lit(x)) for x in fixed.LANGUAGES], F.lit(""))


def _software(p: _Page) -> tuple[Column, list[Column]]:
    repo, use = url.owner_and_name(p.url), F.col("__summary")
    name = F.when((repo["name"] != "") & F.lower(p.title).contains(F.lower(repo["name"])), repo["name"]).otherwise(F.col("__name"))
    license_ = F.regexp_extract(_blank(p.body), "(?i)" + fixed.LICENSE_PATTERN, 0)
    return name, [
        *candidate("name", name, 0.9),
        *candidate(("website_or_repo", "website", "url", "homepage", "site"), url.repository_root(p.url), 0.92),
        *candidate("maintainer_or_org", repo["owner"], 0.82),
        *candidate("license", license_, 0.78),
        *candidate("language_or_stack", p.language(), 0.74),
        *candidate("primary_use_case", use, 0.7),
        *candidate(("key_feature", "description"), use, 0.68),
    ]


def _local(p: _Page) -> tuple[Column, list[Column], Column]:
    types = lambda i: F.transform(i["type"], F.lower)
    local = F.array(*map(F.lit, fixed.LOCAL_ITEM_TYPES))
    fits = F.filter(p.items, lambda i: F.arrays_overlap(types(i), local) | (_blank(i["telephone"]) != "") | (_blank(i["address"]) != ""))
    item = F.get(fits, F.lit(0))
    name = F.coalesce(F.nullif(item["name"], F.lit("")), F.col("__name"))
    other = F.array_join(F.slice(F.filter(item["type"], lambda t: ~F.lower(t).isin(*fixed.LOCAL_ITEM_TYPES)), 1, 2), ", ")
    phone = F.coalesce(F.nullif(item["telephone"], F.lit("")), p.phone())
    return name, [
        *candidate("name", name, 0.9),
        *candidate(("website", "url", "homepage", "site", "website_or_profile"), F.coalesce(F.nullif(item["url"], F.lit("")), url.homepage(p.url)), 0.9),
        *candidate(("location", "address", "headquarters"), item["address"], 0.86),
        *candidate(("phone", "phone_number", "telephone", "contact_or_booking"), phone, 0.84),
        *candidate("category", F.coalesce(F.nullif(item["servesCuisine"], F.lit("")), other), 0.74),
        *candidate("offering", F.coalesce(F.nullif(item["description"], F.lit("")), item["servesCuisine"]), 0.72),
        *candidate("price_or_availability", F.coalesce(F.nullif(item["priceRange"], F.lit("")), item["offers"]), 0.7),
    ], item.isNotNull()


def _official(p: _Page) -> tuple[Column, list[Column]]:
    return F.col("__name"), [
        *candidate("name", F.col("__name"), 0.86),
        *candidate(("website", "url", "homepage", "site", "website_or_profile", "website_or_repo"), url.homepage(p.url), 0.9),
        *candidate(("location", "address", "headquarters"), p.address(), 0.8),
        *candidate(("phone", "phone_number", "telephone", "contact_or_booking"), p.phone(), 0.82),
        *candidate(("description", "overview", "summary", "focus_area", "product_or_service", "offering"), F.col("__summary"), 0.68),
    ]


def anchor_score(said: Column, href: Column, parent: Column) -> Column:
    """How much a link's text looks like an entity's name."""
    low = F.lower(said)
    plus = lambda test, n: F.when(test, n).otherwise(0.0)
    score = (
        plus(F.size(F.split(F.trim(said), r"\s+")) >= 2, 1.0)
        + plus(F.length(said) <= 40, 0.5)
        + plus(F.substring(said, 1, 2).rlike(r"\p{Lu}"), 0.5)
        + plus(url.domain(href) != "", 0.25)
        + plus((_blank(parent) != "") & (F.length(parent) > F.length(said)), 0.25)
        + plus(low.rlike(r"^[a-z0-9][a-z0-9 .,'&+\-]{1,79}$"), 0.25)
        + plus(low.rlike("^(read|view|see|learn) "), -1.0)
    )
    return F.when(low.isin(*fixed.NAVIGATION_TEXTS), -10.0).otherwise(score)


def directory_candidates(anchors: Column, most: int = CANDIDATES) -> Column:
    """(score, text, href, parent_text) of the best links, each text once, ties in the order of the page."""
    fits = F.filter(anchors, lambda a: F.length(a["text"]).between(3, 80) & url.useful(a["href"]))
    scored = F.transform(
        fits,
        lambda a, i: F.struct((-anchor_score(a["text"], a["href"], a["parent_text"])).alias("less"), i.alias("pos"), a["text"].alias("text"), a["href"].alias("href"), a["parent_text"].alias("parent_text")),
    )
    good = F.filter(scored, lambda a: a["less"] <= -1.0)
    keys = F.transform(good, lambda a: F.lower(a["text"]))
    once = F.filter(good, lambda a, i: F.array_position(keys, F.lower(a["text"])) == i + 1)
    return F.slice(F.array_sort(once), 1, most)


def deterministic(pages: DataFrame, plans: DataFrame, *, discover: bool = True) -> DataFrame:
    """Drafts of pages by their regime; directories give several if ``discover``."""
    p, columns = _Page(), F.col("columns")
    kinds = page_kinds.regime(F.col("url"), F.col("title"))["regime"]
    read = pages.withColumns({"url_regime": kinds, "__name": p.name(), "__summary": p.summary()})
    joined = read.join(plans.select("query_id", "columns"), "query_id")
    soft_name, soft = _software(p)
    local_name, local, has_item = _local(p)
    own_name, own = _official(p)
    regime = F.col("regime")
    is_local = (regime == "local_business_listing") & F.coalesce(has_item, F.lit(False))
    kind = F.when(regime == "software_repo_or_docs", "software").when(is_local, "local").when(regime == "official_site", "official")
    if discover:
        kind = kind.when(regime.isin("directory_listing", "local_business_listing"), "directory")
    routed = joined.withColumn("__kind", kind).where("__kind is not null")

    def whole(name: str, entity: Column, candidates: list[Column]) -> DataFrame:
        rows = routed.where(F.col("__kind") == name)
        made = rows.select(
            "query_id", "page_pos", F.lit(0).alias("pos"), F.trim(entity).alias("entity_name"), "url", "title", "url_regime",
            accepted(F.array(*candidates), columns, p.url, p.title, p.body).alias("cells"),
        )
        return made.where(_blank(F.col("entity_name")) != "")

    listed = routed.where("__kind = 'directory'").select("*", F.posexplode(directory_candidates(p.meta["anchors"])).alias("pos", "found"))
    said, href = F.col("found.text"), F.col("found.href")
    other = F.when((url.domain(href) != "") & (url.domain(href) != url.domain(p.url)), href)
    street = F.regexp_extract(F.col("found.parent_text"), "(?i)" + fixed.STREET_PATTERN + r"[^.;]{0,50}", 0)
    options = F.array(
        *candidate("name", said, 0.78),
        *candidate(("website", "url", "homepage", "site", "website_or_profile", "website_or_repo"), other, 0.72),
        *candidate(("location", "address", "headquarters"), street, 0.68),
    )
    from_list = listed.select("query_id", "page_pos", "pos", said.alias("entity_name"), "url", "title", "url_regime", accepted(options, columns, p.url, p.title, p.body).alias("cells"))
    drafts = whole("software", soft_name, soft).unionByName(whole("local", local_name, local)).unionByName(whole("official", own_name, own)).unionByName(from_list)
    return named(drafts)


def named(drafts: DataFrame) -> DataFrame:
    """Drafts with a name cell, and a place in their query: by page, then within it."""
    own = F.struct(
        F.lit("name").alias("col"), F.col("entity_name").alias("value"), F.col("url").alias("source_url"), F.nullif("title", F.lit("")).alias("source_title"),
        text.truncated(F.col("entity_name"), 160).alias("evidence_snippet"), F.lit(0.82).alias("confidence"), F.col("url_regime").alias("source_regime"),
    )
    cells = F.when(c.has(F.col("cells"), "name"), F.col("cells")).otherwise(F.concat("cells", F.array(own)))
    seq = F.col("page_pos").cast("long") * 1000 + F.col("pos")
    return drafts.select("query_id", seq.alias("draft_seq"), "entity_name", F.col("url").alias("source_url"), F.nullif("title", F.lit("")).alias("source_title"), cells.alias("cells"))


def sufficient(drafts: DataFrame, pages: DataFrame, plans: DataFrame, *, discover: bool = True) -> DataFrame:
    """(query_id, url, sufficient): whether a page's own drafts make a model's answer needless."""
    filled = F.size(F.filter("cells", lambda x: x["col"] != "name"))
    per_page = drafts.groupBy("query_id", F.col("source_url").alias("url")).agg(
        F.count(F.lit(1)).alias("n"), F.max(filled).alias("best"), F.array_distinct(F.flatten(F.collect_list(c.columns(F.col("cells"))))).alias("has")
    )
    target = F.greatest(F.lit(1), F.size(F.filter("columns", lambda x: x != "name")))
    joined = pages.select("query_id", "url", "regime").join(plans.select("query_id", "columns"), "query_id").join(per_page, ["query_id", "url"], "left")
    cover, any_of = F.col("best") / target, lambda *n: F.arrays_overlap("has", F.array(*map(F.lit, n)))
    listing = F.col("regime").isin("directory_listing", "local_business_listing") & (F.col("n") >= 2)
    fill = (
        F.when(F.col("regime") == "software_repo_or_docs", (cover >= 0.4) | any_of("website_or_repo", "license", "maintainer_or_org"))
        .when(F.col("regime").isin("official_site", "local_business_listing"), (cover >= 0.4) | any_of("website", "url", "homepage", "location", "phone", "contact_or_booking"))
        .otherwise(cover >= 0.5)
    )
    enough = (listing | (F.col("best") >= 2)) if discover else fill
    return joined.select("query_id", "url", F.coalesce(enough, F.lit(False)).alias("sufficient"))
