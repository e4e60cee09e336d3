"""Kinds of pages and of sources, from address, title, text and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn import fixed
from cairn.functions import text, url
from cairn.functions.binding import let

_LONG_SLUG = r"[a-z0-9]+(?:-[a-z0-9]+){2,}"
_DATED = r"/(?:19|20)\d{2}/\d{1,2}/"


class Page:
    """What a page is judged by, from a struct of ``facts``."""

    def __init__(self, facts: Column, has_items: bool):
        self.domain, self.path, self.query, self.title = (facts[n] for n in ("domain", "path", "query", "title"))
        self.body, self.parts, self.types, self.anchors = (facts[n] for n in ("body", "parts", "types", "anchors"))
        self.items = facts["items"] if has_items else None

    def _typed(self, types) -> Column:
        return F.arrays_overlap(self.types, F.array(*map(F.lit, types)))

    def _part(self, names) -> Column:
        return F.arrays_overlap(self.parts, F.array(*map(F.lit, names)))

    def marketplace(self) -> Column:
        return (
            self.domain.isin(*fixed.PAGE_MARKETPLACE_DOMAINS)
            | text.any_of(self.title, fixed.PAGE_MARKETPLACE_TITLES)
            | text.any_of(F.lower(self.path), fixed.PAGE_MARKETPLACE_PATHS)
        )

    def software(self) -> Column:
        return (
            self.domain.isin(*fixed.REPOSITORY_DOMAINS)
            | self.domain.startswith("docs.")
            | text.any_of(self.title, fixed.PAGE_SOFTWARE_TITLES)
            | text.any_of(F.lower(self.path), fixed.PAGE_SOFTWARE_PATHS)
            | self._typed(fixed.SOFTWARE_TYPES)
            | (self.body.contains("install") & self.body.contains("package") & self.body.contains("version"))
        )

    def article(self) -> Column:
        slug = F.coalesce(F.element_at(F.reverse(self.parts), 1).rlike(_LONG_SLUG), F.lit(False))
        return (
            self._typed(fixed.ARTICLE_TYPES)
            | self._part(fixed.PAGE_ARTICLE_SEGMENTS)
            | self.path.rlike(_DATED)
            | F.when(F.size(self.parts) > 0, slug).otherwise(False)
            | text.any_of(self.title, fixed.PAGE_ARTICLE_TITLES)
        )

    def directory(self) -> Column:
        return (
            self._part(fixed.PAGE_DIRECTORY_SEGMENTS)
            | text.any_of(self.query, fixed.PAGE_DIRECTORY_PARAMETERS)
            | text.any_of(self.title, fixed.PAGE_DIRECTORY_TITLES)
            | (self.anchors >= 30)
        )

    def local_business(self) -> Column:
        filled = F.lit(False)
        if self.items is not None:
            some = lambda item, *names: F.coalesce(*[F.nullif(item[n], F.lit("")) for n in names]).isNotNull()
            filled = F.coalesce(F.exists(self.items, lambda x: some(x, "telephone", "address", "servesCuisine", "priceRange")), F.lit(False))
        contact = self.body.rlike(fixed.PHONE_PATTERN) & self.body.rlike("(?i)" + fixed.STREET_PATTERN)
        return self._typed(fixed.LOCAL_BUSINESS_TYPES) | filled | contact | text.any_of(self.body, fixed.HOURS_HINTS)

    def official(self) -> Column:
        return (
            ~self.domain.isin(*fixed.PAGE_MARKETPLACE_DOMAINS, *fixed.REPOSITORY_DOMAINS)
            & (F.size(self.parts) <= 1)
            & ~text.any_of(self.title, fixed.PAGE_DIRECTORY_TITLES)
        )


def facts(address: Column, title: Column | None, body: Column | None, metadata: Column | None) -> dict[str, Column]:
    """The values that a page is judged by; what is not given counts as absent."""
    low = lambda x: F.lit("") if x is None else F.coalesce(F.lower(x), F.lit(""))
    none = F.array().cast("array<string>")
    found = {
        "domain": url.domain(address),
        "path": F.when(url.path(address) == "", "/").otherwise(url.path(address)),
        "query": F.lower(url.query(address)),
        "title": low(title),
        "body": low(body),
        "parts": url.segments(url.path(address)),
        "types": none if metadata is None else F.coalesce(F.transform(metadata["json_ld_types"], lambda x: F.lower(F.trim(x))), none),
        "anchors": F.lit(0) if metadata is None else F.coalesce(metadata["anchor_count"], F.lit(0)),
    }
    return found if metadata is None else found | {"items": metadata["structured_data"]}


def regime(address: Column, title: Column | None = None, body: Column | None = None, metadata: Column | None = None) -> Column:
    """(regime, confidence): the first kind that fits."""

    def kind(name: str, confidence: Column | float) -> Column:
        return F.struct(F.lit(name).alias("regime"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"))

    def judged(given: Column) -> Column:
        p = Page(given, metadata is not None)
        return (
            F.when(p.marketplace(), kind("marketplace_aggregator", F.when(p.domain.isin(*fixed.PAGE_MARKETPLACE_DOMAINS), 0.95).otherwise(0.78)))
            .when(p.software(), kind("software_repo_or_docs", F.when(p.domain.isin(*fixed.REPOSITORY_DOMAINS), 0.94).otherwise(0.82)))
            .when(p.article(), kind("editorial_article", 0.82))
            .when(p.directory(), kind("directory_listing", 0.78))
            .when(p.local_business(), kind("local_business_listing", 0.8))
            .when(p.official(), kind("official_site", 0.72))
            .otherwise(kind("unknown", 0.5))
        )

    return let(facts(address, title, body, metadata), judged)


def needs_script(html: Column, body: Column, script_count: Column, least: int = 200) -> Column:
    """Whether a page that gave little text is a shell that scripts fill."""
    size, scripts = F.coalesce(F.length(body), F.lit(0)), F.coalesce(script_count, F.lit(0))
    return (size < least) & (
        (text.any_of(html, fixed.SHELL_MARKERS) & (scripts >= 5))
        | ((scripts >= 12) & (size < least // 2))
        | (html.contains("application/ld+json") & (size < least // 3))
    )


def regime_quality(kind: Column, adjustment: Column | float = 0.0) -> Column:
    quality = F.lit(fixed.REGIME_QUALITY["unknown"])
    for name, value in fixed.REGIME_QUALITY.items():
        quality = F.when(kind == name, value).otherwise(quality)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), quality + adjustment))


def source(address: Column, title: Column | None = None, official: Column | None = None, known_regime: Column | None = None) -> Column:
    """(kind, quality) of a source of an entity whose own address is ``official``; a known regime is not sought again."""
    own = F.lit(False) if official is None else F.coalesce(url.same_domain(address, official), F.lit(False))
    found = known_regime if known_regime is not None else regime(address, title)["regime"]
    head = F.lit("") if title is None else F.coalesce(F.lower(title), F.lit(""))

    def kind(name: str, quality) -> Column:
        return F.struct(F.lit(name).alias("kind"), (quality if isinstance(quality, Column) else F.lit(quality)).alias("quality"))

    def judged(s: Column) -> Column:
        site, found, head = s["site"], s["found"], s["head"]
        high, low = text.any_of(head, fixed.HIGH_SIGNAL_TITLES), text.any_of(head, fixed.LOW_SIGNAL_TITLES)
        docs = text.any_of(head, ("docs", "documentation"))
        software = F.when(site.isin(*fixed.REPOSITORY_DOMAINS), 0.86).otherwise(0.8) + F.when(docs, 0.03).otherwise(0.0)
        rest = F.when(high, 0.05).otherwise(0.0) + F.when(low, -0.08).otherwise(0.0)
        return (
            F.when(s["own"], kind("official", 1.0))
            .when(site.isin(*fixed.MARKETPLACE_DOMAINS) | (found == "marketplace_aggregator"), kind("marketplace", 0.15))
            .when(found == "software_repo_or_docs", kind("unknown", software))
            .when(found == "local_business_listing", kind("directory", F.when(site.isin(*fixed.DIRECTORY_DOMAINS), 0.72).otherwise(0.7)))
            .when(found == "editorial_article", kind("editorial", F.when(site.isin(*fixed.EDITORIAL_DOMAINS), 0.82).otherwise(0.72)))
            .when(found == "directory_listing", kind("directory", F.when(site.isin(*fixed.DIRECTORY_DOMAINS), 0.62).otherwise(0.58)))
            .when(found == "official_site", kind("unknown", F.lit(0.72) + F.when(high, 0.05).otherwise(0.0)))
            .when(site.isin(*fixed.EDITORIAL_DOMAINS), kind("editorial", 0.8))
            .when(site.isin(*fixed.DIRECTORY_DOMAINS), kind("directory", 0.6))
            .otherwise(kind("unknown", regime_quality(found, rest)))
        )

    return let({"site": url.domain(address), "found": found, "head": head, "own": own}, judged)
