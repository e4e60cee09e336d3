"""Cell values: addresses, telephone numbers and ratings, checked and brought to a form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn import fixed
from cairn.functions import text, url
from cairn.functions.binding import let

BARE_DOMAIN = r"(?i)^(?!https?://)([a-z0-9][a-z0-9\-]{0,62}\.)+[a-z]{2,}(/.*)?$"
DATED = r"/20\d{2}/\d{1,2}/\d{1,2}/"


def _checked(value: Column, ok: Column) -> Column:
    return F.struct(value.alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"))


def curated(domain: Column) -> Column:
    """Whether a domain is a known editorial, directory or marketplace site."""
    return domain.isin(*fixed.EDITORIAL_DOMAINS, *fixed.DIRECTORY_DOMAINS, *fixed.MARKETPLACE_DOMAINS)


def _title(title: Column | None) -> Column:
    return F.lit("") if title is None else F.coalesce(F.lower(title), F.lit(""))


def article_page(address: Column, title: Column | None = None) -> Column:
    parts = url.segments(url.path(address))
    return (
        F.arrays_overlap(parts, F.array(*map(F.lit, fixed.VALUE_ARTICLE_SEGMENTS)))
        | F.lower(url.path(address)).rlike(DATED)
        | ((F.size(parts) >= 3) & F.exists(parts, lambda x: x.contains("-") & (F.length(x) >= 20)))
        | text.any_of(_title(title), fixed.VALUE_ARTICLE_TITLES)
    )


def directory_page(address: Column, title: Column | None = None) -> Column:
    return (
        F.arrays_overlap(url.segments(url.path(address)), F.array(*map(F.lit, fixed.VALUE_DIRECTORY_SEGMENTS)))
        | text.any_of(F.lower(url.query(address)), fixed.VALUE_DIRECTORY_PARAMETERS)
        | text.any_of(_title(title), fixed.VALUE_DIRECTORY_TITLES)
    )


def hub_page(address: Column) -> Column:
    """One short part of the path without dash and digit: about, menu, docs and the like."""
    parts = url.segments(url.path(address))
    one = F.element_at(parts, 1)
    return F.coalesce((F.size(parts) == 1) & ~one.contains("-") & ~one.rlike(r"\d") & F.length(one).between(2, 20), F.lit(False))


def url_like(value: Column) -> Column:
    web = F.lower(value).rlike("^https?://")
    return F.when(web, url.authority(value).contains(".")).otherwise(value.rlike(BARE_DOMAIN))


def website(value: Column, source_url: Column | None = None, source_title: Column | None = None, canonical_domain: Column | None = None) -> Column:
    """(value, ok): an entity's own address, brought to its homepage where it is an article or a hub."""
    source_url = F.lit(None).cast("string") if source_url is None else source_url
    source_title = F.lit("") if source_title is None else source_title
    canonical_domain = F.lit(None).cast("string") if canonical_domain is None else canonical_domain

    def checked(g: Column) -> Column:
        form, own = g["form"], g["own"]
        same = url.domain(g["source"]) == own
        of_others = same & (curated(url.domain(g["source"])) | directory_page(g["source"], g["title"]))
        refused = ~g["like"] | ~url.authority(form).contains(".") | (own == "") | curated(own) | of_others
        to_home = article_page(form, g["title"]) | hub_page(form) | F.coalesce(g["canonical"] == own, F.lit(False))
        return let(
            {"refused": F.coalesce(refused, F.lit(True)), "home": to_home},
            lambda h: _checked(F.when(h["refused"], g["value"]).when(h["home"], url.bare_homepage(form)).otherwise(form), ~h["refused"]),
        )

    def formed(g: Column) -> Column:
        whole = F.when(F.lower(g["trimmed"]).rlike("^https?://"), g["trimmed"]).otherwise(F.concat(F.lit("https://"), g["trimmed"]))
        return let({"form": url.normalized(whole), "value": g["value"], "like": url_like(g["trimmed"]), "source": g["source"], "title": g["title"], "canonical": g["canonical"]}, with_domain)

    def with_domain(g: Column) -> Column:
        return let({n: g[n] for n in ("form", "value", "like", "source", "title", "canonical")} | {"own": url.domain(g["form"])}, checked)

    given = {"value": value, "trimmed": F.trim(value), "source": F.coalesce(source_url, F.lit("")), "title": source_title, "canonical": canonical_domain}
    return let(given, formed)


def phone(value: Column) -> Column:
    return _checked(F.trim(value), F.length(F.regexp_replace(value, r"\D", "")) >= 7)


def rating(value: Column) -> Column:
    number = F.regexp_extract(value, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return _checked(F.trim(value), number.between(0, 10))


def validated(column: Column, value: Column, source_url: Column | None = None, source_title: Column | None = None, canonical_domain: Column | None = None) -> Column:
    """(value, ok) of a cell by the kind of its column; fillers are refused everywhere."""
    trimmed, kind = F.trim(value), F.lower(column)
    empty = F.coalesce(trimmed, F.lit("")) == ""
    filler = F.lower(trimmed).isin(*fixed.PLACEHOLDERS)
    return (
        F.when(empty | filler, _checked(value, F.lit(False)))
        .when(kind.isin(*fixed.WEBSITE_COLUMNS), website(trimmed, source_url, source_title, canonical_domain))
        .when(kind.isin(*fixed.PHONE_COLUMNS), phone(trimmed))
        .when(kind.isin(*fixed.RATING_COLUMNS), rating(trimmed))
        .otherwise(_checked(trimmed, F.lit(True)))
    )
