"""Free-text queries: repair, family, plan and requirements."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn import fixed
from cairn.functions import fuzzy, text

# --- repair ------------------------------------------------------------------------

_SINGLE_LOCATIONS = {x.lower(): x for x in fixed.KNOWN_LOCATIONS if " " not in x}


def tidied(q: Column) -> Column:
    """Repeated marks single, commas with one space after, no marks at the ends."""
    for pattern, to in ((r"[!?]{2,}", "?"), (r"\.{2,}", "."), (r",{2,}", ","), (r"\s*,\s*", ", "), (r"\s+", " ")):
        q = F.regexp_replace(q, pattern, to)
    return F.regexp_replace(q, r"^[ ,.;:\-]+|[ ,.;:\-]+$", "")


def tokens(q: Column) -> Column:
    """Words with an apostrophe at most, numbers and commas."""
    return F.regexp_extract_all(q, F.lit(r"[A-Za-z]+(?:'[A-Za-z]+)?|[0-9]+|[,]"), F.lit(0))


def _is_state(parts: list[str], i: int) -> bool:
    token, low = parts[i], parts[i].lower()
    if low not in fixed.STATES:
        return False
    if token.isupper():
        return True
    before, after = parts[i - 1] if i else None, parts[i + 1] if i + 1 < len(parts) else None
    by_comma = before == "," or after == ","
    if low in fixed.AMBIGUOUS_STATES:
        return by_comma or (after is None and before not in fixed.REPAIR_PREPOSITIONS)
    return by_comma or after is None


def _repaired(parts: list[str], i: int) -> str:
    token, low = parts[i], parts[i].lower()
    if token == ",":
        return token
    if _is_state(parts, i):
        return low.upper()
    if low in fixed.TOKEN_FIXES:
        return fixed.TOKEN_FIXES[low]
    before, after = (parts[i - 1] if i else "").lower(), (parts[i + 1] if i + 1 < len(parts) else "").lower()
    if len(token) >= 5 and token.isalpha() and (before in fixed.REPAIR_PREPOSITIONS or after in fixed.STATES):
        near = fuzzy.close_match(low, list(_SINGLE_LOCATIONS), fixed.REPAIR_CUTOFF)
        if near:
            return _SINGLE_LOCATIONS[near]
    return _SINGLE_LOCATIONS.get(low, token)


@F.pandas_udf(T.StringType())
def _rejoined(parts: pd.Series) -> pd.Series:
    def one(p) -> str:
        p = list(p)
        return re.sub(r"\s+", " ", " ".join(_repaired(p, i) for i in range(len(p))).replace(" ,", ",")).strip()

    return parts.map(one)


def repaired(q: Column) -> Column:
    """The query with known misspellings, states and places set right; itself if nothing is left."""
    original = F.trim(q)
    done = _rejoined(F.coalesce(tokens(tidied(original)), F.array().cast("array<string>")))
    return F.coalesce(F.nullif(done, F.lit("")), original)


# --- family and plan ---------------------------------------------------------------


def _signal(q: Column, names, phrases=()) -> Column:
    found = q.rlike("(?<![a-z])(?:" + "|".join(re.escape(n) for n in names) + ")(?![a-z])")
    for p in phrases:
        found = found | q.contains(p)
    return found


def has_location(q: Column) -> Column:
    return q.rlike(" (" + "|".join(fixed.LOCATION_WORDS) + ") ")


def family(query: Column) -> Column:
    """The kind of entities that a query asks for."""
    q = F.lower(query)
    software, place = _signal(q, fixed.SOFTWARE_SIGNALS, fixed.SOFTWARE_PHRASES), _signal(q, fixed.PLACE_SIGNALS)
    org, product, person = _signal(q, fixed.ORGANIZATION_SIGNALS), _signal(q, fixed.PRODUCT_SIGNALS), _signal(q, fixed.PERSON_SIGNALS)
    return (
        F.when(software & ~org, "software_project")
        .when(person & ~org & ~software, "person_group")
        .when(place & (has_location(q) | ~org), "place_venue")
        .when(org, "organization_company")
        .when(product, "product_offering")
        .when(has_location(q), "place_venue")
        .otherwise("generic_entity_list")
    )


def by_family(kind: Column, values: dict[str, Column], default: Column) -> Column:
    out = default
    for name, value in values.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def template_type(kind: Column) -> Column:
    return by_family(kind, {k: F.lit(t) for k, (t, _) in fixed.FAMILY_TEMPLATES.items()}, F.lit("entity"))


def template_columns(kind: Column) -> Column:
    lists = {k: F.array(*map(F.lit, c)) for k, (_, c) in fixed.FAMILY_TEMPLATES.items()}
    return by_family(kind, lists, lists["generic_entity_list"])


def topic(query: Column) -> Column:
    return F.regexp_replace(F.trim(query), "(?i)" + fixed.INTENT_PREFIX, "")


def entity_type(query: Column, kind: Column) -> Column:
    """The last words of the topic without place and year, in the singular; the family's type if they are generic."""
    core = F.regexp_replace(topic(query), "(?i)" + fixed.YEAR_SUFFIX, "")
    core = F.trim(F.regexp_replace(core, "(?i)" + fixed.TRAILING_LOCATION, ""))
    parts = F.filter(F.split(core, r"\s+"), lambda x: x != "")
    phrase = F.lower(F.array_join(F.when(F.size(parts) > 3, F.slice(parts, -3, 3)).otherwise(parts), " "))
    single = F.when(phrase.rlike(r"[^ ]{3,}s$") & ~phrase.endswith("ss"), F.regexp_replace(phrase, "s$", "")).otherwise(phrase)
    return F.when((phrase == "") | phrase.isin(*fixed.GENERIC_ENTITY_TYPES), template_type(kind)).otherwise(single)


def facets(query: Column, kind: Column, columns: Column) -> Column:
    """What to search for: lists, official pages, overviews, an attribute, and news or comparisons."""
    about = F.when(topic(query) == "", query).otherwise(topic(query))
    websites = ("website", "website_or_repo", "website_or_profile")
    others = F.slice(F.filter(columns, lambda c: c != "name"), 1, 3)
    own = F.slice(F.filter(columns, lambda c: c.isin(*websites)), 1, 1)
    attributes = F.slice(F.filter(columns, lambda c: ~c.isin("name", *websites)), 1, 2)
    hint = F.translate(F.coalesce(F.get(attributes, F.lit(0)), F.lit("")), "_", " ")
    name = F.array(F.lit("name"))

    def facet(kind_: str, q: Column, fill: Column, why: Column | str) -> Column:
        return F.struct(
            F.lit(kind_).alias("type"), q.alias("query"), fill.alias("expected_fill_columns"), (why if isinstance(why, Column) else F.lit(why)).alias("rationale")
        )

    named = F.concat(name, F.slice(others, 1, 1))
    all_facets = F.array(
        facet("entity_list", F.concat(F.lit("top "), about), F.concat(name, F.slice(others, 1, 2)), "list pages name the most candidates"),
        facet("official_source", F.concat(about, F.lit(" official website")), F.when(F.size(own) > 0, own).otherwise(name), "official pages state an entity's own facts"),
        facet("editorial_review", F.concat(about, F.lit(" overview")), named, "overviews tell candidates from noise"),
        F.when(F.size(attributes) > 0, facet("attribute_specific", F.concat(about, F.lit(" "), hint), attributes, F.concat(F.lit("pages on one attribute fill the column "), hint))),
        F.when(kind.isin("software_project", "product_offering"), facet("comparison", F.concat(about, F.lit(" comparison")), named, "comparisons set similar candidates apart"))
        .when(kind == "organization_company", facet("news_recent", F.concat(about, F.lit(" news")), named, "news shows who is active")),
    )
    return F.slice(F.filter(all_facets, lambda f: f.isNotNull()), 1, 5)


def sanitized(some_facets: Column, columns: Column) -> Column:
    """Facets from outside: without blank queries, with columns of the plan only."""
    kept = F.filter(some_facets, lambda f: F.trim(F.coalesce(f["query"], F.lit(""))) != "")
    return F.transform(
        kept,
        lambda f: f.withField("query", F.trim(f["query"])).withField("expected_fill_columns", F.filter(f["expected_fill_columns"], lambda c: F.array_contains(columns, c))),
    )


def chosen_type(answer: Column, template: Column) -> Column:
    """An entity type from outside, unless it is blank or generic."""
    low = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    return F.when((low == "") | low.isin(*fixed.GENERIC_ENTITY_TYPES), template).otherwise(F.trim(answer))


def name_first(columns: Column) -> Column:
    return F.concat(F.array(F.lit("name")), F.filter(columns, lambda c: F.lower(c) != "name"))


def known_or(value: Column, names, default: str) -> Column:
    """An answer as one of the names: lower case with underscores, or the default."""
    low = F.translate(F.lower(F.trim(F.coalesce(value, F.lit("")))), "- ", "__")
    return F.when(low.isin(*names), low).otherwise(default)


def strict(query: Column) -> Column:
    return text.any_of(F.lower(query), fixed.HIGH_INTENT)


def discovery_columns(columns: Column, mapped: Column) -> Column:
    """At most four columns to find candidates by: the name, those with requirements, then the plan's order."""
    wanted = F.filter(mapped, lambda c: F.array_contains(columns, c))
    return F.slice(F.array_distinct(F.concat(F.array(F.lit("name")), wanted, columns)), 1, 4)


# --- requirements ------------------------------------------------------------------

SPEC = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "label", "kind", "operator", "target_value", "target_value_raw", "source_phrase", "priority")]
    + [T.StructField("is_hard", T.BooleanType()), T.StructField("mapped_columns", T.ArrayType(T.StringType()))]
)
_SPEC_DDL = SPEC.simpleString()


def location_slug(raw: Column, *, of_cells: bool = False) -> Column:
    """A place as a word to compare by; cells also know states by name and countries of the union."""
    s = F.lower(F.trim(raw))
    out = F.when(s.isin(*fixed.LOCATION_NAMES["us"]), "us")
    out = out.when(s.isin(*fixed.LOCATION_NAMES["uk"], *(("england",) if of_cells else ())), "uk")
    for slug in ("eu", "canada", "australia"):
        out = out.when(s.isin(*fixed.LOCATION_NAMES[slug]), slug)
    if of_cells:
        out = out.when(s.isin(*fixed.STATES), F.concat(F.lit("us-"), s)).when(s.isin(*fixed.STATE_NAMES), "us-state").when(s.isin(*fixed.EU_COUNTRIES), "eu")
    return out.otherwise(s)


def money_label(raw: Column) -> Column:
    """An amount without commas and spaces, with K, M or B."""
    s = F.regexp_replace(F.lower(F.trim(raw)), r"[,\s]", "")
    for word, letter in (("thousand", "k"), ("million", "m"), ("billion", "b")):
        s = F.regexp_replace(s, word + "$", letter)
    return F.upper(s)


def _spec(number: Column | int, prefix: str, field: str, kind: str, operator, label: Column, target: Column, raw: Column, phrase: Column, hard: bool) -> Column:
    return F.struct(
        F.concat(F.lit(prefix + "_"), (number if isinstance(number, Column) else F.lit(number)).cast("string")).alias("id"),
        label.alias("label"),
        F.lit(kind).alias("kind"),
        (operator if isinstance(operator, Column) else F.lit(operator)).alias("operator"),
        target.alias("target_value"),
        F.trim(raw).alias("target_value_raw"),
        F.trim(phrase).alias("source_phrase"),
        F.lit("high" if hard else "medium").alias("priority"),
        F.lit(hard).alias("is_hard"),
        F.array(*map(F.lit, fixed.FIELD_COLUMNS[field])).alias("mapped_columns"),
    ).cast(_SPEC_DDL)


def _matches(q: Column, pattern: str, *groups: int) -> Column:
    """All matches as structs of the whole and the groups."""
    names = ["g" + str(g) for g in (0, *groups)]
    return F.arrays_zip(*[F.regexp_extract_all(q, F.lit(pattern), F.lit(g)).alias(n) for g, n in zip((0, *groups), names, strict=True)])


def _one(q: Column, pattern: str, build) -> Column:
    """An array with the spec of the first match, or an empty one."""
    whole = F.regexp_extract(q, pattern, 0)
    return F.when(whole != "", F.array(build(whole)))


def _first_of(*options: Column) -> Column:
    return F.coalesce(*options, F.array().cast(f"array<{_SPEC_DDL}>"))


def _topics(q: Column) -> Column:
    """(topic, phrase) for each entity word with words before it, back to a qualifier or a function word."""
    parts = F.split(F.trim(q), r"\s+")
    stops = F.transform(
        parts,
        lambda t, i: F.when(F.lower(t).isin(*fixed.QUALIFIER_WORDS) | F.regexp_replace(F.lower(t), "[,;]+$", "").isin(*fixed.TOPIC_STOPS), i + 1).otherwise(0),
    )

    def found(t: Column, i: Column) -> Column:
        start = F.when(i > 0, F.array_max(F.slice(stops, F.lit(1), F.greatest(i, F.lit(1))))).otherwise(0)
        size = i - start
        before = F.slice(parts, start + 1, F.greatest(size, F.lit(0)))
        said = F.array_join(before, " ")
        ok = F.lower(t).isin(*fixed.ENTITY_TYPE_WORDS) & (i >= 1) & (size > 0)
        return F.when(ok, F.struct(said.alias("raw"), F.concat(said, F.lit(" "), t).alias("phrase")))

    return F.filter(F.transform(parts, found), lambda x: x.isNotNull())


def requirements(q: Column) -> Column:
    """The explicit requirements of a query, in a fixed order: place, funding, stage, licence, founding, staff, topics."""
    i = "(?i)"
    places = F.transform(
        _matches(q, fixed.REQUIRED_LOCATION, 1),
        lambda m, n: _spec(n, "loc", "location", "location", "contains", F.concat(F.lit("Location: "), F.trim(m["g1"])), location_parsed(m["g1"]), m["g1"], m["g0"], True),
    )
    over = _matches(q, i + fixed.FUNDING_OVER, 1, 2)

    def more(m: Column, n: Column) -> Column:
        least = F.lower(F.trim(m["g1"])).isin("≥", "at least")
        operator = F.when(least, "at_least").otherwise("greater_than")
        label = F.concat(F.lit("Funding "), F.when(least, "≥").otherwise(">"), F.lit(" "), money_label(m["g2"]))
        return _spec(n, "fund", "funding", "numeric", operator, label, money_label(m["g2"]), m["g2"], m["g0"], True)

    def less(m: Column, n: Column) -> Column:
        label = F.concat(F.lit("Funding < "), money_label(m["g2"]))
        return _spec(n + F.size(over), "fund", "funding", "numeric", "less_than", label, money_label(m["g2"]), m["g2"], m["g0"], True)

    under = F.transform(_matches(q, i + fixed.FUNDING_UNDER, 1, 2), less)

    def stage(pattern: str, value: str | None) -> Column:
        said = F.lit(value) if value else F.concat(F.lit("Series "), F.upper(F.regexp_extract(q, i + pattern, 1)))
        label = F.concat(F.lit("Stage: "), said)
        return _one(q, i + pattern, lambda whole: _spec(0, "stage", "stage", "categorical", "contains", label, F.lower(said), whole, whole, False))

    license_ = _first_of(
        _one(q, i + fixed.OPEN_SOURCE, lambda w: _spec(0, "lic", "license", "categorical", "exists", F.lit("License: open-source"), F.lit("open-source"), w, w, False)),
        _one(
            q,
            i + fixed.LICENSE_NAMED,
            lambda w: _spec(
                0, "lic", "license", "categorical", "contains", F.concat(F.lit("License: "), F.upper(F.regexp_extract(q, i + fixed.LICENSE_NAMED, 1))),
                F.upper(F.regexp_extract(q, i + fixed.LICENSE_NAMED, 1)), w, w, False,
            ),
        ),
    )

    def founded(operator: str, word: str, pattern: str) -> Column:
        year = F.regexp_extract(q, i + pattern, 1)
        return _one(q, i + pattern, lambda w: _spec(0, "founded", "founded", "numeric", operator, F.concat(F.lit(f"Founded {word} "), year), year, w, w, False))

    def staff(operator: str, sign: str, pattern: str) -> Column:
        count = F.regexp_extract(q, i + pattern, 1)
        return _one(q, i + pattern, lambda w: _spec(0, "emp", "employees", "numeric", operator, F.concat(F.lit(f"Employees {sign} "), count), count, w, w, False))

    others = F.concat(
        places,
        F.transform(over, more),
        under,
        _first_of(*[stage(p, v) for p, v in fixed.STAGES]),
        license_,
        _first_of(*[founded(*x) for x in fixed.FOUNDED]),
        _first_of(*[staff(*x) for x in fixed.STAFF]),
    )
    found = _topics(q)
    names = F.transform(found, lambda x: F.lower(x["raw"]))
    taken = F.transform(others, lambda s: s["target_value"])
    new = F.filter(found, lambda x, n: (F.array_position(names, F.lower(x["raw"])) == n + 1) & ~F.coalesce(F.array_contains(taken, F.lower(x["raw"])), F.lit(False)))
    topics = F.transform(
        new,
        lambda x, n: _spec(n, "topic", "topic", "semantic", "matches_topic", F.concat(F.lit("Topic: "), F.lower(x["raw"])), F.lower(x["raw"]), x["raw"], x["phrase"], False),
    )
    return F.concat(others, topics)


def location_parsed(raw: Column) -> Column:
    return location_slug(raw)


def binding_key(spec: Column) -> Column:
    """The field that a requirement is about."""
    target = F.lower(F.coalesce(spec["target_value"], F.lit("")))
    said = F.lower(F.concat_ws(" ", spec["source_phrase"], spec["label"], F.coalesce(spec["target_value"], F.lit(""))))
    numeric = (
        F.when(text.any_of(said, ("funding", "raised", "valuation", "capital")), "funding")
        .when(text.any_of(said, ("founded", "established", "year founded")), "founded")
        .when(text.any_of(said, ("employee", "employees", "people", "staff", "headcount", "team size")), "employees")
        .when(text.any_of(said, ("price", "$", "cost", "under", "over")), "price")
        .otherwise("numeric")
    )
    licenses = ("open-source", "mit", "apache", "gpl", "bsd", "mpl", "lgpl")
    stages = ("startup", "early-stage", "pre-seed", "seed", "public", "private", "bootstrapped")
    categorical = F.when(said.contains("license") | target.isin(*licenses), "license").when(target.isin(*stages) | target.startswith("series "), "stage").otherwise("category")
    return F.when(spec["kind"] == "location", "location").when(spec["kind"] == "numeric", numeric).when(spec["kind"] == "categorical", categorical).otherwise("topic")


def bound_columns(spec: Column, kind: Column) -> Column:
    """The columns that a family has for a requirement's field."""
    none = F.array().cast("array<string>")
    key, out = binding_key(spec), none
    for name, fields in fixed.FAMILY_BINDINGS.items():
        for field, columns in fields.items():
            out = F.when((kind == name) & (key == field), F.array(*map(F.lit, columns))).otherwise(out)
    return out


def augmented(columns: Column, specs: Column, kind: Column, most: int = fixed.MAX_COLUMNS) -> Column:
    """A plan's columns with those that requirements need, up to ``most``; one that has any of its own needs none."""

    def step(now: Column, spec: Column) -> Column:
        own = bound_columns(spec, kind)
        wider = F.concat(now, F.slice(F.array_except(own, now), F.lit(1), F.greatest(F.lit(most) - F.size(now), F.lit(0))))
        return F.when((F.size(own) == 0) | F.arrays_overlap(own, now), now).otherwise(wider)

    return F.aggregate(specs, columns, step)


def bound(specs: Column, columns: Column, kind: Column) -> Column:
    """The requirements with the plan's columns for them, the family's own first."""

    def step(spec: Column) -> Column:
        wanted = F.array_distinct(F.concat(bound_columns(spec, kind), spec["mapped_columns"]))
        return spec.withField("mapped_columns", F.filter(wanted, lambda c: F.array_contains(columns, c)))

    return F.transform(specs, step)
