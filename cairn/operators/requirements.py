"""Requirements held against entities: satisfied, not satisfied, or unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import fixed
from cairn.functions import queries as q
from cairn.functions import text
from cairn.functions.binding import let

_FACTORS = (("value", 1.0), ("evidence_snippet", 0.9), ("source_title", 0.8))


def number(said: Column) -> Column:
    """The first number of a text, or null."""
    return F.regexp_replace(F.regexp_extract(said, fixed.NUMBER_PATTERN, 0), ",", "").try_cast("double")


def money(said: Column) -> Column:
    """The first amount of a text with its thousands, millions or billions, or null."""
    pattern = "(?i)" + fixed.MONEY_PATTERN
    unit = F.lower(F.regexp_extract(said, pattern, 2))
    factor = F.when(unit.isin("k", "thousand"), 1e3).when(unit.isin("m", "million"), 1e6).when(unit.isin("b", "billion"), 1e9).otherwise(1.0)
    return F.regexp_replace(F.regexp_extract(said, pattern, 1), ",", "").try_cast("double") * factor


def compared(said: Column, operator: Column, threshold: Column, as_money: Column) -> Column:
    """Whether a text's number is as required; null if there is none."""
    own, asked = (F.when(as_money, money(x)).otherwise(number(x)) for x in (said, threshold))
    return (
        F.when(operator == "greater_than", own > asked).when(operator == "less_than", own < asked).when(operator == "at_least", own >= asked).when(operator == "equals", own == asked)
    )


def in_place(said: Column, target: Column) -> Column:
    """Whether a text is in a place, as a whole, by one of its parts, or as a part of the text."""
    parts = F.filter(F.transform(F.split(said, r"[,/|()\-]"), F.trim), lambda p: p != "")
    slugs = F.concat(F.array(q.location_slug(said, of_cells=True)), F.transform(parts, lambda p: q.location_slug(p, of_cells=True)))
    state = F.exists(slugs, lambda s: s.startswith("us-"))
    return F.array_contains(slugs, target) | ((target == "us") & state) | F.lower(said).contains(target)


def plain(said: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(said), r"[^\p{L}\p{N}]+", " "))


def candidates(spec: Column, cells: Column) -> Column:
    """The filled cells that a requirement looks at, in the order of its columns."""
    prefix = F.substring_index(spec["id"], "_", 1)
    fallback = F.array().cast("array<string>")
    for field, columns in fixed.FIELD_COLUMNS.items():
        fallback = F.when(prefix == field, F.array(*map(F.lit, columns))).otherwise(fallback)
    wanted = F.array_distinct(F.when(F.size(spec["mapped_columns"]) > 0, spec["mapped_columns"]).otherwise(fallback))
    found = F.transform(wanted, lambda w: F.get(F.filter(cells, lambda x: x["col"] == w), F.lit(0)))
    return F.filter(found, lambda x: F.coalesce(x["value"], F.lit("")) != "")


def _grounds(cell: Column, titles: bool) -> Column:
    """(text, confidence) of what a cell says, by what says it; a text that is there already is left out."""
    value, shown, title = (F.nullif(cell[n], F.lit("")) for n, _ in _FACTORS)

    def ground(said: Column, factor: float) -> Column:
        sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), cell["confidence"] * factor))
        return F.struct(said.alias("text"), F.bround(sure, 3).alias("confidence"), cell["col"].alias("col"))

    all_grounds = [
        F.when(value.isNotNull(), ground(value, 1.0)),
        F.when(shown.isNotNull() & ~shown.eqNullSafe(value), ground(shown, 0.9)),
    ]
    if titles:
        all_grounds.append(F.when(title.isNotNull() & ~title.eqNullSafe(value) & ~title.eqNullSafe(shown), ground(title, 0.8)))
    return F.filter(F.array(*all_grounds), lambda g: g.isNotNull())


def evaluated(spec: Column, cells: Column) -> Column:
    """(status, confidence, matched_value, matched_column) of a requirement on an entity's cells."""

    def match(status, confidence, value, column) -> Column:
        text_ = lambda x: x.cast("string") if isinstance(x, Column) else F.lit(x).cast("string")
        sure = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(text_(status).alias("status"), sure.cast("double").alias("confidence"), text_(value).alias("matched_value"), text_(column).alias("matched_column"))

    def judged(b: Column) -> Column:
        found, grounds, target = b["found"], b["grounds"], b["target"]
        first = F.get(found, F.lit(0))

        def first_that(test) -> Column:
            hits = F.filter(grounds, test)
            failed = match("not_satisfied", first["confidence"], first["value"], first["col"])
            return let({"hit": F.get(hits, F.lit(0))}, lambda h: F.when(h["hit"].isNotNull(), match("satisfied", h["hit"]["confidence"], h["hit"]["text"], h["hit"]["col"])).otherwise(failed))

        tested = F.transform(
            b["sure_grounds"],
            lambda g, i: F.struct(
                compared(g["text"], spec["operator"], target, b["is_money"]).alias("ok"), (-g["confidence"]).alias("less"), i.alias("pos"), g["text"].alias("text"), g["col"].alias("col")
            ),
        )

        def numbers(t: Column) -> Column:
            # The best of each kind: more confidence, then the first.
            best = lambda ok: F.array_min(F.transform(F.filter(t["tested"], lambda x: x["ok"] if ok else ~x["ok"]), lambda x: F.struct(x["less"], x["pos"], x["text"], x["col"])))
            return let(
                {"good": best(True), "bad": best(False)},
                lambda n: F.when(n["good"].isNotNull(), match("satisfied", -n["good"]["less"], n["good"]["text"], n["good"]["col"]))
                .when(n["bad"].isNotNull(), match("not_satisfied", -n["bad"]["less"], n["bad"]["text"], n["bad"]["col"]))
                .otherwise(match("unknown", 0.0, first["value"], first["col"])),
            )

        return (
            F.when(F.size(found) == 0, match("unknown", 0.0, None, None))
            .when(spec["operator"] == "exists", match("satisfied", first["confidence"], first["value"], first["col"]))
            .when(spec["kind"] == "location", first_that(lambda g: in_place(g["text"], b["place"])))
            .when(spec["kind"] == "numeric", let({"tested": tested}, numbers))
            .otherwise(first_that(lambda g: plain(g["text"]).contains(b["plain"])))
        )

    def grounded(a: Column) -> Column:
        hint = F.lower(F.concat_ws(" ", spec["id"], spec["label"], spec["source_phrase"], a["target"]))
        return let(
            {
                "found": a["found"],
                "target": a["target"],
                "grounds": F.flatten(F.transform(a["found"], lambda x: _grounds(x, True))),
                "sure_grounds": F.flatten(F.transform(a["found"], lambda x: _grounds(x, False))),
                "place": q.location_slug(a["target"], of_cells=True),
                "plain": plain(a["target"]),
                "is_money": text.any_of(hint, fixed.MONEY_HINTS),
            },
            judged,
        )

    return let({"found": candidates(spec, cells), "target": F.coalesce(spec["target_value"], F.lit(""))}, grounded)


def summarized(entities: DataFrame, plans: DataFrame) -> DataFrame:
    """Entities with their matches and counts; without requirements all counts are 0."""
    specs = plans.select("query_id", F.col("requirements").alias("__specs"))
    joined = entities.join(specs, "query_id", "left")

    def one(s: Column) -> Column:
        names = ("status", "confidence", "matched_value", "matched_column")
        head = [s["id"].alias("requirement_id"), s["label"].alias("label"), s["is_hard"].alias("is_hard")]
        return let({"m": evaluated(s, F.col("cells"))}, lambda b: F.struct(*head, *[b["m"][k].alias(k) for k in names]))

    n = F.greatest(F.size("__specs"), F.lit(0))
    matched = joined.withColumn("matches", F.coalesce(F.transform("__specs", one), F.expr("filter(array(null), x -> false)").cast(_MATCHES)))
    count = lambda test: F.size(F.filter("matches", test))
    share = F.when(n > 0, 1.0 / n).otherwise(0.0)
    with_share = F.transform(
        "matches",
        lambda m: m.withField("score_contribution", F.bround(F.when(m["status"] == "satisfied", share).when(m["status"] == "unknown", share * 0.5).otherwise(0.0), 3)),
    )
    counted = matched.withColumns(
        {
            "requirements_total": n,
            "requirements_satisfied": count(lambda m: m["status"] == "satisfied"),
            "requirements_failed": count(lambda m: m["status"] == "not_satisfied"),
            "requirements_unknown": count(lambda m: m["status"] == "unknown"),
            "hard_satisfied": count(lambda m: (m["status"] == "satisfied") & m["is_hard"]),
            "hard_failed": count(lambda m: (m["status"] == "not_satisfied") & m["is_hard"]),
        }
    )
    ratio = F.when(F.col("requirements_total") > 0, F.bround(F.col("requirements_satisfied") / F.col("requirements_total"), 3)).otherwise(0.0)
    return counted.withColumn("satisfaction_ratio", ratio).withColumn("matches", with_share).drop("__specs")


_MATCHES = "array<struct<requirement_id: string, label: string, is_hard: boolean, status: string, confidence: double, matched_value: string, matched_column: string>>"
