"""Whether cells are about their entity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn import fixed
from cairn.functions import cells as c
from cairn.functions import fuzzy, text, url


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _nearly(texts: pd.Series, key: pd.Series) -> pd.Series:
    """For each text of the array whether a stretch of it is nearly the name."""
    return pd.Series([[bool(t) and bool(k) and fuzzy.partial_ratio(k, t) >= fixed.ALIGNMENT_RATIO for t in ts] for ts, k in zip(texts, key, strict=True)])


def aligned(cells: Column, name: Column, *, fuzzily: bool = True) -> Column:
    """For each cell: its snippet or title has the name, or it comes from the entity's own site, or is not checked."""
    key, site = text.name_key(F.coalesce(name, F.lit(""))), c.own_website(cells)
    blank = lambda x: F.coalesce(x, F.lit(""))
    plain = F.transform(
        cells,
        lambda x: F.lower(x["col"]).isin(*fixed.UNALIGNED_COLUMNS)
        | (key == "")
        | text.name_key(blank(x["evidence_snippet"])).contains(key)
        | text.name_key(blank(x["source_title"])).contains(key)
        | F.coalesce(url.same_domain(x["source_url"], site), F.lit(False)),
    )
    if not fuzzily:
        return plain
    # Only what no exact test settles goes to Python: a settled cell sends empty texts.
    open_texts = lambda field: F.zip_with(cells, plain, lambda x, ok: F.when(ok, "").otherwise(F.lower(blank(x[field]))))
    near = F.zip_with(_nearly(open_texts("evidence_snippet"), key), _nearly(open_texts("source_title"), key), lambda a, b: a | b)
    return F.zip_with(plain, near, lambda a, b: a | b)


def penalized(entities: DataFrame, *, fuzzily: bool = True) -> DataFrame:
    """Entities whose unaligned cells have less confidence; those without a name stay as they are."""
    name = c.value(F.col("cells"), "name")
    judged = entities.withColumn("__ok", aligned(F.col("cells"), name, fuzzily=fuzzily))
    less = F.zip_with("cells", "__ok", lambda x, ok: F.when(ok, x).otherwise(x.withField("confidence", F.bround(x["confidence"] * fixed.ALIGNMENT_PENALTY, 3))))
    some = (F.coalesce(name, F.lit("")) != "") & F.exists("__ok", lambda x: ~x)
    changed = judged.withColumn("cells", F.when(some, less).otherwise(F.col("cells")))
    mean = F.when(some, F.bround(c.mean_confidence(F.col("cells")), 3)).otherwise(F.col("aggregate_confidence"))
    checked = F.size(F.filter("cells", lambda x: ~F.lower(x["col"]).isin(*fixed.UNALIGNED_COLUMNS)))
    return changed.withColumn("aggregate_confidence", mean).withColumn("cells_checked", checked).withColumn("cells_penalized", F.size(F.filter("__ok", lambda x: ~x))).drop("__ok")
