"""Names for values inside expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` over a struct of the values, each of which is computed once.

    A Column that is used twice is written out twice in the plan; nested, that
    grows without bound.  The variable of a lambda is not.
    """
    bound = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(bound, body), F.lit(0))
