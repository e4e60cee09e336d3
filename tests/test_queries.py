"""Every query at the smallest size: it runs, and where SQL says what it returns, it returns that."""

from collections import Counter

import duckdb
import pytest

from cairn import catalog

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


def tidy(v):
    return float(f"{v:.9g}") if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    found = catalog.QUERIES[name](spark, AT)
    rows = found.collect()
    if name not in catalog.ORACLE:
        assert found.columns and rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    result = con.execute(catalog.ORACLE[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(found.columns)
    assert Counter(tuple(tidy(r[n]) for n in names) for r in rows) == Counter(tuple(tidy(v) for v in r) for r in result.fetchall())


def test_every_query_is_registered():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans(spark):
    """Scans read what is asked for, and ranks limit before they sort."""
    plan = catalog.QUERIES["url_domain"](spark, AT)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan
    top = catalog.QUERIES["rank_topn"](spark, AT)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in top
    assert "BatchEvalPython" not in top
