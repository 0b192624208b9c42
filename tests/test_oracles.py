"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import listwright.plans as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if hasattr(v, "__len__") and not isinstance(v, (str, bytes, dict)):
            return str(list(v))
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "null"
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return str(v)
        return repr(float(v))

    return sorted(map(tuple, df[sorted(df.columns)].astype(object).map(cell).values.tolist()))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf, duck, name):
    got, want = plans.queries()[name](spark, sf).toPandas(), duck.execute(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert plans.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
