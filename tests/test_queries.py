"""Every registered query that has SQL equals it on the smallest tables."""

import numbers
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}"
        c.sql(f"create view {name[:-8]} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    def plain(x):
        if isinstance(x, (list, tuple)):
            return x
        # columns of whole numbers with nulls come as floats from one side and not from the other
        return None if pd.isna(x) else round(float(x), 5) if isinstance(x, numbers.Number) and not isinstance(x, bool) else x

    return sorted(str([plain(x) for x in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(duck.sql(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_of_the_engine_has_sql_and_rows(spark):
    from listwright.plans import registry

    assert set(registry.queries()) == set(registry.oracle_sql())
    assert registry.queries()["invalid_domain_rows"](spark, SF).count() > 0
