"""Every registered query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from millrace.plans import catalog


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(repr([None if pd.isna(x) else round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.astype(object).values.tolist())


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.sql(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, con, name):
    got = catalog.queries()[name](spark, sf_dir)
    if name not in catalog.oracle_sql():
        assert got.count() > 0
        return
    want = con.sql(catalog.oracle_sql()[name]).df()
    norm = lambda d: rows(d.astype({c: "Int64" for c in d.columns if c == "quality"}))
    assert norm(got.toPandas()) == norm(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
