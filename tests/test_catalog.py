"""Each named query gives the rows of its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    cell = lambda v: None if v is None or v is pd.NaT or (not isinstance(v, (str, list)) and pd.isna(v)) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        want = db.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
