"""Every check query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from veriframe.plans import queries, source_queries

QUERIES = queries.QUERIES | source_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | source_queries.ORACLE_SQL
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    def one(v):
        return "" if pd.isna(v) else str(v) if isinstance(v, (bool, str)) or type(v).__name__ == "bool" else f"{float(v):.6f}"

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
