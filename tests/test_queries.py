"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
#: tests/llm covers the training-data queries.
OWN_TESTS = {n for n in QUERIES if n.startswith("op")} | {"pipeline"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    """Values as text, doubles to six digits, columns and rows in order."""

    def text(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, (str, bool, pd.Timestamp)) or not hasattr(v, "__float__"):
            return str(v)
        return str(round(float(v), 6) + 0.0)

    df = df[sorted(df.columns)].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables aren't here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - OWN_TESTS))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        want = tables.sql(SQL[name]).df()
        pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)


def test_each_oracle_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
