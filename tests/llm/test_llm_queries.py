"""Registered queries with SQL, on the smallest tables."""

import os

import duckdb
import pytest

from loomtrace.llm import queries

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SF_DIR):
        duck.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    df = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]}) AS q").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
