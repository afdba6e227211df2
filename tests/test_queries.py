"""Every registered query against its SQL on the smallest scale."""

import os

import duckdb
import pytest

from loomtrace.plans import registry

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.sql(f"SELECT {quoted} FROM ({ORACLES[name]}) AS q").fetchall()
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(got, key=key) == sorted(want, key=key)
