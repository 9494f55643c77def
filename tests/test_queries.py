"""Every query against its SQL on the smallest tables; the check tool does the same at any scale."""

import duckdb
import pytest

import __spark_entry__ as entry  # registers the queries
from workload.registry import ORACLES, QUERIES
from tools.check_oracle import TABLES, normal

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    frame = QUERIES[name](spark, FOLDER)
    mine = normal([tuple(r) for r in frame.collect()], frame.columns)
    result = con.sql(ORACLES[name])
    assert mine == normal(result.fetchall(), result.columns)
    assert mine[1]


def test_queries_without_sql_are_the_fitted_ones():
    assert set(QUERIES) - set(ORACLES) == {
        "harm_trained",
        "downstream_models",
    }


def test_entry(spark):
    assert entry.entry(spark).count() == 20
