"""Every registered query beside its SQL, on the smallest supplied tables."""

import duckdb
import pytest
from check_oracle import compare

import __spark_entry__ as entry
from beaconry.plans.views import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, note, _, rows = compare(spark, con, name, FOLDER)
    assert ok, note
    assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
