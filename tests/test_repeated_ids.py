"""Queries of events whose numbers, taken modulo 1,000,003, repeat: as of a million events."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows

SOURCE = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("repeated")
    duckdb.sql(f"COPY (SELECT t.* REPLACE (event_id + i * 1000003 AS event_id, user_id + i * 150 AS user_id) FROM range(2) AS r(i), '{SOURCE}' AS t) TO '{path}/events.parquet'")
    return str(path)


@pytest.mark.parametrize("name", ["chain_reports", "confirm_chains", "confirm_events"])
def test_repeated_ids(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    found, wanted = entry.queries()[name](spark, folder), con.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found.columns, found.collect()) == rows(wanted.columns, wanted.fetchall())
