"""Registered queries against their SQL at the smallest scale.

The quick ones always run; CATALOG=all runs every query that has SQL.
"""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from meguri.catalog.base import _TABLES

FOLDER = "/root/testdata/sf0.001"
QUICK = "undistributed_list o2_list_page a1_history_rollup a3_status_counts u2_first_wins p1_normalized_address p7_name_tokens f7_acceptance j8_nearest_point w2_name_alternatives t7_apply_decisions s1_csv_scan".split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("CATALOG") == "all" else QUICK


def _plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in _TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    answer = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, answer.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
