"""Registered queries against their SQL on the smallest tables, and the guard of the entry module."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from alignlake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted(repr([plain(r[i]) for i in order]) for r in records)


def test_every_query_has_a_name_and_sql_names_exist():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())
