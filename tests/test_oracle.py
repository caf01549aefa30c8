"""Every named query against its SQL on the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from fieldhub.catalog import all_entries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
ENTRIES = all_entries()
QUERIES, ORACLE = {n: e.run for n, e in ENTRIES.items()}, {n: e.sql for n, e in ENTRIES.items()}
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "smallint": "SMALLINT",
}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(
        v + 0.0 if isinstance(v, float) else v
    )
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert all(ORACLE.values())
    assert set(ENTRIES) <= set(entry_module.queries()) and set(ENTRIES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    assert got == canonical(columns, result.fetchall())
    assert {c: TYPES[t] for c, t in df.dtypes} == types


def test_entry(spark):
    assert entry_module.entry(spark).count() == 1
