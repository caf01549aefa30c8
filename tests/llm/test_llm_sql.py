"""Queries with SQL against DuckDB, on whole tables."""

import duckdb
import pytest

from fieldhub.llm.queries import QUERIES, SQL


def canonical(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(row) for row in frame.where(frame.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    query, sql = QUERIES[name](spark, sf), con.sql(SQL[name])
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds[k] for c, k in query.dtypes} == dict(zip(sql.columns, map(str, sql.types), strict=True))
    found, wanted = query.toPandas(), sql.df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert canonical(found) == canonical(wanted)
