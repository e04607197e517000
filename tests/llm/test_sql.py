"""Queries of this subpackage that have SQL give the same rows in it."""

import os

import duckdb
import pytest

from lakeloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    mine, other = QUERIES[name](spark, sf_dir), con.execute(SQL[name])
    columns = [c[0] for c in other.description]
    assert sorted(mine.columns) == sorted(columns)
    order = sorted(columns)
    assert sorted(repr(tuple(r[c] for c in order)) for r in mine.collect()) == sorted(repr(tuple(r[columns.index(c)] for c in order)) for r in other.fetchall())


def test_every_query_is_registered():
    import __spark_entry__ as e

    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
