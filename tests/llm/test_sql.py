"""Queries with a DuckDB twin equal it over the whole small tables."""

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def _names():
    from quire.llm import queries

    return sorted(queries.ORACLE)


@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, name):
    from quire.llm import queries

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SMALL)
    cur = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, cur.fetchall()))
