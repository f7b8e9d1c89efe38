"""Corpus queries that have SQL give the rows of that SQL."""

import duckdb
import pytest

from sheafcalc.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SMALL)
    rows = sorted(repr(tuple(r[c] for c in sorted(got.columns))) for r in got.collect())
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(want.columns) == sorted(got.columns)
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
