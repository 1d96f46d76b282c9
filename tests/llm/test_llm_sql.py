"""The operators' queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from severa.llm import queries

D = "/root/testdata/sf0.001"


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in want.description]
    got = queries.queries()[name](spark, D)
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, want.fetchall())
