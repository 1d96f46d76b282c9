"""Every query with a DuckDB statement against it, on the smallest tables; every other query has to give rows."""

import math

import duckdb
import pytest

from severa.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) else x
    return sorted(names), sorted(([plain(r[i]) for i in order] for r in found), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, D)
    want = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, D).count() > 0
