"""Registered queries of the library's own operators against DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Learners that take long; ``test_brute_force`` runs them.
SLOW = {"boosted_trees", "decision_classifier"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(df):
    cell = lambda v: "null" if v is None or v != v else f"{float(v):.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
