"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from tickloom.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    found = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    order = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [found.columns.index(c) for c in order]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert {r.event_type for r in rows} == {"click", "purchase", "signup"}
    assert set(plans.QUERIES) <= set(entry.queries()) and set(plans.ORACLE_SQL) <= set(entry.oracle_sql())
