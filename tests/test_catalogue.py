"""Each driver query with an oracle gives the oracle's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from plinth.plans import catalogue, code_queries

DATA = Path("/root/testdata/sf0.001")
SLOW = {"cycles"}
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in DATA.glob("*.parquet"):
        c.sql(f"create view {t.stem} as select * from '{t}'")
    return c


def norm(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


QUERIES, ORACLE_SQL = catalogue.QUERIES | code_queries.QUERIES, catalogue.ORACLE_SQL | code_queries.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - SLOW))
def test_query_matches_its_oracle(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(code_queries.QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert code_queries.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
