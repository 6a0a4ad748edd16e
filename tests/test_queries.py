"""Every query against its SQL twin, on the smallest tables."""

import duckdb
import pytest

import cohortloom.queries.sources  # noqa: F401  registers its queries
from cohortloom.queries.core import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def in_order(rows, columns):
    places = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(r[i] for i in places) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = in_order([tuple(r) for r in df.collect()], df.columns)
    q = duck.execute(SQL[name])
    columns = [d[0] for d in q.description]
    want = in_order(q.fetchall(), columns)
    assert sorted(df.columns) == sorted(columns)
    assert {c: KINDS[k] for c, k in df.dtypes} == {d[0]: str(d[1]) for d in q.description}
    assert got == want


def test_entry():
    import __spark_entry__ as e

    assert e.oracle_sql().keys() <= e.queries().keys() and set(QUERIES) <= set(e.queries())
