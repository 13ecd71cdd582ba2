"""Every query of the conversation engine against its SQL."""

import duckdb
import pytest

from palaver.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("conversations", "documents"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    assert len(got) and rows(got) == rows(duck.execute(ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
