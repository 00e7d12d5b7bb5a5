import duckdb
import pytest

import __spark_entry__ as driver
from quarry import queries as relational

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    assert driver.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(relational.SQL))
def test_query_equals_sql(spark, duck, name):
    got = relational.QUERIES[name](spark, SF)
    result = duck.execute(relational.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(map(plain, r)) for r in result.fetchall())
