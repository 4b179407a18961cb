"""Every registered query with SQL against DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return tuple(plain(y) for y in x) if isinstance(x, (list, tuple)) else x


def rows(names, found):
    return sorted((tuple(plain(r[n]) for n in names) for r in found), key=repr)


@pytest.mark.parametrize("name", SQL)
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    names = sorted(df.columns)
    relation = duck.sql(SQL[name])
    assert sorted(relation.columns) == names
    assert rows(names, df.collect()) == rows(names, (dict(zip(relation.columns, r, strict=True)) for r in relation.fetchall()))


def test_queries_without_sql_give_rows(spark):
    for name, query in entry.queries().items():
        if name not in SQL and not name.startswith("op") and name != "pipeline":
            assert query(spark, DIR).count() >= 0, name


def test_entry(spark):
    assert entry.entry(spark).columns == ["kind", "user", "knots", "seen"]
