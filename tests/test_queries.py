"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return c


def rows(columns, data):
    plain = lambda v: None if v is None else round(v, 9) if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in data)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_same_rows_as_sql(spark, duck, folder, name):
    got = entry_module.queries()[name](spark, folder)
    want = duck.sql(entry_module.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
