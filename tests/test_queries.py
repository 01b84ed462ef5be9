"""Every query with a DuckDB counterpart gives the same rows."""

import duckdb
import pytest

import __spark_entry__
from corpusloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    fixed = lambda v: round(float(v), 4) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(fixed(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(catalog.SQL[name])
    assert sorted(d[0] for d in result.description) == columns
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain([tuple(r[k] for k in at) for r in result.fetchall()])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
