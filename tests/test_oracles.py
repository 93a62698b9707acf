"""Every query of the engine against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from graphloom.plans import catalog as registry

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr([cell(row[i]) for i in order]) for row in values)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, sql, name):
    df = registry.QUERIES[name](spark, TABLES)
    wanted = sql.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(columns, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - {"link_communities", "betweenness"}))
def test_queries_without_sql_run(spark, name):
    assert registry.QUERIES[name](spark, TABLES).count() > 0
