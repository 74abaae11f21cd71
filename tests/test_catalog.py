"""Every registered query with SQL gives the same rows in DuckDB."""

import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from gridloom.plans import catalog
from jobs import catalog as job_catalog

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 6) if isinstance(v, (int, float, decimal.Decimal)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


QUERIES, ORACLE_SQL = catalog.QUERIES | job_catalog.QUERIES, catalog.ORACLE_SQL | job_catalog.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in ORACLE_SQL:
        cur = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cur.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_block_barcodes_of_all_suppliers(spark, tmp_path):
    n = 300
    spark.range(1, n + 1).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = catalog.QUERIES["block_barcodes"](spark, str(tmp_path)).select("block_row", "block_col").distinct()
    assert rows.count() == n * n and rows.agg({"block_row": "max"}).first()[0] == n
