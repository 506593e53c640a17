"""Every query of the engine against its SQL in DuckDB; small results are compared value by value."""

import os

import duckdb
import pytest

import __spark_entry__
from strata import suite

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def plain(v):
    return None if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = suite.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*cols).toPandas().astype(object).where(lambda x: x.notna(), None).values.tolist()]
    sql = con.sql(suite.ORACLE_SQL[name])
    assert sorted(sql.columns) == cols
    want = [tuple(plain(v) for v in r) for r in sql.df()[cols].astype(object).where(lambda x: x.notna(), None).values.tolist()]
    key = lambda r: tuple("" if v is None else v for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns[0] == "o_orderkey"
