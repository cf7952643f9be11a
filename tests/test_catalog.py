"""The registered queries: complete, and equal to their SQL on the smallest tables.

`check_oracles.py` runs all of them on any folder.
"""

import glob
import os

import pytest

import __spark_entry__ as entry
from opsweave.catalog import ORACLES, QUERIES
from tests.check_oracles import rows

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    files = glob.glob(f"{FOLDER}/*.parquet")
    if not files:
        pytest.skip("no sample tables here")
    con = duckdb.connect()
    for f in files:
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "host", "status"]
