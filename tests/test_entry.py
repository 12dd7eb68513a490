"""Every registered query against its SQL on the smallest tables (skipped where the tables are not there)."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from leadloom.queries.catalog import QUERIES, SQL

DATA = os.environ.get("LEADLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


def rows(df):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v) or type(v).__name__ in ("NaTType", "NAType"):
            return "-"
        v = v.item() if type(v).__module__ == "numpy" else v
        return repr(round(v, 6)) if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        assert rows(got) == rows(con.execute(SQL[name]).df())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["candidate_id"]
