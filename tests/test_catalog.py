"""Every core query against its SQL on the small data folder."""

import glob
import math
import os

import pytest

from parchmill import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no data folder")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in catalog.oracle_sql():
        assert got
        return
    found = duck.sql(catalog.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = [tuple(plain(r[k]) for k in at) for r in found.fetchall()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_all_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
