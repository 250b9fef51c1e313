"""Every core query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from foliant.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("FOLIANT_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def cells(frame):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        x = x.item() if hasattr(x, "item") else x
        return repr(round(x, 9)) if isinstance(x, float) and x != int(x) else str(int(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert cells(got) == cells(want)
    else:
        assert len(got)
