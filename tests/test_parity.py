"""Every registered query runs on the smallest tables, and equals its SQL where it has one."""

import math
import os

import pytest

from foliant.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or type(v).__name__ in ("NAType", "NaTType"):
        return "null"
    if not isinstance(v, str):
        try:
            return repr(round(float(v), 5) + 0.0)
        except (TypeError, ValueError):
            pass
    return str(v)


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(str([cell(v) for v in r]) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql:
        assert plain(got) == plain(con.execute(sql).fetchdf())
    else:
        assert len(got.columns)
