"""Every registered query against its oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

from linkloom.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, int | float) and not isinstance(v, bool) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in ORACLE_SQL:
        o = duck.sql(ORACLE_SQL[name])
        assert sorted(o.columns) == columns
        at = [o.columns.index(c) for c in columns]
        assert rows == sorted(repr([plain(r[i]) for i in at]) for r in o.fetchall())


def test_no_cartesian_products(spark):
    for name in ("win_smurf", "jn_band_900s", "jn_incident_window", "grf_linkpred"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
