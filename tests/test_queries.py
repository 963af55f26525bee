"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from seriesforge.plans.registry import ORACLE, QUERIES
from seriesforge.sources.adapters import series


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: "" if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(show(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    want = _rows(columns, found.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_have_a_row_for_every_entity(spark, sf_dir, name):
    """Fits and their labels: every entity of the series has a result or says why not; what is there is a number."""
    rows = QUERIES[name](spark, sf_dir)
    found = rows.collect()
    entities = {r.entity for r in series(spark, sf_dir).select("entity").distinct().collect()}
    assert {r.entity for r in found} <= entities and len({r.entity for r in found}) > 0.5 * len(entities)
    for c, kind in rows.dtypes:
        if kind == "double":
            assert all(r[c] is None or math.isfinite(r[c]) for r in found), c
    if "error" in rows.columns:
        assert {r.entity for r in found} == entities
        assert any(r.error is None for r in found)
