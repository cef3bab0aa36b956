"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import math
import os

import duckdb
import pytest

from telemetra.registry import QUERIES

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events",):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def _rows(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(k for k, v in QUERIES.items() if v[1]))
def test_matches_oracle(spark, con, name):
    build, sql = QUERIES[name]
    df = build(spark, SF_SMALL)
    srows = [r.asDict() for r in df.collect()]
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = [dict(zip(dcols, r)) for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    cols = sorted(dcols)
    assert _rows(srows, cols) == _rows(drows, cols)


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["subject", "c"]
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
