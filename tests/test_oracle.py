"""Every registered query against its DuckDB oracle SQL, on the smallest driver tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as E
from tableaudit.plans import catalog
from tableaudit.plans.views import TABLES

SF_SMALL = "/root/testdata/sf0.001"

#: The library's own queries; those of other subpackages have tests beside them.
QUERIES = {name: query for name, query in E.queries().items() if name in catalog.QUERIES}
SQL = E.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.6g}")
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 0 and "anomaly_type" in df.columns


def test_every_query_has_oracle_or_is_sampled():
    rows_only = set(QUERIES) - set(SQL)
    assert not rows_only and set(QUERIES) == set(catalog.QUERIES)
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert df.columns
        return
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _canon(df.columns, rows) == _canon(ocols, orows)
