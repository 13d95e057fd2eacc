"""Every registered query of the graph engine against its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from weftgraph.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    order = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    r = duck.execute(catalogue.ORACLE_SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == order
    assert rows == sorted(tuple(plain(x[cols.index(c)]) for c in order) for x in r.fetchall())
