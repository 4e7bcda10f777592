"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from quarry.plans import catalog, grounding_queries, text_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return float(f"{float(v):.9g}") if type(v).__name__ == "Decimal" else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    cur = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", sorted(k for p in (text_queries, grounding_queries) for k, f in p.QUERIES.items() if catalog.QUERIES[k] is not f))
def test_cases(spark, duck, name):
    """Tables of cases whose query runs on a driver table in the catalog."""
    part = text_queries if name in text_queries.QUERIES else grounding_queries
    df = part.QUERIES[name](spark, FOLDER)
    cur = duck.execute(part.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())
