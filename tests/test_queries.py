"""Every query against its SQL in DuckDB on the smallest tables; queries without SQL must run."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import pytest

from lexloom import plans

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else int(x) if x == int(x) else round(x, 6)
    return x


def table(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(repr(plain(r[k])) for k in order) for r in rows))


def test_every_query_has_sql_or_is_a_flow():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"st_ledger", "x_converge"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert table([tuple(r) for r in got.collect()], got.columns) == table(want.fetchall(), names)
