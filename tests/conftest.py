"""Shared session and the comparison of a query with its SQL."""

from __future__ import annotations

import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from provenix.session import local_session

    session = local_session("4", 4)
    yield session


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.11g}")
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con


@pytest.fixture(scope="session")
def compare(spark):
    con = duck(SF)

    def check(plan, sql: str) -> int:
        df = plan(spark, SF)
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(df.columns) == sorted(names)
        want = rows(names, cur.fetchall())
        got = rows(df.columns, [tuple(r) for r in df.collect()])
        assert len(got) == len(want)
        assert got == want
        return len(got)

    return check
