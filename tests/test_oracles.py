"""Every core query with SQL gives the rows DuckDB gives."""

import importlib

import pytest

import __spark_entry__ as entry

REGS = [importlib.import_module(f"provenix.plans.{n}").REG for n in entry._PLANS]
CASES = [(n, r.plans[n], r.sql[n]) for r in REGS for n in r.plans if n in r.sql]


@pytest.mark.parametrize("name,plan,sql", CASES, ids=[c[0] for c in CASES])
def test_sql(compare, name, plan, sql):
    compare(plan, sql)
