"""Queries of this subpackage whose result SQL can express, against DuckDB; and that all are registered."""

import pytest

import __spark_entry__
from tests.oracle import assert_same, connect
from tidewater.llm import queries

SF = "/root/testdata/sf0.01"
CONNECTION = connect(SF)


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query(spark, name):
    assert_same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], CONNECTION)


def test_all_are_registered():
    names = [n for n in __spark_entry__.queries() if n == "pipeline" or n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op1_license_scan", "op4_chat_format", "op6_mixing", "op9_fingerprints"])
def test_native_plans_have_no_python(spark, name):
    plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
