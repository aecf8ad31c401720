"""Scale lint over the physical plans of every registered query: no
SortAggregate (map-side sort of a whole input), no Cartesian product, and a
single-partition exchange only below a global aggregate (one output row)."""

from __future__ import annotations

import os

import pytest

from tarmac.plans.catalog import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" :+-"))


def _lint(plan: str) -> list[str]:
    lines = [ln for ln in plan.splitlines() if ln.strip()]
    problems = []
    for i, line in enumerate(lines):
        if "SortAggregate" in line:
            problems.append("SortAggregate")
        if "CartesianProduct" in line:
            problems.append("CartesianProduct")
        if "Exchange SinglePartition" in line:
            parent = next((lines[j] for j in range(i - 1, -1, -1)
                           if _indent(lines[j]) < _indent(line)), "")
            if "HashAggregate(keys=[]" not in parent:
                problems.append(f"single partition under: {parent.strip()[:80]}")
    return problems


@pytest.mark.parametrize("name", sorted(queries()))
def test_plan_scales(spark, name):
    df = queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert _lint(plan) == []


def test_lint_catches_whole_table_window_and_sort_aggregate(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    w = df.withColumn("rn", F.row_number().over(Window.orderBy("id")))
    assert any("single partition" in p for p in _lint(
        w._jdf.queryExecution().executedPlan().toString()))
    s = df.groupBy("g").agg(F.min(F.struct("id", "g")).alias("m"))
    assert "SortAggregate" in _lint(s._jdf.queryExecution().executedPlan().toString())
    ok = df.agg(F.sum("id"))
    assert _lint(ok._jdf.queryExecution().executedPlan().toString()) == []
