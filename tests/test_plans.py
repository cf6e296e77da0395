"""Physical-plan properties of the registered queries (sf0.001 inputs)."""

import re

import pytest

import __spark_entry__ as E
from proofloom.plans import catalog

SF = "/root/testdata/sf0.001"
# Queries that write and read back their input (planning them runs jobs).
WRITES = {n for n in catalog.queries() if n.startswith(("scan_", "sink_"))}
PLANNED = sorted(set(catalog.queries()) - WRITES)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_python_and_no_global_window(spark, name):
    plan = plan_of(E.queries()[name](spark, SF))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|PythonUDF", plan), name
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            assert "], [], [" not in line, f"{name}: window without partition key: {line.strip()[:200]}"


def test_filter_and_pruning_reach_scan(spark):
    df = E.queries()["filter_topic"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(source,src3\)", plan)
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", plan).group(1)
    assert "text" not in schema and "source" in schema


def test_metrics_aggregate_is_partial_then_final(spark):
    plan = plan_of(E.queries()["compute_metrics"](spark, SF))
    assert "partial_" in plan or "ObjectHashAggregate" in plan
