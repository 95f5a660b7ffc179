"""Plans: no cross products, no row-wise Python, pruned scans, partial aggregation."""

from __future__ import annotations

import pytest

from sessionloom.plans import catalog
from sessionloom.operators import state, windows
from sessionloom.plans import inputs

catalog.load()
BANNED = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"]


def plan_of(df) -> str:
    text = df._jdf.queryExecution().toString()
    return text[text.index("== Physical Plan"):]


@pytest.mark.parametrize("name", [n for n in sorted(catalog.QUERIES) if not n.startswith(("src_", "snk_")) and "stream" not in n])
def test_no_banned_operator(spark, sf, name):
    plan = plan_of(catalog.QUERIES[name](spark, sf))
    assert [word for word in BANNED if word in plan] == []


def test_scan_reads_only_needed_columns(spark, sf):
    plan = plan_of(state.bucket_sums(inputs.updates(spark, sf), inputs.DAY))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan


def test_sums_are_combined_before_the_shuffle(spark, sf):
    plan = plan_of(state.chunk_sums(inputs.updates(spark, sf), 0.9, inputs.DAY))
    assert "partial_sum" in plan and plan.count("Exchange hashpartitioning") == 1


def test_windows_copy_panes_not_rows(spark, sf):
    plan = plan_of(windows.window_scores(inputs.updates(spark, sf), inputs.DAY, inputs.HOUR))
    below = plan[plan.index("Generate explode"):]
    assert "HashAggregate" in below
