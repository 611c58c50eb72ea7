"""Plan shape checks: the properties the scale design relies on."""

import re

from __spark_entry__ import queries

from .conftest import SF_SMALL


def _plan(df):
    df.write.format("noop").mode("overwrite").save()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_change_detection_never_windows_a_whole_account(spark):
    plan = _plan(queries()["account_changes"](spark, SF_SMALL))
    # stored states are shuffled by chunk, never by account, and no window is over an account's rows
    parts = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert any("_chunk" in p for p in parts) and not any("account_address" in p for p in parts)
    windows = re.findall(r"Window \[[^\n]*", plan)
    assert windows and all(re.search(r"\[_(chunk|part)#\w+\]|\[_part#\w+ ASC", w) and "account_address" not in w.split("windowspecdefinition(")[-1] for w in windows)


def test_no_cartesian_or_nested_loop_joins(spark):
    for name in ("tx_enriched", "slot_commitment", "resolve_identifier", "archive_stats", "block_rollup"):
        plan = _plan(queries()[name](spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_top_k_is_group_limited_before_the_shuffle(spark):
    plan = queries()["last_k_signatures"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_scan_prunes_columns(spark):
    df = queries()["last_k_signatures"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan
