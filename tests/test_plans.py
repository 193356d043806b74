"""Plan checks: the properties the scale design relies on, read from executed plans."""

from __future__ import annotations

import re

from sensorlake.operators.sequence import number_rows, with_previous
from sensorlake.plans.catalog import q_point_lookup, q_split_bad, q_split_good, q_step_flags
from sensorlake.plans.fixtures import decoded_readings

from tests.conftest import SMOKE_DIR


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def final_part(plan: str) -> str:
    """The final adaptive plan (AQE prints the initial plan after it)."""
    return plan.split("+- == Initial Plan ==")[0]


def test_each_message_is_parsed_once(spark):
    for q in (q_split_good, q_split_bad):
        plan = final_part(executed(q(spark, SMOKE_DIR)))
        assert plan.count("from_json(") == 1, plan


def test_lookup_filter_reaches_the_scan(spark):
    plan = executed(q_point_lookup(spark, SMOKE_DIR))
    assert "PushedFilters: [IsNotNull(event_id), EqualTo(event_id,42)]" in plan


def test_table_scan_reads_only_needed_columns(spark, scratch):
    from sensorlake.plans.dashboard import ingest_to_table
    from sensorlake.plans.fixtures import envelopes_from_events, events
    from sensorlake.sources.table import read_table

    envelopes_from_events(events(spark, SMOKE_DIR)).write.parquet(f"{scratch}/m")
    ingest_to_table(spark, f"{scratch}/m", f"{scratch}/t", f"{scratch}/c")
    plan = executed(read_table(spark, f"{scratch}/t").select("id", "pm25"))
    assert "ReadSchema: struct<id:string,pm25:float>" in plan


def test_decode_without_parse_once_prunes_the_parse(spark):
    from pyspark.sql import functions as F

    from sensorlake.plans.fixtures import envelopes_from_events, events
    from sensorlake.sources.messages import decode_messages

    env = envelopes_from_events(events(spark, SMOKE_DIR))
    only_keys = decode_messages(env, keep=["offset"], parse_once=False).select("offset")
    assert "from_json" not in final_part(executed(only_keys))
    one_field = decode_messages(env, keep=["offset"], parse_once=False).select("offset", "pm25")
    assert one_field.where(F.col("pm25").isNotNull()).count() == 1000


def test_sequence_ops_split_keys_without_nested_loop_joins(spark):
    r = decoded_readings(spark, SMOKE_DIR).select("event_id", "sensor", "timestamp", "pm25")
    for df in (
        number_rows(r, ["timestamp", "event_id"], rows_per_slice=100),
        number_rows(r, ["timestamp", "event_id"], "sensor", rows_per_slice=20),
        with_previous(r, "sensor", ["timestamp", "event_id"], ["pm25"], rows_per_slice=20),
    ):
        plan = final_part(executed(df))
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
        # windows run per (key, slice); border tables are broadcast back
        assert re.search(r"windowspecdefinition\((sensor#\d+L, )?_slice", plan)
        assert "BroadcastHashJoin" in plan


def test_step_flags_plain_window_when_no_key_is_heavy(spark):
    plan = final_part(executed(q_step_flags(spark, SMOKE_DIR)))
    assert "BroadcastHashJoin" not in plan and "Window" in plan
