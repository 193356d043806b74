"""Step flags on a live stream, and reads of stored tables that skip what they don't need."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sensorlake.operators.keys import token, token_splits
from sensorlake.operators.quality import step_flags
from sensorlake.operators.report import lookup
from sensorlake.plans.catalog import QUERIES
from sensorlake.schema import METRICS, TABLE
from sensorlake.sources.table import read_table, read_token_range, utc_date, write_by_token
from sensorlake.streaming.ingest import compact_table
from sensorlake.streaming.steps import step_flags_stream

from tests.conftest import SMOKE_DIR

NOON = datetime(2024, 3, 1, 12)
SCHEMA = "id string, sensor string, timestamp timestamp, pm25 float, pm10 float, co2 float, temperature float, humidity float"


def reading(i, sensor, minute, v, temperature=20.0):
    when = None if minute is None else NOON + timedelta(minutes=minute, microseconds=minute * 7 + 1)
    return (i, sensor, when, v, None if v is None else v * 2, 400.0 + (v or 0), temperature, 40.0 + (v or 0) / 10)


def run(spark, base, rows):
    """One micro-batch of a stream that is started anew each time; all rows so far."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    flags = step_flags_stream(spark.readStream.schema(SCHEMA).parquet(f"{base}/in"))
    sink = flags.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint")
    q = sink.trigger(availableNow=True).start(f"{base}/out")
    q.awaitTermination()
    assert q.exception() is None
    return spark.read.schema(flags.schema).parquet(f"{base}/out")


def comparable(df, columns):
    def norm(v):
        return "NaN" if isinstance(v, float) and math.isnan(v) else v

    return sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)


def test_steps_across_restarts_and_late_readings(spark, scratch):
    nan = float("nan")
    first = [
        reading("b", "s", 1, 2.0), reading("a", "s", 1, 1.0), reading("c", "s", 3, nan, None), reading("d", None, 2, 5.0),
        reading("n", "s", None, 9.0), reading("e", "t", 50, 1.5),
    ]
    second = [
        reading("f", "s", 5, None), reading("g", "s", 4, 3.0, 30.0), reading("h", "t", 51, 1.25),
        reading("late1", "s", 2, 7.0), reading("c", "s", 3, nan, None), reading("late2", "t", None, 1.0), reading("i", None, 3, 5.5),
    ]
    third = [reading("j", "s", 6, 4.0), reading("late3", "s", 5, 4.0)]
    run(spark, scratch, first)
    run(spark, scratch, second)
    out = run(spark, scratch, third)
    assert [f.name for f in out.schema.fields[:4]] == ["sensor", "timestamp", "id", "late"]
    late = out.where("late").collect()
    assert sorted(r.id for r in late) == ["c", "late1", "late2"]
    assert all(r.pm25_step is None and r.pm25_step_ok is None for r in late)
    on_time = [*first, *[r for r in second if r[0] not in ("late1", "c", "late2")], *third]
    batch = step_flags(spark.createDataFrame(on_time, SCHEMA), "sensor", "timestamp", ("id",))
    columns = [c for c in out.columns if c != "late"]
    assert comparable(out.where("not late"), columns) == comparable(batch, columns)


def test_steps_with_whole_number_tiebreak_and_wall_clocks(spark, scratch):
    rows = [(10, 1, 2.0), (9, 1, 1.0), (100, 1, 3.0)]
    df = spark.createDataFrame(rows, "event_id long, sensor long, pm25 float").withColumns(
        {"timestamp": F.lit("2024-03-01 00:00:00.000001").cast("timestamp_ntz"), **{m: F.lit(1.0).cast("float") for m in METRICS[1:]}}
    )
    df.coalesce(1).write.parquet(f"{scratch}/in")
    flags = step_flags_stream(spark.readStream.schema(df.schema).parquet(f"{scratch}/in"), tiebreak="event_id")
    q = flags.writeStream.format("parquet").option("checkpointLocation", f"{scratch}/c").trigger(availableNow=True).start(f"{scratch}/out")
    q.awaitTermination()
    got = {r.event_id: (r.pm25_step, r.timestamp) for r in spark.read.schema(flags.schema).parquet(f"{scratch}/out").collect()}
    when = datetime(2024, 3, 1, 0, 0, 0, 1)
    assert got == {9: (None, when), 10: (1.0, when), 100: (1.0, when)}


def test_steps_of_many_sensors_share_buckets(spark, scratch):
    """The state function and its state are a bucket's, however many sensors there are."""
    def sensors(batch):
        i, late = F.col("id"), F.col("id") % 5 == 0
        # Sensors of the second batch: half of the first's and as many new ones; a fifth is late.
        minute = F.when(F.lit(batch == 1) & late, -1).otherwise(batch * 10 + i % 3)
        rows = spark.range(4500).select(
            F.concat(F.lit(f"{batch}-"), i.cast("string")).alias("id"),
            (i % 1500 + 750 * batch).cast("string").alias("sensor"),
            F.lit(NOON).cast("timestamp") + F.make_dt_interval(mins=minute) + F.make_dt_interval(secs=(i * 1e-4).cast("decimal(18,6)")),
            *[(i % 7 + batch).cast("float").alias(m) for m in METRICS],
        )
        return rows.toDF("id", "sensor", "timestamp", *METRICS)

    for batch in (0, 1):
        sensors(batch).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        flags = step_flags_stream(spark.readStream.schema(sensors(0).schema).parquet(f"{scratch}/in"))
        sink = flags.writeStream.format("parquet").option("checkpointLocation", f"{scratch}/c").trigger(availableNow=True)
        q = sink.start(f"{scratch}/out")
        q.awaitTermination()
        assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1024
    out = spark.read.schema(flags.schema).parquet(f"{scratch}/out")
    # Late are the second batch's moved-back readings of sensors that the first batch had.
    moved = sensors(1).where("substr(id, 3) % 5 = 0 and sensor < 1500").select("id")
    assert sorted(r.id for r in out.where("late").collect()) == sorted(r.id for r in moved.collect())
    on_time = sensors(0).unionByName(sensors(1)).join(moved, "id", "left_anti")
    columns = [c for c in out.columns if c != "late"]
    batch = step_flags(on_time, "sensor", "timestamp", ("id",))
    assert comparable(out.where("not late"), columns) == comparable(batch, columns)


def rows_scanned(df) -> int:
    """Rows that the scan of an executed plan has handed on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("stored"))
    times = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 40)
    rows = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("id"), times.alias("timestamp"))
    rows = rows.withColumn("reading_date", utc_date("timestamp"))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in TABLE.fields if f.name not in rows.columns]
    rows.select("*", *missing).write.partitionBy("reading_date").parquet(f"{base}/raw")
    compact_table(spark, f"{base}/raw", f"{base}/compacted", partitions=10)
    return base


def test_lookup_by_id_reads_few_row_groups(spark, stored):
    table = read_table(spark, f"{stored}/compacted")
    for n in (0, 7777, 19_999):
        key = spark.range(1).select(F.md5(F.lit(str(n)))).first()[0]
        found = lookup(table, "id", key)
        assert rows_scanned(found) < 20_000 / 5
        assert found.count() == 1
    assert rows_scanned(lookup(table, "id", "no such id")) < 20_000 / 5


def test_token_ranges_read_their_share(spark, scratch):
    df = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    write_by_token(df, f"{scratch}/t", "k", 16)
    parts = [read_token_range(spark, f"{scratch}/t", b, e) for b, e in token_splits(4)]
    scanned = [rows_scanned(p) for p in parts]
    assert max(scanned) < 20_000 * 0.45 and sum(scanned) < 20_000 * 1.5
    found = [r.k for p in parts for r in p.collect()]
    assert sorted(found) == list(range(20_000))
    assert read_token_range(spark, f"{scratch}/t").where(F.col("token") != token("k")).count() == 0


def test_row_count_parses_nothing(spark):
    plan = QUERIES["row_count"](spark, SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "json" not in plan
