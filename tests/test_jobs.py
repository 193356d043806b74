"""The command-line jobs: one table, a stream and an import as its writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlake import jobs
from sensorlake.plans.fixtures import envelopes_from_events, events
from sensorlake.sources.table import read_table

from tests.conftest import SMOKE_DIR

OPTIONS = ["--option", "HEADER=true", "--option", "DATETIMEFORMAT=%Y-%m-%d %H:%M:%S.%f%z"]


def test_a_stream_and_imports_write_one_table(spark, scratch):
    messages, table = f"{scratch}/m", f"{scratch}/t"
    env = envelopes_from_events(events(spark, SMOKE_DIR), corrupt=True)
    env.write.parquet(messages)
    ingest = ["ingest", "--table", table, "--checkpoint", f"{scratch}/c", "--messages", messages, "--available-now"]
    jobs.main([*ingest, "--quarantine", f"{scratch}/bad"], spark)
    assert read_table(spark, table).count() == 900 and spark.read.parquet(f"{scratch}/bad").count() == 100
    jobs.main(["copy-to", "--table", table, "--path", f"{scratch}/csv", *OPTIONS], spark)
    copy = ["copy-from", "--table", table, "--paths", f"{scratch}/csv", "--source", "again", *OPTIONS, "--option", "TTL=60"]
    jobs.main(copy, spark)
    jobs.main(copy, spark)  # the same import again replaces itself
    jobs.main(ingest, spark)  # and the stream goes on as if alone
    rows = read_table(spark, table)
    assert rows.count() == 1800 and rows.where("expires_at is not null").count() == 900
    per = rows.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("timestamp", "sensor", "co2").alias("d"))
    assert per.where("n <> 2 or d <> 1").count() == 0


def test_report_quality_and_compaction(spark, scratch):
    envelopes_from_events(events(spark, SMOKE_DIR)).write.parquet(f"{scratch}/m")
    table = f"{scratch}/t"
    jobs.main(["ingest", "--table", table, "--checkpoint", f"{scratch}/c", "--messages", f"{scratch}/m", "--available-now"], spark)
    jobs.main(["compact", "--table", table, "--out", f"{scratch}/k"], spark)
    jobs.main(["report", "--table", f"{scratch}/k", "-n", "7", "--out", f"{scratch}/r", "--out-format", "json"], spark)
    assert spark.read.json(f"{scratch}/r").count() == 7
    jobs.main(["quality", "--table", f"{scratch}/k", "--out", f"{scratch}/q"], spark)
    q = spark.read.parquet(f"{scratch}/q")
    sensors = read_table(spark, table).select("sensor").distinct().count()
    assert q.count() == 1000 and q.where("co2_step is null").count() == sensors > 1
