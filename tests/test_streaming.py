"""Stream = batch, checkpointed restart, replay after a lost commit, quarantine sinks."""

from __future__ import annotations

import glob
import os

from pyspark.sql import functions as F

from sensorlake.plans.dashboard import ingest_to_table
from sensorlake.plans.fixtures import envelopes_from_events, events
from sensorlake.schema import ENVELOPE, TOPIC
from sensorlake.sources.messages import read_messages
from sensorlake.sources.table import read_table
from sensorlake.streaming.ingest import compact_table, ingest_frame, quarantine_frame, start_ingest

from tests.conftest import SMOKE_DIR


def write_messages(spark, path, n_files=4, corrupt=False):
    env = envelopes_from_events(events(spark, SMOKE_DIR), corrupt=corrupt)
    env.repartitionByRange(n_files, "offset").write.mode("append").parquet(path)
    return env


def test_stream_equals_batch(spark, scratch):
    msgs = f"{scratch}/messages"
    write_messages(spark, msgs)
    batches = ingest_to_table(spark, msgs, f"{scratch}/table", f"{scratch}/ckpt", max_files_per_trigger=1)
    assert batches >= 4
    streamed = read_table(spark, f"{scratch}/table").drop("reading_date")
    batch = ingest_frame(read_messages(spark, "parquet", path=msgs, stream=False)).drop("reading_date")
    a = sorted(map(tuple, streamed.collect()), key=repr)
    b = sorted(map(tuple, batch.collect()), key=repr)
    assert a == b and len(a) == 1000


def test_restart_adds_nothing_then_only_new(spark, scratch):
    msgs, table, ckpt = f"{scratch}/m", f"{scratch}/t", f"{scratch}/c"
    write_messages(spark, msgs, n_files=2)
    ingest_to_table(spark, msgs, table, ckpt)
    assert read_table(spark, table).count() == 1000
    ingest_to_table(spark, msgs, table, ckpt)  # same input: +0 rows
    assert read_table(spark, table).count() == 1000
    env = envelopes_from_events(events(spark, SMOKE_DIR)).withColumn("offset", F.col("offset") + 100000)
    env.coalesce(1).write.mode("append").parquet(msgs)  # one new file
    ingest_to_table(spark, msgs, table, ckpt)
    t = read_table(spark, table)
    assert t.count() == 2000 and t.select("id").distinct().count() == 2000


def test_lost_commit_replays_without_duplicates(spark, scratch):
    msgs, table, ckpt = f"{scratch}/m", f"{scratch}/t", f"{scratch}/c"
    write_messages(spark, msgs, n_files=3)
    ingest_to_table(spark, msgs, table, ckpt, max_files_per_trigger=1)
    commits = sorted(glob.glob(f"{ckpt}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    last = commits[-1]
    os.rename(last, f"{scratch}/moved-commit")  # the batch now looks unfinished
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.rename(crc, f"{scratch}/moved-commit.crc")
    ingest_to_table(spark, msgs, table, ckpt, max_files_per_trigger=1)
    t = read_table(spark, table)
    assert t.count() == 1000 and t.select("id").distinct().count() == 1000


def test_quarantine_sinks(spark, scratch):
    msgs = f"{scratch}/m"
    write_messages(spark, msgs, n_files=2, corrupt=True)
    stream = read_messages(spark, "parquet", path=msgs, schema=ENVELOPE)
    good, bad = quarantine_frame(stream)
    q1 = start_ingest(good, f"{scratch}/good", f"{scratch}/c1", trigger={"availableNow": True})
    q2 = start_ingest(bad, f"{scratch}/bad", f"{scratch}/c2", trigger={"availableNow": True}, partition_by=())
    q1.awaitTermination()
    q2.awaitTermination()
    n_good = read_table(spark, f"{scratch}/good").count()
    bad_rows = spark.read.parquet(f"{scratch}/bad")
    assert n_good + bad_rows.count() == 1000
    assert bad_rows.where("offset % 10 <> 0").count() == 0


def test_compaction_keeps_rows(spark, scratch):
    msgs, table = f"{scratch}/m", f"{scratch}/t"
    write_messages(spark, msgs, n_files=4)
    ingest_to_table(spark, msgs, table, f"{scratch}/c", max_files_per_trigger=1)
    compact_table(spark, table, f"{scratch}/compact", partitions=4)
    a = read_table(spark, table)
    b = read_table(spark, f"{scratch}/compact")
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    n_before = len(glob.glob(f"{table}/**/*.parquet", recursive=True))
    n_after = len(glob.glob(f"{scratch}/compact/**/*.parquet", recursive=True))
    assert n_after <= n_before


def test_row_local_checks_run_on_a_stream(spark, scratch):
    from sensorlake.operators.quality import range_flags, temperature_residual
    from sensorlake.operators.readings import type_readings
    from sensorlake.sources.messages import decode_messages

    msgs = f"{scratch}/m"
    write_messages(spark, msgs, n_files=2)
    stream = read_messages(spark, "parquet", path=msgs, schema=ENVELOPE)
    checked = temperature_residual(range_flags(type_readings(decode_messages(stream, keep=["offset"]))))
    q = (
        checked.writeStream.format("parquet").option("checkpointLocation", f"{scratch}/c")
        .trigger(availableNow=True).start(f"{scratch}/out")
    )
    q.awaitTermination()
    streamed = spark.read.parquet(f"{scratch}/out")
    batch = temperature_residual(range_flags(type_readings(decode_messages(
        read_messages(spark, "parquet", path=msgs, stream=False), keep=["offset"]))))
    cols = ["offset", "co2_in_range", "humidity_in_range", "temperature_residual"]
    assert sorted(map(tuple, streamed.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def test_write_messages_and_processing_time_trigger(spark, scratch):
    import time

    from sensorlake.sources.messages import kafka_options, write_messages

    opts = kafka_options("broker:9092", max_offsets_per_trigger=500)
    assert opts["subscribe"] == TOPIC and opts["maxOffsetsPerTrigger"] == "500"
    assert opts["startingOffsets"] == "latest" and opts["failOnDataLoss"] == "true"
    env = envelopes_from_events(events(spark, SMOKE_DIR))
    write_messages(env, fmt="parquet", path=f"{scratch}/m")
    stream = read_messages(spark, "parquet", path=f"{scratch}/m", schema=ENVELOPE)
    q = start_ingest(ingest_frame(stream), f"{scratch}/t", f"{scratch}/c", trigger={"processingTime": "1 second"})
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert read_table(spark, f"{scratch}/t").count() == 1000
    assert q.lastProgress is not None
    time.sleep(0)


def test_compaction_sizes_ranges_from_bytes(spark, scratch):
    from sensorlake.sources.table import table_bytes

    msgs, table = f"{scratch}/m", f"{scratch}/t"
    write_messages(spark, msgs, n_files=4)
    ingest_to_table(spark, msgs, table, f"{scratch}/c", max_files_per_trigger=1)
    size = table_bytes(spark, table)
    on_disk = sum(os.path.getsize(p) for p in glob.glob(f"{table}/**/*.parquet", recursive=True))
    assert size == on_disk
    compact_table(spark, table, f"{scratch}/k", target_file_bytes=max(1, size // 3))
    assert read_table(spark, f"{scratch}/k").count() == 1000
