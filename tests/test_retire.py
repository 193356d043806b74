"""Writers that keep apart, and batches that are retired while a stream goes on."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sensorlake.jobs import main
from sensorlake.plans.dashboard import ingest_to_table, latest_in_table, page_table
from sensorlake.plans.fixtures import envelopes_from_events, events
from sensorlake.sources import table as T
from sensorlake.sources.table import newest_mark, partition_dates, read_table, retire_batches, table_bytes, write_batch
from sensorlake.streaming.ingest import compact_table

from tests.conftest import SMOKE_DIR


def send(spark, folder, low, high):
    env = envelopes_from_events(events(spark, SMOKE_DIR)).where(F.col("offset").between(low, high - 1))
    env.coalesce(1).write.mode("append").parquet(folder)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def stream(spark, base, low, high, checkpoint="checkpoint"):
    for at in range(low, high, 20):
        send(spark, f"{base}/messages-{checkpoint}", at, min(high, at + 20))
    ingest_to_table(spark, f"{base}/messages-{checkpoint}", f"{base}/table", f"{base}/{checkpoint}", max_files_per_trigger=1)


def folders(base):
    return sorted(f"{s}/{b}" for s in os.listdir(f"{base}/table") if s.startswith("source=") for b in os.listdir(f"{base}/table/{s}"))


def test_a_new_checkpoint_at_the_same_path_replaces_nothing(spark, scratch):
    stream(spark, scratch, 0, 40)
    before = ids(read_table(spark, f"{scratch}/table"))
    spark.range(0).write.mode("overwrite").parquet(f"{scratch}/checkpoint")
    stream(spark, scratch, 40, 60)  # the new stream reads all messages again
    rows = ids(read_table(spark, f"{scratch}/table"))
    assert len(before) == 40 and sorted(set(rows)) == sorted({*before, *rows}) and len(set(rows)) == 60 and len(rows) == 100
    compact_table(spark, f"{scratch}/table", f"{scratch}/once", one_per_id=True)
    assert ids(read_table(spark, f"{scratch}/once")) == sorted(set(rows))


def test_a_batch_that_runs_again_replaces_itself(spark, scratch):
    stream(spark, scratch, 0, 60)
    before = ids(read_table(spark, f"{scratch}/table"))
    last = max(int(n) for n in os.listdir(f"{scratch}/checkpoint/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{scratch}/checkpoint/commits/{name}")
    retire_batches(spark, f"{scratch}/table")  # leaves the last batch to its stream
    stream(spark, scratch, 60, 80)
    assert set(before) < set(ids(read_table(spark, f"{scratch}/table"))) and len(ids(read_table(spark, f"{scratch}/table"))) == 80


def test_every_row_once_through_several_runs(spark, scratch):
    table = f"{scratch}/table"
    for k in range(2):
        stream(spark, scratch, 80 * k, 80 * k + 40)
        stream(spark, scratch, 80 * k + 40, 80 * k + 80, "other")
        everything = ids(read_table(spark, table))
        assert len(everything) == 80 * (k + 1) == len(set(everything))
        assert retire_batches(spark, table) > 0
        assert ids(read_table(spark, table)) == everything
    # Two streams: their newest batches, and what the last run has retired.
    left = folders(scratch)
    assert len([f for f in left if "part-" in f]) == 2
    assert retire_batches(spark, table) == 0
    assert len(folders(scratch)) == 4 and ids(read_table(spark, table)) == everything
    assert table_bytes(spark, table) > 0
    dates = read_table(spark, table).select("reading_date").distinct().collect()
    assert partition_dates(spark, table) == sorted(r.reading_date for r in dates)
    wanted = read_table(spark, table).orderBy(F.col("timestamp").desc(), "id").limit(30).select("id").collect()
    assert [r.id for r in latest_in_table(spark, table, 30).collect()] == [r.id for r in wanted]
    assert page_table(spark, table, 7).count() == 7
    with pytest.raises(ValueError):
        read_table(spark, table, stream=True)


@pytest.mark.parametrize("stop", ["part", "mark", "removal"])
def test_stopped_midway(spark, scratch, monkeypatch, stop):
    stream(spark, scratch, 0, 60)
    table = f"{scratch}/table"
    everything = ids(read_table(spark, table))
    if stop == "part":  # the part is there in half, no mark
        write_batch(read_table(spark, table).limit(10), table, "part-0", 0)
        spark.createDataFrame([("x",)], "part string").write.json(f"{table}/_marks/00000000")
        os.remove(f"{table}/_marks/00000000/_SUCCESS")
    elif stop == "mark":

        def fail(df, path, tasks):
            real(df.limit(5), path, tasks)
            raise RuntimeError("stopped")

        real = T.write_sorted
        monkeypatch.setattr(T, "write_sorted", fail)
        with pytest.raises(RuntimeError):
            retire_batches(spark, table)
        monkeypatch.setattr(T, "write_sorted", real)
        assert newest_mark(spark, table) is None
    else:
        retire_batches(spark, table)  # nothing is removed before the next run
    retire_batches(spark, table)
    retire_batches(spark, table)
    assert ids(read_table(spark, table)) == everything
    assert newest_mark(spark, table).number == (1 if stop == "part" else 0)


def test_imports_stay_and_can_be_replaced(spark, scratch):
    stream(spark, scratch, 0, 60)
    table = f"{scratch}/table"
    rows = read_table(spark, table).where(F.col("timestamp").isNotNull())
    write_batch(rows.limit(20).withColumn("id", F.concat(F.lit("copy-"), "id")), table, "copy")
    main(["compact", "--table", table], spark)
    assert read_table(spark, table).count() == 80
    again = spark.createDataFrame([("copy-1", datetime(2024, 1, 1))], "id string, timestamp timestamp")
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in T.TABLE.fields if f.name not in ("id", "timestamp", "reading_date")]
    write_batch(again.select("*", *missing, F.to_date("timestamp").alias("reading_date")), table, "copy")
    assert read_table(spark, table).count() == 61
