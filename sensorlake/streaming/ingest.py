"""The ingest job: decode, type, id, and append to a date-partitioned Parquet table.

Works on a streaming or a batch message DataFrame. Each micro-batch is written to a folder
named after its number, in a folder named after the stream's id; offsets are logged before a
micro-batch, so a batch that is run again after a failure has the same rows and replaces its
folder: exactly once. The id lies in the checkpoint, so a stream that starts with a new
checkpoint, also at the path of a lost one, is another writer and replaces nothing. Other
writers may add to the same table meanwhile. With ``id_mode="stable"`` the id is a function
of (topic, partition, offset), so any other sink can be de-duplicated by ``id`` as well.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorlake.operators.readings import type_readings, with_id
from sensorlake.schema import METRICS, READING
from sensorlake.sources.messages import decode_messages, split_malformed
from sensorlake.sources.table import read_table, table_bytes, utc_date, write_batch, write_sorted

_COORDS = ("key", "topic", "partition", "offset")


def _table_rows(readings: DataFrame, id_mode: str, ntz: bool, keep=()) -> DataFrame:
    """Decoded readings with their coordinates -> rows of the table."""
    rows = with_id(type_readings(readings, ntz=ntz), mode=id_mode)
    sensor = F.coalesce(F.col("key").cast("string"), F.concat_ws("/", "topic", F.col("partition").cast("string")))
    return rows.select(
        "id",
        *METRICS,
        "timestamp",
        sensor.alias("sensor"),
        F.lit(None).cast("timestamp").alias("expires_at"),
        utc_date("timestamp", ntz).alias("reading_date"),
        *[c for c in keep if c not in ("id", "sensor", "timestamp")],
    )


def ingest_frame(messages: DataFrame, id_mode: str = "stable", keep=(), ntz: bool = False) -> DataFrame:
    """Messages -> table rows (``TABLE``, plus ``keep`` envelope columns). Garbage bodies
    become rows of NULL readings, as in the original job; use ``quarantine_frame`` to set
    them aside instead."""
    carry = list(dict.fromkeys([*_COORDS, *keep]))
    return _table_rows(decode_messages(messages, READING, keep=carry), id_mode, ntz, keep)


def quarantine_frame(messages: DataFrame, id_mode: str = "stable", ntz: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(good table rows, bad messages)``; bad rows keep the body, coordinates and a
    reason. Start one sink per side, each with its own checkpoint."""
    good, bad = split_malformed(messages, READING, keep=list(_COORDS))
    return _table_rows(good, id_mode, ntz), bad.drop("key")


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream when its checkpoint was made: the same after every
    restart from it. (A copy of a checkpoint is the same stream.)"""
    text = "".join(r.value for r in spark.read.text(f"{checkpoint.rstrip('/')}/metadata").collect())
    return json.loads(text)["id"]


def start_ingest(
    stream: DataFrame,
    table_path: str,
    checkpoint: str,
    trigger: dict | None = None,
    partition_by=("reading_date",),
    query_name: str | None = None,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Append ``stream`` to ``table_path``, exactly once, beside any other writer. The
    stream's folder in the table is named after the stream's id. If a checkpoint is lost, rows
    that the new stream reads again are in the table twice, with the same stable id;
    ``compact_table(one_per_id=True)`` keeps one of them.

    ``trigger``: ``None`` (next batch as soon as the previous ends), or a dict such as
    ``{"processingTime": "30 seconds"}`` (fewer, larger files) or
    ``{"availableNow": True}`` (drain what is there, then stop). Rows with a NULL
    timestamp land in the default partition, late rows in their own date.
    """
    names: list[str] = []

    def save(batch: DataFrame, number: int) -> None:
        if not names:
            names.append("stream-" + stream_id(batch.sparkSession, checkpoint))
        write_batch(batch, table_path, names[0], number, partition_by, fmt)

    w = stream.writeStream.foreachBatch(save).outputMode("append").option("checkpointLocation", checkpoint)
    if trigger:
        w = w.trigger(**trigger)
    if query_name:
        w = w.queryName(query_name)
    return w.start()


TARGET_FILE_BYTES = 256 * 1024 * 1024


def compact_table(
    spark: SparkSession,
    table_path: str,
    out_path: str,
    partitions: int | None = None,
    max_records_per_file: int | None = None,
    target_file_bytes: int = TARGET_FILE_BYTES,
    one_per_id: bool = False,
) -> None:
    """Rewrite the many small files of a streamed table into fewer, time-sorted ones.

    Range-partitioned on ``(reading_date, timestamp, id)``: a busy day spreads over
    several tasks instead of one, and sorted files give tight min/max statistics for
    time predicates. The number of ranges follows the table's size (about
    ``target_file_bytes`` per task), not a fixed shuffle setting, so a task never has
    to sort a share that grows with the table. ``one_per_id`` keeps one row of each id
    (messages that were read twice; one more shuffle, by id). ``sources.table.retire_batches``
    does the same to the batches of a running stream, in place."""
    df = read_table(spark, table_path)
    n = partitions or max(1, -(-table_bytes(spark, table_path) // target_file_bytes))
    if one_per_id:
        df = df.dropDuplicates(["id"])
    write_sorted(df, out_path, n, max_records_per_file)
