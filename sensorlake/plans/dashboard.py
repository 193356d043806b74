"""The end-to-end plans of the original system, expressed as Spark jobs.

``ingest_to_table``: messages -> decode -> type -> stable id -> exactly-once append to a
date-partitioned Parquet table (Structured Streaming, ``availableNow`` by default).
``dashboard``: table -> report columns -> newest ``n`` -> presentation headers, one plan.
"""

from __future__ import annotations

from datetime import date, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.operators.readings import presentation, report_columns
from sensorlake.operators.report import latest, page
from sensorlake.schema import ENVELOPE
from sensorlake.sources.messages import read_messages
from sensorlake.sources.table import partition_dates, read_table
from sensorlake.streaming.ingest import ingest_frame, start_ingest

def ingest_to_table(
    spark: SparkSession,
    messages_path: str,
    table_path: str,
    checkpoint: str,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
    trigger: dict | None = None,
    id_mode: str = "stable",
) -> int:
    """Stream message envelopes stored at ``messages_path`` into the table and wait until
    everything available is committed. Returns the number of micro-batches run."""
    opts = {}
    if max_files_per_trigger:
        opts["maxFilesPerTrigger"] = str(max_files_per_trigger)
    stream = read_messages(spark, fmt=fmt, options=opts, path=messages_path, schema=ENVELOPE)
    q = start_ingest(
        ingest_frame(stream, id_mode=id_mode),
        table_path,
        checkpoint,
        trigger=trigger or {"availableNow": True},
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return len(q.recentProgress)


def latest_in_table(spark: SparkSession, table_path: str, n: int = 100, tiebreak="id") -> DataFrame:
    """The ``n`` newest rows of the stored table, reading only the newest partitions.

    ``reading_date`` is the date of ``timestamp``, so every row of a later date is newer
    than every row of an earlier one: the newest ``n`` rows of the dates from a cutoff
    on are the newest ``n`` of the table as soon as those dates hold ``n`` rows. The
    window starts at the newest date and doubles until it does (or takes everything,
    including rows without a timestamp). Each try is a top-``n`` with partition pruning.
    """
    full = read_table(spark, table_path)
    dates = partition_dates(spark, table_path)
    days = 1
    while dates:
        cutoff = dates[-1] - timedelta(days=days - 1)
        if cutoff <= dates[0]:
            break  # every dated partition is in: fall through to the whole table
        recent = full.where(F.col("reading_date") >= F.lit(cutoff))
        # A count over pruned partitions reads Parquet footers only, not data pages.
        if recent.count() >= n:
            return latest(report_columns(recent), n, "timestamp", tiebreak)
        days *= 2
    return latest(report_columns(full), n, "timestamp", tiebreak)


def page_table(spark: SparkSession, table_path: str, size: int = 100, after=None) -> DataFrame:
    """Pages of the stored table in time order (``timestamp, id``; rows without a time come
    first), keyset style.

    ``after`` is the ``(timestamp, id)`` of the previous page's last row. ``reading_date`` is
    the day of ``timestamp`` in UTC, so a page lies in the days from that row's on (one day
    of slack); the window of days doubles until it holds a page, and partitions outside of it
    are not read."""
    full = read_table(spark, table_path)
    dates = partition_dates(spark, table_path)
    order = ["timestamp", "id"]
    if after is not None and after[0] is not None:
        first = after[0].astimezone(timezone.utc).date() - timedelta(days=1)
        dates = [d for d in dates if d >= first]
        start = F.col("reading_date") >= F.lit(first)
        windows = [start & (F.col("reading_date") <= F.lit(d)) for d in _doubling(dates)]
    else:
        start = F.lit(True)
        undated = F.col("reading_date").isNull()
        windows = [undated, *[undated | (F.col("reading_date") <= F.lit(d)) for d in _doubling(dates)]]
    for days in windows:
        found = page(report_columns(full.where(days)), order, size, after=after)
        if found.count() >= size:
            return found
    return page(report_columns(full.where(start)), order, size, after=after)


def _doubling(dates: list[date]) -> list[date]:
    """The 1st, 2nd, 4th, 8th ... date but the last."""
    return [dates[i] for i in (2**k - 1 for k in range(40)) if i < len(dates) - 1]


def dashboard(spark: SparkSession, table_path: str, n: int = 100) -> DataFrame:
    """The report page: the ``n`` newest readings under their display headers."""
    return presentation(latest_in_table(spark, table_path, n))
