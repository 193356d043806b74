"""Structured Streaming ingest: messages -> typed readings -> partitioned Parquet table."""

from sensorlake.streaming.ingest import (
    compact_table,
    ingest_frame,
    quarantine_frame,
    start_ingest,
)

__all__ = ["compact_table", "ingest_frame", "quarantine_frame", "start_ingest"]
