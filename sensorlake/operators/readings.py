"""Typing, ids and projections of decoded readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.functions.text import stable_uuid
from sensorlake.functions.time import parse_ts
from sensorlake.schema import PRESENTATION_LABELS, REPORT_COLUMNS


def type_readings(df: DataFrame, ts: str = "timestamp", ntz: bool = False) -> DataFrame:
    """Replace the timestamp text by its parsed value (NULL when malformed)."""
    return df.withColumn(ts, parse_ts(F.col(ts), ntz=ntz))


def with_id(
    df: DataFrame,
    mode: str = "stable",
    keys=("topic", "partition", "offset"),
    name: str = "id",
) -> DataFrame:
    """Add an id column.

    ``mode="random"``: a random UUID per row, as the original job does; a replayed
    micro-batch gets new ids. ``mode="stable"``: UUID-shaped md5 of the message
    coordinates ``keys``, identical on replay. Rows whose last key (the offset) is NULL
    can't be told apart by their coordinates and get a random id.
    """
    if mode == "random":
        return df.withColumn(name, F.expr("uuid()"))
    if mode == "stable":
        return df.withColumn(name, F.when(F.col(keys[-1]).isNotNull(), stable_uuid(*keys)).otherwise(F.expr("uuid()")))
    raise ValueError(f"unknown id mode {mode!r}")


def report_columns(df: DataFrame) -> DataFrame:
    """The seven report columns, selected by name."""
    return df.select(*REPORT_COLUMNS)


def presentation(df: DataFrame) -> DataFrame:
    """Drop ``id`` and rename to the report's column headers (``PM2.5`` contains a dot:
    reference it with backticks)."""
    return df.select(*[F.col(src).alias(label) for src, label in PRESENTATION_LABELS])


def select_columns(df: DataFrame, cols=None, skip=()) -> DataFrame:
    """Column subset (default all, in the given order) minus a skip list."""
    names = list(cols) if cols else list(df.columns)
    missing = [c for c in list(names) + list(skip) if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}")
    return df.select(*[c for c in names if c not in set(skip)])
