"""Declared schemas. No inference, no evolution: every field nullable."""

from __future__ import annotations

from pyspark.sql.types import (
    BinaryType,
    DateType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# The topic subscribed to and the report labels of the original pipeline.
TOPIC = "air_quality"
METRICS = ("pm25", "pm10", "co2", "temperature", "humidity")
REPORT_COLUMNS = ("id", "pm25", "pm10", "co2", "temperature", "humidity", "timestamp")
PRESENTATION_LABELS = (
    ("timestamp", "Timestamp"),
    ("pm25", "PM2.5"),
    ("pm10", "PM10"),
    ("co2", "CO2"),
    ("temperature", "Temperature"),
    ("humidity", "Humidity"),
)

# One JSON message body: five float metrics and a naive-UTC ISO-8601 text timestamp.
READING = StructType(
    [StructField(m, FloatType(), True) for m in METRICS]
    + [StructField("timestamp", StringType(), True)]
)

# What a Kafka source yields; file-based test streams use the same columns.
ENVELOPE = StructType(
    [
        StructField("key", BinaryType(), True),
        StructField("value", BinaryType(), True),
        StructField("topic", StringType(), True),
        StructField("partition", IntegerType(), True),
        StructField("offset", LongType(), True),
        StructField("timestamp", TimestampType(), True),
        StructField("timestampType", IntegerType(), True),
    ]
)

# The stored table: report columns, the sensor (the message key, or the source partition
# where a message has none), an expiry time, and the date partition column (in UTC).
TABLE = StructType(
    [StructField("id", StringType(), True)]
    + [StructField(m, FloatType(), True) for m in METRICS]
    + [
        StructField("timestamp", TimestampType(), True),
        StructField("sensor", StringType(), True),
        StructField("expires_at", TimestampType(), True),
        StructField("reading_date", DateType(), True),
    ]
)

CORRUPT_COLUMN = "_corrupt_record"


def with_corrupt_column(schema: StructType, name: str = CORRUPT_COLUMN) -> StructType:
    """``schema`` plus a string column that PERMISSIVE parsing fills with bad input."""
    return StructType(list(schema.fields) + [StructField(name, StringType(), True)])
