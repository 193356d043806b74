"""Readings and message envelopes derived from the driver's ``events`` table.

``readings_from_events`` is the fixed mapping of the test data: every event is one
reading of sensor ``user_id``; arithmetic is in double, then narrowed to float, so a SQL
engine can compute the same values. ``envelopes_from_events`` encodes those readings
as messages (key = sensor, offset = event id), which the ingest path then decodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.operators.readings import type_readings, with_id
from sensorlake.schema import READING
from sensorlake.session import num_partitions, parallelism
from sensorlake.sources.messages import decode_messages, encode_messages, split_malformed

# The fixture's topic partitions and the body of a corrupted message.
N_TOPIC_PARTITIONS = 8
BAD_BODY = "not json"
BAD_EVERY = 10


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table. A file stored as one row group is read by a single task; such a
    small input is spread over the cores with one round-robin exchange. An input that
    already has a split per core (any large table) is read as it is, never reshuffled."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    cores = parallelism(spark)
    n = num_partitions(df)
    if n is not None and n < cores:
        df = df.repartition(cores)
    return df


def props_k():
    return F.get_json_object(F.col("props"), "$.k").try_cast("int")


def readings_from_events(ev: DataFrame) -> DataFrame:
    # k is parsed once; Catalyst does not copy a JSON lookup into its three uses.
    ev = ev.select("event_id", "user_id", "value", "ts", props_k().alias("_k"))
    k = F.col("_k")
    return ev.select(
        F.col("event_id"),
        F.col("user_id").alias("sensor"),
        F.col("value").cast("float").alias("pm25"),
        (F.col("value") * F.lit(1.5)).cast("float").alias("pm10"),
        (F.lit(360.0) + F.lit(17.0) * k).cast("float").alias("co2"),
        (F.lit(17.0) + F.lit(0.1) * k).cast("float").alias("temperature"),
        (F.lit(25.0) + F.lit(0.7) * k).cast("float").alias("humidity"),
        F.col("ts").alias("timestamp"),
    )


def envelopes_from_events(ev: DataFrame, corrupt: bool = False) -> DataFrame:
    """Message envelopes; with ``corrupt=True`` every tenth event id carries a body
    that is not JSON (all events are still present)."""
    r = readings_from_events(ev)
    env = encode_messages(
        r,
        key=F.col("sensor"),
        partition=F.pmod(F.col("sensor"), F.lit(N_TOPIC_PARTITIONS)),
        offset=F.col("event_id"),
        timestamp=F.col("timestamp"),
    )
    if corrupt:
        env = env.withColumn(
            "value",
            F.when(F.pmod(F.col("offset"), F.lit(BAD_EVERY)) == 0, F.lit(BAD_BODY).cast("binary")).otherwise(
                F.col("value")
            ),
        )
    return env


def envelope_keep() -> dict:
    """Envelope columns carried through decoding: the event id is the offset, the
    sensor is the message key."""
    return {
        "event_id": F.col("offset"),
        "sensor": F.col("key").cast("string").cast("long"),
        "topic": F.col("topic"),
        "partition": F.col("partition"),
        "offset": F.col("offset"),
    }


def decoded_readings(spark: SparkSession, sf_dir: str, ntz: bool = True, ids: str | None = "stable") -> DataFrame:
    """events -> messages -> decode -> typed readings (+ stable id)."""
    env = envelopes_from_events(events(spark, sf_dir))
    d = type_readings(decode_messages(env, READING, keep=envelope_keep()), ntz=ntz)
    return with_id(d, mode=ids) if ids else d


def split_readings(spark: SparkSession, sf_dir: str, ntz: bool = True) -> tuple[DataFrame, DataFrame]:
    env = envelopes_from_events(events(spark, sf_dir), corrupt=True)
    good, bad = split_malformed(env, READING, keep=envelope_keep())
    return type_readings(good, ntz=ntz), bad
