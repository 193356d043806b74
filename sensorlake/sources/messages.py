"""Message streams: read, encode (reading -> JSON body) and decode (body -> columns).

Decoding keeps every message: a body that is not a JSON object, or is NULL, becomes an
all-NULL reading, and a field of the wrong type becomes NULL on its own (PERMISSIVE).
``split_malformed`` sets such messages aside with a reason instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sensorlake.functions.time import iso_ts
from sensorlake.schema import CORRUPT_COLUMN, ENVELOPE, METRICS, READING, TOPIC, with_corrupt_column

# Reasons a message is set aside.
REASON_NULL_BODY = "null_body"
REASON_MALFORMED = "malformed_json"
REASON_BAD_TIMESTAMP = "bad_timestamp"


def read_messages(
    spark: SparkSession,
    fmt: str = "kafka",
    options: dict[str, str] | None = None,
    path: str | None = None,
    schema: StructType = ENVELOPE,
    stream: bool = True,
) -> DataFrame:
    """A message source. ``fmt="kafka"`` subscribes with the given options (the Kafka
    source has a fixed schema); file formats (parquet, json) read envelopes of the same
    shape, which is what tests use. ``stream=False`` gives the batch equivalent."""
    reader = spark.readStream if stream else spark.read
    reader = reader.format(fmt)
    if options:
        reader = reader.options(**options)
    if fmt != "kafka":
        reader = reader.schema(schema)
    return reader.load(path) if path is not None else reader.load()


def kafka_options(
    bootstrap_servers: str,
    topic: str = TOPIC,
    starting_offsets: str = "latest",
    fail_on_data_loss: bool = True,
    max_offsets_per_trigger: int | None = None,
) -> dict[str, str]:
    """Options of a Kafka subscription for ``read_messages(fmt="kafka")``: first run
    starts at the latest offset (later runs resume from the checkpoint), lost offsets
    fail the query, and ``max_offsets_per_trigger`` caps a micro-batch (the ingest
    rate). Needs Spark's Kafka connector on the classpath."""
    opts = {
        "kafka.bootstrap.servers": bootstrap_servers,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
        "failOnDataLoss": str(bool(fail_on_data_loss)).lower(),
    }
    if max_offsets_per_trigger:
        opts["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return opts


def write_messages(
    envelopes: DataFrame,
    fmt: str = "kafka",
    path: str | None = None,
    options: dict[str, str] | None = None,
    mode: str = "append",
) -> None:
    """Publish encoded messages (batch): to Kafka (key, value, topic, partition columns;
    options name the servers) or as envelope files of another format (the file stream
    that tests and queries read)."""
    if fmt == "kafka":
        cols = [c for c in ("key", "value", "topic", "partition") if c in envelopes.columns]
        w = envelopes.select(*cols).write.format("kafka")
    else:
        w = envelopes.write.format(fmt).mode(mode)
    if options:
        w = w.options(**options)
    if path is not None:
        w.save(path)
    else:
        w.save()


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode_messages(
    df: DataFrame,
    topic: str = TOPIC,
    key=None,
    partition=None,
    offset=None,
    timestamp=None,
    ts_col: str = "timestamp",
) -> DataFrame:
    """Readings -> message envelopes with a UTF-8 JSON body.

    The body has the five metrics and the timestamp as ISO text (``isoformat`` layout);
    ``to_json`` leaves NULL fields out, which decodes the same as an explicit null.
    ``key``/``partition``/``offset``/``timestamp`` fill the envelope columns so the result
    can be written to Kafka or stored as a file stream. Without ``partition`` it is 0, and
    without ``offset`` the messages are numbered, so that each has coordinates of its own;
    ``key`` and ``timestamp`` are NULL when not given.
    """
    body = F.to_json(
        F.struct(*[F.col(m) for m in METRICS], iso_ts(F.col(ts_col)).alias("timestamp"))
    )
    return df.select(
        (_col(key).cast("string").cast("binary") if key is not None else F.lit(None).cast("binary")).alias("key"),
        body.cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        (_col(partition) if partition is not None else F.lit(0)).cast("int").alias("partition"),
        (_col(offset) if offset is not None else F.monotonically_increasing_id()).cast("long").alias("offset"),
        (_col(timestamp) if timestamp is not None else F.lit(None)).cast("timestamp").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )


def _keep(keep) -> tuple[list[Column], list[str]]:
    """Envelope columns to carry: names, or a dict ``new_name -> column``."""
    if isinstance(keep, dict):
        return [_col(v).alias(k) for k, v in keep.items()], list(keep)
    return [F.col(k) for k in keep], list(keep)


def _parse_once(parsed: Column) -> Column:
    """Expose a parsed struct's fields through a generator.

    A filter on a plain projection of ``from_json(...)`` is pushed below it and the
    parse is copied into the filter (and into every branch of a CASE), so each body
    would be parsed several times. Filters cannot move below a generator that produces
    the columns they read, so ``inline(array(struct))`` keeps it to one parse per
    message. A NULL struct yields one all-NULL row, never zero rows."""
    return F.inline(F.array(parsed))


def decode_messages(df: DataFrame, schema: StructType = READING, keep=(), parse_once: bool = True) -> DataFrame:
    """Body bytes -> text -> struct by ``schema`` -> flat columns.

    ``keep`` lists envelope columns to carry along (a list, or a dict of
    ``new_name -> column``). ``parse_once=True`` (default) guarantees one parse per
    message even under filters on parsed fields; the parse then always runs. With
    ``parse_once=False`` Catalyst drops the parse when no parsed field is used and
    keeps only the used fields otherwise, but copies it into pushed-down filters.
    """
    kept, names = _keep(keep)
    parsed = F.from_json(F.col("value").cast("string"), schema)
    if parse_once:
        return df.select(*kept, _parse_once(parsed))
    return df.select(*kept, parsed.alias("_data")).select(*[F.col(n) for n in names], "_data.*")


def split_malformed(
    df: DataFrame, schema: StructType = READING, keep=(), ts_field: str = "timestamp"
) -> tuple[DataFrame, DataFrame]:
    """Decode and split into ``(good, bad)``.

    Bad: NULL body, a body PERMISSIVE parsing could not fully read (not JSON, not an
    object, a field of the wrong type), or timestamp text that does not parse. Bad rows
    keep the body text and a ``reason``; the two sides partition the input.
    """
    kept, names = _keep(keep)
    full = with_corrupt_column(schema)
    body = F.col("value").cast("string")
    parsed = F.from_json(body, full, {"columnNameOfCorruptRecord": CORRUPT_COLUMN})
    # The body rides inside the generated struct so it is read after the parse too.
    row = F.struct(body.alias("_body"), parsed.alias("data"))
    flat = df.select(*kept, _parse_once(row))
    ts_text = F.col(f"data.{ts_field}")
    reason = (
        F.when(F.col("_body").isNull(), F.lit(REASON_NULL_BODY))
        .when(F.col(f"data.{CORRUPT_COLUMN}").isNotNull(), F.lit(REASON_MALFORMED))
        .when(ts_text.isNotNull() & ts_text.try_cast("timestamp").isNull(), F.lit(REASON_BAD_TIMESTAMP))
    )
    tagged = flat.withColumn("reason", reason)
    fields = [F.col(f"data.{f.name}").alias(f.name) for f in schema.fields]
    good = tagged.where(F.col("reason").isNull()).select(*[F.col(n) for n in names], *fields)
    bad = tagged.where(F.col("reason").isNotNull()).select(
        *[F.col(n) for n in names], F.col("_body").alias("body"), "reason"
    )
    return good, bad
