"""Named queries over the driver's tables, one per operator group of the inventory.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole ``events``
table (through the reading mapping of ``fixtures``). Float metrics are widened to
double and timestamps are wall clocks (TIMESTAMP_NTZ) so results compare exactly with
the SQL twins in ``oracle``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from sensorlake.functions.numbers import clamp, format_number, parse_number, round2
from sensorlake.functions.text import parse_bool
from sensorlake.functions.time import decode_epoch_ms, format_ts, ntz_literal, ts_micros, utc_wall_clock
from sensorlake.operators.errors import error_summary
from sensorlake.operators.keys import token_range, token_splits, unexpired, with_expiry
from sensorlake.operators.quality import range_flags, step_flags, temperature_residual
from sensorlake.operators.readings import presentation, report_columns, select_columns, with_id
from sensorlake.operators.report import (
    after_key,
    latest,
    lookup,
    newest_first,
    page,
    row_count,
    sample_then_sort,
    take_any,
    unpivot_readings,
)
from sensorlake.operators.sequence import number_rows
from sensorlake.plans.dashboard import dashboard, ingest_to_table, page_table
from sensorlake.plans.fixtures import (
    decoded_readings,
    envelopes_from_events,
    events,
    props_k,
    split_readings,
)
from sensorlake.schema import ENVELOPE, METRICS, READING, TABLE
from sensorlake.session import parallelism, scratch_path
from sensorlake.sources.csv import export_csv, import_csv
from sensorlake.sources.messages import decode_messages, read_messages
from sensorlake.sources.table import (
    append_result,
    read_table,
    read_token_range,
    retire_batches,
    write_batch,
    write_by_token,
)
from sensorlake.streaming.ingest import compact_table, ingest_frame
from sensorlake.streaming.steps import step_flags_stream

Query = Callable[[SparkSession, str], DataFrame]

# Fixed values used by the queries and their SQL twins.
LOOKUP_EVENT_ID = 42
PAGE_SIZE = 100
PAGE_AFTER = 199
LATEST_N = 100
AS_OF = datetime(2024, 1, 20)
EPOCH_SHIFT_MS = 5_000_000_000_000
CSV_SKIPROWS = 100
CSV_MAXROWS = 500
N_TOKEN_RANGES = 4
MICRO_BATCHES = 4
TABLE_PAGES = 4
HOT_SENSOR = -1
HOT_EVERY = 3


def widen(df: DataFrame) -> DataFrame:
    """Float columns to double (values compare exactly after widening)."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, FloatType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded_readings(spark, sf_dir)


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_columns(_readings(spark, sf_dir))


# --- decode path --------------------------------------------------------------------


def q_decode_readings(spark, sf_dir):
    r = _readings(spark, sf_dir)
    return widen(r.select("event_id", *METRICS, "timestamp"))


def q_props_json(spark, sf_dir):
    ev = events(spark, sf_dir)
    schema = StructType([StructField("k", IntegerType(), True)])
    return ev.select("event_id", F.from_json("props", schema).alias("p")).select("event_id", F.col("p.k").alias("k"))


def q_stable_id(spark, sf_dir):
    return _readings(spark, sf_dir).select("event_id", "id")


def q_random_id(spark, sf_dir):
    r = with_id(decoded_readings(spark, sf_dir, ids=None), mode="random")
    return r.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("id").alias("n_ids"),
        F.min(F.length("id")).alias("min_len"),
        F.max(F.length("id")).alias("max_len"),
    )


# --- ingest path --------------------------------------------------------------------


def _messages(spark: SparkSession, env: DataFrame, path: str) -> None:
    """Store messages as Parquet files in offset order, as a topic's log segments would be:
    a file for each task slot, so that their size follows the input."""
    files = max(MICRO_BATCHES, parallelism(spark))
    env.repartitionByRange(files, "offset").write.mode("append").parquet(path)


def _stream(spark: SparkSession, base: str) -> str:
    """Stream what is new under ``base``/messages into the table, in several micro-batches."""
    per_batch = max(1, parallelism(spark) // MICRO_BATCHES)
    ingest_to_table(spark, f"{base}/messages", f"{base}/table", f"{base}/checkpoint", max_files_per_trigger=per_batch)
    return f"{base}/table"


def _ingest(spark: SparkSession, sf_dir: str, name: str, corrupt: bool = False) -> str:
    """Store all events as messages, stream them into a table, and return its path."""
    base = scratch_path(spark, name)
    _messages(spark, envelopes_from_events(events(spark, sf_dir), corrupt=corrupt), f"{base}/messages")
    return _stream(spark, base)


def _table_out(df: DataFrame) -> DataFrame:
    return widen(
        df.select(
            "id", *METRICS, utc_wall_clock("timestamp").alias("timestamp"), "reading_date"
        )
    )


def q_stream_ingest(spark, sf_dir):
    return _table_out(read_table(spark, _ingest(spark, sf_dir, "stream_ingest")))


def q_stream_restart(spark, sf_dir):
    """Half of the messages are streamed, the stream is started again on the same ones, and
    again when the other half has come: every message is in the table once."""
    base = scratch_path(spark, "stream_restart")
    env = envelopes_from_events(events(spark, sf_dir))
    odd = F.pmod(F.col("offset"), F.lit(2)) == 1
    _messages(spark, env.where(~odd), f"{base}/messages")
    _stream(spark, base)
    _stream(spark, base)
    _messages(spark, env.where(odd), f"{base}/messages")
    return _table_out(read_table(spark, _stream(spark, base)))


def q_stream_new_checkpoint(spark, sf_dir):
    """Half of the messages are streamed, the checkpoint is lost, and a stream with a new one at
    the same path adds the other half: no row is replaced."""
    base = scratch_path(spark, "stream_new_checkpoint")
    env = envelopes_from_events(events(spark, sf_dir))
    table, checkpoint = f"{base}/table", f"{base}/checkpoint"
    for half in (0, 1):
        _messages(spark, env.where(F.pmod(F.col("offset"), F.lit(2)) == half), f"{base}/messages-{half}")
        ingest_to_table(spark, f"{base}/messages-{half}", table, checkpoint)
        if half == 0:  # nothing is left of the checkpoint
            spark.range(0).write.mode("overwrite").parquet(checkpoint)
    return _table_out(read_table(spark, table))


def q_stream_compact_stream(spark, sf_dir):
    """A stream whose finished batches are retired while it goes on: half of the messages are
    streamed, the batches so far retired, then the other half, and every row is read once."""
    base = scratch_path(spark, "stream_compact_stream")
    env = envelopes_from_events(events(spark, sf_dir))
    for half in (0, 1):
        _messages(spark, env.where(F.pmod(F.col("offset"), F.lit(2)) == half), f"{base}/messages")
        table = _stream(spark, base)
        if half == 0:
            retire_batches(spark, table)
    return _table_out(read_table(spark, table))


def q_stream_then_copy(spark, sf_dir):
    """A table that a stream and a bulk import (of its own export) have both written."""
    table = _ingest(spark, sf_dir, "stream_then_copy")
    opts = dict(header=True, datetimeformat="%Y-%m-%d %H:%M:%S.%f%z")
    export_csv(read_table(spark, table), f"{table}_csv", **opts)
    rows, _ = import_csv(spark, f"{table}_csv", TABLE, maxparseerrors=0, **opts)
    write_batch(rows, table, "copy")
    return _table_out(read_table(spark, table))


def q_stored_step_flags(spark, sf_dir):
    """Steps between readings of one sensor, on the stored table."""
    t = read_table(spark, _ingest(spark, sf_dir, "stored_step_flags"))
    s = step_flags(t, sensor="sensor", ts="timestamp", tiebreak=("id",))
    return s.select("id", "sensor", F.round("co2_step", 6).alias("co2_step"), "pm25_step_ok", "co2_step_ok", "humidity_step_ok")


def q_stream_step_flags(spark, sf_dir):
    """Steps of ``stored_step_flags`` found on the stream, which is stopped and started again
    three times: each quarter of the time range is one micro-batch."""
    base = scratch_path(spark, "stream_step_flags")
    env = envelopes_from_events(events(spark, sf_dir))
    micros = F.unix_micros("timestamp")
    low, high = env.agg(F.min(micros), F.max(micros)).first()
    env = env.withColumn("quarter", F.floor(4 * (micros - F.lit(low)) / F.lit(high - low + 1)))
    for n in range(4):
        _messages(spark, env.where(F.col("quarter") == n).drop("quarter"), f"{base}/messages")
        messages = read_messages(spark, fmt="parquet", path=f"{base}/messages", schema=ENVELOPE)
        flags = step_flags_stream(ingest_frame(messages))
        sink = flags.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint")
        sink.trigger(availableNow=True).start(f"{base}/flags").awaitTermination()
    s = spark.read.schema(flags.schema).parquet(f"{base}/flags").where("not late")
    return s.select("id", "sensor", F.round("co2_step", 6).alias("co2_step"), "pm25_step_ok", "co2_step_ok", "humidity_step_ok")


def q_stored_lookup(spark, sf_dir):
    """The reading of one event by its id, on the compacted table."""
    table = _ingest(spark, sf_dir, "stored_lookup")
    compact_table(spark, table, f"{table}_compacted")
    wanted = lookup(_readings(spark, sf_dir), "event_id", LOOKUP_EVENT_ID).select("id").first().id
    return _table_out(lookup(read_table(spark, f"{table}_compacted"), "id", wanted))


def q_token_ranges(spark, sf_dir):
    """The readings stored by token and read back range by range: their union is the table."""
    path = scratch_path(spark, "token_ranges")
    readings = _readings(spark, sf_dir).select("event_id", "sensor", *METRICS, "timestamp")
    write_by_token(readings, path, ["sensor", "event_id"], max(N_TOKEN_RANGES, parallelism(spark)))
    parts = [read_token_range(spark, path, b, e) for b, e in token_splits(N_TOKEN_RANGES)]
    return widen(reduce(DataFrame.unionByName, parts).drop("token"))


def q_table_pages_all(spark, sf_dir):
    """A table that holds rows without a time, as key ranges put one behind the other: each
    begins with a page of at most ``PAGE_SIZE`` rows, the rest of the range follows that page's
    last key. Where ranges end is read off the sliced row numbers."""
    table, key = _ingest(spark, sf_dir, "table_pages_all", corrupt=True), ["timestamp", "id"]
    stored = read_table(spark, table)
    size = max(1, -(-stored.count() // TABLE_PAGES))
    numbered = number_rows(stored.select(*key), key)
    ends = {r.row_number // size: (r.timestamp, r.id) for r in numbered.where(F.col("row_number") % size == 0).collect()}
    ranges, after = [], None
    for number in range(TABLE_PAGES):
        inside = ~F.coalesce(after_key(key, ends[number + 1]), F.lit(False)) if number + 1 in ends else F.lit(True)
        found = page_table(spark, table, PAGE_SIZE, after)
        last = found.orderBy(F.col("timestamp").desc_nulls_last(), F.col("id").desc()).first()
        parts = [found.where(inside)]
        if last is not None:
            parts.append(page(report_columns(stored.where(inside)), key, None, (last.timestamp, last.id)))
        ranges += [x.select("id", utc_wall_clock("timestamp").alias("timestamp"), F.lit(number).alias("page")) for x in parts]
        if number + 1 not in ends:
            break
        after = ends[number + 1]
    return reduce(DataFrame.unionByName, ranges)


def q_compacted_table(spark, sf_dir):
    table = _ingest(spark, sf_dir, "compacted_table")
    out = table + "_compacted"
    compact_table(spark, table, out)
    return _table_out(read_table(spark, out))


def q_dashboard(spark, sf_dir):
    table = _ingest(spark, sf_dir, "dashboard")
    d = dashboard(spark, table, LATEST_N)
    return widen(d.withColumn("Timestamp", utc_wall_clock("Timestamp")))


# --- report operators ---------------------------------------------------------------


def q_table_page(spark, sf_dir):
    """The page after the reading of event ``PAGE_AFTER`` in time order, over the table."""
    table = _ingest(spark, sf_dir, "table_page")
    after_id = lookup(_readings(spark, sf_dir), "event_id", PAGE_AFTER).select("id").first().id
    row = lookup(read_table(spark, table), "id", after_id).select("timestamp", "id").first()
    p = page_table(spark, table, PAGE_SIZE, after=(row.timestamp, row.id))
    return widen(p.withColumn("timestamp", utc_wall_clock("timestamp")))


def q_latest_100(spark, sf_dir):
    return widen(latest(_report(spark, sf_dir), LATEST_N, "timestamp", "id"))


def q_take_any(spark, sf_dir):
    t = take_any(_report(spark, sf_dir), LATEST_N)
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"))


def q_sample_then_sort(spark, sf_dir):
    """Which rows are taken is not fixed; that they come newest first is."""
    t = sample_then_sort(_report(spark, sf_dir), LATEST_N).select("id", "timestamp", F.monotonically_increasing_id().alias("pos"))
    before = F.lag("timestamp").over(Window.orderBy("pos"))  # over LATEST_N rows
    ordered = t.withColumn("ordered", F.coalesce(before >= F.col("timestamp"), F.lit(True)))
    return ordered.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.min("ordered").alias("newest_first")
    )


def q_newest_first(spark, sf_dir):
    return widen(newest_first(_report(spark, sf_dir), "timestamp", "id"))


def q_presentation(spark, sf_dir):
    return widen(presentation(latest(_report(spark, sf_dir), LATEST_N, "timestamp", "id")))


def q_point_lookup(spark, sf_dir):
    return widen(lookup(_readings(spark, sf_dir), "event_id", LOOKUP_EVENT_ID).select("event_id", *METRICS, "timestamp"))


def q_page_3(spark, sf_dir):
    r = _readings(spark, sf_dir).select("event_id", *METRICS, "timestamp")
    return widen(page(r, "event_id", PAGE_SIZE, after=PAGE_AFTER))


def q_row_numbers(spark, sf_dir):
    r = _readings(spark, sf_dir).select("event_id", "sensor", "timestamp")
    return number_rows(r, ["timestamp", "event_id"], "sensor").select("event_id", "sensor", "row_number")


def q_row_numbers_global(spark, sf_dir):
    r = _readings(spark, sf_dir).select("event_id", "timestamp")
    return number_rows(r, ["timestamp", "event_id"]).select("event_id", "row_number")


def _hot_sensor(spark, sf_dir) -> DataFrame:
    """Readings where one sensor holds a third of all rows (every event kept): the
    skewed case the sequence operators must split."""
    r = _readings(spark, sf_dir)
    hot = F.when(F.pmod(F.col("event_id"), F.lit(HOT_EVERY)) == 0, F.lit(HOT_SENSOR)).otherwise(F.col("sensor"))
    return r.withColumn("sensor", hot.cast("long"))


def q_row_numbers_hot_sensor(spark, sf_dir):
    r = _hot_sensor(spark, sf_dir).select("event_id", "sensor", "timestamp")
    return number_rows(r, ["timestamp", "event_id"], "sensor").select("event_id", "sensor", "row_number")


def q_step_flags_hot_sensor(spark, sf_dir):
    r = _hot_sensor(spark, sf_dir).select("event_id", "sensor", *METRICS, "timestamp")
    s = step_flags(r, sensor="sensor", ts="timestamp", tiebreak=("event_id",))
    return s.select(
        "event_id",
        *[F.round(F.col(f"{m}_step"), 6).alias(f"{m}_step") for m in ("pm25", "pm10", "co2", "humidity")],
        "pm25_step_ok",
        "pm10_step_ok",
        "co2_step_ok",
        "humidity_step_ok",
    )


def q_row_numbers_outlier(spark, sf_dir):
    """One sensor holds all rows; a third has no time, a third the same time, and one row a
    time far off: slices by equal width would put nearly all in one task."""
    r = _readings(spark, sf_dir).select("event_id", "timestamp")
    k = F.pmod(F.col("event_id"), F.lit(3))
    odd = (
        F.when(F.col("event_id") == 1, ntz_literal(datetime(9999, 1, 1)))
        .when(k == 0, F.lit(None).cast("timestamp_ntz"))
        .when(k == 1, ntz_literal(AS_OF))
        .otherwise(F.col("timestamp"))
    )
    r = r.select("event_id", F.lit(HOT_SENSOR).alias("sensor"), odd.alias("timestamp"))
    return number_rows(r, ["timestamp", "event_id"], "sensor").select("event_id", "row_number")


def q_row_count(spark, sf_dir):
    """Counting needs no field of the messages, so none is written or parsed."""
    return row_count(decode_messages(envelopes_from_events(events(spark, sf_dir)), READING, keep=["offset"], parse_once=False))


def q_unpivot(spark, sf_dir):
    r = _readings(spark, sf_dir)
    return widen(unpivot_readings(r, ids=("event_id", "timestamp")))


def q_select_columns(spark, sf_dir):
    return widen(select_columns(_report(spark, sf_dir), skip=("pm10", "co2")))


# --- quarantine -----------------------------------------------------------------------


def q_split_good(spark, sf_dir):
    good, _ = split_readings(spark, sf_dir)
    return widen(good.select("event_id", *METRICS, "timestamp"))


def q_split_bad(spark, sf_dir):
    _, bad = split_readings(spark, sf_dir)
    return bad.select("event_id", "body", "reason")


def q_error_summary(spark, sf_dir):
    _, bad = split_readings(spark, sf_dir)
    return error_summary(bad, reason="reason", order="event_id", sample="body", n_samples=2)


def q_error_summary_ties(spark, sf_dir):
    """Three reasons, one of them NULL, with many errors of equal order."""
    k = F.pmod(F.col("event_id"), F.lit(3))
    bad = events(spark, sf_dir).select(
        F.when(k == 0, F.lit("a")).when(k == 1, F.lit("b")).alias("reason"),
        F.pmod(F.col("event_id"), F.lit(7)).alias("order"),
        F.col("event_type").alias("body"),
    )
    return error_summary(bad, reason="reason", order="order", sample="body", n_samples=2)


# --- copy options ---------------------------------------------------------------------

CSV_OPTIONS = dict(
    delimiter=";",
    decimalsep=",",
    boolstyle="yes,no",
    header=True,
    null="NA",
    datetimeformat="%Y-%m-%d %H:%M:%S.%f",
)

CSV_SCHEMA = StructType(
    [
        StructField("event_id", LongType()),
        StructField("sensor", LongType()),
        *[StructField(m, FloatType()) for m in METRICS],
        StructField("timestamp", TimestampNTZType()),
        StructField("co2_in_range", BooleanType()),
    ]
)


def _csv_source(spark, sf_dir) -> DataFrame:
    r = range_flags(_readings(spark, sf_dir))
    return r.select(*[f.name for f in CSV_SCHEMA.fields])


def q_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv_roundtrip")
    export_csv(_csv_source(spark, sf_dir), path, **CSV_OPTIONS)
    good, _ = import_csv(
        spark,
        f"{path}/*.csv",
        CSV_SCHEMA,
        columns=[f.name.upper() for f in CSV_SCHEMA.fields],
        skipcols=("sensor",),
        maxparseerrors=0,
        **CSV_OPTIONS,
    )
    return widen(good)


def q_csv_stream_import(spark, sf_dir):
    """Export, then import as a stream (two files per micro-batch) into a Parquet sink."""
    path = scratch_path(spark, "csv_stream")
    src = _csv_source(spark, sf_dir).repartitionByRange(max(2, parallelism(spark)), "event_id")
    export_csv(src, f"{path}/in", **CSV_OPTIONS)
    good, _ = import_csv(spark, f"{path}/in", CSV_SCHEMA, stream=True, max_files_per_trigger=2, **CSV_OPTIONS)
    q = (
        good.writeStream.format("parquet")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{path}/out")
    )
    q.awaitTermination()
    return widen(spark.read.parquet(f"{path}/out"))


def q_csv_bad_lines(spark, sf_dir):
    """Lines as text: good ones, a value that doesn't convert (in quotes and spaces), a field
    too few and one too many. The bad ones come back as they stand in the file."""
    path = scratch_path(spark, "csv_bad")
    i, k = F.col("event_id").cast("string"), F.pmod(F.col("event_id"), F.lit(4))
    line = (
        F.when(k == 0, F.concat(i, F.lit(',"a ""b"" c",1.5')))
        .when(k == 1, F.concat(i, F.lit(',"x, y",  not a number ')))
        .when(k == 2, F.concat(i, F.lit(",short")))
        .otherwise(F.concat(i, F.lit(",x,2,extra")))
    )
    events(spark, sf_dir).select(line.alias("value")).write.text(path)
    schema = StructType([StructField("event_id", LongType()), StructField("t", StringType()), StructField("n", FloatType())])
    _, bad = import_csv(spark, path, schema, escape='"')
    return bad.select("line", "reason")


def q_csv_skip_max(spark, sf_dir):
    """A range of rows over several files with a header each."""
    path = scratch_path(spark, "csv_skip_max")
    src = _csv_source(spark, sf_dir).repartitionByRange(parallelism(spark), "event_id").sortWithinPartitions("event_id")
    export_csv(src, path, **CSV_OPTIONS)
    good, _ = import_csv(spark, f"{path}/*.csv", CSV_SCHEMA, skiprows=CSV_SKIPROWS, maxrows=CSV_MAXROWS, **CSV_OPTIONS)
    return widen(good)


def q_csv_odd_names(spark, sf_dir):
    """A range of rows over files in a folder whose name has blanks and signs of patterns."""
    path = scratch_path(spark, "csv odd [names] 100%")
    src = _csv_source(spark, sf_dir).repartitionByRange(parallelism(spark), "event_id").sortWithinPartitions("event_id")
    export_csv(src, path, **CSV_OPTIONS)
    pattern = path.replace("[", "\\[").replace("]", "\\]")
    good, _ = import_csv(spark, f"{pattern}/*.csv", CSV_SCHEMA, skiprows=CSV_SKIPROWS, maxrows=CSV_MAXROWS, **CSV_OPTIONS)
    return widen(good)


TEXT_SCHEMA = StructType([StructField("event_id", LongType()), StructField("t", StringType())])


def q_csv_encoding_skip(spark, sf_dir):
    """A range of rows of Latin-1 files with headers."""
    path = scratch_path(spark, "csv_encoding")
    text = events(spark, sf_dir).select("event_id", F.concat(F.lit("é"), "event_type", F.lit("ü")).alias("t"))
    text = text.repartitionByRange(parallelism(spark), "event_id").sortWithinPartitions("event_id")
    opts = dict(header=True, encoding="latin1")
    export_csv(text, path, **opts)
    return import_csv(spark, path, TEXT_SCHEMA, skiprows=CSV_SKIPROWS, maxrows=CSV_MAXROWS, **opts)[0]


def q_csv_control_chars(spark, sf_dir):
    """Text with each of the control characters but line ends, and blanks around it."""
    path = scratch_path(spark, "csv_control")
    code = F.pmod(F.col("event_id"), F.lit(30))
    sign = F.chr(F.when(code == 10, 30).when(code == 13, 31).otherwise(code))
    text = events(spark, sf_dir).select("event_id", F.concat(sign, F.lit(" y"), sign, F.lit("z "), sign).alias("t"))
    export_csv(text, path)
    return import_csv(spark, path, TEXT_SCHEMA, maxparseerrors=0)[0]


def q_csv_multiline(spark, sf_dir):
    """Quoted fields with line breaks, separators and quotes."""
    path = scratch_path(spark, "csv_multiline")
    text = events(spark, sf_dir).select("event_id", F.concat("event_type", F.lit('\n"a", '), "event_id").alias("t"))
    export_csv(text, path, header=True)
    return import_csv(spark, path, TEXT_SCHEMA, header=True, multiline=True, maxparseerrors=0)[0]


def q_append_result(spark, sf_dir):
    path = scratch_path(spark, "append_result")
    rep = widen(_report(spark, sf_dir))
    append_result(rep, path)
    append_result(rep, path)
    return spark.read.parquet(path)


def q_hash_range_cover(spark, sf_dir):
    """Rows of each token range, in one scan: every row lies in exactly one."""
    r = _readings(spark, sf_dir).select("event_id", "sensor")
    ranges = [token_range(["sensor", "event_id"], b, e).cast("int") for b, e in token_splits(N_TOKEN_RANGES)]
    per_row = r.select("event_id", reduce(Column.__add__, ranges).alias("n"))
    return per_row.agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") == 1).alias("n_distinct"))


def q_expiry(spark, sf_dir):
    ev = events(spark, sf_dir)
    k = props_k()
    ttl = F.when(k % 7 == 0, F.lit(None)).otherwise(k * F.lit(3600))
    e = with_expiry(ev.withColumn("ttl", ttl), "ts", "ttl")
    return unexpired(e, ntz_literal(AS_OF)).select("event_id", "expires_at")


def q_epoch_ms(spark, sf_dir):
    ev = events(spark, sf_dir)
    ms = F.floor(ts_micros(F.col("ts"), "timestamp_ntz").cast("decimal(20,0)") / F.lit(1000)).cast("long") + (
        props_k() - F.lit(50)
    ).cast("long") * F.lit(EPOCH_SHIFT_MS)
    d = ev.select("event_id", decode_epoch_ms(ms).alias("d"))
    return d.select("event_id", F.col("d.ts").alias("ts"), F.col("d.raw_ms").alias("raw_ms"))


def _number_text():
    return F.translate(F.format_string("%,.2f", F.col("value") * F.lit(1000.0)), ",.", ".,")


def q_parse_number(spark, sf_dir):
    ev = events(spark, sf_dir)
    text = F.when(F.col("event_type") == "error", F.concat(_number_text(), F.lit("x"))).otherwise(_number_text())
    return ev.select("event_id", parse_number(text, decimal_sep=",", thousands_sep=".").alias("number"))


def q_parse_bool(spark, sf_dir):
    ev = events(spark, sf_dir)
    text = (
        F.when(F.col("event_type") == "click", F.lit("YES"))
        .when(F.col("event_type") == "view", F.lit("no"))
        .when(F.col("event_type") == "purchase", F.lit("Yes"))
        .otherwise(F.col("event_type"))
    )
    return ev.select("event_id", parse_bool(text, "yes,no").alias("flag"))


def q_format_columns(spark, sf_dir):
    r = _readings(spark, sf_dir)
    # A multiple of 2^-10.
    wide = F.col("event_id").cast("double") / F.lit(1024.0)
    return r.select(
        "event_id",
        format_number(F.col("pm10"), 5).alias("pm10_text"),
        format_number(wide, 12).alias("value_text"),
        format_number(F.col("co2").cast("double") * F.lit(1000.0), 2, ".", ",").alias("grouped_text"),
        format_ts(F.col("timestamp"), "%Y-%m-%d %H:%M:%S").alias("ts_text"),
    )


def q_format_exact(spark, sf_dir):
    """Numbers at half a unit of the last digit: exactly (ties), and only in their shortest form."""
    ev = events(spark, sf_dir)
    i = F.col("event_id").cast("double")
    return ev.select(
        "event_id",
        format_number((i + 0.5) / F.lit(8.0), 3, trim_zeros=False).alias("tie_text"),
        format_number((i * 2 + 1) / F.lit(-2000.0), 3, trim_zeros=False).alias("near_tie_text"),
        format_number(i + 0.5, 0).alias("whole_text"),
        format_number(F.col("value") * F.lit(1e9), 6, trim_zeros=False).alias("large_text"),
    )


def q_clamp_round(spark, sf_dir):
    r = _readings(spark, sf_dir)
    return widen(
        r.select(
            "event_id",
            round2(F.col("pm25").cast("double") / F.lit(3.0)).alias("pm25_third"),
            clamp(F.col("pm10"), 5.0, 50.0).alias("pm10_clamped"),
            clamp(F.col("humidity"), 30.0, 90.0).alias("humidity_clamped"),
        )
    )


# --- quality --------------------------------------------------------------------------


def q_range_flags(spark, sf_dir):
    r = range_flags(_readings(spark, sf_dir))
    return r.select("event_id", "pm25_in_range", "pm10_in_range", "co2_in_range", "humidity_in_range")


def q_step_flags(spark, sf_dir):
    r = _readings(spark, sf_dir).select("event_id", "sensor", *METRICS, "timestamp")
    s = step_flags(r, sensor="sensor", ts="timestamp", tiebreak=("event_id",))
    return s.select(
        "event_id",
        *[F.round(F.col(f"{m}_step"), 6).alias(f"{m}_step") for m in ("pm25", "pm10", "co2", "humidity")],
        "pm25_step_ok",
        "pm10_step_ok",
        "co2_step_ok",
        "humidity_step_ok",
    )


def q_temperature_residual(spark, sf_dir):
    r = temperature_residual(_readings(spark, sf_dir))
    return r.select(
        "event_id",
        F.round("temperature_residual", 6).alias("temperature_residual"),
        "temperature_off_baseline",
    )


QUERIES: dict[str, Query] = {
    "decode_readings": q_decode_readings,
    "props_json": q_props_json,
    "stream_ingest": q_stream_ingest,
    "stream_restart": q_stream_restart,
    "stream_new_checkpoint": q_stream_new_checkpoint,
    "stream_compact_stream": q_stream_compact_stream,
    "stream_then_copy": q_stream_then_copy,
    "stored_step_flags": q_stored_step_flags,
    "stream_step_flags": q_stream_step_flags,
    "stored_lookup": q_stored_lookup,
    "token_ranges": q_token_ranges,
    "table_pages_all": q_table_pages_all,
    "compacted_table": q_compacted_table,
    "dashboard": q_dashboard,
    "stable_id": q_stable_id,
    "random_id": q_random_id,
    "latest_100": q_latest_100,
    "take_any": q_take_any,
    "sample_then_sort": q_sample_then_sort,
    "newest_first": q_newest_first,
    "presentation": q_presentation,
    "point_lookup": q_point_lookup,
    "page_3": q_page_3,
    "table_page": q_table_page,
    "row_numbers": q_row_numbers,
    "row_numbers_global": q_row_numbers_global,
    "row_numbers_hot_sensor": q_row_numbers_hot_sensor,
    "step_flags_hot_sensor": q_step_flags_hot_sensor,
    "row_numbers_outlier": q_row_numbers_outlier,
    "row_count": q_row_count,
    "unpivot": q_unpivot,
    "select_columns": q_select_columns,
    "split_good": q_split_good,
    "split_bad": q_split_bad,
    "error_summary": q_error_summary,
    "error_summary_ties": q_error_summary_ties,
    "csv_roundtrip": q_csv_roundtrip,
    "csv_stream_import": q_csv_stream_import,
    "csv_bad_lines": q_csv_bad_lines,
    "csv_skip_max": q_csv_skip_max,
    "csv_odd_names": q_csv_odd_names,
    "csv_encoding_skip": q_csv_encoding_skip,
    "csv_control_chars": q_csv_control_chars,
    "csv_multiline": q_csv_multiline,
    "append_result": q_append_result,
    "hash_range_cover": q_hash_range_cover,
    "expiry": q_expiry,
    "epoch_ms": q_epoch_ms,
    "parse_number": q_parse_number,
    "parse_bool": q_parse_bool,
    "format_columns": q_format_columns,
    "format_exact": q_format_exact,
    "clamp_round": q_clamp_round,
    "range_flags": q_range_flags,
    "step_flags": q_step_flags,
    "temperature_residual": q_temperature_residual,
}
