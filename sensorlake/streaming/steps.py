"""Step checks on the live stream: each reading against the one before it of its sensor.

The last reading of every sensor is kept as the stream's state (in its checkpoint, so it
outlives restarts). Sensors are dealt by their hash to a fixed number of buckets, and the state of
a bucket is one Arrow table with a row for each of its sensors, so the state function is called
once for each bucket that a micro-batch has readings of, not for each sensor. There the readings
are put in order of (sensor, time, tiebreak) behind the kept ones by column operations; what is
passed on is the text of the reading before, and the steps and flags are the same column
expressions as in a batch.

A reading is late if its place is not behind that of its sensor's last reading: a micro-batch
before had a later one, or the same. It is passed on with ``late`` and without steps, and does
not become the last one. Within a micro-batch order does not matter. So the flags are those of
``operators.quality.step_flags`` over all readings that are not late. A reading without a time
is before all others of its sensor, as there. The readings of one bucket in one micro-batch are
one task's; the source's limit for a micro-batch bounds them. The number of buckets belongs to the
checkpoint: a stream goes on with the number it began with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, IntegralType

from sensorlake.functions.time import ts_micros
from sensorlake.operators.quality import flags_from_previous
from sensorlake.schema import METRICS

_FIRST = -(2**63)
#: Buckets of sensors: more of them make a bucket's state smaller, fewer make fewer calls.
BUCKETS = 1024


def _previous(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The rows of one bucket with the text of the reading before each of the same sensor."""
    rows = pd.concat(list(frames), ignore_index=True).sort_values(["t", "tie"], kind="stable")
    kept = unpacked(state.get[0]) if state.exists else rows.loc[[], _LAST]
    # Sensors in numbers, those with a kept reading first; a missing name is a sensor too.
    of, names = pd.factorize(pd.concat([kept["who"], rows["who"]], ignore_index=True), use_na_sentinel=False)
    of = of[len(kept) :]
    late, has = np.zeros(len(rows), dtype=bool), of < len(kept)
    now, last = rows[has], kept.iloc[of[has]]
    t, last_t = now["t"].to_numpy(), last["t"].to_numpy()
    late[has] = (t < last_t) | ((t == last_t) & (now["tie"].to_numpy() <= last["tie"].to_numpy()).astype(bool))

    rows = rows.assign(late=late, before=None)
    order = np.argsort(of, kind="stable")  # within a sensor by (t, tie), as before
    order = order[~late[order]]
    if len(order):
        on_time, sensor = rows.iloc[order], of[order]
        texts = on_time["body"].to_numpy(dtype=object)
        begins = np.append(True, sensor[1:] != sensor[:-1])
        before = np.append([None], texts[:-1])
        kept_texts = np.append(kept["body"].to_numpy(dtype=object), np.full(len(names) - len(kept), None))
        before[begins] = kept_texts[sensor[begins]]
        whole = np.full(len(rows), None, dtype=object)
        whole[order] = before
        rows["before"] = whole
        ends = np.append(begins[1:], True)
        same = np.ones(len(kept), dtype=bool)
        same[sensor[ends][sensor[ends] < len(kept)]] = False
        state.update((packed(pd.concat([kept[same], on_time.loc[ends, _LAST]], ignore_index=True)),))
    yield rows[["who", "t", "tie", "id", "body", "before", "late"]]


#: What is kept of a sensor's last reading.
_LAST = ["who", "t", "tie", "body"]


def packed(kept: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(kept, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(state: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(state).read_pandas()


def step_flags_stream(
    stream: DataFrame, sensor: str = "sensor", ts: str = "timestamp", tiebreak: str = "id", buckets: int = BUCKETS
) -> DataFrame:
    """Streaming form of ``step_flags``: sensor, timestamp, id (``tiebreak``), the metrics, their
    steps and flags, and ``late``, a row for each reading (append mode)."""
    tie_type = stream.schema[tiebreak].dataType
    whole = isinstance(tie_type, IntegralType)
    kind, first = ("long", F.lit(_FIRST)) if whole else ("string", F.lit(""))
    time_type = stream.schema[ts].dataType.typeName()
    sensor_type = stream.schema[sensor].dataType
    binary = isinstance(sensor_type, BinaryType)
    # Times as microseconds and metrics as text: NULL and NaN stay apart, zones play no part.
    narrow = stream.select(
        F.pmod(F.xxhash64(sensor), F.lit(buckets)).cast("int").alias("bucket"),
        (F.hex(sensor) if binary else F.col(sensor).cast("string")).alias("who"),
        F.coalesce(ts_micros(ts, time_type), F.lit(_FIRST)).alias("t"),
        F.coalesce(F.col(tiebreak).cast(kind), first).alias("tie"),
        F.col(tiebreak).cast("string").alias("id"),
        F.to_json(F.struct(*METRICS)).alias("body"),
    )
    placed = narrow.groupBy("bucket").applyInPandasWithState(
        _previous,
        f"who string, t long, tie {kind}, id string, body string, before string, late boolean",
        "kept binary",
        "append",
        GroupStateTimeout.NoTimeout,
    )
    schema = ", ".join(f"{m} float" for m in METRICS)
    instant = F.timestamp_micros("t") if time_type == "timestamp" else F.lit("1970-01-01").cast("timestamp_ntz") + (
        F.make_dt_interval(secs=(F.col("t").cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))
    )
    read = placed.select(
        (F.unhex("who") if binary else F.col("who").cast(sensor_type)).alias(sensor),
        F.when(F.col("t") != _FIRST, instant).alias(ts),
        F.col("id").cast(tie_type).alias(tiebreak),
        "late",
        F.from_json("body", schema).alias("_now"),
        F.from_json("before", schema).alias("_before"),
    )
    flat = read.select(
        sensor, ts, tiebreak, "late", "_now.*", *[F.col(f"_before.{m}").alias(f"_prev_{m}") for m in METRICS]
    )
    return flags_from_previous(flat)
