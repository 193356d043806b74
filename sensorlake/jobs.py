"""Command-line jobs (for ``spark-submit`` or ``python -m sensorlake.jobs``).

    ingest     messages (Kafka or envelope files) -> partitioned table, exactly once
    report     newest n readings of the table, display headers (printed or written)
    copy-to    table -> CSV files, COPY TO options
    copy-from  CSV files -> table (append), COPY FROM options; bad lines to --errfile
    compact    rewrite the table's small files, time-sorted; without --out in place, beside its streams
    quality    range / step / baseline flags of the table -> Parquet

COPY options are given as ``--option NAME=value`` with the COPY option names
(``DELIMITER``, ``HEADER``, ``NULL``, ``DATETIMEFORMAT``, ``MAXROWS`` ...).
"""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sensorlake.operators.quality import range_flags, step_flags, temperature_residual
from sensorlake.plans.dashboard import dashboard
from sensorlake.schema import ENVELOPE, METRICS, TABLE
from sensorlake.session import get_session
from sensorlake.sources.csv import export_csv, import_csv
from sensorlake.sources.messages import kafka_options, read_messages
from sensorlake.sources.table import read_table, retire_batches, utc_date, write_batch
from sensorlake.streaming.ingest import compact_table, ingest_frame, quarantine_frame, start_ingest

# COPY option names and the keyword each maps to.
COPY_OPTIONS = {
    "DELIMITER": ("delimiter", str),
    "QUOTE": ("quote", str),
    "ESCAPE": ("escape", str),
    "HEADER": ("header", "bool"),
    "NULL": ("null", str),
    "DATETIMEFORMAT": ("datetimeformat", str),
    "DECIMALSEP": ("decimalsep", str),
    "THOUSANDSSEP": ("thousandssep", str),
    "BOOLSTYLE": ("boolstyle", str),
    "SKIPCOLS": ("skipcols", "list"),
    "SKIPROWS": ("skiprows", int),
    "MAXROWS": ("maxrows", int),
    "MAXPARSEERRORS": ("maxparseerrors", int),
    "ERRFILE": ("errfile", str),
    "TTL": ("ttl", int),
    "ENCODING": ("encoding", str),
    "MAXOUTPUTSIZE": ("maxoutputsize", int),
    "FLOATPRECISION": ("float_precision", int),
    "DOUBLEPRECISION": ("double_precision", int),
    "MULTILINE": ("multiline", "bool"),
    "BEGINTOKEN": ("begintoken", int),
    "ENDTOKEN": ("endtoken", int),
}


def copy_kwargs(pairs: list[str]) -> dict:
    """``NAME=value`` pairs -> keyword arguments of import_csv / export_csv."""
    out: dict = {}
    for pair in pairs or []:
        name, _, value = pair.partition("=")
        key = name.strip().upper()
        if key not in COPY_OPTIONS:
            raise SystemExit(f"unknown COPY option {name!r}")
        kw, kind = COPY_OPTIONS[key]
        if kind == "bool":
            out[kw] = value.strip().lower() in ("true", "yes", "1", "on")
        elif kind == "list":
            out[kw] = [v.strip() for v in value.split(",") if v.strip()]
        else:
            out[kw] = kind(value)
    return out


def _session(args) -> SparkSession:
    return get_session(args.master) if args.master else get_session()


def cmd_ingest(spark: SparkSession, args) -> None:
    if args.kafka:
        opts = kafka_options(args.kafka, args.topic, args.starting_offsets, max_offsets_per_trigger=args.max_per_trigger)
        stream = read_messages(spark, "kafka", opts)
    else:
        opts = {"maxFilesPerTrigger": str(args.max_per_trigger)} if args.max_per_trigger else {}
        stream = read_messages(spark, args.format, opts, path=args.messages, schema=ENVELOPE)
    trigger = {"availableNow": True} if args.available_now else (
        {"processingTime": args.processing_time} if args.processing_time else None
    )
    if args.quarantine:
        good, bad = quarantine_frame(stream, id_mode=args.id_mode)
        side = start_ingest(bad, args.quarantine, f"{args.checkpoint.rstrip('/')}-bad", trigger, partition_by=())
    else:
        good, side = ingest_frame(stream, id_mode=args.id_mode), None
    q = start_ingest(good, args.table, args.checkpoint, trigger=trigger)
    q.awaitTermination()
    if side is not None:
        side.awaitTermination()


def cmd_report(spark: SparkSession, args) -> None:
    df = dashboard(spark, args.table, args.n)
    if args.out:
        df.write.mode("overwrite").format(args.out_format).save(args.out)
    else:
        df.show(args.n, truncate=False)


def cmd_copy_to(spark: SparkSession, args) -> None:
    kw = copy_kwargs(args.option)
    if "begintoken" in kw or "endtoken" in kw:
        kw["token_keys"] = ["id"]
    df = read_table(spark, args.table)
    export_csv(df, args.path, columns=args.columns or None, **kw)


def cmd_copy_from(spark: SparkSession, args) -> None:
    kw = copy_kwargs(args.option)
    good, _ = import_csv(spark, args.paths, TABLE, columns=args.columns or None, **kw)
    if "timestamp" in good.columns:
        good = good.withColumn("reading_date", utc_date("timestamp"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in TABLE.fields if f.name not in good.columns]
    rows = good.select("*", *empty).select(*TABLE.fieldNames())
    write_batch(rows, args.table, args.source or f"copy-{uuid.uuid4().hex}")


def cmd_compact(spark: SparkSession, args) -> None:
    if args.out:
        compact_table(spark, args.table, args.out)
    else:
        retire_batches(spark, args.table)


def cmd_quality(spark: SparkSession, args) -> None:
    df = read_table(spark, args.table)
    flagged = temperature_residual(range_flags(df))
    flagged = step_flags(flagged, sensor="sensor", ts="timestamp", tiebreak=("id",))
    cols = ["id", "sensor", "timestamp", *METRICS] + [c for c in flagged.columns if c.endswith(("_ok", "_in_range", "_step"))]
    cols += ["temperature_residual", "temperature_off_baseline"]
    flagged.select(*dict.fromkeys(cols)).write.mode("overwrite").parquet(args.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sensorlake.jobs", description=__doc__.split("\n\n")[0])
    p.add_argument("--master", default=None, help="Spark master (default: from spark-submit)")
    sub = p.add_subparsers(dest="cmd", required=True)

    s = sub.add_parser("ingest")
    s.add_argument("--table", required=True)
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--kafka", help="bootstrap servers; otherwise --messages")
    s.add_argument("--topic", default="air_quality")
    s.add_argument("--starting-offsets", default="latest")
    s.add_argument("--messages", help="folder of envelope files")
    s.add_argument("--format", default="parquet")
    s.add_argument("--max-per-trigger", type=int, default=None)
    s.add_argument("--processing-time", default=None)
    s.add_argument("--available-now", action="store_true")
    s.add_argument("--quarantine", help="folder for messages that can't be read; without it they become rows of NULLs")
    s.add_argument("--id-mode", choices=["stable", "random"], default="stable")
    s.set_defaults(fn=cmd_ingest)

    s = sub.add_parser("report")
    s.add_argument("--table", required=True)
    s.add_argument("-n", type=int, default=100)
    s.add_argument("--out")
    s.add_argument("--out-format", default="parquet")
    s.set_defaults(fn=cmd_report)

    s = sub.add_parser("copy-to")
    s.add_argument("--table", required=True)
    s.add_argument("--path", required=True)
    s.add_argument("--columns", nargs="*")
    s.add_argument("--option", action="append", default=[])
    s.set_defaults(fn=cmd_copy_to)

    s = sub.add_parser("copy-from")
    s.add_argument("--table", required=True)
    s.add_argument("--paths", nargs="+", required=True)
    s.add_argument("--source", help="name of this import's folder in the table; the same name again replaces it")
    s.add_argument("--columns", nargs="*")
    s.add_argument("--option", action="append", default=[])
    s.set_defaults(fn=cmd_copy_from)

    s = sub.add_parser("compact")
    s.add_argument("--table", required=True)
    s.add_argument("--out")
    s.set_defaults(fn=cmd_compact)

    s = sub.add_parser("quality")
    s.add_argument("--table", required=True)
    s.add_argument("--out", required=True)
    s.set_defaults(fn=cmd_quality)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.fn(spark or _session(args), args)


if __name__ == "__main__":
    main(sys.argv[1:])
