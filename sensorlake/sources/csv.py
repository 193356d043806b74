"""Bulk CSV import and export with dialect and formatting options.

Import reads whole lines in the file's charset, parses each once into text fields,
converts each column by the option set, and splits the rows into ``(good, bad)``: a line
with the wrong number of fields, or a value that does not convert, goes to ``bad`` with the
source line as it stands in the file, the file and the reason. Every option goes through
the same reader; with ``multiline`` (quoted fields with line breaks) a row is a record of
several lines, found in parallel (``multiline``); only on streams, and in charsets of wider
units, Spark's CSV reader finds the rows, a file is then one task, and a bad row's line is
written anew from its fields. Export
formats each column to text by type and writes with Spark's CSV writer; parallelism is the
DataFrame's partitions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegralType,
    NumericType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from sensorlake.functions.numbers import format_number, localize, parse_number
from sensorlake.functions.text import format_bool, norm_name, parse_bool
from sensorlake.functions.time import format_ts, strftime_to_spark, utc_wall_clock
from sensorlake.operators.keys import hash_range
from sensorlake.schema import CORRUPT_COLUMN
from sensorlake.session import checkpoint_dir
from sensorlake.sources.multiline import records

# Option defaults of the COPY command.
DEFAULTS = {
    "delimiter": ",",
    "quote": '"',
    "escape": "\\",
    "header": False,
    "null": "",
    "datetimeformat": "%Y-%m-%d %H:%M:%S%z",
    "decimalsep": ".",
    "thousandssep": "",
    "boolstyle": "True,False",
    "float_precision": 5,
    "double_precision": 12,
}

REASON_MALFORMED_LINE = "malformed_line"
REASON_BAD_VALUE = "bad_value"
_LINE = "_line"
_WHOLE = "_whole"
#: Charsets in which a line feed is one byte that is part of no other character.
_BYTEWISE = ("utf-8", "us-ascii", "iso-8859-1")


class ParseErrorLimitExceeded(RuntimeError):
    """More lines failed to import than MAXPARSEERRORS allows; nothing was written."""


def _paths(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else sorted(paths)


def _charset(encoding: str) -> str:
    """COPY spells encodings the Python way (``utf8``); Spark wants ``utf-8``."""
    e = encoding.strip().lower().replace("_", "-")
    return {"utf8": "utf-8", "latin1": "iso-8859-1", "latin-1": "iso-8859-1", "ascii": "us-ascii"}.get(e, e)


def _reader_options(delimiter, quote, escape, null, encoding, field_size_limit) -> dict[str, str]:
    opts = {
        "sep": delimiter,
        "quote": quote,
        "escape": escape,
        "nullValue": null,
        "encoding": _charset(encoding),
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT_COLUMN,
    }
    if field_size_limit:
        opts["maxCharsPerColumn"] = str(field_size_limit)
    return opts


def _convert(text: Column, field: StructField, fmt: str, decimalsep: str, thousandssep: str, boolstyle: str) -> Column:
    dt = field.dataType
    if isinstance(dt, StringType):
        return text
    if isinstance(dt, BooleanType):
        return parse_bool(text, boolstyle)
    if isinstance(dt, (IntegralType, FloatType, DoubleType, DecimalType)):
        return parse_number(text, decimalsep, thousandssep, dt.simpleString())
    if isinstance(dt, TimestampType):
        return F.try_to_timestamp(F.trim(text), F.lit(strftime_to_spark(fmt)))
    if isinstance(dt, TimestampNTZType):
        pattern = strftime_to_spark(fmt)
        instant = F.try_to_timestamp(F.trim(text), F.lit(pattern))
        if "%z" in fmt:
            return utc_wall_clock(instant)
        return F.when(instant.isNotNull(), F.to_timestamp_ntz(F.trim(text), F.lit(pattern)))
    if isinstance(dt, DateType):
        return F.trim(text).try_cast("date")
    return text.try_cast(dt)


def _once(value: Column, name: str) -> Column:
    """``value`` as a column that is computed once a row. A filter on a plain column is pushed
    below it with a copy of its expression, and each field taken from a struct is another copy;
    neither goes below a generator (as in ``messages``)."""
    return F.explode(F.array(value)).alias(name)


def _lines(reader, encoding: str, header: bool):
    """A reader of whole lines in the given charset, each file's header left out: a CSV reader
    of one field, whose separator and quote are no characters of any text. Should a line hold
    them all the same, it has too many fields and comes back whole in ``_whole``."""
    return (
        reader.schema(StructType([StructField(_LINE, StringType(), True), StructField(_WHOLE, StringType(), True)]))
        .option("columnNameOfCorruptRecord", _WHOLE)
        .option("sep", "\ufdd0")
        .option("quote", "\ufdd1")
        .option("escape", "\ufdd1")
        .option("encoding", _charset(encoding))
        .option("header", str(bool(header)).lower())
    )


def _physical_lines(reader, where, encoding: str, meta: list[Column]) -> DataFrame:
    """All lines, empty ones too, with their split and a number that ascends within it."""
    raw = reader.option("lineSep", "\n").text(where).select("value", *meta, F.monotonically_increasing_id().alias("_m"))
    text = F.col("value") if _charset(encoding) != "iso-8859-1" else F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    return raw.select("source", "_block", "_m", F.regexp_replace(text, "\r$", "").alias(_LINE))


def _literal_path(uri: str) -> str:
    """The path that names exactly the file of a ``_metadata.file_path``, which is encoded as a
    URI; a reader takes paths as patterns."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(uri))


def _between_rows(rows: DataFrame, read_file, first: int, stop: int | None) -> DataFrame:
    """Rows whose 0-based position over the files (sorted by path, then by place) is in
    ``[first, stop)``. ``rows`` has ``source`` (the file).

    Rows are counted for each file, which doesn't depend on how files are split. Files within
    the range are kept by a filter on their path, which prunes the others. Only the one or
    two files in which the range begins or ends need positions; they are read by
    ``read_file`` and written to the shared checkpoint folder with their row numbers, so
    that no later scan can number them otherwise."""
    checkpoint_dir(rows.sparkSession)
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source").collect()
    whole, parts, at = [], [], 0
    for r in counts:
        lo, hi = max(first - at, 0), r["n"] if stop is None else min(stop - at, r["n"])
        at += r["n"]
        if lo == 0 and hi == r["n"]:
            whole.append(r["source"])
        elif lo < hi:
            parts.append((r["source"], lo, hi))
    out = rows.where(F.col("source").between(whole[0], whole[-1]) if whole else F.lit(False))
    for source, lo, hi in parts:
        placed = read_file(_literal_path(source))
        if "_m" not in placed.columns:
            placed = placed.withColumn("_m", F.monotonically_increasing_id())
        placed = placed.checkpoint()
        blocks = placed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
        # One row for each split of one file.
        before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        starts = blocks.select("_block", "_m0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        place = F.col("_start") + F.col("_m") - F.col("_m0")
        out = out.unionByName(placed.join(starts, "_block").where((place >= lo) & (place < hi)).select(*rows.columns))
    return out


def import_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: StructType,
    *,
    columns: Sequence[str] | None = None,
    delimiter: str = DEFAULTS["delimiter"],
    quote: str = DEFAULTS["quote"],
    escape: str = DEFAULTS["escape"],
    header: bool = DEFAULTS["header"],
    null: str = DEFAULTS["null"],
    datetimeformat: str = DEFAULTS["datetimeformat"],
    decimalsep: str = DEFAULTS["decimalsep"],
    thousandssep: str = DEFAULTS["thousandssep"],
    boolstyle: str = DEFAULTS["boolstyle"],
    skipcols: Sequence[str] = (),
    skiprows: int = 0,
    maxrows: int = -1,
    maxparseerrors: int = -1,
    errfile: str | None = None,
    encoding: str = "utf8",
    field_size_limit: int | None = None,
    ttl: int | None = None,
    multiline: bool = False,
    stream: bool = False,
    max_files_per_trigger: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Read CSV files (names or glob patterns; one scan) into ``(good, bad)``.

    ``schema`` gives the target types; ``columns`` the file's column order (default: the
    schema's). ``good`` has the converted columns minus ``skipcols``; ``bad`` has
    ``line``, ``source`` and ``reason``. ``header`` drops the first line of every file.
    ``skiprows``/``maxrows`` count rows over the files sorted by path, without headers and
    empty lines. ``multiline`` reads quoted fields with line breaks; a break within a field
    comes as a line feed. ``maxparseerrors`` >= 0 counts bad lines first and raises
    ``ParseErrorLimitExceeded`` above it; ``errfile`` appends the bad lines as text. ``ttl`` (seconds) adds ``expires_at`` = import time +
    ttl (no column: rows never expire).

    ``stream=True`` returns streaming DataFrames over a folder (or glob) that keeps
    receiving files; ``max_files_per_trigger`` caps the intake per micro-batch (the
    import-rate setting). Row counting options (skiprows, maxrows, maxparseerrors,
    errfile) need the whole input and are batch only.
    """
    names = [norm_name(c) for c in columns] if columns else [f.name for f in schema.fields]
    by_name = {f.name: f for f in schema.fields}
    unknown = [n for n in names if n not in by_name]
    if unknown:
        raise ValueError(f"columns not in schema: {unknown}")
    skip = {norm_name(c) for c in skipcols}
    text_schema = StructType(
        [StructField(n, StringType(), True) for n in names] + [StructField(CORRUPT_COLUMN, StringType(), True)]
    )
    opts = _reader_options(delimiter, quote, escape, null, encoding, field_size_limit)
    plist = _paths(paths)

    if stream:
        if skiprows > 0 or maxrows >= 0 or (maxparseerrors is not None and maxparseerrors >= 0) or errfile:
            raise ValueError("skiprows, maxrows, maxparseerrors and errfile need a batch import")
        if len(plist) != 1:
            raise ValueError("a streaming import reads one folder or glob")

    def read(where) -> DataFrame:
        """Rows as text columns, the line (NULL if only the fields are known) and the source."""
        reader = spark.readStream if stream else spark.read
        if stream and max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
        meta = [F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_block")]
        if multiline and (stream or not quote or _charset(encoding) not in _BYTEWISE):
            reader = reader.schema(text_schema).options(**opts).option("header", str(bool(header)).lower())
            found = reader.option("multiLine", "true").csv(where).select("*", *meta)
            written = F.to_csv(
                F.struct(*[F.col(f"`{n}`") for n in names]), {"sep": delimiter, "quote": quote, "escape": escape, "nullValue": null}
            )
            return found.withColumn(_LINE, F.coalesce(f"`{CORRUPT_COLUMN}`", written))
        if multiline:
            lines = records(_physical_lines(reader, where, encoding, meta), delimiter, quote, escape)
            if header:  # a file's first record, however many lines it has
                lines = lines.where((F.col("_block") > 0) | (F.col("_m") > 1))
        else:
            lines = _lines(reader, encoding, header).csv(where).select(F.coalesce(_WHOLE, _LINE).alias(_LINE), *meta)
        ddl = ", ".join(f"`{f.name}` string" for f in text_schema.fields)
        # The parser takes these two for ends of its input, and would go wrong in the next line.
        odd = F.col(_LINE).contains("\uffff") | F.col(_LINE).contains("\ufffe")
        parsed = F.from_csv(F.when(~odd, F.col(_LINE)), ddl, {k: v for k, v in opts.items() if k != "encoding"})
        corrupt = F.when(odd, F.col(_LINE)).otherwise(F.col(f"_r.`{CORRUPT_COLUMN}`")).alias(CORRUPT_COLUMN)
        fields = [F.col(f"_r.`{n}`") for n in names]
        place = [c for c in ("source", "_block", "_m") if c in lines.columns]
        return lines.select(_LINE, *place, _once(parsed, "_r")).select(*fields, corrupt, _LINE, *place)

    raw = read(plist[0] if stream else plist)
    if skiprows > 0 or maxrows >= 0:
        stop = skiprows + maxrows if maxrows >= 0 else None
        raw = _between_rows(raw, read, max(0, skiprows), stop)

    values = F.struct(
        *[_convert(F.col(f"`{n}`"), by_name[n], datetimeformat, decimalsep, thousandssep, boolstyle).alias(n) for n in names]
    )
    read_once = raw.select("*", _once(values, "_v"))
    failed = [
        F.when(F.col(f"`{n}`").isNotNull() & F.col(f"_v.`{n}`").isNull(), F.lit(n)) for n in names if n not in skip
    ]
    bad_cols = F.concat_ws(",", *failed) if failed else F.lit("")
    tagged = read_once.select(
        *[F.col(f"_v.`{n}`").alias(n) for n in names],
        F.col(CORRUPT_COLUMN),
        F.col(_LINE),
        bad_cols.alias("_bad_cols"),
        F.col("source"),
    )
    reason = F.when(F.col(CORRUPT_COLUMN).isNotNull(), F.lit(REASON_MALFORMED_LINE)).when(
        F.col("_bad_cols") != "", F.concat(F.lit(REASON_BAD_VALUE + ":"), F.col("_bad_cols"))
    )
    tagged = tagged.withColumn("reason", reason)
    good = tagged.where(F.col("reason").isNull()).select(*[F.col(f"`{n}`") for n in names if n not in skip])
    if ttl is not None:
        good = good.withColumn(
            "expires_at", F.current_timestamp() + F.make_dt_interval(secs=F.lit(ttl).cast("decimal(18,6)"))
        )
    bad = tagged.where(F.col("reason").isNotNull()).select(F.col(_LINE).alias("line"), "source", "reason")
    if maxparseerrors is not None and maxparseerrors >= 0:
        n_bad = bad.count()
        if n_bad > maxparseerrors:
            raise ParseErrorLimitExceeded(f"{n_bad} lines failed to import; MAXPARSEERRORS is {maxparseerrors}")
    if errfile:
        bad.select("line").write.mode("append").text(errfile)
    return good, bad


def format_columns(
    df: DataFrame,
    *,
    float_precision: int = DEFAULTS["float_precision"],
    double_precision: int = DEFAULTS["double_precision"],
    datetimeformat: str = DEFAULTS["datetimeformat"],
    decimalsep: str = DEFAULTS["decimalsep"],
    thousandssep: str = DEFAULTS["thousandssep"],
    boolstyle: str = DEFAULTS["boolstyle"],
    null_text: str | None = None,
    tz: str | None = None,
) -> DataFrame:
    """Every column to text by its type: floats with ``float_precision`` digits after
    the point, doubles with ``double_precision`` (trailing zeros trimmed), booleans by
    style, timestamps by strftime format in zone ``tz`` (default: the session zone; a
    wall clock without zone renders ``%z`` as +0000). ``null_text`` replaces NULL when
    given."""
    cols = []
    for f in df.schema.fields:
        c, dt = F.col(f"`{f.name}`"), f.dataType
        if isinstance(dt, FloatType):
            t = format_number(c, float_precision, decimalsep, thousandssep)
        elif isinstance(dt, DoubleType):
            t = format_number(c, double_precision, decimalsep, thousandssep)
        elif isinstance(dt, BooleanType):
            t = format_bool(c, boolstyle)
        elif isinstance(dt, TimestampType):
            t = format_ts(c, datetimeformat, tz=tz)
        elif isinstance(dt, TimestampNTZType):
            t = format_ts(c, datetimeformat, tz=tz, ntz=True)
        elif isinstance(dt, NumericType) and (decimalsep != "." or thousandssep):
            # Integers and decimals keep their exact text; only separators change.
            t = F.when(c.isNotNull(), localize(c.cast("string"), decimalsep, thousandssep))
        else:
            t = c.cast("string")
        if null_text is not None:
            t = F.coalesce(t, F.lit(null_text))
        cols.append(t.alias(f.name))
    return df.select(*cols)


def export_csv(
    df: DataFrame,
    path: str,
    *,
    columns: Sequence[str] | None = None,
    delimiter: str = DEFAULTS["delimiter"],
    quote: str = DEFAULTS["quote"],
    escape: str = DEFAULTS["escape"],
    header: bool = DEFAULTS["header"],
    null: str = DEFAULTS["null"],
    datetimeformat: str = DEFAULTS["datetimeformat"],
    decimalsep: str = DEFAULTS["decimalsep"],
    thousandssep: str = DEFAULTS["thousandssep"],
    boolstyle: str = DEFAULTS["boolstyle"],
    float_precision: int = DEFAULTS["float_precision"],
    double_precision: int = DEFAULTS["double_precision"],
    maxoutputsize: int = -1,
    encoding: str = "utf8",
    begintoken: int | None = None,
    endtoken: int | None = None,
    token_keys: Sequence[str] | None = None,
    mode: str = "overwrite",
    tz: str | None = None,
) -> None:
    """Write ``df`` as CSV files under ``path``, one file per task (no funnel into one
    writer). ``maxoutputsize`` caps lines per file (more files, never fewer rows);
    ``begintoken``/``endtoken`` export only the hash range of ``token_keys``."""
    out = df
    if begintoken is not None or endtoken is not None:
        if not token_keys:
            raise ValueError("token range export needs token_keys")
        out = hash_range(out, token_keys, begintoken, endtoken)
    if columns:
        out = out.select(*[F.col(f"`{norm_name(c)}`") for c in columns])
    text = format_columns(
        out,
        float_precision=float_precision,
        double_precision=double_precision,
        datetimeformat=datetimeformat,
        decimalsep=decimalsep,
        thousandssep=thousandssep,
        boolstyle=boolstyle,
        tz=tz,
    )
    w = (
        text.write.mode(mode)
        .option("sep", delimiter)
        .option("quote", quote)
        .option("escape", escape)
        .option("header", str(bool(header)).lower())
        .option("nullValue", null)
        .option("encoding", _charset(encoding))
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
    )
    if maxoutputsize and maxoutputsize > 0:
        w = w.option("maxRecordsPerFile", str(maxoutputsize))
    w.csv(path)
