"""The stored readings table (partitioned Parquet) and appending results to files.

Every writer of the table (a stream, an import) has a folder of its own in it,
``source=<writer>/batch=<n>/reading_date=<day>/``, and writes each batch to one folder. A
batch that is written again replaces itself, writers don't know of each other, and a reader
sees them all by Spark's ordinary partition discovery. A table that was rewritten as a whole
has ``reading_date=<day>/`` alone.

Streams make a folder for each batch. ``retire_batches`` writes their rows again as one part
(``source=part-<id>/batch=0/``) and then commits a mark, ``_marks/<n>/``, a small table that
names all parts and the highest batch of each stream that lies in them. A reader follows the
newest whole mark: the parts, and every batch above its stream's mark. Before the mark is
committed the part is not read, after it the batches are not, so every row is read once
whenever the work stops. Folders that an earlier mark has retired are removed, so listings grow
with the parts and not with the batches.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.functions.time import utc_wall_clock
from sensorlake.operators.keys import token
from sensorlake.schema import TABLE


STREAM, PART = "stream-", "part-"


def read_table(spark: SparkSession, table_path: str, stream: bool = False) -> DataFrame:
    """Scan the stored table with its declared schema (no inference). Filters on
    ``reading_date`` prune partitions; other filters reach the Parquet reader. A stream reads
    a table whose batches have not been retired."""
    mark = newest_mark(spark, table_path)
    if mark is None:
        reader = spark.readStream if stream else spark.read
        return reader.schema(TABLE).parquet(table_path).select(*TABLE.fieldNames())
    if stream:
        raise ValueError("a table with retired batches can't be read as a stream")
    return _scan(spark, table_path, live_folders(spark, table_path, mark))


def _scan(spark: SparkSession, table_path: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], TABLE)
    base = table_path.rstrip("/")
    found = spark.read.schema(TABLE).option("basePath", base).parquet(*[f"{base}/{f}" for f in folders])
    return found.select(*TABLE.fieldNames())


@dataclass
class Mark:
    """What ``retire_batches`` has committed: the parts, and the last batch of each stream in them."""

    number: int = -1
    parts: list[str] = field(default_factory=list)
    through: dict[str, int] = field(default_factory=dict)


def _names(spark: SparkSession, table_path: str, pattern: str) -> list[str]:
    """Folders that match a pattern, relative to the table, in order."""
    path, fs = _folder(spark, table_path)
    depth = pattern.count("/") + 1
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, pattern)) or []
    return sorted("/".join(status.getPath().toString().split("/")[-depth:]) for status in found)


def newest_mark(spark: SparkSession, table_path: str) -> Mark | None:
    """The mark of the highest number that was written to its end."""
    whole = _names(spark, table_path, "_marks/*/_SUCCESS")
    if not whole:
        return None
    number = whole[-1].split("/")[1]
    mark = Mark(int(number))
    for r in spark.read.schema("part string, writer string, through long").json(f"{table_path.rstrip('/')}/_marks/{number}").collect():
        if r.part is not None:
            mark.parts.append(r.part)
        else:
            mark.through[r.writer] = r.through
    return mark


def _batches(spark: SparkSession, table_path: str, last: str = "batch=*") -> list[tuple[str, int]]:
    """(writer, batch) of all batch folders."""
    found = [re.fullmatch(r"source=([^/]*)/batch=(\d+)(/.*)?", n) for n in _names(spark, table_path, f"source=*/{last}")]
    return sorted({(m[1], int(m[2])) for m in found if m})


def live_folders(spark: SparkSession, table_path: str, mark: Mark) -> list[str]:
    """The folders that hold the table's rows: parts, and batches that lie in none."""
    later = [
        f"source={w}/batch={n}" for w, n in _batches(spark, table_path) if not w.startswith(PART) and n > mark.through.get(w, -1)
    ]
    return [*mark.parts, *later]


def retire_batches(spark: SparkSession, table_path: str, target_file_bytes: int = 256 * 1024 * 1024) -> int:
    """Write the rows of all finished batches of streams, but each stream's newest one, as one
    part of large, time-sorted files, and commit it; returns how many batches it holds. The
    newest batch may be written again by its stream. Imports stay as they are. Run it from one
    place at a time; readers that began before the last but one run must have ended."""
    base = table_path.rstrip("/")
    mark = newest_mark(spark, table_path) or Mark()
    retired = dict(mark.through)
    finished = [(w, n) for w, n in _batches(spark, table_path, "batch=*/_SUCCESS") if w.startswith(STREAM)]
    newest = dict(finished)
    taken = [(w, n) for w, n in finished if mark.through.get(w, -1) < n < newest[w]]
    if taken:
        folders = [f"source={w}/batch={n}" for w, n in taken]
        part = f"source={PART}{uuid.uuid4().hex}/batch=0"
        files = max(1, -(-sum(_bytes(spark, f"{base}/{f}") for f in folders) // target_file_bytes))
        write_sorted(_scan(spark, table_path, folders), f"{base}/{part}", files)
        through = {**mark.through, **dict(taken)}
        rows = [(p, None, None) for p in [*mark.parts, part]] + [(None, w, n) for w, n in sorted(through.items())]
        taken_numbers = [int(n.split("/")[1]) for n in _names(spark, table_path, "_marks/*")]
        number = max([mark.number, *taken_numbers]) + 1
        marks = spark.createDataFrame(rows, "part string, writer string, through long").coalesce(1)
        marks.write.mode("error").json(f"{base}/_marks/{number:08d}")
    # What this run has retired may still be read by queries that began before it.
    path, fs = _folder(spark, table_path)
    for w, n in _batches(spark, table_path):
        if w.startswith(STREAM) and n <= retired.get(w, -1):
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, f"source={w}/batch={n}"), True)
    return len(taken)


def write_sorted(df: DataFrame, out_path: str, tasks: int, max_records_per_file: int | None = None) -> None:
    """Rows of the table in time-sorted files, range-partitioned on (reading_date, timestamp,
    id), so that a busy day spreads over several tasks and time predicates skip files. Every row
    group has a Bloom filter of its ids, so a lookup by id reads few of them."""
    order = ["reading_date", "timestamp", "id"]
    w = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("reading_date")
    w = w.option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", str(max_records_per_file))
    w.parquet(out_path)


def write_batch(
    df: DataFrame, table_path: str, source: str, batch: int = 0, partition_by=("reading_date",), fmt: str = "parquet"
) -> None:
    """Write one batch of the writer ``source``; the same batch again replaces it."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(f"{table_path.rstrip('/')}/source={source}/batch={batch}")


def utc_date(ts: str, ntz: bool = False):
    """The ``reading_date`` of a timestamp: its day in UTC, whatever the session zone."""
    return F.to_date(F.col(ts) if ntz else utc_wall_clock(ts))


def _folder(spark: SparkSession, table_path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def partition_dates(spark: SparkSession, table_path: str) -> list[date]:
    """Dates of the table's ``reading_date`` partitions, from the names of their folders (no
    file is listed or opened)."""
    mark = newest_mark(spark, table_path)
    if mark is None:
        patterns = ["reading_date=*", "source=*/batch=*/reading_date=*"]
    else:
        patterns = [f"{f}/reading_date=*" for f in live_folders(spark, table_path, mark)]
    names = {n.rpartition("reading_date=")[2] for pattern in patterns for n in _names(spark, table_path, pattern)}
    # Not the partition of rows without a date.
    return sorted(date.fromisoformat(n) for n in names if not n.startswith("__"))


def _bytes(spark: SparkSession, path: str) -> int:
    folder, fs = _folder(spark, path)
    return int(fs.getContentSummary(folder).getLength())


def table_bytes(spark: SparkSession, table_path: str) -> int:
    """Total size of the table's files, from the file system's own summaries."""
    mark = newest_mark(spark, table_path)
    if mark is None:
        return _bytes(spark, table_path)
    return sum(_bytes(spark, f"{table_path.rstrip('/')}/{f}") for f in live_folders(spark, table_path, mark))


def write_by_token(df: DataFrame, path: str, keys, files: int) -> None:
    """Store ``df`` clustered by the hash of its keys (``operators.keys.token``, stored as the
    column ``token``): each of about ``files`` files holds one contiguous range of tokens."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    with_token = df.withColumn("token", token(*keys))
    with_token.repartitionByRange(files, "token").sortWithinPartitions("token").write.mode("overwrite").parquet(path)


def read_token_range(spark: SparkSession, path: str, begin: int | None = None, end: int | None = None) -> DataFrame:
    """Rows of a table of ``write_by_token`` with a token in ``[begin, end)``. The bounds reach
    the Parquet reader, which skips all row groups whose least and greatest token lie outside."""
    df = spark.read.parquet(path)
    if begin is not None:
        df = df.where(F.col("token") >= F.lit(begin))
    if end is not None:
        df = df.where(F.col("token") < F.lit(end))
    return df


def append_result(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Append a query result to files at ``path`` (the file form of capturing output)."""
    df.write.mode("append").format(fmt).options(**options).save(path)
