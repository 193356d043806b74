"""Report queries over the stored table: limits, order, paging, lookups, counts, long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.schema import METRICS


def _cols(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def take_any(df: DataFrame, n: int = 100) -> DataFrame:
    """``LIMIT n`` with no order: any ``n`` rows (not deterministic)."""
    return df.limit(n)


def newest_first(df: DataFrame, ts: str = "timestamp", tiebreak=()) -> DataFrame:
    """Whole result ordered by time, newest first, NULL times last (batch only).

    A range-partitioned global sort: no single-partition step."""
    return df.orderBy(F.col(ts).desc_nulls_last(), *[F.col(c).asc() for c in _cols(tiebreak)])


def sample_then_sort(df: DataFrame, n: int = 100, ts: str = "timestamp") -> DataFrame:
    """The original dashboard's order of operations: any ``n`` rows, then sorted by
    time descending. Kept for parity; ``latest`` is what the page title means."""
    return df.limit(n).orderBy(F.col(ts).desc_nulls_last())


def latest(df: DataFrame, n: int = 100, ts: str = "timestamp", tiebreak="id") -> DataFrame:
    """The ``n`` newest rows, newest first (batch only).

    Plans as ``TakeOrderedAndProject``: each task keeps its own top ``n`` and only
    ``n`` rows per task reach the final merge; there is no full sort."""
    order = [F.col(ts).desc_nulls_last()] + [F.col(c).asc() for c in _cols(tiebreak)]
    return df.orderBy(*order).limit(n)


def page(
    df: DataFrame,
    order: str | Sequence[str],
    size: int = 100,
    after: Sequence | object | None = None,
) -> DataFrame:
    """Keyset paging: the ``size`` rows that follow ``after`` in ``order`` (batch only).

    ``order`` must end in a unique column. ``after`` is the last key of the previous page
    (a value, or a tuple for a composite order); the predicate ``key > after`` reaches
    the scan, so a page costs a top-``size`` pass, not a numbering of all rows.
    ``size=None`` turns paging off (the whole ordered result).
    """
    cols = _cols(order)
    out = df
    if after is not None:
        vals = list(after) if isinstance(after, (tuple, list)) else [after]
        if len(vals) != len(cols):
            raise ValueError("after must give one value per order column")
        out = out.where(after_key(cols, vals))
    out = out.orderBy(*[F.col(c).asc() for c in cols])
    return out if size is None else out.limit(size)


def after_key(cols: list[str], vals: list) -> Column:
    """Lexicographic ``(cols) > (vals)`` as an OR of prefix equalities; a NULL comes before
    every value, as in Spark's ascending order."""
    cond = None
    for i in range(len(cols)):
        term = F.col(cols[i]).isNotNull() if vals[i] is None else F.col(cols[i]) > F.lit(vals[i])
        for j in range(i):
            same = F.col(cols[j]).isNull() if vals[j] is None else F.col(cols[j]) == F.lit(vals[j])
            term = term & same
        cond = term if cond is None else (cond | term)
    return cond


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """Equality predicate on one column (pushed to the Parquet reader)."""
    return df.where(F.col(column) == F.lit(value))


def row_count(df: DataFrame, name: str = "n_rows") -> DataFrame:
    """One row with the number of rows (partial counts per task, then one merge)."""
    return df.agg(F.count(F.lit(1)).alias(name))


def unpivot_readings(
    df: DataFrame, ids=("id", "timestamp"), metrics=METRICS, name: str = "metric", value: str = "value"
) -> DataFrame:
    """Long form: one row per (reading, metric). A narrow expand, no shuffle."""
    return df.unpivot(list(_cols(ids)), list(metrics), name, value)
