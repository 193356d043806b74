"""Per-key sequence operators that stay balanced when one key holds many rows.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task, so a sensor
with a third of all rows would make one task sort a third of the table. Here a key
with more than ``rows_per_slice`` rows is cut into contiguous slices of its order,
and the window runs per ``(key, slice)``:

1. one aggregation counts the rows of each key. By default ``rows_per_slice`` is a quarter
   of one task's fair share of the rows, so at most ``4 x parallelism`` keys can be heavy,
   which bounds the table that is broadcast; above ``max_broadcast_rows`` it is joined
   with a shuffle instead;
2. for the heavy keys a sample of rows (by a hash of the order columns, about
   ``SAMPLE_PER_SLICE`` for each slice) gives the split points: quantiles of the whole order
   tuple, so that outliers, bursts, equal times and NULL or NaN times are cut evenly too;
3. each row gets ``_slice``: 0 for light keys, the number of split points not after it for
   heavy keys, found by binary search. The window is partitioned by ``(key, _slice)``: one shuffle of the data;
4. what crosses a slice border (row counts before a slice, the last row of the previous
   slice) comes from a per-(heavy key, slice) aggregate whose size has the same bound,
   broadcast back.

Correctness never depends on how even the slices are. The ordering must end in a unique
column for the result to be deterministic, and for equal order values to be cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorlake.session import checkpoint_dir, parallelism

MIN_ROWS_PER_SLICE = 1_000
SLICES_PER_TASK = 4
DEFAULT_ROWS_PER_SLICE = None  # sized from the data, see auto_rows_per_slice
DEFAULT_MAX_BROADCAST_ROWS = 1_000_000
SAMPLE_PER_SLICE = 64
HASH_RANGE = 1 << 30

_ALL = "_all_rows"
_SLICE = "_slice"
_NS = "_n_slices"
_CUTS = "_cuts"


def _cols(cols) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


@dataclass
class Sliced:
    df: DataFrame  # input plus _slice (and slicing helpers)
    keys: list[str]  # partition keys (a constant column when none were given)
    heavy: DataFrame | None  # keys with more than rows_per_slice rows
    n_heavy: int
    n_slices: int  # sum of slices over heavy keys: bounds the border tables
    max_broadcast_rows: int
    helpers: tuple[str, ...]


def _null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str, small: int, limit: int) -> DataFrame:
    """Equi-join on ``on`` with NULL matching NULL; ``right`` is broadcast only when its
    row count ``small`` is within ``limit``."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") for c in on], *[c for c in right.columns if c not in on])
    if small <= limit:
        r = F.broadcast(r)
    cond = None
    for c in on:
        t = left[c].eqNullSafe(r[f"__r_{c}"])
        cond = t if cond is None else cond & t
    return left.join(r, cond, how).drop(*[f"__r_{c}" for c in on])


def auto_rows_per_slice(spark, total_rows: int) -> int:
    """A key is heavy when it alone exceeds a fraction of one task's fair share."""
    par = parallelism(spark)
    return max(MIN_ROWS_PER_SLICE, -(-total_rows // (SLICES_PER_TASK * par)))


def slice_keys(
    df: DataFrame,
    partition_by,
    order,
    rows_per_slice: int | None = None,
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
    descending: bool = False,
) -> Sliced:
    """Attach ``_slice`` (see module doc). ``rows_per_slice=None`` sizes slices from the
    row count and the cluster's parallelism. ``descending`` numbers slices from the
    largest values down (NULL order values last, as Spark orders them descending)."""
    keys, order = _cols(partition_by), _cols(order)
    helpers: list[str] = []
    base = df
    if not keys:
        base = df.withColumn(_ALL, F.lit(0))
        keys = [_ALL]
        helpers.append(_ALL)
    # One row per key: partial aggregation, so a hot key costs one row per map task. Kept in
    # the shared checkpoint folder: its totals and its heavy keys are both read.
    checkpoint_dir(df.sparkSession)
    stats = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    sizes = stats.agg(F.sum("_n").alias("total"), F.max("_n").alias("biggest")).first()
    total, biggest = int(sizes["total"] or 0), int(sizes["biggest"] or 0)
    if rows_per_slice is None:
        rows_per_slice = auto_rows_per_slice(df.sparkSession, total)
    helpers += [_SLICE, _NS]
    if biggest <= rows_per_slice:
        out = base.withColumn(_SLICE, F.lit(0).cast("long")).withColumn(_NS, F.lit(None).cast("long"))
        return Sliced(out, keys, None, 0, 0, max_broadcast_rows, tuple(helpers))
    # At most total / rows_per_slice keys can pass this filter: the proven size bound.
    heavy = stats.where(F.col("_n") > F.lit(rows_per_slice)).withColumn(
        _NS, F.ceil(F.col("_n") / F.lit(rows_per_slice)).cast("long")
    )
    row = heavy.agg(F.count(F.lit(1)).alias("n"), F.sum(_NS).alias("s")).first()
    n_heavy, n_slices = int(row["n"]), int(row["s"] or 0)
    place = F.struct(*[F.col(c) for c in order])
    share = F.lit(float(SAMPLE_PER_SLICE)) * F.col(_NS) / F.col("_n") * F.lit(float(HASH_RANGE))
    sampled = base.select(*keys, *[c for c in order if c not in keys])
    if _ALL in keys:  # one key: its numbers are literals, and its cuts a scalar subquery
        sampled = sampled.withColumns({"_n": F.lit(total), _NS: F.lit(n_slices)})
    else:
        sampled = _null_safe_join(sampled, heavy, keys, "inner", n_heavy, max_broadcast_rows)
    sampled = sampled.where(F.pmod(F.xxhash64(*order), F.lit(HASH_RANGE)) < share)
    # About SAMPLE_PER_SLICE x slices places of each heavy key, whatever the key's size.
    places = F.sort_array(F.collect_list(place))
    nth = F.transform(
        F.sequence(F.lit(1).cast("long"), F.col(_NS) - 1),
        lambda i: F.element_at("_places", (F.floor(i * F.size("_places") / F.col(_NS)) + 1).cast("int")),
    )
    cuts = (
        sampled.groupBy(*keys)
        .agg(places.alias("_places"), F.max(_NS).alias(_NS))
        .select(*keys, F.when(F.col(_NS) > 1, F.array_distinct(nth)).alias(_CUTS), _NS)
        .checkpoint()
    )
    if _ALL in keys:
        joined = base.withColumns({_CUTS: cuts.select(_CUTS).scalar(), _NS: F.lit(n_slices).cast("long")})
    else:
        joined = _null_safe_join(base, cuts, keys, "left", n_heavy, max_broadcast_rows)
    passed = _cuts_passed(place, n_slices).cast("long")
    slice_ = (F.col(_NS) - 1 - passed) if descending else passed
    out = joined.withColumn(_SLICE, F.when(F.col(_CUTS).isNull(), F.lit(0).cast("long")).otherwise(slice_)).drop(_CUTS)
    return Sliced(out, keys, cuts, n_heavy, n_slices, max_broadcast_rows, tuple(helpers))


def _cuts_passed(place: Column, n_slices: int) -> Column:
    """How many of a row's ascending cuts are not after its place: a binary search, whose
    steps are the powers of two up to the number of slices."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, n_slices).bit_length()))])

    def advance(found: Column, step: Column) -> Column:
        return found + F.when(F.get(_CUTS, found + step - 1) <= place, step).otherwise(0)

    return F.aggregate(steps, F.lit(0), advance)


def _order_cols(order, descending: bool = False) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c) for c in _cols(order)]


def number_rows(
    df: DataFrame,
    order,
    partition_by=None,
    name: str = "row_number",
    rows_per_slice: int | None = DEFAULT_ROWS_PER_SLICE,
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
    descending: bool = False,
) -> DataFrame:
    """1-based row number (bigint) per ``partition_by`` in ``order`` (batch only).

    With no ``partition_by`` the whole input is one sequence, still cut into slices so
    it never funnels through a single task. ``order`` is a list of column names.
    ``descending`` orders every column descending.
    """
    order = _cols(order)
    s = slice_keys(df, partition_by, order, rows_per_slice, max_broadcast_rows, descending)
    w = Window.partitionBy(*s.keys, _SLICE).orderBy(*_order_cols(order, descending))
    out = s.df.withColumn("_rn", F.row_number().over(w).cast("long"))
    if s.n_heavy:
        # A partial aggregation over the heavy keys' rows (key and order columns only,
        # so a columnar scan reads little); cheaper than reading the windowed rows again,
        # whose shuffle Spark cannot reuse once the columns differ.
        counts = (
            s.df.where(F.col(_NS).isNotNull())
            .groupBy(*s.keys, _SLICE)
            .agg(F.count(F.lit(1)).alias("_cnt"))
        )
        before = Window.partitionBy(*s.keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*s.keys, _SLICE, F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
        out = _null_safe_join(out, offsets, s.keys + [_SLICE], "left", s.n_slices, s.max_broadcast_rows)
        out = out.withColumn("_rn", F.col("_rn") + F.coalesce(F.col("_off"), F.lit(0))).drop("_off")
    return out.withColumnRenamed("_rn", name).drop(*s.helpers)


def with_previous(
    df: DataFrame,
    partition_by,
    order,
    cols,
    prefix: str = "prev_",
    rows_per_slice: int | None = DEFAULT_ROWS_PER_SLICE,
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
    descending: bool = False,
) -> DataFrame:
    """Add ``prefix + c`` = value of ``c`` in the previous row of the same key in
    ``order`` (``lag``), NULL on a key's first row (batch only)."""
    order, cols = _cols(order), _cols(cols)
    s = slice_keys(df, partition_by, order, rows_per_slice, max_broadcast_rows, descending)
    w = Window.partitionBy(*s.keys, _SLICE).orderBy(*_order_cols(order, descending))
    out = s.df.select(
        "*",
        *[F.lag(c).over(w).alias(prefix + c) for c in cols],
        (F.row_number().over(w) == 1).alias("_first"),
    )
    if s.n_heavy:
        # Last row of each heavy slice: a partial aggregation (max_by merges per task).
        last = (
            s.df.where(F.col(_NS).isNotNull())
            .groupBy(*s.keys, _SLICE)
            .agg(
                # the last row in descending order is the smallest ascending one
                (F.min_by if descending else F.max_by)(F.struct(*cols), F.struct(*order)).alias("_last")
            )
        )
        prev_slice = Window.partitionBy(*s.keys).orderBy(_SLICE)
        carry = last.select(*s.keys, _SLICE, F.lag("_last").over(prev_slice).alias("_carry"))
        out = _null_safe_join(out, carry, s.keys + [_SLICE], "left", s.n_slices, s.max_broadcast_rows)
        out = out.select(
            *[c for c in out.columns if c not in {prefix + x for x in cols} and c != "_carry"],
            *[
                F.when(F.col("_first"), F.col("_carry")[c]).otherwise(F.col(prefix + c)).alias(prefix + c)
                for c in cols
            ],
        )
    return out.drop("_first", *s.helpers)
