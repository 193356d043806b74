"""Records of CSV files whose quoted fields hold line breaks, found in parallel.

Whether a line break ends a record depends on all quotes before it in the file. But a single
line has only two cases, that it begins outside quotes or inside, and is thus a function of two
states:

1. each line (of any split of a file) reports the state in which it ends for both;
2. such functions compose by counting: a line that ends alike in both cases fixes the state,
   later ones keep or turn it. So a window over a split's lines gives each line's state for
   both cases of the split's own beginning, and one row for each split its whole function;
3. the same window over a file's splits, one row each, chooses for every split which case is
   true. Lines that begin outside quotes begin records;
4. a split's lines are joined to records; what continues a record of an earlier split goes to
   it, one piece a split.

The lines' text is shuffled once, by split; no file or record passes through one task but in
its own splits. All of it is built from column expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OUT, _IN, _CLOSED, _START = 0, 1, 2, 3


def ends_inside(line: Column, inside: bool, delimiter: str, quote: str, escape: str) -> Column:
    """Whether a line that begins outside (``inside``: inside) quotes ends inside them.

    A quote opens a field where it is the field's first character; within one it closes, but
    not behind an escape; behind a closing quote another one is a quote of the text if quotes
    escape themselves, and anything else belongs to the field up to the next delimiter."""
    text = line
    if escape and escape != quote:
        text = F.regexp_replace(text, f"{re.escape(escape)}[{re.escape(escape)}{re.escape(quote)}]", "xx")
    before = F.split(text, re.escape(quote), -1)

    def at_quote(state: Column, piece: Column) -> Column:
        """The state behind a quote that follows ``piece``."""
        opens = piece.endswith(delimiter)
        doubled = (piece == "") & ((state == _START) | (F.lit(escape == quote) & (state == _CLOSED)))
        return F.when(state == _IN, _CLOSED).when(opens | doubled, _IN).otherwise(_OUT)

    quotes = F.slice(before, F.lit(1), F.size(before) - 1)
    state = F.aggregate(quotes, F.lit(_IN if inside else _START), at_quote)
    return F.when(line.contains(quote), state == _IN).otherwise(F.lit(inside))


def with_states(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds (state0, state1): whether a row begins inside quotes if the first row of its
    ``keys`` begins outside, or inside. ``end0`` and ``end1`` say how a row ends."""
    whole = Window.partitionBy(*keys).orderBy(order)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    fixes = F.col("end0") == F.col("end1")
    turn = (F.col("end0") & ~F.col("end1")).cast("int")
    turned = df.withColumn("_turns", F.sum(turn).over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.last(F.when(fixes, F.struct(F.col("end0").alias("value"), F.col("_turns").alias("turns"))), ignorenulls=True)
    placed = turned.withColumn("_fixed", fixed.over(before)).withColumn("_turns", F.col("_turns") - turn)

    def state(first: bool) -> Column:
        value = F.coalesce(F.col("_fixed.value"), F.lit(first))
        odd = (F.col("_turns") - F.coalesce(F.col("_fixed.turns"), F.lit(0))) % 2 == 1
        return value != odd

    return placed.withColumns({"state0": state(False), "state1": state(True)}).drop("_turns", "_fixed")


def records(lines: DataFrame, delimiter: str, quote: str, escape: str) -> DataFrame:
    """``lines`` (source, _block: the split's offset, _m: ascending within the split, _line) ->
    the same columns for records: _m counts a split's records from 1 without gaps, _line is
    the record's text with its line breaks. Empty lines between records are left out."""
    split = ["source", "_block"]
    ends = {f"end{i}": ends_inside(F.col("_line"), bool(i), delimiter, quote, escape) for i in (0, 1)}
    marked = lines.withColumns({**ends, "blank": F.col("_line") == ""})

    def starts(state: str) -> Column:
        return ~F.col(state) & ~F.col("blank")

    def end(state: str) -> Column:
        return F.when(F.col(state), F.col("end1")).otherwise(F.col("end0"))

    # One row a split: how it ends and how many records begin in it, for both cases.
    narrow = with_states(marked.select(*split, "_m", "end0", "end1", "blank"), split, "_m")
    cases = [
        c for i in (0, 1) for c in (F.max_by(end(f"state{i}"), "_m").alias(f"end{i}"), F.count_if(starts(f"state{i}")).alias(f"n{i}"))
    ]
    splits = with_states(narrow.groupBy(*split).agg(*cases), ["source"], "_block")
    inside = F.col("state0").alias("inside")
    chosen = splits.select(*split, inside, end("state0").alias("open"), F.when(inside, F.col("n1")).otherwise(F.col("n0")).alias("n"))
    earlier = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("n") > 0, F.struct("_block", F.col("n").alias("_m"))), ignorenulls=True).over(earlier)
    chosen = chosen.select(*split, "inside", "open", "n", owner.alias("owner"))

    placed = with_states(marked, split, "_m").join(chosen.select(*split, "inside"), split)
    state = F.when(F.col("inside"), F.col("state1")).otherwise(F.col("state0"))
    numbered = placed.withColumn("_in", state).where(F.col("_in") | ~F.col("blank"))
    ascending = Window.partitionBy(*split).orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    numbered = numbered.withColumn("record", F.count_if(~F.col("_in")).over(ascending))

    def joined(order: str) -> Column:
        found = F.array_sort(F.collect_list(F.struct(order, "_line")))
        return F.array_join(F.transform(found, lambda x: x["_line"]), "\n").alias("_line")

    pieces = numbered.groupBy(*split, "record").agg(joined("_m")).join(chosen.select(*split, "open", "n", "owner"), split)
    border = (F.col("record") == 0) | (F.col("open") & (F.col("record") == F.col("n")))
    own = F.struct("_block", F.col("record").alias("_m"))
    at_border = pieces.where(border).select(
        "source", F.col("_block").alias("piece"), F.when(F.col("record") == 0, F.col("owner")).otherwise(own).alias("of"), "_line"
    )
    mended = at_border.groupBy("source", "of").agg(joined("piece")).select("source", "of._block", "of._m", "_line")
    return pieces.where(~border).select(*split, F.col("record").alias("_m"), "_line").unionByName(mended)
