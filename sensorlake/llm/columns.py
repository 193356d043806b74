"""Names for added columns that can't clash with a table's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, *names: str) -> list[Column]:
    """All columns of ``df`` but those of the given names."""
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
