"""Text helpers: boolean styles, identifier normalisation and replay-stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _style(style: str) -> tuple[str, str]:
    parts = [p.strip() for p in style.split(",")]
    if len(parts) != 2 or not all(parts):
        raise ValueError(f"boolean style must be 'true_text,false_text', got {style!r}")
    return parts[0], parts[1]


def parse_bool(c, style: str = "True,False") -> Column:
    """Text to boolean by a ``true,false`` style, case insensitive; NULL otherwise."""
    t, f = _style(style)
    s = F.lower(F.trim(_col(c)))
    return F.when(s == t.lower(), F.lit(True)).when(s == f.lower(), F.lit(False))


def format_bool(c, style: str = "True,False") -> Column:
    t, f = _style(style)
    c = _col(c)
    return F.when(c, F.lit(t)).when(~c, F.lit(f))


def norm_name(name: str) -> str:
    """Identifier normalisation: a double-quoted name keeps its case, a bare one is
    lower-cased (applied to column lists, driver-side, never per row)."""
    n = name.strip()
    if len(n) >= 2 and n[0] == '"' and n[-1] == '"':
        return n[1:-1].replace('""', '"')
    return n.lower()


def stable_uuid(*cols) -> Column:
    """UUID-shaped text (8-4-4-4-12) from the md5 of ``cols`` joined by ``|`` (a NULL is
    written as ``\\N``, so it is told apart from a column that isn't there).

    The same message (topic, partition, offset) always gets the same id, so a replayed
    micro-batch can be de-duplicated by ``id``.
    """
    h = F.md5(F.concat_ws("|", *[F.coalesce(_col(c).cast("string"), F.lit("\\N")) for c in cols]))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.substring(h, 13, 4),
        F.substring(h, 17, 4),
        F.substring(h, 21, 12),
    )
