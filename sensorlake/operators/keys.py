"""Key-range subsets and row expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The signed 64-bit hash space.
MIN_TOKEN = -(2**63)
MAX_TOKEN = 2**63 - 1


def token(*keys) -> Column:
    """Deterministic 64-bit hash of the key columns (``xxhash64``)."""
    return F.xxhash64(*[F.col(k) if isinstance(k, str) else k for k in keys])


def token_range(keys, begin: int | None = None, end: int | None = None) -> Column:
    """Whether the hash of the keys is in ``[begin, end)`` (``end=None``: up to and including
    the top of the hash space)."""
    t = token(*([keys] if isinstance(keys, str) else list(keys)))
    cond = F.lit(True)
    if begin is not None:
        cond = cond & (t >= F.lit(begin))
    if end is not None:
        cond = cond & (t < F.lit(end))
    return cond


def hash_range(df: DataFrame, keys, begin: int | None = None, end: int | None = None) -> DataFrame:
    """Rows whose key hash is in a ``token_range``. Splits an export into disjoint jobs;
    row-local, no shuffle."""
    return df.where(token_range(keys, begin, end))


def token_splits(n: int) -> list[tuple[int, int | None]]:
    """``n`` contiguous ``[begin, end)`` ranges covering the hash space."""
    width = (MAX_TOKEN - MIN_TOKEN + 1) // n
    bounds = [MIN_TOKEN + i * width for i in range(n)]
    return [(bounds[i], bounds[i + 1] if i + 1 < n else None) for i in range(n)]


def with_expiry(df: DataFrame, ts: str = "timestamp", ttl_s=3600, name: str = "expires_at") -> DataFrame:
    """Add ``expires_at = ts + ttl`` seconds; a NULL ttl gives NULL (never expires).
    ``ttl_s`` is a number or a column."""
    ttl = F.col(ttl_s) if isinstance(ttl_s, str) else (ttl_s if isinstance(ttl_s, Column) else F.lit(ttl_s))
    return df.withColumn(name, F.col(ts) + F.make_dt_interval(secs=ttl.cast("decimal(18,6)")))


def unexpired(df: DataFrame, as_of, expires: str = "expires_at") -> DataFrame:
    """Rows still alive at ``as_of``: never expiring, or expiring after it."""
    at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return df.where(F.col(expires).isNull() | (F.col(expires) > at))
