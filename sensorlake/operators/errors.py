"""Error counts with a capped sample per reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def error_summary(
    bad: DataFrame,
    reason: str = "reason",
    order: str = "offset",
    sample: str = "body",
    n_samples: int = 2,
) -> DataFrame:
    """Per reason (NULL is one): the error count, the first ``n_samples`` errors in
    ``order`` then ``sample`` (``sample_<i>_order`` and ``sample_<i>``; equal errors are
    samples of their own, a NULL order comes last), and how many more were suppressed.

    The counts are a partial aggregation. For the samples Spark keeps ``n_samples`` rows
    per task and reason before the shuffle, so a reason that holds most rows never gathers
    them in one task. Both are joined on the reason, a row for each."""
    src = bad.select(F.col(reason).alias("reason"), F.col(order).alias("_o"), F.col(sample).alias("_s"))
    counts = src.groupBy("reason").agg(F.count(F.lit(1)).alias("errors"))
    first = Window.partitionBy("reason").orderBy(F.col("_o").asc_nulls_last(), F.col("_s").asc_nulls_last())
    ranked = src.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n_samples)
    picked = []
    for i in range(1, n_samples + 1):
        mine = F.col("_r") == i
        picked += [
            F.max(F.when(mine, F.col("_o"))).alias(f"sample_{i}_order"),
            F.max(F.when(mine, F.col("_s"))).alias(f"sample_{i}"),
        ]
    samples = ranked.groupBy(F.col("reason").alias("_reason")).agg(*picked)
    joined = counts.join(samples, counts["reason"].eqNullSafe(samples["_reason"])).drop("_reason")
    suppressed = F.greatest(F.col("errors") - F.lit(n_samples), F.lit(0)).cast("long")
    return joined.withColumn("suppressed", suppressed)
