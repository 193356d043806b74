"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a small table that one task takes; a table of links is rarely large.
ROWS_PER_TASK = 200_000
LEAST_TASKS = 6


def tasks_for(rows: int) -> int:
    """Tasks for a table of so many narrow rows. Shuffles of small tables by hundreds of
    tasks would leave hundreds of small files each."""
    return max(LEAST_TASKS, -(-rows // ROWS_PER_TASK))


def state_of(links: DataFrame) -> tuple:
    """The number of links (u, v) and two sums by which two tables of them are told apart."""
    h = F.xxhash64("u", "v")
    return tuple(links.agg(F.count("*"), F.bit_xor(h), F.sum(h % 1000003)).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``links`` (two columns of long); the component is
    its smallest node.

    Large-star hangs a node's larger neighbours on its least neighbour, small-star the smaller
    ones; after some rounds all links are (node, least node). Minima are aggregated before
    the shuffle, so a node of very many links is no burden; every round is checkpointed."""

    def lower(df: DataFrame) -> DataFrame:
        """Each link once, as (u, v) with v < u."""
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    links = lower(links.select(F.col(a).alias("u"), F.col(b).alias("v")))
    links = links.coalesce(tasks_for(links.count())).checkpoint()
    before = state_of(links)
    while True:
        tasks = tasks_for(before[0])
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
        large = links.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u")
        large = lower(large.select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)).coalesce(tasks).checkpoint()
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
        links = lower(hung.unionByName(least.select("u", F.col("m").alias("v")))).coalesce(tasks).checkpoint()
        state = state_of(links)
        if state == before:
            break
        before = state
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
