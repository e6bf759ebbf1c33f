"""Connected components by alternating large and small stars, on tables of links only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

TASK_ROWS = 50_000  # links that a task has at least, where there are so many


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of every node in links (u, v); nulls and loops are ignored.

    Each round shuffles the links four times and halves the depth of every tree at least
    logarithmically; hubs cost a minimum, which combines before the shuffle, and a join that
    adaptive execution splits. Rounds run in as many tasks as their links need and no more, since each task of
    a shuffle or a checkpoint leaves files of its own, however few its rows.
    """
    signature = [F.count("*"), F.bit_xor(F.xxhash64("u", "v"))]
    e = cut(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = tuple(e.agg(*signature).first())
    few = lambda d: d.coalesce(max(1, -(-last[0] // TASK_ROWS)))  # noqa: E731  a round makes no more rows of what it has
    e = few(e)
    for _ in range(most_rounds if last[0] else 0):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = few(few(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(few(few(small.union(low.select("u", F.col("m").alias("v")))).distinct()))
        now = tuple(e.agg(*signature).first())
        if now == last:
            break
        last = now
    else:
        if last[0]:
            raise RuntimeError("components have not settled")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
