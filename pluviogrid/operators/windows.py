"""Sorting, ranking and window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_dates import season


def top_k(df: DataFrame, keys: list[str], k: int = 100, col: str = "value", ts: str = "ts") -> DataFrame:
    """The k largest rows of each group with rank from 1; ties by time. Spark limits each partition's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(col), ts)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_mean(df: DataFrame, keys: list[str], k: int, col: str = "value", ts: str = "ts") -> DataFrame:
    return top_k(df, keys, k, col, ts).groupBy(*keys).agg(F.avg(col).alias("mean"), F.count("*").alias("n"))


def season_share(df: DataFrame, keys: list[str], k: int, col: str = "value", ts: str = "ts") -> DataFrame:
    """Of the k largest, per cent in each season, and the dominant season (ties by name)."""
    d = top_k(df, keys, k, col, ts).groupBy(*keys, season(F.col(ts)).alias("season")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    return d.withColumns({"share": F.col("n") * 100.0 / k, "dominant": F.min_by("season", F.struct(-F.col("n"), "season")).over(w)})


def rolling_sum(df: DataFrame, keys: list[str], n: int, ts: str = "ts", col: str = "value", out: str = "rolled") -> DataFrame:
    """Trailing sum over n rows; NULL before there are n."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-(n - 1), 0)
    return df.withColumn(out, F.when(F.count(col).over(w) == n, F.sum(col).over(w)))


def centred_mean(df: DataFrame, keys: list[str], n: int, order: str, col: str = "value", out: str = "smooth") -> DataFrame:
    """Centred mean over n (odd) rows; NULL at the ends."""
    h = n // 2
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-h, h)
    return df.withColumn(out, F.when(F.count(col).over(w) == n, F.avg(col).over(w)))


def neighbours(df: DataFrame, keys: list[str], ts: str = "ts", col: str = "value") -> DataFrame:
    """before, after and the running sum of each row."""
    w = Window.partitionBy(*keys).orderBy(ts)
    return df.withColumns({"before": F.lag(col).over(w), "after": F.lead(col).over(w), "running": F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, 0))})


def average_rank(keys: list[str | Column], col: str) -> Column:
    """Rank from 1 in which ties share their mean."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(col)) + (F.count("*").over(Window.partitionBy(*keys, col)) - 1) / 2.0


def first_rows(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in an order: duplicates dropped, or the newest version kept."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def period_of_record(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("sdate"), F.max(ts).alias("edate"), F.count("*").alias("n"))


def extreme_places(df: DataFrame, keys: list[str], place: str, col: str = "value") -> DataFrame:
    """Places of the smallest and largest value (the first of ties)."""
    return df.groupBy(*keys).agg(F.min_by(place, F.struct(col, place)).alias("argmin"), F.min_by(place, F.struct((-F.col(col)).alias("v"), F.col(place).alias("p"))).alias("argmax"))


def divergence(df: DataFrame, keys: list[str], u: str = "u", v: str = "v", dx: float = 2000.0, dy: float = 2000.0) -> DataFrame:
    """Centred du/dx + dv/dy of interior cells."""
    wx, wy = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    d = df.withColumns({"__du": F.lead(u).over(wx) - F.lag(u).over(wx), "__dv": F.lead(v).over(wy) - F.lag(v).over(wy)})
    return d.withColumn("divergence", F.col("__du") / (2 * dx) + F.col("__dv") / (2 * dy)).where("divergence is not null").drop("__du", "__dv")
