"""Completeness and quality of stored products, and set operations on their lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def expected_days(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def missing_days(present: DataFrame, first: str, last: str) -> DataFrame:
    """Days of a period without a row in present (day)."""
    return expected_days(present.sparkSession, first, last).join(present.select("day").distinct(), "day", "left_anti")


def diagnose_tiles(df: DataFrame, expected: int, run: str = "run", col: str = "value") -> DataFrame:
    """By tile: rows, NULLs and negatives of both runs side by side, and the first issue found."""
    g = df.groupBy("ty", "tx", run).agg(F.count("*").alias("n"), F.count_if(F.col(col).isNull()).alias("nulls"), F.count_if(F.col(col) < 0).alias("negative"))
    p, f = (g.where(F.col(run) == r).select("ty", "tx", *(F.col(c).alias(f"{c}_{s}") for c in ("n", "nulls", "negative"))) for r, s in (("present", "p"), ("future", "f")))
    d = p.join(f, ["ty", "tx"], "full_outer")
    issue = F.when(F.col("n_p").isNull(), "no present").when(F.col("n_f").isNull(), "no future").when(F.col("negative_p") + F.col("negative_f") > 0, "negative values").when((F.col("nulls_p") == F.col("n_p")) | (F.col("nulls_f") == F.col("n_f")), "all missing").when(F.col("n_p") != F.col("n_f"), "lengths differ").when(F.col("n_p") < expected, "incomplete").otherwise("ok")
    return d.withColumn("issue", issue)


def common_models(*lists: DataFrame) -> DataFrame:
    out = lists[0]
    for x in lists[1:]:
        out = out.intersect(x)
    return out


def except_models(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def stacked(**runs: DataFrame) -> DataFrame:
    """All tables under each other, by column names, with their name as run."""
    out = None
    for name, df in runs.items():
        df = df.withColumn("run", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
