"""End-to-end plans, each one lazy query over a cube (run, cell, y, x, ts, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BINS_HIGH, BINS_LOW_FINE, IFD_DURATION, IFD_INTENSITY
from ..functions.bins import hist_bin, searchsorted_bin
from ..operators import dist, events, filters, joins, stats, synthesis, timeagg


def percentile_change(cube: DataFrame, cell: list[str], qs: list[float], wet: float = 0.1, wet_day: float = 1.0) -> DataFrame:
    """Quantiles of wet steps on wet days in present and future, and their change: one shuffle by (cell, day), one aggregation, one pivot by aggregation."""
    d = filters.wet_only(filters.wet_day_rows(cube, ["run", *cell], threshold=wet_day), threshold=wet)
    q = dist.quantiles(d, ["run", *cell], qs)
    return joins.present_future(q, [*cell, "q"]).withColumns(stats.change(F.col("present"), F.col("future")))


def significance(cube: DataFrame, cell: list[str], qs: list[float], wet: float = 0.1, alpha: float = 0.05) -> DataFrame:
    """U tests of the values above each run's quantiles, with false-discovery control over the quantiles of a cell."""
    d = filters.wet_only(cube, threshold=wet)
    p = dist.quantiles(d, ["run", *cell], qs).withColumnRenamed("value", "__q")
    upper = d.join(p, ["run", *cell]).where(F.col("value") >= F.col("__q"))
    t = stats.mann_whitney(upper, [*cell, "q"])
    return stats.benjamini_hochberg(t, cell, alpha=alpha)


def intensity_frequency(cube: DataFrame, cell: list[str], threshold: float = 1.0) -> DataFrame:
    """Counts by event duration and total, summed over cells."""
    e = events.event_table(cube, ["run", *cell], threshold)
    h = dist.histogram2d(e, ["run", *cell], "duration", IFD_DURATION, "total", IFD_INTENSITY)
    return timeagg.spatial_sum(h, ["run", "bin_a", "bin_b"])


def blocks_with_bins(cube: DataFrame, cell: list[str], k: int = 24, wet: float = 0.1, low_edges=BINS_LOW_FINE, wet_day: float = 1.0) -> DataFrame:
    """Daily blocks with totals, wet steps and amounts, largest step, and the bin of the total; dry days go."""
    b = timeagg.blocks(cube, ["run", *cell], k)
    hit = F.col("value") >= wet
    d = b.groupBy("run", *cell, "block").agg(F.sum("value").alias("total"), F.max("value").alias("largest"), F.count_if(hit).alias("n_wet"), F.sum(F.when(hit, F.col("value")).otherwise(0.0)).alias("wet_total"))
    return d.where(F.col("total") >= wet_day).withColumn("bin_low", hist_bin(F.col("total"), low_edges))


def conditional_tables(cube: DataFrame, cell: list[str], k: int = 24, wet: float = 0.1, low_edges=BINS_LOW_FINE, high_edges=BINS_HIGH, wet_day: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P(step | total), P(wet steps | total), P(largest | total)."""
    day = blocks_with_bins(cube, cell, k, wet, low_edges, wet_day)
    steps = timeagg.blocks(cube, ["run", *cell], k).where(F.col("value") >= wet).join(day.select("run", *cell, "block", "bin_low"), ["run", *cell, "block"])
    keys = ["run", *cell]
    return (
        dist.conditional(steps.withColumn("bin_high", hist_bin(F.col("value"), high_edges)), keys, "bin_low", "bin_high"),
        dist.conditional(day.where("n_wet > 0"), keys, "bin_low", "n_wet"),
        dist.conditional(day.where("n_wet > 0").withColumn("bin_high", hist_bin(F.col("largest"), high_edges)), keys, "bin_low", "bin_high"),
    )


def synthetic_future(present: DataFrame, future_days: DataFrame, qs: list[float], samples: int, bqs: list[float], k: int = 24, edges=BINS_LOW_FINE, seed: int = 42) -> DataFrame:
    """Confidence bands of step and daily-maximum quantiles if future totals had the present's structure within days.

    present: cell, ts, value; future_days: cell, day_no, total (wet days).
    """
    library = synthesis.analog_library(present, ["cell"], edges, k)
    cells = future_days.groupBy("cell").agg(F.count("*").alias("n_days"))
    from pyspark.sql import Window

    cells = cells.withColumn("cell_no", F.row_number().over(Window.orderBy("cell")) - 1)  # one row for each cell of a neighbourhood
    drawn = synthesis.block_bootstrap(future_days, cells, samples, seed).withColumn("bin_low", searchsorted_bin(F.col("total"), edges))
    steps = synthesis.method_analog(drawn, library, None, [F.col("sample"), F.col("draw"), F.col("d")], seed)
    q = synthesis.synthetic_quantiles(steps, ["sample"], qs)
    h = synthesis.confidence(q, ["q"], "hourly", bqs)
    m = synthesis.confidence(q, ["q"], "dmax", bqs)
    return h.join(m, ["q", "bootstrap_q"])
