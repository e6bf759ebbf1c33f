"""Distributions: histograms, conditional probabilities, quantiles, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import centers, hist_bin, searchsorted_bin, width_bin
from ..functions.randoms import draw_index
from .events import spells
from .windows import rolling_sum


def histogram(df: DataFrame, keys: list[str], edges, col: str = "value") -> DataFrame:
    """Counts by bin (see hist_bin) of each group; empty bins have no row."""
    return df.withColumn("bin", hist_bin(F.col(col), edges)).where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("cnt"))


def histogram2d(df: DataFrame, keys: list[str], a: str, a_edges, b: str, b_edges) -> DataFrame:
    d = df.withColumns({"bin_a": hist_bin(F.col(a), a_edges), "bin_b": hist_bin(F.col(b), b_edges)})
    return d.where("bin_a is not null and bin_b is not null").groupBy(*keys, "bin_a", "bin_b").agg(F.count("*").alias("cnt"))


def rolling_histograms(df: DataFrame, keys: list[str], durations: list[int], edges, threshold: float = 1.0, ts: str = "ts", col: str = "value", within_events: bool = False) -> DataFrame:
    """Histograms of trailing sums over each number of rows; with within_events only rows of events at least as long."""
    d = spells(df, keys, threshold, True, ts, col)
    d = d.withColumn("dur", F.count("*").over(Window.partitionBy(*keys, "event")))
    for n in durations:
        d = rolling_sum(d, keys, n, ts, col, f"__r{n}")
    d = d.withColumn("r", F.explode(F.array(*[F.struct(F.lit(n).alias("duration"), F.col(f"__r{n}").alias("rolled")) for n in durations])))
    d = d.select(*keys, "wet", "dur", "r.duration", "r.rolled").where(F.col("rolled") >= threshold)
    if within_events:
        d = d.where("wet and dur >= duration")
    return histogram(d, [*keys, "duration"], edges, "rolled")


def conditional(df: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """cnt and p of each (low, high) bin pair: p adds to 1 over high for each low."""
    c = df.where(F.col(low).isNotNull() & F.col(high).isNotNull()).groupBy(*keys, F.col(low).alias("bin_low"), F.col(high).alias("bin_high")).agg(F.count("*").alias("cnt"))
    return c.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*keys, "bin_low")))


def wet_chance(blocks: DataFrame, keys: list[str], low: str = "bin_low", n_wet: str = "n_wet") -> DataFrame:
    """Share of the periods in each low bin with a wet step at least."""
    return blocks.where(F.col(low).isNotNull()).groupBy(*keys, low).agg((F.count_if(F.col(n_wet) > 0) / F.count("*")).alias("p_has_wet"), F.count("*").alias("n_events"))


def neighbourhood(df: DataFrame, radius: int, ny: int, nx: int, edge: str = "clip") -> DataFrame:
    """Each row goes to every centre (cy, cx) within the radius: an explode of offsets, so that what follows is an equi-join or a grouping.

    edge 'clip': fewer neighbours at the border; 'replicate': cells outside count as their nearest inside, with weight.
    """
    r = F.sequence(F.lit(-radius), F.lit(radius))
    if edge == "clip":
        d = df.withColumn("__dy", F.explode(r)).withColumn("__dx", F.explode(r))
        d = d.withColumns({"cy": F.col("y") + F.col("__dy"), "cx": F.col("x") + F.col("__dx"), "weight": F.lit(1)})
        return d.where(F.col("cy").between(0, ny - 1) & F.col("cx").between(0, nx - 1)).drop("__dy", "__dx")

    def reach(c: str, n: int) -> Column:
        """Centres that see this row or column, with how many of their offsets are clamped to it."""
        near = F.sequence(F.greatest(F.lit(0), F.col(c) - radius), F.least(F.lit(n - 1), F.col(c) + radius))
        extra = lambda t: F.when(F.col(c) == 0, F.greatest(F.lit(0), radius - t)).otherwise(0) + F.when(F.col(c) == n - 1, F.greatest(F.lit(0), t + radius - (n - 1))).otherwise(0)
        return F.transform(near, lambda t: F.struct(t.alias("at"), (F.lit(1) + extra(t)).alias("w")))

    d = df.withColumn("__y", F.explode(reach("y", ny))).withColumn("__x", F.explode(reach("x", nx)))
    return d.withColumns({"cy": F.col("__y.at"), "cx": F.col("__x.at"), "weight": F.col("__y.w") * F.col("__x.w")}).drop("__y", "__x")


def pooled_conditional(counts: DataFrame, radius: int, ny: int, nx: int, keys: list[str] = [], edge: str = "clip") -> DataFrame:  # noqa: B006
    """Conditional probabilities pooled over neighbours, from each cell's counts: aggregated before they are exploded."""
    d = neighbourhood(counts, radius, ny, nx, edge).groupBy(*keys, "cy", "cx", "bin_low", "bin_high").agg(F.sum(F.col("cnt") * F.col("weight")).alias("cnt"))
    return d.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*keys, "cy", "cx", "bin_low")))


def pooled_density(pdf: DataFrame, radius: int, ny: int, nx: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Stored densities p weighted by their n_events over the neighbourhood, edges replicated."""
    d = neighbourhood(pdf, radius, ny, nx, "replicate")
    w = F.col("n_events") * F.col("weight")
    num = d.groupBy(*keys, "cy", "cx", "bin_low", "bin_high").agg(F.sum(F.col("p") * w).alias("num"))
    den = neighbourhood(pdf.select(*keys, "y", "x", "bin_low", "n_events").distinct(), radius, ny, nx, "replicate").groupBy(*keys, "cy", "cx", "bin_low").agg(F.sum(w).alias("den"))
    return num.join(den, [*keys, "cy", "cx", "bin_low"]).select(*keys, "cy", "cx", "bin_low", "bin_high", (F.col("num") / F.col("den")).alias("p"))


def cumulative(pdf: DataFrame, keys: list[str], bin_: str = "bin_high", p: str = "p") -> DataFrame:
    return pdf.withColumn("cdf", F.sum(p).over(Window.partitionBy(*keys).orderBy(bin_).rowsBetween(Window.unboundedPreceding, 0)))


def expectation(pdf: DataFrame, keys: list[str], edges, bin_: str = "bin_high", p: str = "p") -> DataFrame:
    """Sum of p times the bin's centre; an open bin's centre lies 5 above its edge."""
    mid = F.get(F.array(*[F.lit(c) for c in centers(list(edges))]), F.col(bin_))
    return pdf.groupBy(*keys).agg(F.sum(F.col(p) * mid).alias("expected"))


def binned_stats(blocks: DataFrame, keys: list[str], low: str = "bin_low") -> DataFrame:
    """Means by low bin: wet steps, wet intensity, largest step."""
    return blocks.where(F.col(low).isNotNull()).groupBy(*keys, low).agg(F.count("*").alias("n"), F.avg("n_wet").alias("mean_n_wet"), F.try_divide(F.sum("wet_total"), F.sum("n_wet")).alias("mean_intensity"), F.avg("largest").alias("mean_max"))


def mismatch(ratio: Column, low: float = 0.7, high: float = 1.3) -> Column:
    return (ratio < low) | (ratio > high)


def precipitation_pdf(df: DataFrame, keys: list[str], lo: float, hi: float, n: int, threshold: float, years: float, col: str = "value") -> DataFrame:
    """Frequency (per cent of values above the threshold) and amount a year in n equal bins."""
    d = df.where(F.col(col) > threshold).withColumn("bin", width_bin(F.col(col), lo, hi, n)).where("bin is not null")
    g = d.groupBy(*keys, "bin").agg(F.count("*").alias("cnt"), F.sum(col).alias("amount"))
    return g.withColumns({"pdf": F.col("cnt") * 100.0 / F.sum("cnt").over(Window.partitionBy(*keys)), "per_year": F.col("amount") / years}).drop("amount")


def quantiles(df: DataFrame, keys: list[str], qs: list[float], col: str = "value", exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """A row for each group and q (0 to 1): linear interpolation between order statistics, or an approximation that merges sketches."""
    array = F.array(*[F.lit(float(q)) for q in qs])
    p = F.percentile(col, array) if exact else F.percentile_approx(col, [float(q) for q in qs], accuracy)
    d = df.groupBy(*keys).agg(p.alias("__p"))
    return d.select(*keys, F.posexplode("__p").alias("__i", "value")).withColumn("q", F.get(array, F.col("__i"))).select(*keys, "q", "value")


def quantiles_by_bin(df: DataFrame, by: str, first: float, last: float, width: float, qs: list[float], col: str = "value") -> DataFrame:
    """Quantiles and counts in bins [first + i width, ...) of another column; outside rows go."""
    d = df.where((F.col(by) >= first) & (F.col(by) < last)).withColumn("bin", F.floor((F.col(by) - first) / width).cast("int"))
    n = d.groupBy("bin").agg(F.count("*").alias("n"))
    return quantiles(d, ["bin"], qs, col).join(n, "bin")


def exceedance_share(df: DataFrame, keys: list[str], q: float = 0.99, col: str = "value") -> DataFrame:
    """Per cent of the total in values above the quantile."""
    p = df.groupBy(*keys).agg(F.percentile(col, F.lit(q)).alias("__p"))
    return df.join(p, keys).groupBy(*keys).agg((100 * F.sum(F.when(F.col(col) > F.col("__p"), F.col(col)).otherwise(0.0)) / F.sum(col)).alias("share"))


def min_max(df: DataFrame, keys: list[str], col: str = "value") -> DataFrame:
    """Scaled to 0 .. 1 within each group."""
    lim = df.groupBy(*keys).agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    return df.join(lim, keys).withColumn("scaled", F.try_divide(F.col(col) - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def against_interval(obs: Column, low: Column, mid: Column, high: Column) -> dict[str, Column]:
    """Difference of an observation from a confidence interval's middle, its distances below and above, and whether it exceeds it."""
    return {"diff": obs - mid, "err_lo": mid - low, "err_hi": high - mid, "outside": F.when(obs > high, obs - high).when(obs < low, obs - low).otherwise(0.0), "above": obs > high}


def box_stats(df: DataFrame, keys: list[str], col: str = "value") -> DataFrame:
    """Whiskers at 10 and 90 per cent, quartiles and median."""
    p = df.groupBy(*keys).agg(F.percentile(col, F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("p"), F.count(col).alias("n"))
    return p.select(*keys, "n", *(F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("p10", "p25", "p50", "p75", "p90"))))


def gini(df: DataFrame, keys: list[str], col: str = "value") -> DataFrame:
    """Concentration over the non-null values of each group: 2 sum(i x_i) / (n sum x) - (n + 1) / n; 0 where all are 0."""
    d = df.where(F.col(col).isNotNull()).withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(col)))
    g = d.groupBy(*keys).agg(F.sum(F.col("__i") * F.col(col)).alias("__s"), F.sum(col).alias("total"), F.count("*").alias("n"))
    return g.withColumn("gini", F.when(F.col("total") == 0, 0.0).otherwise(2 * F.col("__s") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n"))).drop("__s")


def gini_by_bin(g: DataFrame, keys: list[str], edges) -> DataFrame:
    """Mean concentration and number of periods by the bin (lower at edges) of their total."""
    return g.withColumn("bin_low", searchsorted_bin(F.col("total"), edges)).groupBy(*keys, "bin_low").agg(F.avg("gini").alias("gini"), F.count("*").alias("n_events"))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    use = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * use), F.sum(use)).alias("mean"))


def bootstrap_mean(df: DataFrame, order: str, value: str, weight: str, samples: int, seed: int = 42) -> DataFrame:
    """2.5, 50 and 97.5 per cent of weighted means of rows drawn with replacement: draws join rows by number.

    order must be unique; rows are few (bins or cells of one product), draws are samples times rows.
    """
    numbered = df.select(order, value, weight).withColumn("idx", F.row_number().over(Window.orderBy(order)) - 1)
    n = numbered.agg(F.count("*").alias("n"))
    draws = numbered.select(F.col("idx").alias("draw")).crossJoin(F.broadcast(n)).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    draws = draws.withColumn("idx", draw_index(F.col("n"), F.lit(seed), F.col("sample"), F.col("draw")))
    means = weighted_mean(draws.join(numbered, "idx"), ["sample"], value, weight)
    p = means.agg(F.percentile("mean", F.array(*map(F.lit, (0.025, 0.5, 0.975)))).alias("p"))
    return p.select(*(F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("low", "mid", "high"))))


def within_day(df: DataFrame, keys: list[str], ts: str = "ts", col: str = "value") -> DataFrame:
    """Share of the day in each step, and of the largest step."""
    w = Window.partitionBy(*keys, F.to_date(ts))
    return df.withColumns({"fraction": F.try_divide(F.col(col), F.sum(col).over(w)), "peak_ratio": F.try_divide(F.max(col).over(w), F.sum(col).over(w))})


def hide_rare(df: DataFrame, keys: list[str], least: float = 0.001, cnt: str = "cnt") -> DataFrame:
    """Bins with more than a share of all events."""
    return df.withColumn("share", F.col(cnt) / F.sum(cnt).over(Window.partitionBy(*keys))).where(F.col("share") > least)
