"""Stochastic disaggregation of daily totals, with draws hashed from keys (see functions.randoms).

A sample is a key, so a bootstrap of any size is one plan. Daily totals carry bin_low (the
lower bin at edges); cdfs are long tables (bin_low, bin_high, cdf).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import searchsorted_bin
from ..functions.randoms import draw_index, exponential, uniform


def draw_in_bin(low: Column, high: Column, u: Column, mean: float = 5.0) -> Column:
    """Uniform in a finite bin, else the lower edge and an exponential excess."""
    return F.when(high == float("inf"), low + exponential(u, mean)).otherwise(low + u * (high - low))


def analog_library(df: DataFrame, keys: list[str], edges, k: int, ts: str = "ts", col: str = "value", wet: float = 1.0, threshold: float = 0.1) -> DataFrame:
    """Profiles of the wet blocks of k steps: bin_low, idx (from 0 within the bin) and n, total, steps."""
    from .timeagg import blocks

    b = blocks(df, keys, k, ts).groupBy(*keys, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("i"), F.col(col).alias("v")))), lambda s: s["v"]).alias("steps"), F.sum(col).alias("total"), F.count_if(F.col(col) > threshold).alias("n_wet"))
    b = b.where((F.col("total") >= wet) & (F.col("n_wet") > 0)).withColumn("bin_low", searchsorted_bin(F.col("total"), edges))
    w = Window.partitionBy("bin_low")
    return b.withColumns({"idx": F.row_number().over(w.orderBy(*keys, "block")) - 1, "n": F.count("*").over(w)})


def samples_of(days: DataFrame, n: int) -> DataFrame:
    """Every day in every sample."""
    return days.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def block_bootstrap(days: DataFrame, cells: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Double resampling: pixels with replacement, then each drawn pixel's wet days with replacement.

    days: cell, day_no (from 0 within the cell), total; cells: cell_no (from 0), cell, n_days. As many pixels are drawn as there are.
    """
    total = cells.agg(F.count("*").alias("__n"))
    draw = samples_of(cells.select(F.col("cell_no").alias("draw")), n).crossJoin(F.broadcast(total))  # total is one row
    draw = draw.withColumn("cell_no", draw_index(F.col("__n"), F.lit(seed), F.lit("pixel"), F.col("sample"), F.col("draw"))).drop("__n").join(cells, "cell_no").where("n_days > 0")
    day = draw.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_days") - 1)))
    day = day.withColumn("day_no", draw_index(F.col("n_days"), F.lit(seed), F.lit("day"), F.col("sample"), F.col("draw"), F.col("d")))
    return day.select("sample", "draw", "d", "cell", "day_no").join(days, ["cell", "day_no"])


def method_max(days: DataFrame, cdf: DataFrame, chance: DataFrame, edges, keys: list[Column], seed: int = 42, threshold: float = 0.1) -> DataFrame:
    """Largest step of each wet day drawn from its bin's distribution, clipped to [threshold, total].

    cdf: bin_low, bin_high, cdf; chance: bin_low, p_has_wet. keys identify a draw.
    """
    lo, hi = (F.array(*[F.lit(float(e)) for e in part]) for part in (edges[:-1], edges[1:]))
    d = days.join(chance, "bin_low").where(uniform(F.lit(seed), F.lit("wet"), *keys) < F.col("p_has_wet"))
    table = cdf.groupBy("bin_low").agg(F.array_sort(F.collect_list(F.struct("bin_high", "cdf"))).alias("table"))
    d = d.join(table, "bin_low").withColumn("u", uniform(F.lit(seed), F.lit("bin"), *keys))
    d = d.withColumn("bin_high", F.try_element_at(F.filter("table", lambda t: t["cdf"] >= F.col("u")), F.lit(1))["bin_high"])
    d = d.withColumn("bin_high", F.coalesce("bin_high", F.element_at("table", -1)["bin_high"]))
    v = draw_in_bin(F.get(lo, F.col("bin_high")), F.get(hi, F.col("bin_high")), uniform(F.lit(seed), F.lit("value"), *keys))
    return d.withColumn("largest", F.least(F.greatest(v, F.lit(threshold)), F.col("total"))).drop("table", "u")


def method_analog(days: DataFrame, library: DataFrame, chance: DataFrame | None, keys: list[Column], seed: int = 42) -> DataFrame:
    """Steps of each day: a drawn profile of its bin, scaled to the day's total.

    The draw needs only the number of profiles in the bin; the profile itself joins on (bin_low, idx).
    """
    n = library.groupBy("bin_low").agg(F.count("*").alias("n_analogs"))
    d = days.join(n, "bin_low")
    if chance is not None:
        d = d.join(chance.select("bin_low", "p_has_wet"), "bin_low").where(uniform(F.lit(seed), F.lit("wet"), *keys) < F.col("p_has_wet"))
    d = d.withColumn("idx", draw_index(F.col("n_analogs"), F.lit(seed), F.lit("analog"), *keys).cast("int"))
    d = d.join(library.select("bin_low", "idx", F.col("total").alias("analog_total"), F.col("steps").alias("analog")), ["bin_low", "idx"]).where("analog_total > 0")
    return d.withColumn("steps", F.transform("analog", lambda v: v * F.col("total") / F.col("analog_total"))).drop("analog")


def synthetic_quantiles(steps: DataFrame, keys: list[str], qs: list[float], threshold: float = 0.1) -> DataFrame:
    """Quantiles of wet steps and of wet daily maxima for each key (a sample): key, q, hourly, dmax."""
    a = F.array(*[F.lit(float(q)) for q in qs])
    m = steps.withColumn("__m", F.array_max("steps")).groupBy(*keys).agg(F.percentile(F.when(F.col("__m") > threshold, F.col("__m")), a).alias("m"))
    h = steps.select(*keys, F.explode("steps").alias("v")).where(F.col("v") > threshold).groupBy(*keys).agg(F.percentile("v", a).alias("h"))
    d = h.join(m, keys, "full_outer").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(qs) - 1))))
    return d.select(*keys, F.get(a, F.col("i")).alias("q"), F.get("h", F.col("i")).alias("hourly"), F.get("m", F.col("i")).alias("dmax"))


def confidence(samples: DataFrame, keys: list[str], value: str, bqs: list[float]) -> DataFrame:
    """Quantiles over samples, NULL ones left out: keys, bootstrap_q, value."""
    a = F.array(*[F.lit(float(b)) for b in bqs])
    d = samples.groupBy(*keys).agg(F.percentile(value, a).alias("p")).select(*keys, F.posexplode("p").alias("i", value))
    return d.select(*keys, F.get(a, F.col("i")).alias("bootstrap_q"), value)


def disaggregate(total: float, k: int, n_wet_cdf, value_cdf, max_cdf, edges, rng: np.random.Generator, threshold: float = 0.1, max_share: bool = True) -> np.ndarray:
    """k steps that add to a total: number of wet steps, the largest, and the rest drawn from their distributions, then shifted and scaled."""

    def draw(cdf):
        b = min(int(np.searchsorted(cdf, rng.random())), len(edges) - 2)
        return edges[b] + (rng.exponential(5.0) if edges[b + 1] == np.inf else rng.random() * (edges[b + 1] - edges[b]))

    out = np.zeros(k)
    n = max(1, min(k, int(np.searchsorted(n_wet_cdf, rng.random())) + 1, int(total / threshold) or 1))
    if n == 1:
        out[rng.integers(k)] = total
        return out
    v = np.array([draw(value_cdf) for _ in range(n)])
    if max_share and max_cdf is not None:
        top = float(np.clip(draw(max_cdf), total / n, total - threshold * (n - 1)))
        rest = np.maximum(np.sort(v)[: n - 1] - threshold, 1e-9)
        left = total - top - threshold * (n - 1)
        rest = threshold + (rest * left / rest.sum() if left > 0 else np.zeros(n - 1))
        v = np.concatenate(([top], np.minimum(rest, top)))
    v = v * total / v.sum()
    out[rng.choice(k, n, replace=False)] = v
    return out


def method_steps(days: DataFrame, distributions: DataFrame, edges, k: int, samples: int, seed: int = 123, threshold: float = 0.1, with_max: bool = True) -> DataFrame:
    """Sampled steps of each day of each cell and sample, seeded by cell and sample so that partitioning doesn't matter.

    days: cell, day_no, total, bin_low. distributions: bin_low, n_wet_cdf, value_cdf, max_cdf (arrays), p_has_wet.
    with_max: the largest step has a distribution of its own (three in all), else two and proportional scaling.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, sample = int(pdf["cell"].iloc[0]), int(pdf["sample"].iloc[0])
        rng = np.random.default_rng(seed + sample + cell * 10000)
        rows = []
        for r in pdf.sort_values("day_no").itertuples():
            if rng.random() < r.p_has_wet:
                rows.append((cell, sample, int(r.day_no), float(r.total), disaggregate(r.total, k, np.asarray(r.n_wet_cdf), np.asarray(r.value_cdf), np.asarray(r.max_cdf), edges, rng, threshold, with_max)))
        return pd.DataFrame(rows, columns=["cell", "sample", "day_no", "total", "steps"])

    d = samples_of(days, samples).join(distributions, "bin_low")
    return d.groupBy("cell", "sample").applyInPandas(run, "cell long, sample int, day_no long, total double, steps array<double>")


def bias(observed: DataFrame, synthetic: DataFrame, threshold: float = 0.1) -> DataFrame:
    """By kind: days, mass, mean wet steps, mean wet intensity and mean daily maximum of step arrays."""
    both = observed.select(F.lit("observed").alias("kind"), "steps", "total").union(synthetic.select(F.lit("synthetic").alias("kind"), "steps", "total"))
    wet = F.filter("steps", lambda v: v > threshold)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    d = both.select("kind", "total", F.size(wet).alias("n_wet"), add("steps").alias("mass"), add(wet).alias("wet_mass"), F.array_max("steps").alias("largest"))
    return d.groupBy("kind").agg(F.count("*").alias("days"), F.sum("mass").alias("mass"), F.max(F.abs(F.col("mass") - F.col("total"))).alias("mass_error"), F.avg("n_wet").alias("mean_n_wet"), F.try_divide(F.sum("wet_mass"), F.sum("n_wet")).alias("mean_intensity"), F.avg("largest").alias("mean_max"))
