"""Change, significance and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.physics import normal_cdf
from .windows import average_rank


def change(present: Column, future: Column) -> dict[str, Column]:
    """Absolute change, and per cent where the present is above 0."""
    return {"change": future - present, "change_pct": F.when(present > 0, 100 * (future - present) / present)}


def mann_whitney(df: DataFrame, keys: list[str], col: str = "value", run: str = "run", least: int = 5, continuity: bool = False) -> DataFrame:
    """Two-sided U test of 'present' against 'future' by average ranks and the tie-corrected normal; NULL with fewer than `least` on a side.

    Without continuity correction the tail is the polynomial one and 0 beyond |z| = 6.
    """
    d = df.where(F.col(col).isNotNull()).withColumn("__r", average_rank(keys, col)).withColumn("__t", F.count("*").over(Window.partitionBy(*keys, col)))
    p = F.col(run) == "present"
    g = d.groupBy(*keys).agg(F.count_if(p).alias("n1"), F.count_if(~p).alias("n2"), F.sum(F.when(p, F.col("__r"))).alias("__r1"), F.sum((F.col("__t") * F.col("__t") - 1) / 12.0).alias("__ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.col("__r1") - n1 * (n1 + 1) / 2
    g = g.withColumn("u", F.least(u1, n1 * n2 - u1)).withColumn("__sd", F.sqrt(F.greatest(F.lit(0.0), n1 * n2 * (n + 1) / 12 - F.try_divide(n1 * n2 * F.col("__ties"), n * (n - 1)))))
    gap = F.abs(F.col("u") - n1 * n2 / 2)
    z = F.try_divide(F.greatest(F.lit(0.0), gap - 0.5) if continuity else gap, F.col("__sd"))
    tail = F.when(F.col("__sd") == 0, 1.0).when(F.lit(not continuity) & (z > 6), 0.0).otherwise(F.least(F.lit(1.0), 2 * (1 - normal_cdf(z))))
    ok = (F.col("n1") >= least) & (F.col("n2") >= least)
    return g.select(*keys, "n1", "n2", F.when(ok, F.col("u")).alias("u"), F.when(ok, tail).alias("pvalue"))


def exceedances(df: DataFrame, keys: list[str], q: float, col: str = "value", run: str = "run") -> DataFrame:
    """Values at or above their own run's quantile."""
    p = df.groupBy(*keys, run).agg(F.percentile(col, F.lit(q)).alias("__p"))
    return df.join(p, [*keys, run]).where(F.col(col) >= F.col("__p")).drop("__p")


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str = "pvalue", alpha: float = 0.05, order: str = "q") -> DataFrame:
    """sig_fdr: 1 for all tests of a group up to the last with p <= i / m * alpha; NULL tests count in none."""
    valid = df.where(F.col(p).isNotNull())
    w = Window.partitionBy(*keys)
    d = valid.withColumns({"__i": F.row_number().over(w.orderBy(p, order)), "__m": F.count("*").over(w)})
    d = d.withColumn("__k", F.max(F.when(F.col(p) <= F.col("__i") / F.col("__m") * alpha, F.col("__i"))).over(w))
    d = d.withColumn("sig_fdr", F.when(F.col("__i") <= F.coalesce("__k", F.lit(0)), 1).otherwise(0)).drop("__i", "__m", "__k")
    return d.unionByName(df.where(F.col(p).isNull()).withColumn("sig_fdr", F.lit(0)))


def significant_area(df: DataFrame, keys: list[str], sig: str = "sig_fdr", value: str = "change", coast: str | None = None) -> DataFrame:
    """Per cent of cells that are significant, by sign, and inland or coastal on request."""
    pct = lambda c: 100.0 * F.count_if(c) / F.count("*")
    s = F.coalesce(F.col(sig) == 1, F.lit(False))
    out = [pct(s).alias("pct_sig"), pct(s & (F.col(value) > 0)).alias("pct_up"), pct(s & (F.col(value) < 0)).alias("pct_down"), F.count("*").alias("n")]
    if coast:
        out += [F.try_divide(100.0 * F.count_if(s & (F.col(coast) == k)), F.count_if(F.col(coast) == k)).alias(f"pct_{n}") for k, n in ((0, "interior"), (1, "coastal"))]
    return df.groupBy(*keys).agg(*out)


def attribution(present: Column, synthetic: Column, future: Column, absolute: bool = False) -> dict[str, Column]:
    """Total change as what daily totals explain (synthetic - present) and the rest; fractions of the total (of its size, if absolute)."""
    total, daily, rest = future - present, synthetic - present, future - synthetic
    base = F.abs(total) if absolute else total
    return {"total": total, "daily": daily, "structural": rest, "daily_frac": F.try_divide(daily, base), "structural_frac": F.try_divide(rest, base), "total_pct": F.try_divide(100 * total, present), "daily_pct": F.try_divide(100 * daily, present), "structural_pct": F.try_divide(100 * rest, present)}


def classify(fraction: Column) -> Column:
    """Class of a daily fraction; '' for NULL."""
    f = fraction
    return F.when(f.isNull(), "").when((f < -0.2) | (f > 1.2), "amplifying").when((f > 0.2) & (f <= 0.8), "mixed").when((f >= -0.2) & (f <= 0.2), "structural").otherwise("daily")


def summary(df: DataFrame, keys: list[str], total: str = "total", daily: str = "daily", rest: str = "structural", fraction: str = "daily_frac") -> DataFrame:
    """Means, population variances, correlations (with more than 10 rows), and shares of cells; a NULL fraction counts as not dominated."""
    n = F.count(F.col(total) + F.col(daily) + F.col(rest))
    some = lambda c: F.when(n > 10, c)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in (total, daily, rest)), *(F.var_pop(c).alias(f"var_{c}") for c in (total, daily, rest)), some(F.corr(total, daily)).alias("corr_daily"), some(F.corr(total, rest)).alias("corr_structural"), share(F.col(fraction) > 0.8).alias("frac_daily"), share(F.col(fraction) < 0.2).alias("frac_structural"))


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """Chi-squared of a table of counts, with its degrees of freedom."""
    c = df.groupBy(row, column).agg(F.count("*").alias("o"))
    r, k = (df.groupBy(x).agg(F.count("*").alias(n)) for x, n in ((row, "nr"), (column, "nc")))
    t = df.agg(F.count("*").alias("n"))
    full = r.crossJoin(F.broadcast(k)).crossJoin(F.broadcast(t)).join(c, [row, column], "left")  # categories, not rows, are multiplied
    e = F.col("nr") * F.col("nc") / F.col("n")
    return full.agg(F.sum(F.pow(F.coalesce("o", F.lit(0)) - e, 2) / e).alias("chi2"), ((F.count_distinct(row) - 1) * (F.count_distinct(column) - 1)).alias("dof"))


def two_proportions(df: DataFrame, group: str, hit: Column, first: str, second: str) -> DataFrame:
    """z and two-sided p-value for equal shares of hits in two groups."""
    g = df.agg(*(F.count_if((F.col(group) == v) & h).alias(n) for v, s in ((first, "1"), (second, "2")) for h, n in ((hit, f"h{s}"), (F.lit(True), f"n{s}"))))
    p = (F.col("h1") + F.col("h2")) / (F.col("n1") + F.col("n2"))
    z = (F.col("h1") / F.col("n1") - F.col("h2") / F.col("n2")) / F.sqrt(p * (1 - p) * (1 / F.col("n1") + 1 / F.col("n2")))
    return g.withColumn("z", z).withColumn("pvalue", 2 * (1 - normal_cdf(F.abs("z"))))
