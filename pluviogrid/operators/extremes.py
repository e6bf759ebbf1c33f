"""Extreme values: peaks over threshold, GPD and GEV fits, return levels, bootstrap bands.

Fits are small problems (one series of maxima or excesses), grouped by key and run with
NumPy; everything before and after them is a DataFrame expression.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.randoms import draw_index


def peaks_over_threshold(df: DataFrame, keys: list[str], ts: str = "ts", col: str = "value") -> DataFrame:
    """Excesses over the smallest annual maximum of each group: threshold u, excess, years and rate lam = exceedances / years."""
    u = df.groupBy(*keys, F.year(ts).alias("__y")).agg(F.max(col).alias("__m")).groupBy(*keys).agg(F.min("__m").alias("u"), F.count("*").alias("years"))
    d = df.join(u, keys).where(F.col(col) >= F.col("u"))
    return d.withColumns({"excess": F.col(col) - F.col("u"), "lam": F.count("*").over(Window.partitionBy(*keys)) / F.col("years")})


def gpd_return_level(u: Column, sigma: Column, xi: Column, lam: Column, years: float) -> Column:
    """u + sigma / xi ((lam T)^xi - 1), or its limit for xi = 0."""
    m = lam * years
    return F.when(F.abs(xi) < 1e-9, u + sigma * F.log(m)).otherwise(u + sigma / xi * (F.pow(m, xi) - 1))


def gev_return_level(mu: Column, sigma: Column, xi: Column, years: float, lam: float = 1.0) -> Column:
    """Quantile 1 - 1 / (lam T) of a GEV with shape xi (positive: heavy tail)."""
    y = -math.log(1 - 1 / (lam * years))
    return F.when(F.abs(xi) < 1e-9, mu - sigma * math.log(y)).otherwise(mu + sigma / xi * (F.pow(F.lit(y), -xi) - 1))


def l_moments(df: DataFrame, keys: list[str], col: str = "value") -> DataFrame:
    """First three sample L-moments by ranks."""
    w = Window.partitionBy(*keys)
    d = df.where(F.col(col).isNotNull()).withColumns({"__i": F.row_number().over(w.orderBy(col)), "__n": F.count("*").over(w)})
    i, n, x = F.col("__i").cast("double"), F.col("__n"), F.col(col)
    b = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("b0"), F.avg(x * F.try_divide(i - 1, n - 1)).alias("b1"), F.avg(x * F.try_divide((i - 1) * (i - 2), (n - 1) * (n - 2))).alias("b2"))
    return b.select(*keys, "n", F.col("b0").alias("l1"), (2 * F.col("b1") - F.col("b0")).alias("l2"), (6 * F.col("b2") - 6 * F.col("b1") + F.col("b0")).alias("l3"))


def _gamma(x: Column) -> Column:
    """Gamma function for 0.3 < x < 3 by Stirling's series shifted by 7 (relative error below 1e-10)."""
    z, shift = x + 7, F.lit(1.0)
    for k in range(7):
        shift = shift * (x + k)
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, 5.0))
    return F.exp((z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series) / shift


def gev_from_l_moments(moments: DataFrame, keys: list[str]) -> DataFrame:
    """GEV location, scale and shape by the usual approximation in the L-skewness."""
    c = 2 / (3 + F.col("l3") / F.col("l2")) - math.log(2) / math.log(3)
    d = moments.withColumn("__k", 7.8590 * c + 2.9554 * c * c)
    k = F.col("__k")
    g = _gamma(1 + k)
    sigma = F.col("l2") * k / ((1 - F.pow(F.lit(2.0), -k)) * g)
    return d.withColumn("sigma", sigma).select(*keys, (F.col("l1") - F.col("sigma") * (1 - g) / k).alias("mu"), "sigma", (-k).alias("xi"))


def _simplex(f, start: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Nelder and Mead's minimiser."""
    n = len(start)
    pts = [np.array(start, float)] + [np.array(start, float) + np.eye(n)[i] * (0.1 * abs(start[i]) + 0.05) for i in range(n)]
    vals = [f(p) for p in pts]
    for _ in range(rounds):
        order = np.argsort(vals)
        pts, vals = [pts[i] for i in order], [vals[i] for i in order]
        if abs(vals[-1] - vals[0]) < 1e-10 * (1 + abs(vals[0])):
            break
        mid = np.mean(pts[:-1], axis=0)
        r = mid + (mid - pts[-1])
        fr = f(r)
        if fr < vals[0]:
            e = mid + 2 * (mid - pts[-1])
            fe = f(e)
            pts[-1], vals[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < vals[-2]:
            pts[-1], vals[-1] = r, fr
        else:
            c = mid + 0.5 * ((r if fr < vals[-1] else pts[-1]) - mid)
            fc = f(c)
            if fc < min(fr, vals[-1]):
                pts[-1], vals[-1] = c, fc
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                vals = [vals[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(vals))]


def gpd_fit(x: np.ndarray) -> tuple[float, float]:
    """Maximum-likelihood (xi, sigma) of excesses by the profile likelihood in theta = xi / sigma."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x) & (x >= 0)]
    if len(x) < 3 or x.max() <= 0:
        return math.nan, math.nan

    def profile(theta):
        """Negative mean log-likelihood, and xi, at theta."""
        t = 1 + theta * x
        xi = np.log(t).mean()
        return (math.log(xi / theta) + xi + 1, xi) if t.min() > 0 and xi / theta > 0 else (math.inf, 0.0)

    top = 1 / x.max()
    grid = np.concatenate((-top * (1 - np.geomspace(1e-4, 0.999, 60)), top * np.geomspace(1e-3, 50, 90)))
    vals = [profile(t)[0] for t in grid]
    best = int(np.argmin(vals))
    order = np.argsort(grid)
    place = int(np.flatnonzero(order == best)[0])
    a, b = grid[order[max(0, place - 1)]], grid[order[min(len(grid) - 1, place + 1)]]
    for _ in range(100):
        c, d = a + 0.381966 * (b - a), b - 0.381966 * (b - a)
        if profile(c)[0] < profile(d)[0]:
            b = d
        else:
            a = c
    theta = (a + b) / 2
    xi = profile(theta)[1]
    exponential = math.log(x.mean()) + 1
    return (xi, xi / theta) if profile(theta)[0] < exponential - 1e-9 else (0.0, float(x.mean()))


def gev_fit(x: np.ndarray) -> tuple[float, float, float]:
    """Maximum-likelihood (mu, sigma, xi) of block maxima."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    if len(x) < 5 or x.std() == 0:
        return math.nan, math.nan, math.nan

    def loss(p):
        mu, sigma, xi = p[0], math.exp(min(50, p[1])), p[2]
        z = (x - mu) / sigma
        if abs(xi) < 1e-6:
            return len(x) * math.log(sigma) + float((z + np.exp(-np.minimum(z, 700) if z.min() > -700 else 700 + 0 * z)).sum())
        t = 1 + xi * z
        if t.min() <= 0 or abs(xi) > 2:
            return 1e12
        return len(x) * math.log(sigma) + float(((1 + 1 / xi) * np.log(t) + t ** (-1 / xi)).sum())

    s = x.std() * math.sqrt(6) / math.pi
    p = _simplex(loss, np.array([x.mean() - 0.5772 * s, math.log(s), 0.05]), 2000)
    return float(p[0]), float(math.exp(p[1])), float(p[2])


def fit_gpd(df: DataFrame, keys: list[str], col: str = "excess") -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        xi, sigma = gpd_fit(pdf[col].to_numpy())
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), len(pdf), xi, sigma]], columns=[*keys, "n", "xi", "sigma"])

    head = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, col).groupBy(*keys).applyInPandas(one, f"{head}, n long, xi double, sigma double")


def fit_gev(df: DataFrame, keys: list[str], col: str = "largest") -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), len(pdf), *gev_fit(pdf[col].to_numpy())]], columns=[*keys, "n", "mu", "sigma", "xi"])

    head = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, col).groupBy(*keys).applyInPandas(one, f"{head}, n long, mu double, sigma double, xi double")


def spatial_bootstrap(df: DataFrame, keys: list[str], cells: int, samples: int, seed: int = 42, ts: str = "ts", col: str = "value") -> DataFrame:
    """sample, ts, value: for each step of each sample the value of a cell drawn at random (cells are numbered 0 .. cells - 1 in column cell)."""
    steps = df.select(*keys, ts).distinct().withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    drawn = steps.withColumn("cell", draw_index(F.lit(cells), F.lit(seed), F.col("sample"), F.date_format(ts, "yyyyMMddHH")))
    return drawn.join(df.select(*keys, ts, F.col("cell").cast("long").alias("cell"), col), [*keys, ts, "cell"])


def gpd_bootstrap(df: DataFrame, keys: list[str], cells: int, samples: int = 1000, seed: int = 42, ts: str = "ts", col: str = "value") -> DataFrame:
    """sample, n, xi, sigma: for each spatial sample its own threshold and the fit of its excesses."""
    drawn = spatial_bootstrap(df, keys, cells, samples, seed, ts, col)
    return fit_gpd(peaks_over_threshold(drawn, [*keys, "sample"], ts, col), [*keys, "sample"])


def idf_bootstrap(maxima: DataFrame, keys: list[str], years: list[float], samples: int, seed: int = 42, col: str = "largest") -> DataFrame:
    """1, 50 and 99 per cent of return levels over GEV fits (L-moments) of maxima drawn with replacement."""
    w = Window.partitionBy(*keys)
    d = maxima.withColumns({"__i": F.row_number().over(w.orderBy(col)) - 1, "__n": F.count("*").over(w)})
    draws = d.select(*keys, "__n", F.col("__i").alias("__d")).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    draws = draws.withColumn("__i", draw_index(F.col("__n"), F.lit(seed), F.col("sample"), F.col("__d"))).join(d.select(*keys, "__i", col), [*keys, "__i"])
    fits = gev_from_l_moments(l_moments(draws, [*keys, "sample"], col).where("l2 > 0"), [*keys, "sample"])
    levels = fits.withColumn("r", F.explode(F.array(*[F.struct(F.lit(float(t)).alias("years"), gev_return_level(F.col("mu"), F.col("sigma"), F.col("xi"), t).alias("level")) for t in years])))
    p = levels.groupBy(*keys, "r.years").agg(F.percentile("r.level", F.array(*map(F.lit, (0.01, 0.5, 0.99)))).alias("p"))
    return p.select(*keys, "years", *(F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("low", "mid", "high"))))


def qq(df: DataFrame, keys: list[str], cdf_inverse, col: str = "value") -> DataFrame:
    """Empirical against theoretical quantiles at (i - 0.5) / n; cdf_inverse maps a Column of probabilities."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("p", (F.row_number().over(w.orderBy(col)) - 0.5) / F.count("*").over(w))
    return d.withColumn("theoretical", cdf_inverse(F.col("p")))


def kolmogorov_smirnov(df: DataFrame, keys: list[str], cdf, col: str = "value") -> DataFrame:
    """Largest distance of the empirical from a theoretical distribution function, and its asymptotic p-value."""
    w = Window.partitionBy(*keys)
    d = df.withColumns({"__i": F.row_number().over(w.orderBy(col)), "__n": F.count("*").over(w), "__f": cdf(F.col(col))})
    k = d.groupBy(*keys).agg(F.max(F.greatest(F.col("__i") / F.col("__n") - F.col("__f"), F.col("__f") - (F.col("__i") - 1) / F.col("__n"))).alias("d"), F.count("*").alias("n"))
    t = F.col("d") * (F.sqrt("n") + 0.12 + 0.11 / F.sqrt("n"))
    tail = F.lit(0.0)
    for j in range(1, 30):
        tail = tail + 2.0 * (-1) ** (j - 1) * F.exp(-2.0 * j * j * t * t)
    return k.withColumn("pvalue", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("d") < 1e-3, 1.0).otherwise(tail))))
