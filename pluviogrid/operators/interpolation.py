"""Interpolation and regridding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bilinear(field: DataFrame, targets: DataFrame, keys: list[str], lat0: float, lon0: float, step: float, col: str = "value") -> DataFrame:
    """Values at targets (lat, lon) from a regular field (iy, ix); targets whose four corners are not all there go."""
    fy, fx = (F.col("lat") - lat0) / step, (F.col("lon") - lon0) / step
    t = targets.withColumns({"__y": F.floor(fy), "__x": F.floor(fx), "__wy": fy - F.floor(fy), "__wx": fx - F.floor(fx)})
    t = t.withColumn("c", F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (0, 1) for b in (0, 1)])))
    w = F.when(F.col("c.dy") == 1, F.col("__wy")).otherwise(1 - F.col("__wy")) * F.when(F.col("c.dx") == 1, F.col("__wx")).otherwise(1 - F.col("__wx"))
    t = t.withColumns({"iy": F.col("__y") + F.col("c.dy"), "ix": F.col("__x") + F.col("c.dx"), "__w": w})
    f = field.select(*keys, F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), F.col(col).alias("__v"))
    d = t.join(f, ["iy", "ix"], "left").where(F.col("__v").isNotNull() | (F.col("__w") == 0))
    return d.groupBy(*keys, *targets.columns).agg(F.sum(F.col("__w") * F.coalesce("__v", F.lit(0.0))).alias(col), F.sum("__w").alias("__all")).where("__all > 0.999999").drop("__all")


def vertical(profile: DataFrame, levels: DataFrame, keys: list[str], lev: str = "lev", col: str = "value", log: bool = False) -> DataFrame:
    """Linear interpolation of profiles (at least two levels) to the levels in `target`, the end segments extended; log: in the logarithm of the level."""
    x = (lambda c: F.log(c)) if log else (lambda c: c)
    w = Window.partitionBy(*keys).orderBy(lev)
    seg = profile.withColumns({"__x1": F.lead(lev).over(w), "__v1": F.lead(col).over(w), "__first": F.lag(lev).over(w).isNull()}).where("__x1 is not null")
    seg = seg.withColumn("__last", F.lead("__x1").over(w).isNull()).withColumnsRenamed({lev: "__x0", col: "__v0"})
    t = F.col("target")
    inside = ((t >= F.col("__x0")) | F.col("__first")) & ((t < F.col("__x1")) | F.col("__last"))
    d = seg.join(F.broadcast(levels.select("target").distinct()), inside)  # target levels are a short list
    share = (x(t) - x(F.col("__x0"))) / (x(F.col("__x1")) - x(F.col("__x0")))
    return d.select(*keys, "target", (F.col("__v0") + share * (F.col("__v1") - F.col("__v0"))).alias(col))


def climate_signal(df: DataFrame, keys: list[str], col: str = "mean", run: str = "run") -> DataFrame:
    """Future less present climatology by month, stamped as the first of each month of 1990."""
    v = lambda r: F.max(F.when(F.col(run) == r, F.col(col)))
    d = df.groupBy(*keys, "month").agg((v("future") - v("present")).alias("delta"))
    return d.withColumn("stamp", F.make_date(F.lit(1990), F.col("month"), F.lit(1)))


def apply_weights(field: DataFrame, weights: DataFrame, keys: list[str], col: str = "value") -> DataFrame:
    """Remapping by a table of weights (src, dst, w)."""
    return field.join(weights, "src").groupBy(*keys, "dst").agg(F.sum(F.col("w") * F.col(col)).alias(col))
