"""Time aggregation: resampling, blocks, climatologies. Totals add for RAIN, others average."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_dates import season


def rule(var: str, col: str) -> Column:
    return F.sum(col) if var == "RAIN" else F.avg(col)


def resample(df: DataFrame, keys: list[str], unit: str, var: str = "RAIN", how: str | None = None, ts: str = "ts", col: str = "value") -> DataFrame:
    """By 'hour', 'day' or 'month'; how: sum, avg, max or min instead of the variable's own rule."""
    agg = getattr(F, how)(col) if how else rule(var, col)
    return df.groupBy(*keys, F.date_trunc(unit, ts).cast("timestamp_ntz").alias(ts)).agg(agg.alias(col))


def multi_duration(df: DataFrame, keys: list[str], minutes: list[int], ts: str = "ts", col: str = "value") -> DataFrame:
    """Tumbling sums for several durations (dividing a day) in one pass: each row goes to one window of each."""
    start = F.expr(f"timestampdiff(MINUTE, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")
    d = df.withColumn("minutes", F.explode(F.array(*[F.lit(m) for m in minutes])))
    d = d.withColumn("__w", start - F.pmod(start, F.col("minutes")))
    out = d.groupBy(*keys, "minutes", "__w").agg(F.sum(col).alias(col))
    return out.withColumn(ts, F.expr("timestampadd(MINUTE, __w, TIMESTAMP_NTZ '1970-01-01 00:00:00')")).drop("__w")


def with_position(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """i: place of a row in its series, from 0; n: rows of the series."""
    w = Window.partitionBy(*keys)
    return df.withColumns({"i": F.row_number().over(w.orderBy(ts)) - 1, "n": F.count("*").over(w)})


def blocks(df: DataFrame, keys: list[str], k: int, ts: str = "ts") -> DataFrame:
    """block: number of each run of k rows; rows of a partial last block go."""
    d = with_position(df, keys, ts).withColumn("block", F.floor(F.col("i") / k).cast("long"))
    return d.where((F.col("block") + 1) * k <= F.col("n")).drop("n")


def block_sum(df: DataFrame, keys: list[str], k: int, ts: str = "ts", col: str = "value", wet: float = 0.1, inclusive: bool = False) -> DataFrame:
    """total, largest and wet steps of each block of k rows."""
    hit = F.col(col) >= wet if inclusive else F.col(col) > wet
    return blocks(df, keys, k, ts).groupBy(*keys, "block").agg(F.min(ts).alias(ts), F.sum(col).alias("total"), F.max(col).alias("largest"), F.count_if(hit).alias("n_wet"))


def coarsen_sum_max(df: DataFrame, keys: list[str], inner: int, outer: int, ts: str = "ts", col: str = "value") -> DataFrame:
    """Largest of the sums of `inner` rows in each run of `outer` sums; partial ones go."""
    sums = block_sum(df, keys, inner, ts, col).select(*keys, F.col("block").alias("i"), F.col("total"))
    n = Window.partitionBy(*keys)
    sums = sums.withColumn("n", F.count("*").over(n)).withColumn("block", F.floor(F.col("i") / outer).cast("long")).where((F.col("block") + 1) * outer <= F.col("n"))
    return sums.groupBy(*keys, "block").agg(F.max("total").alias("largest"))


def annual_maximum(df: DataFrame, keys: list[str], ts: str = "ts", col: str = "value") -> DataFrame:
    return df.groupBy(*keys, F.year(ts).alias("year")).agg(F.max(col).alias("largest"))


def seasonal(df: DataFrame, keys: list[str], ts: str = "ts", col: str = "value", with_year: bool = False) -> DataFrame:
    """Mean and maximum by season, and of all as 'YEAR' by grouping sets."""
    d = df.withColumn("season", season(F.col(ts)))
    aggs = [F.avg(col).alias("mean"), F.max(col).alias("largest")]
    if not with_year:
        return d.groupBy(*keys, "season").agg(*aggs)
    return d.groupingSets([[*map(F.col, keys), F.col("season")], [*map(F.col, keys)]], *map(F.col, keys), F.col("season")).agg(*aggs, F.grouping("season").alias("__all")).withColumn("season", F.when(F.col("__all") == 1, "YEAR").otherwise(F.col("season"))).drop("__all")


def diurnal_cycle(df: DataFrame, keys: list[str], ts: str = "ts", col: str = "value", by_month: bool = True) -> DataFrame:
    month = [F.month(ts).alias("month")] if by_month else []
    return df.groupBy(*keys, *month, F.hour(ts).alias("hour")).agg(F.avg(col).alias("mean"))


def monthly_climatology(df: DataFrame, keys: list[str], first: int, last: int, ts: str = "ts", col: str = "value") -> DataFrame:
    """Mean annual cycle of the years first to last."""
    return df.where(F.year(ts).between(first, last)).groupBy(*keys, F.month(ts).alias("month")).agg(F.avg(col).alias("mean"))


def statistic_of_statistics(df: DataFrame, keys: list[str], stat: str = "avg", ts: str = "ts", col: str = "value") -> DataFrame:
    """A statistic of each month and then the same of the months: a mean is the mean of monthly means."""
    f = getattr(F, stat)
    months = df.groupBy(*keys, F.date_trunc("month", ts).alias("__m")).agg(f(col).alias("__v"))
    return months.groupBy(*keys).agg(f("__v").alias("stat"))


def wet_count(df: DataFrame, keys: list[str], threshold: float = 0.1, col: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(F.col(col) > threshold).alias("n_wet"), F.sum(col).alias("total"))


def deaccumulate(df: DataFrame, keys: list[str], ts: str = "ts", col: str = "value") -> DataFrame:
    """Differences of running totals; the first row of a series goes."""
    return df.withColumn("__p", F.lag(col).over(Window.partitionBy(*keys).orderBy(ts))).where("__p is not null").withColumn(col, F.col(col) - F.col("__p")).drop("__p")


def fill_forward(df: DataFrame, keys: list[str], ts: str = "ts", col: str = "flag") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(col, F.last(col, ignorenulls=True).over(w))


def level_mean(df: DataFrame, keys: list[str], bottom: float, top: float, lev: str = "lev", col: str = "value") -> DataFrame:
    """Mean over the levels between two (both count, in either order)."""
    return df.where(F.col(lev).between(min(bottom, top), max(bottom, top))).groupBy(*keys).agg(F.avg(col).alias(col))


def ensemble_mean(df: DataFrame, keys: list[str], col: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(col).alias("mean"), F.count(col).alias("n_models"))


def spatial_sum(df: DataFrame, keys: list[str], col: str = "cnt") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(col).alias(col))


def box_maximum(df: DataFrame, center: tuple[int, int], radius: int, keys: tuple[str, ...] = ("ts",), col: str = "value") -> DataFrame:
    """Maximum over the cells around one, for each step."""
    y, x = center
    near = F.col("y").between(y - radius, y + radius) & F.col("x").between(x - radius, x + radius)
    return df.where(near).groupBy(*keys).agg(F.max(col).alias("largest"))


def local_solar_time(df: DataFrame, keys: list[str], lon: str = "lon", ts: str = "ts", col: str = "value") -> DataFrame:
    """Each series shifted by its longitude's whole hours (15 degrees each), wrapped at its ends."""
    d = with_position(df, keys, ts)
    shift = F.floor((F.col(lon) + 7.5) / 15)
    d = d.withColumn("__to", F.pmod(F.col("i") + shift, F.col("n")))
    times = d.select(*keys, F.col("i").alias("__to"), F.col(ts).alias("__ts"))
    return d.drop(ts, "i", "n").join(times, [*keys, "__to"]).withColumnRenamed("__ts", ts).drop("__to")


def period_rates(df: DataFrame, keys: list[str], mean_seconds: float, step_seconds: float, col: str = "value") -> DataFrame:
    """Mean of a rate over a period as an amount, and the largest step as an amount."""
    return df.groupBy(*keys).agg((F.avg(col) * mean_seconds).alias("mean_amount"), (F.max(col) * step_seconds).alias("max_amount"))


def regional_maxima(df: DataFrame, keys: list[str], cell: list[str], col: str = "value") -> DataFrame:
    """Over a region, the largest maximum and the largest temporal mean of its cells."""
    own = df.groupBy(*keys, *cell).agg(F.max(col).alias("a"), F.avg(col).alias("b"))
    return own.groupBy(*keys).agg(F.max("a").alias("max_of_max"), F.max("b").alias("max_of_mean"))
