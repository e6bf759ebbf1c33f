"""Projections, filters and predicates over long tables (one row for each cell and time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_dates import season


def is_wet(value: Column, threshold: float = 0.1, inclusive: bool = False) -> Column:
    return value >= threshold if inclusive else value > threshold


def wet_only(df: DataFrame, col: str = "value", threshold: float = 0.1, inclusive: bool = False) -> DataFrame:
    return df.where(is_wet(F.col(col), threshold, inclusive))


def zero_below(df: DataFrame, col: str = "value", threshold: float = 1.0) -> DataFrame:
    """Values under the threshold become 0; NULL stays."""
    return df.withColumn(col, F.when(F.col(col) < threshold, F.lit(0.0)).otherwise(F.col(col)))


def wet_day_rows(df: DataFrame, keys: list[str], ts: str = "ts", col: str = "value", threshold: float = 1.0) -> DataFrame:
    """Rows of days whose total reaches the threshold; one shuffle on (keys, day)."""
    day = F.to_date(ts)
    return df.withColumn("__day", F.sum(col).over(Window.partitionBy(*keys, day))).where(F.col("__day") >= threshold).drop("__day")


def time_slice(df: DataFrame, first: str, last: str, ts: str = "ts") -> DataFrame:
    """Both ends count; a partial date (2024, 2024-01, 2024-01-05, or with an hour) spans its whole unit."""
    units = {4: ("YEAR", "-01-01"), 7: ("MONTH", "-01"), 10: ("DAY", ""), 13: ("HOUR", ":00:00"), 16: ("MINUTE", ":00"), 19: ("SECOND", "")}
    at = lambda s: F.lit(s.replace("T", " ") + units[len(s)][1]).cast("timestamp_ntz")
    return df.where((F.col(ts) >= at(first)) & (F.col(ts) < F.timestamp_add(units[len(last)][0], F.lit(1), at(last))))


def positional_slice(df: DataFrame, y: tuple[int, int] | None = None, x: tuple[int, int] | None = None) -> DataFrame:
    """Index ranges, the end excluded."""
    for name, r in (("y", y), ("x", x)):
        if r:
            df = df.where((F.col(name) >= r[0]) & (F.col(name) < r[1]))
    return df


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """box: south, west, north, east; all edges count."""
    return lat.between(box[0], box[2]) & lon.between(box[1], box[3])


def region(df: DataFrame, grid: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows of the cells in a box of a two-dimensional grid."""
    return df.join(grid.where(in_box(F.col("lat"), F.col("lon"), box)).select("y", "x"), ["y", "x"], "left_semi")


def land(df: DataFrame, grid: DataFrame) -> DataFrame:
    return df.join(grid.where("landmask = 1").select("y", "x"), ["y", "x"], "left_semi")


def inside_border(df: DataFrame, ny: int, nx: int, n: int) -> DataFrame:
    """Without the n outer rows and columns."""
    return df.where(F.col("y").between(n, ny - 1 - n) & F.col("x").between(n, nx - 1 - n))


def null_edge(df: DataFrame, ny: int, nx: int, n: int, col: str = "value") -> DataFrame:
    """Values of the n outer rows and columns become NULL."""
    inner = F.col("y").between(n, ny - 1 - n) & F.col("x").between(n, nx - 1 - n)
    return df.withColumn(col, F.when(inner, F.col(col)))


def steps_exceeding(df: DataFrame, threshold: float, keys: tuple[str, ...] = ("ts",), col: str = "value") -> DataFrame:
    """Whole fields of the steps at which the spatial maximum exceeds the threshold."""
    steps = df.groupBy(*keys).agg(F.max(col).alias("__max")).where(F.col("__max") > threshold).select(*keys)
    return df.join(steps, list(keys), "left_semi")


def in_season(df: DataFrame, name: str, ts: str = "ts") -> DataFrame:
    return df if name == "YEAR" else df.where(season(F.col(ts)) == name)


def in_hours(df: DataFrame, first: int, last: int, ts: str = "ts") -> DataFrame:
    return df.where(F.hour(ts).between(first, last))


#: Accepted values: lower bound, inclusive?, upper bound, inclusive?
RANGES = {"hur": (0, True, 100, True), "ta": (0, True, 400, False), "ua": (-500, False, 500, False), "va": (-500, False, 500, False), "zg": (-1000, False, 60000, False)}


def physical_range(df: DataFrame, var: str, col: str = "value") -> DataFrame:
    """Values outside the range of the variable become NULL."""
    lo, lo_in, hi, hi_in = RANGES[var]
    c = F.col(col)
    return df.withColumn(col, F.when((c >= lo if lo_in else c > lo) & (c <= hi if hi_in else c < hi), c))


def mask_box(mask: DataFrame) -> DataFrame:
    """First and last row and column of the cells with a true mask."""
    return mask.where("mask").agg(*(f(c).alias(f"{c}_{n}") for c in ("y", "x") for f, n in ((F.min, "first"), (F.max, "last"))))


def combine_masks(df: DataFrame, coast: str = "coast", land: str = "landmask") -> DataFrame:
    """2 where on the coast, else 1 over land, else 0."""
    return df.withColumn("mask", F.when(F.col(coast) == 1, 2).when(F.col(land) == 1, 1).otherwise(0))


def in_polygon(lat: Column, lon: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule for a polygon of (lat, lon) corners; an expression, no UDF."""
    inside = F.lit(False)
    for (y1, x1), (y2, x2) in zip(polygon, polygon[1:] + polygon[:1]):
        if y1 != y2:
            crosses = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
            inside = inside != crosses
    return inside


def nearest_label(df: DataFrame, keys: list[str], label: str, target: float) -> DataFrame:
    """Rows of the label nearest to the target in each group (the lower of two equally near)."""
    best = df.groupBy(*keys).agg(F.min_by(label, F.struct(F.abs(F.col(label) - target), F.col(label))).alias(label))
    return df.join(best, [*keys, label], "left_semi")


def nearest_time(df: DataFrame, keys: list[str], at: str, ts: str = "ts") -> DataFrame:
    """Rows of the step nearest to an instant in each group (the earlier of two)."""
    gap = F.abs(F.timestamp_diff("MICROSECOND", F.lit(at).cast("timestamp_ntz"), F.col(ts)))
    best = df.groupBy(*keys).agg(F.min_by(ts, F.struct(gap, F.col(ts))).alias(ts))
    return df.join(best, [*keys, ts], "left_semi")
