"""Joins that align products: present with future, stations with cells, neighbourhoods, calendars."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS
from ..functions.physics import haversine, unit_xyz


def present_future(df: DataFrame, keys: list[str], col: str = "value", run: str = "run") -> DataFrame:
    """present and future side by side by one conditional aggregation (no join)."""
    return df.groupBy(*keys).agg(F.max(F.when(F.col(run) == "present", F.col(col))).alias("present"), F.max(F.when(F.col(run) == "future", F.col(col))).alias("future"))


def outer(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys, "full_outer")


def combine_first(a: DataFrame, b: DataFrame, keys: list[str], col: str = "value") -> DataFrame:
    """a's value where it has one, else b's."""
    return a.select(*keys, F.col(col).alias("__a")).join(b.select(*keys, F.col(col).alias("__b")), keys, "full_outer").select(*keys, F.coalesce("__a", "__b").alias(col))


def densify(df: DataFrame, series: DataFrame, keys: list[str], first: str, last: str, unit: str = "HOUR", ts: str = "ts") -> DataFrame:
    """A row for each series and step of a regular calendar; missing ones hold NULL."""
    f, n = F.lit(first).cast("timestamp_ntz"), F.timestamp_diff(unit, F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"))
    full = series.select(*keys).distinct().withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), n))).withColumn(ts, F.timestamp_add(unit, F.col("__i"), f)).drop("__i")
    return full.join(df, [*keys, ts], "left")


def _buckets(lat: Column, lon: Column, side: float, sphere: bool) -> list[Column]:
    """Bucket numbers of that side: in degrees, or of cubes around the unit sphere, which know neither poles nor a date line."""
    return [F.floor(c / side).cast("long") for c in (unit_xyz(lat, lon) if sphere else (lat, lon))]


def _around(axes: int, reach: int) -> Column:
    """All offsets of neighbouring buckets."""
    steps = range(-reach, reach + 1)
    return F.array(*(F.struct(*(F.lit(v).alias(f"d{i}") for i, v in enumerate(o))) for o in itertools.product(steps, repeat=axes)))


def nearest_cell(points: DataFrame, grid: DataFrame, names: list[str], sphere: bool = True, cell_degrees: float = 1.0, reach: int = 1) -> DataFrame:
    """The cell (y, x) nearest to each point, by great circles or in degrees; ties go to the first by (y, x).

    An equi-join on buckets of about cell_degrees finds cells within `reach` buckets. Such a
    search proves the nearest cell only up to `reach` bucket sides, so points whose best is
    farther (or that found none) are searched again in buckets four times as large, until none is left or the
    buckets hold everything. In degrees longitudes do not wrap. NULL coordinates and empty grids give NULL.
    """
    side, whole = (math.radians(cell_degrees), 2.0) if sphere else (cell_degrees, 720.0)
    axes = 3 if sphere else 2
    b = [f"__b{i}" for i in range(axes)]
    dist = (lambda a, o, c, e: haversine(a, o, c, e)) if sphere else (lambda a, o, c, e: F.sqrt(F.pow(a - c, 2) + F.pow(o - e, 2)))
    todo, out = points.select(*names, "lat", "lon"), None
    while True:
        g = grid.select("y", "x", F.col("lat").alias("__glat"), F.col("lon").alias("__glon"), *(c.alias(n) for c, n in zip(_buckets(F.col("lat"), F.col("lon"), side, sphere), b, strict=True)))
        p = todo.withColumn("__o", F.explode(_around(axes, reach)))
        p = p.withColumns({n: c + F.col(f"__o.d{i}") for i, (c, n) in enumerate(zip(_buckets(F.col("lat"), F.col("lon"), side, sphere), b, strict=True))})
        d = p.join(g, b, "left").withColumn("__d", F.round(dist(F.col("lat"), F.col("lon"), F.col("__glat"), F.col("__glon")), 6))
        best = d.groupBy(*names, "lat", "lon").agg(F.min(F.when(F.col("__d").isNotNull(), F.struct(F.col("__d"), F.col("y"), F.col("x")))).alias("b"))
        found = best.select(*names, "lat", "lon", F.col("b.y").alias("y"), F.col("b.x").alias("x"), F.col("b.__d").alias("distance"))
        proven = reach * side * (1 - 1e-9)
        proven = 2 * EARTH_RADIUS * math.asin(min(1.0, proven / 2)) if sphere else proven
        known = F.coalesce(F.col("distance") <= proven, F.lit(False)) | F.col("lat").isNull() | F.col("lon").isNull()
        rest = found.where(~known)
        if side >= whole or rest.isEmpty():
            return found if out is None else out.union(found)
        out = found.where(known) if out is None else out.union(found.where(known))
        todo, side = rest.select(*names, "lat", "lon"), side * 4


def within_distance(a: DataFrame, b: DataFrame, keys: list[str], metres: float) -> DataFrame:
    """Pairs of rows with equal keys whose (lat_a, lon_a) and (lat_b, lon_b) lie within a distance.

    Joined on cubes around the unit sphere as wide as the distance's chord, so that a row meets
    its 27 neighbouring cubes on either axis, at the poles and across the date line alike; then exactly.
    """
    side = max(2 * math.sin(min(math.pi, metres / EARTH_RADIUS) / 2) * (1 + 1e-9), 1e-9)
    n = [f"__b{i}" for i in range(3)]
    left = a.withColumn("__o", F.explode(_around(3, 1))).withColumns({k: c + F.col(f"__o.d{i}") for i, (c, k) in enumerate(zip(_buckets(F.col("lat_a"), F.col("lon_a"), side, True), n, strict=True))}).drop("__o")
    right = b.withColumns(dict(zip(n, _buckets(F.col("lat_b"), F.col("lon_b"), side, True), strict=True)))
    d = haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return left.join(right, [*keys, *n]).withColumn("distance", d).where(F.col("distance") <= metres).drop(*n)


def as_of_nearest(a: DataFrame, b: DataFrame, keys: list[str], names: list[str], offset_hours: int, tolerance_hours: int, ts: str = "ts") -> DataFrame:
    """For each row of a (named by names), b's row of the same keys nearest in time to ts + offset, the earlier of two; times count to the microsecond; joined on buckets of the tolerance."""
    micro = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    hour = 3_600_000_000
    width = tolerance_hours * hour
    left = a.withColumn("__t", micro(F.col(ts)) + F.lit(offset_hours * hour)).withColumn("__d", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn("__b", F.floor(F.col("__t") / width) + F.col("__d")).drop("__d")
    right = b.select(*keys, F.col(ts).alias("__bts"), micro(F.col(ts)).alias("__s"), F.col("value").alias("near_value")).withColumn("__b", F.floor(F.col("__s") / width))
    d = left.join(right, [*keys, "__b"]).withColumn("__gap", F.abs(F.col("__s") - F.col("__t"))).where(F.col("__gap") <= width)
    return d.groupBy(*keys, *names).agg(F.min(F.struct("__gap", "__bts", "near_value")).alias("m")).select(*keys, *names, F.col("m.__bts").alias("near_ts"), F.col("m.near_value").alias("near_value"))


def missing(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present, keys, "left_anti")


def tiles(spark: SparkSession, ny: int, nx: int, size: int) -> DataFrame:
    """All tiles of a grid, as (ty, tx)."""
    n = lambda k: -(-k // size)
    return spark.range(n(ny)).select(F.col("id").cast("int").alias("ty")).withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(n(nx) - 1))))


def with_tile(df: DataFrame, size: int, halo: int = 0) -> DataFrame:
    """The tile (ty, tx) of each cell; with a halo, rows near an edge go to the neighbours too (core tells which copy is at home)."""
    d = df.withColumns({"__y": F.floor(F.col("y") / size).cast("int"), "__x": F.floor(F.col("x") / size).cast("int")})
    if not halo:
        return d.withColumnsRenamed({"__y": "ty", "__x": "tx"})
    near = lambda c: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / size)).cast("int"), F.floor((F.col(c) + halo) / size).cast("int"))
    d = d.withColumn("ty", F.explode(near("y"))).withColumn("tx", F.explode(near("x")))
    return d.withColumn("core", (F.col("ty") == F.col("__y")) & (F.col("tx") == F.col("__x"))).drop("__y", "__x")


def by_reference(df: DataFrame, clusters: DataFrame, locations: DataFrame) -> DataFrame:
    """Rows of all cells in the cluster of each named location."""
    ids = locations.join(clusters, ["y", "x"]).select("name", "cluster_id")
    return df.join(clusters, ["y", "x"]).join(ids, "cluster_id")


def month_interpolation(df: DataFrame, monthly: DataFrame, keys: list[str], ts: str = "ts", col: str = "value") -> DataFrame:
    """value: linear in time between the mid-points of the months before and after, from a climatology by month."""
    first = F.date_trunc("month", ts).cast("timestamp_ntz")
    half = lambda m: F.timestamp_add("HOUR", F.date_diff(F.add_months(m, 1), m) * 12, m.cast("timestamp_ntz"))
    d = df.withColumn("__first", first.cast("date"))
    d = d.withColumn("__m0", F.when(F.col(ts) >= half(F.col("__first")), F.col("__first")).otherwise(F.add_months("__first", -1)))
    d = d.withColumn("__m1", F.add_months("__m0", 1)).withColumns({"__t0": half(F.col("__m0")), "__t1": half(F.col("__m1"))})
    w = F.timestamp_diff("SECOND", F.col("__t0"), F.col(ts)) / F.timestamp_diff("SECOND", F.col("__t0"), F.col("__t1"))
    a, b = (monthly.select(*keys, F.col("month").alias(f"__k{i}"), F.col(col).alias(f"__v{i}")) for i in (0, 1))
    d = d.withColumns({"__w": w, "__k0": F.month("__m0"), "__k1": F.month("__m1")}).join(a, [*keys, "__k0"]).join(b, [*keys, "__k1"])
    return d.withColumn(col, F.col("__v0") * (1 - F.col("__w")) + F.col("__v1") * F.col("__w")).select(*df.columns, col)


def first_order(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")
