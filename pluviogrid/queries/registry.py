"""The registry, and the views of the test tables as the engine's data products.

`events` is a cube of 25 cells (5 by 5) over January 2024, the first half 'present', the rest
'future'; `hourly` is a regular series made of one kind of events, with its dry steps;
`daily` is a series of many years by return flag from `lineitem`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import densify
from ..shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_TYPES = {"i": "bigint", "d": "double", "s": "string", "t": "timestamp_ntz", "D": "date", "b": "boolean"}
_DUCK = {"i": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "t": "TIMESTAMP", "D": "DATE", "b": "BOOLEAN"}

CUBE = """cube AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'present' ELSE 'future' END AS run, user_id % 25 AS cell, (user_id % 25) // 5 AS y, user_id % 5 AS x, ts, CAST(round(value * 100) AS BIGINT) / 1000.0 AS value FROM events)"""
HOURLY = """obs AS (SELECT user_id % 25 AS cell, date_trunc('hour', ts)::TIMESTAMP AS ts, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS c FROM events WHERE event_type = 'purchase' GROUP BY ALL),
hourly AS (SELECT CASE WHEN h.ts < TIMESTAMP '2024-01-16' THEN 'present' ELSE 'future' END AS run, k.cell, k.cell // 5 AS y, k.cell % 5 AS x, h.ts, coalesce(obs.c, 0) / 1000.0 AS value
  FROM (SELECT unnest(range(25)) AS cell) k CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS ts) h LEFT JOIN obs ON obs.cell = k.cell AND obs.ts = h.ts)"""
DAILY = """daily AS (SELECT l_returnflag AS cell, l_shipdate AS ts, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)"""
GRID = """grid AS (SELECT c AS cell, c // 5 AS y, c % 5 AS x, 36 + 1.5 * (c // 5) AS lat, -2 + 1.5 * (c % 5) AS lon, (c // 5 + c % 5) % 2 AS landmask, c * 10.0 - 20 AS hgt FROM range(25) t(c))"""
SEASON = "CASE WHEN month(ts) IN (12, 1, 2) THEN 'DJF' WHEN month(ts) IN (3, 4, 5) THEN 'MAM' WHEN month(ts) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "present").otherwise("future")
    cell = F.col("user_id") % 25
    return table(spark, sf_dir, "events").select(run.alias("run"), cell.alias("cell"), F.floor(cell / 5).alias("y"), (cell % 5).alias("x"), "ts", (F.round(F.col("value") * 100).cast("long") / 1000.0).alias("value"))


def grid(spark: SparkSession) -> DataFrame:
    c = F.col("id")
    y, x = F.floor(c / 5), c % 5
    return spark.range(25).select(c.alias("cell"), y.alias("y"), x.alias("x"), (36 + 1.5 * y).alias("lat"), (-2 + 1.5 * x).alias("lon"), ((y + x) % 2).cast("tinyint").alias("landmask"), (c * 10.0 - 20).alias("hgt"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    obs = e.groupBy((F.col("user_id") % 25).alias("cell"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("c"))
    d = densify(obs, spark.range(25).select(F.col("id").alias("cell")), ["cell"], "2024-01-01 00:00:00", "2024-01-30 23:00:00")
    run = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "present").otherwise("future")
    return d.select(run.alias("run"), "cell", F.floor(F.col("cell") / 5).alias("y"), (F.col("cell") % 5).alias("x"), "ts", (F.coalesce("c", F.lit(0)) / 1000.0).alias("value"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("cell"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("value"))


def query(name: str, columns: str, sql: str | None = None):
    """Registers a function under a name. columns: name:type pairs, in which both sides are cast (doubles rounded to 6 places)."""
    cols = [c.split(":") for c in columns.split()]

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            d = f(spark, sf_dir)
            return d.select(*((F.round(F.col(c).cast("double"), 6) + 0.0 if t == "d" else F.col(c).cast(_TYPES[t])).alias(c) for c, t in cols))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = "SELECT " + ", ".join(f'round(CAST("{c}" AS DOUBLE), 6) + 0.0 AS "{c}"' if t == "d" else f'CAST("{c}" AS {_DUCK[t]}) AS "{c}"' for c, t in cols) + f" FROM ({sql}) AS answer"
        return f

    return put
