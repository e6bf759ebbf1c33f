"""Filters, resampling, climatologies, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, timeagg, windows
from .registry import CUBE, DAILY, GRID, HOURLY, SEASON, cube, daily, grid, hourly, query, table


@query("p01_wet_strict", "run:s cell:i n:i total:d", f"WITH {CUBE} SELECT run, cell, count(*) AS n, sum(value) AS total FROM cube WHERE value > 1.0 GROUP BY run, cell")
def _(s, d):
    return filters.wet_only(cube(s, d), threshold=1.0).groupBy("run", "cell").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("p02_zero_below", "cell:i ts:t value:d", f"WITH {HOURLY} SELECT cell, ts, CASE WHEN value < 1 THEN 0 ELSE value END AS value FROM hourly")
def _(s, d):
    return filters.zero_below(hourly(s, d), threshold=1.0)


@query("p03_wet_day_rows", "cell:i ts:t value:d", f"WITH {HOURLY}, w AS (SELECT *, sum(value) OVER (PARTITION BY cell, ts::DATE) AS t FROM hourly) SELECT cell, ts, value FROM w WHERE t >= 5")
def _(s, d):
    return filters.wet_day_rows(hourly(s, d), ["cell"], threshold=5.0)


@query("p04_time_slice", "cell:i ts:t value:d", f"WITH {HOURLY} SELECT cell, ts, value FROM hourly WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08 14:00:00'")
def _(s, d):
    return filters.time_slice(hourly(s, d), "2024-01-05", "2024-01-08T13")


@query("p05_positional_slice", "run:s y:i x:i n:i", f"WITH {CUBE} SELECT run, y, x, count(*) AS n FROM cube WHERE y >= 1 AND y < 4 AND x >= 0 AND x < 2 GROUP BY ALL")
def _(s, d):
    return filters.positional_slice(cube(s, d), (1, 4), (0, 2)).groupBy("run", "y", "x").agg(F.count("*").alias("n"))


@query("p06_region_box", "y:i x:i total:d", f"WITH {CUBE}, {GRID} SELECT cube.y, cube.x, sum(value) AS total FROM cube JOIN grid USING (y, x) WHERE lat BETWEEN 37 AND 41 AND lon BETWEEN -1 AND 3 GROUP BY ALL")
def _(s, d):
    return filters.region(cube(s, d), grid(s), (37.0, -1.0, 41.0, 3.0)).groupBy("y", "x").agg(F.sum("value").alias("total"))


@query("p08_land_mask", "y:i x:i n:i", f"WITH {CUBE}, {GRID} SELECT cube.y, cube.x, count(*) AS n FROM cube JOIN grid USING (y, x) WHERE landmask = 1 GROUP BY ALL")
def _(s, d):
    return filters.land(cube(s, d), grid(s)).groupBy("y", "x").agg(F.count("*").alias("n"))


@query("p09_border_mask", "y:i x:i n:i", f"WITH {CUBE} SELECT y, x, count(*) AS n FROM cube WHERE y BETWEEN 1 AND 3 AND x BETWEEN 1 AND 3 GROUP BY ALL")
def _(s, d):
    return filters.inside_border(cube(s, d), 5, 5, 1).groupBy("y", "x").agg(F.count("*").alias("n"))


@query("p10_null_edge", "y:i x:i n:i", f"WITH {CUBE} SELECT y, x, count(CASE WHEN y BETWEEN 1 AND 3 AND x BETWEEN 1 AND 3 THEN value END) AS n FROM cube GROUP BY ALL")
def _(s, d):
    return filters.null_edge(cube(s, d), 5, 5, 1).groupBy("y", "x").agg(F.count("value").alias("n"))


@query("p11_steps_exceeding", "ts:t cell:i value:d", f"WITH {HOURLY} SELECT ts, cell, value FROM hourly WHERE ts IN (SELECT ts FROM hourly GROUP BY ts HAVING max(value) > 15)")
def _(s, d):
    return filters.steps_exceeding(hourly(s, d), 15.0)


@query("p12_season", "cell:s n:i", f"WITH {DAILY} SELECT cell, count(*) AS n FROM daily WHERE month(ts) IN (6, 7, 8) GROUP BY ALL")
def _(s, d):
    return filters.in_season(daily(s, d), "JJA").groupBy("cell").agg(F.count("*").alias("n"))


@query("p13_hours", "cell:i n:i", f"WITH {CUBE} SELECT cell, count(*) AS n FROM cube WHERE hour(ts) BETWEEN 6 AND 11 GROUP BY ALL")
def _(s, d):
    return filters.in_hours(cube(s, d), 6, 11).groupBy("cell").agg(F.count("*").alias("n"))


@query("p14_physical_range", "cell:i n:i kept:i", f"WITH {CUBE} SELECT cell, count(*) AS n, count(CASE WHEN value * 10 BETWEEN 0 AND 100 THEN 1 END) AS kept FROM cube GROUP BY ALL")
def _(s, d):
    return filters.physical_range(cube(s, d).withColumn("value", F.col("value") * 10), "hur").groupBy("cell").agg(F.count("*").alias("n"), F.count("value").alias("kept"))


@query("p16_mask_box", "y_first:i y_last:i x_first:i x_last:i", f"WITH {GRID} SELECT min(y) AS y_first, max(y) AS y_last, min(x) AS x_first, max(x) AS x_last FROM grid WHERE hgt > 45 AND landmask = 1")
def _(s, d):
    return filters.mask_box(grid(s).withColumn("mask", (F.col("hgt") > 45) & (F.col("landmask") == 1)))


@query("p17_mask_algebra", "cell:i mask:i", f"WITH {GRID} SELECT cell, CASE WHEN x = 0 THEN 2 WHEN landmask = 1 THEN 1 ELSE 0 END AS mask FROM grid")
def _(s, d):
    return filters.combine_masks(grid(s).withColumn("coast", (F.col("x") == 0).cast("int")))


@query("p18_polygon_mask", "cell:i inside:b", f"WITH {GRID} SELECT cell, lat > 36.5 AND lat < 41 AND lon > -1 AND lon < 2.2 AS inside FROM grid")
def _(s, d):
    return grid(s).withColumn("inside", filters.in_polygon(F.col("lat"), F.col("lon"), [(36.5, -1.0), (36.5, 2.2), (41.0, 2.2), (41.0, -1.0)]))


@query("p20_nearest_label", "cell:i q:d value:d", f"WITH {CUBE}, p AS (SELECT cell, unnest([0.1, 0.5, 0.9]) AS q, unnest(quantile_cont(value, [0.1, 0.5, 0.9])) AS value FROM cube GROUP BY cell) SELECT * FROM p WHERE q = 0.5")
def _(s, d):
    from ..operators.dist import quantiles

    return filters.nearest_label(quantiles(cube(s, d), ["cell"], [0.1, 0.5, 0.9]), ["cell"], "q", 0.52)


@query("p21_nearest_time", "cell:i ts:t value:d", f"WITH {HOURLY} SELECT cell, ts, value FROM hourly WHERE ts = TIMESTAMP '2024-01-10 12:00:00'")
def _(s, d):
    return filters.nearest_time(hourly(s, d), ["cell"], "2024-01-10 12:20:00")


@query("t01_hourly", "run:s cell:i ts:t value:d", f"WITH {CUBE} SELECT run, cell, date_trunc('hour', ts) AS ts, sum(value) AS value FROM cube GROUP BY ALL")
def _(s, d):
    return timeagg.resample(cube(s, d), ["run", "cell"], "hour")


@query("t02_daily_mean", "run:s cell:i ts:t value:d", f"WITH {CUBE} SELECT run, cell, date_trunc('day', ts) AS ts, avg(value) AS value FROM cube GROUP BY ALL")
def _(s, d):
    return timeagg.resample(cube(s, d), ["run", "cell"], "day", var="TAS")


@query("t03_monthly", "cell:s ts:t value:d", f"WITH {DAILY} SELECT cell, date_trunc('month', ts) AS ts, sum(value) AS value FROM daily GROUP BY ALL")
def _(s, d):
    return timeagg.resample(daily(s, d), ["cell"], "month")


@query("t04_multi_duration", "cell:i minutes:i ts:t value:d", f"WITH {CUBE}, m AS (SELECT *, unnest([10, 60, 180, 1440]) AS minutes FROM cube) SELECT cell, minutes, time_bucket(to_minutes(minutes::INT), ts, TIMESTAMP '2024-01-01') AS ts, sum(value) AS value FROM m GROUP BY ALL")
def _(s, d):
    return timeagg.multi_duration(cube(s, d), ["cell"], [10, 60, 180, 1440])


@query("t05_block_sum", "cell:i block:i ts:t total:d largest:d n_wet:i", f"WITH {HOURLY}, p AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY cell) AS n FROM hourly), b AS (SELECT *, i // 7 AS block FROM p WHERE (i // 7 + 1) * 7 <= n) SELECT cell, block, min(ts) AS ts, sum(value) AS total, max(value) AS largest, count(CASE WHEN value > 0.1 THEN 1 END) AS n_wet FROM b GROUP BY ALL")
def _(s, d):
    return timeagg.block_sum(hourly(s, d), ["cell"], 7)


@query("t06_coarsen", "cell:i block:i largest:d", f"WITH {HOURLY}, p AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY ts) - 1 AS i FROM hourly), b AS (SELECT cell, i // 6 AS j, sum(value) AS total FROM p GROUP BY ALL) SELECT cell, j // 28 AS block, max(total) AS largest FROM b WHERE (j // 28 + 1) * 28 <= 120 GROUP BY ALL")
def _(s, d):
    return timeagg.coarsen_sum_max(hourly(s, d), ["cell"], 6, 28)


@query("t09_annual_maximum", "cell:s year:i largest:d", f"WITH {DAILY} SELECT cell, year(ts) AS year, max(value) AS largest FROM daily GROUP BY ALL")
def _(s, d):
    return timeagg.annual_maximum(daily(s, d), ["cell"])


@query("t10_seasonal", "cell:s season:s mean:d largest:d", f"WITH {DAILY}, z AS (SELECT *, {SEASON} AS season FROM daily) SELECT cell, season, avg(value) AS mean, max(value) AS largest FROM z GROUP BY ALL UNION ALL SELECT cell, 'YEAR', avg(value), max(value) FROM z GROUP BY cell")
def _(s, d):
    return timeagg.seasonal(daily(s, d), ["cell"], with_year=True)


@query("t11_diurnal", "cell:i month:i hour:i mean:d", f"WITH {HOURLY} SELECT cell, month(ts) AS month, hour(ts) AS hour, avg(value) AS mean FROM hourly GROUP BY ALL")
def _(s, d):
    return timeagg.diurnal_cycle(hourly(s, d), ["cell"])


@query("t13_climatology", "cell:s month:i mean:d", f"WITH {DAILY} SELECT cell, month(ts) AS month, avg(value) AS mean FROM daily WHERE year(ts) BETWEEN 1999 AND 2001 GROUP BY ALL")
def _(s, d):
    return timeagg.monthly_climatology(daily(s, d), ["cell"], 1999, 2001)


@query("t14_mean_of_means", "cell:s stat:d", f"WITH {DAILY}, m AS (SELECT cell, date_trunc('month', ts) AS m, avg(value) AS v FROM daily GROUP BY ALL) SELECT cell, avg(v) AS stat FROM m GROUP BY cell")
def _(s, d):
    return timeagg.statistic_of_statistics(daily(s, d), ["cell"])


@query("t16_wet_count", "run:s cell:i n_wet:i total:d", f"WITH {HOURLY} SELECT run, cell, count(CASE WHEN value > 0.1 THEN 1 END) AS n_wet, sum(value) AS total FROM hourly GROUP BY ALL")
def _(s, d):
    return timeagg.wet_count(hourly(s, d), ["run", "cell"])


@query("t17_deaccumulate", "cell:i ts:t value:d", f"WITH {HOURLY}, w AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY ts) AS i FROM hourly) SELECT cell, ts, value FROM w WHERE i > 1")
def _(s, d):
    return timeagg.deaccumulate(windows.neighbours(hourly(s, d), ["cell"]).select("cell", "ts", F.round("running", 3).alias("value")), ["cell"])


@query("t18_fill_forward", "cell:i ts:t flag:b", f"WITH {HOURLY}, t AS (SELECT cell, ts::DATE AS day, sum(value) >= 5 AS flag FROM hourly GROUP BY ALL) SELECT hourly.cell, ts, flag FROM hourly JOIN t ON t.cell = hourly.cell AND t.day = ts::DATE")
def _(s, d):
    h = hourly(s, d)
    flag = timeagg.resample(h, ["cell"], "day").select("cell", "ts", (F.round("value", 6) >= 5).alias("flag"))
    return timeagg.fill_forward(h.join(flag, ["cell", "ts"], "left"), ["cell"])


@query("t19_hourly_maximum", "cell:i ts:t value:d", f"WITH {CUBE} SELECT cell, date_trunc('hour', ts) AS ts, max(value) AS value FROM cube GROUP BY ALL")
def _(s, d):
    return timeagg.resample(cube(s, d), ["cell"], "hour", how="max")


@query("t20_level_mean", "cell:i value:d", f"WITH {CUBE} SELECT cell, avg(value) AS value FROM (SELECT *, 100 * (1 + hour(ts)) AS lev FROM cube) WHERE lev BETWEEN 600 AND 900 GROUP BY cell")
def _(s, d):
    return timeagg.level_mean(cube(s, d).withColumn("lev", 100.0 * (1 + F.hour("ts"))), ["cell"], 900, 600)


@query("t21_ensemble", "cell:s mean:d n_models:i", "WITH m AS (SELECT c_mktsegment AS model, c_nationkey AS cell, avg(c_acctbal) AS value FROM customer GROUP BY ALL) SELECT cell, avg(value) AS mean, count(*) AS n_models FROM m GROUP BY cell")
def _(s, d):
    m = table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("model"), F.col("c_nationkey").alias("cell")).agg(F.avg("c_acctbal").alias("value"))
    return timeagg.ensemble_mean(m, ["cell"])


@query("t23_box_maximum", "ts:t largest:d", f"WITH {HOURLY} SELECT ts, max(value) AS largest FROM hourly WHERE y BETWEEN 1 AND 3 AND x BETWEEN 0 AND 2 GROUP BY ts")
def _(s, d):
    return timeagg.box_maximum(hourly(s, d), (2, 1), 1)


@query("t24_local_time", "cell:i ts:t value:d", f"WITH {HOURLY}, p AS (SELECT cell, ts, value, row_number() OVER (PARTITION BY cell ORDER BY ts) - 1 AS i FROM hourly), q AS (SELECT *, floor((-35 + 15 * (cell % 5) + 7.5) / 15)::BIGINT AS k FROM p) SELECT a.cell, b.ts, a.value FROM q a JOIN p b ON a.cell = b.cell AND b.i = ((a.i + a.k) % 720 + 720) % 720")
def _(s, d):
    return timeagg.local_solar_time(hourly(s, d).withColumn("lon", -35.0 + 15 * (F.col("cell") % 5)), ["cell"])


@query("t25_period_rates", "cell:i mean_amount:d max_amount:d", f"WITH {CUBE} SELECT cell, avg(value) * 86400 AS mean_amount, max(value) * 3600 AS max_amount FROM cube GROUP BY cell")
def _(s, d):
    return timeagg.period_rates(cube(s, d), ["cell"], 86400, 3600)


@query("t26_regional_maxima", "run:s max_of_max:d max_of_mean:d", f"WITH {CUBE}, c AS (SELECT run, cell, max(value) AS a, avg(value) AS b FROM cube GROUP BY ALL) SELECT run, max(a) AS max_of_max, max(b) AS max_of_mean FROM c GROUP BY run")
def _(s, d):
    return timeagg.regional_maxima(cube(s, d), ["run"], ["cell"])


@query("w01_top_k", "run:s cell:i rank:i ts:t value:d", f"WITH {CUBE}, r AS (SELECT *, row_number() OVER (PARTITION BY run, cell ORDER BY value DESC, ts) AS rank FROM cube) SELECT * FROM r WHERE rank <= 10")
def _(s, d):
    return windows.top_k(cube(s, d), ["run", "cell"], 10)


@query("w03_top_mean", "run:s cell:i mean:d n:i", f"WITH {CUBE}, r AS (SELECT *, row_number() OVER (PARTITION BY run, cell ORDER BY value DESC, ts) AS rank FROM cube) SELECT run, cell, avg(value) AS mean, count(*) AS n FROM r WHERE rank <= 20 GROUP BY ALL")
def _(s, d):
    return windows.top_mean(cube(s, d), ["run", "cell"], 20)


@query("w04_season_share", "cell:s season:s n:i share:d dominant:s", f"WITH {DAILY}, r AS (SELECT *, {SEASON} AS season, row_number() OVER (PARTITION BY cell ORDER BY value DESC, ts) AS rank FROM daily), g AS (SELECT cell, season, count(*) AS n FROM r WHERE rank <= 50 GROUP BY ALL) SELECT cell, season, n, n * 2.0 AS share, first_value(season) OVER (PARTITION BY cell ORDER BY n DESC, season) AS dominant FROM g")
def _(s, d):
    return windows.season_share(daily(s, d), ["cell"], 50)


@query("w05_neighbours", "cell:i ts:t before:d after:d running:d", f"WITH {HOURLY} SELECT cell, ts, lag(value) OVER w AS before, lead(value) OVER w AS after, sum(value) OVER (w ROWS UNBOUNDED PRECEDING) AS running FROM hourly WINDOW w AS (PARTITION BY cell ORDER BY ts)")
def _(s, d):
    return windows.neighbours(hourly(s, d), ["cell"])


@query("w07_rolling_sum", "cell:i ts:t rolled:d", f"WITH {HOURLY} SELECT cell, ts, CASE WHEN count(*) OVER w = 6 THEN sum(value) OVER w END AS rolled FROM hourly WINDOW w AS (PARTITION BY cell ORDER BY ts ROWS 5 PRECEDING)")
def _(s, d):
    return windows.rolling_sum(hourly(s, d), ["cell"], 6)


@query("w08_centred_mean", "cell:i ts:t smooth:d", f"WITH {HOURLY} SELECT cell, ts, CASE WHEN count(*) OVER w = 5 THEN avg(value) OVER w END AS smooth FROM hourly WINDOW w AS (PARTITION BY cell ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def _(s, d):
    return windows.centred_mean(hourly(s, d), ["cell"], 5, "ts")


@query("w09_average_rank", "cell:i value:d r:d", f"WITH {HOURLY} SELECT DISTINCT cell, value, rank() OVER (PARTITION BY cell ORDER BY value) + (count(*) OVER (PARTITION BY cell, value) - 1) / 2.0 AS r FROM hourly")
def _(s, d):
    return hourly(s, d).withColumn("r", windows.average_rank(["cell"], "value")).select("cell", "value", "r").distinct()


@query("w10_extreme_places", "run:s argmin:i argmax:i", f"WITH {CUBE}, c AS (SELECT run, cell, round(sum(value), 3) AS value FROM cube GROUP BY ALL) SELECT run, (list(cell ORDER BY value, cell))[1] AS argmin, (list(cell ORDER BY value DESC, cell))[1] AS argmax FROM c GROUP BY run")
def _(s, d):
    c = cube(s, d).groupBy("run", "cell").agg(F.round(F.sum("value"), 3).alias("value"))
    return windows.extreme_places(c, ["run"], "cell")


@query("w11_first_rows", "o_custkey:i o_orderkey:i o_orderdate:t", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey, o_orderdate FROM r WHERE n = 1")
def _(s, d):
    return windows.first_rows(table(s, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), "o_orderkey")


@query("w13_period_of_record", "cell:s sdate:t edate:t n:i", f"WITH {DAILY} SELECT cell, min(ts) AS sdate, max(ts) AS edate, count(*) AS n FROM daily GROUP BY cell")
def _(s, d):
    return windows.period_of_record(daily(s, d), ["cell"])


@query("w14_divergence", "ts:t y:i x:i divergence:d", f"WITH {HOURLY}, f AS (SELECT ts, y, x, value AS u, value * (1 + y) AS v FROM hourly), g AS (SELECT ts, y, x, lead(u) OVER (PARTITION BY ts, y ORDER BY x) - lag(u) OVER (PARTITION BY ts, y ORDER BY x) AS du, lead(v) OVER (PARTITION BY ts, x ORDER BY y) - lag(v) OVER (PARTITION BY ts, x ORDER BY y) AS dv FROM f) SELECT ts, y, x, du / 4 + dv / 4 AS divergence FROM g WHERE du IS NOT NULL AND dv IS NOT NULL")
def _(s, d):
    f = hourly(s, d).select("ts", "y", "x", F.col("value").alias("u"), (F.col("value") * (1 + F.col("y"))).alias("v"))
    return windows.divergence(f, ["ts"], dx=2.0, dy=2.0)
