"""Further operators: variants of projections, joins, groupings, sources and draws."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.physics import relative_change
from ..functions.randoms import uniform as draw
from ..functions.text_dates import season
from ..operators import dist, events, extremes, filters, interpolation, joins, stats, synthesis, timeagg, windows
from ..plans import pipelines
from ..sources import tables
from .distributions import _CLIP, _COUNTS, BLOCK, _counts, hist, search, uniform
from .registry import CUBE, DAILY, GRID, HOURLY, SEASON, cube, daily, grid, hourly, query, table
from .spells import SPELL


@query("p07_axis_slice", "y:i x:i n:i", f"WITH {CUBE}, {GRID} SELECT cube.y, cube.x, count(*) AS n FROM cube JOIN grid USING (y, x) WHERE lat BETWEEN 37.5 AND 40.5 AND lon BETWEEN -0.5 AND 2.5 GROUP BY ALL")
def _(s, d):
    g = cube(s, d).join(grid(s).select("y", "x", "lat", "lon"), ["y", "x"])
    return g.where(filters.in_box(F.col("lat"), F.col("lon"), (37.5, -0.5, 40.5, 2.5))).groupBy("y", "x").agg(F.count("*").alias("n"))


@query("p15_stack_dropna", "loc:i n:i", f"WITH {HOURLY} SELECT y * 5 + x AS loc, count(CASE WHEN value > 0.5 THEN 1 END) AS n FROM hourly GROUP BY ALL")
def _(s, d):
    h = hourly(s, d).withColumn("loc", F.col("y") * 5 + F.col("x")).withColumn("value", F.when(filters.is_wet(F.col("value"), 0.5), F.col("value")))
    return h.groupBy("loc").agg(F.count("value").alias("n"))


@query("p19_rename", "south_north:i west_east:i Times:s PRNC:d XLAT:d XLONG:d", f'WITH {HOURLY}, {GRID} SELECT h.y AS south_north, h.x AS west_east, strftime(ts, \'%Y-%m-%d_%H:%M:%S\') AS "Times", value AS "PRNC", lat AS "XLAT", lon AS "XLONG" FROM hourly h JOIN grid USING (y, x)')
def _(s, d):
    return tables.for_maps(hourly(s, d).select("y", "x", "ts", "value"), grid(s), {"y": "south_north", "x": "west_east", "value": "PRNC", "lat": "XLAT", "lon": "XLONG"})


@query("t07_block_extremes", "cell:i block:i largest:d n_wet:i", f"WITH {HOURLY}, p AS (SELECT *, (row_number() OVER (PARTITION BY cell ORDER BY ts) - 1) // 24 AS block FROM hourly) SELECT cell, block, max(value) AS largest, count(CASE WHEN value >= 1 THEN 1 END) AS n_wet FROM p GROUP BY ALL")
def _(s, d):
    return timeagg.block_sum(hourly(s, d), ["cell"], 24, wet=1.0, inclusive=True)


@query("t12_diurnal_ensemble", "cell:i hour:i mean:d", f"WITH {HOURLY} SELECT cell, hour(ts) AS hour, avg(value) AS mean FROM hourly GROUP BY ALL")
def _(s, d):
    return timeagg.diurnal_cycle(hourly(s, d), ["cell"], by_month=False)


@query("t15_accumulated", "run:s y:i x:i total:d", f"WITH {CUBE} SELECT run, y, x, sum(value) AS total FROM cube GROUP BY ALL")
def _(s, d):
    return timeagg.spatial_sum(cube(s, d).withColumn("total", F.col("value")), ["run", "y", "x"], "total")


@query("t22_land_sum", "minutes:i bin:i cnt:i", f"WITH {CUBE}, {GRID}, m AS (SELECT cube.*, unnest([60, 1440]) AS minutes FROM cube JOIN grid USING (y, x) WHERE landmask = 1), r AS (SELECT cell, minutes, time_bucket(to_minutes(minutes::INT), ts, TIMESTAMP '2024-01-01') AS w, round(sum(value), 6) AS v FROM m GROUP BY ALL), z AS (SELECT minutes, {hist('v', C.IFD_INTENSITY)} AS bin FROM r) SELECT minutes, bin, count(*) AS cnt FROM z WHERE bin IS NOT NULL GROUP BY ALL")
def _(s, d):
    r = timeagg.multi_duration(filters.land(cube(s, d), grid(s)), ["cell"], [60, 1440]).withColumn("value", F.round("value", 6))
    return timeagg.spatial_sum(dist.histogram(r, ["cell", "minutes"], C.IFD_INTENSITY), ["minutes", "bin"])


@query("q03_wet_quantiles", "cell:i q:d value:d", f"WITH {HOURLY} SELECT cell, unnest([0.25, 0.75]) AS q, unnest(quantile_cont(value, [0.25, 0.75])) AS value FROM hourly WHERE value > 0.1 GROUP BY cell")
def _(s, d):
    return dist.quantiles(filters.wet_only(hourly(s, d)), ["cell"], [0.25, 0.75])


@query("q08_confidence", "cell:i bootstrap_q:d value:d", f"WITH {CUBE}, b AS (SELECT cell, hour(ts) AS sample, CASE WHEN count(*) > 1 THEN avg(value) END AS value FROM cube GROUP BY ALL) SELECT cell, unnest([0.025, 0.5, 0.975]) AS bootstrap_q, unnest(quantile_cont(value, [0.025, 0.5, 0.975])) AS value FROM b WHERE value IS NOT NULL GROUP BY cell")
def _(s, d):
    b = cube(s, d).groupBy("cell", F.hour("ts").alias("sample")).agg(F.when(F.count("*") > 1, F.avg("value")).alias("value"))
    return synthesis.confidence(b, ["cell"], "value", [0.025, 0.5, 0.975])


@query("q10_above_interval", "cell:i above:b", f"WITH {CUBE}, c AS (SELECT cell, quantile_cont(value, 0.9) AS o, quantile_cont(value, 0.85) + 2 AS h FROM cube GROUP BY cell) SELECT cell, o > h AS above FROM c")
def _(s, d):
    c = cube(s, d).groupBy("cell").agg(F.percentile("value", F.lit(0.9)).alias("o"), (F.percentile("value", F.lit(0.85)) + 2).alias("h"))
    return c.select("cell", dist.against_interval(F.col("o"), F.lit(0.0), F.lit(0.0), F.col("h"))["above"].alias("above"))


@query("q13_map_percentiles", "q:d value:d kind:s", f"WITH {CUBE}, c AS (SELECT cell, avg(value) - 5 AS value, cell % 2 = 0 AS sig FROM cube GROUP BY cell) SELECT unnest([0.05, 0.95]) AS q, unnest(quantile_cont(value, [0.05, 0.95])) AS value, 'all' AS kind FROM c UNION ALL SELECT unnest([0.05, 0.95]), unnest(quantile_cont(value, [0.05, 0.95])), 'significant' FROM c WHERE sig")
def _(s, d):
    c = cube(s, d).groupBy("cell").agg((F.avg("value") - 5).alias("value"))
    both = c.withColumn("kind", F.explode(F.when(F.col("cell") % 2 == 0, F.array(F.lit("all"), F.lit("significant"))).otherwise(F.array(F.lit("all")))))
    return dist.quantiles(both, ["kind"], [0.05, 0.95])


@query("j02_observed_synthetic", "cell:i observed:d synthetic:d", f"WITH {CUBE} SELECT cell, quantile_cont(CASE WHEN run = 'present' THEN value END, 0.5) AS observed, quantile_cont(CASE WHEN run = 'future' THEN value END, 0.5) AS synthetic FROM cube GROUP BY cell")
def _(s, d):
    q = dist.quantiles(cube(s, d), ["run", "cell"], [0.1, 0.5, 0.9])
    near = filters.nearest_label(q, ["run", "cell"], "q", 0.49)
    return joins.present_future(near, ["cell"]).select("cell", F.col("present").alias("observed"), F.col("future").alias("synthetic"))


@query("j04_daily_on_hours", "cell:i ts:t share:d", f"WITH {HOURLY} SELECT cell, ts, value / nullif(sum(value) OVER (PARTITION BY cell, ts::DATE), 0) AS share FROM hourly")
def _(s, d):
    return dist.within_day(hourly(s, d), ["cell"]).withColumn("share", F.col("fraction"))


@query("j05_mask_semi_join", "cell:i total:d", f"WITH {CUBE}, {GRID} SELECT cube.cell, sum(value) AS total FROM cube WHERE EXISTS (SELECT 1 FROM grid WHERE grid.y = cube.y AND grid.x = cube.x AND landmask = 1) GROUP BY ALL")
def _(s, d):
    return filters.land(cube(s, d), grid(s)).groupBy("cell").agg(F.sum("value").alias("total"))


@query("j07_event_on_rows", "cell:i ts:t total_all:d", f"WITH {SPELL} SELECT cell, ts, sum(value) OVER (PARTITION BY cell, event) AS total_all FROM s")
def _(s, d):
    return events.on_rows(hourly(s, d), ["cell"])


@query("j15_station_quantiles", "name:i q:d station:d model:d", f"WITH {CUBE}, p AS (SELECT cell, unnest([0.5, 0.9]) AS q, unnest(quantile_cont(value, [0.5, 0.9])) AS model FROM cube GROUP BY cell), st AS (SELECT s_suppkey AS name, s_suppkey % 25 AS cell, s_acctbal / 100 AS station FROM supplier) SELECT name, q, station, model FROM st JOIN p USING (cell)")
def _(s, d):
    st = table(s, d, "supplier").select(F.col("s_suppkey").alias("name"), (F.col("s_suppkey") % 25).alias("cell"), (F.col("s_acctbal") / 100).alias("station"))
    return st.join(dist.quantiles(cube(s, d), ["cell"], [0.5, 0.9]).withColumnRenamed("value", "model"), "cell")


@query("w02_top_durations", "cell:i rank:i total:d duration:i", f"WITH {SPELL}, e AS (SELECT cell, event, min(ts) AS start, count(*) AS duration, round(sum(value), 6) AS total FROM s WHERE wet GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY total DESC, start) AS rank FROM e) SELECT cell, rank, total, duration FROM r WHERE rank <= 3")
def _(s, d):
    return windows.top_k(events.event_table(hourly(s, d), ["cell"]).withColumn("total", F.round("total", 6)), ["cell"], 3, "total", "start")


@query("w12_newest_version", "p_brand:s p_type:s p_partkey:i", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey DESC) AS n FROM part) SELECT p_brand, p_type, p_partkey FROM r WHERE n = 1")
def _(s, d):
    return windows.first_rows(table(s, d, "part"), ["p_brand", "p_type"], F.desc("p_size"), F.desc("p_partkey"))


@query("a01_partial_aggregation", "y:i x:i n_wet:i total:d", f"WITH {HOURLY} SELECT y, x, count(CASE WHEN value > 0.1 THEN 1 END) AS n_wet, sum(value) AS total FROM hourly GROUP BY ALL")
def _(s, d):
    files = timeagg.wet_count(hourly(s, d), ["y", "x", F.to_date("ts")])
    return files.groupBy("y", "x").agg(F.sum("n_wet").alias("n_wet"), F.sum("total").alias("total"))


@query("a04_fraction_of_cells", "hour:i fraction:d", f"WITH {CUBE}, c AS (SELECT hour(ts) AS hour, cell, CASE WHEN count(*) > 1 THEN avg(value) END AS v FROM cube GROUP BY ALL) SELECT hour, avg(coalesce(v > 4, FALSE)::INT) AS fraction FROM c GROUP BY hour")
def _(s, d):
    c = cube(s, d).groupBy(F.hour("ts").alias("hour"), "cell").agg(F.when(F.count("*") > 1, F.avg("value")).alias("v"))
    return c.groupBy("hour").agg(F.avg(F.coalesce(F.col("v") > 4, F.lit(False)).cast("double")).alias("fraction"))


@query("a05_two_levels", "hours:i sessions:i days:i total:d", f"WITH {SPELL}, k AS (SELECT cell, ts::DATE AS day, count(*) AS hours, count(DISTINCT event) AS sessions, sum(value) AS t FROM s WHERE wet GROUP BY ALL) SELECT hours, sessions, count(*) AS days, sum(t) AS total FROM k GROUP BY ALL")
def _(s, d):
    return events.sessions(hourly(s, d), ["cell"]).groupBy("hours", "sessions").agg(F.count("*").alias("days"), F.sum("total").alias("total"))


@query("a09_rollup", "run:s cell:i total:d", f"WITH {CUBE} SELECT run, cell, sum(value) AS total FROM cube GROUP BY ROLLUP (run, cell)")
def _(s, d):
    return cube(s, d).rollup("run", "cell").agg(F.sum("value").alias("total"))


@query("a10_season_sets", "season:s n:i mean:d", f"WITH {DAILY}, z AS (SELECT *, {SEASON} AS season FROM daily) SELECT season, count(*) AS n, avg(value) AS mean FROM z GROUP BY GROUPING SETS ((season), ())")
def _(s, d):
    z = daily(s, d).withColumn("season", season(F.col("ts")))
    return z.groupingSets([[F.col("season")], []], F.col("season")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@query("s01_percentile_change", "cell:i present:d future:d change:d change_pct:d", f"WITH {CUBE}, c AS (SELECT cell, quantile_cont(CASE WHEN run = 'present' THEN value END, 0.9) AS present, quantile_cont(CASE WHEN run = 'future' THEN value END, 0.9) AS future FROM cube GROUP BY cell) SELECT *, future - present AS change, CASE WHEN present > 0 THEN 100 * (future - present) / present END AS change_pct FROM c")
def _(s, d):
    p = joins.present_future(dist.quantiles(cube(s, d), ["run", "cell"], [0.9]), ["cell"])
    return p.withColumns(stats.change(F.col("present"), F.col("future")))


@query("s07_absolute_attribution", "cell:i daily_frac:d structural_frac:d", f"WITH {CUBE}, c AS (SELECT cell, avg(CASE WHEN run = 'present' THEN value END) AS p, avg(CASE WHEN run = 'future' THEN value END) AS f, avg(value) AS s FROM cube GROUP BY cell) SELECT cell, (s - p) / nullif(abs(f - p), 0) AS daily_frac, (f - s) / nullif(abs(f - p), 0) AS structural_frac FROM c")
def _(s, d):
    c = cube(s, d).groupBy("cell").agg(F.avg(F.when(F.col("run") == "present", F.col("value"))).alias("p"), F.avg(F.when(F.col("run") == "future", F.col("value"))).alias("f"), F.avg("value").alias("s"))
    return c.withColumns(stats.attribution(F.col("p"), F.col("s"), F.col("f"), absolute=True))


@query("s17_gev_return_levels", "cell:s years:i level:d", f"WITH {DAILY}, m AS (SELECT cell, avg(value) AS mu, stddev_samp(value) AS sd FROM daily GROUP BY cell), y AS (SELECT unnest([2, 10, 100]) AS years) SELECT cell, years, mu + sd / 0.1 * (pow(-ln(1 - 1.0 / years), -0.1) - 1) AS level FROM m, y")
def _(s, d):
    m = daily(s, d).groupBy("cell").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    level = lambda t: F.struct(F.lit(t).alias("years"), extremes.gev_return_level(F.col("mu"), F.col("sd"), F.lit(0.1), t).alias("level"))
    return m.withColumn("r", F.explode(F.array(*[level(t) for t in (2, 10, 100)]))).select("cell", "r.years", "r.level")


@query("b01_bin_draw", "k:i value:d", f"WITH z AS (SELECT o_orderkey AS k, {uniform(chr(39) + 'draw' + chr(39), 'o_orderkey::VARCHAR')} AS u, o_orderkey % 4 AS b FROM orders) SELECT k, CASE b WHEN 0 THEN 0 + u * 0.5 WHEN 1 THEN 0.5 + u * 1.5 WHEN 2 THEN 2 + u * 8 ELSE 10 - 5 * ln(1 - u) END AS value FROM z")
def _(s, d):
    lo, hi = F.array(*map(F.lit, (0.0, 0.5, 2.0, 10.0))), F.array(*map(F.lit, (0.5, 2.0, 10.0, float("inf"))))
    b = (F.col("o_orderkey") % 4).cast("int")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"), synthesis.draw_in_bin(F.get(lo, b), F.get(hi, b), draw(F.lit("draw"), F.col("o_orderkey"))).alias("value"))


_HALF = f"""{HOURLY}, p AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY ts) - 1 AS i FROM hourly), w AS (SELECT cell, i // 6 AS block, round(sum(value), 6) AS total, list(value ORDER BY ts) AS steps, count(CASE WHEN value > 0.1 THEN 1 END) AS n_wet FROM p GROUP BY ALL), l0 AS (SELECT *, {search("total", C.BINS_LOW_COARSE)} AS bin_low FROM w WHERE total >= 0.1 AND n_wet > 0),
lib AS (SELECT *, row_number() OVER (PARTITION BY bin_low ORDER BY cell, block) - 1 AS idx, count(*) OVER (PARTITION BY bin_low) AS n FROM l0)"""


@query("b08_short_analogs", "cell:i block:i idx:i peak_rate:d", f"WITH {_HALF}, q AS (SELECT cell, block, bin_low, total * 2 AS total, floor({uniform(chr(39) + '7' + chr(39), chr(39) + 'analog' + chr(39), 'cell::VARCHAR', 'block::VARCHAR')} * n)::BIGINT AS idx FROM lib) SELECT q.cell, q.block, q.idx, 6 * list_max(l.steps) * q.total / l.total AS peak_rate FROM q JOIN lib l ON l.bin_low = q.bin_low AND l.idx = q.idx")
def _(s, d):
    from ..functions.bins import searchsorted_bin

    lib = synthesis.analog_library(hourly(s, d), ["cell"], C.BINS_LOW_COARSE, 6, wet=0.1).withColumn("total", F.round("total", 6)).drop("idx", "n")
    w = Window.partitionBy("bin_low")
    lib = lib.withColumn("bin_low", searchsorted_bin(F.col("total"), C.BINS_LOW_COARSE)).withColumns({"idx": F.row_number().over(w.orderBy("cell", "block")) - 1, "n": F.count("*").over(w)})
    m = synthesis.method_analog(lib.select("cell", "block", "bin_low", (F.col("total") * 2).alias("total")), lib, None, [F.col("cell"), F.col("block")], 7)
    return m.withColumn("peak_rate", 6 * F.array_max("steps"))


@query("b14_samples_by_buffer", "buffer:i sample:i days:i", f"WITH {HOURLY}, w AS (SELECT cell, y, x, ts::DATE AS day, round(sum(value), 6) AS total FROM hourly GROUP BY ALL), dy AS (SELECT * FROM w WHERE total >= 1), b AS (SELECT unnest([0, 1, 2]) AS buffer), k AS (SELECT buffer, count(*) AS days FROM dy, b WHERE abs(y - 2) <= buffer AND abs(x - 2) <= buffer GROUP BY buffer) SELECT buffer, sample, days FROM k, (SELECT unnest(range(4)) AS sample)")
def _(s, d):
    w = timeagg.resample(hourly(s, d), ["cell", "y", "x"], "day").where(F.round("value", 6) >= 1)
    near = w.withColumn("buffer", F.explode(F.sequence(F.greatest(F.abs(F.col("y") - 2), F.abs(F.col("x") - 2)), F.lit(2).cast("long"))))
    return synthesis.samples_of(near, 4).groupBy("buffer", "sample").agg(F.count("*").alias("days"))


@query("n01_nearest_regrid", "name:i value:d", f"WITH {GRID}, p AS (SELECT s_suppkey AS name, 36.2 + (s_suppkey % 60) * 0.1 AS lat, -1.9 + (s_suppkey % 53) * 0.11 AS lon FROM supplier), z AS (SELECT name, hgt, row_number() OVER (PARTITION BY name ORDER BY round(sqrt(pow(p.lat - grid.lat, 2) + pow(p.lon - grid.lon, 2)), 6), y, x) AS n FROM p, grid) SELECT name, hgt AS value FROM z WHERE n = 1")
def _(s, d):
    from .alignments import points

    near = joins.nearest_cell(points(s, d), grid(s), ["name"], sphere=False, cell_degrees=1.5)
    return near.select("name", "y", "x").join(grid(s).select("y", "x", F.col("hgt").alias("value")), ["y", "x"])


@query("n04_log_vertical", "cell:i target:d value:d", f"""WITH {CUBE}, p AS (SELECT cell, 100.0 * (1 + hour(ts) // 4) AS lev, avg(value) AS v FROM cube GROUP BY ALL), s AS (SELECT cell, lev AS x0, v AS v0, lead(lev) OVER w AS x1, lead(v) OVER w AS v1, lag(lev) OVER w IS NULL AS first FROM p WINDOW w AS (PARTITION BY cell ORDER BY lev)),
g AS (SELECT *, lead(x1) OVER (PARTITION BY cell ORDER BY x0) IS NULL AS last FROM s WHERE x1 IS NOT NULL) SELECT cell, target, v0 + (ln(target) - ln(x0)) / (ln(x1) - ln(x0)) * (v1 - v0) AS value FROM g, (SELECT unnest([150.0, 350.0]) AS target) t WHERE (target >= x0 OR first) AND (target < x1 OR last)""")
def _(s, d):
    p = cube(s, d).groupBy("cell", (100.0 * (1 + F.floor(F.hour("ts") / 4))).alias("lev")).agg(F.avg("value").alias("value"))
    return interpolation.vertical(p, s.createDataFrame([(150.0,), (350.0,)], "target double"), ["cell"], log=True)


@query("io05_time_bounds", "cell:i ts:t ts_from:t ts_to:t", f"WITH {HOURLY} SELECT cell, ts, ts - INTERVAL 30 MINUTE AS ts_from, ts + INTERVAL 30 MINUTE AS ts_to FROM hourly")
def _(s, d):
    return tables.with_bounds(hourly(s, d), 60)


@query("io16_rewrap_and_clip", "k:i lon:d lat:d", "WITH p AS (SELECT o_orderkey AS k, (o_orderkey % 360)::DOUBLE AS lon, (o_orderkey % 90)::DOUBLE AS lat FROM orders) SELECT k, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon, lat FROM p WHERE lat BETWEEN 30 AND 50 AND CASE WHEN lon > 180 THEN lon - 360 ELSE lon END BETWEEN -20 AND 40")
def _(s, d):
    k = F.col("o_orderkey")
    p = table(s, d, "orders").select(k.alias("k"), (k % 360).cast("double").alias("lon"), (k % 90).cast("double").alias("lat"))
    return tables.rewrap_and_clip(p, (30.0, -20.0, 50.0, 40.0))


@query("io18_prune_by_date", "year:i month:i n:i", "SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1999 AND month(o_orderdate) IN (12, 1, 2) GROUP BY ALL")
def _(s, d):
    o = table(s, d, "orders").withColumns({"year": F.year("o_orderdate"), "month": F.month("o_orderdate")})
    return tables.prune(o, 1997, 1999, [12, 1, 2]).groupBy("year", "month").agg(F.count("*").alias("n"))


@query("io22_merge_tiles", "y:i x:i n:i", f"WITH {CUBE} SELECT y, x, count(*) AS n FROM cube GROUP BY ALL")
def _(s, d):
    c = joins.with_tile(cube(s, d), 2)
    parts = [c.where((F.col("ty") == t) & (F.col("tx") == u)).drop("ty", "tx") for t in range(3) for u in range(3)]
    return tables.merge_tiles(*parts).groupBy("y", "x").agg(F.count("*").alias("n"))


@query("f24b_histogram_change", "bin:i change:d", f"WITH {CUBE}, z AS (SELECT run, {hist('value', C.IFD_INTENSITY)} AS bin FROM cube), g AS (SELECT bin, count(CASE WHEN run = 'present' THEN 1 END) AS p, count(CASE WHEN run = 'future' THEN 1 END) AS f FROM z WHERE bin IS NOT NULL GROUP BY bin) SELECT bin, (f - p) * 100 / nullif(p, 0) AS change FROM g")
def _(s, d):
    h = joins.present_future(dist.histogram(cube(s, d), ["run"], C.IFD_INTENSITY).withColumnRenamed("cnt", "value"), ["bin"])
    return h.select("bin", relative_change(F.coalesce("future", F.lit(0)), F.coalesce("present", F.lit(0))).alias("change"))


@query("plan_pooled_conditional", "run:s cy:i cx:i bin_low:i bin_high:i p:d", f"WITH {_COUNTS}, {_CLIP}, g AS (SELECT run, cy, cx, bin_low, bin_high, sum(cnt)::BIGINT AS cnt FROM n GROUP BY ALL) SELECT run, cy, cx, bin_low, bin_high, cnt / sum(cnt) OVER (PARTITION BY run, cy, cx, bin_low) AS p FROM g")
def _(s, d):
    return dist.pooled_conditional(_counts(s, d), 1, 5, 5, ["run"])


@query("plan_blocks", "run:s cell:i block:D total:d largest:d n_wet:i wet_total:d bin_low:i", f"WITH {BLOCK} SELECT run, cell, block, total, largest, n_wet, wet_total, bin_low FROM b")
def _(s, d):
    b = pipelines.blocks_with_bins(hourly(s, d), ["cell"])
    day = F.col("block").cast("int") + F.when(F.col("run") == "future", 15).otherwise(0)
    return b.withColumn("block", F.date_add(F.lit("2024-01-01").cast("date"), day))
