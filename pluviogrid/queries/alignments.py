"""Joins, interpolation, significance, attribution, quality, set operations."""

from __future__ import annotations

import math


from pyspark.sql import functions as F


from ..operators import clusters, dist, interpolation, joins, quality, stats, timeagg
from ..plans import pipelines
from .registry import CUBE, DAILY, GRID, HOURLY, cube, daily, grid, hourly, query, table

_HAV = "2 * 6371000.0 * asin(sqrt(least(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2), 1.0)))"
POINTS = "pts AS (SELECT s_suppkey AS name, 36.2 + (s_suppkey % 60) * 0.1 AS lat, -1.9 + (s_suppkey % 53) * 0.11 AS lon FROM supplier)"


def points(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(k.alias("name"), (36.2 + (k % 60) * F.lit(0.1)).alias("lat"), (-1.9 + (k % 53) * F.lit(0.11)).alias("lon"))


def _nearest(dist_sql: str) -> str:
    return f"WITH {GRID}, {POINTS}, z AS (SELECT name, grid.y, grid.x, round({dist_sql}, 6) AS distance, row_number() OVER (PARTITION BY name ORDER BY round({dist_sql}, 6), grid.y, grid.x) AS n FROM pts, grid) SELECT name, y, x, distance FROM z WHERE n = 1"


@query("j01_present_future", "cell:i present:d future:d", f"WITH {CUBE} SELECT cell, sum(CASE WHEN run = 'present' THEN value END) AS present, sum(CASE WHEN run = 'future' THEN value END) AS future FROM cube GROUP BY cell")
def _(s, d):
    return joins.present_future(cube(s, d).groupBy("run", "cell").agg(F.sum("value").alias("value")), ["cell"])


@query("j03_outer", "cell:i ts:t rain:d dew:d", f"WITH {CUBE}, r AS (SELECT cell, date_trunc('hour', ts) AS ts, sum(value) AS rain FROM cube GROUP BY ALL), w AS (SELECT (cell * 3) % 29 AS cell, date_trunc('hour', ts) AS ts, max(value) AS dew FROM cube GROUP BY ALL) SELECT coalesce(r.cell, w.cell) AS cell, coalesce(r.ts, w.ts) AS ts, rain, dew FROM r FULL JOIN w ON r.cell = w.cell AND r.ts = w.ts")
def _(s, d):
    c = cube(s, d)
    r = timeagg.resample(c, ["cell"], "hour").withColumnRenamed("value", "rain")
    w = timeagg.resample(c.withColumn("cell", F.col("cell") * 3 % 29), ["cell"], "hour", how="max").withColumnRenamed("value", "dew")
    return joins.outer(r, w, ["cell", "ts"])


@query("j06_cluster_of_location", "name:s y:i x:i", f"WITH {GRID}, k AS (SELECT y, x, (y + 2 * x) % 3 AS cluster_id FROM grid), l AS (SELECT 'A' AS name, 1 AS y, 1 AS x UNION ALL SELECT 'B', 4, 0) SELECT name, k.y, k.x FROM k JOIN (SELECT name, cluster_id FROM l JOIN k USING (y, x)) i USING (cluster_id)")
def _(s, d):
    k = grid(s).select("y", "x", ((F.col("y") + 2 * F.col("x")) % 3).alias("cluster_id"))
    loc = s.createDataFrame([("A", 1, 1), ("B", 4, 0)], "name string, y long, x long")
    return joins.by_reference(grid(s).select("y", "x"), k, loc)


@query("j09_nearest_degrees", "name:i y:i x:i distance:d", _nearest("sqrt(pow(pts.lat - grid.lat, 2) + pow(pts.lon - grid.lon, 2))"))
def _(s, d):
    return joins.nearest_cell(points(s, d), grid(s), ["name"], sphere=False, cell_degrees=1.5)


@query("j10_nearest_sphere", "name:i y:i x:i distance:d", _nearest(_HAV.format(a="pts.lat", b="grid.lat", c="pts.lon", d="grid.lon")))
def _(s, d):
    return joins.nearest_cell(points(s, d), grid(s), ["name"], cell_degrees=1.5)


@query("j11_neighbourhood", "cy:i cx:i n:i total:d", f"WITH {CUBE} SELECT cube.y + dy AS cy, cube.x + dx AS cx, count(*) AS n, sum(value) AS total FROM cube, (SELECT unnest([-1, 0, 1]) AS dy) a, (SELECT unnest([-1, 0, 1]) AS dx) b WHERE cube.y + dy BETWEEN 0 AND 4 AND cube.x + dx BETWEEN 0 AND 4 GROUP BY ALL")
def _(s, d):
    c = cube(s, d).groupBy("y", "x").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return dist.neighbourhood(c, 1, 5, 5).groupBy("cy", "cx").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("j12_within_distance", "name:i cell:i distance:d", f"WITH {GRID}, {POINTS} SELECT name, cell, {_HAV.format(a='pts.lat', b='grid.lat', c='pts.lon', d='grid.lon')} AS distance FROM pts, grid WHERE {_HAV.format(a='pts.lat', b='grid.lat', c='pts.lon', d='grid.lon')} <= 150000")
def _(s, d):
    a = points(s, d).select(F.lit(1).alias("k"), "name", F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    b = grid(s).select(F.lit(1).alias("k"), "cell", F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    return joins.within_distance(a, b, ["k"], 150_000.0)


def _whole_seconds(c):
    """The nearest second of a time, the even one of two, as DuckDB casts numbers to integers."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", F.rint(F.timestamp_diff("MICROSECOND", zero, F.col(c)) / 1e6).cast("long"), zero)


@query("j13_as_of_nearest", "cell:i event_id:i near_ts:t near_value:d", f"""WITH {HOURLY}, a AS (SELECT event_id, user_id % 25 AS cell, epoch(ts)::BIGINT - 10800 AS t FROM events WHERE event_type = 'error'),
z AS (SELECT a.cell, event_id, h.ts AS near_ts, h.value AS near_value, row_number() OVER (PARTITION BY a.cell, event_id ORDER BY abs(epoch(h.ts)::BIGINT - t), h.ts) AS n FROM a JOIN hourly h ON h.cell = a.cell AND abs(epoch(h.ts)::BIGINT - t) <= 7200) SELECT * FROM z WHERE n = 1""")
def _(s, d):
    e = table(s, d, "events").where("event_type = 'error'").select("event_id", (F.col("user_id") % 25).alias("cell"), _whole_seconds("ts").alias("ts"))
    return joins.as_of_nearest(e, hourly(s, d), ["cell"], ["event_id"], -3, 2)


@query("j14_month_interpolation", "cell:s ts:t value:d", f"""WITH {DAILY}, c AS (SELECT cell, month(ts) AS month, avg(value) AS v FROM daily GROUP BY ALL), m AS (SELECT unnest(generate_series(DATE '1990-01-01', DATE '2010-12-01', INTERVAL 1 MONTH))::TIMESTAMP AS m0),
h AS (SELECT m0, m0 + to_hours(date_diff('day', m0, m0 + INTERVAL 1 MONTH) * 12) AS t0, m0 + INTERVAL 1 MONTH AS m1 FROM m), k AS (SELECT *, m1 + to_hours(date_diff('day', m1, m1 + INTERVAL 1 MONTH) * 12) AS t1 FROM h)
SELECT d.cell, d.ts, a.v * (1 - (epoch(d.ts) - epoch(t0)) / (epoch(t1) - epoch(t0))) + b.v * ((epoch(d.ts) - epoch(t0)) / (epoch(t1) - epoch(t0))) AS value FROM daily d JOIN k ON d.ts >= t0 AND d.ts < t1 JOIN c a ON a.cell = d.cell AND a.month = month(m0) JOIN c b ON b.cell = d.cell AND b.month = month(m1)""")
def _(s, d):
    x = daily(s, d)
    monthly = x.groupBy("cell", F.month("ts").alias("month")).agg(F.avg("value").alias("value"))
    return joins.month_interpolation(x.select("cell", "ts"), monthly, ["cell"])


@query("j16_densify", "cell:s day:t value:d", f"WITH {DAILY}, s AS (SELECT DISTINCT cell FROM daily), c AS (SELECT cell, unnest(generate_series(TIMESTAMP '1999-12-01', TIMESTAMP '2000-03-01', INTERVAL 1 DAY)) AS day FROM s) SELECT c.cell, day, value FROM c LEFT JOIN daily ON daily.cell = c.cell AND daily.ts = day")
def _(s, d):
    x = daily(s, d)
    return joins.densify(x, x, ["cell"], "1999-12-01 00:00:00", "2000-03-01 00:00:00", "DAY").withColumnRenamed("ts", "day")


@query("j17_combine_first", "cell:i ts:t value:d", f"WITH {CUBE}, a AS (SELECT cell, date_trunc('hour', ts) AS ts, sum(value) AS v FROM cube GROUP BY ALL), b AS (SELECT (cell * 3) % 29 AS cell, date_trunc('hour', ts) AS ts, max(value) AS v FROM cube GROUP BY ALL) SELECT coalesce(a.cell, b.cell) AS cell, coalesce(a.ts, b.ts) AS ts, coalesce(a.v, b.v) AS value FROM a FULL JOIN b ON a.cell = b.cell AND a.ts = b.ts")
def _(s, d):
    c = cube(s, d)
    return joins.combine_first(timeagg.resample(c, ["cell"], "hour"), timeagg.resample(c.withColumn("cell", F.col("cell") * 3 % 29), ["cell"], "hour", how="max"), ["cell", "ts"])


@query("j18_missing_days", "day:D", "SELECT day FROM (SELECT unnest(generate_series(DATE '1994-12-01', DATE '2001-12-31', INTERVAL 1 DAY))::DATE AS day) WHERE day NOT IN (SELECT o_orderdate::DATE FROM orders)")
def _(s, d):
    return quality.missing_days(table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")), "1994-12-01", "2001-12-31")


@query("j19_tiles", "ty:i tx:i", "SELECT ty, tx FROM (SELECT unnest(range(25)) AS ty) a, (SELECT unnest(range(15)) AS tx) b")
def _(s, d):
    return joins.tiles(s, 1250, 750, 50)


@query("io24_halo_tiles", "ty:i tx:i core:b n:i", f"WITH {CUBE}, t AS (SELECT ty, tx FROM (SELECT unnest(range(3)) AS ty) a, (SELECT unnest(range(3)) AS tx) b) SELECT ty, tx, (cube.y // 2 = ty AND cube.x // 2 = tx) AS core, count(*) AS n FROM cube JOIN t ON cube.y BETWEEN ty * 2 - 1 AND ty * 2 + 2 AND cube.x BETWEEN tx * 2 - 1 AND tx * 2 + 2 GROUP BY ALL")
def _(s, d):
    return joins.with_tile(cube(s, d), 2, 1).where("ty <= 2 and tx <= 2").groupBy("ty", "tx", "core").agg(F.count("*").alias("n"))


@query("io27_tile_diagnosis", "ty:i tx:i n_p:i n_f:i issue:s", f"WITH {CUBE}, g AS (SELECT y // 2 AS ty, x // 2 AS tx, count(CASE WHEN run = 'present' THEN 1 END) AS n_p, count(CASE WHEN run = 'future' THEN 1 END) AS n_f FROM cube GROUP BY ALL) SELECT ty, tx, nullif(n_p, 0) AS n_p, nullif(n_f, 0) AS n_f, CASE WHEN n_p = 0 THEN 'no present' WHEN n_f = 0 THEN 'no future' WHEN n_p <> n_f THEN 'lengths differ' WHEN n_p < 100 THEN 'incomplete' ELSE 'ok' END AS issue FROM g")
def _(s, d):
    return quality.diagnose_tiles(joins.with_tile(cube(s, d), 2), 100)


@query("a06_union", "run:s n:i total:d", "SELECT o_orderstatus AS run, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY ALL")
def _(s, d):
    o = table(s, d, "orders")
    u = quality.stacked(F=o.where("o_orderstatus = 'F'"), O=o.where("o_orderstatus = 'O'"), P=o.where("o_orderstatus = 'P'"))
    return u.groupBy("run").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("a07_intersect", "k:i", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(s, d):
    return quality.common_models(table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select("s_nationkey"))


@query("a08_except", "k:i", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def _(s, d):
    return quality.except_models(table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select("s_nationkey"))


@query("a03_spatial_moments", "run:s mean:d var:d corr:d", f"WITH {CUBE}, c AS (SELECT run, cell, avg(value) AS a, max(value) AS b FROM cube GROUP BY ALL) SELECT run, avg(a) AS mean, var_pop(a) AS var, CASE WHEN count(*) > 10 THEN corr(a, b) END AS corr FROM c GROUP BY run")
def _(s, d):
    c = cube(s, d).groupBy("run", "cell").agg(F.avg("value").alias("a"), F.max("value").alias("b"))
    return c.groupBy("run").agg(F.avg("a").alias("mean"), F.var_pop("a").alias("var"), F.when(F.count("*") > 10, F.corr("a", "b")).alias("corr"))


@query("n02_bilinear", "name:i value:d", f"""WITH {GRID}, {POINTS}, f AS (SELECT name, floor((lat - 36) / 1.5)::BIGINT AS iy, floor((lon + 2) / 1.5)::BIGINT AS ix, (lat - 36) / 1.5 - floor((lat - 36) / 1.5) AS wy, (lon + 2) / 1.5 - floor((lon + 2) / 1.5) AS wx FROM pts)
SELECT name, (1 - wy) * (1 - wx) * a.hgt + (1 - wy) * wx * b.hgt + wy * (1 - wx) * c.hgt + wy * wx * e.hgt AS value FROM f JOIN grid a ON a.y = iy AND a.x = ix JOIN grid b ON b.y = iy AND b.x = ix + 1 JOIN grid c ON c.y = iy + 1 AND c.x = ix JOIN grid e ON e.y = iy + 1 AND e.x = ix + 1""")
def _(s, d):
    g = grid(s).select(F.col("y").alias("iy"), F.col("x").alias("ix"), F.col("hgt").alias("value"))
    return interpolation.bilinear(g, points(s, d).where("lat < 42 and lon < 4"), [], 36.0, -2.0, 1.5)


@query("n03_vertical", "cell:i target:d value:d", f"""WITH {CUBE}, p AS (SELECT cell, 100.0 * (1 + hour(ts) // 4) AS lev, avg(value) AS v FROM cube GROUP BY ALL), s AS (SELECT cell, lev AS x0, v AS v0, lead(lev) OVER w AS x1, lead(v) OVER w AS v1, lag(lev) OVER w IS NULL AS first FROM p WINDOW w AS (PARTITION BY cell ORDER BY lev)),
g AS (SELECT *, lead(x1) OVER (PARTITION BY cell ORDER BY x0) IS NULL AS last FROM s WHERE x1 IS NOT NULL) SELECT cell, target, v0 + (target - x0) / (x1 - x0) * (v1 - v0) AS value FROM g, (SELECT unnest([50.0, 150.0, 200.0, 433.0, 700.0]) AS target) t WHERE (target >= x0 OR first) AND (target < x1 OR last)""")
def _(s, d):
    p = cube(s, d).groupBy("cell", (100.0 * (1 + F.floor(F.hour("ts") / 4))).alias("lev")).agg(F.avg("value").alias("value"))
    return interpolation.vertical(p, s.createDataFrame([(x,) for x in (50.0, 150.0, 200.0, 433.0, 700.0)], "target double"), ["cell"])


@query("n06_climate_signal", "cell:s month:i delta:d stamp:D", f"WITH {DAILY}, m AS (SELECT cell, month(ts) AS month, avg(CASE WHEN year(ts) < 2000 THEN value END) AS p, avg(CASE WHEN year(ts) >= 2000 THEN value END) AS f FROM daily GROUP BY ALL) SELECT cell, month, f - p AS delta, make_date(1990, month, 1) AS stamp FROM m")
def _(s, d):
    x = daily(s, d).withColumn("run", F.when(F.year("ts") < 2000, "present").otherwise("future"))
    return interpolation.climate_signal(timeagg.monthly_climatology(x, ["run", "cell"], 1900, 2100), ["cell"])


@query("n07_apply_weights", "dst:i value:d", f"WITH {CUBE}, f AS (SELECT cell AS src, sum(value) AS v FROM cube GROUP BY ALL), w AS (SELECT src, src // 5 AS dst, 1.0 / (1 + src % 5) AS w FROM (SELECT unnest(range(25)) AS src)) SELECT dst, sum(w * v) AS value FROM f JOIN w USING (src) GROUP BY dst")
def _(s, d):
    f = cube(s, d).groupBy(F.col("cell").alias("src")).agg(F.sum("value").alias("value"))
    w = s.range(25).select(F.col("id").alias("src"), F.floor(F.col("id") / 5).alias("dst"), (1.0 / (1 + F.col("id") % 5)).alias("w"))
    return interpolation.apply_weights(f, w, [])


def _cdf(z: str) -> str:
    k = f"(1 / (1 + 0.2316419 * {z}))"
    return f"(exp(-{z} * {z} / 2) / {math.sqrt(2 * math.pi)!r} * ({k} * (0.319381530 + {k} * (-0.356563782 + {k} * (1.781477937 + {k} * (-1.821255978 + {k} * 1.330274429))))))"


_MW = """r AS (SELECT *, rank() OVER (PARTITION BY cell ORDER BY value) + (count(*) OVER (PARTITION BY cell, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY cell, value) AS t FROM v),
g AS (SELECT cell, count(CASE WHEN run = 'present' THEN 1 END)::DOUBLE AS n1, count(CASE WHEN run <> 'present' THEN 1 END)::DOUBLE AS n2, sum(CASE WHEN run = 'present' THEN r END) AS r1, sum((t::DOUBLE * t - 1) / 12) AS ties FROM r GROUP BY cell),
u AS (SELECT *, least(r1 - n1 * (n1 + 1) / 2, n1 * n2 - r1 + n1 * (n1 + 1) / 2) AS u, sqrt(greatest(0, n1 * n2 * (n1 + n2 + 1) / 12 - n1 * n2 * ties / nullif((n1 + n2) * (n1 + n2 - 1), 0))) AS sd FROM g),
z AS (SELECT *, {gap} / nullif(sd, 0) AS z FROM u)"""


def _mw(continuity: bool) -> str:
    gap = "greatest(0, abs(u - n1 * n2 / 2) - 0.5)" if continuity else "abs(u - n1 * n2 / 2)"
    far = "" if continuity else "WHEN z > 6 THEN 0.0 "
    return f"WITH {CUBE}, q AS (SELECT run, cell, quantile_cont(value, 0.75) AS q FROM cube GROUP BY ALL), v AS (SELECT cube.run, cube.cell, cube.value FROM cube JOIN q ON q.run = cube.run AND q.cell = cube.cell WHERE cube.value >= q.q), {_MW.format(gap=gap)} SELECT cell, n1::BIGINT AS n1, n2::BIGINT AS n2, CASE WHEN n1 >= 5 AND n2 >= 5 THEN u END AS u, CASE WHEN n1 >= 5 AND n2 >= 5 THEN CASE WHEN sd = 0 THEN 1.0 {far}ELSE least(1.0, 2 * {_cdf('z')}) END END AS pvalue FROM z"


@query("s02_mann_whitney", "cell:i n1:i n2:i u:d pvalue:d", _mw(False))
def _(s, d):
    return stats.mann_whitney(stats.exceedances(cube(s, d), ["cell"], 0.75), ["cell"])


@query("s03_mann_whitney_continuity", "cell:i n1:i n2:i u:d pvalue:d", _mw(True))
def _(s, d):
    return stats.mann_whitney(stats.exceedances(cube(s, d), ["cell"], 0.75), ["cell"], continuity=True)


@query("s04_benjamini_hochberg", "cell:i q:i pvalue:d sig_fdr:i", f"WITH {CUBE}, p AS (SELECT cell, hour(ts) AS q, CASE WHEN count(*) > 1 THEN round(pow(avg(value) / 20, 4), 9) END AS pvalue FROM cube GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY pvalue, q) AS i, count(*) OVER (PARTITION BY cell) AS m FROM p WHERE pvalue IS NOT NULL), k AS (SELECT *, max(CASE WHEN pvalue <= i / m * 0.05 THEN i END) OVER (PARTITION BY cell) AS k FROM r) SELECT cell, q, pvalue, CASE WHEN i <= coalesce(k, 0) THEN 1 ELSE 0 END AS sig_fdr FROM k UNION ALL SELECT cell, q, pvalue, 0 FROM p WHERE pvalue IS NULL")
def _(s, d):
    p = cube(s, d).groupBy("cell", F.hour("ts").alias("q")).agg(F.when(F.count("*") > 1, F.round(F.pow(F.avg("value") / 20, F.lit(4.0)), 9)).alias("pvalue"))
    return stats.benjamini_hochberg(p, ["cell"])


@query("s05_significant_area", "hour:i pct_sig:d pct_up:d pct_down:d n:i pct_interior:d pct_coastal:d", f"WITH {CUBE}, c AS (SELECT hour(ts) AS hour, cell, (max(value) > 12)::INT AS sig_fdr, avg(value) - 5 AS change, (cell % 5 = 0)::INT AS coast FROM cube GROUP BY ALL) SELECT hour, 100.0 * avg((sig_fdr = 1)::INT) AS pct_sig, 100.0 * avg((sig_fdr = 1 AND change > 0)::INT) AS pct_up, 100.0 * avg((sig_fdr = 1 AND change < 0)::INT) AS pct_down, count(*) AS n, 100.0 * count(CASE WHEN sig_fdr = 1 AND coast = 0 THEN 1 END) / nullif(count(CASE WHEN coast = 0 THEN 1 END), 0) AS pct_interior, 100.0 * count(CASE WHEN sig_fdr = 1 AND coast = 1 THEN 1 END) / nullif(count(CASE WHEN coast = 1 THEN 1 END), 0) AS pct_coastal FROM c GROUP BY hour")
def _(s, d):
    c = cube(s, d).groupBy(F.hour("ts").alias("hour"), "cell").agg((F.max("value") > 12).cast("int").alias("sig_fdr"), (F.avg("value") - 5).alias("change"), F.first((F.col("cell") % 5 == 0).cast("int")).alias("coast"))
    return stats.significant_area(c, ["hour"], coast="coast")


_ATTR = f"{CUBE}, c AS (SELECT cell, avg(CASE WHEN run = 'present' THEN value END) AS p, avg(CASE WHEN run = 'future' THEN value END) AS f, avg(value) AS s FROM cube GROUP BY cell), a AS (SELECT cell, f - p AS total, s - p AS daily, f - s AS structural, (s - p) / nullif(f - p, 0) AS daily_frac, (f - s) / nullif(f - p, 0) AS structural_frac, 100 * (f - p) / nullif(p, 0) AS total_pct FROM c)"
_CLASS = "CASE WHEN daily_frac IS NULL THEN '' WHEN daily_frac < -0.2 OR daily_frac > 1.2 THEN 'amplifying' WHEN daily_frac > 0.2 AND daily_frac <= 0.8 THEN 'mixed' WHEN daily_frac >= -0.2 AND daily_frac <= 0.2 THEN 'structural' ELSE 'daily' END"


def _attribution(s, d):
    c = cube(s, d).groupBy("cell").agg(F.avg(F.when(F.col("run") == "present", F.col("value"))).alias("p"), F.avg(F.when(F.col("run") == "future", F.col("value"))).alias("f"), F.avg("value").alias("s"))
    return c.withColumns(stats.attribution(F.col("p"), F.col("s"), F.col("f")))


@query("s06_attribution", "cell:i total:d daily:d structural:d daily_frac:d structural_frac:d total_pct:d", f"WITH {_ATTR} SELECT * FROM a")
def _(s, d):
    return _attribution(s, d)


@query("s08_classification", "cell:i label:s", f"WITH {_ATTR} SELECT cell, {_CLASS} AS label FROM a")
def _(s, d):
    return _attribution(s, d).withColumn("label", stats.classify(F.col("daily_frac")))


@query("s09_summary", "n:i mean_total:d var_daily:d corr_daily:d frac_daily:d frac_structural:d", f"WITH {_ATTR} SELECT count(*) AS n, avg(total) AS mean_total, var_pop(daily) AS var_daily, CASE WHEN count(total) > 10 THEN corr(total, daily) END AS corr_daily, avg(coalesce(daily_frac > 0.8, FALSE)::INT) AS frac_daily, avg(coalesce(daily_frac < 0.2, FALSE)::INT) AS frac_structural FROM a")
def _(s, d):
    return stats.summary(_attribution(s, d).withColumn("k", F.lit(1)), ["k"])


@query("s10_contingency", "chi2:d dof:i", "WITH r AS (SELECT o_orderstatus AS a, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1), o AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT count(*) AS n FROM orders), f AS (SELECT coalesce(o.n, 0) AS o, r.n * c.n / t.n AS e FROM r CROSS JOIN c CROSS JOIN t LEFT JOIN o ON o.a = r.a AND o.b = c.b) SELECT sum(pow(o - e, 2) / e) AS chi2, ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1) AS dof FROM f")
def _(s, d):
    return stats.contingency(table(s, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("s10b_two_proportions", "z:d pvalue:d", f"WITH g AS (SELECT count(CASE WHEN l_returnflag = 'A' AND l_discount > 0.05 THEN 1 END) AS h1, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS n1, count(CASE WHEN l_returnflag = 'R' AND l_discount > 0.05 THEN 1 END) AS h2, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n2 FROM lineitem), q AS (SELECT *, (h1 + h2) / (n1 + n2) AS p FROM g), r AS (SELECT (h1 / n1 - h2 / n2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) AS z FROM q) SELECT z, 2 * {_cdf('abs(z)')} AS pvalue FROM r")
def _(s, d):
    return stats.two_proportions(table(s, d, "lineitem"), "l_returnflag", F.col("l_discount") > 0.05, "A", "R")


@query("plan_intensity_frequency", "run:s bin_a:i bin_b:i cnt:i")
def _(s, d):
    return pipelines.intensity_frequency(hourly(s, d), ["cell"])


@query("plan_significance", "cell:i q:d n1:i n2:i pvalue:d sig_fdr:i")
def _(s, d):
    return pipelines.significance(hourly(s, d), ["cell"], [0.5, 0.75, 0.9])


@query("s20_ward_clusters", "vec_id:i cluster_id:i")
def _(s, d):
    return clusters.ward_clusters(table(s, d, "embeddings"), "vec_id", "embedding", 1.6)


@query("s20b_linkage", "step:i a:i b:i dist:d size:i")
def _(s, d):
    return clusters.linkage(table(s, d, "embeddings"), "vec_id", "embedding")


