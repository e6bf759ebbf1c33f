"""Spells, events, storm tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events
from .registry import HOURLY, cube, hourly, query, table

SPELL = f"""{HOURLY}, f AS (SELECT *, value >= 1 AS wet, coalesce(lag(value >= 1) OVER w <> (value >= 1), TRUE) AS is_start, coalesce(lead(value >= 1) OVER w <> (value >= 1), TRUE) AS is_end FROM hourly WINDOW w AS (PARTITION BY cell ORDER BY ts)),
s AS (SELECT *, sum(is_start::INT) OVER (PARTITION BY cell ORDER BY ts ROWS UNBOUNDED PRECEDING) AS event FROM f)"""
EVENT = f"""{SPELL}, e AS (SELECT run, cell, event, min(ts) AS start, max(ts) AS stop, count(*) AS duration, sum(value) AS total, max(value) AS peak, sum(value) / count(*) AS intensity FROM (SELECT *, first_value(run) OVER (PARTITION BY cell, event ORDER BY ts) AS r0 FROM s) WHERE wet GROUP BY run, cell, event)"""


@query("e01_spell_ids", "cell:i ts:t event:i is_start:b is_end:b wet:b", f"WITH {SPELL} SELECT cell, ts, event, is_start, is_end, wet FROM s")
def _(s, d):
    return events.spells(hourly(s, d), ["cell"])


@query("e02_wet_events", "cell:i event:i start:t stop:t duration:i total:d peak:d intensity:d", f"WITH {SPELL} SELECT cell, event, min(ts) AS start, max(ts) AS stop, count(*) AS duration, sum(value) AS total, max(value) AS peak, sum(value) / count(*) AS intensity FROM s WHERE wet GROUP BY cell, event")
def _(s, d):
    return events.event_table(hourly(s, d), ["cell"])


@query("e03_event_on_rows", "cell:i ts:t dur_all:i dur_last:i total_last:d len_first:i cumul_first:d peak_first:d", f"WITH {SPELL}, w AS (SELECT *, count(*) OVER g AS n, sum(value) OVER g AS t, max(value) OVER g AS m FROM s WINDOW g AS (PARTITION BY cell, event)) SELECT cell, ts, n AS dur_all, CASE WHEN is_end THEN n END AS dur_last, CASE WHEN is_end THEN t END AS total_last, CASE WHEN is_start AND wet THEN n ELSE 0 END AS len_first, CASE WHEN is_start AND wet THEN t END AS cumul_first, CASE WHEN is_start AND wet THEN m END AS peak_first FROM w")
def _(s, d):
    return events.on_rows(hourly(s, d), ["cell"])


@query("e06_event_stats", "cell:i n_events:i mean_duration:d mean_intensity:d total_precipitation:d", f"WITH {SPELL}, e AS (SELECT cell, event, count(*) AS duration, sum(value) AS total FROM s WHERE wet GROUP BY cell, event) SELECT cell, count(*) AS n_events, avg(duration) AS mean_duration, avg(total / duration) AS mean_intensity, sum(total) AS total_precipitation FROM e GROUP BY cell")
def _(s, d):
    return events.event_stats(events.event_table(hourly(s, d), ["cell"]), ["cell"])


@query("e07_event_stats_season", "cell:i season:s n_events:i mean_duration:d", f"WITH {SPELL}, e AS (SELECT cell, event, count(*) AS duration FROM s WHERE wet GROUP BY cell, event) SELECT cell, 'DJF' AS season, count(*) AS n_events, avg(duration) AS mean_duration FROM e GROUP BY cell")
def _(s, d):
    return events.event_stats(events.event_table(hourly(s, d), ["cell"]), ["cell"], by_season=True)


@query("e09_sessions", "cell:i day:D hours:i sessions:i total:d max_rate:d duration:d amount:d", f"WITH {SPELL} SELECT cell, ts::DATE AS day, count(*) AS hours, count(DISTINCT event) AS sessions, sum(value) AS total, max(value) AS max_rate, count(*) / count(DISTINCT event) AS duration, sum(value) / count(DISTINCT event) AS amount FROM s WHERE wet GROUP BY ALL")
def _(s, d):
    return events.sessions(hourly(s, d), ["cell"])


@query("e11_moving_accumulation", "cell:i ts:t accumulated:d", f"WITH {HOURLY} SELECT cell, ts, CASE WHEN value > 0.1 THEN sum(value) OVER (PARTITION BY cell ORDER BY ts ROWS 11 PRECEDING) ELSE 0 END AS accumulated FROM hourly")
def _(s, d):
    return events.moving_accumulation(hourly(s, d), ["cell"], 12)


@query("e12_decomposition", "cell:i by_number:d by_intensity:d by_duration:d change:d residual:d", f"""WITH {HOURLY}, f AS (SELECT *, value >= 1 AS wet, coalesce(lag(value >= 1) OVER w <> (value >= 1), TRUE) AS is_start FROM hourly WINDOW w AS (PARTITION BY run, cell ORDER BY ts)),
s AS (SELECT *, sum(is_start::INT) OVER (PARTITION BY run, cell ORDER BY ts ROWS UNBOUNDED PRECEDING) AS event FROM f),
e AS (SELECT run, cell, event, count(*) AS duration, sum(value) AS total FROM s WHERE wet GROUP BY ALL), g AS (SELECT run, cell, count(*) AS n, avg(total / duration) AS i, avg(duration) AS t FROM e GROUP BY ALL),
p AS (SELECT a.cell, a.n, a.i, a.t, b.n AS n2, b.i AS i2, b.t AS t2 FROM g a JOIN g b ON a.cell = b.cell AND a.run = 'present' AND b.run = 'future'),
r AS (SELECT cell, (n2 - n) * i * t AS by_number, (i2 - i) * n * t AS by_intensity, (t2 - t) * n * i AS by_duration, n2 * i2 * t2 - n * i * t AS change FROM p) SELECT *, change - by_number - by_intensity - by_duration AS residual FROM r""")
def _(s, d):
    return events.decompose(events.event_stats(events.event_table(hourly(s, d), ["run", "cell"]), ["run", "cell"]), ["cell"])


def tracks(s, d):
    """Orders of a customer as a storm's steps."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("storm_id"), F.struct(F.col("o_orderdate").cast("timestamp_ntz").alias("t"), "o_orderkey", (F.round("o_totalprice") / 1000).alias("v")).alias("r"))
    t = o.groupBy("storm_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    get = lambda f: F.transform("r", f)
    return t.select("storm_id", get(lambda r: r["t"]).alias("times"), get(lambda r: r["v"] * 2).alias("size"), get(lambda r: r["v"]).alias("tot"), get(lambda r: r["v"] / 2).alias("max"), get(lambda r: r["v"] / 4).alias("mean"), F.slice(get(lambda r: r["v"] / 8), F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))).alias("speed"), get(lambda r: F.array(F.lit(36.0) + r["o_orderkey"] % 8, r["o_orderkey"] % 5 + F.lit(0.5))).alias("track"))


STEPS = """st AS (SELECT o_custkey AS storm_id, row_number() OVER w - 1 AS step, o_orderdate AS ts, round(o_totalprice) / 1000 AS v, 36.0 + o_orderkey % 8 AS lat, o_orderkey % 5 + 0.5 AS lon FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


@query("e13_explode_tracks", "storm_id:i step:i ts:t size:d tot:d max:d mean:d speed:d lat:d lon:d", f"WITH {STEPS} SELECT storm_id, step, ts, v * 2 AS size, v AS tot, v / 2 AS max, v / 4 AS mean, CASE WHEN step = 0 THEN 0 ELSE v / 8 END AS speed, lat, lon FROM st")
def _(s, d):
    return events.explode_tracks(tracks(s, d))


@query("e14_storm_summary", "storm_id:i start:t duration:i max_size:d tot:d max:d mean:d mean_speed:d month:i", f"WITH {STEPS} SELECT storm_id, min(ts) AS start, count(*) AS duration, max(v * 2) AS max_size, sum(v) AS tot, max(v / 2) AS max, avg(v / 4) AS mean, avg(CASE WHEN step = 0 THEN 0 ELSE v / 8 END) AS mean_speed, month(min(ts)) AS month FROM st GROUP BY storm_id")
def _(s, d):
    return events.storm_summary(events.explode_tracks(tracks(s, d)))


@query("e15_renumber", "storm_id:i number:i", "WITH f AS (SELECT o_custkey AS storm_id, min(o_orderkey) AS k FROM orders GROUP BY ALL) SELECT storm_id, row_number() OVER (ORDER BY k) - 1 AS number FROM f")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("storm_id"), "o_orderkey")
    return events.renumber(o, "storm_id", "o_orderkey").select("storm_id", "number").distinct()


@query("e16_storms_per_month", "month:i n:i", f"WITH {STEPS}, f AS (SELECT storm_id, month(min(ts)) AS month FROM st GROUP BY storm_id) SELECT month, count(*) AS n FROM f GROUP BY month")
def _(s, d):
    return events.storm_summary(events.explode_tracks(tracks(s, d))).groupBy("month").agg(F.count("*").alias("n"))


@query("e17_objects", "ts:t object:i cells:i total:d center_y:d center_x:d", f"""WITH RECURSIVE {HOURLY}, w AS (SELECT ts, y, x, value FROM hourly WHERE value > 8),
r AS (SELECT ts, y, x, y * 5 + x AS root FROM w UNION SELECT b.ts, b.y, b.x, r.root FROM r JOIN w b ON b.ts = r.ts AND abs(b.y - r.y) + abs(b.x - r.x) = 1),
m AS (SELECT ts, y, x, min(root) AS root FROM r GROUP BY ALL), g AS (SELECT w.ts, root, count(*) AS cells, sum(value) AS total, sum(w.y * value) / sum(value) AS center_y, sum(w.x * value) / sum(value) AS center_x FROM w JOIN m ON w.ts = m.ts AND w.y = m.y AND w.x = m.x GROUP BY ALL)
SELECT ts, row_number() OVER (PARTITION BY ts ORDER BY root) - 1 AS object, cells, total, center_y, center_x FROM g""")
def _(s, d):
    return events.objects(hourly(s, d), 8.0)


@query("a02_distinct_days", "run:s cell:i days:i", "SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'present' ELSE 'future' END AS run, user_id % 25 AS cell, count(DISTINCT ts::DATE) AS days FROM events GROUP BY ALL")
def _(s, d):
    return cube(s, d).groupBy("run", "cell").agg(F.count_distinct(F.to_date("ts")).alias("days"))
