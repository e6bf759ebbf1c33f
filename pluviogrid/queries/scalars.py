"""Scalar functions: physics, the sphere, strings, dates, records."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import physics as P
from ..functions import text_dates as D
from .registry import cube, query, table

_PTS = "p AS (SELECT s_suppkey AS k, 36.2 + (s_suppkey % 60) * 0.1 AS lat, -1.9 + (s_suppkey % 53) * 0.11 AS lon FROM supplier)"


def _pts(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(k.alias("k"), (36.2 + (k % 60) * F.lit(0.1)).alias("lat"), (-1.9 + (k % 53) * F.lit(0.11)).alias("lon"))


_H = "2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(39.56 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(39.56)) * pow(sin(radians(2.74 - lon) / 2), 2), 1.0)))"
_L = "6371000.0 * acos(greatest(-1.0, least(1.0, sin(radians(lat)) * sin(radians(39.56)) + cos(radians(lat)) * cos(radians(39.56)) * cos(radians(2.74 - lon)))))"


@query("f01_sphere", "k:i hav_km:d cos_km:d ux:d uy:d uz:d wrapped:d east:d suffix:s line:d", f"WITH {_PTS} SELECT k, round({_H} / 1000, 3) AS hav_km, round({_L} / 1000, 3) AS cos_km, cos(radians(lat)) * cos(radians(lon)) AS ux, cos(radians(lat)) * sin(radians(lon)) AS uy, sin(radians(lat)) AS uz, round(lon * 50 + 180 - 360 * floor((lon * 50 + 180) / 360) - 180, 4) AS wrapped, round(lon - 360 * floor(lon / 360), 4) AS east, lpad((k // 3)::VARCHAR, 3, '0') || 'y-' || lpad((k // 2)::VARCHAR, 3, '0') || 'x' AS suffix, 1.0 + (lat - 36) * (5.0 - 1.0) / (44.0 - 36) AS line FROM p")
def _(s, d):
    lat, lon, k = F.col("lat"), F.col("lon"), F.col("k")
    x, y, z = P.unit_xyz(lat, lon)
    return _pts(s, d).select("k", F.round(P.haversine(lat, lon, F.lit(39.56), F.lit(2.74)) / 1000, 3).alias("hav_km"), F.round(P.cosine_distance(lat, lon, F.lit(39.56), F.lit(2.74)) / 1000, 3).alias("cos_km"), x.alias("ux"), y.alias("uy"), z.alias("uz"), F.round(P.wrap_lon(lon * 50), 4).alias("wrapped"), F.round(P.wrap_lon(lon, 0.0), 4).alias("east"), P.tile_suffix(F.floor(k / 3), F.floor(k / 2), 1).alias("suffix"), P.line_through(lat, F.lit(36.0), F.lit(1.0), F.lit(44.0), F.lit(5.0)).alias("line"))


_V = "v AS (SELECT event_id, 250 + value / 6 AS t2, value / 20000 + 0.001 AS q2, 90000 + value * 20 AS psfc, value / 25 - 6 AS u, event_id % 13 - 6.5 AS v, 200 + value / 8 AS td FROM events)"
_T = "(t2 - 273.15)"
_E = "(q2 * psfc / (0.62197 + q2))"
_ES = f"(CASE WHEN {_T} <= 0 THEN 6.1078 * pow(10.0, {_T} * 9.5 / ({_T} + 265.5)) ELSE 6.1078 * pow(10.0, {_T} * 7.5 / ({_T} + 237.3)) END)"


def _weather(s, d):
    v = F.col("value")
    return table(s, d, "events").select("event_id", (250 + v / 6).alias("t2"), (v / 20000 + 0.001).alias("q2"), (90000 + v * 20).alias("psfc"), (v / 25 - 6).alias("u"), (F.col("event_id") % 13 - 6.5).alias("v"), (200 + v / 8).alias("td"))


@query("f15_humidity", "event_id:i e:d es:d rh:d vpd:d wbgt:d at:d dew:d huss:d", f"WITH {_V} SELECT event_id, {_E} AS e, {_ES} AS es, {_E} / 100 / {_ES} * 100 AS rh, {_ES} - {_E} / 100 AS vpd, 0.567 * {_T} + 0.393 * {_E} / 100 + 3.94 AS wbgt, {_T} + 0.33 * {_E} / 100 - 0.7 * 3 + 4.0 AS at, 243.5 * ln({_E} / 611.2) / (17.67 - ln({_E} / 611.2)) + 273.15 AS dew, q2 / (1 + q2) AS huss FROM v")
def _(s, d):
    t, q, p = F.col("t2"), F.col("q2"), F.col("psfc")
    e = P.vapour_pressure(p, q)
    return _weather(s, d).select("event_id", e.alias("e"), P.saturation_pressure_hpa(t).alias("es"), P.relative_humidity(p, t, q).alias("rh"), P.vapour_pressure_deficit_hpa(p, t, q).alias("vpd"), P.wet_bulb_globe(t, e).alias("wbgt"), P.apparent_temperature(t, e, F.lit(3.0)).alias("at"), P.dew_point(e).alias("dew"), P.specific_humidity(q).alias("huss"))


_WS = f"(0.62197 * {_ES} * 100 / (psfc - {_ES} * 100))"


@query("f19_lapse_wind", "event_id:i lapse:d rh_td:d speed:d direction:d rate:d zg:d vort:d", f"WITH {_V} SELECT event_id, 9.81 / (7.0 * 287.04 / 2.0) * (1 + 2.501e6 * {_WS} / (287.04 * t2)) / (1 + 2.501e6 * 2.501e6 * {_WS} * 0.62197 / ((7.0 * 287.04 / 2.0) * 287.04 * t2 * t2)) AS lapse, round(100 * exp(17.67 * (td - 273.15) / (td - 273.15 + 243.5)) / exp(17.67 * (t2 - 273.15) / (t2 - 273.15 + 243.5)), 4) AS rh_td, sqrt(u * u + v * v) AS speed, round(270 - atan2(v, u) * 180 / {math.pi!r} - 360 * floor((270 - atan2(v, u) * 180 / {math.pi!r}) / 360), 5) AS direction, u / 600 AS rate, psfc / 9.81 AS zg, u / 1000 - 2 * 7.2921e-5 * sin(radians(40.0)) AS vort FROM v")
def _(s, d):
    t, u, v = F.col("t2"), F.col("u"), F.col("v")
    return _weather(s, d).select("event_id", P.moist_lapse_rate(F.col("psfc"), t).alias("lapse"), F.round(P.humidity_from_dew_point(F.col("td"), t), 4).alias("rh_td"), P.wind_speed(u, v).alias("speed"), F.round(P.wind_direction(u, v), 5).alias("direction"), P.rain_rate(u, 10).alias("rate"), P.geopotential_height(F.col("psfc")).alias("zg"), P.relative_vorticity(u / 1000, F.lit(40.0)).alias("vort"))


@query("f22_wind_rose", "sector:i speed_bin:i n:i", f"WITH {_V}, w AS (SELECT floor((round(270 - atan2(v, u) * 180 / {math.pi!r} - 360 * floor((270 - atan2(v, u) * 180 / {math.pi!r}) / 360), 5) + 22.5) / 45)::BIGINT % 8 AS sector, floor(round(sqrt(u * u + v * v), 6) / 2.5)::BIGINT AS speed_bin FROM v) SELECT sector, speed_bin, count(*) AS n FROM w GROUP BY ALL")
def _(s, d):
    w = _weather(s, d)
    sector = F.floor((F.round(P.wind_direction(F.col("u"), F.col("v")), 5) + 22.5) / 45) % 8
    return w.groupBy(sector.alias("sector"), F.floor(F.round(P.wind_speed(F.col("u"), F.col("v")), 6) / 2.5).alias("speed_bin")).agg(F.count("*").alias("n"))


@query("f24_change_gauss", "event_id:i change:d gauss:d perturbed:d total:d", f"WITH {_V} SELECT event_id, 100 * (t2 - td) / nullif(td, 0) AS change, exp(-pow((u - 1) / 3.0, 2) / 2) / (3.0 * sqrt(2 * {math.pi!r})) AS gauss, greatest(u + CASE WHEN event_id % 3 = 0 THEN 0 ELSE v END, 0.0) AS perturbed, u + CASE WHEN event_id % 3 = 0 THEN 0 ELSE v END AS total FROM v")
def _(s, d):
    c = F.when(F.col("event_id") % 3 != 0, F.col("v").cast("double"))
    return _weather(s, d).select("event_id", P.relative_change(F.col("t2"), F.col("td")).alias("change"), P.gaussian(F.col("u"), 1.0, 3.0).alias("gauss"), P.perturbed(F.col("u"), c, 0.0).alias("perturbed"), P.total_rain(F.col("u"), c).alias("total"))


@query("f27_registry", "event_id:i RH2:d WSPD:d HUSS:d", f"WITH {_V} SELECT event_id, {_E} / 100 / {_ES} * 100 AS \"RH2\", sqrt(u * u + v * v) AS \"WSPD\", q2 / (1 + q2) AS \"HUSS\" FROM v")
def _(s, d):
    w = _weather(s, d)
    for name in ("RH2", "WSPD", "HUSS"):
        w = P.compute(w, name)
    return w


@query("f30_strings", "k:i day:D lon:d lat:d slug:s km:i file_day:D", "WITH z AS (SELECT o_orderkey AS k, o_orderdate AS t, (o_orderkey % 60) AS m FROM orders) SELECT k, t::DATE AS day, round(CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END * (m % 20 + m / 60.0 + (59 - m) / 3600.0), 3) AS lon, round(35 + m % 9 + m / 60.0 + (59 - m) / 3600.0, 3) AS lat, 'palma_' || k::VARCHAR || '_son' AS slug, (k % 30)::INT AS km, t::DATE AS file_day FROM z")
def _(s, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    m = k % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    lon = F.concat(two(m % 20), two(m), two(59 - m), F.when(k % 2 == 1, "2").otherwise("1")).cast("int")
    lat = F.concat(two(35 + m % 9), two(m), two(59 - m)).cast("int")
    return table(s, d, "orders").select(k.alias("k"), D.padded_date(F.year(t), F.month(t), F.day(t)).alias("day"), D.packed_degrees(lon).alias("lon"), D.packed_degrees(lat, lon=False).alias("lat"), D.slug(F.concat(F.lit("Pálma "), k.cast("string"), F.lit(" (Són)"))).alias("slug"), D.resolution_km(F.concat(F.lit("RUN_"), (k % 30).cast("string"), F.lit("km_ERA"))).alias("km"), D.file_date(F.concat(F.lit("out_d01_"), F.date_format(t, "yyyy-MM-dd"), F.lit("_00:00:00"))).alias("file_day"))


@query("f35_dates", "k:i season:s month_end:D mid:t back:t text:s", "WITH z AS (SELECT o_orderkey AS k, o_orderdate AS t, date_trunc('month', o_orderdate)::TIMESTAMP AS m FROM orders) SELECT k, CASE WHEN month(t) IN (12, 1, 2) THEN 'DJF' WHEN month(t) <= 5 THEN 'MAM' WHEN month(t) <= 8 THEN 'JJA' ELSE 'SON' END AS season, last_day(t) AS month_end, m + to_hours(date_diff('day', m, m + INTERVAL 1 MONTH) * 12) AS mid, t AS back, strftime(t, '%Y-%m-%d_%H:%M:%S') AS text FROM z")
def _(s, d):
    t = F.col("o_orderdate").cast("timestamp_ntz")
    text = D.model_time_text(t)
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"), D.season(t).alias("season"), D.month_end(t).alias("month_end"), D.mid_month(F.year(t), F.month(t)).alias("mid"), D.model_time(text).alias("back"), text.alias("text"))


@query("f40_json", "event_id:i k:i number:d", "SELECT event_id, (props->>'k')::BIGINT AS k, CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 7 = 1 THEN NULL ELSE (event_id % 50) + 0.5 END AS number FROM events")
def _(s, d):
    e = F.col("event_id")
    text = F.when(e % 7 == 0, "Ip").when(e % 7 == 1, "Acum").otherwise(F.concat((e % 50).cast("string"), F.lit(",5")))
    return table(s, d, "events").select("event_id", D.json_field(F.col("props"), "k").alias("k"), D.spanish_number(text).alias("number"))


@query("f38_arrays", "cell:i n:i first:d last:d total:d", "WITH c AS (SELECT user_id % 25 AS cell, ts, event_id, CAST(round(value * 100) AS BIGINT) / 1000.0 AS value FROM events) SELECT cell, count(*) AS n, (list(value ORDER BY ts, value))[1] AS first, (list(value ORDER BY ts, value))[-1] AS last, sum(value) AS total FROM c GROUP BY cell")
def _(s, d):
    a = cube(s, d).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("a"))
    v = F.transform("a", lambda r: r["value"])
    return a.select("cell", F.size("a").alias("n"), F.element_at(v, 1).alias("first"), F.element_at(v, -1).alias("last"), F.aggregate(v, F.lit(0.0), lambda x, y: x + y).alias("total"))
