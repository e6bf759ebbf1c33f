"""Extreme values, and stochastic disaggregation with hashed draws."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.bins import searchsorted_bin
from ..operators import extremes, synthesis, timeagg
from ..plans import pipelines
from .distributions import BLOCK, hist, search, uniform
from .registry import DAILY, HOURLY, daily, hourly, query

_POT = f"{DAILY}, m AS (SELECT cell, year(ts) AS y, max(value) AS m FROM daily GROUP BY ALL), u AS (SELECT cell, min(m) AS u, count(*) AS years FROM m GROUP BY cell), x AS (SELECT daily.cell, ts, value - u AS excess, u, years, count(*) OVER (PARTITION BY daily.cell) / years AS lam FROM daily JOIN u ON u.cell = daily.cell WHERE value >= u)"


@query("s11_peaks_over_threshold", "cell:s ts:t u:d years:i excess:d lam:d", f"WITH {_POT} SELECT * FROM x")
def _(s, d):
    return extremes.peaks_over_threshold(daily(s, d), ["cell"])


@query("s12_gpd_fit", "cell:s n:i xi:d sigma:d")
def _(s, d):
    return extremes.fit_gpd(extremes.peaks_over_threshold(daily(s, d), ["cell"]), ["cell"])


@query("s13_spatial_bootstrap", "sample:i ts:t value:d", f"WITH {HOURLY}, k AS (SELECT s.sample, h.ts, floor({uniform(chr(39) + '42' + chr(39), 's.sample::VARCHAR', 'strftime(h.ts, ' + chr(39) + '%Y%m%d%H' + chr(39) + ')')} * 25)::BIGINT AS cell FROM (SELECT DISTINCT ts FROM hourly) h, (SELECT unnest(range(5)) AS sample) s) SELECT sample, k.ts, value FROM k JOIN hourly ON hourly.ts = k.ts AND hourly.cell = k.cell")
def _(s, d):
    return extremes.spatial_bootstrap(hourly(s, d), [], 25, 5)


@query("s14_return_levels", "cell:s level:d", f"WITH {_POT} SELECT cell, any_value(u) + 5.0 / 0.1 * (pow(any_value(lam) * 100, 0.1) - 1) AS level FROM x GROUP BY cell")
def _(s, d):
    p = extremes.peaks_over_threshold(daily(s, d), ["cell"]).select("cell", "u", "lam").distinct()
    return p.withColumn("level", extremes.gpd_return_level(F.col("u"), F.lit(5.0), F.lit(0.1), F.col("lam"), 100))


_LM = f"{DAILY}, m AS (SELECT cell, year(ts) * 100 + month(ts) AS y, max(value) AS x FROM daily GROUP BY ALL), r AS (SELECT cell, x, row_number() OVER (PARTITION BY cell ORDER BY x)::DOUBLE AS i, count(*) OVER (PARTITION BY cell)::DOUBLE AS n FROM m), b AS (SELECT cell, avg(x) AS b0, avg(x * (i - 1) / (n - 1)) AS b1, avg(x * (i - 1) * (i - 2) / ((n - 1) * (n - 2))) AS b2 FROM r GROUP BY cell), l AS (SELECT cell, b0 AS l1, 2 * b1 - b0 AS l2, 6 * b2 - 6 * b1 + b0 AS l3 FROM b)"


def _maxima(s, d):
    return daily(s, d).groupBy("cell", (F.year("ts") * 100 + F.month("ts")).alias("y")).agg(F.max("value").alias("largest"))


@query("s15_l_moments", "cell:s l1:d l2:d l3:d", f"WITH {_LM} SELECT * FROM l")
def _(s, d):
    return extremes.l_moments(_maxima(s, d), ["cell"], "largest")


@query("s15b_gev_l_moments", "cell:s mu:d sigma:d xi:d level:d", f"WITH {_LM}, c AS (SELECT *, 2 / (3 + l3 / l2) - ln(2) / ln(3) AS c FROM l), k AS (SELECT *, 7.8590 * c + 2.9554 * c * c AS k FROM c), g AS (SELECT *, gamma(1 + k) AS g FROM k), s AS (SELECT *, l2 * k / ((1 - pow(2.0, -k)) * g) AS sigma FROM g), f AS (SELECT cell, l1 - sigma * (1 - g) / k AS mu, sigma, -k AS xi FROM s) SELECT *, mu + sigma / xi * (pow(-ln(1 - 1 / 50.0), -xi) - 1) AS level FROM f")
def _(s, d):
    f = extremes.gev_from_l_moments(extremes.l_moments(_maxima(s, d), ["cell"], "largest"), ["cell"])
    return f.withColumn("level", extremes.gev_return_level(F.col("mu"), F.col("sigma"), F.col("xi"), 50))


@query("s16_gev_fit", "cell:s n:i mu:d sigma:d xi:d")
def _(s, d):
    return extremes.fit_gev(_maxima(s, d), ["cell"])


@query("s18_idf_bootstrap", "cell:s years:d low:d mid:d high:d")
def _(s, d):
    return extremes.idf_bootstrap(_maxima(s, d), ["cell"], [2, 10, 50], 100)


@query("s19_kolmogorov_smirnov", "cell:s d:d n:i", f"WITH {DAILY}, r AS (SELECT cell, 1 - exp(-value / 300) AS f, row_number() OVER (PARTITION BY cell ORDER BY value) AS i, count(*) OVER (PARTITION BY cell) AS n FROM daily) SELECT cell, max(greatest(i / n - f, f - (i - 1) / n)) AS d, count(*) AS n FROM r GROUP BY cell")
def _(s, d):
    return extremes.kolmogorov_smirnov(daily(s, d), ["cell"], lambda x: 1 - F.exp(-x / 300))


@query("s19b_qq", "cell:s ts:t theoretical:d", f"WITH {DAILY}, r AS (SELECT cell, ts, (row_number() OVER (PARTITION BY cell ORDER BY value, ts) - 0.5) / count(*) OVER (PARTITION BY cell) AS p FROM daily) SELECT cell, ts, -300 * ln(1 - p) AS theoretical FROM r")
def _(s, d):
    x = daily(s, d).withColumn("v", F.struct("value", "ts"))
    return extremes.qq(x, ["cell"], lambda p: -300 * F.log(1 - p), "v")


@query("s21_regional_maxima", "cluster_id:i block:i largest:d", f"WITH {HOURLY}, p AS (SELECT *, cell % 3 AS cluster_id, row_number() OVER (PARTITION BY cell ORDER BY ts) - 1 AS i FROM hourly), b AS (SELECT cluster_id, cell, i // 24 AS j, sum(value) AS total FROM p GROUP BY ALL) SELECT cluster_id, j // 10 AS block, max(total) AS largest FROM b GROUP BY ALL")
def _(s, d):
    h = hourly(s, d).withColumn("cluster_id", F.col("cell") % 3)
    return timeagg.coarsen_sum_max(h, ["cluster_id", "cell"], 24, 10).groupBy("cluster_id", "block").agg(F.max("largest").alias("largest"))


_LIB = f"""{HOURLY}, w AS (SELECT cell, ts::DATE AS day, dense_rank() OVER (PARTITION BY cell ORDER BY ts::DATE) - 1 AS block, round(sum(value), 6) AS total, list(value ORDER BY ts) AS steps, count(CASE WHEN value > 0.1 THEN 1 END) AS n_wet FROM hourly GROUP BY cell, ts::DATE),
lib AS (SELECT cell, block, total, steps, {search("total", C.BINS_LOW_FINE)} AS bin_low FROM w WHERE total >= 1 AND n_wet > 0), lb AS (SELECT *, row_number() OVER (PARTITION BY bin_low ORDER BY cell, block) - 1 AS idx, count(*) OVER (PARTITION BY bin_low) AS n FROM lib)"""


def _library(s, d):
    lib = synthesis.analog_library(hourly(s, d), ["cell"], C.BINS_LOW_FINE, 24).withColumn("total", F.round("total", 6))
    return lib.withColumn("bin_low", searchsorted_bin(F.col("total"), C.BINS_LOW_FINE)).drop("idx", "n").withColumns({"idx": F.row_number().over(Window.partitionBy("bin_low").orderBy("cell", "block")) - 1, "n": F.count("*").over(Window.partitionBy("bin_low"))})


@query("b09_analog_library", "cell:i block:i bin_low:i idx:i n:i total:d peak:d", f"WITH {_LIB} SELECT cell, block, bin_low, idx, n, total, list_max(steps) AS peak FROM lb")
def _(s, d):
    return _library(s, d).withColumn("peak", F.array_max("steps"))


@query("b05_analog_method", "cell:i block:i idx:i total:d peak:d mass:d", f"WITH {_LIB}, c AS (SELECT bin_low, count(*) AS n FROM lb GROUP BY ALL), q AS (SELECT a.cell, a.block, a.bin_low, a.total * 1.1 AS total, floor({uniform(chr(39) + '42' + chr(39), chr(39) + 'analog' + chr(39), 'a.cell::VARCHAR', 'a.block::VARCHAR')} * c.n)::BIGINT AS idx FROM lb a JOIN c USING (bin_low)) SELECT q.cell, q.block, q.idx, q.total, list_max(l.steps) * q.total / l.total AS peak, list_sum(l.steps) * q.total / l.total AS mass FROM q JOIN lb l ON l.bin_low = q.bin_low AND l.idx = q.idx")
def _(s, d):
    lib = _library(s, d)
    days = lib.select("cell", "block", "bin_low", (F.col("total") * F.lit(1.1)).alias("total"))
    m = synthesis.method_analog(days, lib, None, [F.col("cell"), F.col("block")])
    return m.withColumns({"peak": F.array_max("steps"), "mass": F.aggregate("steps", F.lit(0.0), lambda a, v: a + v)})


@query("b04_max_method", "cell:i block:i bin_high:i largest:d", f"""WITH {BLOCK}, k AS (SELECT bin_low, {hist("largest", C.BINS_HIGH)} AS bin_high, count(*) AS cnt FROM b WHERE n_wet > 0 GROUP BY ALL), p AS (SELECT bin_low, bin_high, sum(cnt / t) OVER (PARTITION BY bin_low ORDER BY bin_high ROWS UNBOUNDED PRECEDING) AS cdf FROM (SELECT *, sum(cnt) OVER (PARTITION BY bin_low) AS t FROM k)),
h AS (SELECT bin_low, count(CASE WHEN n_wet > 0 THEN 1 END) / count(*) AS p_has_wet FROM b GROUP BY bin_low), e AS (SELECT unnest([{", ".join(map(repr, C.BINS_HIGH[:-1]))}]) AS lo, unnest([{", ".join("'infinity'::DOUBLE" if x == C.INF else repr(x) for x in C.BINS_HIGH[1:])}]) AS hi, unnest(range({len(C.BINS_HIGH) - 1})) AS bin_high),
q AS (SELECT b.cell, date_diff('day', DATE '2024-01-01', b.block) AS block, b.bin_low, round(b.total, 6) AS total FROM b JOIN h USING (bin_low)), z AS (SELECT *, {uniform("'42'", "'wet'", "cell::VARCHAR", "block::VARCHAR")} AS u0, {uniform("'42'", "'bin'", "cell::VARCHAR", "block::VARCHAR")} AS u1, {uniform("'42'", "'value'", "cell::VARCHAR", "block::VARCHAR")} AS u2 FROM q),
y AS (SELECT z.cell, z.block, z.total, z.u2, coalesce(min(CASE WHEN round(p.cdf, 9) >= u1 THEN p.bin_high END), max(p.bin_high)) AS bin_high FROM z JOIN h ON h.bin_low = z.bin_low JOIN p ON p.bin_low = z.bin_low WHERE u0 < p_has_wet GROUP BY z.cell, z.block, z.total, z.u2)
SELECT cell, block, y.bin_high, least(greatest(CASE WHEN isinf(hi) THEN lo - 5 * ln(1 - u2) ELSE lo + u2 * (hi - lo) END, 0.1), total) AS largest FROM y JOIN e ON e.bin_high = y.bin_high""")
def _(s, d):
    b = pipelines.blocks_with_bins(hourly(s, d), ["cell"])
    b = b.withColumns({"block": F.when(F.col("run") == "future", F.col("block") + 15).otherwise(F.col("block")), "total": F.round("total", 6)})
    from ..functions.bins import hist_bin
    from ..operators.dist import cumulative, wet_chance

    k = b.where("n_wet > 0").withColumn("bin_high", hist_bin(F.col("largest"), C.BINS_HIGH)).groupBy("bin_low", "bin_high").agg(F.count("*").alias("cnt"))
    cdf = cumulative(k.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("bin_low"))), ["bin_low"]).withColumn("cdf", F.round("cdf", 9))
    return synthesis.method_max(b.select("cell", "block", "bin_low", "total"), cdf, wet_chance(b, []), C.BINS_HIGH, [F.col("cell"), F.col("block")])


_DAYS = f"""{HOURLY}, w AS (SELECT cell, ts::DATE AS day, round(sum(value), 6) AS total FROM hourly GROUP BY ALL), dy AS (SELECT cell, row_number() OVER (PARTITION BY cell ORDER BY day) - 1 AS day_no, total FROM w WHERE total >= 1), ce AS (SELECT cell, count(*) AS n_days, row_number() OVER (ORDER BY cell) - 1 AS cell_no FROM dy GROUP BY cell)"""


def _days(s, d):
    w = timeagg.resample(hourly(s, d), ["cell"], "day").withColumn("total", F.round("value", 6)).where("total >= 1")
    return w.select("cell", (F.row_number().over(Window.partitionBy("cell").orderBy("ts")) - 1).cast("long").alias("day_no"), "total")


@query("b06_block_bootstrap", "sample:i draw:i d:i cell:i day_no:i total:d", f"""WITH {_DAYS}, n AS (SELECT count(*) AS n FROM ce), p AS (SELECT s.sample, ce.cell_no AS draw, floor({uniform("'42'", "'pixel'", "s.sample::VARCHAR", "ce.cell_no::VARCHAR")} * n)::BIGINT AS k FROM ce, n, (SELECT unnest(range(3)) AS sample) s),
q AS (SELECT sample, draw, cell, n_days, unnest(range(n_days)) AS d FROM p JOIN ce ON ce.cell_no = p.k), r AS (SELECT *, floor({uniform("'42'", "'day'", "sample::VARCHAR", "draw::VARCHAR", "d::VARCHAR")} * n_days)::BIGINT AS day_no FROM q) SELECT sample, draw, d, r.cell, r.day_no, total FROM r JOIN dy ON dy.cell = r.cell AND dy.day_no = r.day_no""")
def _(s, d):
    days = _days(s, d)
    cells = days.groupBy("cell").agg(F.count("*").alias("n_days")).withColumn("cell_no", F.row_number().over(Window.orderBy("cell")) - 1)
    return synthesis.block_bootstrap(days, cells, 3)


@query("b11_confidence", "q:d bootstrap_q:d hourly:d dmax:d")
def _(s, d):
    return pipelines.synthetic_future(hourly(s, d), _days(s, d), [0.5, 0.9, 0.99], 20, [0.025, 0.5, 0.975])


@query("b13_bias", "kind:s days:i mass:d mass_error:d mean_n_wet:d mean_intensity:d mean_max:d")
def _(s, d):
    lib = _library(s, d)
    syn = synthesis.method_analog(lib.select("cell", "block", "bin_low", "total"), lib, None, [F.col("cell"), F.col("block")])
    return synthesis.bias(lib, syn)


@query("b02_step_sampler", "cell:i sample:i day_no:i total:d mass:d")
def _(s, d):
    days = _days(s, d).withColumn("bin_low", searchsorted_bin(F.col("total"), C.BINS_LOW_COARSE))
    n = len(C.BINS_HIGH) - 1
    flat = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i / F.lit(float(n)))
    dist = days.select("bin_low").distinct().withColumns({"n_wet_cdf": F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: i / F.lit(24.0)), "value_cdf": flat, "max_cdf": flat, "p_has_wet": F.lit(0.95)})
    m = synthesis.method_steps(days, dist, C.BINS_HIGH, 24, 2)
    return m.withColumn("mass", F.aggregate("steps", F.lit(0.0), lambda a, v: a + v))


