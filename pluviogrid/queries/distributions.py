"""Histograms, conditional probabilities, quantiles, concentration."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions.bins import hist_bin, searchsorted_bin
from ..operators import dist
from ..plans import pipelines
from .registry import CUBE, HOURLY, cube, hourly, query
from .spells import SPELL


def edges(e) -> str:
    return "[" + ", ".join("'infinity'::DOUBLE" if x == C.INF else repr(float(x)) for x in e) + "]"


def hist(v: str, e) -> str:
    """SQL of a histogram bin."""
    last = "'infinity'::DOUBLE" if e[-1] == C.INF else repr(float(e[-1]))
    return f"CASE WHEN {v} < {float(e[0])!r} OR {v} > {last} THEN NULL WHEN {v} = {last} THEN {len(e) - 2} ELSE len(list_filter({edges(e)}, lambda q: q <= {v})) - 1 END"


def search(v: str, e) -> str:
    return f"least(len(list_filter({edges(e[1:])}, lambda q: q < {v})), {len(e) - 2})"


BLOCK = f"""{HOURLY}, b0 AS (SELECT run, cell, y, x, ts::DATE AS block, sum(value) AS total, max(value) AS largest, count(CASE WHEN value >= 0.1 THEN 1 END) AS n_wet, sum(CASE WHEN value >= 0.1 THEN value ELSE 0 END) AS wet_total FROM hourly GROUP BY ALL),
b AS (SELECT *, {hist("total", C.BINS_LOW_FINE)} AS bin_low FROM b0 WHERE total >= 1)"""


@query("m01_bins", "cell:i value:d a:i b:i c:i", f"WITH {CUBE} SELECT DISTINCT cell, value, {hist('value', C.BINS_HIGH)} AS a, len(list_filter({edges(C.BINS_LOW_FINE)}, lambda q: q <= value)) - 1 AS b, {search('value', C.BINS_LOW_FINE)} AS c FROM cube")
def _(s, d):
    from ..functions.bins import digitize_bin

    v = F.col("value")
    return cube(s, d).select("cell", "value", hist_bin(v, C.BINS_HIGH).alias("a"), digitize_bin(v, C.BINS_LOW_FINE).alias("b"), searchsorted_bin(v, C.BINS_LOW_FINE).alias("c")).distinct()


@query("h01_histogram", "run:s cell:i bin:i cnt:i", f"WITH {CUBE}, z AS (SELECT run, cell, {hist('value', C.IFD_INTENSITY)} AS bin FROM cube) SELECT run, cell, bin, count(*) AS cnt FROM z WHERE bin IS NOT NULL GROUP BY ALL")
def _(s, d):
    return dist.histogram(cube(s, d), ["run", "cell"], C.IFD_INTENSITY)


@query("h02_spell_histogram", "run:s bin_a:i bin_b:i cnt:i", f"""WITH {HOURLY}, f AS (SELECT *, value >= 1 AS wet, coalesce(lag(value >= 1) OVER w <> (value >= 1), TRUE) AS is_start FROM hourly WINDOW w AS (PARTITION BY run, cell ORDER BY ts)), s AS (SELECT *, sum(is_start::INT) OVER (PARTITION BY run, cell ORDER BY ts ROWS UNBOUNDED PRECEDING) AS event FROM f),
e AS (SELECT run, cell, event, count(*) AS duration, round(sum(value), 6) AS total FROM s WHERE wet GROUP BY ALL), z AS (SELECT run, {hist("duration", C.IFD_DURATION)} AS bin_a, {hist("total", C.IFD_INTENSITY)} AS bin_b FROM e) SELECT run, bin_a, bin_b, count(*) AS cnt FROM z WHERE bin_a IS NOT NULL AND bin_b IS NOT NULL GROUP BY ALL""")
def _(s, d):
    from ..operators import events, timeagg

    e = events.event_table(hourly(s, d), ["run", "cell"]).withColumn("total", F.round("total", 6))
    return timeagg.spatial_sum(dist.histogram2d(e, ["run", "cell"], "duration", C.IFD_DURATION, "total", C.IFD_INTENSITY), ["run", "bin_a", "bin_b"])


def _rolled(within: bool) -> str:
    parts = " UNION ALL ".join(f"SELECT cell, ts, wet, dur, {n} AS duration, CASE WHEN count(*) OVER w = {n} THEN round(sum(value) OVER w, 6) END AS rolled FROM g WINDOW w AS (PARTITION BY cell ORDER BY ts ROWS {n - 1} PRECEDING)" for n in (1, 3, 6, 24))
    extra = " AND wet AND dur >= duration" if within else ""
    return f"WITH {SPELL}, g AS (SELECT *, count(*) OVER (PARTITION BY cell, event) AS dur FROM s), r AS ({parts}), z AS (SELECT cell, duration, {hist('rolled', C.IFD_INTENSITY)} AS bin FROM r WHERE rolled >= 1{extra}) SELECT cell, duration, bin, count(*) AS cnt FROM z WHERE bin IS NOT NULL GROUP BY ALL"


@query("h03_rolling_histograms", "cell:i duration:i bin:i cnt:i", _rolled(False))
def _(s, d):
    return dist.rolling_histograms(hourly(s, d), ["cell"], [1, 3, 6, 24], C.IFD_INTENSITY)


@query("h04_rolling_in_events", "cell:i duration:i bin:i cnt:i", _rolled(True))
def _(s, d):
    return dist.rolling_histograms(hourly(s, d), ["cell"], [1, 3, 6, 24], C.IFD_INTENSITY, within_events=True)


_STEP = f"{BLOCK}, st AS (SELECT h.run, h.cell, b.bin_low, {hist('h.value', C.BINS_HIGH)} AS bin_high FROM hourly h JOIN b ON b.run = h.run AND b.cell = h.cell AND b.block = h.ts::DATE WHERE h.value >= 0.1)"


@query("h05_conditional_steps", "run:s cell:i bin_low:i bin_high:i cnt:i p:d", f"WITH {_STEP}, c AS (SELECT run, cell, bin_low, bin_high, count(*) AS cnt FROM st GROUP BY ALL) SELECT *, cnt / sum(cnt) OVER (PARTITION BY run, cell, bin_low) AS p FROM c")
def _(s, d):
    return pipelines.conditional_tables(hourly(s, d), ["cell"])[0]


@query("h06_conditional_n_wet", "run:s cell:i bin_low:i bin_high:i cnt:i p:d", f"WITH {BLOCK}, c AS (SELECT run, cell, bin_low, n_wet AS bin_high, count(*) AS cnt FROM b WHERE n_wet > 0 GROUP BY ALL) SELECT *, cnt / sum(cnt) OVER (PARTITION BY run, cell, bin_low) AS p FROM c")
def _(s, d):
    return pipelines.conditional_tables(hourly(s, d), ["cell"])[1]


@query("h07_conditional_max", "run:s cell:i bin_low:i bin_high:i cnt:i p:d", f"WITH {BLOCK}, c AS (SELECT run, cell, bin_low, {hist('largest', C.BINS_HIGH)} AS bin_high, count(*) AS cnt FROM b WHERE n_wet > 0 GROUP BY ALL) SELECT *, cnt / sum(cnt) OVER (PARTITION BY run, cell, bin_low) AS p FROM c")
def _(s, d):
    return pipelines.conditional_tables(hourly(s, d), ["cell"])[2]


@query("h08_wet_chance", "run:s bin_low:i p_has_wet:d n_events:i", f"WITH {BLOCK} SELECT run, bin_low, count(CASE WHEN n_wet > 0 THEN 1 END) / count(*) AS p_has_wet, count(*) AS n_events FROM b GROUP BY ALL")
def _(s, d):
    return dist.wet_chance(pipelines.blocks_with_bins(hourly(s, d), ["cell"]), ["run"])


_COUNTS = f"{BLOCK}, k AS (SELECT run, y, x, bin_low, {hist('largest', C.BINS_HIGH)} AS bin_high, count(*) AS cnt FROM b WHERE n_wet > 0 GROUP BY ALL)"
_CLIP = "n AS (SELECT k.*, k.y + dy AS cy, k.x + dx AS cx FROM k, (SELECT unnest([-1, 0, 1]) AS dy) a, (SELECT unnest([-1, 0, 1]) AS dx) c WHERE k.y + dy BETWEEN 0 AND 4 AND k.x + dx BETWEEN 0 AND 4)"


def _counts(s, d):
    b = pipelines.blocks_with_bins(hourly(s, d), ["y", "x"]).where("n_wet > 0")
    return b.withColumn("bin_high", hist_bin(F.col("largest"), C.BINS_HIGH)).groupBy("run", "y", "x", "bin_low", "bin_high").agg(F.count("*").alias("cnt"))


@query("h09_pooled_histograms", "run:s cy:i cx:i bin_low:i bin_high:i cnt:i p:d", f"WITH {_COUNTS}, {_CLIP}, g AS (SELECT run, cy, cx, bin_low, bin_high, sum(cnt)::BIGINT AS cnt FROM n GROUP BY ALL) SELECT *, cnt / sum(cnt) OVER (PARTITION BY run, cy, cx, bin_low) AS p FROM g")
def _(s, d):
    return dist.pooled_conditional(_counts(s, d), 1, 5, 5, ["run"])


@query("h10_pooled_density", "run:s cy:i cx:i bin_low:i bin_high:i p:d", f"""WITH {_COUNTS}, q AS (SELECT *, sum(cnt) OVER (PARTITION BY run, y, x, bin_low) AS n_events, cnt / sum(cnt) OVER (PARTITION BY run, y, x, bin_low) AS p FROM k),
o AS (SELECT cy, cx, least(greatest(cy + dy, 0), 4) AS y, least(greatest(cx + dx, 0), 4) AS x FROM (SELECT unnest(range(5)) AS cy) a, (SELECT unnest(range(5)) AS cx) b, (SELECT unnest([-1, 0, 1]) AS dy) c, (SELECT unnest([-1, 0, 1]) AS dx) e),
num AS (SELECT run, cy, cx, bin_low, bin_high, sum(p * n_events) AS a FROM o JOIN q USING (y, x) GROUP BY ALL), den AS (SELECT run, cy, cx, bin_low, sum(n_events) AS z FROM o JOIN (SELECT DISTINCT run, y, x, bin_low, n_events FROM q) USING (y, x) GROUP BY ALL)
SELECT num.run, num.cy, num.cx, num.bin_low, bin_high, a / z AS p FROM num JOIN den USING (run, cy, cx, bin_low)""")
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("run", "y", "x", "bin_low")
    k = _counts(s, d).withColumns({"n_events": F.sum("cnt").over(w), "p": F.col("cnt") / F.sum("cnt").over(w)})
    return dist.pooled_density(k, 1, 5, 5, ["run"])


@query("h11_cdf", "run:s bin_low:i bin_high:i cdf:d", f"WITH {_STEP}, c AS (SELECT run, bin_low, bin_high, count(*) AS cnt FROM st GROUP BY ALL), p AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY run, bin_low) AS p FROM c) SELECT run, bin_low, bin_high, sum(p) OVER (PARTITION BY run, bin_low ORDER BY bin_high ROWS UNBOUNDED PRECEDING) AS cdf FROM p")
def _(s, d):
    h = pipelines.conditional_tables(hourly(s, d), ["cell"])[0].groupBy("run", "bin_low", "bin_high").agg(F.sum("cnt").alias("cnt"))
    from pyspark.sql import Window

    p = h.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("run", "bin_low")))
    return dist.cumulative(p, ["run", "bin_low"])


def _centers(e) -> str:
    from ..functions.bins import centers

    return "[" + ", ".join(repr(x) for x in centers(e)) + "]"


@query("h12_expectation", "run:s cell:i bin_low:i expected:d", f"WITH {_STEP}, c AS (SELECT run, cell, bin_low, bin_high, count(*) AS cnt FROM st GROUP BY ALL), p AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY run, cell, bin_low) AS p FROM c) SELECT run, cell, bin_low, sum(p * {_centers(C.BINS_HIGH)}[bin_high + 1]) AS expected FROM p GROUP BY ALL")
def _(s, d):
    return dist.expectation(pipelines.conditional_tables(hourly(s, d), ["cell"])[0], ["run", "cell", "bin_low"], C.BINS_HIGH)


@query("h13_binned_stats", "run:s bin_low:i n:i mean_n_wet:d mean_intensity:d mean_max:d", f"WITH {BLOCK} SELECT run, bin_low, count(*) AS n, avg(n_wet) AS mean_n_wet, sum(wet_total) / nullif(sum(n_wet), 0) AS mean_intensity, avg(largest) AS mean_max FROM b GROUP BY ALL")
def _(s, d):
    return dist.binned_stats(pipelines.blocks_with_bins(hourly(s, d), ["cell"]), ["run"])


@query("h14_mismatch", "cell:i flagged:b", f"WITH {HOURLY}, t AS (SELECT cell, sum(CASE WHEN run = 'future' THEN value END) / nullif(sum(CASE WHEN run = 'present' THEN value END), 0) AS r FROM hourly GROUP BY cell) SELECT cell, r < 0.7 OR r > 1.3 AS flagged FROM t")
def _(s, d):
    t = hourly(s, d).groupBy("cell").agg(F.try_divide(F.sum(F.when(F.col("run") == "future", F.col("value"))), F.sum(F.when(F.col("run") == "present", F.col("value")))).alias("r"))
    return t.select("cell", dist.mismatch(F.col("r")).alias("flagged"))


@query("h15_precipitation_pdf", "run:s bin:i cnt:i pdf:d per_year:d", f"WITH {CUBE}, z AS (SELECT run, value, CASE WHEN value >= 0 AND value <= 40 THEN least(floor(value * 20 / 40), 19) END AS bin FROM cube WHERE value > 0.1), g AS (SELECT run, bin, count(*) AS cnt, sum(value) AS amount FROM z WHERE bin IS NOT NULL GROUP BY ALL) SELECT run, bin, cnt, cnt * 100.0 / sum(cnt) OVER (PARTITION BY run) AS pdf, amount / 2 AS per_year FROM g")
def _(s, d):
    return dist.precipitation_pdf(cube(s, d), ["run"], 0, 40, 20, 0.1, 2.0)


_Q = "unnest([0.1, 0.5, 0.9, 0.99]) AS q, unnest(quantile_cont(value, [0.1, 0.5, 0.9, 0.99])) AS value"


@query("q01_quantiles", "run:s cell:i q:d value:d", f"WITH {CUBE} SELECT run, cell, {_Q} FROM cube WHERE value > 0.1 GROUP BY run, cell")
def _(s, d):
    return dist.quantiles(cube(s, d).where("value > 0.1"), ["run", "cell"], [0.1, 0.5, 0.9, 0.99])


@query("q02_pooled_quantiles", "run:s q:d value:d", f"WITH {CUBE} SELECT run, {_Q} FROM cube GROUP BY run")
def _(s, d):
    return dist.quantiles(cube(s, d), ["run"], [0.1, 0.5, 0.9, 0.99])


@query("q04_approximate_quantiles", "run:s q:d value:d")
def _(s, d):
    return dist.quantiles(cube(s, d), ["run"], [0.1, 0.5, 0.9, 0.99], exact=False)


@query("q05_quantiles_by_bin", "bin:i q:d value:d n:i", f"WITH {CUBE}, z AS (SELECT value, floor((264 + hour(ts) * 2.5 - 264) / 1)::BIGINT AS bin FROM cube WHERE 264 + hour(ts) * 2.5 >= 264 AND 264 + hour(ts) * 2.5 < 310) SELECT bin, {_Q}, count(*) AS n FROM z GROUP BY bin")
def _(s, d):
    return dist.quantiles_by_bin(cube(s, d).withColumn("td", 264 + F.hour("ts") * 2.5), "td", 264, 310, 1, [0.1, 0.5, 0.9, 0.99])


@query("q06_exceedance_share", "run:s cell:i share:d", f"WITH {CUBE}, p AS (SELECT run, cell, quantile_cont(value, 0.9) AS p FROM cube GROUP BY ALL) SELECT cube.run, cube.cell, 100 * sum(CASE WHEN value > p THEN value ELSE 0 END) / sum(value) AS share FROM cube JOIN p ON p.run = cube.run AND p.cell = cube.cell GROUP BY ALL")
def _(s, d):
    return dist.exceedance_share(cube(s, d), ["run", "cell"], 0.9)


@query("q07_min_max", "run:s cell:i scaled:d", f"WITH {CUBE}, c AS (SELECT run, cell, sum(value) AS v FROM cube GROUP BY ALL) SELECT run, cell, (v - min(v) OVER (PARTITION BY run)) / nullif(max(v) OVER (PARTITION BY run) - min(v) OVER (PARTITION BY run), 0) AS scaled FROM c")
def _(s, d):
    return dist.min_max(cube(s, d).groupBy("run", "cell").agg(F.sum("value").alias("value")), ["run"])


@query("q09_against_interval", "cell:i diff:d err_lo:d err_hi:d outside:d above:b", f"WITH {CUBE}, c AS (SELECT cell, avg(value) AS o, quantile_cont(value, 0.25) AS l, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.6) AS h FROM cube GROUP BY cell) SELECT cell, o - m AS diff, m - l AS err_lo, h - m AS err_hi, CASE WHEN o > h THEN o - h WHEN o < l THEN o - l ELSE 0 END AS outside, o > h AS above FROM c")
def _(s, d):
    c = cube(s, d).groupBy("cell").agg(F.avg("value").alias("o"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.6))).alias("p"))
    return c.withColumns(dist.against_interval(F.col("o"), F.get("p", F.lit(0)), F.get("p", F.lit(1)), F.get("p", F.lit(2))))


@query("q11_box_stats", "cell:i n:i p10:d p25:d p50:d p75:d p90:d", f"WITH {CUBE} SELECT cell, count(*) AS n, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90 FROM cube GROUP BY cell")
def _(s, d):
    return dist.box_stats(cube(s, d), ["cell"])


@query("q12_hide_rare", "run:s bin:i cnt:i share:d", f"WITH {CUBE}, z AS (SELECT run, {hist('value', C.BINS_HIGH)} AS bin, count(*) AS cnt FROM cube GROUP BY ALL), w AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY run) AS share FROM z) SELECT * FROM w WHERE share > 0.01")
def _(s, d):
    return dist.hide_rare(dist.histogram(cube(s, d), ["run"], C.BINS_HIGH), ["run"], 0.01)


_GINI = f"""{HOURLY}, r AS (SELECT run, cell, ts::DATE AS day, value, row_number() OVER (PARTITION BY run, cell, ts::DATE ORDER BY value) AS i FROM hourly), g AS (SELECT run, cell, day, sum(value) AS total, count(*) AS n, CASE WHEN sum(value) = 0 THEN 0 ELSE 2 * sum(i * value) / (count(*) * sum(value)) - (count(*) + 1) / count(*) END AS gini FROM r GROUP BY ALL)"""


def _gini(s, d):
    return dist.gini(hourly(s, d).withColumn("day", F.to_date("ts")), ["run", "cell", "day"])


@query("g01_gini", "run:s cell:i day:D gini:d n:i total:d", f"WITH {_GINI} SELECT * FROM g")
def _(s, d):
    return _gini(s, d)


@query("g02_gini_by_bin", "run:s cell:i bin_low:i gini:d n_events:i", f"WITH {_GINI} SELECT run, cell, {search('round(total, 6)', C.BINS_LOW_COARSE)} AS bin_low, avg(gini) AS gini, count(*) AS n_events FROM g GROUP BY ALL")
def _(s, d):
    return dist.gini_by_bin(_gini(s, d).withColumn("total", F.round("total", 6)), ["run", "cell"], C.BINS_LOW_COARSE)


@query("g03_weighted_gini", "run:s mean:d", f"WITH {_GINI}, b AS (SELECT run, cell, avg(gini) AS v, count(*) * (cell + 1) AS w FROM g GROUP BY run, cell) SELECT run, sum(v * w) / sum(w) AS mean FROM b GROUP BY run")
def _(s, d):
    b = _gini(s, d).groupBy("run", "cell").agg(F.avg("gini").alias("v"), (F.count("*") * (F.col("cell") + 1)).alias("w"))
    return dist.weighted_mean(b, ["run"], "v", "w")


def uniform(*keys: str) -> str:
    return "(('0x' || substr(md5(" + " || '|' || ".join(keys) + "), 1, 8))::BIGINT / 4294967296.0)"


@query("g04_bootstrap_mean", "low:d mid:d high:d", f"""WITH {_GINI}, b AS (SELECT cell, avg(gini) AS v, count(*) AS w FROM g GROUP BY cell), k AS (SELECT *, row_number() OVER (ORDER BY cell) - 1 AS idx FROM b),
z AS (SELECT s.sample, floor({uniform("'42'", "s.sample::VARCHAR", "k.idx::VARCHAR")} * 25)::BIGINT AS idx FROM k, (SELECT unnest(range(200)) AS sample) s), m AS (SELECT sample, sum(v * w) / sum(w) AS mean FROM z JOIN k USING (idx) GROUP BY sample)
SELECT quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.5) AS mid, quantile_cont(mean, 0.975) AS high FROM m""")
def _(s, d):
    b = _gini(s, d).groupBy("cell").agg(F.avg("gini").alias("v"), F.count("*").alias("w"))
    return dist.bootstrap_mean(b, "cell", "v", "w", 200)


@query("r01_within_day", "cell:i ts:t fraction:d peak_ratio:d", f"WITH {HOURLY} SELECT cell, ts, value / nullif(sum(value) OVER w, 0) AS fraction, max(value) OVER w / nullif(sum(value) OVER w, 0) AS peak_ratio FROM hourly WINDOW w AS (PARTITION BY cell, ts::DATE)")
def _(s, d):
    return dist.within_day(hourly(s, d), ["cell"])


@query("plan_percentile_change", "cell:i q:d present:d future:d change:d change_pct:d", f"WITH {HOURLY}, w AS (SELECT *, sum(value) OVER (PARTITION BY run, cell, ts::DATE) AS t FROM hourly), p AS (SELECT run, cell, unnest([0.5, 0.9, 0.99]) AS q, unnest(quantile_cont(value, [0.5, 0.9, 0.99])) AS v FROM w WHERE t >= 1 AND value > 0.1 GROUP BY run, cell), j AS (SELECT cell, q, max(CASE WHEN run = 'present' THEN v END) AS present, max(CASE WHEN run = 'future' THEN v END) AS future FROM p GROUP BY ALL) SELECT *, future - present AS change, CASE WHEN present > 0 THEN 100 * (future - present) / present END AS change_pct FROM j")
def _(s, d):
    return pipelines.percentile_change(hourly(s, d), ["cell"], [0.5, 0.9, 0.99])


