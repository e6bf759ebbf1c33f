"""Operators on a hand-made series and on small products with known answers."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluviogrid.operators import clusters, dist, events, extremes, filters, interpolation, joins, stats, synthesis, timeagg, windows

SERIES = [0.9, 0.1, 0, 0.1, 0, 6, 3, 0, 0, 0, 14, 0, 0, 0, 5, 6, 4, 0, 0, 0, 11, 5, 1, 0, 0, 1, 1, 1, 2, 11, 2, 1, 0]


@pytest.fixture(scope="module")
def toy(spark):
    t0 = dt.datetime(2000, 1, 1)
    return spark.createDataFrame([(0, t0 + dt.timedelta(hours=i), float(v)) for i, v in enumerate(SERIES)], "cell long, ts timestamp_ntz, value double")


def test_spells(toy):
    e = [(r.start.hour + 24 * (r.start.day - 1), r.duration, r.total, r.peak) for r in events.event_table(toy, ["cell"]).orderBy("start").collect()]
    assert e == [(5, 2, 9, 6), (10, 1, 14, 14), (14, 3, 15, 6), (20, 3, 17, 11), (25, 7, 19, 11)]
    assert events.spells(toy, ["cell"], 0.0, False).agg(F.max("event")).first()[0] == 14


def test_null_breaks_a_spell(spark):
    t0 = dt.datetime(2000, 1, 1)
    rows = [(0, t0 + dt.timedelta(hours=i), v) for i, v in enumerate([2.0, None, 2.0, 2.0])]
    got = events.event_table(spark.createDataFrame(rows, "cell long, ts timestamp_ntz, value double"), ["cell"]).collect()
    assert sorted(r.duration for r in got) == [1, 2]
    dry = spark.createDataFrame([(0, t0, 0.0)], "cell long, ts timestamp_ntz, value double")
    assert events.event_table(dry, ["cell"]).count() == 0


def test_rolling(toy):
    z = filters.zero_below(toy, threshold=1.0)
    assert windows.rolling_sum(z, ["cell"], 2).agg(F.max("rolled")).first()[0] == 16
    assert windows.rolling_sum(z, ["cell"], 3).agg(F.max("rolled")).first()[0] == 17
    assert windows.rolling_sum(z, ["cell"], 3).where("rolled is null").count() == 2


def test_first_day(toy):
    b = timeagg.block_sum(toy, ["cell"], 24).collect()
    assert len(b) == 1 and round(b[0].total, 6) == 56.1 and b[0].largest == 14 and b[0].n_wet == 10
    assert timeagg.block_sum(toy, ["cell"], 24, inclusive=True).first().n_wet == 12
    day = toy.where("ts < timestamp_ntz '2000-01-02'")
    assert day.where("value >= 1").count() == 9
    assert dist.gini(day, ["cell"]).first().gini == pytest.approx(0.7367052881758767)


@pytest.mark.parametrize("values,want", [([0.0] * 23 + [5.0], 23 / 24), ([1.0] * 24, 0.0), ([0.0] * 24, 0.0)])
def test_gini_limits(spark, values, want):
    df = spark.createDataFrame([(0, v) for v in values], "cell int, value double")
    assert dist.gini(df, ["cell"]).first().gini == pytest.approx(want)


def test_quantiles_and_histogram(toy):
    wet = toy.where("value >= 1")
    got = [r.value for r in dist.quantiles(wet, ["cell"], [0.5, 0.9, 0.99]).orderBy("q").collect()]
    assert got == pytest.approx([3.5, 11, 13.55])
    h = {r.bin: r.cnt for r in dist.histogram(wet, ["cell"], [1, 5, 10, 15, 20]).collect()}
    assert h == {0: 9, 1: 4, 2: 3}


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(0, float(i), p) for i, p in enumerate([0.001, 0.02, 0.03, 0.04, 0.2, None])], "cell int, q double, pvalue double")
    assert [r.sig_fdr for r in stats.benjamini_hochberg(df, ["cell"]).orderBy("q").collect()] == [1, 1, 1, 1, 0, 0]


def test_mann_whitney_limits(spark):
    same = spark.createDataFrame([(0, r, float(v)) for r in ("present", "future") for v in range(10)], "cell int, run string, value double")
    assert stats.mann_whitney(same, ["cell"]).first().pvalue == pytest.approx(1.0, abs=1e-6)
    few = same.where("value < 4")
    assert stats.mann_whitney(few, ["cell"]).first().pvalue is None


def test_attribution_adds_up(spark):
    df = spark.createDataFrame([(1.0, 1.5, 3.0), (2.0, 2.0, 2.0), (0.0, 1.0, 1.0)], "p double, s double, f double")
    for r in df.withColumns(stats.attribution(F.col("p"), F.col("s"), F.col("f"))).withColumn("label", stats.classify(F.col("daily_frac"))).collect():
        assert r.total == r.daily + r.structural
        assert (r.label == "") == (r.total == 0)
    labels = spark.createDataFrame([(x,) for x in (-0.3, 0.0, 0.2, 0.5, 0.8, 0.81, 1.2, 1.3, None)], "x double").select(stats.classify(F.col("x")).alias("c")).collect()
    assert [r.c for r in labels] == ["amplifying", "structural", "structural", "mixed", "mixed", "daily", "daily", "amplifying", ""]


def test_time_slice(toy):
    assert filters.time_slice(toy, "2000-01-01T05", "2000-01-01T06").count() == 2
    assert filters.time_slice(toy, "2000", "2000").count() == 33 and filters.time_slice(toy, "2000-01-02", "2000-01-02").count() == 9


def test_season_by_month_alone(spark):
    df = spark.createDataFrame([(dt.datetime(2000, m, 1), float(m)) for m in range(1, 13)], "ts timestamp_ntz, value double")
    assert sorted(r.value for r in filters.in_season(df, "DJF").collect()) == [1, 2, 12]


def test_neighbourhood_edges(spark):
    df = spark.createDataFrame([(y, x, 1) for y in range(4) for x in range(3)], "y int, x int, v int")
    clip = {(r.cy, r.cx): r.n for r in dist.neighbourhood(df, 1, 4, 3).groupBy("cy", "cx").agg(F.sum("weight").alias("n")).collect()}
    assert clip[0, 0] == 4 and clip[1, 1] == 9
    full = {(r.cy, r.cx): r.n for r in dist.neighbourhood(df, 2, 4, 3, "replicate").groupBy("cy", "cx").agg(F.sum("weight").alias("n")).collect()}
    assert set(full.values()) == {25}


def test_nearest_cell_ties(spark):
    grid = spark.createDataFrame([(y, x, float(y), float(x)) for y in range(3) for x in range(3)], "y int, x int, lat double, lon double")
    p = spark.createDataFrame([("a", 0.5, 0.5), ("b", 1.9, 0.1), ("c", 50.0, 50.0)], "name string, lat double, lon double")
    got = {r.name: (r.y, r.x) for r in joins.nearest_cell(p, grid, ["name"], sphere=False).collect()}
    assert got == {"a": (0, 0), "b": (2, 0), "c": (2, 2)}


def test_vertical_extrapolates(spark):
    p = spark.createDataFrame([(0, 100.0, 1.0), (0, 200.0, 2.0), (0, 400.0, 6.0)], "cell int, lev double, value double")
    t = spark.createDataFrame([(x,) for x in (50.0, 150.0, 200.0, 300.0, 500.0)], "target double")
    assert [r.value for r in interpolation.vertical(p, t, ["cell"]).orderBy("target").collect()] == [0.5, 1.5, 2.0, 4.0, 8.0]


def test_objects(spark):
    df = spark.createDataFrame([(0, y, x, v) for y, x, v in [(0, 0, 5.0), (0, 1, 5.0), (1, 2, 5.0), (3, 3, 1.0)]], "ts int, y int, x int, value double")
    got = [(r.object, r.cells, r.center_x) for r in events.objects(df, 2.0).orderBy("object").collect()]
    assert got == [(0, 2, 0.5), (1, 1, 2.0)]


def test_gpd_recovery():
    rng = np.random.default_rng(0)
    for xi in (-0.2, 0.0, 0.3):
        u = rng.random(20000)
        x = -5 * np.log(u) if xi == 0 else 5 / xi * (u**-xi - 1)
        got = extremes.gpd_fit(x)
        assert got[0] == pytest.approx(xi, abs=0.04) and got[1] == pytest.approx(5, rel=0.05)
    assert all(math.isnan(v) for v in extremes.gpd_fit(np.zeros(2)))


def test_gev_recovery(spark):
    rng = np.random.default_rng(1)
    y = -np.log(rng.random(4000))
    x = 20 + 4 / 0.1 * (y**-0.1 - 1)
    mu, sigma, xi = extremes.gev_fit(x)
    assert mu == pytest.approx(20, abs=0.4) and sigma == pytest.approx(4, rel=0.08) and xi == pytest.approx(0.1, abs=0.05)
    df = spark.createDataFrame([(0, float(v)) for v in x], "cell int, value double")
    r = extremes.gev_from_l_moments(extremes.l_moments(df, ["cell"]), ["cell"]).first()
    assert r.mu == pytest.approx(20, abs=0.4) and r.sigma == pytest.approx(4, rel=0.08) and r.xi == pytest.approx(0.1, abs=0.05)


def test_ward():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (15, 3)) for c in (0, 4, 9)])
    merges = clusters.ward(x)
    # each merge joins the pair of clusters with the smallest increase
    groups = {i: [i] for i in range(len(x))}
    for k, (a, b, d, n) in enumerate(merges):
        def cost(p, q):
            u, v = x[groups[p]], x[groups[q]]
            return math.sqrt(2 * len(u) * len(v) / (len(u) + len(v)) * ((u.mean(0) - v.mean(0)) ** 2).sum())
        names = sorted(groups)
        best = min(cost(p, q) for i, p in enumerate(names) for q in names[i + 1 :])
        assert d == pytest.approx(cost(int(a), int(b))) == pytest.approx(best)
        groups[len(x) + k] = groups.pop(int(a)) + groups.pop(int(b))
        assert n == len(groups[len(x) + k])
    assert [sorted(set(g)) for g in np.split(clusters.cut_tree(merges, 45, 8.0), 3)] == [[1], [2], [3]]


def test_ward_clusters_of_many(spark):
    """More points than one task takes (F1)."""
    n = 3 * clusters.ALONE // 2 + 7001
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (n // 3, 2)) for c in (0, 4, 9)] + [np.zeros((40, 2))])
    df = spark.createDataFrame([(len(x) - i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    assert {r.cluster_id for r in clusters.ward_clusters(df, "id", "v", 60.0).collect()} == {1, 2, 3}


def test_linkage_of_many(spark):
    """More points than one task takes (F2): ordered steps down to one cluster, and a cut as of ward_clusters (F1)."""
    n = 3 * clusters.ALONE // 2 + 7001
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (n // 3, 2)) for c in (0, 4, 9)] + [np.zeros((40, 2))])
    df = spark.createDataFrame([(len(x) - i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = np.array([tuple(r) for r in clusters.linkage(df, "id", "v").orderBy("step").collect()])
    assert (got[:, 0] == np.arange(len(x) - 1)).all() and (np.diff(got[:, 3]) >= -1e-9).all() and got[-1, 4] == len(x)
    assert {r.cluster_id for r in clusters.ward_clusters(df, "id", "v", float(got[-3, 3]) * (1 + 1e-9)).collect()} == {1, 2, 3}


@pytest.mark.parametrize("shape", ["clouds", "chain"])
def test_ward_rounds_make_the_same_tree(spark, monkeypatch, shape):
    monkeypatch.setattr(clusters, "ALONE", 10)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.3, (150, 3)) for c in (0, 4, 9)]) if shape == "clouds" else (1.02 ** np.arange(400.0))[:, None]
    got, want = clusters.ward_rounds(spark, x), clusters.ward(x)
    assert (got[:, [0, 1, 3]] == want[:, [0, 1, 3]]).all() and got[:, 2] == pytest.approx(want[:, 2])
    copies = np.concatenate([x, x[::3], x[:5]])
    got, want = clusters.ward_rounds(spark, copies), clusters.ward(copies)
    assert got[:, 2] == pytest.approx(want[:, 2], abs=1e-9)
    for at in want[-40::7, 2]:
        assert (clusters.cut_tree(got, len(copies), at * (1 + 1e-9)) == clusters.cut_tree(want, len(copies), at * (1 + 1e-9))).all()


def test_mass_is_conserved():
    rng = np.random.default_rng(3)
    edges = [0.1, 1, 5, 20, float("inf")]
    cdf = np.array([0.4, 0.7, 0.9, 1.0])
    for total in (0.05, 0.3, 5.0, 80.0):
        for with_max in (True, False):
            v = synthesis.disaggregate(total, 24, np.linspace(1 / 24, 1, 24), cdf, cdf, edges, rng, 0.1, with_max)
            assert v.sum() == pytest.approx(total) and (v >= 0).all()


def test_seed_does_not_depend_on_partitions(spark):
    days = spark.createDataFrame([(c, d, 5.0 + d, 0) for c in range(3) for d in range(5)], "cell long, day_no long, total double, bin_low int")
    dists = spark.createDataFrame([(0, [i / 24 for i in range(1, 25)], [0.5, 1.0], [0.5, 1.0], 0.9)], "bin_low int, n_wet_cdf array<double>, value_cdf array<double>, max_cdf array<double>, p_has_wet double")
    run = lambda d: sorted((r.cell, r.sample, r.day_no, tuple(r.steps)) for r in synthesis.method_steps(d, dists, [0.1, 2.0, 9.0], 24, 2).collect())
    assert run(days) == run(days.repartition(7))


def test_gpd_bootstrap_refits_every_sample(spark):
    rng = np.random.default_rng(8)
    steps = [dt.datetime(y, 1, 1) + dt.timedelta(days=int(i)) for y in range(2000, 2006) for i in range(200)]
    rows = [(c, t, float(v)) for c in range(4) for t, v in zip(steps, rng.exponential(5.0, len(steps)), strict=True)]
    df = spark.createDataFrame(rows, "cell long, ts timestamp_ntz, value double")
    got = {r["sample"]: r for r in extremes.gpd_bootstrap(df, [], 4, 6).collect()}
    drawn = extremes.spatial_bootstrap(df, [], 4, 6).toPandas()
    assert sorted(got) == list(range(6))
    for k, d in drawn.groupby("sample"):
        u = d.groupby(d.ts.dt.year).value.max().min()
        x = d.value[d.value >= u].to_numpy() - u
        assert got[k].n == len(x) and np.allclose((got[k].xi, got[k].sigma), extremes.gpd_fit(x), equal_nan=True)
    assert len({r.sigma for r in got.values()}) > 1


def test_sphere_nulls(spark):
    from pluviogrid.functions.physics import cosine_distance, haversine

    d = spark.createDataFrame([(None, 1.0), (1.0, None), (1.0, 1.0)], "a double, b double")
    for f in (haversine, cosine_distance):
        got = [r[0] for r in d.select(f(F.col("a"), F.col("b"), F.lit(1.0), F.lit(1.0))).collect()]
        assert got[:2] == [None, None] and got[2] == pytest.approx(0, abs=0.2)


def _great_circle(a, b):
    p, q, r, s = map(math.radians, (*a, *b))
    return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2)))


@pytest.mark.parametrize("sphere", [True, False])
def test_nearest_cell_anywhere(spark, sphere):
    from pluviogrid.operators import joins

    cells = [(0, 0, 1.99, 1.99), (0, 1, 0.5, 2.05), (1, 0, 80.2, 5.0), (1, 1, 81.0, 4.0), (2, 0, 10.0, 179.9), (2, 1, 11.0, 150.0), (3, 0, -60.0, -100.0)]
    places = [("a", 0.5, 0.5), ("b", 80.5, 1.0), ("c", 10.0, -179.9), ("d", 89.9, -170.0), ("e", -20.0, 60.0), ("f", -89.0, 10.0)]
    grid = spark.createDataFrame(cells, "y int, x int, lat double, lon double")
    points = spark.createDataFrame([*places, ("n", None, 1.0)], "name string, lat double, lon double")
    got = {r.name: r for r in joins.nearest_cell(points, grid, ["name"], sphere).collect()}
    far = _great_circle if sphere else lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1])
    for name, *p in places:
        want = min(cells, key=lambda c: far(p, c[2:]))
        assert (got[name].y, got[name].x) == want[:2] and got[name].distance == pytest.approx(far(p, want[2:]))
    assert got["n"].y is None and got["n"].distance is None and len(got) == 7
    none = joins.nearest_cell(points, grid.limit(0), ["name"], sphere).collect()
    assert len(none) == 7 and all(r.distance is None for r in none)


def test_within_distance_anywhere(spark):
    from pluviogrid.operators import joins

    rng = np.random.default_rng(3)
    p = [(1, i, float(math.degrees(math.asin(2 * u - 1))), float(360 * v - 180)) for i, (u, v) in enumerate(rng.random((120, 2)))]
    p += [(1, 200, 89.9, 0.0), (1, 201, 89.9, 180.0), (1, 202, 0.0, 179.99), (1, 203, 0.0, -179.99)]
    for metres in (30_000.0, 1_500_000.0, 30_000_000.0):
        a = spark.createDataFrame(p, "k int, i int, lat_a double, lon_a double")
        b = spark.createDataFrame(p, "k int, j int, lat_b double, lon_b double")
        got = sorted((r.i, r.j) for r in joins.within_distance(a, b, ["k"], metres).collect())
        assert got == sorted((x[1], y[1]) for x in p for y in p if _great_circle(x[2:], y[2:]) <= metres)
