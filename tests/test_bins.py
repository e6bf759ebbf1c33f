import numpy as np
import pytest
from pyspark.sql import functions as F

from pluviogrid import config as C
from pluviogrid.functions.bins import centers, digitize_bin, hist_bin, searchsorted_bin, width_bin


def column(spark, values, expr):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, v double")
    return [r.b for r in df.select("i", expr(F.col("v")).alias("b")).orderBy("i").collect()]


EDGES = [0, 0.25, 0.5, 0.75, 1, 2, 3, 4, 5, 10]
VALUES = [-1.0, 0.0, 0.1, 0.25, 0.3, 5.0, 9.99, 10.0, 11.0]


def test_constants():
    assert (len(C.BINS_HIGH), len(C.BINS_LOW_FINE), len(C.BINS_LOW_COARSE)) == (38, 28, 21)
    assert C.BINS_HIGH[3] == 0.30000000000000004 and (len(C.IFD_INTENSITY), len(C.IFD_DURATION)) == (101, 101)
    assert C.IFD_DURATION[-1] == 576 and C.IFD_INTENSITY[:3] == [1, 5, 10]


def test_three_conventions(spark):
    assert column(spark, [5.0], lambda v: hist_bin(v, EDGES)) == [8]
    assert column(spark, [5.0], lambda v: searchsorted_bin(v, EDGES)) == [7]
    got = column(spark, VALUES + [None, float("nan")], lambda v: hist_bin(v, EDGES))
    assert got == [None, 0, 0, 1, 1, 8, 8, 8, None, None, None]
    assert column(spark, VALUES, lambda v: digitize_bin(v, EDGES)) == list(np.digitize(VALUES, EDGES) - 1)
    assert column(spark, VALUES, lambda v: searchsorted_bin(v, EDGES)) == [min(int(np.searchsorted(EDGES[1:], v)), 8) for v in VALUES]
    assert column(spark, [0.3, 0.30000000000000004], lambda v: hist_bin(v, C.BINS_HIGH)) == [2, 3]


def test_histogram_counts_match(spark):
    v = [0.5, 1, 4.9, 5, 500, 501]
    got = [b for b in column(spark, v, lambda x: hist_bin(x, [1, 5, 10, 500])) if b is not None]
    assert [got.count(i) for i in range(3)] == list(np.histogram(v, [1, 5, 10, 500])[0])


def test_width_and_centers(spark):
    assert column(spark, [0.0, 9.99, 10.0, 10.1], lambda v: width_bin(v, 0, 10, 5)) == [0, 4, 4, None]
    assert centers([0, 1, 3, float("inf")]) == [0.5, 2.0, 8.0]


def test_settings_guard():
    C.Settings().check_matches({"wet_low": 1.0, "bins_low": list(C.BINS_LOW_FINE)})
    with pytest.raises(ValueError):
        C.Settings().check_matches({"wet_low": 0.1})
