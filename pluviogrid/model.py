"""Schemas of the data products, and the normalisation of missing values at ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import MISSING

CUBE = "run string, y int, x int, ts timestamp_ntz, value double"
LEVELS = "run string, ts timestamp_ntz, lev double, y int, x int, value double"
GRID = "y int, x int, lat double, lon double, landmask tinyint, hgt double"
STATIONS = "code string, name string, province string, altitude double, lon double, lat double, sdate date, edate date"
CONDITIONAL = "y int, x int, bin_low int, bin_high int, cnt bigint, p double"
PERCENTILE_CHANGE = "y int, x int, p double, present double, future double, change double, change_pct double, pvalue double, sig tinyint, sig_fdr tinyint"
TOP_EVENTS = "y int, x int, event int, cumul double, cumul_duration int, cumul_time timestamp_ntz, peak double, peak_duration int, peak_time timestamp_ntz"
CONFIDENCE = "y int, x int, bootstrap_q double, q double, hourly_intensity double, max_hourly_intensity double"
DELTAS = "model string, var string, month int, plev double, lat double, lon double, delta double"
TRACKS = "storm_id bigint, times array<timestamp_ntz>, size array<double>, tot array<double>, max array<double>, mean array<double>, speed array<double>, track array<array<double>>"


def nullify(df: DataFrame, *cols: str, sentinels: tuple[float, ...] = (MISSING, -999.0)) -> DataFrame:
    """NaN and fill values become NULL, so that no comparison or sum meets them."""
    out = {}
    for c in cols:
        v = F.col(c).cast("double")
        bad = F.isnan(v)
        for s in sentinels:
            bad = bad | (v == s)
        out[c] = F.when(~bad, v)
    return df.withColumns(out)
