"""Settings and fixed values: thresholds, bin edges, quantiles, physical constants."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _edges(*parts: np.ndarray, top: float | None = None) -> list[float]:
    out = [float(x) for p in parts for x in p]
    return out + [top] if top is not None else out


INF = float("inf")
#: Bin edges as NumPy's ranges give them (steps of 0.1 are inexact, and so are these).
BINS_HIGH = _edges(np.arange(0, 1, 0.1), np.arange(1, 10, 1), np.arange(10, 100, 5), top=INF)
BINS_LOW_FINE = _edges(np.arange(0, 1, 0.25), np.arange(1, 5, 1), np.arange(5, 100, 5), top=INF)
BINS_LOW_COARSE = _edges(np.arange(0, 100, 5), top=INF)
IFD_INTENSITY = _edges(np.array([1.0]), np.arange(5, 505, 5))
IFD_DURATION = _edges(np.arange(1, 6, 1), np.arange(6, 577, 6))
#: Durations in minutes of the multi-duration sums.
DURATIONS = [10, 20, 30, 60, 120, 180, 360, 720, 1440]

# Percentiles.
PERCENTILES = [10, 20, 25, 40, 50, 60, 70, 75, 80, 85, 90, 95, 98, 99, 99.5, 99.9, 99.99, 100]

# Physical constants.
RD = 287.04
RV = 461.5
CP = 7.0 * RD / 2.0
CV = 718.0
EPSILON = 0.62197
ES_BOLTON, A_BOLTON, B_BOLTON = 611.2, 17.67, 243.5
ES_TETENS = 6.1078
A_VAPOR, B_VAPOR = 7.5, 237.3
A_ICE, B_ICE = 9.5, 265.5
G = 9.81
T0 = 273.15
MISSING = 1.0e20
LATENT = 2.501e6
EARTH_RADIUS = 6371000.0
OMEGA = 7.2921e-5

#: Steps in a day, and the factor to mm/h, of each frequency.
STEPS_PER_DAY = {"10MIN": 144, "01H": 24, "DAY": 1}
TO_MM_PER_HOUR = {"10MIN": 6.0, "01H": 1.0, "DAY": 1.0 / 24.0}

#: Region boxes: south, west, north, east.
REGIONS = {
    "BAL": (38.6, 0.9, 40.3, 4.7),
    "LEV": (36.4, -3.30, 40.20, 1.0),
    "CAT": (40.3, 0.0, 43.0, 3.5),
    "SAR": (38.7, 7.74, 41.35, 10.3),
    "WME": (36.0, -5.0, 45.0, 15.0),
    "SWM": (36.0, -5.0, 40.3, 15.0),
    "NWM": (40.5, -5.0, 45.0, 15.0),
}


@dataclass(frozen=True)
class Settings:
    """Thresholds with their sense, edges and quantiles of an analysis."""

    wet_high: float = 0.1
    wet_high_inclusive: bool = False
    wet_low: float = 1.0
    wet_low_inclusive: bool = True
    bins_high: tuple[float, ...] = field(default_factory=lambda: tuple(BINS_HIGH))
    bins_low: tuple[float, ...] = field(default_factory=lambda: tuple(BINS_LOW_FINE))
    quantiles: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99)
    bootstrap_quantiles: tuple[float, ...] = (0.025, 0.5, 0.975)
    samples: int = 1000
    buffer: int = 5
    tile: int = 50
    steps: int = 24
    alpha: float = 0.05

    def check_matches(self, stored: dict) -> None:
        """Raises where the edges or thresholds of a stored histogram differ from these."""
        for k in ("wet_high", "wet_low", "bins_high", "bins_low"):
            if k in stored and (tuple(stored[k]) if isinstance(stored[k], (list, tuple)) else stored[k]) != getattr(self, k):
                raise ValueError(f"{k} of the stored product is {stored[k]}, not {getattr(self, k)}")
