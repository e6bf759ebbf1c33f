"""Closed-form scalar functions of meteorology and the sphere, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = C.EARTH_RADIUS) -> Column:
    """Great-circle distance in metres; NULL where a coordinate is."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * radius * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def cosine_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = C.EARTH_RADIUS) -> Column:
    """Great-circle distance by the law of cosines, clamped; NULL where a coordinate is."""
    c = F.sin(F.radians(lat1)) * F.sin(F.radians(lat2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return radius * F.acos(F.when(c > 1, 1.0).when(c < -1, -1.0).otherwise(c))


def unit_xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Point on the unit sphere."""
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def wrap_lon(lon: Column, west: float = -180.0) -> Column:
    """Longitude in [west, west + 360)."""
    return F.pmod(lon - west, F.lit(360.0)) + west


def tile_suffix(y: Column, x: Column, size: int = 50) -> Column:
    """Name of the tile of a cell: 012y-003x."""
    return F.concat(F.lpad(F.floor(y / size).cast("string"), 3, "0"), F.lit("y-"), F.lpad(F.floor(x / size).cast("string"), 3, "0"), F.lit("x"))


def line_through(x: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return y1 + (x - x1) * F.try_divide(y2 - y1, x2 - x1)


def nice_scale(low: float, high: float, ticks: int = 10) -> tuple[float, float, float]:
    """Rounded axis limits and step (1, 2, 5 or 10 times a power of ten) for about so many ticks; on the driver."""

    def nice(v: float, around: bool) -> float:
        power = 10.0 ** math.floor(math.log10(v))
        share = v / power
        for limit, value in ((1.5, 1), (3, 2), (7, 5)) if around else ((1, 1), (2, 2), (5, 5)):
            if share < limit or not around and share <= limit:
                return value * power
        return 10 * power

    if high <= low:
        raise ValueError("high must exceed low")
    step = nice(nice(high - low, False) / (ticks - 1), True)
    return math.floor(low / step) * step, math.ceil(high / step) * step, step


def rain_rate(accumulated: Column, step_minutes: float) -> Column:
    """mm per second from mm per step."""
    return accumulated / (step_minutes * 60)


def total_rain(non_convective: Column, convective: Column) -> Column:
    return non_convective + F.coalesce(convective, F.lit(0.0))


def specific_humidity(q: Column) -> Column:
    return q / (1 + q)


def geopotential_height(phi: Column) -> Column:
    return phi / C.G


def relative_vorticity(absolute: Column, lat: Column) -> Column:
    return absolute - 2 * C.OMEGA * F.sin(F.radians(lat))


def vapour_pressure(psfc: Column, q2: Column) -> Column:
    """Pa."""
    return q2 * psfc / (C.EPSILON + q2)


def saturation_pressure_hpa(t2: Column) -> Column:
    """hPa, over ice at or below freezing, else over water."""
    t = t2 - C.T0
    return F.when(t <= 0, C.ES_TETENS * F.pow(F.lit(10.0), t * C.A_ICE / (t + C.B_ICE))).otherwise(C.ES_TETENS * F.pow(F.lit(10.0), t * C.A_VAPOR / (t + C.B_VAPOR)))


def relative_humidity(psfc: Column, t2: Column, q2: Column) -> Column:
    """Per cent."""
    return vapour_pressure(psfc, q2) / 100 / saturation_pressure_hpa(t2) * 100


def vapour_pressure_deficit_hpa(psfc: Column, t2: Column, q2: Column) -> Column:
    return saturation_pressure_hpa(t2) - vapour_pressure(psfc, q2) / 100


def wet_bulb_globe(t2: Column, e: Column) -> Column:
    """Simplified index in degrees Celsius; e in Pa."""
    return 0.567 * (t2 - C.T0) + 0.393 * e / 100 + 3.94


def apparent_temperature(t2: Column, e: Column, wind: Column) -> Column:
    return (t2 - C.T0) + 0.33 * e / 100 - 0.7 * wind + 4.0


def moist_lapse_rate(p_pa: Column, t: Column) -> Column:
    """K per metre, with the saturation mixing ratio eps * es / (p - es)."""
    es = saturation_pressure_hpa(t) * 100
    ws = C.EPSILON * es / (p_pa - es)
    return C.G / C.CP * (1 + C.LATENT * ws / (C.RD * t)) / (1 + C.LATENT * C.LATENT * ws * C.EPSILON / (C.CP * C.RD * t * t))


def dew_point(e_pa: Column) -> Column:
    """K, from vapour pressure."""
    r = F.log(e_pa / C.ES_BOLTON)
    return C.B_BOLTON * r / (C.A_BOLTON - r) + C.T0


def humidity_from_dew_point(td: Column, t: Column) -> Column:
    """Per cent, both in K."""
    e = lambda k: F.exp(C.A_BOLTON * (k - C.T0) / (k - C.T0 + C.B_BOLTON))
    return 100 * e(td) / e(t)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    """Degrees from which it blows."""
    return F.pmod(270 - F.atan2(v, u) * 180 / math.pi, F.lit(360.0))


def relative_change(future: Column, present: Column) -> Column:
    """Per cent; NULL where the present is 0."""
    return F.try_divide((future - present) * 100, present)


def gaussian(x: Column, mean: float, sd: float) -> Column:
    return F.exp(-F.pow((x - mean) / sd, 2) / 2) / (sd * math.sqrt(2 * math.pi))


def perturbed(base: Column, anomaly: Column, floor: float | None = None) -> Column:
    """Base plus anomaly (a missing one is 0), not below floor."""
    out = base + F.coalesce(F.nanvl(anomaly, F.lit(0.0)), F.lit(0.0))
    return F.greatest(out, F.lit(floor)) if floor is not None else out


def normal_cdf(z: Column) -> Column:
    """Normal distribution function by a polynomial (error below 7.5e-8)."""
    a = F.abs(z)
    k = 1 / (1 + 0.2316419 * a)
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    upper = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


#: Variables by name, as functions of the columns they need: (columns, expression).
VARIABLES = {
    "RAIN": (("rainnc", "rainc"), total_rain),
    "HUSS": (("q2",), specific_humidity),
    "E": (("psfc", "q2"), vapour_pressure),
    "RH2": (("psfc", "t2", "q2"), relative_humidity),
    "VPD": (("psfc", "t2", "q2"), vapour_pressure_deficit_hpa),
    "ZG": (("phi",), geopotential_height),
    "VORREL": (("avo", "lat"), relative_vorticity),
    "WSPD": (("u", "v"), wind_speed),
    "WDIR": (("u", "v"), wind_direction),
    "TAS": (("t2",), lambda c: c),
    "RSDS": (("swdown",), lambda c: c),
    "RLDS": (("glw",), lambda c: c),
    "PSFC": (("psfc",), lambda c: c),
}


def compute(df, name: str, out: str | None = None):
    """df with the named variable; register others in VARIABLES."""
    if name not in VARIABLES:
        raise KeyError(f"no variable {name}; known are {', '.join(sorted(VARIABLES))}")
    cols, f = VARIABLES[name]
    return df.withColumn(out or name, f(*[F.col(c) for c in cols]))
