"""Great-circle and solar geometry as Column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyledger.functions.arrays import let


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = (
        F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0))
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    )
    return 12742.0 * F.asin(F.sqrt(a))


def wrap(value: Column, period: float) -> Column:
    return value - F.floor(value / period) * period


def wrap_once(value: Column, period: float) -> Column:
    """`wrap` of a value that is long to compute, which is named first."""
    return let(value, lambda v: wrap(v, period))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = (
        F.cos(F.radians(lat1)) * F.sin(F.radians(lat2))
        - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    )
    return wrap(F.degrees(F.atan2(y, x)) + 360.0, 360.0)


def angle_diff(left: Column, right: Column) -> Column:
    return F.abs(wrap(left - right + 180.0, 360.0) - 180.0)


# fixed values: the published NOAA solar series for the equation of time (minutes) and the declination (radians).
TIME_SERIES = ((0.000075, 0.0), (0.001868, -0.032077), (-0.014615, -0.040849))
DECLINATION_SERIES = ((0.006918, 0.0), (-0.399912, 0.070257), (-0.006758, 0.000907), (-0.002697, 0.00148))


def _series(angle: Column, coefficients) -> Column:
    total = F.lit(coefficients[0][0])
    for order, (c, s) in enumerate(coefficients[1:], start=1):
        total = total + c * F.cos(angle * order) + s * F.sin(angle * order)
    return total


def toa_irradiance(latitude: Column, longitude: Column, ts: Column) -> Column:
    """Top-of-atmosphere horizontal irradiance in W/m2, zero below the horizon.

    Clock, angle and declination are named (`let`), as each stands in many terms of the series.
    """
    clock = F.struct(F.dayofyear(ts).alias("day"), (F.hour(ts) * 60.0 + F.minute(ts) + F.second(ts) / 60.0).alias("minute"),
                     F.radians(latitude).alias("lat"), longitude.cast("double").alias("lon"))

    def height(at: Column, gamma: Column) -> Column:
        solar = wrap_once(at["minute"] + 229.18 * _series(gamma, TIME_SERIES) + 4.0 * at["lon"], 1440.0)
        hour_angle = F.radians(solar / 4.0 - 180.0)
        cosine = let(_series(gamma, DECLINATION_SERIES), lambda declination: (
            F.sin(at["lat"]) * F.sin(declination) + F.cos(at["lat"]) * F.cos(declination) * F.cos(hour_angle)))
        distance = 1.0 + 0.033 * F.cos(2.0 * math.pi * at["day"] / 365.0)
        return F.greatest(F.lit(0.0), 1361.0 * distance * cosine)
    return let(clock, lambda at: let((2.0 * math.pi / 365.0) * (at["day"] - 1 + (at["minute"] / 60.0 - 12.0) / 24.0), lambda gamma: height(at, gamma)))


def radiation_surprise(dsr_mean: Column, shortwave: Column, latitude: Column, longitude: Column,
                       decision: Column, trailing_minutes: int = 60) -> Column:
    """Observed minus forecast transmission; null where the sun is too low for a stable ratio."""
    def shifted(minutes: float) -> Column:
        return F.timestamp_micros(F.unix_micros(decision) + int(minutes * 60_000_000))
    seen = toa_irradiance(latitude, longitude, shifted(-trailing_minutes / 2))
    ahead = sum((toa_irradiance(latitude, longitude, shifted(m)) for m in (90, 150)),
                toa_irradiance(latitude, longitude, shifted(30))) / 3.0
    # named once, as either stands in the test and in the ratio
    return let(F.array(seen, ahead), lambda sun: F.when((sun[0] >= 50.0) & (sun[1] >= 50.0), dsr_mean / sun[0] - shortwave / sun[1]))
