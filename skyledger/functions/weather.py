"""Weather scalars."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * (2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def wet_bulb(temp_f: Column, dewpoint_f: Column, humidity: Column) -> Column:
    """Stull approximation in Fahrenheit; without humidity a fixed share of the dewpoint depression is used."""
    celsius = (temp_f - 32.0) * 5.0 / 9.0
    dew = (dewpoint_f - 32.0) * 5.0 / 9.0
    rh = F.when(humidity.isNotNull(), F.least(F.greatest(humidity, F.lit(1.0)), F.lit(100.0)))
    # fixed values: the published Stull (2011) coefficients.
    stull = (
        celsius * F.atan(0.151977 * F.sqrt(rh + 8.313659))
        + F.atan(celsius + rh)
        - F.atan(rh - 1.676331)
        + 0.00391838 * F.pow(rh, F.lit(1.5)) * F.atan(0.023101 * rh)
        - 4.686035
    )
    return F.coalesce(stull, celsius - (celsius - dew) * 0.35) * 9.0 / 5.0 + 32.0


def cloud_code(*codes: Column) -> Column:
    """Worst sky cover of the reported layers: -1 none reported, 0 clear, 1 few or scattered, 2 broken, 3 overcast."""
    rank = {"OVC": 3, "VV": 3, "BKN": 2, "SCT": 1, "FEW": 1}
    ranks = []
    for code in codes:
        clean = F.upper(F.trim(code))
        chain = F.when(code.isNull(), F.lit(-1))
        for name, value in rank.items():
            chain = chain.when(clean == name, F.lit(value))
        ranks.append(chain.otherwise(F.lit(0)))
    return F.greatest(*ranks)


def f_to_c(value: Column) -> Column:
    return F.bround((value - 32.0) * 5.0 / 9.0, 1)


def k_to_f(value: Column) -> Column:
    return (value - 273.15) * 9.0 / 5.0 + 32.0
