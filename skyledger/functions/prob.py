"""Probability scalars."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyledger.functions.arrays import let


def clip(p: Column, eps: float) -> Column:
    """Clip into [eps, 1-eps]; a missing or non-finite value becomes one half."""
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    return F.when(finite, F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))).otherwise(F.lit(0.5))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps)
    return F.log(q / (1.0 - q))


def sigmoid(x: Column) -> Column:
    tail = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + tail)).otherwise(tail / (1.0 + tail))


def log_loss(p: Column, y: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return -(y * F.log(q) + (1 - y) * F.log(1.0 - q))


def normal_cdf(x: Column, mean: Column, sigma: Column) -> Column:
    """Normal CDF by the Abramowitz-Stegun 7.1.26 polynomial for erf, absolute error below 1.5e-7."""
    return standard_cdf((x - mean) / (sigma * math.sqrt(2.0)), lambda value, body: body(value))


def standard_cdf(z: Column, name: Callable[[Column, Callable[[Column], Column]], Column] = let) -> Column:
    """The CDF at `z` deviations times the square root of one half; inside array functions its parts are named (`let`), since
    nothing else keeps them from being computed at each use."""
    def at(z: Column, t: Column) -> Column:
        # fixed values: the published coefficients, highest power first.
        poly = F.lit(1.061405429)
        for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
            poly = poly * t + c
        erf = F.signum(z) * (1.0 - poly * t * F.exp(-z * z))
        return 0.5 * (1.0 + erf)
    return name(z, lambda v: name(1.0 / (1.0 + 0.3275911 * F.abs(v)), lambda t: at(v, t)))


def wilson(wins: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of a share, null on an empty sample."""
    p = wins / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))
