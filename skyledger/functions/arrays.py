"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body`: inside array functions a repeated expression is computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
