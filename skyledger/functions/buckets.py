"""Market bucket labels, containment rules and range predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the bucket label grammar, `<=X`, `>=X`, `lo-hi` or a single `X`, each with an optional F or C.
NUMBER = r"-?\d+(?:\.\d+)?"
AT_MOST = rf"^\s*<=\s*({NUMBER})\s*°?[FC]?\s*$"
AT_LEAST = rf"^\s*>=\s*({NUMBER})\s*°?[FC]?\s*$"
BETWEEN = rf"^\s*({NUMBER})\s*-\s*({NUMBER})\s*°?[FC]?\s*$"


def _group(label: Column, pattern: str, index: int) -> Column:
    return F.expr("try_cast(NULL AS DOUBLE)") if pattern is None else F.when(
        label.rlike(pattern), F.regexp_extract(label, pattern, index).cast("double")
    )


def parse_bucket(label: Column) -> Column:
    """Label to `struct<lower,upper>`; null when the label matches no form, so the caller can name a reason."""
    lower = F.coalesce(_group(label, AT_LEAST, 1), _group(label, BETWEEN, 1))
    upper = F.coalesce(_group(label, AT_MOST, 1), _group(label, BETWEEN, 2))
    return F.when(lower.isNotNull() | upper.isNotNull(), F.struct(lower.alias("lower"), upper.alias("upper")))


def bucket_won(value: Column, bucket: Column) -> Column:
    """Market containment: inclusive at both ends; null when the bucket did not parse."""
    lower, upper = bucket["lower"], bucket["upper"]
    inside = (lower.isNull() | (value >= lower)) & (upper.isNull() | (value <= upper))
    return F.when(bucket.isNotNull() & value.isNotNull(), inside)


def ladder_contains(value: Column, lower: Column, upper: Column) -> Column:
    """Training-ladder containment: half-open `[lower, upper)`, either bound may be open."""
    return (lower.isNull() | (value >= lower)) & (upper.isNull() | (value < upper))


def bucket_type(label: Column) -> Column:
    return (
        F.when(label.isNull() | (label == ""), F.lit("missing"))
        .when(label.startswith("<=") | label.startswith(">="), F.lit("tail"))
        .otherwise(F.lit("range"))
    )


def in_range(value: Column, minimum: float | None, maximum: float | None) -> Column:
    """Range predicate: a null value fails only when at least one bound is set."""
    if minimum is None and maximum is None:
        return F.lit(True)
    keep = value.isNotNull()
    if minimum is not None:
        keep = keep & (value >= minimum)
    if maximum is not None:
        keep = keep & (value <= maximum)
    return keep


def side_value(side: Column, yes: Column, no: Column) -> Column:
    """Value of the selected side, null for any other action."""
    return F.when(side == "BUY_YES", yes).when(side == "BUY_NO", no)


def side_probability(side: Column, yes: Column, no: Column) -> Column:
    picked = side_value(side, yes, no)
    return F.when((picked >= 0) & (picked <= 1), picked)


def truth_compatible(low: Column, high: Column, bucket: Column) -> Column:
    """Some whole degree between the half-up rounded ends of a truth interval lies in the bucket."""
    lo, hi = round_half_up(low), round_half_up(high)
    lower, upper = bucket["lower"], bucket["upper"]
    first = F.greatest(lo, F.ceil(F.coalesce(lower, lo)))
    last = F.least(hi, F.floor(F.coalesce(upper, hi)))
    return F.when(bucket.isNotNull() & lo.isNotNull() & hi.isNotNull(), first <= last)


def round_half_up(value: Column) -> Column:
    """Settlement rounding; `F.rint` and `F.bround` are the half-even twins."""
    return F.floor(value + 0.5)
