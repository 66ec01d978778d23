"""Clocks: local projections, cycles, quote-ready time and causal gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value.cast("long"))


def localize(df: DataFrame, ts: str, zone: str, prefix: str = "") -> DataFrame:
    """Local clock columns beside the UTC one; the zone may differ per row."""
    local = F.from_utc_timestamp(F.col(ts), F.col(zone))
    return df.withColumns({
        f"{prefix}valid_local": local,
        f"{prefix}local_date": F.to_date(local),
        f"{prefix}hour_local": F.hour(local),
        f"{prefix}minute_local": F.minute(local),
        f"{prefix}day_of_year": F.dayofyear(local),
    })


def local_midnight_utc(date: Column, zone: Column) -> Column:
    return F.to_utc_timestamp(date.cast("timestamp"), zone)


def standard_offset_seconds(date: Column, zone: Column) -> Column:
    """Standard-time offset of the zone in the date's year: the smaller of mid-January and mid-July."""
    def offset(month: int) -> Column:
        noon = F.make_timestamp(F.year(date), F.lit(month), F.lit(15), F.lit(12), F.lit(0), F.lit(0))
        return F.unix_seconds(F.from_utc_timestamp(noon, zone)) - F.unix_seconds(noon)
    return F.least(offset(1), offset(7))


def climate_date(ts: Column, zone: Column, standard_day: bool = False) -> Column:
    """Civil local date, or the date of the fixed standard-time day that never moves with DST."""
    civil = F.to_date(F.from_utc_timestamp(ts, zone))
    if not standard_day:
        return civil
    offset = standard_offset_seconds(civil, zone)
    return F.to_date(F.timestamp_seconds(F.unix_seconds(ts) + offset))


def quote_ready(ts: Column, bucket_us: int, latency_us: int) -> Column:
    """Ceiling of the clock to its bucket plus latency; a time on a boundary stays there."""
    return from_micros(F.ceil(micros(ts) / F.lit(bucket_us)) * bucket_us + latency_us)


def latest_cycle(ts: Column, step_hours: int, lag_hours: float) -> Column:
    """Newest model cycle already released at a decision time."""
    hour = F.floor((F.unix_seconds(ts) - int(lag_hours * 3600)) / 3600).cast("long")
    return F.timestamp_seconds((hour - F.pmod(F.pmod(hour, F.lit(24)), F.lit(step_hours))) * 3600)


def valid_times(date: Column, zone: Column, stride_hours: int) -> Column:
    """UTC instants of a local day at a wall-clock stride, as an array."""
    steps = F.sequence(F.lit(0), F.lit(23), F.lit(stride_hours))
    start = date.cast("timestamp")
    return F.transform(steps, lambda h: F.to_utc_timestamp(
        F.timestamp_seconds(F.unix_seconds(start) + h * 3600), zone))


def forecast_hours(ts: Column, zone: Column, step_hours: int, lag_hours: float, stride: int, maximum: int) -> Column:
    """Lead hours from the decision to local midnight by stride, the current one first, capped by the product."""
    cycle = latest_cycle(ts, step_hours, lag_hours)
    now = F.unix_seconds(ts)
    current = F.greatest(F.lit(0), F.ceil((now - F.unix_seconds(cycle)) / 3600).cast("int"))
    next_day = F.date_add(F.to_date(F.from_utc_timestamp(ts, zone)), 1)
    midnight = F.unix_seconds(local_midnight_utc(next_day, zone))
    remaining = F.greatest(F.lit(0), F.ceil((midnight - now) / 3600).cast("int"))
    last = F.least(F.lit(maximum), current + remaining)
    return F.when(last < current, F.array(current)).otherwise(F.sequence(current, last, F.lit(stride)))


def due_delays(age_minutes: Column, delays: list[int], instant_max: float, max_age: float) -> Column:
    """Discovery-delay labels an observation age is due for; each delay ends where the next begins."""
    ordered = sorted(set(delays))
    labels = []
    for index, delay in enumerate(ordered):
        if delay == 0:
            labels.append(F.when(age_minutes <= instant_max, F.lit("instant")))
            continue
        upper = ordered[index + 1] if index + 1 < len(ordered) else max_age + 1
        labels.append(F.when((age_minutes >= delay) & (age_minutes < upper), F.lit(f"{delay}m")))
    return F.when(age_minutes <= max_age, F.array_compact(F.array(*labels))).otherwise(F.array().cast("array<string>"))


def source_reasons(snapshot: Column, decision: Column, observation: Column, resolved: Column,
                   fair: Column, side: Column) -> Column:
    """Every reason a row is not causally usable; an empty array means eligible."""
    misordered = (
        snapshot.isNull() | decision.isNull() | observation.isNull()
        | (observation > decision) | (decision > snapshot)
    )
    return F.array_compact(F.array(
        F.when(misordered, F.lit("INVALID_CAUSAL_TIMESTAMP_ORDER")),
        F.when(resolved <= snapshot, F.lit("NONCAUSAL_OUTCOME_RESOLUTION")),
        F.when(fair.isNull(), F.lit("MISSING_RAW_MODEL_FAIR")),
        F.when(side.isNull() | ~side.isin("BUY_YES", "BUY_NO"), F.lit("INVALID_SELECTED_SIDE")),
    ))
