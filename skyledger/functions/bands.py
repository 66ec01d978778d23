"""Band labels. Each table is data; one helper turns it into a chain of comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: (exclusive upper edge, label); the last label has no edge.
ENTRY_BANDS = [(0.05, "0.00-0.05"), (0.10, "0.05-0.10"), (0.25, "0.10-0.25"), (0.50, "0.25-0.50"), (0.75, "0.50-0.75"),
               (None, "0.75-1.00")]
PROBABILITY_BANDS = [(0.25, "0.00-0.25"), (0.50, "0.25-0.50"), (0.75, "0.50-0.75"), (None, "0.75-1.00")]
EDGE_BANDS = [(0.10, "<0.10"), (0.20, "0.10-0.20"), (0.35, "0.20-0.35"), (None, ">=0.35")]
HOUR_BANDS = [(8, "00-08"), (12, "08-12"), (16, "12-16"), (20, "16-20"), (None, "20-24")]
LIQUIDITY_BANDS = [(25, "0-25"), (50, "25-50"), (100, "50-100"), (None, ">=100")]
WINDOW_BANDS = [(11, "early_09_10"), (13, "midday_11_12"), (None, "late_13_plus")]


def band(value: Column, table: list[tuple[float | None, str]]) -> Column:
    """Left-closed band label; null becomes `missing`."""
    chain = F.when(value.isNull(), F.lit("missing"))
    for edge, label in table:
        chain = chain.otherwise(F.lit(label)) if edge is None else chain.when(value < edge, F.lit(label))
    return chain


def entry_band(value: Column) -> Column:
    return band(value, ENTRY_BANDS)


def probability_band(value: Column) -> Column:
    return band(value, PROBABILITY_BANDS)


def edge_band(value: Column) -> Column:
    return band(value, EDGE_BANDS)


def hour_band(value: Column) -> Column:
    return band(value, HOUR_BANDS)


def liquidity_band(value: Column) -> Column:
    return band(value, LIQUIDITY_BANDS)


def entry_window(hour: Column) -> Column:
    """Training window of a local hour; a missing hour is `unknown`."""
    return F.when(hour.isNull(), F.lit("unknown")).otherwise(band(F.floor(hour), WINDOW_BANDS))


def cloud_regime(cover: Column) -> Column:
    """Cloud cover percent to regime; both edges belong to the outer regimes."""
    return (
        F.when(cover.isNull(), F.lit("MISSING"))
        .when(cover <= 25.0, F.lit("CLEAR"))
        .when(cover >= 75.0, F.lit("CLOUDY"))
        .otherwise(F.lit("MIXED"))
    )


def lifecycle_horizon(local_time: Column, market_date: Column) -> Column:
    """Where a local decision time stands against its market date."""
    return (
        F.when(local_time.isNull(), F.lit("UNKNOWN"))
        .when(F.to_date(local_time) < market_date, F.lit("D_MINUS_1"))
        .when(F.hour(local_time) < 12, F.lit("D0_EARLY"))
        .when(F.hour(local_time) < 16, F.lit("D0_LATE"))
        .otherwise(F.lit("D0_CLOSE"))
    )
