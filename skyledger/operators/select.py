"""First-per-scope, modes and top-k. Every order is total: ties end in an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators.ranks import exact_position


def first_by_scope(df: DataFrame, scope: list[str], order: list[Column]) -> DataFrame:
    """First row of each scope. Spark limits each map task to one row per scope before the shuffle."""
    return top_n(df, scope, order, 1).drop("rank")


def top_n(df: DataFrame, scope: list[str], order: list[Column], n: int) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def latest_by(df: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    return first_by_scope(df, scope, [F.col(c).desc() for c in order])


SCOPES = {
    "station_date": [],
    "station_date_bucket_side": ["selected_bucket", "selected_side"],
    "station_date_bucket_side_obs_delay": ["selected_bucket", "selected_side", "obs_delay_bucket"],
}


def scope_columns(mode: str, by_strategy: bool = False) -> list[str]:
    if mode not in SCOPES:
        raise ValueError(f"unknown uniqueness scope: {mode}")
    return ["station", "market_date", "market_family", *SCOPES[mode], *(["strategy_bucket"] if by_strategy else [])]


def apply_mode(df: DataFrame, mode: str, scope: list[str], ts: str = "ts", ident: str = "id", edge: str = "edge",
               liquidity: str = "liquidity", pnl: str = "pnl") -> DataFrame:
    """One row per scope by the named mode; a missing ranking value sorts below every number."""
    by_time = [F.col(ts), F.col(ident)]
    orders = {
        "first_opportunity": by_time,
        "first_station_date": by_time,
        "best_edge": [F.col(edge).desc_nulls_last(), *by_time],
        "best_liquidity": [F.col(liquidity).desc_nulls_last(), *by_time],
        "hindsight_best": [F.col(pnl).desc_nulls_last(), *by_time],
    }
    keys = ["station", "market_date"] if mode == "first_station_date" else scope
    return first_by_scope(df, keys, orders[mode])


def sample_group(df: DataFrame, group: str, slice_by: Column, order: list[Column], limit: int,
                 strategy: str = "even") -> DataFrame:
    """Head or evenly spaced rows of each group, in row order."""
    if strategy == "head":
        return top_n(df, [group], order, limit).drop("rank")
    numbered = exact_position(df, [group], slice_by, order)
    position, total = F.col("_pos") - 1, F.col("_total")
    if limit == 1:
        keep = position == 0
    else:
        # row p is kept when some slot i of 0..limit-1 rounds (half-even) to p
        guess = F.floor(position * (limit - 1) / F.greatest(total - 1, F.lit(1)))
        slots = F.array(guess - 1, guess, guess + 1, guess + 2)
        hit = F.exists(slots, lambda i: (i >= 0) & (i < limit) & (F.rint(i * (total - 1) / (limit - 1)) == position))
        keep = (total <= limit) | hit
    return numbered.where(keep).drop("_pos", "_total")
