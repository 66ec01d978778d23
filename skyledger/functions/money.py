"""Quantised prices, sizes, ids and the price-sheet scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def q_price(x: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) + 1e-12, 4)


def q_usdc(x: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), x) + 1e-12, 2)


def q_shares(x: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), x) + 1e-12, 6)


def floor_tick(x: Column, tick: float) -> Column:
    """Largest tick multiple not above the value, never negative."""
    return F.round(F.floor(F.greatest(F.lit(0.0), x) / tick + 1e-12) * tick, 10)


def stable_id(*columns: Column | str) -> Column:
    """Content identity: sha256 over the JSON form of the columns in name order."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def market_reference(book_ts: Column, ready: Column, stated_age: Column, bid: Column, ask: Column,
                     fallback_ask: Column, max_age: float) -> Column:
    """Reference price by ordered rules with the flag that explains it."""
    age = F.coalesce(stated_age, (F.unix_micros(ready) - F.unix_micros(book_ts)) / 1e6)
    def unit(c: Column) -> Column:
        return F.when((c >= 0) & (c <= 1), c)
    b, a, f = unit(bid), unit(ask), unit(fallback_ask)

    def out(price: Column, kind: str, flag: str | None) -> Column:
        return F.struct(price.cast("double").alias("price"), F.lit(kind).alias("kind"),
                        age.alias("age"), F.lit(flag).cast("string").alias("flag"))
    missing = F.lit(None)
    return (
        F.when(book_ts > ready, out(missing, "MISSING", "FUTURE_MARKET_REFERENCE"))
        .when(age < 0, out(missing, "MISSING", "NEGATIVE_MARKET_REFERENCE_AGE"))
        .when(age > max_age, out(missing, "MISSING", "STALE_MARKET_REFERENCE"))
        .when(b > a, out(missing, "MISSING", "CROSSED_MARKET_REFERENCE"))
        .when(b.isNotNull() & a.isNotNull(), out(F.bround((b + a) / 2, 6), "MIDPOINT", None))
        .when(a.isNotNull(), out(a, "SAME_SIDE_ASK", None))
        .when(f.isNotNull(), out(f, "SAME_SIDE_ASK", "MARKET_REFERENCE_SELECTED_ASK_FALLBACK"))
        .otherwise(out(missing, "MISSING", "MISSING_MARKET_REFERENCE"))
    )
