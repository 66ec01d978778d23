"""Running aggregates that survive hot keys.

A window over one key alone puts the whole key in one task. Here the key is cut into time slices: the running
value is taken inside (key, slice), slice totals are pre-aggregated map-side, and only the totals (one row per
key and slice) are scanned per key. The caller names a slice column that never decreases in the row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def day_slice(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 86_400_000_000)


def running(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column],
            aggregates: dict[str, tuple], inclusive: bool = True) -> DataFrame:
    """Add running columns `{name: (sum|max|min, input[, inclusive])}` in row order per key, in one pass.

    What the slices before add up to enters a slice as one row ahead of its own, so the rows themselves move once; a join of
    rows and totals by null-safe keys would deal them a second time.
    """
    kinds = {n: (COMBINE[spec[0]], spec[2] if len(spec) > 2 else inclusive) for n, spec in aggregates.items()}
    sliced = df.withColumn("_slice", slice_by).withColumns({f"_in_{n}": spec[1] for n, spec in aggregates.items()})
    totals = sliced.groupBy(*keys, "_slice").agg(*[fn(f"_in_{n}").alias(f"_tot_{n}") for n, (fn, _) in kinds.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_slice", *[fn(f"_tot_{n}").over(before).alias(f"_in_{n}") for n, (fn, _) in kinds.items()], F.lit(0).alias("_own"))
    carry = carry.where(F.coalesce(*[F.when(F.col(f"_in_{n}").isNotNull(), True) for n in kinds], F.lit(False)))
    everything = sliced.withColumn("_own", F.lit(1)).unionByName(carry, allowMissingColumns=True)
    part = Window.partitionBy(*keys, "_slice").orderBy("_own", *order)
    upto = {True: part.rowsBetween(Window.unboundedPreceding, 0), False: part.rowsBetween(Window.unboundedPreceding, -1)}
    out = {}
    for n, (fn, i) in kinds.items():
        value = fn(f"_in_{n}").over(upto[i])
        out[n] = F.coalesce(value, F.lit(0)) if aggregates[n][0] == "sum" else value
    return everything.withColumns({f"_at_{n}": c for n, c in out.items()}).where("_own = 1").withColumns({n: F.col(f"_at_{n}") for n in out}).drop(
        "_slice", "_own", *[f"_{k}_{n}" for n in out for k in ("in", "at")])


def neighbour(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column], name: str, value: Column,
              following: bool = False) -> DataFrame:
    """Value of the row before (or after) per key across slices: a lag or lead that never puts a key in one task."""
    sliced = df.withColumns({"_slice": slice_by, "_val": F.struct(value.alias("v")), "_rank": F.struct(*order), "_own": F.lit(1)})
    step = F.lead if following else F.lag
    edge = F.min_by if following else F.max_by
    ends = sliced.groupBy(*keys, "_slice").agg(edge("_val", "_rank").alias("_edge"))
    carry = ends.select(*keys, "_slice", step("_edge").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_val"), F.lit(2 if following else 0).alias("_own"))
    # the row from the other slice stands beside the slice's own, as in `running`
    everything = sliced.unionByName(carry.where("_val is not null"), allowMissingColumns=True)
    near = step("_val").over(Window.partitionBy(*keys, "_slice").orderBy("_own", "_rank"))
    return everything.withColumn("_near", near).where("_own = 1").withColumn(name, F.col("_near.v")).drop("_slice", "_val", "_rank", "_own", "_near")


def drawdown(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column], pnl: Column) -> DataFrame:
    """Per key: total, final running peak (from zero) and largest fall from a peak, in one pass over slices.

    Each slice is reduced to (sum, highest prefix, largest inner fall, lowest prefix); slices are then chained.
    """
    sliced = df.withColumns({"_slice": slice_by, "_p": pnl.cast("double")})
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = sliced.withColumn("_c", F.sum("_p").over(inner))
    run = run.withColumn("_peak", F.greatest(F.lit(0.0), F.max("_c").over(inner)))
    parts = run.groupBy(*keys, "_slice").agg(
        F.sum("_p").alias("_sum"), F.max("_peak").alias("_hi"), F.min("_c").alias("_lo"),
        F.max(F.col("_peak") - F.col("_c")).alias("_fall"))
    over = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    chain = parts.withColumn("_base", F.coalesce(F.sum("_sum").over(over), F.lit(0.0)))
    chain = chain.withColumn("_abs_hi", F.col("_base") + F.col("_hi"))
    chain = chain.withColumn("_seen", F.greatest(F.lit(0.0), F.max("_abs_hi").over(over)))
    fall = F.greatest(F.lit(0.0), F.col("_fall"), F.col("_seen") - (F.col("_base") + F.col("_lo")))
    return chain.groupBy(*keys).agg(
        F.sum("_sum").alias("total_pnl"),
        F.greatest(F.lit(0.0), F.max("_abs_hi")).alias("peak_pnl"),
        F.max(fall).alias("max_drawdown"))


def with_totals(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Group totals beside each row through a partial aggregate and a join, never a whole group in one window."""
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    totals = totals.select(*[F.col(k).alias(f"_t_{k}") for k in keys], *aggregates)
    on = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]
    return df.join(totals, on, "inner").drop(*[f"_t_{k}" for k in keys])
