"""As-of joins by union and last-non-null.

Both sides are tagged, unioned and sorted once per (key, time slice), so the cost is linear in the rows and a hot key
is spread over its slices. The last right row of the earlier slices enters a slice as one extra row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_time: Column,
    right_time: Column,
    take: dict[str, Column],
    direction: str = "backward",
    exact: bool = True,
    tolerance_us: int | None = None,
    tie: list[Column] | None = None,
    slice_us: int = DAY,
    prefix: str = "",
) -> DataFrame:
    """Add the matched right row's `take` columns and its time (`{prefix}matched_us`) to every left row.

    `backward` picks the latest right row at or before the left time, `forward` the first at or after it, `nearest`
    the closer of both (an exact tie takes the earlier row). `exact=False` excludes equal times. Equal right times
    are ordered by `tie` ascending: backward takes the last, forward the first. The tolerance is applied after the
    pick, so a stale match gives null and never an older row. Rows with a null time or key match nothing.
    """
    names = list(take)
    picked = right.select(
        *on,
        F.unix_micros(right_time).alias("_t"),
        F.struct(*(tie or [F.lit(0)])).alias("_tie"),
        F.struct(F.unix_micros(right_time).alias("_rt"), *[c.alias(n) for n, c in take.items()]).alias("_row"),
    ).where(F.col("_t").isNotNull())
    probe = left.select(*on, F.unix_micros(left_time).alias("_t"), F.struct("*").alias("_left"))

    wanted = ["backward", "forward"] if direction in ("nearest", "both") else [direction]
    slots = {}
    for way in wanted:
        slots[way] = _carries(probe, picked, on, slice_us, way)

    tie_type = picked.schema["_tie"].dataType
    row_type = picked.schema["_row"].dataType
    left_type = probe.schema["_left"].dataType
    null_tie, null_row = F.lit(None).cast(tie_type), F.lit(None).cast(row_type)

    def slot(t: Column) -> Column:
        return F.floor(t / slice_us)

    rows = picked.select(*on, slot(F.col("_t")).alias("_slice"), "_t", F.lit(1).alias("_side"), "_tie", "_row",
                         F.lit(None).cast(left_type).alias("_left"))
    probes = probe.select(*on, slot(F.col("_t")).alias("_slice"), "_t", F.lit(2 if exact else 0).alias("_side"),
                          null_tie.alias("_tie"), null_row.alias("_row"), "_left")
    everything = rows.unionByName(probes)
    for way, carry in slots.items():
        # a carry row sorts before (backward) or after (forward) everything else of its slice
        edge = -1 if way == "backward" else 3
        everything = everything.unionByName(carry.select(
            *on, "_slice", F.lit(-(2**62) if way == "backward" else 2**62).alias("_t"), F.lit(edge).alias("_side"),
            null_tie.alias("_tie"), F.col("_carry").alias("_row"), F.lit(None).cast(left_type).alias("_left")))

    part = Window.partitionBy(*on, "_slice")
    running = Window.unboundedPreceding, Window.currentRow
    picks = {}
    if "backward" in wanted:
        order = part.orderBy("_t", "_side", "_tie").rowsBetween(*running)
        usable = F.when(F.col("_side") <= 1, F.col("_row"))
        picks["_back"] = F.last(usable, ignorenulls=True).over(order)
    if "forward" in wanted:
        # read from the far end, so the frame stays a cheap running one; equal times sort against the probe
        backwards = F.when(F.col("_side") == 2, F.lit(0)).when(F.col("_side") == 0, F.lit(2)).otherwise(F.col("_side"))
        order = part.orderBy(F.col("_t").desc(), backwards.desc(), F.col("_tie").desc()).rowsBetween(*running)
        usable = F.when((F.col("_side") == 1) | (F.col("_side") == 3), F.col("_row"))
        picks["_fore"] = F.last(usable, ignorenulls=True).over(order)
    matched = everything.withColumns(picks).where(F.col("_left").isNotNull())

    if direction == "both":
        return matched.select("_left.*", F.col("_back").alias(f"{prefix}before"), F.col("_fore").alias(f"{prefix}after"))
    if direction == "nearest":
        back, fore = F.col("_back"), F.col("_fore")
        behind, ahead = F.col("_t") - back["_rt"], fore["_rt"] - F.col("_t")
        choice = F.when(back.isNull(), fore).when(fore.isNull() | (behind <= ahead), back).otherwise(fore)
    else:
        choice = F.col("_back" if direction == "backward" else "_fore")
    matched = matched.select("_left", "_t", choice.alias("_m"))
    if tolerance_us is not None:
        close = F.abs(F.col("_t") - F.col("_m._rt")) <= tolerance_us
        matched = matched.withColumn("_m", F.when(close, F.col("_m")))
    return matched.select(
        "_left.*", F.col("_m._rt").alias(f"{prefix}matched_us"), *[F.col(f"_m.{n}").alias(f"{prefix}{n}") for n in names])


def both_sides(left: DataFrame, right: DataFrame, on: list[str], left_time: Column, right_time: Column, take: dict[str, Column],
               tie: list[Column] | None = None, slice_us: int = DAY) -> DataFrame:
    """The matches on both sides of the left time from one pass: structs `before` and `after`, each with its time `_rt`."""
    return asof_join(left, right, on, left_time, right_time, take, "both", tie=tie, slice_us=slice_us)


def _carries(probe: DataFrame, picked: DataFrame, on: list[str], slice_us: int, way: str) -> DataFrame:
    """One row per (key, slice): the nearest right row outside the slice on the side the direction looks to."""
    slot = F.floor(F.col("_t") / slice_us).alias("_slice")
    rank = F.struct("_t", "_tie")
    best = F.max_by("_row", rank) if way == "backward" else F.min_by("_row", rank)
    ends = picked.groupBy(*on, slot).agg(best.alias("_end"))
    wanted = probe.select(*on, slot).distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))
    both = ends.unionByName(wanted).groupBy(*on, "_slice").agg(F.first("_end", ignorenulls=True).alias("_end"))
    order = F.col("_slice") if way == "backward" else F.col("_slice").desc()
    outside = Window.partitionBy(*on).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carry = both.withColumn("_carry", F.last("_end", ignorenulls=True).over(outside))
    return carry.where(F.col("_carry").isNotNull()).select(*on, "_slice", "_carry")


def value_change(df: DataFrame, key: str, ts: str, value: str, lookback_us: int, tolerance_us: int,
                 name: str) -> DataFrame:
    """Value now minus the nearest non-null value one lookback earlier, within a tolerance."""
    known = df.where(F.col(value).isNotNull()).select(key, ts, value)
    target = F.timestamp_micros(F.unix_micros(F.col(ts)) - lookback_us)
    joined = asof_join(df, known, [key], target, F.col(ts), {"_past": F.col(value)}, "nearest",
                       tolerance_us=tolerance_us, prefix="_vc")
    return joined.withColumn(name, F.col(value) - F.col("_vc_past")).drop("_vc_past", "_vcmatched_us")


def asof_latest(decisions: DataFrame, observations: DataFrame, on: list[str], decision_time: Column,
                available_at: Column, take: dict[str, Column], max_age_us: int, tie: list[Column] | None = None,
                slice_us: int = DAY) -> DataFrame:
    """Latest row already available at the decision; a latest row older than the bound gives null."""
    return asof_join(decisions, observations, on, decision_time, available_at, take, tolerance_us=max_age_us,
                     tie=tie, slice_us=slice_us)


def asof_between(left: DataFrame, right: DataFrame, on: list[str], left_time: Column, right_time: Column,
                 take: dict[str, Column], oldest_us: int, newest_us: int, tie: list[Column] | None = None) -> DataFrame:
    """Last right row whose time lies between `oldest_us` and `newest_us` before the left time.

    The latest row up to the near end is the only candidate, so it is one backward as-of with the span as tolerance.
    """
    near = F.timestamp_micros(F.unix_micros(left_time) - newest_us)
    return asof_join(left, right, on, near, right_time, take, tolerance_us=oldest_us - newest_us, tie=tie)
