"""Intervals: containment joins, trailing windows, gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators import scan

HOUR = 3_600_000_000


def bucketed_range_join(points: DataFrame, intervals: DataFrame, on: list[str], point_us: Column, start_us: Column,
                        end_us: Column, bucket_us: int = HOUR, how: str = "inner") -> DataFrame:
    """Points in `[start, end]`: intervals are spread over the buckets they touch, so the join is an equi join.

    An open interval (null end) is closed at the last point of the whole input, a one-row aggregate.
    """
    pts = points.withColumns({"_p": point_us, "_b": F.floor(point_us / bucket_us)})
    last = points.agg(F.max(point_us).alias("_last"))
    ivs = intervals.withColumns({"_s": start_us, "_e": end_us}).join(F.broadcast(last), F.lit(True))
    ivs = ivs.withColumn("_e", F.greatest("_s", F.coalesce("_e", "_last"))).drop("_last")
    ivs = ivs.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / bucket_us), F.floor(F.col("_e") / bucket_us))))
    ivs = ivs.select(*[F.col(k).alias(f"_i_{k}") for k in on], F.col("_b").alias("_i_b"), "_s", "_e",
                     *[F.col(c) for c in intervals.columns if c not in on])
    cond = [F.col(k) == F.col(f"_i_{k}") for k in on] + [
        F.col("_b") == F.col("_i_b"), F.col("_p") >= F.col("_s"), F.col("_p") <= F.col("_e")]
    return pts.join(ivs, cond, how).drop("_p", "_b", "_i_b", "_s", "_e", *[f"_i_{k}" for k in on])


def trailing_totals(decisions: DataFrame, events: DataFrame, on: list[str], decision_id: str, decision_us: Column,
                    event_us: Column, span_us: int, measures: dict[str, Column], slice_us: int = 86_400_000_000) -> DataFrame:
    """Sums over events in `[t-span, t]` per decision as the difference of two running sums.

    Work is linear in events plus decisions; no (decision, event) pair is ever formed.
    """
    names = list(measures)
    zero = [F.lit(0.0).alias(n) for n in names]
    ev = events.select(*on, event_us.alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_id"),
                       F.lit(0).alias("_sign"), *[c.cast("double").alias(n) for n, c in measures.items()])
    # an upper probe sorts after equal event times, a lower probe before them
    ids = F.col(decision_id).cast("string").alias("_id")
    hi = decisions.select(*on, decision_us.alias("_t"), F.lit(2).alias("_side"), ids, F.lit(1).alias("_sign"), *zero)
    lo = decisions.select(*on, (decision_us - span_us).alias("_t"), F.lit(0).alias("_side"), ids,
                          F.lit(-1).alias("_sign"), *zero)
    run = scan.running(ev.unionByName(hi).unionByName(lo), on, F.floor(F.col("_t") / slice_us),
                       [F.col("_t"), F.col("_side")], {f"_run_{n}": ("sum", F.col(n)) for n in names})
    return run.where(F.col("_sign") != 0).groupBy(*on, F.col("_id").alias(decision_id)).agg(
        *[F.sum(F.col(f"_run_{n}") * F.col("_sign")).alias(n) for n in names])


def state_intervals(events: DataFrame, keys: list[str], ts: str, order: list[Column], state: str) -> DataFrame:
    """Maximal runs of one state per key; a run ends where the next begins, the last one stays open."""
    prior = scan.neighbour(events, keys, scan.day_slice(F.col(ts)), order, "_before", F.col(state))
    starts = prior.where(F.col("_before").isNull() | (F.col("_before") != F.col(state)))
    nxt = scan.neighbour(
        starts, keys, scan.day_slice(F.col(ts)), order, "ended_at", F.col(ts), following=True)
    return nxt.select(*keys, F.col(state).alias("state"), F.col(ts).alias("started_at"), "ended_at")


def coverage_gaps(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Gap before each interval, measured from the furthest end seen so far; overlap gives zero."""
    furthest = scan.running(intervals, keys, scan.day_slice(F.col(start)), [F.col(start), F.col(end)],
                            {"_reach": ("max", F.unix_micros(F.col(end)))}, inclusive=False)
    gap = (F.unix_micros(F.col(start)) - F.col("_reach")) / 1e6
    return furthest.withColumn("gap_seconds", F.when(F.col("_reach").isNotNull(), F.greatest(F.lit(0.0), gap))).drop("_reach")


def covering_interval(points: DataFrame, intervals: DataFrame, on: list[str], start_by: Column, until_us: Column,
                      start: str, end: str, ident: str, slice_us: int = 86_400_000_000) -> DataFrame:
    """Add `interval_id` and `interval_start`: an interval begun by `start_by` that lasts to `until_us`, else null.

    The latest begun interval is taken when it reaches far enough, else the furthest reaching one, so the answer is
    whole even where intervals of one key overlap. An open interval never ends.
    """
    from skyledger.operators.asof import asof_join

    far = 2**62
    ends = intervals.withColumn("_end_us", F.coalesce(F.unix_micros(F.col(end)), F.lit(far)))
    reach = scan.running(ends, on, scan.day_slice(F.col(start)), [F.col(start), F.col(ident)], {
        "_reach": ("max", F.struct(F.col("_end_us").alias("e"), F.unix_micros(F.col(start)).alias("s"), F.col(ident).alias("i")))})
    take = {"_iv": F.struct(F.col("_end_us").alias("e"), F.unix_micros(F.col(start)).alias("s"), F.col(ident).alias("i")), "_rv": F.col("_reach")}
    rows = asof_join(points, reach, on, start_by, F.col(start), take, tie=[F.col(ident)], slice_us=slice_us, prefix="_c")
    best = F.when(F.col("_c_iv.e") >= until_us, F.col("_c_iv")).when(F.col("_c_rv.e") >= until_us, F.col("_c_rv"))
    return rows.withColumn("_best", best).withColumns({
        "interval_id": F.col("_best.i"), "interval_start": F.timestamp_micros("_best.s"),
        "latest_interval_end_us": F.col("_c_iv.e")}).drop("_best", "_c_iv", "_c_rv", "_cmatched_us")
