"""Observation features: daily tables, intraday snapshots, horizons, next-day rows, forecast summaries, neighbours."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.times import climate_date
from skyledger.operators import select
from skyledger.operators.dists import threshold_examples


def daily_station(df: DataFrame, metric: str = "high") -> DataFrame:
    """Extreme temperature, first and last observation and count per station and local date."""
    extreme = F.max("tmpf").alias("final_high") if metric == "high" else F.min("tmpf").alias("final_low")
    return df.groupBy("station", "local_date").agg(
        extreme, F.min("valid").alias("first_valid"), F.max("valid").alias("last_valid"), F.count("valid").alias("obs_count"))


def daily_maximum(df: DataFrame, zone: str, standard_day: bool) -> DataFrame:
    """Maximum per climate day, civil or fixed standard time; days without a value are left out."""
    day = climate_date(F.col("valid"), F.col(zone), standard_day)
    return df.where("tmpf is not null").groupBy("station", day.alias("climate_date")).agg(F.max("tmpf").alias("daily_max"))


def snapshots(df: DataFrame, hours: list[int], carry: list[str]) -> DataFrame:
    """Latest row with a temperature at or before local midnight plus each hour, with the extremes up to that row.

    Needs station, local_date, midnight_us (local midnight in UTC microseconds), valid, tmpf. Each row goes to the first cutoff at
    or after it, so a day is reduced to one partial row per cutoff before the running extremes over at most `len(hours)` rows.
    """
    cut = sorted(hours)
    elapsed = F.unix_micros("valid") - F.col("midnight_us")
    slot = F.lit(None).cast("int")
    for h in reversed(cut):
        slot = F.when(elapsed <= h * 3_600_000_000, F.lit(h)).otherwise(slot)
    rows = df.where("tmpf is not null").withColumn("_slot", slot).where("_slot is not null")
    pick = F.struct("valid", "tmpf", *carry)
    rank = F.struct("valid", *carry)
    parts = rows.groupBy("station", "local_date", "_slot").agg(
        F.max("tmpf").alias("_hi"), F.min("tmpf").alias("_lo"), F.max_by(pick, rank).alias("_last"))
    filled = parts.groupBy("station", "local_date").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("_slot"), F.struct("_hi", "_lo", "_last")))).alias("_m"))
    grid = filled.withColumn("hour", F.explode(F.array(*[F.lit(h) for h in cut])))
    seen = F.filter(F.array(*[F.struct(F.lit(h).alias("h"), F.try_element_at("_m", F.lit(h)).alias("v")) for h in cut]),
                    lambda x: x["v"].isNotNull() & (x["h"] <= F.col("hour")))
    grid = grid.withColumn("_s", seen).where(F.size("_s") > 0)
    last = F.element_at("_s", -1)["v"]["_last"]
    hi, lo = F.array_max(F.transform("_s", lambda x: x["v"]["_hi"])), F.array_min(F.transform("_s", lambda x: x["v"]["_lo"]))
    return grid.select("station", "local_date", "hour", last.alias("_l"), hi.alias("max_so_far"), lo.alias("min_so_far")).select(
        "station", "local_date", "hour", F.col("_l.valid").alias("snapshot_at"), F.col("_l.tmpf").alias("current_temp"), *[F.col(f"_l.{c}").alias(c) for c in carry],
        "max_so_far", "min_so_far", (F.col("max_so_far") - F.col("min_so_far")).alias("range_so_far"))


def threshold_dataset(snaps: DataFrame, daily: DataFrame, offsets: list[int], low: bool = False) -> DataFrame:
    """Snapshots of days with a final value, one row per threshold, with the distances to the running values."""
    final = "final_low" if low else "final_high"
    rows = threshold_examples(snaps.join(daily.select("station", "local_date", final), ["station", "local_date"]), final, offsets, low)
    return rows.withColumns({
        "threshold_minus_current": F.col("threshold") - F.col("current_temp"), "threshold_minus_max": F.col("threshold") - F.col("max_so_far"),
        "threshold_minus_min": F.col("threshold") - F.col("min_so_far")})


def select_horizon(df: DataFrame, local_time: str, hour: int, final: str) -> DataFrame:
    """Latest row at or before an exact local cutoff second per station-date, with a flag for conflicting outcomes."""
    seconds = F.hour(local_time) * 3600 + F.minute(local_time) * 60 + F.second(local_time)
    rows = df.where((seconds <= hour * 3600) & F.col(final).isNotNull())
    clash = rows.groupBy("station", "local_date", local_time).agg((F.min(final) != F.max(final)).alias("_c"))
    bad = clash.groupBy("station", "local_date").agg(F.max("_c").alias("conflict"))
    last = select.first_by_scope(rows, ["station", "local_date"], [F.col(local_time).desc(), F.col(final)])
    return last.join(bad, ["station", "local_date"]).withColumn("target_value", F.rint(final).cast("int"))


def next_day(daily: DataFrame, value: str = "final_high") -> DataFrame:
    """Next calendar day's value beside the day, with the prior day and 3- and 7-row means; gaps in the calendar are dropped.

    The input has one row per station and date, so a station is as long as the calendar.
    """
    w = Window.partitionBy("station").orderBy("local_date")
    def mean(n: int) -> Column:
        return F.avg(value).over(w.rowsBetween(-n, -1))
    rows = daily.withColumns({
        "target_date": F.lead("local_date").over(w), "target_value": F.lead(value).over(w), "prior_day": F.lag(value).over(w),
        "prior_3day_mean": mean(3), "prior_7day_mean": mean(7)})
    return rows.where((F.col("target_date") == F.date_add("local_date", 1)) & F.col("target_value").isNotNull())


def distinct_snapshots(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return select.first_by_scope(df, key, order)


def build_dataset(parts: list[DataFrame]) -> DataFrame:
    """Append inputs with differing columns; a missing column becomes null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def summarize_forecast(points: DataFrame, key: list[str]) -> DataFrame:
    """Remaining-day forecast summary per key from point rows ordered by forecast hour.

    Needs forecast_hour, tmpf, dwpf, rh, wind, gust, cloud, shortwave. The first hour comes from a partial aggregate joined back, so the
    3-hour window is a plain condition.
    """
    first = points.groupBy(*key).agg(F.min("forecast_hour").alias("_h0"))
    rows = points.join(first, key)
    near = F.col("forecast_hour") <= F.col("_h0") + 3

    def head(c: str) -> Column:
        return F.max(F.when(F.col("forecast_hour") == F.col("_h0"), F.col(c)))

    def soon(c: str) -> Column:
        return F.when(near, F.col(c))
    last3 = F.max_by(F.struct(F.col("tmpf").alias("v")), F.when(near, F.col("forecast_hour")))["v"]
    return rows.groupBy(*key).agg(
        head("tmpf").alias("current_temp"), F.max("tmpf").alias("remaining_max"), F.min("tmpf").alias("remaining_min"),
        F.max(soon("tmpf")).alias("next_3h_max"), F.avg(soon("tmpf")).alias("next_3h_mean"), (last3 - head("tmpf")).alias("trend_next_3h"),
        head("dwpf").alias("dewpoint_current"), F.avg(soon("dwpf")).alias("dewpoint_next_3h_mean"), F.avg("dwpf").alias("dewpoint_remaining_mean"),
        head("rh").alias("rh_current"), F.avg(soon("rh")).alias("rh_next_3h_mean"), F.avg("rh").alias("rh_remaining_mean"),
        head("wind").alias("wind_current"), F.avg(soon("wind")).alias("wind_next_3h_mean"), F.max("wind").alias("wind_remaining_max"),
        F.max("gust").alias("gust_remaining_max"), head("cloud").alias("cloud_current"), F.avg(soon("cloud")).alias("cloud_next_3h_mean"),
        F.avg("cloud").alias("cloud_remaining_mean"), F.max("cloud").alias("cloud_remaining_max"), F.avg(soon("shortwave")).alias("shortwave_next_3h_mean"),
        F.max("shortwave").alias("shortwave_remaining_max"), F.count(F.lit(1)).cast("double").alias("hours_count"))


def dsr_window(decisions: DataFrame, scans: DataFrame, minutes: int = 60, minimum: int = 3) -> DataFrame:
    """Trailing scans whose end lies in [t-60m, t] and that were available by t: median, mean, deviation and change.

    One row a decision row. A decision needs scans of its own span-wide slot of time and of the slot before, so scans go to two
    slots each and no pair of decision and scan is formed; inside a (station, slot) the window slides over the sorted scans.
    """
    span = minutes * 60_000_000
    # a scan counts from `_in`, when it has ended and is available, and until it is a span old
    end = F.unix_micros("scan_end")
    seen = scans.where("station is not null and scan_end is not null and available_at is not null").select(
        "station", end.alias("_end"), F.greatest(end, F.unix_micros("available_at")).alias("_in"), "scan_id", F.col("dsr").cast("double").alias("dsr"),
        F.explode(F.array(F.floor(end / span), F.floor(end / span) + 1)).alias("_slot")).where(F.col("_in") < (F.col("_slot") + 1) * span)
    at = F.unix_micros("decided_at")
    asked = decisions.where("station is not null and decided_at is not null").select("station", "decision_id", at.alias("_t"), F.floor(at / span).alias("_slot"))
    kind = decisions.schema["decision_id"].dataType.simpleString()
    schema = f"decision_id {kind}, scan_count long, dsr_median double, dsr_mean double, dsr_std double, dsr_latest double, dsr_change double, latest_scan_end long"

    def slide(asked: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        return slide_window(asked, seen, span, minimum)
    out = asked.groupBy("station", "_slot").cogroup(seen.groupBy("station", "_slot")).applyInPandas(slide, schema)
    return out.withColumn("latest_scan_end", F.timestamp_micros("latest_scan_end"))


def slide_window(asked: pd.DataFrame, scans: pd.DataFrame, span: int, minimum: int) -> pd.DataFrame:
    """The window of each decision of one (station, slot), from scans that enter and leave it once. A NaN counts as no value.

    Sums are of differences to the first value and in long doubles, so that what leaves takes away what it brought.
    """
    asked = asked.sort_values("_t", kind="stable")
    scans = scans.sort_values(["_end", "scan_id"], kind="stable")
    ends, enters, values = (scans[c].to_numpy() for c in ("_end", "_in", "dsr"))
    entering = np.argsort(enters, kind="stable").tolist()
    finite = values[np.isfinite(values)]
    base = float(finite[0]) if len(finite) else 0.0
    ends_l, enters_l, values_l = ends.tolist(), enters.tolist(), values.tolist()
    moved = (values - base).astype(np.longdouble)
    present, ordered = [], []  # ranks of the scans in the window, and their values from low to high
    gone, n_next, total, squares, odd = 0, 0, np.longdouble(0), np.longdouble(0), 0
    rows = []
    for t, ident in zip(asked["_t"].tolist(), asked["decision_id"].tolist(), strict=True):
        while n_next < len(entering) and enters_l[entering[n_next]] <= t:
            i, n_next = entering[n_next], n_next + 1
            if ends_l[i] < t - span:
                continue
            insort(present, i, lo=gone)
            if values_l[i] == values_l[i]:
                insort(ordered, values_l[i])
                if math.isinf(values_l[i]):
                    odd += 1
                else:
                    total, squares = total + moved[i], squares + moved[i] * moved[i]
        while gone < len(present) and ends_l[present[gone]] < t - span:
            i, gone = present[gone], gone + 1
            if values_l[i] == values_l[i]:
                del ordered[bisect_left(ordered, values_l[i])]
                if math.isinf(values_l[i]):
                    odd -= 1
                else:
                    total, squares = total - moved[i], squares - moved[i] * moved[i]
        if gone > 4096:
            del present[:gone]
            gone = 0
        count, n = len(present) - gone, len(ordered)
        if count == 0 or count < minimum:
            continue
        first, last = values_l[present[gone]], values_l[present[-1]]
        if n == 0:
            middle = mean = deviation = math.nan
        else:
            middle = ordered[n // 2] if n % 2 else ordered[n // 2 - 1] + 0.5 * (ordered[n // 2] - ordered[n // 2 - 1])
            mean = float(base + total / n) if not odd else sum(ordered) / n
            spread = max(squares / n - (total / n) ** 2, np.longdouble(0))
            deviation = 0.0 if ordered[0] == ordered[-1] else float(np.sqrt(spread)) if not odd else math.nan
        rows.append((ident, count, middle, mean, deviation, last, last - first, ends_l[present[-1]]))
    return pd.DataFrame(rows, columns=["decision_id", "scan_count", "dsr_median", "dsr_mean", "dsr_std", "dsr_latest", "dsr_change", "latest_scan_end"])


def neighbor_features(decisions: DataFrame, observations: DataFrame, model_points: DataFrame, sites: DataFrame, max_age_us: int = 5_400_000_000) -> DataFrame:
    """Weighted neighbour residuals per decision from a fixed target-to-site table.

    `decisions`: decision_id, station, decided_at, target_temp, target_wind, target_speed. `observations`: station, valid, available_at,
    tmpf, dwpf. `model_points`: decision_id, site, model_temp, model_previous. `sites`: station, site, lat, lon, site_lat, site_lon, elevation_gap.
    """
    from skyledger.functions.geo import angle_diff, bearing_deg, haversine_km
    from skyledger.operators.asof import asof_between, asof_join
    from skyledger.plans.evaluation import spatial_means
    from skyledger.session import materialize

    pairs = decisions.join(sites, ["station"]).join(model_points, ["decision_id", "site"])
    obs = observations.withColumnRenamed("station", "site")
    pairs = asof_join(pairs, obs, ["site"], F.col("decided_at"), F.col("available_at"),
                      {"site_temp": F.col("tmpf"), "site_valid": F.col("valid")}, tolerance_us=max_age_us, tie=[F.col("valid")]).drop("matched_us")
    pairs = materialize(pairs.where("site_temp is not null and model_temp is not null"))
    pairs = asof_between(pairs, obs, ["site"], F.col("site_valid"), F.col("valid"), {"past_temp": F.col("tmpf"), "past_valid": F.col("valid")},
                         120 * 60_000_000, 30 * 60_000_000).drop("matched_us")
    hours = (F.unix_micros("site_valid") - F.unix_micros("past_valid")) / 3.6e9
    warming = (F.col("site_temp") - F.col("past_temp")) / F.when(hours > 0, hours) - (F.col("model_temp") - F.col("model_previous"))
    distance = haversine_km(F.col("lat"), F.col("lon"), F.col("site_lat"), F.col("site_lon"))
    bearing = bearing_deg(F.col("lat"), F.col("lon"), F.col("site_lat"), F.col("site_lon"))
    upwind = F.when(F.col("target_wind").isNull(), 1.0).otherwise(F.exp(-0.5 * F.pow(angle_diff(bearing, F.col("target_wind")) / 45.0, F.lit(2.0))))
    base = F.exp(-distance / 100.0) * F.exp(-F.abs("elevation_gap") / 300.0)
    speed = F.greatest(F.coalesce("target_speed", F.lit(0.0)) * 1.15078 * 1.60934, F.lit(8.0))
    pairs = pairs.withColumns({
        "residual": F.col("site_temp") - F.col("model_temp"), "warming": warming, "gradient": F.col("site_temp") - F.col("target_temp"),
        "base_weight": base, "upwind_weight": base * upwind, "travel": distance / speed})
    return spatial_means(pairs, ["decision_id"], {
        "weighted_residual": ("residual", "base_weight"), "upwind_residual": ("residual", "upwind_weight"),
        "warming_residual": ("warming", "upwind_weight"), "temp_gradient": ("gradient", "upwind_weight")}, "residual", "travel")
