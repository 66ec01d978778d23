"""Observation features and scalar functions over events, and store tables over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import geo, times, weather
from skyledger.plans import evaluation, features, reports
from skyledger.queries.registry import query
from skyledger.queries.views import OBS_SQL, SIGNAL_SQL, observations, signals, table
from skyledger.sources import artifacts, markets

LOCAL_SQL = OBS_SQL + """, v_loc AS (SELECT *, CASE station % 3 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Asia/Tokyo' ELSE 'Asia/Kolkata' END AS tz, CASE station % 3 WHEN 0 THEN valid WHEN 1 THEN valid + INTERVAL 540 MINUTE ELSE valid + INTERVAL 330 MINUTE END AS loc FROM v_obs)"""


def local_obs(spark, sf):
    zone = F.when(F.col("station") % 3 == 0, "UTC").when(F.col("station") % 3 == 1, "Asia/Tokyo").otherwise("Asia/Kolkata")
    df = times.localize(observations(spark, sf).withColumn("tz", zone), "valid", "tz")
    return df.withColumn("midnight_us", F.unix_micros(times.local_midnight_utc(F.col("local_date"), F.col("tz"))))


@query("x01_localize", f"""WITH {LOCAL_SQL} SELECT station, CAST(loc AS DATE) AS local_date, count(*) AS n, sum(hour(loc))::BIGINT AS hours, sum(minute(loc))::BIGINT AS minutes, max(dayofyear(loc))::BIGINT AS doy FROM v_loc GROUP BY ALL""", dates="local_date")
def x01(spark, sf):
    return local_obs(spark, sf).groupBy("station", "local_date").agg(F.count(F.lit(1)).alias("n"), F.sum("hour_local").alias("hours"), F.sum("minute_local").alias("minutes"), F.max("day_of_year").cast("long").alias("doy"))


@query("x02_cyclic", f"""WITH {OBS_SQL} SELECT station, sum(sin(radians(drct))) AS s, sum(cos(radians(drct))) AS c, sum(sin(2 * pi() * dayofyear(valid) / 365.25)) AS ds FROM v_obs GROUP BY station""", "s c ds")
def x02(spark, sf):
    s, c = weather.cyclic(F.col("drct"), 360.0)
    return observations(spark, sf).groupBy("station").agg(F.sum(s).alias("s"), F.sum(c).alias("c"), F.sum(weather.cyclic(F.dayofyear("valid"), 365.25)[0]).alias("ds"))


@query("x03_wet_bulb", f"""WITH {OBS_SQL}, w AS (SELECT station, (tmpf - 32.0) * 5.0 / 9.0 AS t, least(greatest(CASE WHEN k % 4 <> 0 THEN relh END, 1.0), 100.0) AS rh, k, (dwpf - 32.0) * 5.0 / 9.0 AS d FROM v_obs), z AS (SELECT station, coalesce(CASE WHEN k % 4 <> 0 THEN t * atan(0.151977 * sqrt(rh + 8.313659)) + atan(t + rh) - atan(rh - 1.676331) + 0.00391838 * pow(rh, 1.5) * atan(0.023101 * rh) - 4.686035 END, t - (t - d) * 0.35) * 9.0 / 5.0 + 32.0 AS wb FROM w)
  SELECT station, count(wb) AS n, sum(wb) AS total FROM z GROUP BY station""", "total", 4)
def x03(spark, sf):
    humid = F.when(F.col("k") % 4 != 0, F.col("relh"))
    return observations(spark, sf).withColumn("wb", weather.wet_bulb(F.col("tmpf"), F.col("dwpf"), humid)).groupBy("station").agg(F.count("wb").alias("n"), F.sum("wb").alias("total"))


@query("x04_cloud_code", f"""WITH {OBS_SQL}, c AS (SELECT station, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'CLR' WHEN 2 THEN 'few' WHEN 3 THEN 'BKN' ELSE 'OVC' END AS a, CASE WHEN k % 3 = 0 THEN 'SCT' END AS b FROM v_obs)
  SELECT station, CASE WHEN a IS NULL AND b IS NULL THEN -1 WHEN a = 'OVC' THEN 3 WHEN a = 'BKN' THEN 2 WHEN a = 'few' OR b = 'SCT' THEN 1 ELSE 0 END AS code, count(*) AS n FROM c GROUP BY ALL""")
def x04(spark, sf):
    a = F.element_at(F.array(F.lit(None).cast("string"), F.lit("CLR"), F.lit("few"), F.lit("BKN"), F.lit("OVC")), F.col("k") % 5 + 1)
    code = weather.cloud_code(a, F.when(F.col("k") % 3 == 0, "SCT"), F.lit(None).cast("string"))
    return observations(spark, sf).groupBy("station", code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("x05_unit_conversion", f"""WITH {OBS_SQL} SELECT station, sum(round_even((k * 2.0 - 32.0) * 5.0 / 9.0, 1)) AS c, sum((k + 250.0 - 273.15) * 9.0 / 5.0 + 32.0) AS f FROM v_obs GROUP BY station""", "c f", 4)
def x05(spark, sf):
    return observations(spark, sf).groupBy("station").agg(F.sum(weather.f_to_c(F.col("k") * 2.0)).alias("c"), F.sum(weather.k_to_f(F.col("k") + 250.0)).alias("f"))


GEO = "(station * 2.0 + 25) AS la, (k * 0.7 - 120) AS lo"


@query("x06_geo", f"""WITH {OBS_SQL}, g AS (SELECT station, {GEO}, 40.0 AS lb, -75.0 AS mb FROM v_obs), x AS (SELECT station, 12742.0 * asin(sqrt(pow(sin(radians(lb - la) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin(radians(mb - lo) / 2), 2))) AS km,
  degrees(atan2(sin(radians(mb - lo)) * cos(radians(lb)), cos(radians(la)) * sin(radians(lb)) - sin(radians(la)) * cos(radians(lb)) * cos(radians(mb - lo)))) + 360.0 AS b FROM g)
  SELECT station, sum(km) AS km, sum(b - floor(b / 360) * 360) AS bearing, sum(abs((b - 90.0 + 180.0) - floor((b - 90.0 + 180.0) / 360) * 360 - 180.0)) AS diff FROM x GROUP BY station""", "km bearing diff", 4)
def x06(spark, sf):
    la, lo = F.col("station") * 2.0 + 25, F.col("k") * 0.7 - 120
    b = geo.bearing_deg(la, lo, F.lit(40.0), F.lit(-75.0))
    return observations(spark, sf).groupBy("station").agg(F.sum(geo.haversine_km(la, lo, F.lit(40.0), F.lit(-75.0))).alias("km"), F.sum(b).alias("bearing"), F.sum(geo.angle_diff(b, F.lit(90.0))).alias("diff"))


@query("x07_toa_irradiance", f"""WITH {OBS_SQL}, a AS (SELECT station, station * 2.0 + 25 AS lat, k * 0.7 - 120 AS lon, dayofyear(valid) AS d, hour(valid) * 60.0 + minute(valid) + second(valid) / 60.0 AS m FROM v_obs), g AS (SELECT *, 2 * pi() / 365.0 * (d - 1 + (m / 60.0 - 12.0) / 24.0) AS g FROM a),
  s AS (SELECT *, m + 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) + 4.0 * lon AS sm, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS dec FROM g),
  z AS (SELECT station, greatest(0.0, 1361.0 * (1.0 + 0.033 * cos(2 * pi() * d / 365.0)) * (sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(radians((sm - floor(sm / 1440) * 1440) / 4.0 - 180.0)))) AS toa FROM s) SELECT station, sum(toa) AS total, count(*) FILTER (WHERE toa > 0) AS lit FROM z GROUP BY station""", "total", 3)
def x07(spark, sf):
    toa = geo.toa_irradiance(F.col("station") * 2.0 + 25, F.col("k") * 0.7 - 120, F.date_trunc("second", "valid"))
    return observations(spark, sf).groupBy("station").agg(F.sum(toa).alias("total"), F.sum((toa > 0).cast("int")).alias("lit"))


@query("x08_dsr_window", f"""WITH {OBS_SQL}, d AS (SELECT obs_id, station, valid FROM v_obs), j AS (SELECT d.obs_id AS decision_id, s.tmpf AS dsr, s.valid AS e FROM d JOIN v_obs s ON s.station = d.station AND s.tmpf IS NOT NULL AND s.valid BETWEEN d.valid - INTERVAL 6 HOUR AND d.valid AND s.valid + INTERVAL 2 MINUTE <= d.valid)
  SELECT decision_id, count(*) AS scan_count, quantile_cont(dsr, 0.5) AS dsr_median, avg(dsr) AS dsr_mean, stddev_pop(dsr) AS dsr_std, arg_max(dsr, e) AS dsr_latest, arg_max(dsr, e) - arg_min(dsr, e) AS dsr_change FROM j GROUP BY decision_id HAVING count(*) >= 3""", "dsr_median dsr_mean dsr_std dsr_latest dsr_change")
def x08(spark, sf):
    obs = observations(spark, sf)
    d = obs.selectExpr("obs_id AS decision_id", "station", "valid AS decided_at")
    scans = obs.where("tmpf is not null").selectExpr("station", "valid AS scan_end", "valid + INTERVAL 2 MINUTES AS available_at", "tmpf AS dsr", "obs_id AS scan_id")
    return features.dsr_window(d, scans, 360, 3).drop("latest_scan_end")


@query("a01_daily_station", f"""WITH {LOCAL_SQL} SELECT station, CAST(loc AS DATE) AS local_date, max(tmpf) AS final_high, epoch_us(min(valid)) AS first_us, epoch_us(max(valid)) AS last_us, count(valid) AS obs_count FROM v_loc GROUP BY ALL""", "final_high", dates="local_date")
def a01(spark, sf):
    d = features.daily_station(local_obs(spark, sf))
    return d.select("station", "local_date", "final_high", F.unix_micros("first_valid").alias("first_us"), F.unix_micros("last_valid").alias("last_us"), "obs_count")


@query("a02_daily_maximum", f"""WITH {LOCAL_SQL} SELECT station, CAST(loc AS DATE) AS climate_date, max(tmpf) AS daily_max FROM v_loc WHERE tmpf IS NOT NULL GROUP BY ALL""", "daily_max", dates="climate_date")
def a02(spark, sf):
    return features.daily_maximum(local_obs(spark, sf), "tz", True)


SNAP_SQL = LOCAL_SQL + """, h AS (SELECT unnest([10, 12, 14]) AS hour), days AS (SELECT DISTINCT station, CAST(loc AS DATE) AS local_date FROM v_loc), j AS (SELECT d.station, d.local_date, h.hour, l.valid, l.tmpf, l.obs_id FROM days d, h, v_loc l WHERE l.station = d.station AND CAST(l.loc AS DATE) = d.local_date AND l.tmpf IS NOT NULL AND l.loc <= d.local_date + to_hours(h.hour)),
  v_snap AS (SELECT station, local_date, hour, max(valid) AS snapshot_at, arg_max(tmpf, valid) AS current_temp, max(tmpf) AS max_so_far, min(tmpf) AS min_so_far, max(tmpf) - min(tmpf) AS range_so_far FROM j GROUP BY ALL)"""


def snaps(spark, sf):
    return features.snapshots(local_obs(spark, sf), [10, 12, 14], ["obs_id"])


@query("w01_snapshots", f"WITH {SNAP_SQL} SELECT station, local_date, hour, epoch_us(snapshot_at) AS at_us, current_temp, max_so_far, min_so_far, range_so_far FROM v_snap", "current_temp max_so_far min_so_far range_so_far", dates="local_date")
def w01(spark, sf):
    return snaps(spark, sf).select("station", "local_date", "hour", F.unix_micros("snapshot_at").alias("at_us"), "current_temp", "max_so_far", "min_so_far", "range_so_far")


@query("d03_threshold_dataset", f"""WITH {SNAP_SQL}, f AS (SELECT station, CAST(loc AS DATE) AS local_date, max(tmpf) AS fh FROM v_loc GROUP BY ALL), t AS (SELECT s.*, fh, round_even(fh + o, 0) AS th FROM v_snap s JOIN f USING (station, local_date), (SELECT unnest([-2, -1, 0, 1, 2]) AS o))
  SELECT station, count(*) AS n, sum(CASE WHEN fh >= th THEN 1 ELSE 0 END)::BIGINT AS targets, sum(th - current_temp) AS a, sum(th - max_so_far) AS b, sum(th - min_so_far) AS c FROM t GROUP BY station""", "a b c")
def d03b(spark, sf):
    rows = features.threshold_dataset(snaps(spark, sf), features.daily_station(local_obs(spark, sf)), [-2, -1, 0, 1, 2])
    return rows.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("targets"), F.sum("threshold_minus_current").alias("a"), F.sum("threshold_minus_max").alias("b"), F.sum("threshold_minus_min").alias("c"))


@query("w02_select_horizon", f"""WITH {LOCAL_SQL}, r AS (SELECT *, CAST(loc AS DATE) AS local_date, row_number() OVER (PARTITION BY station, CAST(loc AS DATE) ORDER BY date_trunc('second', loc) DESC, tmpf) AS rn FROM v_loc WHERE tmpf IS NOT NULL AND hour(loc) * 3600 + minute(loc) * 60 + second(loc) <= 43200)
  SELECT station, local_date, CAST(round_even(tmpf, 0) AS INTEGER) AS target_value, obs_id FROM r WHERE rn = 1""", dates="local_date")
def w02(spark, sf):
    df = local_obs(spark, sf).withColumn("at", F.date_trunc("second", "valid_local"))
    return features.select_horizon(df, "at", 12, "tmpf").select("station", "local_date", "target_value", "obs_id")


@query("w03_next_day", f"""WITH {LOCAL_SQL}, d AS (SELECT station, CAST(loc AS DATE) AS local_date, max(tmpf) AS fh FROM v_loc GROUP BY ALL), w AS (SELECT *, lead(local_date) OVER o AS td, lead(fh) OVER o AS tv, lag(fh) OVER o AS pd, avg(fh) OVER (PARTITION BY station ORDER BY local_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS p3, avg(fh) OVER (PARTITION BY station ORDER BY local_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS p7 FROM d WINDOW o AS (PARTITION BY station ORDER BY local_date))
  SELECT station, local_date, tv AS target_value, pd AS prior_day, p3 AS prior_3day_mean, p7 AS prior_7day_mean FROM w WHERE td = local_date + 1 AND tv IS NOT NULL""", "target_value prior_day prior_3day_mean prior_7day_mean", dates="local_date")
def w03(spark, sf):
    return features.next_day(features.daily_station(local_obs(spark, sf))).select("station", "local_date", "target_value", "prior_day", "prior_3day_mean", "prior_7day_mean")


@query("a03_summarize_forecast", """WITH p AS (SELECT l_orderkey AS key, l_linenumber AS h, max(l_quantity) AS t, max(l_discount) AS d, max(l_tax) AS r FROM lineitem GROUP BY ALL), f AS (SELECT *, min(h) OVER (PARTITION BY key) AS h0 FROM p)
  SELECT key, max(CASE WHEN h = h0 THEN t END) AS current_temp, max(t) AS remaining_max, min(t) AS remaining_min, max(CASE WHEN h <= h0 + 3 THEN t END) AS next_3h_max, avg(CASE WHEN h <= h0 + 3 THEN t END) AS next_3h_mean, arg_max(t, CASE WHEN h <= h0 + 3 THEN h END) - max(CASE WHEN h = h0 THEN t END) AS trend_next_3h,
   avg(d) AS dewpoint_remaining_mean, avg(CASE WHEN h <= h0 + 3 THEN r END) AS rh_next_3h_mean, CAST(count(*) AS DOUBLE) AS hours_count FROM f GROUP BY key""", "current_temp remaining_max remaining_min next_3h_max next_3h_mean trend_next_3h dewpoint_remaining_mean rh_next_3h_mean hours_count")
def a03(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("forecast_hour")).agg(
        F.max("l_quantity").alias("tmpf"), F.max("l_discount").alias("dwpf"), F.max("l_tax").alias("rh"))
    p = p.withColumns({c: F.lit(0.0) for c in ("wind", "gust", "cloud", "shortwave")})
    return features.summarize_forecast(p, ["key"]).select("key", "current_temp", "remaining_max", "remaining_min", "next_3h_max", "next_3h_mean", "trend_next_3h", "dewpoint_remaining_mean", "rh_next_3h_mean", "hours_count")


@query("a28_spatial_means", f"""WITH {OBS_SQL} SELECT obs_id % 500 AS decision, count(*) AS neighbor_count, sum(CASE WHEN tmpf IS NOT NULL AND k % 7 > 0 THEN tmpf * (k % 7) END) / sum(CASE WHEN tmpf IS NOT NULL AND k % 7 > 0 THEN k % 7 END) AS weighted, stddev_pop(tmpf) AS boundary_score, min(dwpf) AS min_travel_hours FROM v_obs GROUP BY ALL""", "weighted boundary_score min_travel_hours")
def a28(spark, sf):
    df = observations(spark, sf).withColumns({"decision": F.col("obs_id") % 500, "w": (F.col("k") % 7).cast("double")})
    return evaluation.spatial_means(df, ["decision"], {"weighted": ("tmpf", "w")}, "tmpf", "dwpf")


@query("j15_neighbor_features")
def j15(spark, sf):
    obs = observations(spark, sf)
    d = obs.selectExpr("obs_id AS decision_id", "station", "valid AS decided_at", "tmpf AS target_temp", "drct AS target_wind", "relh / 5 AS target_speed")
    stations = obs.select("station").distinct()
    sites = stations.select("station", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("step")).select(
        "station", ((F.col("station") + F.col("step")) % 20).alias("site"), (F.col("station") * 0.3 + 30).alias("lat"), F.lit(-90.0).alias("lon"),
        (F.col("station") * 0.3 + 30 + F.col("step") * 0.2).alias("site_lat"), F.lit(-90.2).alias("site_lon"), (F.col("step") * 40.0).alias("elevation_gap"))
    model = d.join(sites.select("station", "site"), ["station"]).select("decision_id", "site", (60 + F.col("decision_id") % 9).cast("double").alias("model_temp"), F.lit(59.0).alias("model_previous"))
    seen = obs.where("tmpf is not null").selectExpr("station", "valid", "valid + INTERVAL 5 MINUTES AS available_at", "tmpf", "dwpf")
    return features.neighbor_features(d, seen, model, sites)


@query("f15_latest_cycle", f"""WITH {OBS_SQL}, c AS (SELECT station, CAST(floor((epoch(valid) - 5400) / 3600) AS BIGINT) AS h FROM v_obs) SELECT station, max((h - (h % 24) % 6) * 3600) AS last_cycle, count(DISTINCT h - (h % 24) % 6) AS cycles FROM c GROUP BY station""")
def f15(spark, sf):
    c = times.latest_cycle(F.col("valid"), 6, 1.5)
    return observations(spark, sf).groupBy("station").agg(F.max(F.unix_seconds(c)).alias("last_cycle"), F.countDistinct(c).alias("cycles"))


@query("f15_valid_times", f"""WITH {LOCAL_SQL}, d AS (SELECT DISTINCT station, CAST(loc AS DATE) AS d, CASE station % 3 WHEN 0 THEN 0 WHEN 1 THEN 540 ELSE 330 END AS off FROM v_loc) SELECT station, count(*) AS n, max(epoch_us(d + to_hours(h) - to_minutes(off))) AS last_us FROM d, (SELECT unnest([0, 3, 6, 9, 12, 15, 18, 21]) AS h) GROUP BY station""")
def f15b(spark, sf):
    days = local_obs(spark, sf).select("station", "local_date", "tz").distinct()
    t = days.select("station", F.explode(times.valid_times(F.col("local_date"), F.col("tz"), 3)).alias("t"))
    return t.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("t")).alias("last_us"))


@query("f16_forecast_plan", f"""WITH {LOCAL_SQL}, c AS (SELECT station, floor(epoch(valid)) AS now, (CAST(floor((floor(epoch(valid)) - 3600) / 3600) AS BIGINT)) * 3600 AS cyc, epoch(CAST(loc AS DATE) + 1) - CASE station % 3 WHEN 0 THEN 0 WHEN 1 THEN 32400 ELSE 19800 END AS mid FROM v_loc),
  p AS (SELECT station, greatest(0, CAST(ceil((now - cyc) / 3600) AS INTEGER)) AS h0, greatest(0, CAST(ceil((mid - now) / 3600) AS INTEGER)) AS rem FROM c) SELECT station, sum(h0)::BIGINT AS leads, sum(len(range(h0, least(18, h0 + rem) + 1, 3)))::BIGINT AS hours FROM p GROUP BY station""")
def f16(spark, sf):
    plan = times.forecast_hours(F.col("valid"), F.col("tz"), 1, 1.0, 3, 18)
    return local_obs(spark, sf).withColumn("p", plan).groupBy("station").agg(F.sum(F.col("p")[0]).alias("leads"), F.sum(F.size("p")).alias("hours"))


@query("u01_build_dataset", f"""WITH {OBS_SQL}, {SIGNAL_SQL} SELECT count(*) AS n, count(tmpf) AS temps, count(edge) AS edges FROM (SELECT tmpf, NULL AS edge FROM v_obs UNION ALL SELECT NULL, edge FROM v_signal)""")
def u01(spark, sf):
    both = features.build_dataset([observations(spark, sf).select(F.col("station").cast("string"), "tmpf"), signals(spark, sf).select("station", "edge")])
    return both.agg(F.count(F.lit(1)).alias("n"), F.count("tmpf").alias("temps"), F.count("edge").alias("edges"))


@query("u02_distinct_snapshots", f"""WITH {SIGNAL_SQL} SELECT station, count(DISTINCT (market_date, minute_of_day % 60)) AS n FROM v_signal GROUP BY station""")
def u02(spark, sf):
    df = signals(spark, sf).withColumn("slot", F.col("minute_of_day") % 60)
    return features.distinct_snapshots(df, ["station", "market_date", "slot"], [F.col("id"), F.col("liquidity")]).groupBy("station").agg(F.count(F.lit(1)).alias("n"))


# ---- truth sources and artifacts ----

TRUTH_SQL = SIGNAL_SQL + """, v_truth AS (SELECT station, market_date, 'S' || substr(model_name, 2) AS source, max(60 + cost % 8) AS value FROM v_signal WHERE model_name <> 'm3' GROUP BY ALL), v_venue AS (SELECT station, market_date, min(60 + cost % 8) AS lo FROM v_signal WHERE model_name = 'm3' GROUP BY ALL)"""


def truths(spark, sf):
    df = signals(spark, sf)
    t = df.where("model_name <> 'm3'").groupBy("station", "market_date", F.concat(F.lit("S"), F.substring("model_name", 2, 9)).alias("source")).agg(F.max(60 + F.col("cost") % 8).alias("value"))
    t = t.withColumns({"value_lower": F.lit(None).cast("double"), "value_upper": F.lit(None).cast("double"), "error": F.lit(None).cast("string")})
    v = df.where("model_name = 'm3'").groupBy("station", "market_date").agg(F.min(60 + F.col("cost") % 8).alias("lo"))
    return t, v.select("station", "market_date", F.struct(F.col("lo").alias("lower"), (F.col("lo") + 4).alias("upper")).alias("bucket"))


@query("j14_truth_pairs", f"""WITH {TRUTH_SQL}, t AS (SELECT t.*, v.lo IS NOT NULL AS has, value >= lo AND value <= lo + 4 AS ok FROM v_truth t LEFT JOIN v_venue v USING (station, market_date))
  SELECT a.station, a.source AS source_left, b.source AS source_right, count(*) AS dates_compared, count(*) FILTER (WHERE a.value = b.value) AS exact_matches, count(*) FILTER (WHERE abs(a.value - b.value) >= 1) AS one_degree_or_more, count(*) FILTER (WHERE abs(a.value - b.value) >= 2) AS two_degrees_or_more, avg(a.value - b.value) AS mean_signed_difference, avg(abs(a.value - b.value)) AS mean_absolute_difference, max(abs(a.value - b.value)) AS max_absolute_difference,
   count(*) FILTER (WHERE a.has) AS venue_dates, count(*) FILTER (WHERE a.has AND NOT a.ok) AS left_mismatches, count(*) FILTER (WHERE a.has AND NOT b.ok) AS right_mismatches, count(*) FILTER (WHERE a.has AND a.ok <> b.ok) AS classification_disagreements FROM t a JOIN t b ON a.station = b.station AND a.market_date = b.market_date AND a.source < b.source GROUP BY ALL""", "mean_signed_difference mean_absolute_difference max_absolute_difference")
def j14(spark, sf):
    return reports.truth_pairs(*truths(spark, sf))


@query("j21_truth_matrix", f"""WITH {TRUTH_SQL}, ks AS (SELECT station, market_date FROM v_truth UNION SELECT station, market_date FROM v_venue), t AS (SELECT t.*, CASE WHEN lo IS NOT NULL THEN value >= lo AND value <= lo + 4 END AS ok FROM v_truth t LEFT JOIN v_venue USING (station, market_date))
  SELECT k.station, k.market_date, max(value) FILTER (WHERE source = 'S0') AS "S0_value", max(value) FILTER (WHERE source = 'S1') AS "S1_value", CASE WHEN count(*) FILTER (WHERE source = 'S0') = 0 THEN 'MISSING' ELSE '' END AS "S0_error", CASE WHEN bool_or(ok) FILTER (WHERE source = 'S1') THEN 'yes' WHEN NOT bool_or(ok) FILTER (WHERE source = 'S1') THEN 'no' ELSE 'unknown' END AS "S1_matches" FROM ks k LEFT JOIN t ON t.station = k.station AND t.market_date = k.market_date GROUP BY ALL""", "S0_value S1_value", dates="market_date")
def j21(spark, sf):
    m = reports.truth_matrix(*truths(spark, sf), ["S0", "S1"])
    match = F.when(F.col("S1_matches"), "yes").when(~F.col("S1_matches"), "no").otherwise("unknown")
    return m.select("station", "market_date", "S0_value", "S1_value", F.coalesce("S0_error", F.lit("")).alias("S0_error"), match.alias("S1_matches"))


@query("a51_truth_decision", f"""WITH {TRUTH_SQL}, t AS (SELECT source, value >= lo AND value <= lo + 4 AS ok FROM v_truth JOIN v_venue USING (station, market_date)), c AS (SELECT source, count(*) AS comparable, count(*) FILTER (WHERE NOT ok) AS mismatches FROM t GROUP BY source)
  SELECT *, mismatches / comparable AS mismatch_rate, row_number() OVER (ORDER BY mismatches / comparable, source) = 1 AS chosen FROM c""", "mismatch_rate")
def a51(spark, sf):
    return reports.truth_decision(reports.truth_matrix(*truths(spark, sf), ["S0", "S1", "S2"]), ["S0", "S1", "S2"])


@query("s09_parse_markets", f"""WITH {SIGNAL_SQL}, q AS (SELECT 'Will the highest temperature in NYC be ' || CASE WHEN selected_bucket LIKE '<=%' THEN substr(selected_bucket, 3) || '°F or below' WHEN selected_bucket LIKE '>=%' THEN regexp_extract(selected_bucket, '([0-9]+)', 1) || '°F or higher' ELSE 'between ' || replace(selected_bucket, 'F', '') || '°F' END || ' on ' || strftime(market_date, '%B %-d, %Y') || '?' AS question, * FROM v_signal)
  SELECT CASE WHEN selected_bucket LIKE '<=%' THEN NULL ELSE CAST(regexp_extract(selected_bucket, '([0-9]+)', 1) AS DOUBLE) END AS lower, CASE WHEN selected_bucket LIKE '>=%' THEN NULL WHEN selected_bucket LIKE '<=%' THEN CAST(regexp_extract(selected_bucket, '([0-9]+)', 1) AS DOUBLE) ELSE CAST(regexp_extract(selected_bucket, '-([0-9]+)', 1) AS DOUBLE) END AS upper, market_date, count(*) AS n FROM q GROUP BY ALL""", dates="market_date")
def s09(spark, sf):
    b = F.col("selected_bucket")
    text = F.when(b.startswith("<="), F.concat(F.substring(b, 3, 9), F.lit("°F or below"))).when(b.startswith(">="), F.concat(F.regexp_extract(b, "([0-9]+)", 1), F.lit("°F or higher"))).otherwise(F.concat(F.lit("between "), F.replace(b, F.lit("F"), F.lit("")), F.lit("°F")))
    q = signals(spark, sf).withColumn("question", F.concat(F.lit("Will the highest temperature in NYC be "), text, F.lit(" on "), F.date_format("market_date", "MMMM d, yyyy"), F.lit("?"))).drop("market_date")
    return markets.parse_markets(q, "question").groupBy("lower", "upper", "market_date").agg(F.count(F.lit(1)).alias("n"))


@query("s10_artifact_coverage", """WITH a AS (SELECT lang AS source_id, source AS source_key, sha256(text) AS sha, n_chars, doc_id FROM documents), d AS (SELECT DISTINCT source_id, source_key, sha FROM a), k AS (SELECT source_id, count(*) FILTER (WHERE n > 1) AS revised FROM (SELECT source_id, source_key, count(*) AS n FROM d GROUP BY ALL) GROUP BY source_id)
  SELECT a.source_id, count(*) AS artifacts, sum(n_chars)::BIGINT AS bytes, min(doc_id) AS first_seen, max(doc_id) AS last_seen, any_value(k.revised) AS revised_keys FROM a JOIN k ON k.source_id = a.source_id GROUP BY a.source_id""")
def s10(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("source_id"), F.col("source").alias("source_key"), F.sha2("text", 256).alias("content_sha256"), F.col("n_chars").alias("byte_count"),
                                            F.timestamp_seconds("doc_id").alias("causal_available_at"), F.col("source").alias("station"), F.lit("2024-01-01").cast("date").alias("market_date"))
    out = artifacts.artifact_coverage(d)
    return out.select("source_id", "artifacts", "bytes", F.unix_seconds("first_causal").alias("first_seen"), F.unix_seconds("last_causal").alias("last_seen"), "revised_keys")


@query("s11_ingest_artifacts", """WITH a AS (SELECT lang, source, sha256(text) AS sha, doc_id FROM documents), o AS (SELECT DISTINCT lang, source, sha FROM a WHERE doc_id % 3 = 0), n AS (SELECT DISTINCT lang, source, sha FROM a) SELECT n.lang AS source_id, count(*) AS new_artifacts FROM n LEFT JOIN o USING (lang, source, sha) WHERE o.sha IS NULL GROUP BY n.lang""")
def s11(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("source_id"), F.col("source").alias("source_key"), F.sha2("text", 256).alias("content_sha256"), "doc_id",
                                            F.timestamp_seconds("doc_id").alias("first_observed_at"), F.lit(None).cast("timestamp").alias("provider_available_at"), F.lit("FIRST_OBSERVED").alias("time_rule"))
    old = artifacts.identify(d.where("doc_id % 3 = 0"))
    return artifacts.ingest_artifacts(d, old).groupBy("source_id").agg(F.count(F.lit(1)).alias("new_artifacts"))
