"""Predicates, bands, selection, slices and leaderboards over signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import bands, buckets, money, prob, times
from skyledger.operators import folds, metrics, scan, select
from skyledger.plans import leaderboard as lb
from skyledger.queries.registry import query
from skyledger.queries.views import SIGNAL_SQL, signals

ORDER = ["ts", "id", "liquidity"]
SQL_ORDER = "ts, id, liquidity"


def positions(spark, sf_dir):
    """Signals as policy positions: the policy is the model and strategy."""
    return signals(spark, sf_dir).withColumn("policy", F.concat_ws("/", "model_name", "strategy_bucket"))


POSITION_SQL = SIGNAL_SQL + ", v_pos AS (SELECT *, model_name || '/' || strategy_bucket AS policy FROM v_signal)"


@query("f01_in_range", f"""WITH {SIGNAL_SQL} SELECT station, count(*) AS n FROM v_signal
  WHERE correct IS NOT NULL AND pnl >= -0.5 AND pnl <= 0.5 GROUP BY station""")
def f01(spark, sf):
    return signals(spark, sf).where(buckets.in_range(F.col("pnl"), -0.5, 0.5)).groupBy("station").agg(F.count(F.lit(1)).alias("n"))


POLICY_WHERE = """station NOT IN ('s3', 's7') AND selected_side = 'BUY_NO' AND entry BETWEEN 0.1 AND 0.6
  AND fair BETWEEN 0.2 AND 0.9 AND edge >= 0.05 AND selected_bucket NOT LIKE '<=%' AND selected_bucket NOT LIKE '>=%'
  AND minute_of_day >= 600 AND minute_of_day < 960"""


@query("f02_policy_filter", f"""WITH {SIGNAL_SQL} SELECT model_name, count(*) AS n, avg(edge) AS avg_edge FROM v_signal
  WHERE {POLICY_WHERE} GROUP BY model_name""", "avg_edge")
def f02(spark, sf):
    from skyledger.plans.policies import PolicySpec, policy_filter

    spec = PolicySpec(name="p", source="model", exclude=("s3", "s7"), side="BUY_NO", entry=(0.1, 0.6), fair=(0.2, 0.9),
                      edge=(0.05, None), bucket_type="range", local_window=("10:00", "16:00"))
    return policy_filter(signals(spark, sf), spec).groupBy("model_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("edge").alias("avg_edge"))


@query("f03_policy_candidates", f"""WITH {SIGNAL_SQL} SELECT source, count(*) AS n, min(id) AS first_id FROM (
  SELECT 'm1' AS source, id FROM v_signal WHERE model_name = 'm1' AND strategy_bucket <> 'PROGRESS'
  UNION ALL SELECT 'progress', id FROM v_signal WHERE strategy_bucket = 'PROGRESS') GROUP BY source""")
def f03(spark, sf):
    from skyledger.plans.policies import policy_candidates

    df = signals(spark, sf)
    return policy_candidates(df, {"m1": "model", "progress": "progress"}).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("f04_selected_value", f"""WITH {SIGNAL_SQL} SELECT selected_side, count(v) AS kept, avg(v) AS mean_value FROM (
  SELECT selected_side, CASE WHEN x >= 0 AND x <= 1 THEN x END AS v FROM (
    SELECT selected_side, CASE selected_side WHEN 'BUY_YES' THEN edge WHEN 'BUY_NO' THEN 1 - edge END AS x FROM v_signal))
  GROUP BY selected_side""", "mean_value")
def f04(spark, sf):
    value = buckets.side_probability(F.col("selected_side"), F.col("edge"), 1 - F.col("edge"))
    return signals(spark, sf).withColumn("v", value).groupBy("selected_side").agg(
        F.count("v").alias("kept"), F.avg("v").alias("mean_value"))


BOUND_SQL = """CASE WHEN selected_bucket LIKE '<=%' THEN NULL ELSE CAST(regexp_extract(selected_bucket, '([0-9]+)', 1) AS DOUBLE) END AS lower,
  CASE WHEN selected_bucket LIKE '>=%' THEN NULL WHEN selected_bucket LIKE '<=%' THEN CAST(regexp_extract(selected_bucket, '([0-9]+)', 1) AS DOUBLE)
       ELSE CAST(regexp_extract(selected_bucket, '-([0-9]+)', 1) AS DOUBLE) END AS upper"""


@query("f05_parse_bucket", f"""WITH {SIGNAL_SQL}, b AS (SELECT *, {BOUND_SQL} FROM v_signal)
  SELECT selected_bucket, lower, upper, count(*) AS n,
    sum(CASE WHEN (lower IS NULL OR 60 + cost >= lower) AND (upper IS NULL OR 60 + cost <= upper) THEN 1 ELSE 0 END)::BIGINT AS won
  FROM b GROUP BY ALL""")
def f05(spark, sf):
    df = signals(spark, sf).withColumn("_b", buckets.parse_bucket(F.col("selected_bucket")))
    won = buckets.bucket_won(60 + F.col("cost"), F.col("_b"))
    return df.groupBy("selected_bucket", F.col("_b.lower").alias("lower"), F.col("_b.upper").alias("upper")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(won.cast("int")).alias("won"))


@query("f06_ladder_contains", f"""WITH {SIGNAL_SQL}, b AS (SELECT *, {BOUND_SQL} FROM v_signal)
  SELECT station, sum(CASE WHEN (lower IS NULL OR 60 + cost >= lower) AND (upper IS NULL OR 60 + cost < upper) THEN 1 ELSE 0 END)::BIGINT AS inside
  FROM b GROUP BY station""")
def f06(spark, sf):
    df = signals(spark, sf).withColumn("_b", buckets.parse_bucket(F.col("selected_bucket")))
    inside = buckets.ladder_contains(60 + F.col("cost"), F.col("_b.lower"), F.col("_b.upper"))
    return df.groupBy("station").agg(F.sum(inside.cast("int")).alias("inside"))


@query("f07_bands", f"""WITH {SIGNAL_SQL} SELECT
  CASE WHEN entry < 0.05 THEN '0.00-0.05' WHEN entry < 0.1 THEN '0.05-0.10' WHEN entry < 0.25 THEN '0.10-0.25' WHEN entry < 0.5 THEN '0.25-0.50' WHEN entry < 0.75 THEN '0.50-0.75' ELSE '0.75-1.00' END AS entry_band,
  CASE WHEN fair < 0.25 THEN '0.00-0.25' WHEN fair < 0.5 THEN '0.25-0.50' WHEN fair < 0.75 THEN '0.50-0.75' ELSE '0.75-1.00' END AS probability_band,
  CASE WHEN edge < 0.1 THEN '<0.10' WHEN edge < 0.2 THEN '0.10-0.20' WHEN edge < 0.35 THEN '0.20-0.35' ELSE '>=0.35' END AS edge_band,
  count(*) AS n FROM v_signal GROUP BY ALL""")
def f07(spark, sf):
    return signals(spark, sf).groupBy(
        bands.entry_band(F.col("entry")).alias("entry_band"), bands.probability_band(F.col("fair")).alias("probability_band"),
        bands.edge_band(F.col("edge")).alias("edge_band")).agg(F.count(F.lit(1)).alias("n"))


@query("f08_hour_liquidity_bands", f"""WITH {SIGNAL_SQL} SELECT
  CASE WHEN h < 8 THEN '00-08' WHEN h < 12 THEN '08-12' WHEN h < 16 THEN '12-16' WHEN h < 20 THEN '16-20' ELSE '20-24' END AS hour_band,
  CASE WHEN liq IS NULL THEN 'missing' WHEN liq < 25 THEN '0-25' WHEN liq < 50 THEN '25-50' WHEN liq < 100 THEN '50-100' ELSE '>=100' END AS liquidity_band,
  count(*) AS n FROM (SELECT minute_of_day // 60 AS h, CASE WHEN correct IS NOT NULL THEN liquidity END AS liq FROM v_signal) GROUP BY ALL""")
def f08(spark, sf):
    liquidity = F.when(F.col("correct").isNotNull(), F.col("liquidity"))
    return signals(spark, sf).groupBy(
        bands.hour_band(F.hour("ts")).alias("hour_band"), bands.liquidity_band(liquidity).alias("liquidity_band")).agg(
        F.count(F.lit(1)).alias("n"))


@query("f09_entry_window", f"""WITH {SIGNAL_SQL} SELECT CASE WHEN h IS NULL THEN 'unknown' WHEN h < 11 THEN 'early_09_10' WHEN h < 13 THEN 'midday_11_12' ELSE 'late_13_plus' END AS entry_window,
  count(*) AS n FROM (SELECT CASE WHEN correct IS NOT NULL THEN minute_of_day // 60 END AS h FROM v_signal) GROUP BY ALL""")
def f09(spark, sf):
    hour = F.when(F.col("correct").isNotNull(), F.hour("ts"))
    return signals(spark, sf).groupBy(bands.entry_window(hour).alias("entry_window")).agg(F.count(F.lit(1)).alias("n"))


@query("f10_lifecycle_horizon", f"""WITH {SIGNAL_SQL} SELECT CASE WHEN CAST(ts AS DATE) < d THEN 'D_MINUS_1' WHEN hour(ts) < 12 THEN 'D0_EARLY' WHEN hour(ts) < 16 THEN 'D0_LATE' ELSE 'D0_CLOSE' END AS horizon,
  count(*) AS n FROM (SELECT ts, CAST(market_date + CAST(cost AS INTEGER) % 7 AS DATE) AS d FROM v_signal) GROUP BY ALL""")
def f10(spark, sf):
    day = F.date_add("market_date", F.col("cost").cast("int") % 7)
    return signals(spark, sf).groupBy(bands.lifecycle_horizon(F.col("ts"), day).alias("horizon")).agg(F.count(F.lit(1)).alias("n"))


@query("f11_source_reasons", f"""WITH {SIGNAL_SQL}, r AS (SELECT array_to_string(list_filter([
   CASE WHEN correct IS NULL OR obs > ts OR ts > snap THEN 'INVALID_CAUSAL_TIMESTAMP_ORDER' END,
   CASE WHEN res <= snap THEN 'NONCAUSAL_OUTCOME_RESOLUTION' END,
   CASE WHEN f IS NULL THEN 'MISSING_RAW_MODEL_FAIR' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM (SELECT *, ts - to_minutes(CAST(cost AS INTEGER)) + to_minutes(5) AS obs, ts + to_minutes(CAST(cost AS INTEGER)) - to_minutes(3) AS snap,
   ts + to_minutes(60 - 2 * CAST(cost AS INTEGER)) AS res, CASE WHEN edge >= 0 AND edge <= 1 THEN edge END AS f FROM v_signal))
  SELECT reasons, count(*) AS n FROM r GROUP BY ALL""")
def f11(spark, sf):
    df = signals(spark, sf)
    def at(minutes):
        return F.timestamp_seconds(F.unix_seconds("ts") + minutes * 60)
    cost = F.col("cost").cast("int")
    observed = F.when(F.col("correct").isNotNull(), at(5 - cost))
    reasons = times.source_reasons(at(cost - 3), F.col("ts"), observed, at(60 - 2 * cost),
                                   F.when((F.col("edge") >= 0) & (F.col("edge") <= 1), F.col("edge")), F.col("selected_side"))
    return df.select(F.concat_ws(",", reasons).alias("reasons")).groupBy("reasons").agg(F.count(F.lit(1)).alias("n"))


@query("f12_due_delay_buckets", f"""WITH {SIGNAL_SQL}, a AS (SELECT obs_delay_bucket, cost * 1.0 AS age FROM v_signal),
  d AS (SELECT * FROM (VALUES ('instant', -1.0, 3.0, 1), ('5m', 5.0, 10.0, 0), ('10m', 10.0, 15.0, 0), ('15m', 15.0, 30.0, 0), ('30m', 30.0, 46.0, 0)) t(label, lo, hi, closed))
  SELECT obs_delay_bucket, label, count(*) AS n FROM a JOIN d ON age >= lo AND (age < hi OR (closed = 1 AND age <= hi)) AND age <= 45 GROUP BY ALL""")
def f12(spark, sf):
    labels = times.due_delays(F.col("cost"), [0, 5, 10, 15, 30], 3.0, 45.0)
    return signals(spark, sf).select("obs_delay_bucket", F.explode(labels).alias("label")).groupBy(
        "obs_delay_bucket", "label").agg(F.count(F.lit(1)).alias("n"))


@query("f14_cloud_regime", f"""WITH {SIGNAL_SQL} SELECT CASE WHEN c IS NULL THEN 'MISSING' WHEN c <= 25 THEN 'CLEAR' WHEN c >= 75 THEN 'CLOUDY' ELSE 'MIXED' END AS regime, count(*) AS n
  FROM (SELECT CASE WHEN correct IS NOT NULL THEN cost * 2 END AS c FROM v_signal) GROUP BY ALL""")
def f14(spark, sf):
    cover = F.when(F.col("correct").isNotNull(), F.col("cost") * 2)
    return signals(spark, sf).groupBy(bands.cloud_regime(cover).alias("regime")).agg(F.count(F.lit(1)).alias("n"))


@query("w05_first_scope_pnl", f"""WITH {SIGNAL_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY station, market_date, market_family ORDER BY {SQL_ORDER}) AS rn FROM v_signal)
  SELECT station, count(*) AS n, count(pnl) AS resolved, sum(pnl) AS pnl, sum(CASE WHEN pnl IS NOT NULL THEN entry END) AS risk FROM f WHERE rn = 1 GROUP BY station""", "pnl risk")
def w05(spark, sf):
    first = select.first_by_scope(signals(spark, sf), select.scope_columns("station_date"), ORDER)
    return first.groupBy("station").agg(
        F.count(F.lit(1)).alias("n"), F.count("pnl").alias("resolved"), F.sum("pnl").alias("pnl"),
        F.sum(F.when(F.col("pnl").isNotNull(), F.col("entry"))).alias("risk"))


MODES = {
    "first_opportunity": "ts, id, liquidity", "best_edge": "edge DESC, ts, id, liquidity",
    "best_liquidity": "liquidity DESC, ts, id", "hindsight_best": "pnl DESC NULLS LAST, ts, id, liquidity"}
OPP = "strategy_bucket, station, market_date, market_family, selected_bucket, selected_side, obs_delay_bucket"
MODE_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS mode, id, pnl, entry FROM (SELECT *, row_number() OVER (PARTITION BY station, market_date, selected_side ORDER BY {o}) AS rn FROM v_signal) WHERE rn = 1"
    for m, o in MODES.items())


@query("w06_modes", f"""WITH {SIGNAL_SQL}, m AS ({MODE_SQL})
  SELECT mode, count(*) AS n, sum(pnl) AS pnl, sum(entry) AS entry, count(pnl) AS resolved FROM m GROUP BY mode""", "pnl entry")
def w06(spark, sf):
    df = signals(spark, sf)
    scope = ["station", "market_date", "selected_side"]
    out = None
    for mode in MODES:
        part = select.apply_mode(df.withColumn("liq2", F.col("liquidity")), mode, scope).select(F.lit(mode).alias("mode"), "pnl", "entry")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"), F.sum("entry").alias("entry"),
                                   F.count("pnl").alias("resolved"))


@query("w04_drawdown", f"""WITH {SIGNAL_SQL}, c AS (SELECT station, ts, id, liquidity, sum(pnl) OVER (PARTITION BY station ORDER BY {SQL_ORDER} ROWS UNBOUNDED PRECEDING) AS cum FROM v_signal WHERE pnl IS NOT NULL),
  p AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY station ORDER BY {SQL_ORDER} ROWS UNBOUNDED PRECEDING)) AS peak FROM c),
  t AS (SELECT station, sum(pnl) AS total_pnl FROM v_signal GROUP BY station)
  SELECT p.station, any_value(t.total_pnl) AS total_pnl, max(peak) AS peak_pnl, greatest(0, max(peak - cum)) AS max_drawdown FROM p JOIN t ON p.station = t.station GROUP BY p.station""",
       "total_pnl peak_pnl max_drawdown")
def w04(spark, sf):
    return scan.drawdown(signals(spark, sf).where("pnl is not null"), ["station"], scan.day_slice(F.col("ts")), ORDER, F.col("pnl"))


@query("w13_in_window", f"""WITH {SIGNAL_SQL}, l AS (SELECT max(market_date) AS last FROM v_signal WHERE pnl IS NOT NULL)
  SELECT w.name AS "window", count(*) AS n, sum(pnl) AS pnl FROM v_signal, l, (VALUES ('7', 7), ('30', 30), ('all', 999999)) w(name, days)
  WHERE pnl IS NOT NULL AND datediff('day', market_date, last) >= 0 AND datediff('day', market_date, last) < days GROUP BY w.name""", "pnl")
def w13(spark, sf):
    rows = signals(spark, sf).where("pnl is not null")
    last = rows.agg(F.max("market_date").alias("_last"))
    tagged = lb.in_windows(rows.join(F.broadcast(last), F.lit(True)), F.col("_last"), windows=(("7", 7), ("30", 30), ("all", 999999)))
    return tagged.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"))


@query("w12_greedy_cap", f"""WITH RECURSIVE {SIGNAL_SQL},
  r AS (SELECT station, market_date, id, cost, row_number() OVER (PARTITION BY station, market_date ORDER BY {SQL_ORDER}) AS rn FROM v_signal),
  f AS (SELECT station, market_date, rn, CASE WHEN cost <= 60 THEN cost ELSE 0 END AS used, cost <= 60 AS taken FROM r WHERE rn = 1
   UNION ALL SELECT r.station, r.market_date, r.rn, CASE WHEN f.used + r.cost <= 60 THEN f.used + r.cost ELSE f.used END, f.used + r.cost <= 60
   FROM f JOIN r ON r.station = f.station AND r.market_date = f.market_date AND r.rn = f.rn + 1)
  SELECT station, count(*) FILTER (WHERE taken) AS taken, sum(mx) AS used FROM (SELECT station, market_date, taken, CASE WHEN rn = max(rn) OVER (PARTITION BY station, market_date) THEN used ELSE 0 END AS mx FROM f) GROUP BY station""", "used")
def w12(spark, sf):
    kept = folds.greedy_cap(signals(spark, sf), ["station", "market_date"], ["ts", "id", "liquidity"], "cost", 60.0)
    return kept.groupBy("station").agg(F.count(F.lit(1)).alias("taken"), F.sum("cost").alias("used"))


@query("w12_equal_cost_cap", f"""WITH {SIGNAL_SQL}, r AS (SELECT station, pnl, row_number() OVER (PARTITION BY station, market_date ORDER BY {SQL_ORDER}) AS rn FROM v_signal)
  SELECT station, count(*) AS n, sum(pnl) AS pnl FROM r WHERE rn <= 4 GROUP BY station""", "pnl")
def w12b(spark, sf):
    kept = folds.equal_cost_cap(signals(spark, sf), ["station", "market_date"], ORDER, 25.0, 100.0)
    return kept.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"))


@query("w07_edge_improve", f"""WITH RECURSIVE {SIGNAL_SQL},
  r AS (SELECT station, selected_side, edge, row_number() OVER (PARTITION BY station, selected_side ORDER BY {SQL_ORDER}) AS rn FROM v_signal),
  m AS (SELECT *, max(CASE WHEN edge > 0 THEN edge END) OVER (PARTITION BY station, selected_side ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM r),
  c AS (SELECT *, row_number() OVER (PARTITION BY station, selected_side ORDER BY rn) AS k FROM m WHERE rn = 1 OR (edge > 0 AND (best IS NULL OR edge > best))),
  f AS (SELECT station, selected_side, k, edge, CASE WHEN edge > 0 THEN edge END AS last, true AS kept FROM c WHERE k = 1
   UNION ALL SELECT c.station, c.selected_side, c.k, c.edge, CASE WHEN f.last IS NULL OR c.edge >= 1.5 * f.last THEN c.edge ELSE f.last END, f.last IS NULL OR c.edge >= 1.5 * f.last
   FROM f JOIN c ON c.station = f.station AND c.selected_side = f.selected_side AND c.k = f.k + 1)
  SELECT station, selected_side, count(*) AS kept, max(edge) AS top_edge FROM f WHERE kept GROUP BY ALL""", "top_edge")
def w07(spark, sf):
    kept = folds.edge_improve(signals(spark, sf), ["station", "selected_side"], scan.day_slice(F.col("ts")),
                              ["ts", "id", "liquidity"], "edge")
    return kept.groupBy("station", "selected_side").agg(F.count(F.lit(1)).alias("kept"), F.max("edge").alias("top_edge"))


@query("w09_date_folds", f"""WITH {SIGNAL_SQL}, d AS (SELECT DISTINCT market_date FROM v_signal), i AS (SELECT market_date, row_number() OVER (ORDER BY market_date) - 1 AS ix, count(*) OVER () AS n FROM d),
  f AS (SELECT market_date, CASE WHEN ix >= n - 30 THEN NULL ELSE CAST(least(ix * 4 // (n - 30), 3) AS BIGINT) END AS fold FROM i)
  SELECT coalesce(fold, -1)::BIGINT AS fold, count(DISTINCT s.market_date) AS dates, count(*) AS n FROM v_signal s JOIN f ON s.market_date = f.market_date GROUP BY ALL""")
def w09(spark, sf):
    from skyledger.plans.discovery import date_folds

    df = signals(spark, sf)
    return df.join(date_folds(df, "market_date", 4, 30), ["market_date"]).groupBy(F.coalesce("fold", F.lit(-1)).alias("fold")).agg(
        F.countDistinct("market_date").alias("dates"), F.count(F.lit(1)).alias("n"))


SLICE_SQL = """count(*) AS n, count(pnl) AS resolved, count(*) - count(pnl) AS pending,
  avg(CASE WHEN pnl IS NOT NULL THEN correct END) AS win_rate, sum(pnl) AS pnl, sum(CASE WHEN pnl IS NOT NULL THEN entry END) AS risk,
  CASE WHEN sum(CASE WHEN pnl IS NOT NULL THEN entry END) <> 0 THEN sum(pnl) / sum(CASE WHEN pnl IS NOT NULL THEN entry END) END AS rr,
  CASE WHEN stddev_pop(pnl) <> 0 THEN avg(pnl) / stddev_pop(pnl) END AS sharpe, avg(entry) AS avg_entry, avg(edge) AS avg_edge,
  avg(fair) AS avg_fair, avg(liquidity) AS avg_liquidity, avg(book_age) AS avg_book_age,
  coalesce(nullif(concat_ws(',', CASE WHEN count(pnl) < 30 THEN 'LOW_N' END, CASE WHEN count(*) - count(pnl) > count(pnl) THEN 'PENDING_HEAVY' END,
    CASE WHEN avg(liquidity) < 50 THEN 'EXECUTION_WEAK' END), ''), 'OK') AS flags"""
SLICE_COLS = "win_rate pnl risk rr sharpe avg_entry avg_edge avg_fair avg_liquidity avg_book_age"


@query("a04_summarize_slice", f"WITH {SIGNAL_SQL} SELECT model_name, station, selected_side, {SLICE_SQL} FROM v_signal GROUP BY ALL", SLICE_COLS)
def a04(spark, sf):
    return metrics.summarize_slice(signals(spark, sf), ["model_name", "station", "selected_side"], 30)


TABLES = {
    "By Source": ["model_name"], "By Source Strategy": ["model_name", "strategy_bucket"],
    "By Source Strategy Side": ["model_name", "strategy_bucket", "selected_side"],
    "By Source Strategy Obs Delay": ["model_name", "strategy_bucket", "obs_delay_bucket"],
    "By Source Strategy Entry Side": ["model_name", "strategy_bucket", "entry_band", "selected_side"],
    "By Source Strategy Edge Side": ["model_name", "strategy_bucket", "edge_band", "selected_side"],
    "By Station": ["station"], "By Bucket Type": ["bucket_kind"], "By Decision Hour": ["hour_band"], "By Liquidity": ["liquidity_band"]}
BANDED_SQL = f"""{SIGNAL_SQL}, v_banded AS (SELECT *,
  CASE WHEN entry < 0.05 THEN '0.00-0.05' WHEN entry < 0.1 THEN '0.05-0.10' WHEN entry < 0.25 THEN '0.10-0.25' WHEN entry < 0.5 THEN '0.25-0.50' WHEN entry < 0.75 THEN '0.50-0.75' ELSE '0.75-1.00' END AS entry_band,
  CASE WHEN fair < 0.25 THEN '0.00-0.25' WHEN fair < 0.5 THEN '0.25-0.50' WHEN fair < 0.75 THEN '0.50-0.75' ELSE '0.75-1.00' END AS probability_band,
  CASE WHEN edge < 0.1 THEN '<0.10' WHEN edge < 0.2 THEN '0.10-0.20' WHEN edge < 0.35 THEN '0.20-0.35' ELSE '>=0.35' END AS edge_band,
  CASE WHEN selected_bucket LIKE '<=%' OR selected_bucket LIKE '>=%' THEN 'tail' ELSE 'range' END AS bucket_kind,
  CASE WHEN minute_of_day < 480 THEN '00-08' WHEN minute_of_day < 720 THEN '08-12' WHEN minute_of_day < 960 THEN '12-16' WHEN minute_of_day < 1200 THEN '16-20' ELSE '20-24' END AS hour_band,
  CASE WHEN liquidity < 25 THEN '0-25' WHEN liquidity < 50 THEN '25-50' WHEN liquidity < 100 THEN '50-100' ELSE '>=100' END AS liquidity_band FROM v_signal)"""


def banded(spark, sf):
    return signals(spark, sf).withColumns({
        "entry_band": bands.entry_band(F.col("entry")), "probability_band": bands.probability_band(F.col("fair")),
        "edge_band": bands.edge_band(F.col("edge")), "bucket_kind": buckets.bucket_type(F.col("selected_bucket")),
        "hour_band": bands.hour_band(F.hour("ts")), "liquidity_band": bands.liquidity_band(F.col("liquidity"))})


@query("a05_slice_tables", f"WITH {BANDED_SQL} " + " UNION ALL ".join(
    f"SELECT '{t}' AS slice_table, concat_ws(' + ', {', '.join(c)}) AS label, {SLICE_SQL} FROM v_banded GROUP BY {', '.join(c)}" for t, c in TABLES.items()), SLICE_COLS)
def a05(spark, sf):
    return metrics.slice_tables(banded(spark, sf), TABLES, 30)


CAL = {"fair": "probability_band", "edge": "edge_band", "entry": "entry_band", "side": "selected_side", "delay": "obs_delay_bucket"}


@query("a06_calibration_bands", f"WITH {BANDED_SQL} " + " UNION ALL ".join(
    f"""SELECT '{d}' AS dim, {c} AS band, count(*) AS n, count(correct) AS resolved, count(*) - count(correct) AS pending, avg(fair) AS avg_fair,
    avg(CASE WHEN correct IS NOT NULL THEN fair END) AS resolved_avg_fair, avg(correct) AS hit_rate,
    avg(correct) - avg(CASE WHEN correct IS NOT NULL THEN fair END) AS cal_error FROM v_banded GROUP BY {c}""" for d, c in CAL.items()),
       "avg_fair resolved_avg_fair hit_rate cal_error")
def a06(spark, sf):
    return metrics.calibration_bands(banded(spark, sf), {d: F.col(c) for d, c in CAL.items()})


WEIGHT_SQL = POSITION_SQL + """, v_w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY market_date, station, selected_side, selected_bucket, obs_delay_bucket) AS weight FROM v_pos)"""


def board_sql(extra: str = "", source: str = "v_w") -> str:
    e = f"{extra}, " if extra else ""
    k = f"{extra}, policy" if extra else "policy"
    on = " AND ".join(f"m.{c.strip()} = d.{c.strip()}" for c in k.split(","))
    return f"""m AS (SELECT {k}, count(*) AS total, count(DISTINCT (market_date, station, selected_side, selected_bucket, obs_delay_bucket)) AS opportunities, count(pnl) AS resolved,
   count(*) - count(pnl) AS pending, count(*) FILTER (WHERE correct = 1) AS won, count(*) FILTER (WHERE correct = 0) AS lost, avg(correct) AS win_rate, coalesce(sum(pnl), 0) AS pnl,
   sum(pnl) / nullif(sum(CASE WHEN pnl IS NOT NULL THEN entry END), 0) AS rr, avg(pnl) / nullif(stddev_pop(pnl), 0) AS sharpe,
   sum(pnl * weight) / nullif(sum(CASE WHEN pnl IS NOT NULL THEN entry * weight END), 0) AS adj_rr, avg(pnl * weight) / nullif(stddev_pop(pnl * weight), 0) AS adj_sharpe,
   avg(entry) AS avg_entry, avg(fair) AS avg_fair, avg(edge) AS avg_edge, avg(CASE WHEN pnl IS NOT NULL THEN fair END) AS avg_resolved_fair, avg(CASE WHEN pnl IS NOT NULL THEN edge END) AS avg_resolved_edge,
   sum(CASE WHEN pnl IS NOT NULL THEN fair - entry END) / nullif(sum(CASE WHEN pnl IS NOT NULL THEN entry END), 0) AS expected_rr,
   abs(avg(CASE WHEN pnl > 0 THEN pnl END) / nullif(avg(CASE WHEN pnl < 0 THEN pnl END), 0)) AS payoff, count(DISTINCT station) AS stations, count(DISTINCT selected_bucket) AS buckets
   FROM {source} GROUP BY {k}),
  dd AS (SELECT {k}, market_date, sum(pnl) / nullif(sum(entry), 0) AS rr FROM {source} WHERE pnl IS NOT NULL GROUP BY {k}, market_date),
  dc AS (SELECT *, sum(rr) OVER (PARTITION BY {k} ORDER BY market_date) AS cum FROM dd),
  dp AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY {k} ORDER BY market_date)) AS peak FROM dc),
  d AS (SELECT {k}, CASE WHEN count(rr) >= 2 THEN stddev_pop(rr) END AS daily_vol, least(0, min(cum - peak)) AS max_drawdown FROM dp GROUP BY {k}),
  board AS (SELECT m.*, d.daily_vol, d.max_drawdown, m.rr - m.expected_rr AS edge_capture,
   CASE WHEN resolved = 0 AND pending > 0 THEN 'PENDING' WHEN resolved < 5 THEN 'TINY_N' WHEN stations < 3 THEN 'CONCENTRATED' WHEN sharpe > 0.25 AND rr > 0.2 THEN 'PROMISING'
        WHEN sharpe < 0 AND rr < 0 THEN 'WEAK' WHEN pending > resolved THEN 'PENDING_HEAVY' ELSE 'WATCH' END AS status FROM m LEFT JOIN d ON {on})"""


@query("a07_leaderboard", f"WITH {WEIGHT_SQL}, {board_sql()} SELECT *, pnl / (SELECT sum(abs(pnl)) FROM m) AS contribution FROM board",
       "win_rate pnl rr sharpe adj_rr adj_sharpe avg_entry avg_fair avg_edge avg_resolved_fair avg_resolved_edge expected_rr payoff daily_vol max_drawdown edge_capture contribution")
def a07(spark, sf):
    return lb.leaderboard(positions(spark, sf))


@query("a08_rolling_leaderboard", f"""WITH {POSITION_SQL}, l AS (SELECT max(market_date) AS last FROM v_signal),
  x AS (SELECT p.*, w.name AS win FROM v_pos p, l, (VALUES ('1d', 1), ('30d', 30), ('365d', 365), ('all', 999999)) w(name, days) WHERE datediff('day', market_date, last) < days),
  v_w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY market_date, station, selected_side, selected_bucket, obs_delay_bucket, win) AS weight FROM x), {board_sql("win")}
  SELECT win AS "window", sum(resolved)::BIGINT AS resolved, sum(pending)::BIGINT AS pending, count(*) AS policies,
   arg_min(policy, k) AS top_policy, arg_min(status, k) AS top_status, arg_min(rr, k) AS top_rr, arg_min(sharpe, k) AS top_sharpe
  FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY status <> 'PROMISING', coalesce(sharpe, -999) DESC, coalesce(rr, -999) DESC, resolved DESC, policy) AS k FROM board) GROUP BY win""", "top_rr top_sharpe")
def a08(spark, sf):
    pos = positions(spark, sf)
    last = pos.agg(F.max("market_date").alias("_last"))
    return lb.rolling_leaderboard(pos.join(F.broadcast(last), F.lit(True)), F.col("_last"),
                                  windows=(("1d", 1), ("30d", 30), ("365d", 365), ("all", 999999)))


SPLITS = {"station": "station", "side": "selected_side", "bucket_type": "bucket_kind", "entry_band": "entry_band", "obs_delay": "obs_delay_bucket", "strategy": "strategy_bucket"}


@query("a09_split_report", f"WITH {BANDED_SQL}, v_bp AS (SELECT *, model_name || '/' || strategy_bucket AS policy FROM v_banded) " + " UNION ALL ".join(
    f"""SELECT '{s}' AS split, {c} AS value, count(*) AS total, count(pnl) AS resolved, count(*) - count(pnl) AS pending, avg(correct) AS win_rate,
    sum(pnl) / nullif(sum(CASE WHEN pnl IS NOT NULL THEN entry END), 0) AS rr, avg(pnl) / nullif(stddev_pop(pnl), 0) AS sharpe, count(DISTINCT policy) AS policies FROM v_bp GROUP BY {c}"""
    for s, c in SPLITS.items()), "win_rate rr sharpe")
def a09(spark, sf):
    return lb.split_report(positions(spark, sf))


@query("a09_station_report", f"""WITH {POSITION_SQL} SELECT station, count(*) AS total, count(pnl) AS resolved, count(*) - count(pnl) AS pending, avg(correct) AS win_rate,
  sum(pnl) / nullif(sum(CASE WHEN pnl IS NOT NULL THEN entry END), 0) AS rr, avg(pnl) / nullif(stddev_pop(pnl), 0) AS sharpe, avg(fair) AS avg_fair, avg(correct) - avg(fair) AS cal_error,
  CASE WHEN count(pnl) < 20 THEN 'LOW_N' ELSE 'OK' END AS gate, count(DISTINCT policy) AS policies, 'manual' AS regime FROM v_pos GROUP BY station""", "win_rate rr sharpe avg_fair cal_error")
def a09b(spark, sf):
    return lb.station_report(positions(spark, sf))


CAL2 = {"fair": "probability_band", "edge": "edge_band", "entry": "entry_band", "side": "selected_side", "station": "station", "obs_delay": "obs_delay_bucket"}


@query("a09_calibration_report", f"WITH {BANDED_SQL} " + " UNION ALL ".join(
    f"""SELECT '{d}' AS type, {c} AS band, count(*) AS n, count(correct) AS resolved, avg(fair) AS avg_fair, avg(edge) AS avg_edge, avg(correct) AS hit_rate,
    avg(correct) - avg(fair) AS cal_error, avg((fair - correct) ** 2) AS brier FROM v_banded GROUP BY {c}""" for d, c in CAL2.items()),
       "avg_fair avg_edge hit_rate cal_error brier")
def a09c(spark, sf):
    return lb.calibration_report(positions(spark, sf))


@query("j17_policy_overlap", f"""WITH {POSITION_SQL}, o AS (SELECT DISTINCT policy, market_date, station, selected_side, selected_bucket, obs_delay_bucket FROM v_pos),
  t AS (SELECT policy, count(*) AS n FROM o GROUP BY policy),
  s AS (SELECT a.policy AS policy_a, b.policy AS policy_b, count(*) AS shared FROM o a JOIN o b ON a.market_date = b.market_date AND a.station = b.station AND a.selected_side = b.selected_side
    AND a.selected_bucket = b.selected_bucket AND a.obs_delay_bucket = b.obs_delay_bucket AND a.policy < b.policy GROUP BY ALL)
  SELECT policy_a, policy_b, shared, x.n AS a_total, y.n AS b_total, shared / least(x.n, y.n) AS overlap FROM s JOIN t x ON x.policy = policy_a JOIN t y ON y.policy = policy_b""", "overlap")
def j17(spark, sf):
    return lb.policy_overlap(positions(spark, sf))


@query("a37_coverage_summary", f"""WITH {SIGNAL_SQL} SELECT count(*) AS rows, count(pnl) AS resolved, count(*) - count(pnl) AS pending, count(DISTINCT (station, market_date, selected_side, selected_bucket)) AS unique_opportunities,
  count(DISTINCT station) AS stations, count(DISTINCT market_date) AS market_dates, count(DISTINCT model_name) AS sources, count(DISTINCT strategy_bucket) AS strategies FROM v_signal""")
def a37(spark, sf):
    return metrics.coverage_summary(signals(spark, sf).withColumn("source", F.col("model_name")),
                                    ["station", "market_date", "selected_side", "selected_bucket"])


@query("a34_calibration_gate", f"""WITH {SIGNAL_SQL}, b AS (SELECT *, {BOUND_SQL}, 60 + cost % 22 AS temp FROM v_signal WHERE selected_bucket NOT LIKE '<=%'),
  s AS (SELECT *, (temp >= lower AND temp <= coalesce(upper, 200)) AS inside FROM b), r AS (SELECT *, (selected_side = 'BUY_NO') <> inside AS won FROM s),
  g AS (SELECT station, selected_side, CASE WHEN entry < 0.15 THEN '<0.15' WHEN entry < 0.25 THEN '0.15-0.25' WHEN entry < 0.35 THEN '0.25-0.35' WHEN entry < 0.45 THEN '0.35-0.45' WHEN entry < 0.55 THEN '0.45-0.55' ELSE '>=0.55' END AS band,
   count(*) AS n, avg(CASE WHEN won THEN 1.0 ELSE 0.0 END) * 100 AS win_pct, avg(CASE WHEN won THEN (1 - entry) / entry ELSE -1.0 END) AS avg_rr, avg(fair) * 100 AS model_wr, avg(entry) AS avg_entry, count(DISTINCT market_date) AS market_dates FROM r GROUP BY ALL)
  SELECT *, model_wr - win_pct AS overconfidence_pp, CASE WHEN n < 8 THEN 'INSUFFICIENT_DATA' WHEN avg_rr >= 0.15 AND n >= 20 THEN 'TRADE' WHEN avg_rr > 0 THEN 'CANARY' WHEN avg_rr > -0.1 THEN 'WATCH' ELSE 'BLOCK' END AS decision FROM g""",
       "win_pct avg_rr model_wr avg_entry overconfidence_pp")
def a34(spark, sf):
    return lb.calibration_gate(signals(spark, sf).withColumn("temp", 60 + F.col("cost") % 22), "temp")


def window_stat_sql(days: str, name: str) -> str:
    c = f"datediff('day', market_date, last) < {days}"
    return f"""count(*) FILTER (WHERE {c}) AS n_{name}, sum(pnl) FILTER (WHERE {c}) AS pnl_{name}, sum(pnl) FILTER (WHERE {c}) / nullif(sum(entry) FILTER (WHERE {c}), 0) AS rr_{name},
      avg(pnl) FILTER (WHERE {c}) / nullif(stddev_pop(pnl) FILTER (WHERE {c}), 0) AS sharpe_{name}"""


PROMO_SQL = f"""{POSITION_SQL}, l AS (SELECT max(market_date) AS last FROM v_pos WHERE pnl IS NOT NULL),
  s AS (SELECT policy, bool_or(model_name = 'm0') AS live, {window_stat_sql('1000000', 'all')}, {window_stat_sql('30', '30')}, {window_stat_sql('7', '7')} FROM v_pos, l WHERE pnl IS NOT NULL GROUP BY policy),
  z AS (SELECT *, coalesce(n_7 >= 5 AND rr_7 <= -0.15, false) AS bad, coalesce(rr_30, -1e9) AS r30, coalesce(rr_all, -1e9) AS rall FROM s)"""


@query("a35_promotion_report", f"""WITH {PROMO_SQL} SELECT policy, live, n_all, pnl_all, rr_all, sharpe_all, n_30, pnl_30, rr_30, sharpe_30, n_7, pnl_7, rr_7, sharpe_7,
  CASE WHEN live AND (rall <= 0.05 OR r30 <= 0.05 OR bad) THEN 'DEACTIVATE' WHEN n_30 >= 20 AND r30 >= 0.15 AND rall >= 0.1 AND NOT bad THEN 'PROMOTE'
       WHEN n_30 >= 10 AND r30 >= 0.05 AND rall >= 0 AND NOT bad THEN 'CANARY' ELSE 'RESEARCH_ONLY' END AS decision FROM z""",
       "pnl_all rr_all sharpe_all pnl_30 rr_30 sharpe_30 pnl_7 rr_7 sharpe_7")
def a35(spark, sf):
    return lb.promotion_report(positions(spark, sf).withColumn("live", F.col("model_name") == "m0"))


@query("a36_emerging", f"""WITH {PROMO_SQL}, e AS (SELECT policy, n_7 AS resolved_7, rr_7, rr_30, rr_all, sharpe_7, pnl_7, rr_7 - greatest(coalesce(rr_30, 0), coalesce(rr_all, 0)) AS improvement FROM s)
  SELECT * FROM e WHERE rr_7 > 0 AND (improvement > 0 OR rr_7 >= 0.25)""", "rr_7 rr_30 rr_all sharpe_7 pnl_7 improvement")
def a36(spark, sf):
    return lb.emerging(positions(spark, sf))


@query("a36_family_rollup", f"""WITH {WEIGHT_SQL}, {board_sql()} SELECT split_part(policy, '/', 1) AS family, count(*) AS policies, max(rr) AS best_rr, max(sharpe) AS best_sharpe, sum(pnl) AS total_pnl, avg(resolved) AS avg_resolved FROM board GROUP BY ALL""",
       "best_rr best_sharpe total_pnl avg_resolved")
def a36b(spark, sf):
    return lb.family_rollup(lb.leaderboard(positions(spark, sf)), F.split_part("policy", F.lit("/"), F.lit(1)))


@query("k06_top_policies", f"WITH {SIGNAL_SQL}, s AS (SELECT model_name, strategy_bucket, station, selected_side, {SLICE_SQL} FROM v_signal GROUP BY ALL) SELECT * FROM s WHERE resolved >= 30 ORDER BY sharpe DESC NULLS LAST, rr DESC NULLS LAST, resolved DESC, win_rate DESC NULLS LAST, model_name, strategy_bucket, station, selected_side LIMIT 25", SLICE_COLS)
def k06(spark, sf):
    labels = ["model_name", "strategy_bucket", "station", "selected_side"]
    stats = metrics.summarize_slice(signals(spark, sf), labels, 30)
    return lb.top_policies(stats, lb.rank_by("sharpe", labels), 30, 25)


@query("a25_scenario_summary", f"""WITH {SIGNAL_SQL}, e AS (SELECT *, CASE WHEN correct IS NOT NULL AND book_age < 120 THEN CASE WHEN correct = 1 THEN cost / entry - cost ELSE -cost END END AS p FROM v_signal),
  c AS (SELECT station, ts, id, liquidity, sum(p) OVER w AS cum FROM e WHERE p IS NOT NULL WINDOW w AS (PARTITION BY station ORDER BY {SQL_ORDER} ROWS UNBOUNDED PRECEDING)),
  k AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY station ORDER BY {SQL_ORDER} ROWS UNBOUNDED PRECEDING)) AS peak FROM c),
  d AS (SELECT station, greatest(0, max(peak - cum)) AS max_drawdown FROM k GROUP BY station),
  s AS (SELECT station, count(*) AS executions, count(p) AS venue_resolved, sum(CASE WHEN p IS NOT NULL THEN cost ELSE 0 END) AS venue_cost, sum(p) AS venue_pnl, sum(CASE WHEN p IS NOT NULL THEN correct ELSE 0 END)::BIGINT AS wins,
   (count(p) - sum(CASE WHEN p IS NOT NULL THEN correct ELSE 0 END))::BIGINT AS losses, sum(CASE WHEN p IS NOT NULL THEN entry * (cost / entry) END) / nullif(sum(CASE WHEN p IS NOT NULL THEN cost / entry END), 0) AS weighted_vwap,
   avg(cost / 50) AS avg_fill_fraction, sum(cost) AS capacity, avg(p) AS mean_pnl, CASE WHEN count(p) > 1 THEN stddev_samp(p) / sqrt(count(p)) END AS standard_error FROM e GROUP BY station)
  SELECT s.*, coalesce(d.max_drawdown, 0) AS max_drawdown, venue_pnl / nullif(venue_cost, 0) AS venue_rr,
   greatest(0, ((wins / venue_resolved) + 1.96 * 1.96 / (2 * venue_resolved)) / (1 + 1.96 * 1.96 / venue_resolved) - 1.96 * sqrt((wins / venue_resolved) * (1 - wins / venue_resolved) / venue_resolved + 1.96 * 1.96 / (4.0 * venue_resolved * venue_resolved)) / (1 + 1.96 * 1.96 / venue_resolved)) AS win_low,
   least(1, ((wins / venue_resolved) + 1.96 * 1.96 / (2 * venue_resolved)) / (1 + 1.96 * 1.96 / venue_resolved) + 1.96 * sqrt((wins / venue_resolved) * (1 - wins / venue_resolved) / venue_resolved + 1.96 * 1.96 / (4.0 * venue_resolved * venue_resolved)) / (1 + 1.96 * 1.96 / venue_resolved)) AS win_high
  FROM s LEFT JOIN d ON s.station = d.station""",
       "venue_cost venue_pnl weighted_vwap avg_fill_fraction capacity mean_pnl standard_error max_drawdown venue_rr win_low win_high")
def a25(spark, sf):
    df = signals(spark, sf).withColumns({
        "shares": F.col("cost") / F.col("entry"), "vwap": F.col("entry"), "fill_fraction": F.col("cost") / 50,
        "label": F.col("correct"), "disagreement": F.col("book_age") >= 120})
    return metrics.scenario_summary(df, ["station"], scan.day_slice(F.col("ts")), ORDER)


@query("a26_concentration", f"""WITH {SIGNAL_SQL}, a AS (SELECT model_name, station, sum(cost) AS c FROM v_signal GROUP BY ALL), b AS (SELECT model_name, market_date, sum(cost) AS c FROM v_signal GROUP BY ALL)
  SELECT x.model_name, max_station_share, station_count, max_market_date_share, market_date_count FROM (SELECT model_name, max(c) / sum(c) AS max_station_share, count(*) AS station_count FROM a GROUP BY ALL) x
  JOIN (SELECT model_name, max(c) / sum(c) AS max_market_date_share, count(*) AS market_date_count FROM b GROUP BY ALL) y ON x.model_name = y.model_name""", "max_station_share max_market_date_share")
def a26(spark, sf):
    return metrics.concentration(signals(spark, sf), ["model_name"], ["station", "market_date"])


@query("a53_daily_sharpe", f"""WITH {POSITION_SQL}, d AS (SELECT policy, market_date, sum(pnl) AS p FROM v_pos WHERE pnl IS NOT NULL GROUP BY ALL)
  SELECT policy, count(*) AS dates, avg(p) / nullif(stddev_pop(p), 0) AS daily_sharpe FROM d GROUP BY policy""", "daily_sharpe")
def a53(spark, sf):
    from skyledger.plans.reports import daily_sharpe

    return daily_sharpe(positions(spark, sf), ["policy"])


@query("x09_logit_sigmoid", f"""WITH {SIGNAL_SQL} SELECT station, avg(ln(least(greatest(fair, 1e-6), 1 - 1e-6) / (1 - least(greatest(fair, 1e-6), 1 - 1e-6)))) AS mean_logit, avg(1 / (1 + exp(-edge))) AS mean_sigmoid FROM v_signal GROUP BY station""", "mean_logit mean_sigmoid")
def x09(spark, sf):
    return signals(spark, sf).groupBy("station").agg(
        F.avg(prob.logit(F.col("fair"))).alias("mean_logit"), F.avg(prob.sigmoid(F.col("edge"))).alias("mean_sigmoid"))


@query("x10_quantisers", f"""WITH {SIGNAL_SQL} SELECT station, sum(round_even(least(greatest(edge, 0), 1) + 1e-12, 2)) AS price, sum(floor(greatest(edge, 0) / 0.01 + 1e-12) * 0.01) AS tick FROM v_signal GROUP BY station""", "price tick")
def x10(spark, sf):
    price = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("edge"))) + 1e-12, 2)
    return signals(spark, sf).groupBy("station").agg(F.sum(price).alias("price"), F.sum(money.floor_tick(F.col("edge"), 0.01)).alias("tick"))


@query("x11_rounding", f"""WITH {SIGNAL_SQL} SELECT station, sum(floor(cost / 2 + 0.5))::BIGINT AS half_up, sum(round_even(cost / 2, 0))::BIGINT AS half_even FROM v_signal GROUP BY station""")
def x11(spark, sf):
    return signals(spark, sf).groupBy("station").agg(
        F.sum(buckets.round_half_up(F.col("cost") / 2)).alias("half_up"), F.sum(F.rint(F.col("cost") / 2).cast("long")).alias("half_even"))


@query("x12_truth_compatible", f"""WITH {SIGNAL_SQL}, b AS (SELECT *, {BOUND_SQL}, floor(60 + cost % 20 + 0.5) AS lo, floor(60 + cost % 20 + entry * 4 + 0.5) AS hi FROM v_signal)
  SELECT station, sum(CASE WHEN greatest(lo, coalesce(lower, lo)) <= least(hi, coalesce(upper, hi)) THEN 1 ELSE 0 END)::BIGINT AS compatible FROM b GROUP BY station""")
def x12(spark, sf):
    low = 60 + F.col("cost") % 20
    ok = buckets.truth_compatible(low, low + F.col("entry") * 4, buckets.parse_bucket(F.col("selected_bucket")))
    return signals(spark, sf).groupBy("station").agg(F.sum(ok.cast("int")).alias("compatible"))


@query("x13_quote_ready", f"""WITH {SIGNAL_SQL} SELECT station, max(CAST(ceil(epoch_us(ts) / 900000000.0) AS BIGINT) * 900000000 + 250000) AS last_ready_us, count(DISTINCT CAST(ceil(epoch_us(ts) / 900000000.0) AS BIGINT)) AS decisions FROM v_signal GROUP BY station""")
def x13(spark, sf):
    ready = times.quote_ready(F.col("ts"), 900_000_000, 250_000)
    return signals(spark, sf).groupBy("station").agg(
        F.max(F.unix_micros(ready)).alias("last_ready_us"), F.countDistinct(ready).alias("decisions"))


@query("x14_stable_id", f"""WITH {SIGNAL_SQL}, j AS (SELECT station, sha256('{{"id":' || id || ',"liquidity":' || CAST(liquidity AS VARCHAR) || ',"station":"' || station || '"}}') AS sid FROM v_signal) SELECT station, count(DISTINCT sid) AS ids, min(sid) AS first_id FROM j GROUP BY station""")
def x14(spark, sf):
    df = signals(spark, sf).select("station", money.stable_id("id", "liquidity", "station").alias("sid"))
    return df.groupBy("station").agg(F.countDistinct("sid").alias("ids"), F.min("sid").alias("first_id"))


@query("x21_score_snapshots", f"""WITH {SIGNAL_SQL}, b AS (SELECT *, {BOUND_SQL}, CASE WHEN correct IS NOT NULL THEN 60 + cost % 22 END AS temp FROM v_signal),
  s AS (SELECT *, CASE WHEN temp IS NULL THEN NULL WHEN selected_side = 'BUY_YES' THEN inside ELSE NOT inside END AS won FROM (SELECT *, ((lower IS NULL OR temp >= lower) AND (upper IS NULL OR temp <= upper)) AS inside FROM b))
  SELECT model_name, selected_side, count(won) AS scored, sum(CASE WHEN won THEN 1 - entry WHEN NOT won THEN -entry END) AS pnl FROM s GROUP BY ALL""", "pnl")
def x21(spark, sf):
    from skyledger.plans.policies import score_snapshots

    df = signals(spark, sf).drop("correct", "pnl").join(
        signals(spark, sf).select(F.col("id"), F.col("liquidity"), F.when(F.col("correct").isNotNull(), 60 + F.col("cost") % 22).alias("temp")), ["id", "liquidity"])
    return score_snapshots(df, "temp").groupBy("model_name", "selected_side").agg(
        F.count("correct").alias("scored"), F.sum("pnl").alias("pnl"))
