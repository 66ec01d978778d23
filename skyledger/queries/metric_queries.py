"""Calibration, comparison and resampling metrics over signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import dists, metrics, ranks, select
from skyledger.plans import discovery, evaluation
from skyledger.queries.registry import query
from skyledger.queries.signal_queries import ORDER, SQL_ORDER
from skyledger.queries.views import OBS_SQL, SIGNAL_SQL, observations, signals

RES_SQL = SIGNAL_SQL + ", v_res AS (SELECT *, least(greatest(fair, 1e-6), 1 - 1e-6) AS q, least(greatest(1 - entry, 1e-6), 1 - 1e-6) AS q2 FROM v_signal WHERE correct IS NOT NULL)"
LL = "-(correct * ln({0}) + (1 - correct) * ln(1 - {0}))"


def resolved(spark, sf):
    return signals(spark, sf).where("correct is not null")


@query("a17_binary_metrics", f"""WITH {RES_SQL}, d AS (SELECT model_name, market_date, count(*) AS n, avg((q - correct) ** 2) AS b, avg({LL.format('q')}) AS l, avg(q) AS p, avg(correct) AS y FROM v_res GROUP BY ALL)
  SELECT model_name, sum(n)::BIGINT AS rows, count(*) AS dates, avg(b) AS brier, avg(l) AS log_loss, avg(p) AS mean_probability, avg(y) AS outcome_rate FROM d GROUP BY model_name""", "brier log_loss mean_probability outcome_rate")
def a17(spark, sf):
    return metrics.binary_metrics(resolved(spark, sf), "fair", "correct", "market_date", ["model_name"])


@query("a18_weighted_metrics", f"""WITH {RES_SQL} SELECT count(*) AS rows, count(DISTINCT market_date) AS dates, sum(cost) AS weight_sum, sum(cost * q) / sum(cost) AS mean_probability, sum(cost * correct) / sum(cost) AS observed_rate, sum(cost * (q - correct) ** 2) / sum(cost) AS brier,
  sum(cost * ({LL.format('q')})) / sum(cost) AS log_loss, sum(cost * correct) / sum(cost) - sum(cost * q) / sum(cost) AS calibration_in_the_large FROM v_res""", "weight_sum mean_probability observed_rate brier log_loss calibration_in_the_large")
def a18(spark, sf):
    return metrics.weighted_metrics(resolved(spark, sf), "fair", "correct", "cost", "market_date")


@query("a19_reliability", f"""WITH {RES_SQL} SELECT CAST(least(floor(fair / 0.15), 6) AS BIGINT) AS bin, count(*) AS rows, sum(cost) AS weight_sum, sum(cost * fair) / sum(cost) AS mean_probability, sum(cost * correct) / sum(cost) AS observed_rate FROM v_res GROUP BY ALL""", "weight_sum mean_probability observed_rate")
def a19(spark, sf):
    return metrics.reliability(resolved(spark, sf), "fair", "correct", "cost", 0.15)


@query("a20_reliability_cut", f"""WITH {RES_SQL}, b AS (SELECT *, CASE WHEN fair < 0 OR fair > 1 THEN NULL WHEN fair <= 0.25 THEN 0 WHEN fair <= 0.5 THEN 1 WHEN fair <= 0.77 THEN 2 WHEN fair <= 1 THEN 3 END AS bin FROM v_res)
  SELECT station, bin, count(*) AS rows, avg(fair) AS mean_probability, avg(correct) AS observed_rate FROM b WHERE bin IS NOT NULL GROUP BY ALL""", "mean_probability observed_rate")
def a20(spark, sf):
    return metrics.reliability_cut(resolved(spark, sf), "fair", "correct", [0.0, 0.25, 0.5, 0.77, 1.0], ["station"])


@query("a20_roc_auc", f"""WITH {RES_SQL}, g AS (SELECT station, fair, sum(correct) AS pos, sum(1 - correct) AS neg FROM v_res GROUP BY ALL), c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY station ORDER BY fair ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
  SELECT station, sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM c GROUP BY station""", "auc")
def a20b(spark, sf):
    return ranks.rank_sum_auc(resolved(spark, sf), ["station"], "fair", "correct")


EDGES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


@query("a21_ece", f"""WITH {RES_SQL}, b AS (SELECT fair, correct, least(CAST(floor(fair * 5 + 1e-12) AS INTEGER), 4) AS bin, 1.0 / count(*) OVER (PARTITION BY market_date) AS w FROM v_res),
  g AS (SELECT bin, count(*) AS n, sum(w) AS w, sum(w * fair) AS wp, sum(w * correct) AS wy FROM b GROUP BY bin) SELECT sum(n)::BIGINT AS rows, sum(abs(wp - wy)) / sum(w) AS ece, (sum(wp) - sum(wy)) / sum(w) AS signed_bias FROM g""", "ece signed_bias")
def a21(spark, sf):
    return metrics.ece(resolved(spark, sf), "fair", "correct", "market_date", EDGES)


@query("a22_paired_delta", f"""WITH {RES_SQL} SELECT market_date, count(*) AS rows, avg(({LL.format('q')}) - ({LL.format('q2')})) AS log_loss_delta, avg((q - correct) ** 2 - (q2 - correct) ** 2) AS brier_delta FROM v_res GROUP BY market_date""", "log_loss_delta brier_delta", dates="market_date")
def a22(spark, sf):
    df = resolved(spark, sf).withColumn("other", 1 - F.col("entry"))
    return metrics.paired_delta(df, "fair", "other", "correct", "market_date")


@query("a23_abstention_curve", f"""WITH {RES_SQL}, e AS (SELECT t AS threshold, market_date, fair - entry AS e, correct - entry AS p FROM v_res, (SELECT unnest([0.0, 0.05, 0.125, 0.3]) AS t) WHERE fair - entry >= t), d AS (SELECT threshold, market_date, count(*) AS n, sum(e) AS e, avg(p) AS p FROM e GROUP BY ALL)
  SELECT CAST(threshold AS DOUBLE) AS threshold, sum(n)::BIGINT AS rows, count(*) AS dates, sum(e) / sum(n) AS mean_edge, avg(p) AS date_equal_pnl FROM d GROUP BY threshold""", "threshold mean_edge date_equal_pnl")
def a23(spark, sf):
    return metrics.abstention_curve(resolved(spark, sf), "fair", "entry", "correct", "market_date", [0.0, 0.05, 0.125, 0.3])


@query("a42_binned_report", f"""WITH {RES_SQL}, b AS (SELECT *, CASE WHEN edge < -1 OR edge > 1 THEN NULL WHEN edge <= -0.2 THEN 'far_below' WHEN edge <= 0 THEN 'below' WHEN edge <= 0.2 THEN 'above' ELSE 'far_above' END AS bin FROM v_res)
  SELECT bin, count(*) AS rows, avg(correct) AS observed_rate, avg(fair) AS mean_probability, avg((fair - correct) ** 2) AS brier, avg({LL.format('q')}) AS log_loss, avg(abs(fair - correct)) AS mean_abs_error FROM b WHERE bin IS NOT NULL GROUP BY bin""", "observed_rate mean_probability brier log_loss mean_abs_error")
def a42(spark, sf):
    return metrics.binned_report(resolved(spark, sf), "edge", "fair", "correct", [-1.0, -0.2, 0.0, 0.2, 1.0], ["far_below", "below", "above", "far_above"])


@query("a39_cluster_weights", f"""WITH {SIGNAL_SQL}, c AS (SELECT market_date, station, count(*) AS n FROM v_signal GROUP BY ALL), d AS (SELECT market_date, count(*) AS k FROM c GROUP BY ALL)
  SELECT s.station, sum(1.0 / n) AS station_date_weight, sum(1.0 / n / k) AS market_date_weight FROM v_signal s JOIN c ON c.market_date = s.market_date AND c.station = s.station JOIN d ON d.market_date = s.market_date GROUP BY s.station""", "station_date_weight market_date_weight")
def a39(spark, sf):
    w = metrics.cluster_weights(signals(spark, sf), "market_date", "station")
    return w.groupBy("station").agg(F.sum("station_date_weight").alias("station_date_weight"), F.sum("market_date_weight").alias("market_date_weight"))


@query("a40_price_economics", f"""WITH {RES_SQL}, p AS (SELECT *, CASE WHEN selected_side = 'BUY_YES' THEN 'y' ELSE 'n' END AS side FROM v_res WHERE entry > 0)
  SELECT level, key, count(*) AS resolved_quotes, count(DISTINCT market_date) AS market_dates, sum(cost) AS risk_units, sum(cost * (correct / entry - 1)) AS pnl_units, sum(cost * (correct / entry - 1)) / sum(cost) AS return_on_risk, sum(cost * correct) / sum(cost) AS win_rate
  FROM (SELECT 'model' AS level, model_name AS key, * FROM p UNION ALL SELECT 'side', selected_side, * FROM p UNION ALL SELECT 'station', station, * FROM p UNION ALL SELECT 'all', '', * FROM p) GROUP BY level, key""", "risk_units pnl_units return_on_risk win_rate")
def a40(spark, sf):
    from skyledger.plans.pricing import price_economics

    return price_economics(resolved(spark, sf), "entry", "correct", "cost", {"model": "model_name", "side": "selected_side", "station": "station"})


@query("a41_signal_backtest", f"""WITH {RES_SQL}, s AS (SELECT station, CASE WHEN entry - 0.1 - fair >= 0.1 THEN 'BUY_NO' WHEN fair - entry >= 0.1 THEN 'BUY_YES' ELSE 'HOLD' END AS sig, entry, correct FROM v_res),
  p AS (SELECT *, CASE sig WHEN 'BUY_NO' THEN entry - 0.1 - correct WHEN 'BUY_YES' THEN correct - entry ELSE 0 END AS pnl FROM s)
  SELECT station, count(*) AS rows, count(*) FILTER (WHERE sig <> 'HOLD') AS trades, sum(pnl) AS total_pnl, avg(pnl) FILTER (WHERE sig <> 'HOLD') AS avg_pnl, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE sig <> 'HOLD') AS win_rate FROM p GROUP BY station""", "total_pnl avg_pnl win_rate")
def a41(spark, sf):
    df = resolved(spark, sf).withColumn("bid", F.col("entry") - 0.1)
    return evaluation.backtest_summary(evaluation.signal_backtest(df, "fair", "entry", "bid", "correct", 0.1), ["station"])


@query("a33_validate_dataset", f"""WITH {RES_SQL}, d AS (SELECT *, CASE WHEN fair >= 0.5 THEN 1 ELSE 0 END AS y FROM v_res), v AS (SELECT count(*) AS n, min(correct) AS lo, max(correct) AS hi FROM d GROUP BY entry, fair, minute_of_day)
  SELECT 'missing_column' AS "check", 'humidity' AS detail, 1::BIGINT AS n UNION ALL SELECT 'inconsistent_target', 'correct', count(*) FILTER (WHERE correct <> y) FROM d UNION ALL SELECT 'contradictory_duplicates', 'features', sum(n) FILTER (WHERE lo <> hi)::BIGINT FROM v
  UNION ALL SELECT 'constant_column', 'unit', count(*) FROM d""")
def a33(spark, sf):
    df = resolved(spark, sf).select("entry", "fair", "minute_of_day", "correct", "market_date", F.lit(0.5).alias("half"), F.lit(1).alias("unit"))
    out = evaluation.validate_dataset(df, ["entry", "humidity"], ["entry", "fair", "minute_of_day"], "correct", "market_date", "fair", "half")
    unit = evaluation.validate_dataset(df, [], ["unit"], "correct", "market_date", "fair", "half").where("check = 'constant_column'")
    return out.unionByName(unit)


@query("a33_split_health", f"""WITH {RES_SQL} SELECT CASE WHEN market_date < DATE '1999-01-01' THEN 'train' ELSE 'validation' END AS split, count(*) AS rows, count(DISTINCT market_date) AS dates, avg(correct) AS target_rate, min(market_date) AS first_date, max(market_date) AS last_date FROM v_res GROUP BY ALL""", "target_rate", dates="first_date last_date")
def a33b(spark, sf):
    return evaluation.split_health(resolved(spark, sf), "market_date", "correct", F.lit("1999-01-01").cast("date"))


@query("a47_acceptance_checks", f"""WITH {RES_SQL}, m AS (SELECT avg((q - correct) ** 2) AS b, avg((q2 - correct) ** 2) AS r, count(*) AS n FROM v_res) SELECT 'beats_reference' AS "check", b < r AS passes FROM m UNION ALL SELECT 'enough_rows', n >= 100 FROM m UNION ALL SELECT 'brier_bound', b <= 0.2 FROM m""")
def a47(spark, sf):
    one = resolved(spark, sf).agg(F.avg(F.pow(F.col("fair") - F.col("correct"), F.lit(2.0))).alias("b"),
                                  F.avg(F.pow(1 - F.col("entry") - F.col("correct"), F.lit(2.0))).alias("r"), F.count(F.lit(1)).alias("n"))
    return evaluation.acceptance_checks(one, {"beats_reference": F.col("b") < F.col("r"), "enough_rows": F.col("n") >= 100, "brier_bound": F.col("b") <= 0.2})


@query("a48_cutoff_leak", f"""WITH {OBS_SQL}, l AS (SELECT station, CAST(valid AS DATE) AS d, max(valid) AS t FROM v_obs WHERE hour(valid) <= 12 GROUP BY ALL), x AS (SELECT *, hour(t) * 3600 + minute(t) * 60 + second(t) > 43200 AS leak FROM l)
  SELECT count(*) AS groups, sum(CASE WHEN leak THEN 1 ELSE 0 END)::BIGINT AS leaks, avg(CASE WHEN leak THEN 1.0 ELSE 0.0 END) AS leak_rate, quantile_cont(CASE WHEN leak THEN minute(t) END, 0.5) AS median_leak_minute FROM x""", "leak_rate median_leak_minute")
def a48(spark, sf):
    return evaluation.cutoff_leak(observations(spark, sf).withColumn("d", F.to_date("valid")), ["station", "d"], "valid", 12)


@query("a49_feature_coverage", f"""WITH {SIGNAL_SQL}, a AS (SELECT avg(CASE WHEN correct IS NOT NULL THEN 1.0 ELSE 0.0 END) AS c, 1.0 AS e FROM v_signal WHERE model_name = 'm0'), b AS (SELECT avg(CASE WHEN correct IS NOT NULL THEN 1.0 ELSE 0.0 END) AS c, 1.0 AS e FROM v_signal WHERE model_name = 'm1')
  SELECT 'correct' AS feature, a.c AS first_share, b.c AS second_share FROM a, b UNION ALL SELECT 'entry', a.e, b.e FROM a, b""", "first_share second_share")
def a49b(spark, sf):
    df = signals(spark, sf)
    return evaluation.feature_coverage(df.where("model_name = 'm0'"), df.where("model_name = 'm1'"), ["correct", "entry"])


DRAW = "(('0x' || substr(md5('{seed}:' || rep || ':' || slot), 1, 12))::BIGINT % n)"


@query("r01_cluster_bootstrap", f"""WITH {RES_SQL}, d AS (SELECT market_date, avg((q - correct) ** 2) AS brier, avg(pnl) AS pnl FROM v_res GROUP BY market_date), i AS (SELECT *, row_number() OVER (ORDER BY market_date) - 1 AS ix, count(*) OVER () AS n FROM d),
  s AS (SELECT rep, {DRAW.format(seed='s7')} AS ix FROM (SELECT unnest(range(0, 200)) AS rep), (SELECT ix AS slot, n FROM i)), m AS (SELECT rep, avg(brier) AS brier, avg(pnl) AS pnl FROM s JOIN i ON i.ix = s.ix GROUP BY rep)
  SELECT 'brier' AS metric, quantile_cont(brier, 0.025) AS q025, quantile_cont(brier, 0.975) AS q975 FROM m UNION ALL SELECT 'pnl', quantile_cont(pnl, 0.025), quantile_cont(pnl, 0.975) FROM m""", "q025 q975")
def r01(spark, sf):
    daily = resolved(spark, sf).groupBy("market_date").agg(
        F.avg(F.pow(F.least(F.greatest(F.col("fair"), F.lit(1e-6)), F.lit(1 - 1e-6)) - F.col("correct"), F.lit(2.0))).alias("b"), F.avg("pnl").alias("p"))
    return metrics.cluster_bootstrap(daily, "market_date", {"brier": F.col("b"), "pnl": F.col("p")}, 200, "s7")


@query("r01_bootstrap_rr", f"""WITH {RES_SQL}, d AS (SELECT market_date, sum(pnl) AS p, sum(entry) AS c FROM v_res GROUP BY market_date), i AS (SELECT *, row_number() OVER (ORDER BY market_date) - 1 AS ix, count(*) OVER () AS n FROM d),
  s AS (SELECT rep, {DRAW.format(seed='rr')} AS ix FROM (SELECT unnest(range(0, 100)) AS rep), (SELECT ix AS slot, n FROM i)), m AS (SELECT rep, sum(p) / sum(c) AS v FROM s JOIN i ON i.ix = s.ix GROUP BY rep), l AS (SELECT list(v ORDER BY v) AS s, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) AS pp FROM m)
  SELECT s[CAST(floor(0.05 * 99) AS INTEGER) + 1] AS lower_5pct, s[CAST(floor(0.5 * 99) AS INTEGER) + 1] AS median, s[CAST(floor(0.95 * 99) AS INTEGER) + 1] AS upper_95pct, pp AS probability_positive FROM l""", "lower_5pct median upper_95pct probability_positive")
def r01b(spark, sf):
    daily = resolved(spark, sf).groupBy("market_date").agg(F.sum("entry").alias("c"), F.sum("pnl").alias("p"))
    return metrics.bootstrap_rr(daily, "market_date", "c", "p", 100, "rr")


@query("p06_cluster_lcb", f"""WITH {RES_SQL}, d AS (SELECT model_name, market_date, round(sum(pnl) / sum(entry), 8) AS rr FROM v_res GROUP BY ALL) SELECT model_name, avg(rr) AS mean_daily_rr, count(*) AS dates, avg(rr) - 1.645 * stddev_samp(rr) / sqrt(count(*)) AS lcb_daily_rr FROM d GROUP BY model_name""", "mean_daily_rr lcb_daily_rr")
def p06(spark, sf):
    daily = resolved(spark, sf).groupBy("model_name", "market_date").agg(F.round(F.sum("pnl") / F.sum("entry"), 8).alias("rr"))
    return discovery.cluster_lcb(daily, ["model_name"])


@query("u03_common_dates", f"""WITH {SIGNAL_SQL}, n AS (SELECT market_family, count(DISTINCT model_name) AS need FROM v_signal GROUP BY ALL), h AS (SELECT market_family, market_date, count(DISTINCT model_name) AS have FROM v_signal GROUP BY ALL) SELECT h.market_family, market_date FROM h JOIN n ON n.market_family = h.market_family AND have = need""", dates="market_date")
def u03(spark, sf):
    return discovery.common_dates(signals(spark, sf), "market_family", "model_name", "market_date")


@query("k07_sample_even", f"""WITH {SIGNAL_SQL}, r AS (SELECT year(ts) AS y, id, row_number() OVER (PARTITION BY year(ts) ORDER BY {SQL_ORDER}) - 1 AS pos, count(*) OVER (PARTITION BY year(ts)) AS n FROM v_signal), w AS (SELECT y, CAST(round_even(i * (n - 1) / 99.0, 0) AS BIGINT) AS pos FROM (SELECT DISTINCT y, n FROM r), (SELECT unnest(range(0, 100)) AS i))
  SELECT r.y AS year, count(*) AS n, sum(r.pos)::BIGINT AS positions, max(id) AS top_id FROM r JOIN (SELECT DISTINCT y, pos FROM w) w ON w.y = r.y AND w.pos = r.pos GROUP BY r.y""")
def k07(spark, sf):
    df = signals(spark, sf).withColumn("year", F.year("ts").cast("long"))
    numbered = ranks.exact_position(df, ["year"], F.floor(F.unix_micros("ts") / 86_400_000_000), ORDER).select("id", "liquidity", (F.col("_pos") - 1).alias("pos"))
    kept = select.sample_group(df, "year", F.floor(F.unix_micros("ts") / 86_400_000_000), ORDER, 100)
    return kept.join(numbered, ["id", "liquidity"]).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("positions"), F.max("id").alias("top_id"))


@query("u04_dedupe_training", f"""WITH {SIGNAL_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY station, market_date, minute_of_day % 60 ORDER BY CASE WHEN model_name = 'm0' THEN 0 ELSE 1 END, {SQL_ORDER}) AS rn FROM v_signal) SELECT model_name, count(*) AS n FROM d WHERE rn = 1 GROUP BY model_name""")
def u04(spark, sf):
    from skyledger.plans.pricing import dedupe_training

    df = signals(spark, sf).withColumns({"decision_key": F.concat_ws(":", "station", (F.col("minute_of_day") % 60).cast("string")), "role": F.when(F.col("model_name") == "m0", "evaluation").otherwise("fit")})
    return dedupe_training(df, ["decision_key", "market_date"], "role", ORDER).groupBy("model_name").agg(F.count(F.lit(1)).alias("n"))


@query("w10_uncertainty_reserve", f"""WITH {RES_SQL}, d AS (SELECT model_name, market_date, avg(CASE WHEN minute_of_day % 3 > 0 THEN fair - correct END) AS r, min(ts) AS first_at, max(ts) + INTERVAL 1 DAY AS resolved_at FROM v_signal GROUP BY ALL),
  x AS (SELECT a.model_name, a.market_date, list(greatest(b.r, 0) ORDER BY greatest(b.r, 0)) AS s FROM d a JOIN d b ON b.r IS NOT NULL AND b.model_name = a.model_name AND b.market_date < a.market_date AND b.resolved_at < a.first_at GROUP BY ALL)
  SELECT d.model_name, d.market_date, coalesce(len(s), 0)::BIGINT AS prior_dates, greatest(0.02, coalesce(s[CAST(greatest(0, ceil(0.8 * len(s)) - 1) AS INTEGER) + 1], 0)) AS reserve FROM d LEFT JOIN x ON x.model_name = d.model_name AND x.market_date = d.market_date""", "reserve", dates="market_date")
def w10(spark, sf):
    """Residual quantile of dates resolved (a day after their last decision) before the first decision of the date; dates whose
    usable decisions are all unresolved have no residual."""
    from skyledger.plans.pricing import uncertainty_reserve

    daily = signals(spark, sf).groupBy("model_name", "market_date").agg(
        F.avg(F.when(F.col("minute_of_day") % 3 > 0, F.col("fair") - F.col("correct"))).alias("residual"), F.min("ts").alias("first_at"), (F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("resolved_at"))
    return uncertainty_reserve(daily, ["model_name"], "market_date", "residual", 0.8, 0.02, "first_at", "resolved_at")
