"""Calibration fits, models, searches and roles over signals and observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import bands, buckets
from skyledger.functions.geo import radiation_surprise
from skyledger.operators import metrics
from skyledger.plans import calibrate, discovery, features, models, pricing, replay, search
from skyledger.queries.dist_queries import lines
from skyledger.queries.feature_queries import local_obs
from skyledger.queries.metric_queries import resolved
from skyledger.queries.registry import query
from skyledger.queries.replay_queries import BASKET_SQL, baskets_in, candidates, forward_rows
from skyledger.queries.signal_queries import ORDER, positions
from skyledger.queries.views import SIGNAL_SQL, signals, table
from skyledger.session import materialize
from skyledger.sources import tables


def logit_sql(p: str, eps: str = "1e-6") -> str:
    q = f"least(greatest({p}, {eps}), 1 - {eps})"
    return f"ln({q} / (1 - {q}))"


def newton_sql(name: str, src: str, groups: list[str], k: int, l2: str = "1.0", steps: int = 14) -> str:
    """Steps of Newton's method for logistic fits of `src` (groups, x1.., y, w, n), one table a step; `name` has the last coefficients
    b0.., and rows, weight and both classes' weights of each group. `k` counts the coefficients, 2 or 3."""
    g = ", ".join(groups)
    x = ["1", "x1", "x2"][:k]
    b = [f"b{i}" for i in range(k)]
    p = "1 / (1 + exp(-(" + " + ".join(f"b{i} * {x[i]}" for i in range(k)) + ")))"
    grad = ", ".join(f"sum(w * (y - p) * {x[i]}) - {l2 if i else 0} * any_value(b{i}) AS g{i}" for i in range(k))
    hess = ", ".join(f"sum(w * p * (1 - p) * {x[i]} * {x[j]}) + {(l2 if i else '0') if i == j else '0'} + {'1e-12' if i == j else '0'} AS h{i}{j}" for i in range(k) for j in range(i, k))
    if k == 2:
        det, step = "(h00 * h11 - h01 * h01)", ["(g0 * h11 - g1 * h01)", "(h00 * g1 - h01 * g0)"]
    else:
        c = ["(h11 * h22 - h12 * h12)", "(h02 * h12 - h01 * h22)", "(h01 * h12 - h02 * h11)", "(h00 * h22 - h02 * h02)", "(h01 * h02 - h00 * h12)", "(h00 * h11 - h01 * h01)"]
        det = f"(h00 * {c[0]} + h01 * {c[1]} + h02 * {c[2]})"
        step = [f"(g0 * {c[0]} + g1 * {c[1]} + g2 * {c[2]})", f"(g0 * {c[1]} + g1 * {c[3]} + g2 * {c[4]})", f"(g0 * {c[2]} + g1 * {c[4]} + g2 * {c[5]})"]
    out = [f"{name}_0 AS (SELECT {g}, {', '.join(f'CAST(0 AS DOUBLE) AS {c}' for c in b)} FROM {src} GROUP BY ALL)"]
    for s in range(steps):
        size = "greatest(" + ", ".join(f"abs(s{i})" for i in range(k)) + ")"
        out.append(f"{name}_{s + 1} AS MATERIALIZED (SELECT {g}, {', '.join(f'CASE WHEN one THEN b{i} ELSE b{i} + s{i} * CASE WHEN {size} > 4 THEN 4 / {size} ELSE 1 END END AS b{i}' for i in range(k))} FROM (SELECT *, {', '.join(f'{step[i]} / {det} AS s{i}' for i in range(k))} FROM "
                   f"(SELECT {g}, {', '.join(f'any_value(b{i}) AS b{i}' for i in range(k))}, {grad}, {hess}, min(y) = max(y) AS one FROM (SELECT s.*, {', '.join(b)}, {p} AS p FROM {src} s JOIN {name}_{s} USING ({g})) t GROUP BY {g}) u) v)")
    out.append(f"{name} AS (SELECT {g}, {', '.join(b)}, rows, weight, one FROM {name}_{steps} JOIN (SELECT {g}, CAST(sum(n) AS BIGINT) AS rows, sum(w) AS weight, min(y) = max(y) AS one FROM {src} GROUP BY {g}) t USING ({g}))")
    return ", ".join(out)


def walk_sql(name: str, src: str, day: str, k: int, extra: str = "TRUE", calendar: str = "") -> str:
    """Fits `name` of each eval_date over the rows of earlier dates in `src` (day, x1.., y, w), with a further test on r and e."""
    x = ", ".join(["x1", "x2"][: k - 1])
    days = calendar or f"SELECT DISTINCT {day} AS eval_date FROM {src}"
    return f"{name}_e AS ({days}), {name}_s AS MATERIALIZED (SELECT eval_date, {x}, y, sum(w) AS w, count(*) AS n FROM {src} r JOIN {name}_e e ON r.{day} < e.eval_date AND ({extra}) GROUP BY ALL), " + newton_sql(name, f"{name}_s", ["eval_date"], k)


def monthly(spark, sf):
    """Resolved signals whose date is the month, so a walk forward has about eighty fits; labels are known 20 days after."""
    return resolved(spark, sf).withColumns({"month": F.trunc("ts", "month"), "resolved_at": F.col("ts") + F.expr("INTERVAL 20 DAY")})


MONTH_SQL = SIGNAL_SQL + f""", mr AS (SELECT *, CAST(date_trunc('month', ts) AS DATE) AS month, {logit_sql('fair')} AS x1, {logit_sql('entry')} AS x2, correct AS y, ts + INTERVAL 20 DAY AS resolved_at FROM v_signal WHERE correct IS NOT NULL)"""
APPLIED = "CASE WHEN f.rows >= 30 AND NOT f.one THEN 1 / (1 + exp(-(b0 + b1 * x1{more}))) ELSE {raw} END"


@query("m01_walk_forward_calibration", f"""WITH {MONTH_SQL}, wr AS (SELECT *, CAST(cost AS DOUBLE) AS w FROM mr), {walk_sql('f', 'wr', 'month', 3, 'r.resolved_at < e.first_at', 'SELECT month AS eval_date, min(ts) AS first_at FROM wr GROUP BY month')},
  c AS (SELECT r.month, CASE WHEN f.rows IS NULL THEN 'NO_PRIOR_DATES' WHEN f.rows < 30 THEN 'INSUFFICIENT_ROWS' WHEN f.one THEN 'SINGLE_CLASS' ELSE 'FITTED' END AS reason, fair, f.rows AS train, {APPLIED.format(more=' + b2 * x2', raw='fair')} AS cal FROM wr r LEFT JOIN f ON f.eval_date = r.month)
  SELECT month, reason, count(*) AS n, max(train) AS train_rows, avg(cal) AS calibrated, avg(fair) AS raw FROM c GROUP BY ALL""", "calibrated raw", dates="month")
def m01(spark, sf):
    out = calibrate.walk_forward_calibration(monthly(spark, sf), "month", "fair", "correct", "cost", "entry", decided_at="ts", resolved_at="resolved_at")
    return out.groupBy("month", F.coalesce("fallback_reason", F.lit("FITTED")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.max("train_rows").alias("train_rows"), F.avg("calibrated").alias("calibrated"), F.avg("fair").alias("raw"))


PLATT_SQL = SIGNAL_SQL + f""", pr AS (SELECT model_name, station, {logit_sql('fair')} AS x1, correct AS y FROM v_signal WHERE correct IS NOT NULL), ps AS MATERIALIZED (SELECT model_name, station, x1, y, CAST(count(*) AS DOUBLE) AS w, count(*) AS n FROM (SELECT * FROM pr UNION ALL SELECT model_name, '*', x1, y FROM pr) z GROUP BY ALL), """ + newton_sql("f", "ps", ["model_name", "station"], 2)


@query("m02_fit_platt", f"WITH {PLATT_SQL} SELECT model_name, station, b0 AS intercept, b1 AS slope, rows FROM f WHERE rows >= 30 AND NOT one", "intercept slope")
def m02(spark, sf):
    return calibrate.fit_platt(resolved(spark, sf), "fair", "correct", ["model_name", "station"])


@query("m03_apply_calibration", f"""WITH {PLATT_SQL}, k AS (SELECT * FROM f WHERE rows >= 400 AND NOT one), a AS (SELECT s.model_name, CASE WHEN e.b0 IS NOT NULL THEN 'exact' WHEN d.b0 IS NOT NULL THEN 'fallback' ELSE 'raw' END AS calibration_scope,
  CASE WHEN coalesce(e.b0, d.b0) IS NULL THEN fair ELSE 1 / (1 + exp(-(coalesce(e.b0, d.b0) + coalesce(e.b1, d.b1) * {logit_sql('fair')}))) END AS cal FROM v_signal s LEFT JOIN k e ON e.model_name = s.model_name AND e.station = s.station LEFT JOIN k d ON d.model_name = s.model_name AND d.station = '*')
  SELECT model_name, calibration_scope, count(*) AS n, avg(cal) AS calibrated FROM a GROUP BY ALL""", "calibrated")
def m03(spark, sf):
    fits = calibrate.fit_platt(resolved(spark, sf), "fair", "correct", ["model_name", "station"], 400)
    out = calibrate.apply_calibration(signals(spark, sf), fits, "fair", ["model_name", "station"])
    return out.groupBy("model_name", "calibration_scope").agg(F.count(F.lit(1)).alias("n"), F.avg("calibrated").alias("calibrated"))


@query("a18_calibration_line", f"WITH {SIGNAL_SQL}, ls AS MATERIALIZED (SELECT model_name, {logit_sql('fair', '1e-12')} AS x1, correct AS y, CAST(sum(cost) AS DOUBLE) AS w, count(*) AS n FROM v_signal WHERE correct IS NOT NULL GROUP BY ALL), {newton_sql('f', 'ls', ['model_name'], 2, '1e-6')} SELECT model_name, b0 AS intercept, b1 AS slope, CASE WHEN one THEN 'SINGLE_CLASS' ELSE 'FITTED' END AS status, rows, weight FROM f", "intercept slope weight")
def a18b(spark, sf):
    from skyledger.functions.prob import logit

    rows = resolved(spark, sf).select("model_name", logit(F.col("fair"), 1e-12).alias("x"), "correct", "cost")
    fits = calibrate.fit_logistic(rows, ["model_name"], ["x"], "correct", "cost", l2=1e-6)
    return fits.select("model_name", F.col("coefficients")[0].alias("intercept"), F.col("coefficients")[1].alias("slope"), "status", "rows", "weight")


@query("p18_calibrated_replay", f"""WITH {MONTH_SQL}, wr AS (SELECT *, CAST(1 AS DOUBLE) AS w FROM mr), {walk_sql('f', 'wr', 'month', 2)}, c AS (SELECT r.*, {APPLIED.format(more='', raw='fair')} - entry AS ce FROM wr r LEFT JOIN f ON f.eval_date = r.month),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station, market_date ORDER BY round(ce, 9) DESC, ts, id, liquidity) AS rn FROM c) z WHERE rn = 1)
  SELECT CAST(t AS DOUBLE) AS threshold, count(*) AS n, sum(correct - entry) AS pnl, sum(correct - entry) / sum(entry) AS rr, avg(CAST(correct AS DOUBLE)) AS hit_rate FROM b, (VALUES (0.0), (0.05), (0.1), (0.2)) v(t) WHERE ce >= t GROUP BY t""", "threshold pnl rr hit_rate")
def p18(spark, sf):
    return calibrate.calibrated_replay(monthly(spark, sf), "month", "fair", "entry", "correct", ["station", "market_date"], ORDER, [0.0, 0.05, 0.1, 0.2])


@query("m11_fit_clusters", f"""WITH {BASKET_SQL}, mr AS (SELECT model_name, CAST(date_trunc('month', ts) AS DATE) AS month, CASE WHEN hit THEN 1 ELSE 0 END AS y, least(fair_mass, 0.999) AS mass, ask_sum, {logit_sql('least(fair_mass, 0.999)')} AS x1, CAST(ask_sum AS DOUBLE) AS x2, CAST(1 AS DOUBLE) AS w FROM v_basket),
  {walk_sql('f', 'mr', 'month', 2)}, {walk_sql('h', 'mr', 'month', 3)}
  SELECT model_name, count(*) AS n, avg({APPLIED.format(more='', raw='mass')}) AS by_mass, avg(CASE WHEN h.rows >= 30 AND NOT h.one THEN 1 / (1 + exp(-(h.b0 + h.b1 * x1 + h.b2 * x2))) ELSE mass END) AS by_context
  FROM mr LEFT JOIN f ON f.eval_date = month LEFT JOIN h ON h.eval_date = month GROUP BY model_name""".replace("exp(-(b0 + b1 * x1))", "exp(-(f.b0 + f.b1 * x1))"), "by_mass by_context")
def m11(spark, sf):
    b = replay.top_n_basket(baskets_in(spark, sf), 3).withColumns({"month": F.trunc("ts", "month"), "y": F.col("hit").cast("int"), "mass": F.least(F.col("fair_mass"), F.lit(0.999))})
    alike = materialize(b.groupBy("model_name", "month", "mass", "y", "ask_sum").agg(F.count(F.lit(1)).alias("n")))
    out = calibrate.fit_clusters(alike, "month", "mass", "y", ["ask_sum"], n="n")
    by_mass, by_context = (F.sum(F.col(c) * F.col("n")) / F.sum("n") for c in ("mass_calibrated", "context_calibrated"))
    return out.groupBy("model_name").agg(F.sum("n").alias("n"), by_mass.alias("by_mass"), by_context.alias("by_context"))


def day(text):
    return F.lit(text).cast("date")


@query("m04_train_threshold")
def m04(spark, sf):
    out = models.train_threshold(resolved(spark, sf), ["entry", "fair", "minute_of_day", "book_age"], "correct", "market_date", day("1999-01-01"), day("2000-01-01"), 5, 3)
    return metrics.binary_metrics(out, "calibrated_probability", "correct", "market_date")


@query("m05_train_bucket")
def m05(spark, sf):
    df = lines(spark, sf).withColumn("part", F.col("ladder_id") % 4)
    out = models.train_bucket(df, ["score", "s1", "s2"], ["ladder_id"], "y", "part", F.lit(3), 5).withColumn("ord", F.col("line") * 10000000 + F.col("partkey"))
    return metrics.ladder_metrics(out, ["ladder_id"], "normalized_probability", "y", "progress", "ord")


def daily_rows(spark, sf):
    return features.next_day(features.daily_station(local_obs(spark, sf))).withColumns({"hour": F.dayofmonth("local_date") % 16, "delta": F.rint(F.col("target_value") - F.col("final_high")).cast("int")})


@query("m06_train_regressor")
def m06(spark, sf):
    scored, _ = models.train_regressor(daily_rows(spark, sf), ["final_high", "prior_day", "prior_3day_mean"], "target_value", "local_date", "hour", day("2024-01-22"), 5)
    return models.regressor_report(scored, "target_value")


@query("m07_train_next_day")
def m07(spark, sf):
    df = daily_rows(spark, sf).withColumn("y", (F.col("target_value") >= F.col("final_high")).cast("int"))
    out = models.train_threshold(df, ["final_high", "prior_day", "prior_7day_mean"], "y", "local_date", day("2024-01-16"), day("2024-01-22"), 5, 3)
    return metrics.binary_metrics(out, "calibrated_probability", "y", "local_date")


@query("m08_fit_hurdle")
def m08(spark, sf):
    out = models.fit_hurdle(daily_rows(spark, sf), ["final_high", "prior_day", "prior_3day_mean"], "delta", "local_date", day("2024-01-22"))
    return out.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.avg("peak_probability").alias("peak"), F.avg(F.aggregate("delta_mass", F.lit(0.0), lambda a, x: a + x)).alias("mass"))


@query("m09_fit_spatial")
def m09(spark, sf):
    df = daily_rows(spark, sf).withColumn("residual", F.col("target_value") - F.col("final_high"))
    out = models.fit_spatial(df, ["final_high", "prior_day", "prior_7day_mean"], "residual", F.col("prior_day").isNotNull(), "local_date", day("2024-01-22"))
    return out.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.avg("correction").alias("correction"))


def cohort(spark, sf):
    """Signals with a radiation surprise built from their own columns."""
    s = radiation_surprise(300 + F.col("cost") * 5, 320 + F.col("liquidity"), 35 + F.col("entry") * 5, F.lit(-90.0), F.col("ts"))
    # a filter on the surprise would compute it twice; an explode of none or one does not
    known = F.explode(F.array_compact(F.array(s)))
    return resolved(spark, sf).withColumn("regime", bands.cloud_regime(F.col("cost") * 2)).withColumn("surprise", known)


@query("m10_fit_surprise")
def m10(spark, sf):
    rows = cohort(spark, sf).select("fair", "entry", "surprise", "regime", "correct", "market_date")
    out = models.fit_surprise(rows, ["fair", "entry"], "surprise", "regime", "correct", "market_date", day("2000-01-01"))
    return metrics.paired_delta(out, "challenger_probability", "baseline_probability", "correct", "market_date").agg(
        F.count(F.lit(1)).alias("dates"), F.avg("log_loss_delta").alias("log_loss_delta"), F.avg("brier_delta").alias("brier_delta"))


SUN_SQL = """a AS (SELECT id, liquidity, cost, correct, q, 35 + entry * 5 AS lat, -90.0 AS lon, ts + to_minutes(q) AS t FROM v_signal, (SELECT unnest([-30, 30, 90, 150]) AS q) k WHERE correct IS NOT NULL), b AS (SELECT *, dayofyear(t) AS d, hour(t) * 60.0 + minute(t) + second(t) / 60.0 AS m FROM a), g AS (SELECT *, 2 * pi() / 365.0 * (d - 1 + (m / 60.0 - 12.0) / 24.0) AS g FROM b),
  s AS (SELECT *, m + 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) + 4.0 * lon AS sm, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS dec FROM g),
  z AS (SELECT *, greatest(0.0, 1361.0 * (1.0 + 0.033 * cos(2 * pi() * d / 365.0)) * (sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(radians((sm - floor(sm / 1440) * 1440) / 4.0 - 180.0)))) AS toa FROM s),
  e AS (SELECT id, liquidity, cost, correct, max(toa) FILTER (WHERE q < 0) AS seen, avg(toa) FILTER (WHERE q > 0) AS ahead FROM z GROUP BY ALL)"""


@query("p22_surprise_cohort", f"""WITH {SIGNAL_SQL}, {SUN_SQL} SELECT CASE WHEN cost * 2 <= 25 THEN 'CLEAR' WHEN cost * 2 >= 75 THEN 'CLOUDY' ELSE 'MIXED' END AS regime, count(*) AS n, avg((300 + cost * 5) / seen - (320 + liquidity) / ahead) AS surprise, avg(correct) AS rate FROM e WHERE seen >= 50 AND ahead >= 50 GROUP BY ALL""", "surprise rate", 4)
def p22(spark, sf):
    return cohort(spark, sf).groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.avg("surprise").alias("surprise"), F.avg("correct").alias("rate"))


@query("p17_policy_search", f"""WITH {SIGNAL_SQL}, g AS (SELECT s.*, d.delay, w.n AS win, b.n AS band, c.scope FROM v_signal s, (VALUES ('all', 0, 1440), ('morning', 360, 720)) w(n, a, z), (VALUES ('low', 0.0, 0.3), ('any', 0.0, 1.0)) b(n, lo, hi), (VALUES ('station_date'), ('station_date_bucket_side')) c(scope), LATERAL (SELECT unnest(['ANY', s.obs_delay_bucket]) AS delay) d WHERE minute_of_day >= w.a AND minute_of_day < w.z AND entry >= b.lo AND entry <= b.hi),
  r AS (SELECT *, row_number() OVER (PARTITION BY model_name, strategy_bucket, delay, win, band, scope, station, market_date, market_family, CASE WHEN scope <> 'station_date' THEN selected_bucket END, CASE WHEN scope <> 'station_date' THEN selected_side END ORDER BY ts, id, liquidity) AS rn FROM g)
  SELECT model_name, strategy_bucket, delay, win AS "window", band, scope, count(*) AS n, count(pnl) AS resolved, sum(pnl) AS pnl FROM r WHERE rn = 1 GROUP BY ALL""", "pnl")
def p17(spark, sf):
    out = search.policy_search(signals(spark, sf), [("all", 0, 1440), ("morning", 360, 720)], [("low", 0.0, 0.3), ("any", 0.0, 1.0)], ["station_date", "station_date_bucket_side"], ORDER, 30)
    return out.select("model_name", "strategy_bucket", "delay", "window", "band", "scope", "n", "resolved", "pnl")


def cards(spark, sf):
    """Scorecards with the base and conservative scenario side by side."""
    out = replay.forward_scorecards(forward_rows(spark, sf), candidates(spark, sf), 25.0, 100.0, 5, 20)
    one = ["candidate_id"]
    def pick(name, alias):
        return [F.max(F.when(F.col("scenario") == name, F.col(c))).alias(f"{alias}_{k}") for c, k in (("venue_cost", "cost"), ("venue_pnl", "pnl"), ("venue_rr", "rr"), ("mean_pnl", "mean"), ("standard_error", "se"))]
    wide = out.groupBy(*one).agg(*pick("base", "base"), *pick("conservative", "conservative"), F.max("venue_resolved").alias("venue_resolved"), F.max("disagreements").alias("disagreements"),
                                 F.max("blockers").alias("blockers"), F.max("review_state").alias("review_state"), F.max("max_station_share").alias("max_station_share"), F.max("max_market_date_share").alias("max_market_date_share"))
    return wide.join(candidates(spark, sf).select("candidate_id", "family_id", "complexity"), one).withColumn("enough_evidence", F.lit(True))


@query("p15_transition_decisions")
def p15(spark, sf):
    return replay.transition_decisions(cards(spark, sf)).select("candidate_id", "family_id", "hard_rejection", "negative_economics", "promotion_ready", "decision")


@query("p24_role_transitions")
def p24(spark, sf):
    decided = replay.transition_decisions(cards(spark, sf))
    roles = candidates(spark, sf).select("candidate_id", "family_id", F.when(F.col("candidate_id").startswith("m0:"), "CHAMPION").otherwise("CHALLENGER").alias("role"), F.lit(1).alias("negative_streak"))
    common = decided.select("candidate_id", F.concat(F.lit("m0:"), F.element_at(F.split("candidate_id", ":"), 2)).alias("peer_id"), F.col("base_pnl").alias("pnl_delta"), F.col("base_rr").alias("rr_delta"), F.lit(True).alias("simpler"))
    return replay.role_transitions(roles, decided, common)


@query("p10_evaluate_manifest")
def p10(spark, sf):
    runs = replay.forward_executions(forward_rows(spark, sf), candidates(spark, sf), 25.0, 100.0, (("base", 1.0),))
    return runs.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("executions"), F.sum("cost").alias("cost"), F.min("ts").alias("first_execution"))


@query("j18_common_cohort", f"""WITH {SIGNAL_SQL}, d AS (SELECT model_name, market_date, sum(pnl) AS p, sum(entry) AS e FROM v_signal WHERE pnl IS NOT NULL GROUP BY ALL), c AS (SELECT market_date FROM d GROUP BY market_date HAVING count(*) = (SELECT count(DISTINCT model_name) FROM d))
  SELECT model_name, count(*) AS dates, sum(p) AS pnl, sum(p) / sum(e) AS rr FROM d JOIN c USING (market_date) GROUP BY model_name""", "pnl rr")
def j18(spark, sf):
    daily = resolved(spark, sf).groupBy("model_name", "market_date").agg(F.sum("pnl").alias("p"), F.sum("entry").alias("e")).withColumn("family", F.lit("f"))
    days = discovery.common_dates(daily, "family", "model_name", "market_date")
    return daily.join(days, ["family", "market_date"], "left_semi").groupBy("model_name").agg(F.count(F.lit(1)).alias("dates"), F.sum("p").alias("pnl"), (F.sum("p") / F.sum("e")).alias("rr"))


@query("a27_markout_summary", f"""WITH {SIGNAL_SQL} SELECT horizon, count(*) AS n, avg(mid - entry) AS mean_markout FROM (SELECT entry, '10s' AS horizon, fair AS mid FROM v_signal WHERE correct IS NOT NULL UNION ALL SELECT entry, '10m', fair / 2 FROM v_signal WHERE correct IS NOT NULL) GROUP BY horizon""", "mean_markout")
def a27(spark, sf):
    df = signals(spark, sf).select(F.col("entry").alias("vwap"), F.col("correct").isNotNull().alias("markouts_valid"), F.create_map(F.lit("10s"), F.col("fair"), F.lit("10m"), F.col("fair") / 2).alias("markouts"))
    return metrics.markout_summary(df)


@query("x20_mark_positions", f"""WITH {SIGNAL_SQL}, b AS (SELECT station, arg_max(fair, (ts, fair)) AS bid FROM v_signal GROUP BY station), p AS (SELECT s.*, b.bid, CASE WHEN selected_bucket LIKE '>=%' AND 55 + cost >= CAST(regexp_extract(selected_bucket, '([0-9]+)', 1) AS DOUBLE) THEN 'W' WHEN selected_bucket NOT LIKE '>=%' AND 55 + cost > CAST(regexp_extract(selected_bucket, '([0-9]+)F?$', 1) AS DOUBLE) THEN 'L' ELSE 'O' END AS y FROM v_signal s JOIN b USING (station)),
  q AS (SELECT *, CASE WHEN selected_side = 'BUY_YES' THEN CASE y WHEN 'W' THEN 'WON' WHEN 'L' THEN 'LOST' ELSE 'OPEN' END ELSE CASE y WHEN 'W' THEN 'LOST' WHEN 'L' THEN 'WON' ELSE 'OPEN' END END AS state FROM p)
  SELECT state, count(*) AS n, sum(CASE state WHEN 'WON' THEN 1.0 WHEN 'LOST' THEN 0.0 ELSE bid END - entry) AS mark_pnl FROM q GROUP BY state""", "mark_pnl")
def x20(spark, sf):
    df = signals(spark, sf).withColumn("_b", buckets.parse_bucket(F.col("selected_bucket")))
    pos = df.select(F.col("station").alias("token_id"), F.col("selected_side").alias("side"), F.col("_b.lower").alias("lower"), F.col("_b.upper").alias("upper"), "entry", F.lit(1.0).alias("shares"), (55 + F.col("cost")).alias("high_so_far"))
    rows = df.select(F.col("station").alias("token_id"), F.col("fair").alias("best_bid"), "ts")
    return pricing.mark_positions(pos, rows, F.lit("2002-01-01").cast("timestamp")).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("mark_pnl").alias("mark_pnl"))


@query("x16_post_only_quotes", f"""WITH {SIGNAL_SQL}, s AS (SELECT *, CASE WHEN minute_of_day % 11 = 0 THEN NULL ELSE entry END AS ask, minute_of_day % 13 <> 0 AS eligible, CASE WHEN minute_of_day % 17 = 0 THEN NULL ELSE id END AS token FROM v_signal), g AS (SELECT s.*, q.spec, q.off, q.usd FROM s, (VALUES ('near', 0, 25.0), ('far', 3, 50.0), ('small', 1, 0.5)) q(spec, off, usd)),
  p AS (SELECT *, CASE WHEN ask IS NOT NULL THEN floor(least(fair - 0.06, ask - greatest(off, 1) / 100.0) * 100 + 1e-9) / 100 END AS price FROM g),
  r AS (SELECT *, CASE WHEN NOT eligible THEN CASE WHEN minute_of_day % 2 = 0 THEN 'SHEET' ELSE 'PRICE_SHEET_INELIGIBLE' END WHEN token IS NULL THEN 'MISSING_TOKEN' WHEN ask IS NULL THEN 'MISSING_BOOK_OR_ASK' WHEN price <= 0 THEN 'NO_POST_ONLY_PRICE' WHEN price >= ask - 1e-9 THEN 'WOULD_CROSS_SPREAD' WHEN usd < 1 THEN 'QUOTE_SIZE_BELOW_MIN' END AS reason FROM p)
  SELECT spec, reason AS skip_reason, count(*) AS n, sum(CASE WHEN reason IS NULL THEN price END) AS price FROM r GROUP BY ALL""", "price", 4)
def x16(spark, sf):
    every = F.col("minute_of_day")
    sheets = signals(spark, sf).select(
        F.when(every % 17 != 0, F.col("id")).alias("token_id"), (every % 13 != 0).alias("eligible"), F.when(every % 2 == 0, "SHEET").alias("reject_reason"), (F.col("fair") - 0.06).alias("max_quote"),
        F.when(every % 11 != 0, F.col("entry")).alias("best_ask"), F.array(F.struct((F.col("entry") - 0.03).alias("price"), F.col("cost").alias("size"))).alias("bids"))
    specs = [{"name": "near", "ask_offset_cents": 0, "size_usd": 25}, {"name": "far", "ask_offset_cents": 3, "size_usd": 50}, {"name": "small", "ask_offset_cents": 1, "size_usd": 0.5}]
    return pricing.post_only_quotes(sheets, specs).groupBy("spec", "skip_reason").agg(F.count(F.lit(1)).alias("n"), F.sum("quote_price").alias("price"))


ROW_JSON = """'{"c_acctbal":' || CAST(c_acctbal AS VARCHAR) || ',"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}'"""


@query("s12_row_set_hash", f"SELECT count(*) AS rows, " + ", ".join(f"CAST(sum(CAST('0x' || substr(md5({ROW_JSON}), {a}, 15) AS HUGEINT)) AS VARCHAR) AS {n}" for a, n in ((1, "sum_a"), (16, "sum_b"))) + " FROM customer")
def s12(spark, sf):
    return tables.row_set_hash(table(spark, sf, "customer").select("c_acctbal", "c_custkey", "c_mktsegment", "c_nationkey"))


@query("j10_explode_sources", f"""WITH {SIGNAL_SQL}, g AS (SELECT model_name, station, list(id) AS ids FROM v_signal GROUP BY ALL), x AS (SELECT model_name, unnest(ids) AS sid FROM g) SELECT model_name, count(*) AS sources, count(DISTINCT sid) AS distinct_sources FROM x GROUP BY model_name""")
def j10(spark, sf):
    from skyledger.plans.reports import explode_sources

    g = signals(spark, sf).groupBy("model_name", "station", "market_date").agg(F.to_json(F.collect_list("id")).alias("source_ids"))
    return explode_sources(g).groupBy("model_name").agg(F.count("source_id").alias("sources"), F.countDistinct("source_id").alias("distinct_sources"))


@query("w05_scopes", f"""WITH {SIGNAL_SQL}, a AS (SELECT row_number() OVER (PARTITION BY station, market_date, market_family, selected_bucket, selected_side, strategy_bucket ORDER BY ts, id, liquidity) AS rn, model_name FROM v_signal) SELECT model_name, count(*) AS n FROM a WHERE rn = 1 GROUP BY model_name""")
def w05b(spark, sf):
    from skyledger.operators.select import first_by_scope, scope_columns

    return first_by_scope(positions(spark, sf), scope_columns("station_date_bucket_side", True), ORDER).groupBy("model_name").agg(F.count(F.lit(1)).alias("n"))


@query("b07_execution_modes")
def b07(spark, sf):
    from skyledger.operators import books
    from skyledger.queries.views import tape

    book = books.book_at(tape(spark, sf), F.col("received_at") <= F.lit("2024-01-20 00:00:00").cast("timestamp"))
    rows = book.withColumns({"selected_side": F.lit("BUY_YES"), "fair": (F.col("token_id").cast("int") % 40 + 60) / 100.0})
    out = books.execution_modes(rows, 0.05, 0.02, 0.05, (25.0, 50.0))
    return out.select("token_id", F.coalesce("bid_reason", F.lit("OK")).alias("reason"), F.col("sweep_25.cost").alias("sweep_25"), F.col("sweep_50.cost").alias("sweep_50"), F.size("bid_ladder").alias("rungs"))


@query("x15_ladders_from_json")
def x15(spark, sf):
    from skyledger.operators import dists
    from skyledger.queries.views import observations

    obs = observations(spark, sf)
    cut = F.col("k") % 10 + 5
    entry = lambda name, fair: F.struct(F.concat_ws(":", F.lit(name), (F.col("k") % 10).cast("string")).alias("market_id"), fair.alias("fair_yes"), (fair / 2 + 0.1).alias("yes_ask"))
    rows = obs.select("obs_id", F.to_json(F.array(entry("lo", F.lit(0.3)), entry("hi", 0.2 + F.col("k") / 200))).alias("raw"))
    days = obs.select((F.col("k") % 10).alias("d"), cut.alias("cut")).distinct()
    bounds = days.select(F.explode(F.array(
        F.struct(F.concat_ws(":", F.lit("lo"), F.col("d").cast("string")).alias("market_id"), F.lit(None).cast("double").alias("lower"), (F.col("cut") - 1).cast("double").alias("upper")),
        F.struct(F.concat_ws(":", F.lit("hi"), F.col("d").cast("string")).alias("market_id"), F.col("cut").cast("double").alias("lower"), F.lit(None).cast("double").alias("upper")))).alias("b")).select("b.*")
    out = dists.ladders_from_json(rows, "obs_id", "raw", bounds, 0, 20)
    return out.groupBy(F.coalesce("model_reason", F.lit("OK")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.element_at("model_p", 1)).alias("first_cell"))
