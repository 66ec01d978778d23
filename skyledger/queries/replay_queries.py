"""Consensus, decision cache, discovery, replay, caps and store reports over signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import buckets
from skyledger.operators import scan
from skyledger.plans import discovery, policies, pricing, replay, reports
from skyledger.queries.registry import query
from skyledger.queries.signal_queries import BOUND_SQL, ORDER, POSITION_SQL, SQL_ORDER, positions
from skyledger.queries.views import SIGNAL_SQL, signals, table

KEY = "market_family, station, market_date, obs_delay_bucket, strategy_bucket, selected_side, selected_bucket"
CONS_SQL = SIGNAL_SQL + f""", v_coarse AS (SELECT * REPLACE ('any' AS obs_delay_bucket, CASE WHEN selected_bucket LIKE '<=%' OR selected_bucket LIKE '>=%' THEN 'tail' ELSE 'range' END AS selected_bucket) FROM v_signal), l AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, model_name ORDER BY ts DESC, id DESC, liquidity DESC) AS rn FROM v_coarse WHERE strategy_bucket <> 'PROGRESS' AND model_name IN ('m0', 'm2')),
  v_cons AS (SELECT {KEY}, min(id) AS id, max(ts) AS ts, arg_max(liquidity, (ts, id)) AS liquidity, avg(edge) AS edge, avg(fair) AS fair, arg_min(entry, id) AS entry FROM l WHERE rn = 1 GROUP BY {KEY} HAVING count(*) = 2)"""


def _consensus(spark, sf):
    coarse = signals(spark, sf).withColumns({"obs_delay_bucket": F.lit("any"), "selected_bucket": buckets.bucket_type(F.col("selected_bucket"))})
    return policies.consensus(coarse, {"pair": ["m0", "m2"]}, ["ts", "id", "liquidity"])


@query("j11_consensus", f"WITH {CONS_SQL} SELECT id, station, epoch_us(ts) AS ts_us, liquidity, edge, fair, entry FROM v_cons", "liquidity edge fair entry")
def j11(spark, sf):
    return _consensus(spark, sf).select("id", "station", F.unix_micros("ts").alias("ts_us"), "liquidity", "edge", "fair", "entry")


@query("j12_relaxed_consensus", f"""WITH {SIGNAL_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY model_name, station, market_date, selected_side ORDER BY {SQL_ORDER}) AS rn FROM v_signal)
  SELECT a.station, a.selected_side, count(*) AS pairs, sum(a.entry) AS entry, sum((a.fair + b.fair) / 2) AS fair FROM f a JOIN f b ON a.rn = 1 AND b.rn = 1 AND a.model_name = 'm0' AND b.model_name = 'm1' AND a.station = b.station AND a.market_date = b.market_date AND a.selected_side = b.selected_side GROUP BY ALL""", "entry fair")
def j12(spark, sf):
    out = policies.relaxed_consensus(signals(spark, sf), "m0", "m1", ["ts", "id", "liquidity"])
    return out.groupBy("station", "selected_side").agg(F.count(F.lit(1)).alias("pairs"), F.sum("entry").alias("entry"), F.sum("fair").alias("fair"))


@query("j13_disagreement", f"""WITH {SIGNAL_SQL}, o AS (SELECT {KEY}, arg_max(fair, (ts, id)) AS of, arg_max(edge, (ts, id)) AS oe FROM v_signal WHERE model_name = 'm3' GROUP BY {KEY}),
  c AS (SELECT s.*, of, oe, o.station IS NOT NULL AS hit FROM (SELECT * FROM v_signal WHERE model_name = 'm1') s LEFT JOIN o USING ({KEY}))
  SELECT station, count(*) AS n, sum(fair) AS fair FROM c WHERE CASE WHEN hit THEN NOT coalesce(oe >= 0.5, false) AND fair - of >= 0.1 ELSE fair - entry >= 0.1 END GROUP BY station""", "fair")
def j13(spark, sf):
    df = signals(spark, sf)
    kept = policies.disagreement(df.where("model_name = 'm1'"), df.where("model_name = 'm3'"), 0.1, 0.5)
    return kept.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.sum("fair").alias("fair"))


@query("s07_load_snapshots", f"""WITH {SIGNAL_SQL}, r AS (SELECT id, liquidity, pnl AS result FROM v_signal WHERE correct IS NOT NULL), o AS (SELECT station, market_date, max(cost) AS final FROM v_signal WHERE selected_side = 'BUY_YES' GROUP BY ALL)
  SELECT s.market_family, count(*) AS n, count(r.result) AS scored, count(o.final) AS resolved, sum(o.final) AS finals FROM v_signal s LEFT JOIN r ON r.id = s.id AND r.liquidity = s.liquidity LEFT JOIN o ON o.station = s.station AND o.market_date = s.market_date
  WHERE s.market_date >= DATE '1996-01-01' AND s.market_date <= DATE '1999-12-31' GROUP BY s.market_family""", "finals")
def s07(spark, sf):
    df = signals(spark, sf).withColumns({"selected_market_id": F.col("id"), "id": F.struct("id", "liquidity")})
    results = df.where("correct is not null").select("id", F.col("pnl").alias("result"))
    outcomes = df.where("selected_side = 'BUY_YES'").groupBy("station", "market_date").agg(F.max("cost").alias("final"))
    rows = reports.load_snapshots(df, results, outcomes, F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date"))
    return rows.groupBy("market_family").agg(F.count(F.lit(1)).alias("n"), F.count("result").alias("scored"), F.count("final").alias("resolved"), F.sum("final").alias("finals"))


@query("j09_unresolved_groups", f"""WITH {SIGNAL_SQL} SELECT DISTINCT s.station, s.market_date FROM v_signal s WHERE NOT EXISTS (SELECT 1 FROM v_signal o WHERE o.station = s.station AND o.market_date = s.market_date AND o.correct = 1)""", dates="market_date")
def j09(spark, sf):
    df = signals(spark, sf)
    return reports.unresolved_groups(df, df.where("correct = 1"))


STORE_SQL = POSITION_SQL + f""", v_store AS (SELECT id AS position_id, policy, model_name AS model_group, strategy_bucket, obs_delay_bucket, station, market_date, market_family, selected_side, selected_bucket, ts, entry, fair, edge, correct, pnl, cost AS target, liquidity,
  CASE id % 7 WHEN 0 THEN 'SETTLED' WHEN 1 THEN 'FILLED' WHEN 2 THEN 'PARTIAL' WHEN 3 THEN 'REJECTED' WHEN 4 THEN 'SUBMITTED' ELSE 'UNKNOWN' END AS state, CASE WHEN id % 7 IN (0, 1) THEN cost WHEN id % 7 = 2 THEN cost / 2 END AS cost,
  CASE WHEN id % 7 = 0 THEN pnl END AS realized_pnl, edge / 2 AS unrealized_pnl FROM v_pos)"""


def store(spark, sf):
    """Signals as stored live positions with states, fills and values."""
    m = F.col("id") % 7
    state = F.when(m == 0, "SETTLED").when(m == 1, "FILLED").when(m == 2, "PARTIAL").when(m == 3, "REJECTED").when(m == 4, "SUBMITTED").otherwise("UNKNOWN")
    return positions(spark, sf).select(
        F.col("id").alias("position_id"), "policy", F.col("model_name").alias("model_group"), "strategy_bucket", "obs_delay_bucket", "station", "market_date", "market_family",
        "selected_side", "selected_bucket", "ts", "entry", "fair", "edge", "correct", "pnl", F.col("cost").alias("target"), "liquidity", state.alias("state"),
        F.when(m.isin(0, 1), F.col("cost")).when(m == 2, F.col("cost") / 2).alias("cost"), F.when(m == 0, F.col("pnl")).alias("realized_pnl"), (F.col("edge") / 2).alias("unrealized_pnl"))


@query("a10_result_summary", f"""WITH {SIGNAL_SQL} SELECT strategy_bucket, obs_delay_bucket, count(*) AS snapshots, count(correct) AS scored, count(*) FILTER (WHERE correct = 1) AS correct, avg(correct) AS win_rate, avg(edge) AS avg_edge, avg(pnl) AS avg_pnl,
  CASE obs_delay_bucket WHEN 'instant' THEN 0 WHEN '5m' THEN 5 WHEN '10m' THEN 10 WHEN '15m' THEN 15 WHEN '30m' THEN 30 ELSE 999 END AS delay_order FROM v_signal GROUP BY ALL""", "win_rate avg_edge avg_pnl")
def a10(spark, sf):
    df = signals(spark, sf).withColumn("id", F.struct("id", "liquidity"))
    return reports.result_summary(df.select("id", "obs_delay_bucket", "correct", "edge", "pnl"), df)


PERF_SQL = POSITION_SQL + f""", ids AS (SELECT policy, model_name, strategy_bucket, obs_delay_bucket, station, market_date, min(id) AS position_id, list(id) AS src, avg(entry) AS entry, max(edge) AS edge FROM v_pos GROUP BY policy, model_name, strategy_bucket, obs_delay_bucket, station, market_date),
  x AS (SELECT ids.*, unnest(src) AS sid FROM ids), res AS (SELECT id, max(correct) AS correct, avg(pnl) AS pnl FROM v_signal WHERE model_name <> 'm3' OR correct = 1 GROUP BY id)"""


def perf_inputs(spark, sf):
    pos = positions(spark, sf)
    grouped = pos.groupBy("policy", F.col("model_name").alias("model_group"), "strategy_bucket", "obs_delay_bucket", "station", "market_date").agg(
        F.min("id").alias("position_id"), F.to_json(F.collect_list("id")).alias("source_ids"), F.round(F.avg("entry"), 9).alias("entry"), F.max("edge").alias("edge"))
    results = signals(spark, sf).where("model_name <> 'm3' or correct = 1").groupBy("id").agg(F.max("correct").alias("correct"), F.avg("pnl").alias("pnl"))
    return grouped, results


@query("a11_policy_performance", f"""WITH {PERF_SQL}, p AS (SELECT position_id, policy, station, market_date, entry, edge, max(correct) AS correct, avg(pnl) AS pnl FROM x JOIN res ON res.id = x.sid GROUP BY position_id, policy, strategy_bucket, obs_delay_bucket, station, market_date, entry, edge)
  SELECT policy, count(*) AS resolved_positions, count(DISTINCT (station, market_date)) AS station_days, count(*) FILTER (WHERE correct = 1) AS wins, avg(correct) AS hit_rate, coalesce(sum(pnl), 0) AS total_pnl, avg(entry) AS avg_entry, avg(edge) AS avg_edge FROM p GROUP BY policy""", "hit_rate total_pnl avg_entry avg_edge")
def a11(spark, sf):
    pos, results = perf_inputs(spark, sf)
    return reports.policy_performance(pos, results, ["policy"])


@query("a44_policy_status", f"""WITH {PERF_SQL}, p AS (SELECT position_id, policy, station, market_date, entry, edge, max(correct) AS correct, avg(pnl) AS pnl FROM x LEFT JOIN res ON res.id = x.sid GROUP BY position_id, policy, strategy_bucket, obs_delay_bucket, station, market_date, entry, edge)
  SELECT policy, station, count(*) AS total_positions, count(pnl) AS resolved_positions, count(DISTINCT (station, market_date)) AS station_days, count(*) FILTER (WHERE correct = 1) AS wins, avg(correct) AS hit_rate, coalesce(sum(pnl), 0) AS total_pnl, avg(entry) AS avg_entry, avg(edge) AS avg_edge,
   sum(CASE WHEN pnl IS NOT NULL THEN entry ELSE 0 END) AS resolved_risk, avg(pnl) / nullif(stddev_pop(pnl), 0) AS position_sharpe, sum(pnl) / nullif(sum(CASE WHEN pnl IS NOT NULL THEN entry ELSE 0 END), 0) AS return_on_risk FROM p GROUP BY ALL""",
       "hit_rate total_pnl avg_entry avg_edge resolved_risk position_sharpe return_on_risk", 5)
def a44(spark, sf):
    pos, results = perf_inputs(spark, sf)
    return reports.policy_performance(pos, results, ["policy", "station"], keep_unresolved=True)


@query("a12_performance_by_day", f"""WITH {STORE_SQL}, d AS (SELECT CAST(ts AS DATE) AS utc_date, count(*) AS positions, sum(CASE WHEN state = 'SETTLED' THEN coalesce(realized_pnl, unrealized_pnl, 0) ELSE coalesce(unrealized_pnl, 0) END) AS daily_pnl FROM v_store WHERE state <> 'REJECTED' GROUP BY ALL)
  SELECT *, sum(daily_pnl) OVER (ORDER BY utc_date) AS cumulative_pnl FROM d""", "daily_pnl cumulative_pnl", 4, "utc_date")
def a12(spark, sf):
    return reports.performance_by_day(store(spark, sf))


OPEN = "state IN ('RESERVED', 'SUBMITTED', 'FILLED', 'PARTIAL', 'DELAYED', 'UNKNOWN')"


@query("a13_exposure_summary", f"""WITH {STORE_SQL}, o AS (SELECT *, coalesce(nullif(cost, 0), target, 0) AS risk FROM v_store WHERE {OPEN})
  SELECT level, count(*) AS groups, sum(n)::BIGINT AS positions, sum(r) AS open_risk, max(r) AS top_risk FROM (SELECT 'total' AS level, count(*) AS n, sum(risk) AS r FROM o UNION ALL SELECT 'station_date', count(*), sum(risk) FROM o GROUP BY station, market_date UNION ALL SELECT 'station_date_side', count(*), sum(risk) FROM o GROUP BY station, market_date, selected_side
   UNION ALL SELECT 'exact_bucket_side', count(*), sum(risk) FROM o GROUP BY station, market_date, selected_side, selected_bucket UNION ALL SELECT 'utc_day', count(*), sum(risk) FROM o GROUP BY CAST(ts AS DATE)) GROUP BY level""", "open_risk top_risk")
def a13(spark, sf):
    return reports.exposure_summary(store(spark, sf)).groupBy("level").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("positions").alias("positions"), F.sum("open_risk").alias("open_risk"), F.max("open_risk").alias("top_risk"))


ATT_SQL = STORE_SQL + """, v_att AS (SELECT position_id, ts, i AS attempt, target, CASE WHEN i = 0 THEN coalesce(cost, 0) ELSE 0 END AS cost, CASE WHEN i = 0 THEN coalesce(cost, 0) / entry ELSE 0 END AS filled_shares, CASE WHEN (position_id + i) % 3 = 0 THEN 'GTC' WHEN (position_id + i) % 3 = 1 THEN 'FAK' ELSE 'FOK' END AS order_mode,
  CASE WHEN i = 0 AND state IN ('FILLED', 'SETTLED') THEN 'FILLED' WHEN i = 0 AND state = 'PARTIAL' THEN 'PARTIAL' WHEN position_id % 5 = 0 THEN 'CANCELLED' ELSE 'REJECTED' END AS final_state,
  CASE position_id % 6 WHEN 0 THEN 'RESTING_TTL_EXPIRED' WHEN 1 THEN 'no orders found' WHEN 2 THEN 'INVALID_TICK' WHEN 3 THEN 'INSUFFICIENT_DEPTH' WHEN 4 THEN 'RISK_LIMIT' ELSE 'ORDER_REJECTED' END AS final_reason FROM v_store, (SELECT unnest([0, 1]) AS i))"""


def attempts(spark, sf):
    i = F.col("attempt")
    got = F.when(i == 0, F.coalesce("cost", F.lit(0.0))).otherwise(0.0)
    mode = (F.col("position_id") + i) % 3
    reason = F.element_at(F.array(*[F.lit(x) for x in ("RESTING_TTL_EXPIRED", "no orders found", "INVALID_TICK", "INSUFFICIENT_DEPTH", "RISK_LIMIT", "ORDER_REJECTED")]), (F.col("position_id") % 6 + 1).cast("int"))
    state = F.when((i == 0) & F.col("state").isin("FILLED", "SETTLED"), "FILLED").when((i == 0) & (F.col("state") == "PARTIAL"), "PARTIAL").when(F.col("position_id") % 5 == 0, "CANCELLED").otherwise("REJECTED")
    rows = store(spark, sf).withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select("position_id", "ts", "attempt", "target", got.alias("cost"), (got / F.col("entry")).alias("filled_shares"),
                       F.when(mode == 0, "GTC").when(mode == 1, "FAK").otherwise("FOK").alias("order_mode"), state.alias("final_state"), reason.alias("final_reason"))


@query("a54_reject_reasons", f"""WITH {ATT_SQL} SELECT final_reason, final_state, count(*) AS attempts, sum(target) AS intended, sum(cost) AS filled FROM v_att WHERE ts >= TIMESTAMP '1997-01-01' AND (upper(final_state) IN ('REJECTED', 'FAILED', 'ERROR') OR upper(final_reason) LIKE '%REJECT%' OR upper(final_reason) LIKE '%ERROR%') GROUP BY ALL""", "intended filled")
def a54(spark, sf):
    return reports.reject_reasons(attempts(spark, sf), F.lit("1997-01-01").cast("timestamp"))


@query("a29_policy_retrospective", f"""WITH {ATT_SQL}, g AS (SELECT position_id, bool_or(order_mode = 'GTC') AS resting FROM v_att GROUP BY position_id), pp AS (SELECT *, row_number() OVER (PARTITION BY position_id ORDER BY liquidity) AS rn FROM v_store), s AS (SELECT * FROM pp WHERE rn = 1),
  a AS (SELECT s.policy, x.*, s.state AS parent_state, resting, (upper(final_state) IN ('REJECTED', 'FAILED', 'ERROR') OR upper(final_reason) LIKE '%REJECT%' OR upper(final_reason) LIKE '%ERROR%') AS rej FROM (SELECT DISTINCT position_id, attempt, target, cost, order_mode, final_state, final_reason FROM v_att) x JOIN g ON g.position_id = x.position_id JOIN s ON s.position_id = x.position_id),
  c AS (SELECT *, CASE WHEN cost > 0 AND target > 0 AND cost < target - 1e-6 THEN 'partial_fill' WHEN upper(final_reason) LIKE '%RESTING_TTL_EXPIRED%' OR (order_mode = 'GTC' AND upper(final_state) = 'CANCELLED') THEN 'resting_ttl_expired' WHEN upper(final_reason) LIKE '%TICK%' OR upper(final_reason) LIKE '%INVALID%' THEN 'order_construction_error'
    WHEN order_mode = 'FAK' AND upper(final_reason) LIKE '%NO ORDERS FOUND%' AND resting THEN 'child_fak_miss_then_resting' WHEN rej AND parent_state = 'REJECTED' THEN 'terminal_reject' WHEN rej THEN 'nonterminal_reject' END AS cat FROM a)
  SELECT policy, count(*) AS attempts, count(*) FILTER (WHERE rej) AS rejected_attempts, count(*) FILTER (WHERE cat = 'partial_fill') AS partial_fill, count(*) FILTER (WHERE cat = 'resting_ttl_expired') AS resting_ttl_expired, count(*) FILTER (WHERE cat = 'order_construction_error') AS order_construction_error,
   count(*) FILTER (WHERE cat = 'child_fak_miss_then_resting') AS child_fak_miss_then_resting, count(*) FILTER (WHERE cat = 'terminal_reject') AS terminal_reject FROM c GROUP BY policy""")
def a29(spark, sf):
    from skyledger.operators.select import first_by_scope

    pos = first_by_scope(store(spark, sf), ["position_id"], [F.col("liquidity")])
    att = attempts(spark, sf).select("position_id", "attempt", "target", "cost", "order_mode", "final_state", "final_reason").distinct()
    return reports.policy_retrospective(pos, att).select("policy", "attempts", "rejected_attempts", "partial_fill", "resting_ttl_expired", "order_construction_error", "child_fak_miss_then_resting", "terminal_reject")


@query("a46_reconcile_fills", f"""WITH {ATT_SQL}, s AS (SELECT position_id, sum(filled_shares) AS sh, sum(cost) AS co FROM v_att WHERE final_state IN ('FILLED', 'PARTIAL') AND filled_shares > 0 AND cost > 0 GROUP BY position_id)
  SELECT new_state, count(*) AS n, sum(co) AS cost FROM (SELECT CASE WHEN co + 0.01 >= target THEN 'FILLED' ELSE 'PARTIAL' END AS new_state, co FROM v_store v JOIN s ON s.position_id = v.position_id WHERE {OPEN}) GROUP BY new_state""", "cost")
def a46(spark, sf):
    pos = store(spark, sf).withColumns({"target_shares": F.lit(0.0), "filled_shares": F.lit(None).cast("double"), "avg_entry": F.lit(None).cast("double")})
    return reports.reconcile_fills(pos, attempts(spark, sf)).groupBy("new_state").agg(F.count(F.lit(1)).alias("n"), F.sum("new_cost").alias("cost"))


@query("a30_whole_chain", f"""WITH {STORE_SQL} SELECT model_group AS sleeve, count(*) AS selected_rows, count(*) FILTER (WHERE coalesce(cost, 0) > 0) AS filled_rows, sum(CASE WHEN correct IS NOT NULL THEN target ELSE 0 END) AS selected_risk, sum(CASE WHEN correct = 1 THEN target / entry - target WHEN correct = 0 THEN -target ELSE 0 END) AS selected_pnl,
  sum(CASE WHEN coalesce(cost, 0) > 0 THEN CASE WHEN correct = 1 THEN cost / entry - cost WHEN correct = 0 THEN -cost ELSE 0 END ELSE 0 END) AS filled_entry_pnl, sum(CASE WHEN coalesce(cost, 0) > 0 THEN CASE WHEN correct = 1 THEN cost / (entry + 0.01) - cost WHEN correct = 0 THEN -cost ELSE 0 END ELSE 0 END) AS filled_actual_pnl,
  sum(CASE WHEN coalesce(cost, 0) > 0 THEN 0 ELSE CASE WHEN correct = 1 THEN target / entry - target WHEN correct = 0 THEN -target ELSE 0 END END) AS unfilled_pnl, sum(coalesce(realized_pnl, unrealized_pnl)) AS actual_pnl FROM v_store GROUP BY model_group""", "selected_risk selected_pnl filled_entry_pnl filled_actual_pnl unfilled_pnl actual_pnl", 5)
def a30(spark, sf):
    live = store(spark, sf).withColumns({"sleeve": F.col("model_group"), "won": F.col("correct") == 1, "avg_entry": F.col("entry") + 0.01})
    return reports.whole_chain(live, attempts(spark, sf)).select("sleeve", "selected_rows", "filled_rows", "selected_risk", "selected_pnl", "filled_entry_pnl", "filled_actual_pnl", "unfilled_pnl", "actual_pnl")


@query("a52_exposure_rollup", f"""WITH {STORE_SQL}, b AS (SELECT *, CASE WHEN position_id % 4 <> 0 THEN fair - 0.02 END AS bid, cost / entry AS shares FROM v_store WHERE cost > 0)
  SELECT policy, count(*) AS positions, sum(cost) AS cost, sum(cost * entry) / sum(cost) AS weighted_entry, sum(cost * fair) / sum(cost) AS weighted_fair, sum(cost * edge) / sum(cost) AS weighted_edge, count(bid) AS marked, count(*) - count(bid) AS missing_marks, min(bid) AS min_bid, max(bid) AS max_bid, sum(shares * bid - cost) AS mark_pnl FROM b GROUP BY policy""",
       "cost weighted_entry weighted_fair weighted_edge min_bid max_bid mark_pnl")
def a52(spark, sf):
    df = store(spark, sf).where("cost > 0").withColumns({"bid": F.when(F.col("position_id") % 4 != 0, F.col("fair") - 0.02), "shares": F.col("cost") / F.col("entry")})
    return reports.exposure_rollup(df, ["policy"])


@query("a43_status_overview", f"""WITH {SIGNAL_SQL}, d AS (SELECT max(market_date) AS day FROM v_signal), t AS (SELECT station, count(*) AS snapshots, max(cost) AS current_temp, max(book_age) AS max_age FROM v_signal, d WHERE market_date = day GROUP BY station),
  m AS (SELECT station, count(*) AS markets, count(*) FILTER (WHERE correct IS NOT NULL) AS tokenized, min(entry) AS min_low, max(fair) AS max_bucket FROM v_signal, d WHERE market_date = day AND model_name = 'm1' GROUP BY station)
  SELECT t.station, snapshots, current_temp, max_age, coalesce(markets, 0) AS markets, coalesce(tokenized, 0) AS tokenized, min_low, max_bucket FROM t LEFT JOIN m ON m.station = t.station""", "current_temp max_age min_low max_bucket")
def a43(spark, sf):
    df = signals(spark, sf)
    day = df.agg(F.max("market_date").alias("_day"))
    snaps = df.join(F.broadcast(day), F.lit(True)).withColumns({"current_temp": F.col("cost"), "high": F.col("cost")})
    markets = df.where("model_name = 'm1'").join(F.broadcast(day), F.lit(True)).select(
        "station", "market_date", "_day", F.when(F.col("correct").isNotNull(), "t").alias("yes_token"), F.lit("t").alias("no_token"), F.col("entry").alias("lower"), F.col("fair").alias("upper"))
    out = reports.status_overview(snaps, markets, F.col("_day"))
    return out.select("station", "snapshots", "current_temp", "max_age", F.coalesce("markets", F.lit(0)).alias("markets"), F.coalesce("tokenized", F.lit(0)).alias("tokenized"), "min_low", "max_bucket")


@query("a45_quote_health", f"""WITH {SIGNAL_SQL} SELECT (SELECT count(*) FROM v_signal WHERE model_name = 'm0') AS policy_candidates, count(*) AS quote_intents, count(DISTINCT station) AS candidates_with_quotes, count(DISTINCT strategy_bucket) AS unique_quote_specs, count(*) FILTER (WHERE edge > 0) AS would_post,
  count(*) FILTER (WHERE liquidity >= 50) AS useful_50, count(*) FILTER (WHERE liquidity >= 100) AS useful_100, count(DISTINCT CASE WHEN liquidity >= 50 THEN station END) AS candidates_with_50, count(DISTINCT CASE WHEN liquidity >= 100 THEN station END) AS candidates_with_100, max(liquidity) AS max_quote_size,
  count(correct) AS outcomes, count(DISTINCT CASE WHEN correct IS NOT NULL THEN station END) AS candidates_with_outcomes, 'candidates_without_quotes,unlabelled_quotes' AS failures FROM v_signal""", "max_quote_size")
def a45(spark, sf):
    df = signals(spark, sf)
    quotes = df.select(F.col("station").alias("candidate_id"), F.col("strategy_bucket").alias("quote_spec"), (F.col("edge") > 0).alias("would_post"), F.col("liquidity").alias("quote_size"))
    return reports.quote_health(df.where("model_name = 'm0'").withColumn("source_stage", F.lit("POLICY_CANDIDATE")), quotes, df.where("correct is not null").select(F.col("station").alias("candidate_id")))


# ---- decision cache ----

def _cache(spark, sf):
    df = signals(spark, sf).withColumns({"market_id": F.concat_ws(":", "station", "selected_bucket"), "reasons": F.array_compact(F.array(F.when(F.col("edge") < -0.5, "NEGATIVE_EDGE"))), "id": F.struct("id", "liquidity")})
    tokens = df.where("model_name <> 'm9'").select("market_id", F.when(F.col("selected_side") == "BUY_YES", "YES").otherwise("NO").alias("outcome")).distinct().where(
        "market_id not like 's7:%'").withColumn("token_id", F.concat_ws("#", "market_id", "outcome"))
    return replay.decision_cache(df, tokens, 900_000_000, 250_000)


CACHE_SQL = SIGNAL_SQL + """, v_map AS (SELECT *, CASE WHEN station = 's7' THEN 'TOKEN_NOT_CATALOGED' WHEN edge < -0.5 THEN 'SOURCE:NEGATIVE_EDGE' END AS rej, (station, selected_bucket, selected_side) AS tok, CAST(ceil(epoch_us(ts) / 900000000.0) AS BIGINT) AS rb FROM v_signal)"""


@query("p01_decision_cache", f"WITH {CACHE_SQL} SELECT coalesce(rej, 'OK') AS reason, count(*) AS mappings, count(DISTINCT (tok, rb)) AS decisions FROM v_map GROUP BY ALL")
def p01(spark, sf):
    return _cache(spark, sf).groupBy(F.coalesce("rejection_reason", F.lit("OK")).alias("reason")).agg(
        F.count(F.lit(1)).alias("mappings"), F.countDistinct("decision_id").alias("decisions"))


@query("a38_decision_grain", f"WITH {CACHE_SQL} SELECT count(*) AS model_rows, count(DISTINCT (tok, ts)) AS exact_decisions, count(DISTINCT (tok, rb)) AS bucketed_decisions, count(*) / count(DISTINCT (tok, rb)) AS reduction FROM v_map", "reduction")
def a38(spark, sf):
    return replay.decision_grain(_cache(spark, sf))


@query("p02_enrich_outcomes", f"""WITH {CACHE_SQL}, g AS (SELECT tok, rb, min((station, market_date, market_family, selected_bucket, selected_side)) AS lo, max((station, market_date, market_family, selected_bucket, selected_side)) AS hi, any_value(station) AS station, min(market_date) AS market_date, any_value(selected_bucket) AS selected_bucket, any_value(selected_side) AS selected_side FROM v_map GROUP BY tok, rb),
  o AS (SELECT station, market_date, 60 + max(cost) % 22 AS final FROM v_signal WHERE selected_side = 'BUY_YES' GROUP BY ALL) SELECT CASE WHEN lo <> hi THEN 'CONFLICT' WHEN final IS NULL THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS status, count(*) AS n FROM g LEFT JOIN o USING (station, market_date) GROUP BY ALL""")
def p02(spark, sf):
    maps = _cache(spark, sf)
    outcomes = signals(spark, sf).where("selected_side = 'BUY_YES'").groupBy("station", "market_date").agg((60 + F.max("cost") % 22).alias("final"))
    def score(df):
        won = buckets.bucket_won(F.col("final"), buckets.parse_bucket(F.col("selected_bucket")))
        return df.withColumn("label", F.when(F.col("selected_side") == "BUY_YES", won).otherwise(~won).cast("int"))
    return replay.enrich_outcomes(replay.decisions_of(maps), maps, outcomes, score).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---- discovery ----

def rule_rows(spark, sf):
    """Signals as executable decisions: each price cap has a sweep of fixed cost 25."""
    caps = [0.3, 0.6, 0.9]
    ask = F.col("entry")
    sweep = F.map_from_arrays(F.array(*[F.lit(f"{c:.8f}") for c in caps]), F.array(*[
        F.when(ask <= c, F.struct(F.lit(25.0).alias("cost"), (25.0 / ask).alias("shares"), ask.alias("vwap"))) for c in caps]))
    return signals(spark, sf).select(
        F.struct("id", "liquidity").alias("mapping_id"), F.col("id").alias("snapshot_id"), F.col("ts").alias("ready"), "station", "market_date", "market_family", F.col("model_name").alias("model_id"), "selected_side",
        F.col("obs_delay_bucket").alias("observation_delay_bucket"), F.date_format("ts", "HH:mm").alias("local_hhmm"), ask.alias("best_ask"), (F.col("book_age") / 1000).alias("spread"), F.col("edge").alias("edge_at_best"), F.col("correct").alias("label"), sweep.alias("sweeps"))


def grid(rows):
    return discovery.rule_grid(rows, ["ANY", "BUY_NO"], [None, "10m"], [("00:00", "24:00"), ("06:00", "12:00")], [(0.05, 0.3), (0.05, 0.6)], [0.0, 0.1], [None, 0.1])


RULE_SQL = SIGNAL_SQL + """, rules AS (SELECT m AS model_id, mf AS family, s AS side, coalesce(dl, '') AS delay, w.a AS w0, w.b AS w1, bb.v AS cap, e AS edge_min, coalesce(sp, -1) AS spread_max, 1 + (s <> 'ANY')::INT + (dl IS NOT NULL)::INT + (w.a <> '00:00')::INT + (e > 0)::INT + (sp IS NOT NULL)::INT AS complexity FROM (SELECT DISTINCT model_name AS m, market_family AS mf FROM v_signal) m, (VALUES ('ANY'), ('BUY_NO')) s(s), (VALUES (NULL), ('10m')) d(dl), (VALUES ('00:00', '24:00'), ('06:00', '12:00')) w(a, b), (VALUES (0.3), (0.6)) bb(v), (VALUES (0.0), (0.1)) e(e), (VALUES (NULL), (0.1)) sp(sp)),
  hits AS (SELECT r.*, v.* FROM v_signal v JOIN rules r ON v.model_name = r.model_id AND v.market_family = r.family AND (side = 'ANY' OR selected_side = side) AND (delay = '' OR obs_delay_bucket = delay) AND strftime(ts, '%H:%M') >= w0 AND strftime(ts, '%H:%M') < w1 AND v.entry >= 0.05 AND v.entry <= cap AND v.edge + 1e-12 >= edge_min AND (spread_max < 0 OR book_age / 1000 <= spread_max + 1e-12))"""
RK = "model_id, family, side, delay, w0, cap, edge_min, spread_max"
SHOWN_SQL = "model_id, family, side, delay, w0 AS local_start, CAST(cap AS DOUBLE) AS cap, CAST(edge_min AS DOUBLE) AS edge_min, CAST(spread_max AS DOUBLE) AS spread_max"


def shown(df, rules, *columns):
    """`df` with the parts of each rule in place of its id."""
    parts = rules.select("rule_id", "model_id", F.col("market_family").alias("family"), F.col("selected_side").alias("side"), F.coalesce("observation_delay_bucket", F.lit("")).alias("delay"), "local_start", F.col("entry_max").alias("cap"),
                         F.col("edge_minimum").alias("edge_min"), F.coalesce("spread_maximum", F.lit(-1.0)).alias("spread_max"), F.col("complexity").cast("long").alias("complexity"))
    return df.select("rule_id", *columns).join(parts, ["rule_id"]).drop("rule_id")


@query("j16_match_rules", f"WITH {RULE_SQL} SELECT {SHOWN_SQL}, complexity::BIGINT AS complexity, count(*) AS n, sum(entry) AS entry FROM hits GROUP BY ALL", "cap edge_min spread_max entry")
def j16(spark, sf):
    rows = rule_rows(spark, sf)
    rules = grid(rows)
    hits = discovery.match_rules(rows, rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum("best_ask").alias("entry"))
    return shown(hits, rules, "n", "entry")


@query("p04_rule_grid", f"WITH {RULE_SQL} SELECT model_id, family, complexity::BIGINT AS complexity, count(*) AS n FROM rules GROUP BY ALL")
def p04(spark, sf):
    return grid(rule_rows(spark, sf)).groupBy("model_id", F.col("market_family").alias("family"), F.col("complexity").cast("long").alias("complexity")).agg(F.count(F.lit(1)).alias("n"))


FOLD_SQL = RULE_SQL + """, dts AS (SELECT DISTINCT market_date FROM v_signal WHERE correct IS NOT NULL), ix AS (SELECT market_date, row_number() OVER (ORDER BY market_date) - 1 AS i, count(*) OVER () - 40 AS n FROM dts),
  fo AS (SELECT market_date, CASE WHEN i < n THEN least(i * 4 // n, 3) END AS fold FROM ix)"""
DAY_SQL = """{p}h AS (SELECT h.* EXCLUDE (market_date), h.market_date, fold, row_number() OVER (PARTITION BY {rk}, station, h.market_date ORDER BY ts, id, liquidity) AS rn FROM hits h JOIN fo ON fo.market_date = h.market_date WHERE correct IS NOT NULL AND {where}),
  {p}1 AS (SELECT *, row_number() OVER (PARTITION BY {rk}, market_date ORDER BY ts, id, liquidity) AS dn FROM {p}h WHERE rn = 1),
  {p}x AS (SELECT *, CASE WHEN correct = 1 THEN 25.0 / entry - 25 ELSE -25.0 END AS p1 FROM {p}1 WHERE dn <= 4),
  {p}d AS (SELECT {rk}, complexity, market_date, fold, count(*) AS trades, round(sum(25.0), 8) AS cost, round(sum(p1), 8) AS pnl, round(sum(p1) / sum(25.0), 8) AS rr, count(*) FILTER (WHERE correct = 1) AS wins FROM {p}x GROUP BY {rk}, complexity, market_date, fold)"""
SCORE_SQL = FOLD_SQL + ", " + DAY_SQL.format(p="f", rk=RK, where="fold IS NOT NULL") + f""",
  pf AS (SELECT {RK}, count(*) AS populated, count(*) FILTER (WHERE p > 0) AS positive FROM (SELECT {RK}, fold, sum(pnl) AS p FROM fd GROUP BY {RK}, fold) GROUP BY {RK}),
  tt AS (SELECT {RK}, complexity, sum(trades)::BIGINT AS trades, count(*) AS dates, round(sum(cost), 8) AS cost, round(sum(pnl), 8) AS pnl, avg(rr) AS mean_rr, round(avg(rr) - 1.645 * stddev_samp(rr) / sqrt(count(*)), 8) AS lcb FROM fd GROUP BY {RK}, complexity),
  sc AS (SELECT tt.*, populated, positive, round(lcb - 0.01 * complexity, 8) AS pl, positive / populated >= 2 / 3 AND dates >= 5 AND trades >= 10 AND pnl > 0 AS passes FROM tt JOIN pf USING ({RK})),
  best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model_id, family, side, cap ORDER BY pl DESC, pnl DESC, complexity) AS rn FROM sc WHERE passes) z WHERE rn = 1)"""


def _scored(rows, rules):
    return discovery.score_rules(rows, rules, 4, 40)


@query("p05_score_rules", f"WITH {SCORE_SQL} SELECT {SHOWN_SQL}, complexity::BIGINT AS complexity, trades, dates AS effective_dates, cost, pnl, pnl / cost AS rr, mean_rr AS mean_daily_rr, lcb AS lcb_daily_rr, populated AS populated_folds, positive AS positive_folds, pl AS penalized_lcb, passes FROM sc",
       "cap edge_min spread_max cost pnl rr mean_daily_rr lcb_daily_rr penalized_lcb", 5)
def p05(spark, sf):
    rows = rule_rows(spark, sf)
    rules = grid(rows)
    return shown(_scored(rows, rules), rules, "trades", "effective_dates", "cost", "pnl", "rr", "mean_daily_rr", "lcb_daily_rr", "populated_folds", "positive_folds", "penalized_lcb", "passes")


@query("k04_family_representatives", f"WITH {SCORE_SQL} SELECT model_id, family, side, CAST(cap AS DOUBLE) AS cap, pl AS penalized_lcb, pnl, complexity::BIGINT AS complexity FROM best", "cap penalized_lcb pnl", 4)
def k04(spark, sf):
    rows = rule_rows(spark, sf)
    rules = grid(rows)
    return shown(discovery.family_representatives(_scored(rows, rules)), rules, "penalized_lcb", "pnl").select("model_id", "family", "side", "cap", "penalized_lcb", "pnl", "complexity")


@query("p07_evaluate_holdout", f"""WITH {SCORE_SQL}, few AS (SELECT * FROM best ORDER BY pl DESC, pnl DESC, complexity LIMIT 12), {DAY_SQL.format(p="o", rk=RK, where="fold IS NULL")}
  SELECT {SHOWN_SQL}, any_value(o.complexity)::BIGINT AS complexity, sum(o.trades)::BIGINT AS trades, count(*) AS effective_dates, sum(o.cost) AS cost, sum(o.pnl) AS pnl, sum(o.pnl) / sum(o.cost) AS rr, CASE WHEN count(*) >= 2 THEN avg(rr) - 1.645 * stddev_samp(rr) / sqrt(count(*)) ELSE -1e9 END AS lcb_daily_rr
  FROM od o SEMI JOIN few USING ({RK}) GROUP BY {RK}""", "cap edge_min spread_max cost pnl rr lcb_daily_rr", 5)
def p07(spark, sf):
    rows = rule_rows(spark, sf)
    rules = grid(rows)
    reps = discovery.family_representatives(_scored(rows, rules), 12)
    return shown(discovery.evaluate_holdout(rows, rules, reps, 4, 40), rules, "trades", "effective_dates", "cost", "pnl", "rr", "lcb_daily_rr")


@query("p09_discover_executed_folds", f"""WITH {FOLD_SQL}, {DAY_SQL.format(p="c", rk=RK, where="fold IS NOT NULL")}, own AS (SELECT * EXCLUDE (fold), least((row_number() OVER w - 1) * 4 // count(*) OVER (PARTITION BY {RK}), 3) AS fold FROM cd WINDOW w AS (PARTITION BY {RK} ORDER BY market_date)),
  pf AS (SELECT {RK}, count(*) AS populated, count(*) FILTER (WHERE p > 0) AS positive FROM (SELECT {RK}, fold, round(sum(pnl), 6) AS p FROM own GROUP BY {RK}, fold) z GROUP BY {RK}),
  tt AS (SELECT {RK}, complexity, sum(trades)::BIGINT AS trades, count(*) AS effective_dates, round(sum(pnl), 6) AS pnl, round(sum(pnl) / sum(cost), 6) AS rr, sum(wins)::BIGINT AS wins FROM own GROUP BY {RK}, complexity),
  z AS (SELECT tt.*, populated, positive, round(rr - 0.01 * complexity, 6) AS prr, positive / populated >= 2 / 3 AND effective_dates >= 5 AND trades >= 10 AND pnl > 0 AS passes FROM tt JOIN pf USING ({RK})),
  fa AS (SELECT *, row_number() OVER (PARTITION BY model_id, family, side, cap ORDER BY passes DESC, prr DESC, complexity) AS rn FROM z)
  SELECT {SHOWN_SQL}, complexity::BIGINT AS complexity, trades, effective_dates, pnl, rr, wins, populated AS populated_folds, positive AS positive_folds, prr AS penalized_rr FROM fa WHERE rn = 1 AND passes ORDER BY prr DESC, complexity LIMIT 20""", "cap edge_min spread_max pnl rr penalized_rr", 4)
def p09(spark, sf):
    rows = rule_rows(spark, sf)
    rules = grid(rows)
    chosen = discovery.nominations(discovery.score_compatible(rows, rules, 4, 40), 20)
    return shown(chosen, rules, "trades", "effective_dates", "pnl", "rr", "wins", "populated_folds", "positive_folds", "penalized_rr")


@query("f13_collapse_equivalent", f"""WITH {RULE_SQL}, fp AS (SELECT {RK}, complexity, count(*) AS matched_rows, bit_xor(hash(id, liquidity)) AS a, bit_xor(md5_number_lower(id || ':' || liquidity)) AS b FROM hits GROUP BY ALL)
  SELECT any_value(model_id) AS model_id, any_value(family) AS family, CAST(cap AS DOUBLE) AS cap, min(complexity)::BIGINT AS complexity, matched_rows FROM fp GROUP BY matched_rows, a, b, cap""", "cap")
def f13(spark, sf):
    rows = rule_rows(spark, sf)
    kept = discovery.collapse_equivalent(rows, grid(rows), ["entry_max"])
    return kept.select("model_id", F.col("market_family").alias("family"), F.col("entry_max").alias("cap"), F.col("complexity").cast("long").alias("complexity"), "matched_rows")


# ---- baskets ----

def baskets_in(spark, sf, n_candidates=5):
    """Signals as snapshots with a short candidate ladder around their own bucket."""
    lo = 60 + F.col("minute_of_day") % 20
    cand = F.array(*[F.struct(
        F.concat((lo + i).cast("string"), F.lit("-"), (lo + i + 1).cast("string"), F.lit("F")).alias("bucket"), (F.pmod(F.col("fair") * 10 + i * 3, F.lit(10.0)) / 25).alias("fair_yes"),
        (F.pmod(F.col("entry") * 10 + i * 7, F.lit(10.0)) / 20).alias("yes_ask"), F.coalesce(60 + F.col("cost") % 22 == lo + i, F.lit(False)).alias("won")) for i in range(n_candidates)])
    return signals(spark, sf).select(F.struct("id", "liquidity").alias("snapshot_id"), "id", "liquidity", "ts", "station", "market_date", "model_name", "obs_delay_bucket", cand.alias("candidates"))


BASKET_SQL = SIGNAL_SQL + """, v_cand AS (SELECT id, liquidity, ts, station, market_date, model_name, i, concat(60 + minute_of_day % 20 + i, '-', 61 + minute_of_day % 20 + i, 'F') AS bucket, fmod(fair * 10 + i * 3, 10.0) / 25 AS fair_yes, fmod(entry * 10 + i * 7, 10.0) / 20 AS yes_ask, 60 + cost % 22 = 60 + minute_of_day % 20 + i AS won FROM v_signal, (SELECT unnest(range(0, 5)) AS i)),
  v_rank AS (SELECT *, row_number() OVER (PARTITION BY id, liquidity ORDER BY fair_yes DESC, yes_ask, bucket) AS rk FROM v_cand WHERE fair_yes >= 0 AND yes_ask > 0 AND yes_ask < 1),
  v_basket AS (SELECT id, liquidity, ts, station, market_date, model_name, sum(yes_ask) AS ask_sum, sum(fair_yes) AS fair_mass, sum(fair_yes) - sum(yes_ask) AS basket_edge, bool_or(won) AS hit FROM v_rank WHERE rk <= 3 GROUP BY ALL HAVING count(*) = 3)"""


@query("k01_top_n_basket", f"WITH {BASKET_SQL} SELECT station, count(*) AS n, sum(ask_sum) AS ask_sum, sum(fair_mass) AS fair_mass, count(*) FILTER (WHERE hit) AS hits FROM v_basket GROUP BY station", "ask_sum fair_mass", 4)
def k01(spark, sf):
    return replay.top_n_basket(baskets_in(spark, sf), 3).groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.sum("ask_sum").alias("ask_sum"), F.sum("fair_mass").alias("fair_mass"), F.sum(F.col("hit").cast("int")).alias("hits"))


@query("k02_select_baskets", f"""WITH {BASKET_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY model_name, station, market_date ORDER BY ts, id, liquidity) AS rn FROM v_basket), p AS (SELECT *, CASE WHEN hit THEN 1.0 ELSE 0 END - ask_sum AS pnl FROM s WHERE rn = 1)
  SELECT model_name, count(*) AS n, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) AS hit_rate, sum(ask_sum) AS risk, sum(pnl) AS pnl, sum(pnl) / sum(ask_sum) AS rr, avg(pnl) / stddev_pop(pnl) AS sharpe, avg(fair_mass) AS avg_fair_mass, avg(basket_edge) AS avg_edge FROM p GROUP BY model_name""", "hit_rate risk pnl rr sharpe avg_fair_mass avg_edge", 4)
def k02(spark, sf):
    chosen = replay.select_baskets(replay.top_n_basket(baskets_in(spark, sf), 3), "first_eligible", ["model_name", "station", "market_date"])
    return replay.basket_summary(chosen, ["model_name"])


@query("p19_basket_grid", f"""WITH {BASKET_SQL}, g AS (SELECT b.*, e AS edge_min, a AS ask_max, row_number() OVER (PARTITION BY e, a, model_name, station, market_date ORDER BY ts, id, liquidity) AS rn FROM v_basket b, (VALUES (-0.5), (0.0)) x(e), (VALUES (0.5), (0.8)) y(a) WHERE basket_edge >= e AND ask_sum <= a)
  SELECT CAST(edge_min AS DOUBLE) AS edge_min, CAST(ask_max AS DOUBLE) AS ask_max, count(*) AS n, sum(ask_sum) AS risk, sum(CASE WHEN hit THEN 1.0 ELSE 0 END - ask_sum) AS pnl FROM g WHERE rn = 1 GROUP BY ALL""", "edge_min ask_max risk pnl", 4)
def p19(spark, sf):
    out = replay.basket_grid(replay.top_n_basket(baskets_in(spark, sf), 3), ["model_name", "station", "market_date"], [-0.5, 0.0], [0.5, 0.8])
    return out.select("edge_min", "ask_max", "n", "risk", "pnl")


@query("k03_consensus_ladder", f"""WITH {BASKET_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY station, market_date, bucket, model_name ORDER BY ts DESC, id DESC, liquidity DESC) AS rn FROM v_cand WHERE model_name IN ('m0', 'm1'))
  SELECT station, market_date, bucket, avg(fair_yes) AS fair_yes, arg_max(yes_ask, (ts, id, liquidity)) AS yes_ask FROM l WHERE rn = 1 GROUP BY ALL HAVING count(*) = 2""", "fair_yes yes_ask", dates="market_date")
def k03(spark, sf):
    rows = baskets_in(spark, sf).select("*", F.explode("candidates").alias("c")).select("station", "market_date", "model_name", "ts", "snapshot_id", "c.*")
    return replay.consensus_ladder(rows, ["station", "market_date"], ["m0", "m1"])


@query("j22_bucket_examples", f"""WITH {BASKET_SQL}, w AS (SELECT id, liquidity FROM v_cand GROUP BY ALL HAVING count(*) FILTER (WHERE won) = 1) SELECT model_name, count(*) AS n, count(*) FILTER (WHERE won) AS winners, sum(fair_yes) AS fair FROM v_cand c JOIN w ON w.id = c.id AND w.liquidity = c.liquidity GROUP BY model_name""", "fair", 4)
def j22(spark, sf):
    return replay.bucket_examples(baskets_in(spark, sf)).groupBy("model_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("won").cast("int")).alias("winners"), F.sum("fair_yes").alias("fair"))


# ---- forward evaluation and caps ----

def forward_rows(spark, sf):
    asks = F.array(*[F.struct((F.col("entry") + d).alias("price"), (F.col("cost") * (1 + i)).alias("size")) for i, d in enumerate((0.0, 0.02, 0.05))])
    return signals(spark, sf).select(F.struct("id", "liquidity").alias("row_id"), "ts", "station", "market_date", "market_family", F.col("model_name").alias("model_id"), "selected_side", "edge", F.col("entry").alias("best_ask"), F.col("correct").alias("label"),
                                     (F.col("book_age") >= 147).alias("disagreement"), "liquidity", asks.alias("asks"))


CANDIDATE = """
concat(model_name, ':', market_family) AS candidate_id
| concat(market_family, CASE WHEN model_name IN ('m0', 'm1') THEN ':f0' ELSE ':f1' END) AS family_id
| model_name AS model_id
| market_family
| CASE WHEN model_name IN ('m1', 'm3') THEN 'ANY' ELSE 'BUY_NO' END AS side
| CAST(0.05 AS DOUBLE) AS entry_min
| CAST(0.6 AS DOUBLE) AS entry_max
| CAST(0.0 AS DOUBLE) AS edge_min
| CAST(CASE WHEN model_name IN ('m0', 'm2') THEN 1 ELSE 2 END AS INT) AS complexity
| CASE WHEN model_name = 'm3' AND market_family = 'LOW_TEMP' THEN 'taker_v0' ELSE 'taker_v1' END AS execution_version
| CAST(CASE WHEN model_name = 'm1' THEN 0.4 END AS DOUBLE) AS price_cap
| CAST(CASE WHEN model_name = 'm3' THEN 50.0 END AS DOUBLE) AS target
| CAST(CASE WHEN model_name = 'm2' THEN 60.0 END AS DOUBLE) AS daily_cap
| CAST(CASE WHEN model_name = 'm3' THEN 30.0 END AS DOUBLE) AS station_date_cap
| CAST(CASE WHEN model_name = 'm2' AND market_family = 'LOW_TEMP' THEN '2020-01-01' ELSE '1996-06-01' END AS TIMESTAMP) AS activated_at
"""
CANDIDATE_COLUMNS = [c.strip() for c in CANDIDATE.strip().split("\n|")]
CANDIDATE_SQL = "cand AS (SELECT " + ", ".join(CANDIDATE_COLUMNS).replace("AS INT)", "AS INTEGER)") + " FROM (SELECT DISTINCT model_name, market_family FROM v_signal) c)"


def candidates(spark, sf):
    """One candidate for each model and family of the signals, some with sizes and caps of their own."""
    return signals(spark, sf).select("model_name", "market_family").distinct().selectExpr(*CANDIDATE_COLUMNS)


@query("p11_forward_scorecards")
def p11(spark, sf):
    return replay.forward_scorecards(forward_rows(spark, sf), candidates(spark, sf), 25.0, 100.0, 5, 20)


SWEEPS = [(c, t) for c in (0.4, 0.6) for t in (25.0, 50.0)]


@query("p21_evaluate_candidates", f"""WITH {SIGNAL_SQL}, {CANDIDATE_SQL}, own AS (SELECT * REPLACE (coalesce(price_cap, entry_max) AS price_cap, coalesce(target, 25.0) AS target, coalesce(daily_cap, 100.0) AS daily_cap, coalesce(station_date_cap, 150.0) AS station_date_cap), execution_version = 'taker_v1' AS counts FROM cand),
  m AS (SELECT o.*, s.station, s.market_date, s.ts, s.id, s.liquidity, s.minute_of_day, s.entry, s.correct, s.ts >= o.activated_at AS since FROM v_signal s JOIN own o ON o.model_id = s.model_name AND o.market_family = s.market_family AND (side = 'ANY' OR selected_side = side) AND edge >= edge_min AND entry >= entry_min AND entry <= entry_max WHERE correct IS NOT NULL),
  seen AS (SELECT candidate_id, count(*) FILTER (WHERE NOT since) AS rows_before, count(*) FILTER (WHERE since AND counts) AS rows_since FROM m GROUP BY ALL),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, station, market_date ORDER BY ts, id, liquidity) AS rn FROM m WHERE since AND counts) z WHERE rn = 1),
  x AS (SELECT *, CASE WHEN entry <= price_cap THEN greatest(least(target, liquidity - 8), 0) ELSE 0 END AS c, CASE WHEN minute_of_day % 11 = 0 THEN 'EXECUTION_SUMMARY_UNAVAILABLE' WHEN entry > price_cap OR liquidity <= 8 THEN 'NO_CAPPED_EXECUTABLE_ASK' END AS known FROM f),
  g AS (SELECT candidate_id, market_date, daily_cap, station_date_cap, list({{'k': known, 'c': c, 'p': CASE WHEN correct = 1 THEN c / entry - c ELSE -c END}} ORDER BY ts, id, liquidity) AS t FROM x GROUP BY ALL),
  h AS (SELECT candidate_id, market_date, unnest(list_reduce(t, lambda a, r: {{'u': a.u + CASE WHEN r.k IS NULL AND a.u + r.c <= daily_cap + 1e-9 AND r.c <= station_date_cap + 1e-9 THEN r.c ELSE 0 END,
      't': list_append(a.t, {{'k': CASE WHEN r.k IS NOT NULL THEN r.k WHEN a.u + r.c > daily_cap + 1e-9 THEN 'DAILY_RISK_CAP' WHEN r.c > station_date_cap + 1e-9 THEN 'STATION_DATE_CAP' END, 'c': r.c, 'p': r.p}})}}, {{'u': CAST(0 AS DOUBLE), 't': CAST([] AS STRUCT(k VARCHAR, c DOUBLE, p DOUBLE)[])}}).t) AS r FROM g),
  sc AS (SELECT candidate_id, count(*) FILTER (WHERE r.k IS NULL) AS executed, count(DISTINCT CASE WHEN r.k IS NULL THEN market_date END) AS dates, sum(CASE WHEN r.k IS NULL THEN r.c END) AS cost, sum(CASE WHEN r.k IS NULL THEN r.p END) AS pnl,
    {', '.join(f"count(*) FILTER (WHERE r.k = '{x}') AS {x.lower()}" for x in replay.REJECTIONS)} FROM h GROUP BY candidate_id)
  SELECT own.candidate_id, family_id, coalesce(rows_before, 0) AS rows_before, coalesce(rows_since, 0) AS rows_since, coalesce(executed, 0) AS executed, coalesce(dates, 0) AS dates, cost, pnl, pnl / cost AS rr, {', '.join(f"coalesce(sc.{x.lower()}, 0) AS {x.lower()}" for x in replay.REJECTIONS)},
    concat(CASE WHEN counts THEN '' ELSE 'EXECUTION_VERSION_MISMATCH,' END, 'MARKOUTS_UNAVAILABLE,', CASE WHEN coalesce(rows_since, 0) = 0 THEN 'NO_POST_ACTIVATION_MATCHING_DECISIONS,' ELSE '' END, 'VENUE_SETTLEMENT_UNAVAILABLE') AS blockers, 'CONTINUE_COLLECTING' AS disposition
  FROM own LEFT JOIN seen USING (candidate_id) LEFT JOIN sc USING (candidate_id)""", "cost pnl rr", 4)
def p21(spark, sf):
    def sweep(cap, target):
        cost = F.when(F.col("entry") <= cap, F.greatest(F.least(F.lit(target), F.col("liquidity") - 8), F.lit(0.0))).otherwise(0.0)
        return F.struct(cost.alias("cost"), (cost / F.col("entry")).alias("shares"), F.when(cost > 0, F.col("entry")).alias("vwap"))

    stored = F.create_map(*[v for c, t in SWEEPS for v in (F.lit(f"cap={c:.8f}|target={t:.8f}"), sweep(c, t))])
    rows = signals(spark, sf).where("correct IS NOT NULL").withColumn("sweeps", F.when(F.col("minute_of_day") % 11 > 0, stored).otherwise(F.create_map().cast("map<string,struct<cost:double,shares:double,vwap:double>>")))
    rows = rows.select(F.struct("id", "liquidity").alias("row_id"), "ts", "station", "market_date", "market_family", F.col("model_name").alias("model_id"), "selected_side", "edge", F.col("entry").alias("best_ask"), F.col("correct").alias("label"), "sweeps")
    return replay.evaluate_candidates(rows, candidates(spark, sf), replay.ForwardDefaults("taker_v1"))


def capped(spark, sf, model):
    return signals(spark, sf).where(F.col("model_name") == model).select("market_date", "station", "ts", "id", "liquidity", "cost", (F.col("cost") / F.col("entry")).alias("shares"), F.lit(1.0).alias("fill_fraction"))


@query("p12_incremental_after_peer", f"""WITH {SIGNAL_SQL}, s AS (SELECT * FROM v_signal WHERE model_name = 'm0'), ps AS (SELECT market_date, station, sum(cost) AS c FROM v_signal WHERE model_name = 'm1' GROUP BY ALL), pd AS (SELECT market_date, sum(cost) AS c FROM v_signal WHERE model_name = 'm1' GROUP BY ALL),
  a AS (SELECT s.*, least(s.cost, greatest(100 - coalesce(ps.c, 0) - coalesce(sum(s.cost) OVER (PARTITION BY s.market_date, s.station ORDER BY ts, id, liquidity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS c1, coalesce(pd.c, 0) AS day_used FROM s LEFT JOIN ps ON ps.market_date = s.market_date AND ps.station = s.station LEFT JOIN pd ON pd.market_date = s.market_date),
  b AS (SELECT *, least(c1, greatest(2000 - day_used - coalesce(sum(c1) OVER (PARTITION BY market_date ORDER BY ts, id, liquidity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS adm FROM a)
  SELECT station, count(*) AS n, sum(adm) AS cost, sum(cost / entry * (adm / cost)) AS shares FROM b WHERE adm > 0 GROUP BY station""", "cost shares", 4)
def p12(spark, sf):
    out = replay.incremental_after_peer(capped(spark, sf, "m0"), capped(spark, sf, "m1"), 100.0, 2000.0, scan.day_slice(F.col("ts")), ORDER)
    return out.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), F.sum("shares").alias("shares"))


@query("p13_shared_caps", f"""WITH {SIGNAL_SQL}, g AS (SELECT market_date, list({{'a': CAST(model_name[2:] AS INTEGER), 's': station, 'c': CAST(cost AS DOUBLE)}} ORDER BY model_name, ts, id, liquidity) AS t FROM v_signal GROUP BY ALL),
  h AS (SELECT unnest(list_reduce(t, lambda acc, r: {{'t': list_append(acc.t, {{'a': r.a, 's': r.s, 'c': r.c, 'k': CASE WHEN acc.d + r.c > 400 + 1e-9 THEN 'SHARED_DAILY_RISK_CAP' WHEN list_sum(list_append(list_transform(list_filter(acc.t, lambda q: q.k = 'TAKEN' AND q.s = r.s), lambda q: q.c), r.c)) > 60 + 1e-9 THEN 'SHARED_STATION_DATE_CAP' ELSE 'TAKEN' END}}),
      'd': acc.d + CASE WHEN acc.d + r.c > 400 + 1e-9 OR list_sum(list_append(list_transform(list_filter(acc.t, lambda q: q.k = 'TAKEN' AND q.s = r.s), lambda q: q.c), r.c)) > 60 + 1e-9 THEN 0 ELSE r.c END}}, {{'t': CAST([] AS STRUCT(a INTEGER, s VARCHAR, c DOUBLE, k VARCHAR)[]), 'd': CAST(0 AS DOUBLE)}}).t) AS r FROM g)
  SELECT r.a AS activation_rank, r.k AS reason, count(*) AS n, sum(r.c) AS cost FROM h GROUP BY ALL""", "cost")
def p13(spark, sf):
    rows = signals(spark, sf).select(F.substring("model_name", 2, 1).cast("int").alias("activation_rank"), "market_date", "station", "ts", F.struct("id", "liquidity").alias("row_id"), "cost")
    return replay.shared_caps(rows, 400.0, 60.0).groupBy("activation_rank", F.coalesce("cap_reason", F.lit("TAKEN")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))


def _room(limit, *same):
    test = " AND ".join(["TRUE", *[f"q.{k} = r.{k}" for k in same]])
    return f"({limit} - list_sum(list_append(list_transform(list_filter(acc, lambda q: {test}), lambda q: q.z), 0.0)))"


ROOM = f"greatest(0, least({_room(500.0)}, {_room(150.0, 'f', 's')}, {_room(120.0, 'f', 's', 'd')}, {_room(80.0, 'f', 's', 'd', 'b')}))"


@query("p14_portfolio_replay", f"""WITH {SIGNAL_SQL}, w AS (SELECT *, CASE WHEN minute_of_day % 10 = 0 THEN 0.0 ELSE liquidity END AS depth FROM v_signal), g AS (SELECT market_date, list({{'m': model_name, 'f': market_family, 's': station, 'b': selected_bucket, 'd': selected_side, 'e': entry, 'p': pnl, 'y': CAST(depth AS DOUBLE), 'w': CAST(least(25.0, 50.0, depth) AS DOUBLE), 'z': CAST(0 AS DOUBLE), 'r': CAST(0 AS DOUBLE)}} ORDER BY model_name, ts, id, liquidity) AS t FROM w WHERE entry > 0 AND pnl IS NOT NULL GROUP BY ALL),
  h AS (SELECT unnest(list_reduce(t, lambda acc, r: list_append(acc, {{'m': r.m, 'f': r.f, 's': r.s, 'b': r.b, 'd': r.d, 'e': r.e, 'p': r.p, 'y': r.y, 'w': r.w, 'z': CASE WHEN least(r.w, {ROOM}) < 5 THEN CAST(0 AS DOUBLE) ELSE least(r.w, {ROOM}) END, 'r': CAST({ROOM} AS DOUBLE)}}),
      CAST([] AS STRUCT(m VARCHAR, f VARCHAR, s VARCHAR, b VARCHAR, d VARCHAR, e DOUBLE, p DOUBLE, y DOUBLE, w DOUBLE, z DOUBLE, r DOUBLE)[]))) AS r FROM g),
  c AS (SELECT model_name AS spec, count(*) AS rows FROM v_signal GROUP BY ALL)
  SELECT spec, any_value(rows) AS rows, count(*) AS candidate_rows, count(*) FILTER (WHERE r.z > 0) AS allocated_rows, sum(r.z) AS risk_usd, coalesce(sum(CASE WHEN r.z > 0 THEN r.p / r.e * r.z END), 0) AS pnl_usd, count(*) FILTER (WHERE r.z > 0 AND r.p > 0) AS wins,
    count(*) FILTER (WHERE r.z = 0 AND NOT (r.r > 0 AND r.y <= 0)) AS skipped_capacity_rows, count(*) FILTER (WHERE r.z = 0 AND r.r > 0 AND r.y <= 0) AS skipped_depth_rows, avg(CASE WHEN r.z > 0 THEN r.e END) AS avg_entry, avg(CASE WHEN r.z > 0 THEN r.y END) AS avg_depth
  FROM h JOIN c ON c.spec = r.m GROUP BY spec""", "risk_usd pnl_usd avg_entry avg_depth", 4)
def p14(spark, sf):
    depth = F.when(F.col("minute_of_day") % 10 == 0, F.lit(0.0)).otherwise(F.col("liquidity"))
    rows = signals(spark, sf).select(F.col("model_name").alias("spec"), F.substring("model_name", 2, 1).cast("int").alias("spec_rank"), "market_date", "market_family", "station", "selected_bucket", "selected_side", "ts",
                                     F.struct("id", "liquidity").alias("row_id"), F.lit(25.0).alias("target"), depth.alias("depth"), "entry", "pnl")
    return replay.portfolio_summary(rows, replay.portfolio_replay(rows, replay.PortfolioCaps()), ["spec"])


@query("p16_policy_positions", f"""WITH {SIGNAL_SQL}, x AS (SELECT 'a' AS policy, *, NULL AS bk, NULL AS sd FROM v_signal WHERE model_name = 'm1' AND strategy_bucket <> 'PROGRESS' AND entry >= 0.1 UNION ALL SELECT 'b', *, selected_bucket, selected_side FROM v_signal WHERE strategy_bucket = 'PROGRESS' AND edge >= 0.05),
  r AS (SELECT *, row_number() OVER (PARTITION BY policy, station, market_date, market_family, bk, sd ORDER BY {SQL_ORDER}) AS rn FROM x) SELECT policy, count(*) AS n, sum(entry) AS entry, sum(pnl) AS pnl FROM r WHERE rn = 1 GROUP BY policy""", "entry pnl")
def p16(spark, sf):
    specs = [policies.PolicySpec("a", "model", model="m1", entry=(0.1, None)), policies.PolicySpec("b", "progress", edge=(0.05, None), scope="station_date_bucket_side")]
    out = policies.policy_positions(signals(spark, sf), specs, ["ts", "id", "liquidity"])
    return out.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.sum("entry").alias("entry"), F.sum("pnl").alias("pnl"))


@query("p23_phase1_replay", f"""WITH {SIGNAL_SQL}, f AS (SELECT *, least(1.0, fair + 0.05) AS other, id % 5 AS cancels, id % 9 AS trades FROM v_signal WHERE market_family = 'HIGH_TEMP' AND selected_side = 'BUY_NO'),
  r AS (SELECT *, round_even((fair + other) / 2, 4) AS raw, sqrt(((fair - (fair + other) / 2) ** 2 + (other - (fair + other) / 2) ** 2) / 2) AS gap FROM f), c AS (SELECT *, round_even(least(0.95, greatest(0.05, raw)), 4) AS cal FROM r),
  h AS (SELECT *, cal - round_even(0.03 + least(0.06, gap) + greatest(0.0, least(0.08, raw - cal)) + CASE WHEN id % 11 = 0 THEN 0.03 ELSE 0 END, 4) - round_even(0.02 + least(0.04, greatest(0.0, book_age / 1000) * 0.5) + least(0.03, cancels * 0.005) + least(0.02, trades * 0.002), 4) AS net FROM c),
  q AS (SELECT *, round(floor(greatest(0.0, net) / 0.01 + 1e-12) * 0.01, 10) AS quote FROM h), o AS (SELECT *, row_number() OVER (PARTITION BY station, market_date, market_family, selected_bucket, selected_side ORDER BY {SQL_ORDER}) AS rn FROM q WHERE quote > 0)
  SELECT station, count(*) AS n, sum(CASE WHEN correct = 1 THEN 1 - quote WHEN correct = 0 THEN -quote END) AS pnl, sum(quote) AS quotes FROM o WHERE rn = 1 GROUP BY station""", "pnl quotes", 4)
def p23(spark, sf):
    rows = signals(spark, sf).withColumns({
        "model_fairs": F.create_map(F.lit("a"), F.col("fair"), F.lit("b"), F.least(F.lit(1.0), F.col("fair") + 0.05)), "spread": F.col("book_age") / 1000, "just_depleted": F.lit(False),
        "cancels_5m": (F.col("id") % 5), "trades_5m": (F.col("id") % 9), "blocked_calibration": F.col("id") % 11 == 0})
    out = pricing.phase1_replay(rows, ORDER)
    return out.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.sum("quote_pnl").alias("pnl"), F.sum("max_quote").alias("quotes"))


@query("p20_v2_dataset", f"""WITH {SIGNAL_SQL}, f AS (SELECT 'fit' AS role, id, correct, edge, book_age FROM v_signal UNION ALL SELECT 'evaluation', id, correct, edge, book_age FROM (SELECT *, row_number() OVER (PARTITION BY station, market_date ORDER BY {SQL_ORDER}) AS rn FROM v_signal WHERE model_name = 'm2') WHERE rn = 1)
  SELECT role, CASE WHEN book_age > 120 THEN 'STALE_MARKET_REFERENCE' ELSE 'MIDPOINT' END AS reference, CASE WHEN correct IS NULL THEN 'UNRESOLVED' ELSE '' END AS exclusion, count(*) AS n FROM f GROUP BY ALL""")
def p20(spark, sf):
    df = signals(spark, sf).withColumns({"ready_ts": F.col("ts"), "book_ts": F.lit(None).cast("timestamp"), "best_bid": F.col("entry") - 0.02, "best_ask": F.col("entry")})
    out = pricing.v2_dataset(df, F.col("model_name") == "m2", ["station", "market_date"], ORDER, 120.0)
    return out.groupBy("role", F.coalesce("reference.flag", "reference.kind").alias("reference"), F.coalesce("exclusion", F.lit("")).alias("exclusion")).agg(F.count(F.lit(1)).alias("n"))


@query("x22_bucket_from_survival", f"""WITH {SIGNAL_SQL}, b AS (SELECT *, {BOUND_SQL}, 58 + cost % 24 AS hi FROM v_signal), r AS (SELECT *, CASE WHEN lower IS NOT NULL AND upper IS NOT NULL THEN CASE WHEN hi > upper THEN 0 WHEN hi >= lower THEN 1 - fair / 2 ELSE greatest(0, fair - fair / 2) END WHEN lower IS NOT NULL THEN CASE WHEN hi >= lower THEN 1 ELSE fair END WHEN hi > upper THEN 0 ELSE 1 - fair / 2 END AS p FROM b)
  SELECT station, sum(p) AS mass FROM r GROUP BY station""", "mass")
def x22(spark, sf):
    df = signals(spark, sf).withColumn("_b", buckets.parse_bucket(F.col("selected_bucket")))
    p = pricing.bucket_from_survival(F.col("_b.lower"), F.col("_b.upper"), F.col("fair"), F.col("fair") / 2, 58 + F.col("cost") % 24)
    return df.groupBy("station").agg(F.sum(p["p"]).alias("mass"))


@query("x18_price_sheet", f"""WITH {SIGNAL_SQL}, s AS (SELECT *, least(greatest(fair - 0.1, 0), 1) AS c FROM v_signal), q AS (SELECT *, round(floor(greatest(c - 0.03, 0) / 0.01 + 1e-12) * 0.01, 10) AS mq FROM s)
  SELECT station, count(*) FILTER (WHERE book_age <= 120 AND mq >= 0.01) AS eligible, sum(CASE WHEN book_age <= 120 AND mq >= 0.01 THEN mq END) AS quotes FROM q GROUP BY station""", "quotes")
def x18(spark, sf):
    df = signals(spark, sf).withColumns({"calibrated": F.col("fair"), "reserve": F.lit(0.1), "prior_dates": F.lit(9), "reference_kind": F.lit("MIDPOINT"), "reference_stale": F.col("book_age") > 120, "calibrator_selected": F.lit(True)})
    out = pricing.price_sheet(df)
    return out.groupBy("station").agg(F.sum(F.col("eligible").cast("int")).alias("eligible"), F.sum("maximum_quote").alias("quotes"))


# a strategy name for each signal, so that every kind of stake occurs
STAKE_SQL = """CASE WHEN minute_of_day % 10 = 0 THEN 'moonshot' WHEN minute_of_day % 3 = 0 THEN 'consensus_pair' ELSE 'core' END"""


@query("x23_size_candidates", f"""WITH {SIGNAL_SQL}, u AS (SELECT station, market_date, selected_side, sum(cost) / 2 AS used FROM v_signal GROUP BY ALL), n AS (SELECT *, {STAKE_SQL} AS strategy_name, CASE WHEN minute_of_day % 7 = 0 THEN NULL ELSE liquidity - 8 END AS depth FROM v_signal),
  r AS (SELECT n.*, used, CASE WHEN strategy_name = 'moonshot' THEN 2.0 ELSE 25 * CASE WHEN entry < 0.1 THEN 0.25 WHEN entry < 0.25 THEN 0.6 WHEN entry <= 0.75 THEN 1.0 ELSE 0.6 END * CASE WHEN strategy_name = 'consensus_pair' THEN 0.6 ELSE 1.0 END END * CASE WHEN strategy_name = 'consensus_pair' AND n.selected_side = 'BUY_YES' THEN 0.5 ELSE 1.0 END AS want
    FROM n JOIN u ON u.station = n.station AND u.market_date = n.market_date AND u.selected_side = n.selected_side),
  z AS (SELECT *, floor((greatest(least(want, 100, 150 - used, 120 - used, 80, CASE WHEN depth IS NULL THEN 1e18 ELSE greatest(depth, 0) END), 0) + 1e-9) / 0.5) * 0.5 AS size FROM r),
  w AS (SELECT *, CASE WHEN 150 - used <= 0 THEN 'RISK_STATION_DATE_CAP' WHEN 120 - used <= 0 THEN 'RISK_STATION_DATE_SIDE_CAP' WHEN depth <= 0 THEN 'INSUFFICIENT_DEPTH' WHEN size < 1 AND depth < 1 THEN 'INSUFFICIENT_DEPTH' WHEN size < 1 THEN 'RISK_MIN_ORDER_NOTIONAL' END AS reason FROM z)
  SELECT station, strategy_name, reason AS blocked_reason, count(*) AS n, sum(want) AS target, sum(size) AS usd FROM w GROUP BY ALL""", "target usd")
def x23(spark, sf):
    df = signals(spark, sf)
    used = df.groupBy("station", "market_date", "selected_side").agg((F.sum("cost") / 2).alias("used_station_date")).withColumn("used_station_date_side", F.col("used_station_date"))
    rows = df.withColumns({"strategy_name": F.expr(STAKE_SQL), "depth": F.when(F.col("minute_of_day") % 7 != 0, F.col("liquidity") - 8)})
    out = pricing.size_candidates(rows, used, ["station", "market_date", "selected_side"])
    return out.groupBy("station", "strategy_name", "blocked_reason").agg(F.count(F.lit(1)).alias("n"), F.sum("target_usd").alias("target"), F.sum("size_usd").alias("usd"))


@query("j19_mark_to_latest", """WITH b AS (SELECT l_partkey % 50 AS tok, max((l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey) AS bid_id, arg_max(l_discount, ((l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey, l_extendedprice)) AS bid FROM lineitem GROUP BY ALL)
  SELECT c_mktsegment AS segment, count(*) AS n, count(bid) AS marked, sum(bid - 0.05) AS mark FROM customer LEFT JOIN b ON b.tok = c_custkey % 60 GROUP BY c_mktsegment""", "mark")
def j19(spark, sf):
    pos = table(spark, sf, "customer").selectExpr("c_mktsegment AS segment", "c_custkey AS market_id", "'BUY_YES' AS selected_side", "0.05D AS entry")
    markets = table(spark, sf, "customer").selectExpr("c_custkey AS market_id", "c_custkey % 60 AS yes_token", "-1L AS no_token")
    rows = table(spark, sf, "lineitem").selectExpr("l_partkey % 50 AS token_id", "struct((l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS a, l_extendedprice AS b) AS book_id", "l_discount AS best_bid")
    return replay.mark_to_latest(pos, markets, rows).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.count("bid").alias("marked"), F.sum("mark").alias("mark"))


@query("j20_active_candidates", """WITH e AS (SELECT o_custkey AS candidate_id, o_orderstatus AS to_role, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
  SELECT c_mktsegment AS segment, to_role, count(*) AS n FROM customer JOIN e ON candidate_id = c_custkey AND rn = 1 WHERE to_role IN ('F', 'O') GROUP BY ALL""")
def j20(spark, sf):
    events = table(spark, sf, "orders").selectExpr("o_custkey AS candidate_id", "o_orderstatus AS to_role", "o_orderdate AS at", "o_orderkey AS seq")
    versions = table(spark, sf, "customer").selectExpr("c_custkey AS candidate_id", "c_mktsegment AS segment")
    return replay.active_candidates(versions, events, ("F", "O")).groupBy("segment", "to_role").agg(F.count(F.lit(1)).alias("n"))


@query("k05_select_strategy", f"""WITH {SIGNAL_SQL}, e AS (SELECT *, 1 - fair AS fair_no, 1.02 - entry AS entry_no, round(entry - fair - 0.02, 4) AS edge_no FROM v_signal),
  s AS (SELECT *, edge >= edge_no AS yes, CASE WHEN edge >= edge_no THEN fair ELSE fair_no END AS f, CASE WHEN edge >= edge_no THEN edge ELSE edge_no END AS g, CASE WHEN edge >= edge_no THEN entry ELSE entry_no END AS ask FROM e),
  m AS (SELECT *, 'HIGH_CONVICTION' AS strategy, g AS rank FROM s WHERE f >= 0.75 AND g >= 0.10 UNION ALL SELECT *, 'TAIL', g FROM s WHERE f BETWEEN 0.08 AND 0.25 AND ask <= 0.10 AND f / ask >= 2.0 AND g >= 0.05 UNION ALL SELECT *, 'BEST_BUCKET', fair FROM s UNION ALL SELECT *, 'MAX_SO_FAR', 0.0 FROM s WHERE minute_of_day % 4 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY strategy, station, market_date ORDER BY rank DESC, selected_bucket, id, liquidity) AS rn FROM m)
  SELECT strategy, count(*) AS n, count(*) FILTER (WHERE yes) AS yes, sum(g) AS edge, sum(f) AS fair FROM r WHERE rn = 1 GROUP BY strategy""", "edge fair")
def k05(spark, sf):
    rows = signals(spark, sf).withColumns({"fair_no": 1 - F.col("fair"), "entry_no": 1.02 - F.col("entry"), "edge_no": F.round(F.col("entry") - F.col("fair") - 0.02, 4), "holds_progress": F.col("minute_of_day") % 4 == 0})
    out = None
    for name in replay.STRATEGIES:
        part = replay.select_strategy(rows, ["station", "market_date"], name, [F.col("selected_bucket"), F.col("id"), F.col("liquidity")]).groupBy(F.lit(name).alias("strategy")).agg(
            F.count(F.lit(1)).alias("n"), F.sum((F.col("best_side") == "BUY_YES").cast("int")).alias("yes"), F.sum("best_edge").alias("edge"), F.sum("best_fair").alias("fair"))
        out = part if out is None else out.unionByName(part)
    return out
