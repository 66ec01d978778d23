"""Store-level reports over positions, attempts, quotes and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators.metrics import ratio, sharpe

OPEN_STATES = ("RESERVED", "SUBMITTED", "FILLED", "PARTIAL", "DELAYED", "UNKNOWN")


def daily_sharpe(df: DataFrame, keys: list[str], pnl: str = "pnl", date: str = "market_date") -> DataFrame:
    """Mean over population deviation of summed daily PnL."""
    daily = df.where(F.col(pnl).isNotNull()).groupBy(*keys, date).agg(F.sum(pnl).alias("_p"))
    return daily.groupBy(*keys).agg(F.count(F.lit(1)).alias("dates"), sharpe(F.col("_p")).alias("daily_sharpe"))


def load_snapshots(snapshots: DataFrame, results: DataFrame, outcomes: DataFrame, start=None, end=None, family: str | None = None,
                   us_only: bool = False) -> DataFrame:
    """Snapshots with their results and outcomes, both optional per row; skipped rows are dropped.

    Date, family and station filters are plain predicates on the snapshot scan, so they are pushed down.
    """
    rows = snapshots.where((F.col("selected_side") != "SKIP") & F.col("selected_market_id").isNotNull())
    if start is not None:
        rows = rows.where(F.col("market_date") >= start)
    if end is not None:
        rows = rows.where(F.col("market_date") <= end)
    if family is not None:
        rows = rows.where(F.coalesce("market_family", F.lit("HIGH_TEMP")) == family)
    if us_only:
        rows = rows.where(F.col("station").startswith("K") & ~F.col("model_name").contains("international") & ~F.col("model_name").startswith("low_"))
    return rows.join(results, ["id"], "left").join(outcomes, ["station", "market_date"], "left")


def unresolved_groups(snapshots: DataFrame, outcomes: DataFrame) -> DataFrame:
    return snapshots.select("station", "market_date").distinct().join(
        outcomes.select("station", "market_date"), ["station", "market_date"], "left_anti")


def result_summary(results: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Scored, correct, win rate and averages per strategy and delay, with the delay's sort position."""
    rows = results.join(snapshots.select("id", "strategy_bucket"), ["id"], "left")
    place = F.coalesce(F.create_map(*[x for d, n in (("instant", 0), ("5m", 5), ("10m", 10), ("15m", 15), ("30m", 30))
                                      for x in (F.lit(d), F.lit(n))])[F.col("obs_delay_bucket")], F.lit(999))
    return rows.groupBy("strategy_bucket", "obs_delay_bucket").agg(
        F.count(F.lit(1)).alias("snapshots"), F.count("correct").alias("scored"),
        F.sum(F.when(F.col("correct") == 1, 1).otherwise(0)).alias("correct"),
        F.avg(F.col("correct").cast("double")).alias("win_rate"), F.avg("edge").alias("avg_edge"), F.avg("pnl").alias("avg_pnl"),
    ).withColumn("delay_order", place)


def explode_sources(positions: DataFrame, ids: str = "source_ids", outer: bool = False) -> DataFrame:
    """One row per source id of a position from its JSON id array."""
    parsed = F.from_json(F.col(ids), "array<bigint>")
    return positions.withColumn("source_id", (F.explode_outer if outer else F.explode)(parsed))


def policy_performance(positions: DataFrame, results: DataFrame, grain: list[str], keep_unresolved: bool = False) -> DataFrame:
    """Position result = max correct and mean PnL over its source snapshots; then totals per grain.

    Counts stations-dates by the pair itself. With `keep_unresolved` positions without any result stay in and resolved
    risk and the population ratio of position PnL are added.
    """
    rows = explode_sources(positions, outer=keep_unresolved).join(
        results.select(F.col("id").alias("source_id"), "correct", "pnl"), ["source_id"], "left" if keep_unresolved else "inner")
    keys = ["position_id", "policy", "model_group", "strategy_bucket", "obs_delay_bucket", "station", "market_date", "entry", "edge"]
    per = rows.groupBy(*keys).agg(F.max("correct").alias("correct"), F.avg("pnl").alias("pnl"))
    aggs = [
        F.count("pnl").alias("resolved_positions"), F.countDistinct("station", "market_date").alias("station_days"),
        F.sum(F.when(F.col("correct") == 1, 1).otherwise(0)).alias("wins"), F.avg(F.col("correct").cast("double")).alias("hit_rate"),
        F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("total_pnl"), F.avg("entry").alias("avg_entry"), F.avg("edge").alias("avg_edge")]
    if not keep_unresolved:
        aggs[0] = F.count(F.lit(1)).alias("resolved_positions")
        return per.groupBy(*grain).agg(*aggs)
    risk = F.sum(F.when(F.col("pnl").isNotNull(), F.col("entry")).otherwise(0.0))
    return per.groupBy(*grain).agg(
        F.count(F.lit(1)).alias("total_positions"), *aggs, risk.alias("resolved_risk"), sharpe(F.col("pnl")).alias("position_sharpe"),
        ratio(F.sum("pnl"), risk).alias("return_on_risk"))


def performance_by_day(positions: DataFrame) -> DataFrame:
    """PnL per UTC date, settled rows by realised and open rows by unrealised value, with the running total.

    The running total reads one row per date.
    """
    value = F.when(F.col("state") == "SETTLED", F.coalesce("realized_pnl", "unrealized_pnl", F.lit(0.0))).when(
        F.col("state").isin(*OPEN_STATES), F.coalesce("unrealized_pnl", F.lit(0.0))).otherwise(0.0)
    daily = positions.where("state <> 'REJECTED'").groupBy(F.to_date("ts").alias("utc_date")).agg(
        F.count(F.lit(1)).alias("positions"), F.sum(value).alias("daily_pnl"))
    return daily.withColumn("cumulative_pnl", F.sum("daily_pnl").over(
        Window.orderBy("utc_date").rowsBetween(Window.unboundedPreceding, 0)))


def exposure_summary(open_positions: DataFrame) -> DataFrame:
    """Open risk in total, by station-date, by side, by exact bucket and by UTC day, in one grouping-sets pass."""
    risk = F.coalesce(F.when(F.col("cost") != 0, F.col("cost")), F.col("target"), F.lit(0.0))
    rows = open_positions.where(F.col("state").isin(*OPEN_STATES)).select(
        F.col("station"), F.col("market_date"), F.col("selected_side"), F.coalesce("selected_bucket", F.lit("")).alias("selected_bucket"),
        F.to_date("ts").alias("utc_date"), risk.alias("risk"))
    s, d, i, b, u = (F.col(c) for c in ("station", "market_date", "selected_side", "selected_bucket", "utc_date"))
    grouped = rows.groupingSets([[], [s, d], [s, d, i], [s, d, i, b], [u]], s, d, i, b, u).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("positions"), F.sum("risk").alias("open_risk"))
    names = {31: "total", 7: "station_date", 3: "station_date_side", 1: "exact_bucket_side", 30: "utc_day"}
    level = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])[F.col("_g").cast("int")]
    return grouped.withColumn("level", level).drop("_g")


def status_overview(snapshots: DataFrame, markets: DataFrame, day: Column) -> DataFrame:
    """Per-station counts and latest values on one date, with market coverage beside them."""
    today = snapshots.where(F.col("market_date") == day)
    temps = today.groupBy("station").agg(
        F.count(F.lit(1)).alias("snapshots"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.max("current_temp").alias("current_temp"), F.max("high").alias("high"), F.max("book_age").alias("max_age"))
    cover = markets.where(F.col("market_date") == day).groupBy("station").agg(
        F.count(F.lit(1)).alias("markets"), F.sum(F.when(F.col("yes_token").isNotNull() & F.col("no_token").isNotNull(), 1).otherwise(0)).alias("tokenized"),
        F.min("lower").alias("min_low"), F.max(F.coalesce("upper", "lower")).alias("max_bucket"))
    return temps.join(cover, ["station"], "left")


def quote_health(candidates: DataFrame, quotes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Collection counts in one row, and the milestones they miss."""
    c = candidates.where("source_stage = 'POLICY_CANDIDATE'").agg(F.count(F.lit(1)).alias("policy_candidates"))
    size = F.col("quote_size")
    q = quotes.agg(
        F.count(F.lit(1)).alias("quote_intents"), F.countDistinct("candidate_id").alias("candidates_with_quotes"),
        F.countDistinct("quote_spec").alias("unique_quote_specs"), F.sum(F.col("would_post").cast("int")).alias("would_post"),
        F.sum((size >= 50).cast("int")).alias("useful_50"), F.sum((size >= 100).cast("int")).alias("useful_100"),
        F.countDistinct(F.when(size >= 50, F.col("candidate_id"))).alias("candidates_with_50"),
        F.countDistinct(F.when(size >= 100, F.col("candidate_id"))).alias("candidates_with_100"),
        F.max(size).alias("max_quote_size"))
    o = outcomes.agg(F.count(F.lit(1)).alias("outcomes"), F.countDistinct("candidate_id").alias("candidates_with_outcomes"))
    one = c.join(F.broadcast(q), F.lit(True)).join(F.broadcast(o), F.lit(True))
    failures = F.array_compact(F.array(
        F.when(F.col("quote_intents") == 0, "no_quotes"),
        F.when(F.col("candidates_with_quotes") < F.col("policy_candidates"), "candidates_without_quotes"),
        F.when(F.col("useful_50") == 0, "no_useful_50_quotes"), F.when(F.col("outcomes") < F.col("quote_intents"), "unlabelled_quotes")))
    return one.withColumn("failures", F.concat_ws(",", failures))


def reconcile_fills(positions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Positions whose stored fill differs from the sum of their filled attempts, with the repaired values."""
    good = attempts.where(F.col("final_state").isin("FILLED", "PARTIAL") & (F.col("filled_shares") > 0) & (F.col("cost") > 0))
    sums = good.groupBy("position_id").agg(F.sum("filled_shares").alias("new_shares"), F.sum("cost").alias("new_cost"))
    rows = positions.where(F.col("state").isin(*OPEN_STATES)).join(sums, ["position_id"])
    average = F.col("new_cost") / F.col("new_shares")
    full = ((F.col("target_shares") > 0) & (F.col("new_shares") + 1e-6 >= F.col("target_shares"))) | (
        (F.col("target") > 0) & (F.col("new_cost") + 0.01 >= F.col("target")))
    state = F.when(F.coalesce(full, F.lit(False)), "FILLED").otherwise("PARTIAL")
    same = (
        (F.col("state") == state) & (F.abs(F.coalesce("filled_shares", F.lit(0.0)) - F.col("new_shares")) < 1e-6)
        & (F.abs(F.coalesce("cost", F.lit(0.0)) - F.col("new_cost")) < 1e-6) & F.col("avg_entry").isNotNull()
        & (F.abs(F.col("avg_entry") - average) < 1e-6))
    return rows.where(~F.coalesce(same, F.lit(False))).select(
        "position_id", state.alias("new_state"), "new_shares", "new_cost", average.alias("new_avg_entry"))


def is_reject(state: Column, reason: Column) -> Column:
    up = F.upper(F.coalesce(reason, F.lit("")))
    return F.upper(F.coalesce(state, F.lit(""))).isin("REJECTED", "FAILED", "ERROR") | up.contains("REJECT") | up.contains("ERROR")


def attempt_category(df: DataFrame) -> Column:
    """Why an attempt did not end as one full fill; the first rule that fits wins."""
    reason, mode = F.upper(F.coalesce("final_reason", F.lit(""))), F.upper(F.coalesce("order_mode", F.lit("")))
    reject = is_reject(F.col("final_state"), F.col("final_reason"))
    broken = reason.contains("TICK") | reason.contains("ALLOWANCE") | reason.contains("KILL_SWITCH") | reason.contains("INVALID")
    return (
        F.when((F.col("cost") > 0) & (F.col("target") > 0) & (F.col("cost") < F.col("target") - 1e-6), "partial_fill")
        .when(reason.contains("RESTING_TTL_EXPIRED") | ((mode == "GTC") & (F.upper("final_state") == "CANCELLED")), "resting_ttl_expired")
        .when(broken, "order_construction_error")
        .when((mode == "FAK") & reason.contains("NO ORDERS FOUND") & F.col("has_resting"), "child_fak_miss_then_resting")
        .when(reject & (F.upper("parent_state") == "REJECTED"), "terminal_reject")
        .when(reject, "nonterminal_reject"))


def policy_retrospective(positions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Fill rate, expected and missed value, and attempt categories per policy."""
    shares = F.col("target") / F.col("entry")
    expected = shares * (F.col("fair") - F.col("entry"))
    filled = F.col("cost") / F.col("entry") * (F.col("fair") - F.col("entry"))
    main = positions.groupBy("policy").agg(
        F.count(F.lit(1)).alias("positions"), F.sum("target").alias("intended"), F.sum("cost").alias("filled"),
        ratio(F.sum("cost"), F.sum("target")).alias("fill_rate"), F.sum(expected).alias("expected_ev"),
        F.sum(filled).alias("filled_ev"), (F.sum(expected) - F.sum(filled)).alias("missed_ev"),
        F.coalesce(F.sum("realized_pnl"), F.lit(0.0)).alias("realized_pnl"),
        F.sum((F.col("realized_pnl").isNotNull() | F.upper("state").isin("RESOLVED", "SETTLED", "CLOSED")).cast("int")).alias("resolved"))
    resting = attempts.groupBy("position_id").agg(F.max((F.upper("order_mode") == "GTC").cast("int")).alias("_r"))
    rows = attempts.join(resting, ["position_id"]).withColumn("has_resting", F.col("_r") == 1).join(
        positions.select("position_id", "policy", F.col("state").alias("parent_state")), ["position_id"])
    tagged = rows.withColumn("category", attempt_category(rows))
    names = ["partial_fill", "resting_ttl_expired", "order_construction_error", "child_fak_miss_then_resting", "terminal_reject"]
    per = tagged.groupBy("policy").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.sum(is_reject(F.col("final_state"), F.col("final_reason")).cast("int")).alias("rejected_attempts"),
        *[F.sum(F.when(F.col("category") == n, 1).otherwise(0)).alias(n) for n in names])
    return main.join(per, ["policy"], "left")


def reject_reasons(attempts: DataFrame, start=None, end=None) -> DataFrame:
    rows = attempts.where(is_reject(F.col("final_state"), F.col("final_reason")))
    if start is not None:
        rows = rows.where(F.col("ts") >= start)
    if end is not None:
        rows = rows.where(F.col("ts") < end)
    return rows.groupBy("final_reason", "final_state").agg(
        F.count(F.lit(1)).alias("attempts"), F.coalesce(F.sum("target"), F.lit(0.0)).alias("intended"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("filled"))


def capacity_reason(reason: Column) -> Column:
    up = F.upper(reason)
    return (
        F.when(up.contains("INSUFFICIENT_DEPTH"), "insufficient_depth_usd").when(up.contains("NO ORDERS FOUND"), "fak_miss_usd")
        .when(up.contains("RESTING_TTL_EXPIRED"), "ttl_expired_usd")
        .when(up.startswith("RISK_") | up.contains("_CAP"), "risk_cap_usd").otherwise("other_reject_usd"))


def whole_chain(live: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per sleeve: the selected rows at entry, the filled part at entry and at the real price, what was not filled, slippage
    and the capacity lost by reason. Live rows carry won (null while unresolved)."""
    def pnl(price: Column, notional: Column) -> Column:
        return F.when(F.col("won"), notional / price - notional).when(~F.col("won"), -notional)
    cost, target = F.coalesce("cost", F.lit(0.0)), F.coalesce("target", F.lit(0.0))
    fill_price = F.coalesce("avg_entry", "entry")
    filled = cost > 0
    known = F.col("won").isNotNull()
    main = live.groupBy("sleeve").agg(
        F.count(F.lit(1)).alias("selected_rows"), F.sum(filled.cast("int")).alias("filled_rows"),
        F.sum(F.when(known, target).otherwise(0.0)).alias("selected_risk"), F.sum(F.coalesce(pnl(F.col("entry"), target), F.lit(0.0))).alias("selected_pnl"),
        F.sum(F.when(filled, F.coalesce(pnl(F.col("entry"), cost), F.lit(0.0))).otherwise(0.0)).alias("filled_entry_pnl"),
        F.sum(F.when(filled, F.coalesce(pnl(fill_price, cost), F.lit(0.0))).otherwise(0.0)).alias("filled_actual_pnl"),
        F.sum(F.when(~filled, F.coalesce(pnl(F.col("entry"), target), F.lit(0.0))).otherwise(0.0)).alias("unfilled_pnl"),
        F.coalesce(F.sum(F.coalesce("realized_pnl", "unrealized_pnl")), F.lit(0.0)).alias("actual_pnl"),
        ratio(F.sum(F.when(filled, cost * (fill_price - F.col("entry")))), F.sum(F.when(filled, cost))).alias("weighted_slippage"))
    lost = attempts.join(live.select("position_id", "sleeve"), ["position_id"]).where(
        ~F.col("final_state").isin("FILLED", "PARTIAL")).withColumn("_r", capacity_reason(F.col("final_reason")))
    names = ["insufficient_depth_usd", "fak_miss_usd", "ttl_expired_usd", "risk_cap_usd", "other_reject_usd"]
    loss = lost.groupBy("sleeve").agg(*[F.sum(F.when(F.col("_r") == n, F.col("target")).otherwise(0.0)).alias(n) for n in names])
    return main.join(loss, ["sleeve"], "left")


def exposure_rollup(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Open positions by key: cost, cost-weighted prices, marks and unrealised value."""
    w = F.col("cost")
    marked = F.col("bid").isNotNull()
    def mean(c: str) -> Column:
        known = F.col(c).isNotNull()
        return ratio(F.sum(F.when(known, w * F.col(c))), F.sum(F.when(known, w)))
    return positions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("positions"), F.sum(w).alias("cost"), mean("entry").alias("weighted_entry"), mean("fair").alias("weighted_fair"),
        mean("edge").alias("weighted_edge"), F.sum(marked.cast("int")).alias("marked"), F.sum((~marked).cast("int")).alias("missing_marks"),
        F.min("bid").alias("min_bid"), F.max("bid").alias("max_bid"),
        F.sum(F.when(marked, F.col("shares") * F.col("bid") - w)).alias("mark_pnl"))


def truth_pairs(truths: DataFrame, venue: DataFrame) -> DataFrame:
    """Every pair of truth sources per station: agreement, differences and venue mismatches.

    Sources of one station-date are packed (at most one row each) and pairs are formed inside the row.
    """
    from skyledger.functions.buckets import truth_compatible

    one = truths.where("value is not null and error is null").groupBy("station", "market_date", "source").agg(
        F.max_by(F.struct("value", "value_lower", "value_upper"), F.struct("value", "value_lower", "value_upper")).alias("v"))
    rows = one.join(venue, ["station", "market_date"], "left")
    low, high = F.coalesce("v.value_lower", "v.value"), F.coalesce("v.value_upper", "v.value")
    rows = rows.withColumn("ok", truth_compatible(low, high, F.col("bucket")))
    packed = rows.groupBy("station", "market_date").agg(F.array_sort(F.collect_list(
        F.struct(F.col("source").alias("s"), F.col("v.value").alias("v"), F.col("ok").alias("ok")))).alias("_a"))
    pairs = packed.select("station", F.explode(F.flatten(F.transform("_a", lambda a, i: F.transform(
        F.slice("_a", i + 2, F.size("_a")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("x"))
    d = F.col("x.a.v") - F.col("x.b.v")
    both = F.col("x.a.ok").isNotNull()
    return pairs.groupBy("station", F.col("x.a.s").alias("source_left"), F.col("x.b.s").alias("source_right")).agg(
        F.count(F.lit(1)).alias("dates_compared"), F.sum((d == 0).cast("int")).alias("exact_matches"),
        F.sum((F.abs(d) >= 1).cast("int")).alias("one_degree_or_more"), F.sum((F.abs(d) >= 2).cast("int")).alias("two_degrees_or_more"),
        F.avg(d).alias("mean_signed_difference"), F.avg(F.abs(d)).alias("mean_absolute_difference"), F.max(F.abs(d)).alias("max_absolute_difference"),
        F.sum(both.cast("int")).alias("venue_dates"), F.sum(F.when(both & ~F.col("x.a.ok"), 1).otherwise(0)).alias("left_mismatches"),
        F.sum(F.when(both & ~F.col("x.b.ok"), 1).otherwise(0)).alias("right_mismatches"),
        F.sum(F.when(both & (F.col("x.a.ok") != F.col("x.b.ok")), 1).otherwise(0)).alias("classification_disagreements"))


def truth_matrix(truths: DataFrame, venue: DataFrame, sources: list[str]) -> DataFrame:
    """One row per station-date of either input; value, error and venue match per source (columns known ahead)."""
    from skyledger.functions.buckets import truth_compatible

    keys = truths.select("station", "market_date").unionByName(venue.select("station", "market_date")).distinct()
    rows = truths.join(venue, ["station", "market_date"], "left")
    ok = truth_compatible(F.coalesce("value_lower", "value"), F.coalesce("value_upper", "value"), F.col("bucket"))
    cells = []
    for s in sources:
        mine = F.col("source") == s
        cells += [F.max(F.when(mine, F.col("value"))).alias(f"{s}_value"),
                  F.max(F.when(mine, F.col("error"))).alias(f"_{s}_err"), F.max(F.when(mine, F.lit(1))).alias(f"_{s}_has"),
                  F.max(F.when(mine, ok)).alias(f"{s}_matches")]
    wide = rows.withColumn("_ok", ok).groupBy("station", "market_date").agg(*cells)
    out = keys.join(wide, ["station", "market_date"], "left").join(venue, ["station", "market_date"], "left")
    errors = {f"{s}_error": F.when(F.col(f"_{s}_has").isNull(), "MISSING").otherwise(F.col(f"_{s}_err")) for s in sources}
    return out.withColumns(errors).drop("bucket", *[f"_{s}_err" for s in sources], *[f"_{s}_has" for s in sources])


def truth_decision(matrix: DataFrame, sources: list[str], minimum: int = 30) -> DataFrame:
    """Proxy source: enough comparable dates, lowest mismatch rate, ties by the listed order."""
    rows = matrix.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("source"), F.lit(i).alias("rank"), F.col(f"{s}_matches").alias("ok")) for i, s in enumerate(sources)])).alias("x"))
    counts = rows.groupBy(F.col("x.source").alias("source"), F.col("x.rank").alias("rank")).agg(
        F.count("x.ok").alias("comparable"), F.sum(F.when(~F.col("x.ok"), 1).otherwise(0)).alias("mismatches"))
    best = counts.where(F.col("comparable") >= minimum).agg(F.min_by("source", F.struct(F.col("mismatches") / F.col("comparable"), F.col("rank"))).alias("_best"))
    return counts.join(F.broadcast(best), F.lit(True)).withColumns({
        "mismatch_rate": ratio(F.col("mismatches"), F.col("comparable")), "chosen": F.coalesce(F.col("source") == F.col("_best"), F.lit(False))}).drop("_best", "rank")
