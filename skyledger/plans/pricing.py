"""Price sheets, reserves, quotes, sizing and the pricing dataset."""

from __future__ import annotations

import bisect
import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.buckets import side_value
from skyledger.functions.money import floor_tick, market_reference
from skyledger.operators import select
from skyledger.operators.metrics import cluster_weights, ratio


def price_economics(df: DataFrame, price: str, label: str, weight: str, levels: dict[str, str]) -> DataFrame:
    """Weighted `label/price - 1` over all rows and by each level, in one grouping-sets pass."""
    usable = df.where(F.col(price) > 0).withColumn("_w", F.greatest(F.col(weight), F.lit(0.0)))
    cols = list(levels.values())
    names = list(levels)
    sets = [[F.col(c)] for c in cols] + [[]]
    pnl = F.sum(F.col("_w") * (F.col(label) / F.col(price) - 1.0))
    out = usable.groupingSets(sets, *[F.col(c) for c in cols]).agg(
        F.grouping_id().cast("long").alias("_g"), F.count(F.lit(1)).alias("resolved_quotes"), F.countDistinct("market_date").alias("market_dates"),
        F.sum("_w").alias("risk_units"), pnl.alias("pnl_units"), ratio(pnl, F.sum("_w")).alias("return_on_risk"),
        ratio(F.sum(F.col("_w") * F.col(label)), F.sum("_w")).alias("win_rate"))
    full = (1 << len(cols)) - 1
    level, key = F.when(F.col("_g") == full, "all"), F.when(F.col("_g") == full, F.lit(""))
    for i, (name, c) in enumerate(zip(names, cols)):
        gid = full - (1 << (len(cols) - 1 - i))
        level, key = level.when(F.col("_g") == gid, name), key.when(F.col("_g") == gid, F.col(c))
    return out.withColumns({"level": level, "key": key}).drop("_g", *cols)


def dedupe_training(df: DataFrame, key: list[str], role: str, order: list[Column]) -> DataFrame:
    """One row per key: an evaluation row beats a fit row, else the first by order."""
    rank = F.when(F.col(role) == "evaluation", 0).otherwise(1)
    return select.first_by_scope(df, key, [rank, *order])


def uncertainty_reserve(daily: DataFrame, keys: list[str], date: str, residual: str, quantile: float, minimum: float,
                        decided_at: str | None = None, resolved_at: str | None = None) -> DataFrame:
    """Higher quantile `ceil(q*n)-1` of the positive parts of earlier dates' residuals, never under the minimum.

    With the two clocks a date counts only once its labels were all resolved (`resolved_at`) before the first decision of the
    date at hand (`decided_at`). The input has one row per key and date, so a key's rows are as many as the calendar's dates;
    they pass once, in order, through a sorted list. A date without a residual gets a reserve and counts for none.
    """
    clocks = [decided_at, resolved_at] if decided_at and resolved_at else []
    schema = daily.select(*keys, date).schema.add("prior_dates", "long").add("reserve", "double")

    def running(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(date)
        waiting: list[tuple] = []  # (when it may count, positive part), smallest first
        counted: list[float] = []
        priors, reserves = [], []
        for row in rows.itertuples(index=False):
            now = getattr(row, decided_at) if clocks else getattr(row, date)
            while waiting and waiting[0][0] < now:
                bisect.insort(counted, heapq.heappop(waiting)[1])
            n = len(counted)
            priors.append(n)
            reserves.append(max(minimum, counted[max(0, math.ceil(quantile * n) - 1)] if n else 0.0))
            if not pd.isna(getattr(row, residual)):
                heapq.heappush(waiting, (getattr(row, resolved_at) if clocks else now, max(float(getattr(row, residual)), 0.0)))
        return rows[[*keys, date]].assign(prior_dates=priors, reserve=reserves)

    return daily.select(*keys, date, residual, *clocks).groupBy(*keys).applyInPandas(running, schema)


def price_sheet(rows: DataFrame, min_profit: float = 0.02, known_cost: float = 0.01, tick: float = 0.01, min_quote: float = 0.01,
                min_dates: int = 5) -> DataFrame:
    """Maximum quote after the reserves, floored to the tick, with the first reason it may not be used.

    `rows` carry calibrated, reserve, prior_dates, reference_kind, reference_stale, calibrator_selected.
    """
    conservative = F.least(F.greatest(F.col("calibrated") - F.col("reserve"), F.lit(0.0)), F.lit(1.0))
    quote = floor_tick(conservative - min_profit - known_cost, tick)
    reason = (
        F.when(~F.col("calibrator_selected"), "CALIBRATOR_NOT_SELECTED").when(F.col("reference_stale"), "STALE_MARKET_REFERENCE")
        .when(F.col("reference_kind") == "MISSING", "MISSING_MARKET_REFERENCE").when(F.col("prior_dates") < min_dates, "INSUFFICIENT_PRIOR_OOF_DATES")
        .when(quote < min_quote, "NO_POSITIVE_QUOTE_AFTER_RESERVES"))
    return rows.withColumns({"conservative": conservative, "skip_reason": reason, "maximum_quote": F.when(reason.isNull(), quote), "eligible": reason.isNull()})


def phase1_sheet(rows: DataFrame, fairs: str = "model_fairs", cap: float = 0.95, floor: float = 0.05, base_uncertainty: float = 0.03,
                 base_adverse: float = 0.02) -> DataFrame:
    """Quote from the mean model fair less an uncertainty and an adverse-selection haircut, floored to the cent.

    `model_fairs` is a map of model to fair; rows also carry spread, just_depleted, cancels_5m, trades_5m, blocked_calibration.
    """
    values = F.filter(F.map_values(fairs), lambda x: x.isNotNull())
    n = F.size(values)
    mean = F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n)
    raw = F.bround(F.coalesce(mean, F.col("fair")), 4)
    rows = rows.withColumns({"raw_fair": raw, "_vals": values})
    mu = F.aggregate("_vals", F.lit(0.0), lambda a, x: a + x) / F.size("_vals")
    rows = rows.withColumn("_mu", F.when(F.size("_vals") > 0, mu))
    spread = F.sqrt(F.aggregate("_vals", F.lit(0.0), lambda a, x: a + (x - F.col("_mu")) * (x - F.col("_mu"))) / F.size("_vals"))
    fair = F.bround(F.least(F.lit(cap), F.greatest(F.lit(floor), F.col("raw_fair"))), 4)
    unsure = (
        F.lit(base_uncertainty) + F.when(F.size("_vals") >= 2, F.least(F.lit(0.06), spread)).otherwise(0.02)
        + F.greatest(F.lit(0.0), F.least(F.lit(0.08), F.col("raw_fair") - fair)) + F.when(F.col("blocked_calibration"), 0.03).otherwise(0.0))
    adverse = (
        F.lit(base_adverse) + F.when(F.col("spread").isNotNull(), F.least(F.lit(0.04), F.greatest(F.lit(0.0), F.col("spread")) * 0.5)).otherwise(0.0)
        + F.when(F.col("just_depleted"), 0.02).otherwise(0.0) + F.least(F.lit(0.03), F.coalesce("cancels_5m", F.lit(0)) * 0.005)
        + F.least(F.lit(0.02), F.coalesce("trades_5m", F.lit(0)) * 0.002))
    rows = rows.withColumns({"calibrated": fair, "uncertainty": F.bround(unsure, 4), "adverse": F.bround(adverse, 4)})
    quote = floor_tick(F.col("calibrated") - F.col("uncertainty") - F.col("adverse"), 0.01)
    reason = (
        F.when(F.col("market_family") != "HIGH_TEMP", "FAMILY_OUT_OF_SCOPE").when(F.col("selected_side") != "BUY_NO", "SIDE_OUT_OF_SCOPE")
        .when(F.col("calibrated").isNull(), "MISSING_FAIR").when(quote <= 0, "NO_POSITIVE_QUOTE_AFTER_HAIRCUTS"))
    return rows.withColumns({"max_quote": F.when(reason.isNull(), quote), "reject_reason": reason}).drop("_vals", "_mu")


def phase1_replay(consensus: DataFrame, order: list[Column]) -> DataFrame:
    """First eligible sheet per (station, date, family, bucket, side) and the PnL of its quote."""
    sheet = phase1_sheet(consensus).where("reject_reason is null")
    first = select.first_by_scope(sheet, ["station", "market_date", "market_family", "selected_bucket", "selected_side"], order)
    return first.withColumn("quote_pnl", F.when(F.col("correct") == 1, 1 - F.col("max_quote")).when(F.col("correct") == 0, -F.col("max_quote")))


def v2_dataset(rows: DataFrame, frozen: Column, scope: list[str], order: list[Column], max_age: float = 300.0) -> DataFrame:
    """Fit corpus (all rows) and frozen-signal rows (first by scope), with market reference, flags, exclusions and cluster weights."""
    fit = rows.withColumn("role", F.lit("fit"))
    signal = select.first_by_scope(rows.where(frozen), scope, order).withColumn("role", F.lit("evaluation"))
    both = fit.unionByName(signal)
    ref = market_reference(F.col("book_ts"), F.col("ready_ts"), F.col("book_age"), F.col("best_bid"), F.col("best_ask"), F.col("entry"), max_age)
    both = both.withColumn("reference", ref)
    excluded = F.when(F.col("fair").isNull(), "MISSING_FAIR").when(F.col("correct").isNull(), "UNRESOLVED")
    both = both.withColumn("exclusion", excluded)
    weighted = cluster_weights(both.where("exclusion is null").withColumn("_d", F.concat_ws(":", "role", "market_date")), "_d", "station").drop("_d")
    dropped = both.where("exclusion is not null").withColumns({"station_date_weight": F.lit(None).cast("double"), "market_date_weight": F.lit(None).cast("double")})
    return weighted.unionByName(dropped)


def post_only_quotes(sheets: DataFrame, specs: list[dict], min_notional: float = 1.0) -> DataFrame:
    """One row per sheet and quote spec: post-only price, the reason to skip and the notional queued ahead.

    Sheets carry token_id, eligible, reject_reason, max_quote, best_ask and bids (best first). Specs are a short list of (name,
    ask_offset_cents, size_usd); they are exploded from literals. The price stays at least one cent under the ask.
    """
    grid = F.array(*[F.struct(F.lit(s["name"]).alias("spec"), F.lit(int(s["ask_offset_cents"])).alias("offset"), F.lit(float(s["size_usd"])).alias("size_usd")) for s in specs])
    rows = sheets.withColumn("_q", F.explode(grid)).select("*", "_q.*").drop("_q")
    under = F.col("best_ask") - F.greatest(F.col("offset"), F.lit(1)) / 100.0
    price = F.when(F.col("max_quote").isNotNull() & under.isNotNull(), F.floor(F.least("max_quote", under) * 100 + 1e-9) / 100)
    rows = rows.withColumn("_price", price)
    checks = {  # in order; the first that holds is the reason
        "MISSING_TOKEN": F.col("token_id").isNull(), "MISSING_BOOK_OR_ASK": F.col("best_ask").isNull(),
        "NO_POST_ONLY_PRICE": F.coalesce(F.col("_price") <= 0, F.lit(True)), "WOULD_CROSS_SPREAD": F.col("_price") >= F.col("best_ask") - 1e-9,
        "QUOTE_SIZE_BELOW_MIN": F.col("size_usd") < min_notional}
    reason = F.coalesce(F.when(~F.col("eligible"), F.coalesce("reject_reason", F.lit("PRICE_SHEET_INELIGIBLE"))), *[F.when(c, F.lit(n)) for n, c in checks.items()])
    rows = rows.withColumn("skip_reason", reason).withColumn("quote_price", F.when(F.col("skip_reason").isNull(), F.col("_price"))).drop("_price")
    ahead = F.aggregate(F.filter("bids", lambda x: x["price"] >= F.col("quote_price")), F.lit(0.0), lambda a, x: a + x["price"] * x["size"])
    return rows.withColumn("queue_ahead_usd", F.when(F.col("quote_price").isNotNull(), ahead))


# Fixed values of order sizing: multipliers by entry price (below each bound; the third bound is included), by kind of strategy, the
# stake of long shots, the rounding step, and the reasons in the order the caps are applied.
PRICE_STEPS = [(0.10, 0.25), (0.25, 0.60), (0.75, 1.00)]
PRICE_ABOVE, CONSENSUS, CONSENSUS_YES, LONG_SHOT_USD, SIZE_STEP = 0.60, 0.6, 0.5, 2.0, 0.5
CAP_REASONS = {
    "order": "per_order", "total": "RISK_TOTAL_OPEN_CAP", "daily": "RISK_DAILY_NEW_CAP", "station_date": "RISK_STATION_DATE_CAP",
    "station_date_side": "RISK_STATION_DATE_SIDE_CAP", "bucket": "RISK_EXACT_BUCKET_SIDE_CAP"}


def size_candidates(df: DataFrame, exposure: DataFrame, keys: list[str], base_usd: float = 25.0, minimum: float = 1.0, caps: dict[str, float] | None = None) -> DataFrame:
    """Order size: a stake by strategy, price and side, cut by six caps and the visible depth, floored to a step, or a reason.

    Rows carry strategy_name, selected_side, entry and depth (null where unknown); `exposure` has `used_<cap>` per `keys`, and a
    missing one counts as zero. The first exhausted cap is the reason; a size under the minimum names depth where depth is short.
    """
    caps = caps or {"order": 100.0, "total": 1000.0, "daily": 500.0, "station_date": 150.0, "station_date_side": 120.0, "bucket": 80.0}
    rows = df.join(exposure, keys, "left").fillna(0.0, [c for c in exposure.columns if c.startswith("used_")])
    name, yes = F.lower("strategy_name"), F.col("selected_side") == "BUY_YES"
    (low, at_low), (mid, at_mid), (high, at_high) = PRICE_STEPS
    by_price = F.when(F.col("entry") < low, at_low).when(F.col("entry") < mid, at_mid).when(F.col("entry") <= high, at_high).otherwise(PRICE_ABOVE)
    by_policy = F.when(F.col("strategy_name").contains("consensus"), CONSENSUS).otherwise(1.0)
    long_shot = name.contains("moonshot") | name.contains("entry_05_10")
    by_side = F.when(yes & name.contains("consensus"), CONSENSUS_YES).otherwise(1.0)
    wanted = F.when(long_shot, LONG_SHOT_USD).otherwise(base_usd * by_policy * by_price) * by_side
    room = {k: F.greatest(F.lit(caps[k]) - (F.col(f"used_{k}") if f"used_{k}" in exposure.columns else F.lit(0.0)), F.lit(0.0)) for k in CAP_REASONS}
    depth = F.when(F.col("depth").isNotNull(), F.greatest(F.col("depth"), F.lit(0.0)))  # unknown depth limits nothing
    target = F.least(wanted, *room.values(), F.coalesce(depth, F.lit(float("inf"))))
    size = F.floor((F.greatest(target, F.lit(0.0)) + 1e-9) / SIZE_STEP) * SIZE_STEP
    rows = rows.withColumns({"target_usd": wanted, "size_usd": size})
    exhausted = [F.when(room[k] <= 0, F.lit(reason)) for k, reason in CAP_REASONS.items()] + [F.when(depth <= 0, F.lit("INSUFFICIENT_DEPTH"))]
    small = F.when(F.col("size_usd") < minimum, F.when(depth < minimum, F.lit("INSUFFICIENT_DEPTH")).otherwise(F.lit("RISK_MIN_ORDER_NOTIONAL")))
    return rows.withColumn("blocked_reason", F.coalesce(*exhausted, small))


def bucket_from_survival(lower: Column, upper: Column, at_lower: Column, above_upper: Column, so_far: Column) -> Column:
    """High-temperature bucket probability from survival at its two thresholds, with what is already decided by the high so far."""
    both, only_low, only_up = lower.isNotNull() & upper.isNotNull(), upper.isNull() & lower.isNotNull(), lower.isNull() & upper.isNotNull()
    def out(p: Column, reason: str | None) -> Column:
        return F.struct(p.cast("double").alias("p"), F.lit(reason).cast("string").alias("reason"))
    return (
        F.when(both & (so_far > upper), out(F.lit(0.0), "HIGH_SO_FAR_ABOVE_BUCKET"))
        .when(both & (so_far >= lower), out(1.0 - above_upper, "HIGH_SO_FAR_INSIDE_BUCKET"))
        .when(both, out(F.greatest(F.lit(0.0), at_lower - above_upper), None))
        .when(only_low & (so_far >= lower), out(F.lit(1.0), "OR_HIGHER_ALREADY_CROSSED")).when(only_low, out(at_lower, None))
        .when(only_up & (so_far > upper), out(F.lit(0.0), "HIGH_SO_FAR_ABOVE_BUCKET")).when(only_up, out(1.0 - above_upper, None))
        .otherwise(out(F.lit(0.0), "UNPARSEABLE_BUCKET_BLOCKED")))


def low_bucket_from_survival(lower: Column, upper: Column, below_lower: Column, at_upper: Column, so_far: Column) -> Column:
    """Low-temperature twin: `at_upper` is P(low <= upper), `below_lower` is P(low <= lower-1)."""
    both, only_low, only_up = lower.isNotNull() & upper.isNotNull(), upper.isNull() & lower.isNotNull(), lower.isNull() & upper.isNotNull()
    def out(p: Column, reason: str | None) -> Column:
        return F.struct(p.cast("double").alias("p"), F.lit(reason).cast("string").alias("reason"))
    return (
        F.when((both | only_low) & (so_far < lower), out(F.lit(0.0), "LOW_SO_FAR_BELOW_BUCKET"))
        .when(both, out(F.greatest(F.lit(0.0), at_upper - below_lower), None)).when(only_low, out(1.0 - below_lower, None))
        .when(only_up & (so_far <= upper), out(F.lit(1.0), "OR_LOWER_ALREADY_CROSSED")).when(only_up, out(at_upper, None))
        .otherwise(out(F.lit(0.0), "UNPARSEABLE_BUCKET_BLOCKED")))


def mark_positions(positions: DataFrame, books: DataFrame, as_of: Column) -> DataFrame:
    """Mark by the latest bid, and the outcome already certain from the progress value.

    Positions carry token_id, side, lower, upper, entry, shares, high_so_far.
    """
    latest = books.groupBy("token_id").agg(F.max_by(F.struct("best_bid", "ts"), F.struct("ts", "best_bid")).alias("_b"))
    rows = positions.join(latest, ["token_id"], "left")
    lost = F.col("high_so_far") > F.col("upper")
    won = F.col("upper").isNull() & (F.col("high_so_far") >= F.col("lower"))
    yes = F.when(won, "WON").when(lost, "LOST").otherwise("OPEN")
    state = F.when(F.col("side") == "BUY_YES", yes).otherwise(F.when(yes == "WON", "LOST").when(yes == "LOST", "WON").otherwise("OPEN"))
    mark = F.when(state == "WON", 1.0).when(state == "LOST", 0.0).otherwise(F.col("_b.best_bid"))
    age = (F.unix_micros(as_of) - F.unix_micros("_b.ts")) / 1e6
    return rows.withColumns({"state": state, "mark": mark, "mark_age_s": age, "mark_pnl": F.col("shares") * (mark - F.col("entry"))}).drop("_b")


def selected_fair(side: Column, yes: Column, no: Column) -> Column:
    return side_value(side, yes, no)
