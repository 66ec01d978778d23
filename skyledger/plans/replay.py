"""Decision cache, forward scorecards, caps across candidates, portfolio replay, role transitions and baskets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.money import stable_id
from skyledger.functions.times import quote_ready
from skyledger.operators import books, folds, metrics, scan, select
from skyledger.operators.metrics import ratio, sharpe


# ---- decision cache ----

def decision_cache(snapshots: DataFrame, tokens: DataFrame, bucket_us: int, latency_us: int, known: DataFrame | None = None) -> DataFrame:
    """Map every snapshot to the decision it shares (token, ceiling time), with content ids and a reject reason.

    `snapshots`: id, market_id, selected_side, ts, reasons (array). `tokens`: market_id, outcome, token_id. Mappings whose id is
    in `known` are left out, so a rerun adds only what is new.
    """
    outcome = F.when(F.col("selected_side") == "BUY_YES", "YES").when(F.col("selected_side") == "BUY_NO", "NO").otherwise("INVALID")
    rows = snapshots.withColumn("outcome", outcome).join(tokens, ["market_id", "outcome"], "left")
    token = F.when(F.col("outcome") == "INVALID", F.concat_ws(":", F.lit("INVALID"), "market_id")).when(
        F.col("token_id").isNull(), F.concat_ws(":", F.lit("UNCATALOGED"), "market_id", "outcome")).otherwise(F.col("token_id"))
    reason = (
        F.when(F.col("outcome") == "INVALID", "SOURCE:INVALID_SELECTED_SIDE").when(F.col("token_id").isNull(), "TOKEN_NOT_CATALOGED")
        .when(F.size("reasons") > 0, F.concat(F.lit("SOURCE:"), F.array_min("reasons"))))
    rows = rows.withColumns({"rejection_reason": reason, "ready": quote_ready(F.col("ts"), bucket_us, latency_us)}).withColumn("token_id", token)
    rows = rows.withColumns({
        "decision_id": stable_id("token_id", "market_id", "outcome", F.unix_micros("ready").alias("ready_us")),
        "mapping_id": stable_id(F.lit(bucket_us).alias("b"), F.lit(latency_us).alias("l"), "id")})
    return rows if known is None else rows.join(known.select("mapping_id"), ["mapping_id"], "left_anti")


def decisions_of(mappings: DataFrame) -> DataFrame:
    """One row per decision; the status is that of its first mapping by snapshot id."""
    return mappings.groupBy("decision_id").agg(
        F.min("token_id").alias("token_id"), F.min("ready").alias("ready"), F.count(F.lit(1)).alias("mappings"),
        F.min_by(F.coalesce("rejection_reason", F.lit("PENDING")), "id").alias("status"))


def enrich_outcomes(decisions: DataFrame, mappings: DataFrame, outcomes: DataFrame, score) -> DataFrame:
    """Label of each decision, or CONFLICT when its mappings disagree on what they bought, or UNAVAILABLE without an outcome."""
    identity = F.struct("station", "market_date", "market_family", "selected_bucket", "selected_side")
    ids = mappings.withColumn("_i", identity).groupBy("decision_id").agg(
        (F.min("_i") != F.max("_i")).alias("conflict"), F.min("_i").alias("_i")).select("decision_id", "conflict", "_i.*")
    scored = score(decisions.select("decision_id").join(ids, ["decision_id"]).join(outcomes, ["station", "market_date"], "left"))
    status = F.when(F.col("conflict"), "CONFLICT").when(F.col("label").isNull(), "UNAVAILABLE").otherwise("AVAILABLE")
    return scored.withColumn("status", status).withColumn("label", F.when(F.col("status") == "AVAILABLE", F.col("label")))


def decision_grain(mappings: DataFrame) -> DataFrame:
    """Rows, distinct exact decisions and distinct bucketed decisions, with the reduction ratio."""
    one = mappings.agg(
        F.count(F.lit(1)).alias("model_rows"), F.countDistinct("token_id", "ts").alias("exact_decisions"),
        F.countDistinct("token_id", "ready").alias("bucketed_decisions"))
    return one.withColumn("reduction", F.col("model_rows") / F.col("bucketed_decisions"))


# ---- forward evaluation ----

DEPTHS = (("conservative", 0.5), ("base", 1.0), ("optimistic", 1.0))


def matching_signals(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Post-activation rows of each candidate: an equi join on (model, family) with the rule ranges beside it.

    Candidates carry candidate_id, family_id, model_id, market_family, side, entry_min, entry_max, edge_min, activated_at, complexity.
    """
    c = candidates.select(*[F.col(x).alias(f"c_{x}") for x in candidates.columns])
    on = [F.col("model_id") == F.col("c_model_id"), F.col("market_family") == F.col("c_market_family"), F.col("ts") >= F.col("c_activated_at"),
          (F.col("c_side") == "ANY") | (F.col("selected_side") == F.col("c_side")), F.col("edge") >= F.col("c_edge_min"),
          F.col("best_ask") >= F.col("c_entry_min"), F.col("best_ask") <= F.col("c_entry_max")]
    keep = {"c_candidate_id": "candidate_id", "c_family_id": "family_id", "c_entry_max": "cap", "c_complexity": "complexity"}
    return rows.join(c, on).withColumnsRenamed(keep).drop(*[x for x in c.columns if x not in keep])


ORDER = ["ts", "row_id"]


def forward_executions(rows: DataFrame, candidates: DataFrame, position_cost: float, daily_cap: float, depths=DEPTHS) -> DataFrame:
    """First signal per (candidate, station, date) within the daily cap, executed under each depth scenario."""
    first = select.first_by_scope(matching_signals(rows, candidates), ["candidate_id", "station", "market_date"], [F.col(c) for c in ORDER])
    kept = folds.equal_cost_cap(first, ["candidate_id", "market_date"], [F.col(c) for c in ORDER], position_cost, daily_cap)
    grid = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(m).alias("depth")) for n, m in depths])
    runs = kept.withColumn("_d", F.explode(grid)).withColumns({"scenario": F.col("_d.scenario")})
    levels = F.transform("asks", lambda x: F.struct(x["price"].alias("price"), (x["size"] * F.col("_d.depth")).alias("size")))
    runs = runs.withColumn("_s", books.sweep_asks(levels, F.col("cap"), F.lit(position_cost))).where("_s.cost > 0 and _s.vwap is not null")
    return runs.withColumns({
        "cost": F.col("_s.cost"), "shares": F.col("_s.shares"), "vwap": F.col("_s.vwap"),
        "fill_fraction": F.least(F.col("_s.cost") / position_cost, F.lit(1.0))}).drop("_d", "_s")


def forward_scorecards(rows: DataFrame, candidates: DataFrame, position_cost: float, daily_cap: float, min_dates: int,
                       min_station_dates: int) -> DataFrame:
    """Scenario summaries per candidate, concentration, blockers and the review state."""
    runs = forward_executions(rows, candidates, position_cost, daily_cap)
    stats = metrics.scenario_summary(runs, ["candidate_id", "scenario"], scan.day_slice(F.col("ts")), [F.col(c) for c in ORDER])
    venue = runs.where("scenario = 'base' and label is not null and not disagreement")
    shares = metrics.concentration(venue, ["candidate_id"], ["station", "market_date"])
    per = venue.groupBy("candidate_id").agg(
        F.countDistinct("market_date").alias("venue_dates"), F.countDistinct("station", "market_date").alias("venue_station_dates"))
    wrong = runs.where("scenario = 'base'").groupBy("candidate_id").agg(F.sum(F.col("disagreement").cast("int")).alias("disagreements"))
    base = stats.where("scenario = 'base'").select("candidate_id", F.col("venue_cost").alias("_cost"), F.col("venue_pnl").alias("_pnl"))
    rows_ = stats.join(per, ["candidate_id"], "left").join(wrong, ["candidate_id"], "left").join(base, ["candidate_id"], "left").join(
        shares.select("candidate_id", "max_station_share", "max_market_date_share"), ["candidate_id"], "left").fillna(0, ["venue_dates", "venue_station_dates", "disagreements"])
    blockers = F.array_compact(F.array(
        F.when(F.col("venue_dates") < min_dates, "INSUFFICIENT_VENUE_RESOLVED_MARKET_DATES"),
        F.when(F.col("venue_station_dates") < min_station_dates, "INSUFFICIENT_VENUE_RESOLVED_STATION_DATES"),
        F.when(F.col("disagreements") > 0, "SETTLEMENT_DISAGREEMENT"),
        F.when((F.col("_cost") <= 0) | F.coalesce(F.col("_pnl") <= 0, F.lit(True)), "NONPOSITIVE_OR_ABSENT_BASE_ECONOMICS")))
    return rows_.withColumn("blockers", F.concat_ws(",", F.sort_array(blockers))).withColumn(
        "review_state", F.when(F.col("blockers") == "", "READY").otherwise("CONTINUE_COLLECTING")).drop("_cost", "_pnl")


@dataclass(frozen=True)
class ForwardDefaults:
    """What a candidate that names no size or cap of its own takes, and the execution version that counts."""

    execution_version: str
    target: float = 25.0
    daily_cap: float = 100.0
    station_date_cap: float = 150.0


REJECTIONS = ("EXECUTION_SUMMARY_UNAVAILABLE", "NO_CAPPED_EXECUTABLE_ASK", "DAILY_RISK_CAP", "STATION_DATE_CAP")
UNMEASURED = ("VENUE_SETTLEMENT_UNAVAILABLE", "MARKOUTS_UNAVAILABLE")


def sweep_key(cap: Column, target: Column) -> Column:
    """Name of a stored sweep: its price cap and target with eight places."""
    def fixed(c: Column) -> Column:
        return F.format_string("%.8f", c)

    return F.concat(F.lit("cap="), fixed(cap), F.lit("|target="), fixed(target))


def evaluate_candidates(rows: DataFrame, candidates: DataFrame, defaults: ForwardDefaults) -> DataFrame:
    """Each candidate's exact rule on the rows since its activation, alone under its own size and caps.

    The first matching row of a (station, date) stands for it, whether or not it executes. It is rejected, for the first reason that
    holds, where no sweep is stored at the candidate's cap and target, where the sweep buys nothing, where the date's cost would pass
    the daily cap, or the station's the station-date cap. A candidate of another execution version has no rows that count. Gives
    one row for each candidate, those without a match too: rows before and since activation, executions with their cost, PnL and
    ratio, a count for each rejection, and the blockers.

    `rows.sweeps` maps sweep names to (cost, shares, vwap). Candidates carry what `matching_signals` reads, and execution_version,
    price_cap, target, daily_cap and station_date_cap, all but the first null where the default (for the price cap: entry_max) holds.
    """
    own = candidates.withColumns({
        "price_cap": F.coalesce("price_cap", "entry_max"), "target": F.coalesce("target", F.lit(defaults.target)), "daily_cap": F.coalesce("daily_cap", F.lit(defaults.daily_cap)),
        "station_date_cap": F.coalesce("station_date_cap", F.lit(defaults.station_date_cap)), "counts": F.col("execution_version") == defaults.execution_version})
    always = own.withColumns({"_since": F.col("activated_at"), "activated_at": F.lit("0001-01-01").cast("timestamp")})
    matched = matching_signals(rows, always.select("candidate_id", "family_id", "model_id", "market_family", "side", "entry_min", "entry_max", "edge_min", "activated_at", "complexity"))
    facts = own.select("candidate_id", "activated_at", "price_cap", "target", "daily_cap", "station_date_cap", "counts")
    matched = matched.join(facts, ["candidate_id"])
    since = F.col("ts") >= F.col("activated_at")
    seen = matched.groupBy("candidate_id").agg(F.sum((~since).cast("long")).alias("rows_before"), F.sum((since & F.col("counts")).cast("long")).alias("rows_since"))
    first = select.first_by_scope(matched.where(since & F.col("counts")), ["candidate_id", "station", "market_date"], [F.col(c) for c in ORDER])
    got = first.withColumn("_x", F.try_element_at("sweeps", sweep_key(F.col("price_cap"), F.col("target"))))
    cost = F.coalesce(F.col("_x.cost"), F.lit(0.0))
    known = F.when(F.col("_x").isNull(), REJECTIONS[0]).when((cost <= 0) | F.col("_x.vwap").isNull(), REJECTIONS[1])
    pnl = F.when(F.col("label") == 1, F.col("_x.shares") - cost).otherwise(-cost)
    row = F.struct(*ORDER, known.alias("reason"), cost.alias("cost"), pnl.alias("pnl"))
    # a date has a row a station at most
    dates = got.groupBy("candidate_id", "market_date", "daily_cap", "station_date_cap").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    kind = "array<struct<reason:string,cost:double,pnl:double>>"

    def step(acc: Column, r: Column) -> Column:
        reason = F.coalesce(r["reason"], F.when(acc["used"] + r["cost"] > F.col("daily_cap") + 1e-9, REJECTIONS[2]).when(r["cost"] > F.col("station_date_cap") + 1e-9, REJECTIONS[3]))
        used = acc["used"] + F.when(reason.isNull(), r["cost"]).otherwise(0.0)
        return F.struct(used.alias("used"), F.concat(acc["out"], F.array(F.struct(reason.alias("reason"), r["cost"].alias("cost"), r["pnl"].alias("pnl")))).alias("out"))

    run = dates.select("candidate_id", "market_date", F.explode(F.aggregate("_rows", F.struct(F.lit(0.0).alias("used"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])).alias("_r"))
    taken = F.col("_r.reason").isNull()
    score = run.groupBy("candidate_id").agg(
        F.sum(taken.cast("long")).alias("executed"), F.countDistinct(F.when(taken, F.col("market_date"))).alias("dates"), F.round(F.sum(F.when(taken, F.col("_r.cost"))), 8).alias("cost"),
        F.round(F.sum(F.when(taken, F.col("_r.pnl"))), 8).alias("pnl"), *[F.sum((F.col("_r.reason") == r).cast("long")).alias(r.lower()) for r in REJECTIONS])
    counts = ["rows_before", "rows_since", "executed", "dates", *[r.lower() for r in REJECTIONS]]
    out = own.select("candidate_id", "family_id", "counts").join(seen, ["candidate_id"], "left").join(score, ["candidate_id"], "left").fillna(0, counts)
    blockers = F.array_compact(F.array(F.when(~F.col("counts"), "EXECUTION_VERSION_MISMATCH"), F.when(F.col("rows_since") == 0, "NO_POST_ACTIVATION_MATCHING_DECISIONS"), *[F.lit(u) for u in UNMEASURED]))
    return out.withColumns({"rr": ratio(F.col("pnl"), F.col("cost")), "blockers": F.concat_ws(",", F.sort_array(blockers)), "disposition": F.lit("CONTINUE_COLLECTING")}).drop("counts")


def incremental_after_peer(subject: DataFrame, peer: DataFrame, station_cap: float, daily_cap: float, slice_by: Column, order: list[Column]) -> DataFrame:
    """Subject rows clipped to what the peer left of the station-date and daily caps.

    Clipping is a prefix sum: the station clip needs the cost before a row in its station-date, and the daily clip the
    station-clipped cost before it in its date; once a day is full everything later is zero either way. Two running sums, no fold.
    """
    used_sd = peer.groupBy("market_date", "station").agg(F.sum("cost").alias("_sd"))
    used_d = peer.groupBy("market_date").agg(F.sum("cost").alias("_d"))
    rows = subject.join(used_sd, ["market_date", "station"], "left").join(used_d, ["market_date"], "left").fillna(0.0, ["_sd", "_d"])
    rows = scan.running(rows, ["market_date", "station"], slice_by, order, {"_before": ("sum", F.col("cost"))}, inclusive=False)
    room = F.greatest(station_cap - F.col("_sd") - F.col("_before"), F.lit(0.0))
    rows = rows.withColumn("_c1", F.least(F.col("cost"), room))
    rows = scan.running(rows, ["market_date"], slice_by, order, {"_day": ("sum", F.col("_c1"))}, inclusive=False)
    left = F.greatest(daily_cap - F.col("_d") - F.col("_day"), F.lit(0.0))
    rows = rows.withColumn("admitted", F.least(F.col("_c1"), left)).where("admitted > 0")
    part = F.col("admitted") / F.col("cost")
    return rows.withColumns({"shares": F.col("shares") * part, "fill_fraction": F.col("fill_fraction") * part}).withColumn(
        "cost", F.col("admitted")).drop("_sd", "_d", "_before", "_c1", "_day", "admitted")


def shared_caps(executions: DataFrame, daily_cap: float, station_cap: float) -> DataFrame:
    """Candidates share one daily and station-date cap in activation order; a row that does not fit is rejected whole.

    Every cap key contains the date, so dates are independent and the fold runs per date over pruned rows.
    """
    run = folds.two_cap_fold(executions, ["market_date"], ["station"], ["activation_rank", *ORDER], "cost", daily_cap, station_cap, F.col("activation_rank"))
    return run.withColumn("cap_reason", F.when(F.col("cap_reason") == "OUTER_CAP", "SHARED_DAILY_RISK_CAP").when(
        F.col("cap_reason") == "INNER_CAP", "SHARED_STATION_DATE_CAP"))


@dataclass(frozen=True)
class PortfolioCaps:
    order: float = 50.0
    daily: float = 500.0
    station_date: float = 150.0
    side: float = 120.0
    bucket: float = 80.0
    minimum: float = 5.0


SKIPS = ("CAPACITY", "DEPTH")


def portfolio_replay(rows: DataFrame, caps: PortfolioCaps) -> DataFrame:
    """Allocate positions of all specs, in spec order inside a date, under five shared caps, depth and a minimum order.

    Rows carry spec_rank, target, depth, entry, pnl and the cap keys; rows without a price or result are no candidates. Every other
    row comes back with what it was given and, if that is nothing, why: no room in some cap or less than the minimum (CAPACITY), or
    room but nothing to buy (DEPTH).

    A date's rows stream through one sorted pass that holds the exposure alone: every cap has the date in its key.
    """
    wanted = F.least(F.col("target"), F.lit(caps.order), F.col("depth"))
    usable = rows.where((F.col("entry") > 0) & F.col("pnl").isNotNull()).withColumn("wanted", wanted)
    order = ["spec_rank", *ORDER]
    minimum, limits = caps.minimum, (caps.daily, caps.station_date, caps.side, caps.bucket)

    def step(state, value):
        want, depth, family, station, bucket_label, side = value
        keys = (("d",), ("sd", family, station), ("sds", family, station, side), ("b", family, station, bucket_label, side))
        room = max(0.0, min(limit - state.get(k, 0.0) for k, limit in zip(keys, limits)))
        size = min(want, room)
        if size < minimum or size <= 0:
            return 0.0, "DEPTH" if room > 0 and depth <= 0 else "CAPACITY"
        for k in keys:
            state[k] = state.get(k, 0.0) + size
        return size, None

    run = folds.ordered_fold(usable, ["market_date"], order, dict, step, ["wanted", "depth", "market_family", "station", "selected_bucket", "selected_side"], "allocated double, skip string")
    return run.withColumn("pnl_usd", F.when(F.col("allocated") > 0, F.col("pnl") / F.col("entry") * F.col("allocated")))


def portfolio_summary(rows: DataFrame, allocated: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per spec, with the rows that were no candidates, found no capacity or found no depth."""
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    got = F.col("allocated") > 0
    run = allocated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidate_rows"), F.sum(got.cast("int")).alias("allocated_rows"), F.sum("allocated").alias("risk_usd"), F.sum("pnl_usd").alias("pnl_usd"), F.sum((F.col("pnl_usd") > 0).cast("int")).alias("wins"),
        *[F.sum((F.col("skip") == s).cast("int")).alias(f"skipped_{s.lower()}_rows") for s in SKIPS], F.avg(F.when(got, F.col("entry"))).alias("avg_entry"), F.avg(F.when(got, F.col("depth"))).alias("avg_depth"))
    return base.join(run, keys, "left").fillna(0, ["candidate_rows", "allocated_rows", "wins", *[f"skipped_{s.lower()}_rows" for s in SKIPS]]).fillna(0.0, ["risk_usd", "pnl_usd"])


# ---- roles ----

def transition_decisions(cards: DataFrame, z: float = 1.645, station_share: float = 0.5, date_share: float = 0.5) -> DataFrame:
    """Booleans and one ordered decision per scorecard row (base and conservative columns side by side)."""
    negative = F.col("enough_evidence") & (F.col("venue_resolved") > 0) & ((F.col("base_pnl") <= 0) | (F.col("conservative_pnl") <= 0))
    hard = (F.col("disagreements") > 0) | F.col("blockers").rlike("(^|[^A-Z_])INVALID_OR_MISSING_")
    def sure(name: str) -> Column:
        return (F.col(f"{name}_cost") > 0) & (F.col(f"{name}_pnl") > 0) & (F.col(f"{name}_mean") - z * F.col(f"{name}_se") > 0)
    ready = (F.col("review_state") == "READY") & (F.col("blockers") == "") & sure("base") & sure("conservative") & (
        F.col("max_station_share") <= station_share) & (F.col("max_market_date_share") <= date_share)
    rows = cards.withColumns({"hard_rejection": F.coalesce(hard, F.lit(False)), "negative_economics": F.coalesce(negative, F.lit(False)),
                              "promotion_ready": F.coalesce(ready, F.lit(False))})
    return rows.withColumn("decision", F.when(F.col("hard_rejection"), "REJECT").when(F.col("negative_economics"), "DEGRADE").when(
        F.col("promotion_ready"), "PROMOTE").otherwise("CONTINUE"))


def rank_candidates(decisions: DataFrame) -> DataFrame:
    """Best promotable candidate per family: conservative then base ratio, then the simpler rule."""
    order = [F.col("conservative_rr").desc_nulls_last(), F.col("base_rr").desc_nulls_last(), F.col("complexity"), F.col("candidate_id")]
    return select.first_by_scope(decisions.where("promotion_ready"), ["family_id"], order)


def role_transitions(roles: DataFrame, decisions: DataFrame, common: DataFrame, min_rr_delta: float = 0.02, retire_after: int = 2) -> DataFrame:
    """Event rows per family: reject, degrade or retire, assign a champion, or replace the incumbent. Nothing is applied.

    `roles`: candidate_id, family_id, role, negative_streak. `common`: candidate_id, peer_id, pnl_delta, rr_delta, simpler. A family with
    two champions is an error row.
    """
    rows = roles.join(decisions.drop("family_id"), ["candidate_id"], "left").fillna(False, ["hard_rejection", "negative_economics", "promotion_ready"])
    champions = roles.where("role = 'CHAMPION'").groupBy("family_id").agg(F.count(F.lit(1)).alias("champions"), F.min("candidate_id").alias("incumbent"))
    best = rank_candidates(rows.where("role <> 'CHAMPION'")).select(F.col("family_id"), F.col("candidate_id").alias("challenger"))
    rows = rows.join(champions, ["family_id"], "left").join(best, ["family_id"], "left").fillna(0, ["champions"])
    versus = common.select(F.col("candidate_id"), F.col("peer_id").alias("incumbent"), "pnl_delta", "rr_delta", "simpler")
    rows = rows.join(versus, ["candidate_id", "incumbent"], "left")
    beats = (F.col("pnl_delta") > 0) & ((F.col("rr_delta") >= min_rr_delta) | ((F.col("rr_delta") >= 0) & F.col("simpler")))
    mine = F.col("candidate_id") == F.col("challenger")
    event = (
        F.when(F.col("champions") > 1, "ERROR_MULTIPLE_CHAMPIONS").when(F.col("hard_rejection"), "REJECT")
        .when(F.col("negative_economics") & (F.col("negative_streak") + 1 >= retire_after), "RETIRE").when(F.col("negative_economics"), "DEGRADE")
        .when(mine & (F.col("champions") == 0), "ASSIGN_CHAMPION").when(mine & F.coalesce(beats, F.lit(False)), "REPLACE_INCUMBENT"))
    return rows.withColumn("event", event).where("event is not null").select("family_id", "candidate_id", "role", "event")


def active_candidates(versions: DataFrame, events: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Versions whose latest lifecycle event leaves them in one of the roles."""
    latest = select.latest_by(events, ["candidate_id"], ["at", "seq"])
    return versions.join(latest.select("candidate_id", "to_role", "at", "seq"), ["candidate_id"]).where(F.col("to_role").isin(*roles))


def latest_scorecards(cards: DataFrame, kind: str) -> DataFrame:
    return select.latest_by(cards.where(F.col("kind") == kind), ["candidate_id"], ["at", "seq"])


# ---- baskets ----

def top_n_basket(snapshots: DataFrame, n: int, won: Column | None = None) -> DataFrame:
    """The n best tradable buckets of each snapshot by (-fair, ask, label); snapshots with fewer are dropped.

    Candidates stay an array on their snapshot (a ladder is short), so the choice is a sort inside the row: no shuffle. The chosen
    are exploded out of an array of one entry or none: a test on them would be pushed below their projection and sort every row twice.
    `won(bucket label, final)` decides the hit over the column `final`.
    """
    good = F.filter("candidates", lambda c: c["bucket"].isNotNull() & (c["fair_yes"] >= 0) & (c["yes_ask"] > 0) & (c["yes_ask"] < 1))
    keyed = F.transform(good, lambda c: F.struct((-c["fair_yes"]).alias("a"), c["yes_ask"].alias("b"), c["bucket"].alias("c"), c["won"].alias("w")))
    best = F.when(F.size("candidates") >= n, F.array(F.slice(F.sort_array(keyed), 1, n)))
    rows = snapshots.withColumn("_best", best).select("*", F.explode(F.filter("_best", lambda t: F.size(t) == n)).alias("_top"))
    top = [F.get("_top", F.lit(i)) for i in range(n)]
    asks = reduce(lambda total, t: total + t["b"], top, F.lit(0.0))
    fair = reduce(lambda total, t: total - t["a"], top, F.lit(0.0))
    return rows.withColumns({"ask_sum": asks, "fair_mass": fair, "basket_edge": fair - asks, "hit": reduce(lambda any_won, t: any_won | t["w"], top, F.lit(False)),
                             "buckets": F.col("_top")["c"]}).drop("_best", "_top", "candidates")


def select_baskets(df: DataFrame, selector: str, scope: list[str]) -> DataFrame:
    orders = {
        "first_eligible": [F.col("ts"), F.col("snapshot_id")],
        "best_edge_intraday": [F.col("basket_edge").desc(), F.col("ask_sum"), F.col("ts").desc(), F.col("snapshot_id")],
        "cheapest_intraday": [F.col("ask_sum"), F.col("basket_edge").desc(), F.col("ts"), F.col("snapshot_id")]}
    return select.first_by_scope(df, scope, orders[selector])


def basket_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    pnl = F.when(F.col("hit"), 1.0).otherwise(0.0) - F.col("ask_sum")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.sum("ask_sum").alias("risk"), F.sum(pnl).alias("pnl"),
        ratio(F.sum(pnl), F.sum("ask_sum")).alias("rr"), sharpe(pnl).alias("sharpe"), F.avg("fair_mass").alias("avg_fair_mass"), F.avg("basket_edge").alias("avg_edge"))


def basket_grid(baskets: DataFrame, scope: list[str], edges: list[float], max_asks: list[float]) -> DataFrame:
    """Summary of the first eligible basket per scope under every pair of thresholds."""
    grid = F.array(*[F.struct(F.lit(e).alias("edge_min"), F.lit(a).alias("ask_max")) for e in edges for a in max_asks])
    ok = F.filter(grid, lambda g: (F.col("basket_edge") >= g["edge_min"]) & (F.col("ask_sum") <= g["ask_max"]))
    rows = baskets.withColumn("_g", F.explode(ok)).select("*", "_g.*").drop("_g")
    first = select_baskets(rows, "first_eligible", ["edge_min", "ask_max", *scope])
    return basket_summary(first, ["edge_min", "ask_max"])


def consensus_ladder(candidates: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """Buckets every model prices: mean fair, newest ask."""
    rows = candidates.where(F.col("model_name").isin(*models)).groupBy(*keys, "bucket", "model_name").agg(
        F.max_by(F.struct("fair_yes", "yes_ask", "ts", "snapshot_id"), F.struct("ts", "snapshot_id")).alias("r"))
    return rows.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("r.fair_yes").alias("fair_yes"), F.max_by("r.yes_ask", F.struct("r.ts", "r.snapshot_id")).alias("yes_ask")
    ).where(F.col("_n") == len(models)).drop("_n")


def bucket_examples(snapshots: DataFrame) -> DataFrame:
    """Labelled candidate buckets of the snapshots in which exactly one bucket wins; the count stays inside the row."""
    wins = F.aggregate("candidates", F.lit(0), lambda a, c: a + F.coalesce(c["won"].cast("int"), F.lit(0)))
    return snapshots.where(wins == 1).select("*", F.explode("candidates").alias("c")).drop("candidates").select("*", "c.*").drop("c")


def mark_to_latest(positions: DataFrame, markets: DataFrame, book_rows: DataFrame) -> DataFrame:
    """Bid less entry of the side's token, by the newest book row (largest id) of each token."""
    latest = book_rows.groupBy("token_id").agg(F.max_by("best_bid", "book_id").alias("bid"), F.max("book_id").alias("latest_book_id"))
    rows = positions.join(markets, ["market_id"], "left")
    token = F.when(F.col("selected_side") == "BUY_YES", F.col("yes_token")).when(F.col("selected_side") == "BUY_NO", F.col("no_token"))
    return rows.withColumn("token_id", token).join(latest, ["token_id"], "left").withColumn("mark", F.col("bid") - F.col("entry"))


# What a bucket's better side must show for each strategy, unless other limits are given.
STRATEGIES = {
    "HIGH_CONVICTION": {"min_probability": 0.75, "min_edge": 0.10},
    "TAIL": {"min_probability": 0.08, "max_probability": 0.25, "max_ask": 0.10, "min_relative_value": 2.0, "min_edge": 0.05},
    "BEST_BUCKET": {},
    "MAX_SO_FAR": {},
}


def select_strategy(rows: DataFrame, keys: list[str], strategy: str, ties: list[Column], limits: dict[str, float] | None = None) -> DataFrame:
    """One bucket per group, with its better side as best_side, best_fair, best_edge and best_ask.

    Rows are buckets with fair, entry and edge of YES, the same with `_no` for NO, and holds_progress. BEST_BUCKET takes the
    highest YES probability and MAX_SO_FAR the bucket that holds the progress value; the others take the largest edge among
    buckets whose better side (YES where equal, or where NO has no edge) keeps the limits.
    """
    known = STRATEGIES[strategy] | (limits or {})
    yes = F.coalesce(F.col("edge") >= F.col("edge_no"), F.col("edge_no").isNull())
    rows = rows.withColumns({"best_side": F.when(yes, "BUY_YES").otherwise("BUY_NO"), **{f"best_{n}": F.when(yes, F.col(c)).otherwise(F.col(f"{c}_no")) for n, c in (("fair", "fair"), ("edge", "edge"), ("ask", "entry"))}})
    if strategy == "BEST_BUCKET":
        return select.first_by_scope(rows, keys, [F.col("fair").desc_nulls_last(), *ties])
    if strategy == "MAX_SO_FAR":
        return select.first_by_scope(rows.where("holds_progress"), keys, ties)
    tests = {
        "min_probability": lambda v: F.col("best_fair") >= v, "max_probability": lambda v: F.col("best_fair") <= v, "max_ask": lambda v: F.col("best_ask") <= v,
        "min_relative_value": lambda v: F.col("best_fair") / F.col("best_ask") >= v, "min_edge": lambda v: F.col("best_edge") >= v}
    for name, value in known.items():
        rows = rows.where(tests[name](value))
    return select.first_by_scope(rows, keys, [F.col("best_edge").desc_nulls_last(), *ties])
