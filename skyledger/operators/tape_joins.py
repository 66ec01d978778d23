"""Causal joins of decisions to the order-book tape. Every row keeps its place; what fails gets a named reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators import books, intervals, ranks, scan
from skyledger.operators.asof import asof_join, both_sides
from skyledger.session import materialize


def coverage_states(validity: DataFrame) -> DataFrame:
    """Coverage after each event: VALID with a valid book, GAPPED once it was lost, RESYNCING before the first one."""
    state = F.when(F.col("valid"), "VALID").when(F.col("epoch").isNotNull(), "GAPPED").otherwise("RESYNCING")
    return validity.withColumn("coverage", state)


def coverage_intervals(validity: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Coverage runs per token; a run is closed by the next transition and the last one stays open."""
    runs = intervals.state_intervals(
        coverage_states(validity), keys or ["token_id"], "received_at", [F.col("received_at"), F.col("receipt_sequence")], "coverage")
    return runs.withColumn("interval_id", F.unix_micros("started_at"))


def invalid_reason(no_events: Column, book_valid: Column, termination: Column, first_visible: Column, observed: Column,
                   end_book_valid: Column, interval_end_us: Column, required_end: Column) -> Column:
    """Ordered reasons a decision has no usable tape; null means valid."""
    timed = termination.isNotNull()
    return F.coalesce(
        F.when(no_events, F.lit("no_tape_events")),
        F.when(book_valid.isNull(), F.lit("no_reconstructable_book_at_quote_ready")),
        F.when(~book_valid, F.lit("invalid_book_at_quote_ready")),
        F.when(~timed & first_visible.isNull(), F.lit("no_visible_event_after_quote_ready")),
        F.when(timed & (observed.isNull() | (observed < termination)), F.lit("quote_termination_not_observed")),
        F.when(timed & ~F.coalesce(end_book_valid, F.lit(False)), F.lit("invalid_book_at_quote_termination")),
        F.when(interval_end_us.isNull() | required_end.isNull() | (interval_end_us < F.unix_micros(required_end)),
               F.lit("insufficient_continuous_valid_coverage")),
    )


def join_decisions_to_tape(decisions: DataFrame, validity: DataFrame, coverage: DataFrame, pre_signal_seconds: int = 60) -> DataFrame:
    """Book state at quote-ready, first visible event after it and the coverage interval begun early enough.

    `decisions`: decision_id, session_id, token_id, finished_at, latency_ms, termination (nullable). The ready and the
    termination instants are probed together in one backward-and-forward as-of over the tape, then folded back to one row
    per decision; nothing is paired per event.
    """
    state = validity.select("token_id", "received_at", "receipt_sequence", "valid")
    rows = decisions.withColumn("quote_ready", F.timestamp_micros(F.unix_micros("finished_at") + F.col("latency_ms") * 1000))
    probes = rows.select("decision_id", "token_id", F.explode(F.array(
        F.struct(F.lit("ready").alias("k"), F.col("quote_ready").alias("at")),
        F.struct(F.lit("end").alias("k"), F.col("termination").alias("at")))).alias("_p")).select("decision_id", "token_id", "_p.*")
    seen = both_sides(probes.where("at is not null"), state, ["token_id"], F.col("at"), F.col("received_at"),
                      {"valid": F.col("valid"), "seq": F.col("receipt_sequence")}, tie=[F.col("receipt_sequence")])
    ready, end = F.col("k") == "ready", F.col("k") == "end"
    per = seen.groupBy("decision_id").agg(
        F.max(F.when(ready, F.col("before.valid"))).alias("book_valid"), F.max(F.when(ready, F.col("after.seq"))).alias("first_visible_event"),
        F.max(F.when(ready, F.timestamp_micros(F.col("after._rt")))).alias("first_visible_at"),
        F.max(F.when(end, F.col("before.valid"))).alias("end_book_valid"))
    valid = coverage.where("state = 'VALID'").select(
        "token_id", "started_at", F.coalesce(F.unix_micros("ended_at"), F.lit(2**62)).alias("_end"), "interval_id")
    start_by = F.timestamp_micros(F.unix_micros("quote_ready") - pre_signal_seconds * 1_000_000)
    rows = asof_join(rows, valid, ["token_id"], start_by, F.col("started_at"),
                     {"coverage_end_us": F.col("_end"), "coverage_interval_id": F.col("interval_id")}, tie=[F.col("interval_id")]).drop("matched_us")
    sessions = validity.groupBy("session_id").agg(F.max("received_at").alias("observed_through"))
    rows = rows.join(per, ["decision_id"], "left").join(sessions, ["session_id"], "left")
    required = F.coalesce("termination", "first_visible_at")
    reason = invalid_reason(F.col("observed_through").isNull(), F.col("book_valid"), F.col("termination"), F.col("first_visible_at"),
                            F.col("observed_through"), F.col("end_book_valid"), F.col("coverage_end_us"), required)
    return rows.withColumn("reason", reason).withColumn("coverage_valid", F.col("reason").isNull())


def book_at_post_ready(decisions: DataFrame, checkpoints: DataFrame, coverage: DataFrame, pre_seconds: int = 60,
                       max_delay_seconds: float = 30.0) -> DataFrame:
    """First checkpoint at or after ready within the delay bound, inside one VALID interval begun before ready.

    `decisions` need token_id and quote_ready. Adds the execution time and delay, or a reason, and what else `checkpoints` hold: books are
    looked up for the checkpoint that was found, and never carried through the search for it.
    """
    sides = [c for c in ("bids", "asks") if c in checkpoints.columns]
    carried = [c for c in checkpoints.columns if c not in ("token_id", "epoch", "event_number", "captured_at", *sides)]
    rows = asof_join(decisions, checkpoints, ["token_id"], F.col("quote_ready"), F.col("captured_at"),
                     {c: F.col(c) for c in carried}, "forward", tie=[F.col("event_offset")])
    rows = materialize(rows)
    delay = (F.col("matched_us") - F.unix_micros("quote_ready")) / 1e6
    rows = rows.withColumns({"execution_delay_s": delay, "execution_at": F.timestamp_micros("matched_us")})
    valid = coverage.where("state = 'VALID'").withColumnRenamed("interval_id", "coverage_id")
    start_by = F.timestamp_micros(F.unix_micros("quote_ready") - pre_seconds * 1_000_000)
    rows = intervals.covering_interval(rows, valid.select("token_id", "started_at", "ended_at", "coverage_id"), ["token_id"],
                                       start_by, F.col("matched_us"), "started_at", "ended_at", "coverage_id")
    reason = (
        F.when(F.col("matched_us").isNull(), "no_post_ready_checkpoint")
        .when(F.col("execution_delay_s") > max_delay_seconds, "post_ready_checkpoint_delay_exceeded")
        .when(F.col("interval_id").isNull(), "no_continuous_valid_interval_through_execution"))
    rows = rows.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    if sides:
        books_of = checkpoints.groupBy("token_id", "event_offset").agg(*[F.first(c).alias(c) for c in sides])
        rows = rows.join(books_of, ["token_id", "event_offset"], "left")
    return rows.withColumns({c: F.when(ok, F.col(c)) for c in (*sides, "execution_at", "execution_delay_s")}).drop(
        "matched_us", "interval_start", "latest_interval_end_us")


def book_at_exact(decisions: DataFrame, checkpoints: DataFrame, coverage: DataFrame, events: DataFrame,
                  pre_seconds: int = 60) -> DataFrame:
    """Book at ready itself: a VALID interval spans [ready-pre, ready], the latest checkpoint inside it is the seed and the
    level updates in (seed, ready] are applied, so a decision reads only the events since its seed."""
    valid = coverage.where("state = 'VALID'").withColumnRenamed("interval_id", "coverage_id")
    ready_us = F.unix_micros("quote_ready")
    rows = intervals.covering_interval(
        decisions, valid.select("token_id", "started_at", "ended_at", "coverage_id"), ["token_id"],
        F.timestamp_micros(ready_us - pre_seconds * 1_000_000), ready_us, "started_at", "ended_at", "coverage_id")
    rows = asof_join(materialize(rows), checkpoints, ["token_id"], F.col("quote_ready"), F.col("captured_at"),
                     {"_bids": F.col("bids"), "_asks": F.col("asks"), "_seed": F.col("event_offset")}, tie=[F.col("event_offset")])
    seeded = F.col("matched_us").isNotNull() & (F.col("matched_us") >= F.unix_micros("interval_start"))
    rows = rows.withColumn("reason", F.when(F.col("interval_id").isNull(), "no_continuous_valid_interval").when(
        ~F.coalesce(seeded, F.lit(False)), "no_seed_checkpoint"))
    rows = materialize(rows)
    good = rows.where("reason is null").select("decision_id", "token_id", "quote_ready", "matched_us", "_seed", "_bids", "_asks")
    parsed = books.parse_events(events, strict=True)
    since = intervals.bucketed_range_join(
        parsed.select("token_id", "receipt_sequence", "received_at", "is_full", "is_delta", "bad_reason", "delta_side", "delta_price", "delta_size", "_p"),
        good.select("token_id", "decision_id", "_seed", F.col("matched_us").alias("_from"), F.unix_micros("quote_ready").alias("_to")),
        ["token_id"], F.unix_micros("received_at"), F.col("_from"), F.col("_to")).where(F.col("receipt_sequence") > F.col("_seed"))
    broken = since.groupBy("decision_id").agg(F.max(F.col("bad_reason").isNotNull().cast("int")).alias("_broken"))

    def seed_levels(column: str, side: str) -> DataFrame:
        return good.select("decision_id", F.lit(-1).cast("long").alias("q"), F.lit(side).alias("side"), F.explode(column).alias("l")).select(
            "decision_id", "q", "side", F.col("l.price").alias("price"), F.col("l.size").alias("size"))
    moves = since.where("is_delta").select("decision_id", F.col("receipt_sequence").alias("q"), F.col("delta_side").alias("side"),
                                          F.col("delta_price").cast("double").alias("price"), F.col("delta_size").cast("double").alias("size"))
    levels = seed_levels("_bids", "BUY").unionByName(seed_levels("_asks", "SELL")).unionByName(moves)
    last = levels.groupBy("decision_id", "side", "price").agg(F.max_by("size", "q").alias("size")).where("size > 0")
    arrays = books._arrays(last, ["decision_id"])
    out = rows.drop("_bids", "_asks", "_seed").join(arrays, ["decision_id"], "left").join(broken, ["decision_id"], "left")
    out = out.withColumn("reason", F.coalesce("reason", F.when(F.col("_broken") == 1, "invalid_event_after_checkpoint")))
    return out.withColumn("checkpoint_age_s", (F.unix_micros("quote_ready") - F.col("matched_us")) / 1e6).withColumns({
        c: F.when(F.col("reason").isNull(), F.coalesce(F.col(c), F.array().cast(books.BOOK_LEVEL))) for c in ("bids", "asks")}).drop(
        "matched_us", "_broken", "interval_start", "latest_interval_end_us")


# fixed values: markout horizons in seconds.
MARKOUT_SECONDS = {"10s": 10, "30s": 30, "2m": 120, "10m": 600}


def markouts(quotes: DataFrame, quotes_at: str, rows: DataFrame, rows_at: str, horizons: dict[str, int] | None = None,
             tie: list[Column] | None = None) -> DataFrame:
    """First best-bid/ask row at or after quote time plus each horizon, and its midpoint against the quote price."""
    grid = F.array(*[F.struct(F.lit(n).alias("horizon"), F.lit(s).alias("secs")) for n, s in (horizons or MARKOUT_SECONDS).items()])
    asked = quotes.withColumn("_h", F.explode(grid)).withColumns({
        "horizon": F.col("_h.horizon"), "_at": F.timestamp_micros(F.unix_micros(quotes_at) + F.col("_h.secs").cast("long") * 1_000_000)}).drop("_h")
    hit = asof_join(asked, rows, ["token_id"], F.col("_at"), F.col(rows_at),
                    {"mark_bid": F.col("best_bid"), "mark_ask": F.col("best_ask")}, "forward", tie=tie)
    mid = (F.col("mark_bid") + F.col("mark_ask")) / 2
    return hit.withColumns({
        "status": F.when(F.col("matched_us").isNull(), "pending").otherwise("available"), "mid": mid,
        "mid_markout": mid - F.col("quote_price"), "bid_markout": F.col("mark_bid") - F.col("quote_price")}).drop("_at", "matched_us")


def feed_summary(decisions: DataFrame, events: DataFrame, types: list[str], span_seconds: int = 300) -> DataFrame:
    """Event counts by type, adds, cancels and the latest quotes in the trailing window of each decision.

    Counts are differences of running sums and the latest values are as-of lookups with the window as tolerance, so a
    busy token costs its events once.
    """
    span = span_seconds * 1_000_000
    measures = {"event_count": F.lit(1), **{f"n_{t}": (F.col("event_type") == t).cast("int") for t in types},
                "adds": (F.col("size") > 0).cast("int"), "cancels": (F.col("size") <= 0).cast("int")}
    counts = intervals.trailing_totals(decisions, events, ["token_id"], "decision_id", F.unix_micros("decided_at"),
                                       F.unix_micros("received_at"), span, measures)
    rows = decisions.select("decision_id", "token_id", "decided_at")
    for name in ("best_bid", "best_ask"):
        rows = asof_join(rows, events.where(F.col(name).isNotNull()), ["token_id"], F.col("decided_at"), F.col("received_at"),
                         {f"latest_{name}": F.col(name)}, tolerance_us=span, tie=[F.col("receipt_sequence")]).drop("matched_us")
    counts = counts.withColumn("decision_id", F.col("decision_id").cast(decisions.schema["decision_id"].dataType))
    return rows.join(counts.select("decision_id", *[F.col(m).cast("long").alias(m) for m in measures]), ["decision_id"], "left")


def label_quotes(quotes: DataFrame, events: DataFrame, span_bucket_us: int = 600_000_000) -> DataFrame:
    """Fill labels of passive quotes from the events in [quote, expiry] of their token.

    `quotes`: quote_id, token_id, quoted_at, expires_at, quote_price, size_usd, queue_usd. Events: price, size, side,
    event_type, best_bid, best_ask. The joined rows go straight into sums, flags and counts.
    """
    joined = intervals.bucketed_range_join(
        events, quotes, ["token_id"], F.unix_micros("received_at"), F.unix_micros("quoted_at"), F.unix_micros("expires_at"), span_bucket_us)
    q = F.col("quote_price")
    selling = F.col("event_type").isin("last_trade_price", "trade", "match") | F.upper("side").isin("SELL", "ASK")
    flow = F.when((F.col("price") <= q + 1e-9) & selling, F.abs(F.col("price") * F.col("size"))).otherwise(0.0)
    touch = F.coalesce(F.col("best_bid") >= q - 1e-9, F.lit(False)) | F.coalesce(F.col("best_ask") <= q + 1e-9, F.lit(False))
    adverse = F.coalesce(F.col("best_bid") <= q - 0.02, F.lit(False))
    per = joined.groupBy("quote_id").agg(
        F.sum(flow).alias("_flow"), F.max(touch.cast("int")).alias("_touch"), F.max(adverse.cast("int")).alias("_adverse"),
        F.count(F.lit(1)).alias("_n"))
    rows = quotes.join(per, ["quote_id"], "left")
    flow_usd = F.round(F.coalesce("_flow", F.lit(0.0)), 6)
    rows = rows.withColumns({"sell_flow_usd": flow_usd, "event_count": F.coalesce("_n", F.lit(0))})
    sized = F.col("size_usd") > 0
    return rows.withColumns({
        "conservative_fill": sized & (F.col("sell_flow_usd") >= F.col("queue_usd") + F.col("size_usd")),
        "base_fill": sized & (F.col("sell_flow_usd") >= F.col("queue_usd") + F.col("size_usd") * 0.5),
        "optimistic_fill": (F.coalesce("_touch", F.lit(0)) == 1) | (F.col("sell_flow_usd") > 0),
        "adverse_move": F.coalesce("_adverse", F.lit(0)) == 1}).drop("_flow", "_touch", "_adverse", "_n")


# fixed values: edge-decay offsets in seconds.
DECAY_SECONDS = (0, 5, 15, 30, 60, 120, 300, 600, 900)


def edge_decay_points(decisions: DataFrame, checkpoints: DataFrame, coverage: DataFrame, target: float = 25.0, reserve: float = 0.0,
                      offsets: tuple[int, ...] = DECAY_SECONDS, max_delay_seconds: float = 30.0) -> DataFrame:
    """Executable edge at fixed offsets after ready; an offset without a usable book is right-censored with its reason.

    Each book is swept once, where it is made, and only cost and price of that go on.
    """
    swept = materialize(checkpoints.withColumn("_s", books.sweep_asks(F.col("asks"), F.lit(1.0), F.lit(target))).select(
        "token_id", "event_offset", "captured_at", F.col("_s.cost").alias("_cost"), F.col("_s.vwap").alias("_vwap")))
    grid = decisions.withColumn("offset_seconds", F.explode(F.array(*[F.lit(o) for o in offsets])))
    moved = grid.withColumn("quote_ready", F.timestamp_micros(F.unix_micros("quote_ready") + F.col("offset_seconds").cast("long") * 1_000_000))
    rows = book_at_post_ready(moved, swept, coverage, 60, max_delay_seconds)
    ok = F.col("reason").isNull()
    full = ok & (F.col("_cost") >= target - 1e-6)
    return rows.withColumns({
        "status": F.when(ok, "VALID").otherwise("RIGHT_CENSORED"), "fillable_usd": F.when(ok, F.col("_cost")),
        "net_edge": F.when(full, F.col("fair") - reserve - F.col("_vwap"))}).drop("_cost", "_vwap")


def edge_decay(points: DataFrame, target: float = 25.0) -> DataFrame:
    """Valid, fillable and censored counts and the net edge by offset."""
    ok = (F.col("status") == "VALID") & F.col("net_edge").isNotNull()
    edge = F.when(ok, F.col("net_edge"))
    # the median is the mean of the middle one or two edges, found by running counts over slices of the edge
    points = materialize(points.select("offset_seconds", "status", "net_edge"))
    kept = points.where(ok).select("offset_seconds", "net_edge")
    middles = ranks.median(kept, ["offset_seconds"], "net_edge", F.floor(F.col("net_edge") * 256), "median_net_edge")
    out = points.groupBy("offset_seconds").agg(
        F.count(F.lit(1)).alias("selected_rows"), F.sum((F.col("status") == "VALID").cast("int")).alias("valid_rows"),
        F.count(edge).alias("fillable_rows"), (F.count(F.lit(1)) - F.count(edge)).alias("censored_rows"),
        F.avg(edge).alias("mean_net_edge"), F.avg((edge > 0).cast("double")).alias("positive_rate"))
    return out.join(middles, ["offset_seconds"], "left")


def censor_reasons(points: DataFrame) -> DataFrame:
    out = points.where(~((F.col("status") == "VALID") & F.col("net_edge").isNotNull()))
    return out.groupBy("offset_seconds", F.coalesce("reason", F.lit("UNFILLABLE")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def edge_half_life(points: DataFrame) -> DataFrame:
    """First offset at half the initial edge, time to a non-positive edge, and whether anything was censored."""
    edges = F.collect_list(F.when(F.col("net_edge").isNotNull(), F.struct(F.col("offset_seconds").alias("at"), F.col("net_edge").alias("edge"))))
    per = points.groupBy("decision_id").agg(  # a decision has as many points as there are offsets
        F.max(F.when(F.col("offset_seconds") == 0, F.col("net_edge"))).alias("initial_edge"), edges.alias("_edges"),
        (F.max((F.col("status") != "VALID").cast("int")) == 1).alias("_censored"))
    first = F.col("initial_edge")

    def earliest(bound: Column) -> Column:
        return F.array_min(F.transform(F.filter("_edges", lambda p: p["edge"] <= bound), lambda p: p["at"]))
    return per.select(
        "decision_id", "initial_edge", F.when(first > 0, earliest(first / 2)).alias("half_life_seconds"),
        F.when(first > 0, earliest(F.lit(0.0))).when(first <= 0, F.lit(0)).alias("nonpositive_seconds"),
        (first.isNull() | F.col("_censored")).alias("right_censored"))


def tape_lifecycle(tokens: DataFrame, coverage: DataFrame, cohort_end: Column, max_gap_seconds: float = 30.0) -> DataFrame:
    """Per market: tokens whose valid coverage runs from discovery to the market end within the gap budget.

    `tokens`: market_id, token_id, discovered_at, market_end. `coverage`: token_id, started_at, ended_at of VALID intervals.
    A gap is measured from the furthest end seen so far; a tail that never reaches the end counts as a gap.
    """
    ivs = coverage.join(tokens, ["token_id"]).withColumns({
        "_s": F.unix_micros("started_at"), "_e": F.unix_micros(F.coalesce("ended_at", "market_end")),
        "_from": F.unix_micros("discovered_at"), "_to": F.unix_micros("market_end")})
    run = scan.running(ivs, ["token_id"], scan.day_slice(F.col("started_at")), [F.col("_s"), F.col("_e")],
                       {"_reach": ("max", F.col("_e"))}, inclusive=False)
    cursor = F.greatest(F.col("_from"), F.coalesce("_reach", F.col("_from")))
    used = (F.col("_e") >= cursor) & (cursor < F.col("_to"))
    gap = F.when(used, F.greatest(F.lit(0), F.col("_s") - cursor) / 1e6)
    per = run.groupBy("token_id").agg(F.max(gap).alias("_gap"), F.max("_e").alias("_last"))
    rows = tokens.join(per, ["token_id"], "left")
    start, stop = F.unix_micros("discovered_at"), F.unix_micros("market_end")
    has = F.col("_last").isNotNull() & (stop > start)
    end_at = F.greatest(F.coalesce("_last", start), start)
    tail = F.when(end_at < stop, (stop - end_at) / 1e6)
    rows = rows.withColumns({
        "matured": F.col("market_end") <= cohort_end,
        "_worst": F.when(has, F.greatest(F.coalesce("_gap", F.lit(0.0)), F.coalesce(tail, F.lit(0.0)))),
        "_whole": has & (F.coalesce("_gap", F.lit(0.0)) <= max_gap_seconds) & tail.isNull()})
    matured = F.min(F.col("matured").cast("int")) == 1
    ok = F.sum(F.col("_whole").cast("int"))
    return rows.groupBy("market_id").agg(
        F.count(F.lit(1)).alias("tokens"), F.when(matured, "MATURED").otherwise("RIGHT_CENSORED").alias("cohort_status"),
        F.when(matured, ok).otherwise(0).cast("long").alias("valid_through_end"), F.when(matured, F.max("_worst")).alias("max_gap_seconds"),
        (matured & (ok == F.count(F.lit(1)))).alias("complete"))


def subscription_generations(listings: DataFrame, session: str, refresh: str, token: str) -> DataFrame:
    """Membership generations per session: a refresh opens a new one only when its token set differs from the one before.

    A refresh's set is compared by count and two additive hashes, so sets are never gathered.
    """
    members = listings.select(session, refresh, token).distinct()
    a, b = F.xxhash64(token).cast("decimal(38,0)"), F.xxhash64(F.lit("b"), token).cast("decimal(38,0)")
    sets = members.groupBy(session, refresh).agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b")).alias("_set"))
    slices = scan.day_slice(F.col(refresh))
    prior = scan.neighbour(sets, [session], slices, [F.col(refresh)], "_before", F.col("_set"))
    changed = (F.col("_before").isNull() | (F.col("_before") != F.col("_set"))).cast("int")
    run = scan.running(prior.withColumn("changed", changed), [session], slices, [F.col(refresh)], {"generation": ("sum", F.col("changed"))})
    return run.select(session, refresh, F.col("_set.n").alias("members"), F.col("changed") == 1, "generation").toDF(
        session, refresh, "members", "changed", "generation")


def session_health(metrics: DataFrame, errors: DataFrame, subscribed: DataFrame, coverage: DataFrame, max_lag_ms: float = 10_000.0,
                   max_rss: int = 1_073_741_824) -> DataFrame:
    """Latest telemetry of each session with coverage counts and every failed check by name."""
    latest = metrics.groupBy("session_id").agg(F.max_by(F.struct(*[c for c in metrics.columns if c != "session_id"]), "metric_id").alias("m"))
    err = errors.groupBy("session_id").agg(F.count(F.lit(1)).alias("reconstruction_errors"))
    wanted = subscribed.groupBy("session_id").agg(F.countDistinct("token_id").alias("subscribed_tokens"))
    live = coverage.where("state = 'VALID' and ended_at is null").join(subscribed, ["session_id", "token_id"], "left_semi").groupBy(
        "session_id").agg(F.countDistinct("token_id").alias("valid_tokens"))
    rows = latest.select("session_id", "m.*").join(err, ["session_id"], "left").join(wanted, ["session_id"], "left").join(live, ["session_id"], "left")
    rows = rows.fillna(0, ["reconstruction_errors", "subscribed_tokens", "valid_tokens"])
    failures = F.array_compact(F.array(
        F.when(F.col("reconstruction_errors") > 0, "reconstruction_errors"),
        F.when(F.col("queue_high_water") >= F.col("queue_capacity"), "queue_capacity_reached"),
        F.when(F.col("receipt_lag_ms") > max_lag_ms, "receipt_lag_over_budget"), F.when(F.col("rss_bytes") > max_rss, "rss_over_budget"),
        F.when(F.col("messages") <= 0, "zero_messages"), F.when(F.col("events") <= 0, "zero_events"),
        F.when(F.col("subscribed_tokens") <= 0, "empty_latest_subscription")
        .when(F.col("valid_tokens") < F.col("subscribed_tokens"), "subscribed_tokens_without_valid_full_book")))
    return rows.withColumn("failures", F.concat_ws(",", failures)).withColumn("healthy", F.size(failures) == 0)
