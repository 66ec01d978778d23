"""Order-book state rebuilt from tape events as DataFrame operators, and ladder kernels over level arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators import scan
from skyledger.session import materialize

LEVELS = "array<struct<price:string,size:string>>"
PAYLOAD = (f"struct<bids:{LEVELS},asks:{LEVELS},side:string,price:string,size:string,"
           "price_change:struct<side:string,price:string,size:string>>")
BOOK_LEVEL = "array<struct<price:double,size:double>>"
BLOCK = 64  # events of a token whose books are made together


def _number(text: Column) -> Column:
    return text.try_cast("decimal(18,6)")


def parse_events(events: DataFrame, strict: bool = False) -> DataFrame:
    """Classify tape events: `is_full`, `bad_reason` (what would invalidate the book) and the delta's fields.

    Needs token_id, receipt_sequence, received_at, event_type, coverage_state, raw_payload. The strict rule set also
    refuses a full book with an unusable level and a non-positive delta price.
    """
    df = events.withColumn("_p", F.from_json("raw_payload", PAYLOAD))
    is_book, is_delta = F.col("event_type") == "book", F.col("event_type") == "price_change"
    lists = F.col("_p.bids").isNotNull() & F.col("_p.asks").isNotNull()
    full_ok = is_book & lists
    if strict:
        def usable(level: Column) -> Column:
            price, size = _number(level["price"]), _number(level["size"])
            return F.coalesce((price > 0) & (size >= 0), F.lit(False))
        full_ok = full_ok & F.forall("_p.bids", usable) & F.forall("_p.asks", usable)
    full_ok = F.coalesce(full_ok, F.lit(False))
    change = F.when(F.col("_p.price_change").isNotNull(), F.col("_p.price_change")).otherwise(
        F.struct(F.col("_p.side").alias("side"), F.col("_p.price").alias("price"), F.col("_p.size").alias("size")))
    df = df.withColumn("_c", F.when(is_delta, change))
    side, price, size = F.upper(F.col("_c.side")), _number(F.col("_c.price")), _number(F.col("_c.size"))
    bad_price = (price <= 0) if strict else F.lit(False)
    reason = (
        F.when(is_book, F.when(~full_ok, F.lit("malformed_full_book")))
        .when(F.col("coverage_state") != "VALID", F.concat(F.lit("coverage_"), F.lower("coverage_state")))
        .when(is_delta & (side.isNull() | price.isNull() | size.isNull()), F.lit("malformed_price_change"))
        .when(is_delta & ~side.isin("BUY", "SELL"), F.lit("unknown_price_change_side"))
        .when(is_delta & ((size < 0) | bad_price), F.lit("negative_level_size"))
    )
    return df.withColumns({
        "is_full": full_ok,
        "bad_reason": reason,
        "is_delta": is_delta & (F.col("coverage_state") == "VALID"),
        "delta_side": side, "delta_price": price, "delta_size": size,
    }).drop("_c")


def book_validity(events: DataFrame, strict: bool = False, slice_by: Column | None = None, reasons: bool = True) -> DataFrame:
    """Each event with its epoch (sequence of the full book in force), `valid` after it and its number in the token.

    A well-formed full book cures any state; anything in `bad_reason` invalidates until the next full book; a delta
    that meets an invalid book is never applied and names `delta_before_full_book`. The reason of an invalid state costs
    a second pass and can be left out.
    """
    parsed = parse_events(events, strict)
    key, seq = ["token_id"], F.col("receipt_sequence")
    slices = scan.day_slice(F.col("received_at")) if slice_by is None else slice_by
    bad = F.when(F.col("bad_reason").isNotNull(), seq)
    run = scan.running(parsed, key, slices, [seq], {
        "epoch": ("max", F.when(F.col("is_full"), seq)), "_last_bad": ("max", bad), "_bad_before": ("max", bad, False),
        "event_number": ("sum", F.lit(1))})

    def live(last_bad: Column) -> Column:
        return F.col("epoch").isNotNull() & (last_bad.isNull() | (F.col("epoch") > last_bad))
    open_before = live(F.col("_bad_before"))
    run = run.withColumns({
        "valid": live(F.col("_last_bad")),
        "applied": F.col("is_full") | (F.col("is_delta") & open_before & F.col("bad_reason").isNull()),
        "_names": F.when(F.col("is_delta") & ~open_before, F.lit("delta_before_full_book")).otherwise(F.col("bad_reason")),
    }).drop("_last_bad", "_bad_before")
    if not reasons:
        return run.drop("_names")
    setter = F.when(F.col("_names").isNotNull(), F.struct(seq.alias("s"), F.col("_names").alias("r")))
    named = scan.running(run, key, slices, [seq], {"_why": ("max", setter)})
    why = F.when(~F.col("valid") & (F.col("epoch").isNull() | (F.col("_why.s") > F.col("epoch"))), F.col("_why.r"))
    return named.withColumn("invalid_reason", why).drop("_names", "_why")


def level_updates(validity: DataFrame) -> DataFrame:
    """One row per level set or delete that took effect: (token_id, epoch, seq, event_number, received_at, side, price, size)."""
    def levels(field: str, side: str) -> Column:
        rows = F.transform(F.col(f"_p.{field}"), lambda x: F.struct(
            F.lit(side).alias("side"), _number(x["price"]).alias("price"), _number(x["size"]).alias("size")))
        return F.filter(rows, lambda x: x["price"].isNotNull() & (x["size"] > 0))
    delta = F.array(F.struct(F.col("delta_side").alias("side"), F.col("delta_price").alias("price"), F.col("delta_size").alias("size")))
    changes = F.when(F.col("is_full"), F.concat(levels("bids", "BUY"), levels("asks", "SELL"))).when(
        F.col("is_delta") & F.col("applied"), delta)
    at = ["token_id", "epoch", "receipt_sequence", "event_number", "received_at"]
    return validity.select(*at, F.explode(changes).alias("_l")).select(*at, "_l.*")


def book_at(events: DataFrame, boundary: Column, strict: bool = False) -> DataFrame:
    """Book of every token at an inclusive boundary: sorted level arrays, validity and reason.

    Levels are the last update per (token, side, price) of the epoch in force, a partial aggregate; the arrays are as
    long as the book is deep.
    """
    upto = materialize(book_validity(events.where(boundary), strict).drop("raw_payload"))
    state = upto.groupBy("token_id").agg(F.max_by(
        F.struct("epoch", "valid", "invalid_reason", F.col("receipt_sequence").alias("as_of_sequence")),
        "receipt_sequence").alias("s")).select("token_id", "s.*")
    last = level_updates(upto).groupBy("token_id", "side", "price").agg(
        F.max_by(F.struct("epoch", "size"), F.struct("epoch", "receipt_sequence")).alias("l"))
    live = last.select("token_id", "side", "price", "l.epoch", "l.size")
    return state.join(_arrays(live.where("size > 0"), ["token_id", "epoch"]), ["token_id", "epoch"], "left").select(
        "token_id", "as_of_sequence", "valid", "invalid_reason",
        *[F.coalesce(F.col(c), F.array().cast(BOOK_LEVEL)).alias(c) for c in ("bids", "asks")])


def _arrays(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Level rows to `bids` (best first) and `asks` (best first)."""
    level = F.struct(F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"))
    return levels.groupBy(*keys).agg(
        F.reverse(F.array_sort(F.collect_list(F.when(F.col("side") == "BUY", level)))).alias("bids"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "SELL", level))).alias("asks"))


def level_intervals(validity: DataFrame) -> DataFrame:
    """Each level with the span it stood: from its update to its next update or the token's next full book."""
    rows = level_updates(validity)
    slices, order = scan.day_slice(F.col("received_at")), [F.col("receipt_sequence")]
    here = F.struct(F.col("receipt_sequence").alias("q"), F.col("received_at").alias("t"))
    same = scan.neighbour(rows, ["token_id", "epoch", "side", "price"], slices, order, "_next", here, following=True)
    fulls = validity.where("is_full").select("token_id", F.col("receipt_sequence").alias("epoch"), "received_at", "receipt_sequence")
    ends = scan.neighbour(fulls, ["token_id"], slices, order, "_stop", here, following=True).select("token_id", "epoch", "_stop")
    until = F.least("_next", "_stop")
    return same.join(ends, ["token_id", "epoch"], "left").where("size > 0").select(
        "token_id", "epoch", "side", "price", "size", F.col("receipt_sequence").alias("from_seq"),
        F.col("received_at").alias("started_at"), until["q"].alias("to_seq"), until["t"].alias("ended_at"))


def books_at_events(validity: DataFrame, points: DataFrame) -> DataFrame:
    """`points` (token_id, epoch, event_number and other columns of the validity table) with the sorted level arrays `bids` and `asks`.

    A level stands from its update's event to its next update in the epoch or the epoch's end. Points and spans meet by the
    number of the event in its token: a span is dealt to the blocks of `BLOCK` events it touches, so spans are as many as the
    updates however long they last, and a block holds as many points as events. Both sides of a block are gathered in one row,
    and its books are made there: no row per point and level is dealt or sorted.
    """
    rows = level_updates(validity)
    block = F.floor(F.col("event_number") / BLOCK)
    same = scan.neighbour(rows.select("token_id", "epoch", "side", "price", "size", "event_number"), ["token_id", "epoch", "side", "price"],
                          block, [F.col("event_number")], "_next", F.col("event_number"), following=True).where("size > 0")
    ends = points.groupBy("token_id", "epoch").agg(F.max("event_number").alias("_end"))
    spans = same.join(ends, ["token_id", "epoch"]).withColumn("_until", F.least(F.col("_next") - 1, F.col("_end"))).where("event_number <= _until")
    span = F.struct((F.col("side") == "BUY").alias("buy"), F.col("event_number").alias("from"), F.col("_until").alias("until"), F.struct(
        F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size")).alias("level"))
    held = spans.select("token_id", span.alias("_span"), F.explode(F.sequence(block, F.floor(F.col("_until") / BLOCK))).alias("_block")).groupBy(
        "token_id", "_block").agg(F.collect_list("_span").alias("_spans"))
    asked = points.select("token_id", block.alias("_block"), F.struct(*points.columns).alias("_point")).groupBy(
        "token_id", "_block").agg(F.collect_list("_point").alias("_points"))

    def side(live: Column, buy: bool) -> Column:
        levels = F.transform(F.filter(live, lambda s: s["buy"] if buy else ~s["buy"]), lambda s: s["level"])
        return F.sort_array(levels, asc=not buy)

    def book(point: Column) -> Column:
        live = F.filter("_spans", lambda s: point["event_number"].between(s["from"], s["until"]))
        both = F.transform(F.array(live), lambda x: F.struct(point.alias("point"), side(x, True).alias("bids"), side(x, False).alias("asks")))
        return F.get(both, F.lit(0))
    made = asked.join(held, ["token_id", "_block"], "left").select(F.explode(F.transform("_points", book)).alias("_made"))
    return made.select("_made.point.*", *[F.coalesce(F.col(f"_made.{c}"), F.array().cast(BOOK_LEVEL)).alias(c) for c in ("bids", "asks")])


def checkpoint_marks(validity: DataFrame, every: int) -> DataFrame:
    """Events (token_id, epoch, event_number, event_offset, captured_at) that get a checkpoint: each full-book event and every
    `every`-th event of a token, while the book is valid."""
    marks = validity.where(F.col("valid") & (F.col("is_full") | (F.col("event_number") % every == 0)))
    return marks.select("token_id", "epoch", "event_number", F.col("receipt_sequence").alias("event_offset"), F.col("received_at").alias("captured_at"))


def checkpoints(validity: DataFrame, every: int) -> DataFrame:
    """Full book after each full-book event and after every `every` events of a token, while the book is valid."""
    return books_at_events(validity, checkpoint_marks(validity, every)).select("token_id", "event_offset", "captured_at", "bids", "asks")


# ---- ladder kernels over sorted arrays ----

def sweep_asks(asks: Column, cap: Column, target: Column) -> Column:
    """Take asks from the best price up to the cap until the target cost is spent: struct(cost, shares, vwap)."""
    usable = F.array_sort(F.filter(asks, lambda x: (x["price"] <= cap) & (x["price"] > 0) & (x["size"] > 0)))
    zero = F.struct(F.lit(0.0).alias("cost"), F.lit(0.0).alias("shares"), target.cast("double").alias("left"))

    def step(acc: Column, level: Column) -> Column:
        take = F.when(acc["left"] <= 1e-9, F.lit(0.0)).otherwise(F.least(acc["left"], level["price"] * level["size"]))
        return F.struct((acc["cost"] + take).alias("cost"), (acc["shares"] + take / level["price"]).alias("shares"),
                        (acc["left"] - take).alias("left"))
    return F.aggregate(usable, zero, step, lambda acc: F.struct(
        acc["cost"].alias("cost"), acc["shares"].alias("shares"),
        F.when(acc["shares"] > 0, acc["cost"] / acc["shares"]).alias("vwap")))


def walk_ladder(asks: Column, limit: Column, target: Column, cap: Column, half: bool = False) -> Column:
    """Quantised ladder walk: shares wanted are target/limit, the running average price may not pass the cap.

    Stops at the first level that would push the average over the cap, after a part take where that level alone
    is above the cap and something is already held. Returns struct(shares, cost, avg_price, levels, remaining).
    """
    from skyledger.functions.money import q_price, q_shares, q_usdc

    limit_q, cap_q, target_q = q_price(limit), q_price(cap), q_usdc(target)
    wanted = q_shares(target_q / limit_q)
    if half:
        wanted = q_shares(wanted / 2.0)
    start = F.struct(F.lit(0.0).alias("shares"), F.lit(0.0).alias("cost"), wanted.alias("left"),
                     F.lit(0).alias("levels"), F.lit(False).alias("done"))

    def step(acc: Column, level: Column) -> Column:
        price = q_price(level["price"])
        budget = q_usdc(target_q - acc["cost"])
        # a price of zero is skipped, so the division is guarded
        take = F.least(acc["left"], q_shares(level["size"]), q_shares(budget / F.when(price > 0, price)))
        skip = (price <= 0) | (take <= 0)
        shares = acc["shares"] + take
        vwap = (acc["cost"] + take * price) / shares
        over = vwap > cap_q
        stop_now = over & ((price <= cap_q) | (acc["shares"] <= 0))
        part = F.least(take, q_shares((cap_q * acc["shares"] - acc["cost"]) / F.when(price != cap_q, price - cap_q)))
        final = F.when(over, part).otherwise(take)
        stop = F.coalesce(acc["done"] | (budget <= 0) | (~skip & (stop_now | (over & (part <= 0)))), F.lit(False))
        use = ~(stop | skip)
        cost = q_usdc(acc["cost"] + q_usdc(final * price))
        left = q_shares(acc["left"] - final)
        return F.struct(
            F.when(use, q_shares(acc["shares"] + final)).otherwise(acc["shares"]).alias("shares"),
            F.when(use, cost).otherwise(acc["cost"]).alias("cost"),
            F.when(use, left).otherwise(acc["left"]).alias("left"),
            (acc["levels"] + F.when(use, 1).otherwise(0)).alias("levels"),
            (stop | (use & (left <= 0))).alias("done"))
    done = F.aggregate(asks, start, step, lambda acc: F.struct(
        acc["shares"].alias("shares"), acc["cost"].alias("cost"),
        F.when(acc["shares"] > 0, q_price(acc["cost"] / acc["shares"])).alias("avg_price"),
        acc["levels"].alias("levels"), acc["left"].alias("remaining")))
    nothing = F.struct(F.lit(0.0).alias("shares"), F.lit(0.0).alias("cost"), F.lit(None).cast("double").alias("avg_price"),
                       F.lit(0).alias("levels"), F.lit(0.0).alias("remaining"))
    return F.when((F.size(asks) > 0) & (limit_q > 0), done).otherwise(nothing)


# fixed values: cap offsets over the best ask and targets in dollars of the liquidity summary.
CAP_OFFSETS = (("ask", 0.0), ("ask_plus_0_01", 0.01), ("ask_plus_0_03", 0.03), ("ask_plus_0_05", 0.05))
TARGETS_USD = (25.0, 50.0, 100.0, 250.0, 500.0)


def depth_at_cap(levels: Column, cap: Column) -> Column:
    """Notional, to the cent, of the levels whose quantised price is at or under a cap."""
    from skyledger.functions.money import q_price, q_usdc

    inside = F.filter(levels, lambda x: q_price(x["price"]) <= cap)
    return q_usdc(F.aggregate(inside, F.lit(0.0), lambda acc, x: acc + x["price"] * x["size"]))


def liquidity_summary(books: DataFrame) -> DataFrame:
    """Best prices, spread and depth per cap, and the walk for each cap and target, as long rows."""
    best_ask, best_bid = F.try_element_at("asks", F.lit(1))["price"], F.try_element_at("bids", F.lit(1))["price"]
    grid = F.array(*[
        F.struct(F.lit(n).alias("cap_name"), F.lit(o).alias("offset"), F.lit(t).alias("target"))
        for n, o in CAP_OFFSETS for t in TARGETS_USD])
    rows = books.withColumns({"best_ask": best_ask, "best_bid": best_bid}).withColumn("_g", F.explode(grid))
    from skyledger.functions.money import q_price

    cap = q_price(F.col("best_ask") + F.col("_g.offset"))
    rows = rows.withColumn("_w", walk_ladder(F.col("asks"), F.col("best_ask"), F.col("_g.target"), cap))
    return rows.where("best_ask is not null").select(
        "token_id", F.col("_g.cap_name").alias("cap_name"), F.col("_g.target").alias("target_usd"),
        "best_bid", "best_ask", (F.col("best_ask") - F.col("best_bid")).alias("spread"),
        depth_at_cap(F.col("asks"), cap).alias("depth_at_cap"),
        F.col("_w.cost").alias("fillable_usd"), F.col("_w.shares").alias("filled_shares"),
        F.col("_w.avg_price").alias("vwap"), F.col("_w.levels").alias("levels_consumed"),
        (F.col("_w.cost") + 1e-9 >= F.col("_g.target")).alias("fully_fillable"))


def decision_summaries(books: DataFrame, caps: list[float], targets: list[float]) -> DataFrame:
    """Status of a decision's book and one sweep per cap and target; rejected books keep one row with the reason."""
    best_ask, best_bid = F.try_element_at("asks", F.lit(1))["price"], F.try_element_at("bids", F.lit(1))["price"]
    reason = (
        F.when(F.size("asks") == 0, F.lit("TAPE:NO_ASKS"))
        .when(best_bid > best_ask + 1e-12, F.lit("TAPE:CROSSED_BOOK"))
    )
    grid = F.array(*[F.struct(F.lit(c).alias("cap"), F.lit(t).alias("target")) for c in caps for t in targets])
    rows = books.withColumns({"best_ask": best_ask, "best_bid": best_bid, "rejection_reason": reason})
    rows = rows.withColumn("_g", F.explode_outer(F.when(F.col("rejection_reason").isNull(), grid)))
    rows = rows.withColumn("_s", F.when(F.col("_g").isNotNull(), sweep_asks(F.col("asks"), F.col("_g.cap"), F.col("_g.target"))))
    return rows.select(
        "token_id", F.when(F.col("rejection_reason").isNull(), "SUCCESS").otherwise("REJECTED").alias("status"),
        "rejection_reason", "best_bid", "best_ask", F.col("_g.cap").alias("cap"), F.col("_g.target").alias("target"),
        F.col("_s.cost").alias("cost_usd"), F.col("_s.shares").alias("shares"), F.col("_s.vwap").alias("vwap"),
        F.when(F.col("_g").isNotNull(), F.least(F.col("_s.cost") / F.col("_g.target"), F.lit(1.0))).alias("fill_fraction"))


def ladder_fill(orders: DataFrame, asks: str, mode: str, minimum_usd: float, cap_slippage: float = 0.0) -> DataFrame:
    """Fill state of each order against its book: FILLED, PARTIAL, FOK_NOT_FILLED or REJECTED with a reason."""
    walk = walk_ladder(F.col(asks), F.col("limit_price"), F.col("target_usd"), F.col("limit_price") + cap_slippage)
    rows = orders.withColumn("_w", walk)
    empty = F.coalesce(F.size(F.col(asks)), F.lit(0)) <= 0
    thin = (F.col("_w.shares") <= 0) | (F.col("_w.cost") < minimum_usd)
    state = (
        F.when(empty | thin, "REJECTED")
        .when((F.lit(mode) == "FOK") & (F.col("_w.remaining") > 0), "FOK_NOT_FILLED")
        .when(F.col("_w.remaining") <= 0, "FILLED").otherwise("PARTIAL")
    )
    rows = rows.withColumn("state", state)
    filled = F.col("state").isin("FILLED", "PARTIAL")
    return rows.withColumns({
        "reason": F.when(empty, "MISSING_ASKS").when(thin, "INSUFFICIENT_DEPTH").otherwise(F.col("state")),
        "filled_shares": F.when(filled, F.col("_w.shares")).otherwise(0.0),
        "fill_cost": F.when(filled, F.col("_w.cost")).otherwise(0.0),
        "fill_price": F.when(filled, F.col("_w.avg_price")),
    }).drop("_w")


def execution_modes(df: DataFrame, min_edge: float, keep_edge: float, slippage: float, targets: tuple[float, ...], order_usd: float = 10.0,
                    total_usd: float = 50.0, step: float = 0.01, span: float = 0.05) -> DataFrame:
    """Ask-sweep and post-only bid-ladder plans beside each row (asks, bids, selected_side, fair), or the reason there is none.

    The bid ladder starts at the best post-only price and steps down within the span until the total notional is placed.
    """
    from skyledger.functions.money import q_price, q_usdc

    ask, bid = F.try_element_at("asks", F.lit(1))["price"], F.try_element_at("bids", F.lit(1))["price"]
    rows = df.withColumns({"best_ask": ask, "best_bid": bid})
    reason = (
        F.when(F.col("selected_side").isNull() | ~F.col("selected_side").isin("BUY_YES", "BUY_NO"), "SKIP").when(F.col("fair").isNull(), "MISSING_FAIR")
        .when(F.col("asks").isNull(), "MISSING_BOOK").when(F.col("best_ask").isNull(), "MISSING_ASK")
        .when(F.col("fair") - F.col("best_ask") < min_edge, "EDGE_BELOW_MINIMUM"))
    cap = q_price(F.least(F.col("best_ask") + slippage, F.col("fair") - keep_edge))
    rows = rows.withColumns({"reason": reason, "price_cap": cap})
    ok = F.col("reason").isNull()
    sweeps = {f"sweep_{int(t)}": F.when(ok, walk_ladder(F.col("asks"), F.col("best_ask"), F.lit(float(t)), F.col("price_cap"))) for t in targets}
    top = q_price(F.least(F.col("fair") - keep_edge, F.col("best_ask") - 0.01))
    count = int(round(span / step)) + 1
    rungs = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(
        q_price(top - i * step).alias("price"), q_usdc(F.least(F.lit(order_usd), total_usd - i * order_usd)).alias("notional")))
    placed = F.filter(rungs, lambda x: (x["price"] > 0) & (x["notional"] > 0))
    return rows.withColumns(sweeps | {
        "bid_reason": F.coalesce("reason", F.when(top <= 0, "NO_POST_ONLY_PRICE")),
        "bid_ladder": F.when(ok & (top > 0), placed), "depth_to_cap": F.when(ok, depth_at_cap(F.col("asks"), F.col("price_cap")))})
