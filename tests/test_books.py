import json

import pytest
from pyspark.sql import functions as F

from skyledger.operators import books, tape_joins

SCHEMA = "token_id string, receipt_sequence long, received_at timestamp, event_type string, coverage_state string, raw_payload string"


def full(bids, asks):
    return json.dumps({"bids": [{"price": p, "size": s} for p, s in bids], "asks": [{"price": p, "size": s} for p, s in asks]})


def delta(side, price, size):
    return json.dumps({"price_change": {"side": side, "price": price, "size": size}})


def tape(spark, rows):
    data = [("t", i + 1, kind, cover, payload) for i, (kind, cover, payload) in enumerate(rows)]
    df = spark.createDataFrame(data, "token_id string, receipt_sequence long, event_type string, coverage_state string, raw_payload string")
    return df.withColumn("received_at", F.timestamp_seconds(F.col("receipt_sequence") * 40_000))


# three bids and two asks, given worst first so that order is shown to be made, not kept
BOOK = ("book", "RESYNCING", full([("0.21", "40"), ("0.33", "4"), ("0.37", "21")], [("0.62", "9"), ("0.58", "13")]))
BIDS, ASKS = [(0.37, 21.0), (0.33, 4.0), (0.21, 40.0)], [(0.58, 13.0), (0.62, 9.0)]


def state(spark, rows):
    out = books.book_validity(tape(spark, rows)).orderBy("receipt_sequence").collect()
    return [(r.valid, r.invalid_reason) for r in out]


def book(spark, rows):
    return books.book_at(tape(spark, rows), F.lit(True)).first()


def levels(side):
    return [(x.price, x.size) for x in side]


def change(side, price, size):
    return ("price_change", "VALID", delta(side, price, size))


def test_changes_replace_add_and_remove_levels(spark):
    b = book(spark, [BOOK, change("BUY", "0.330", "17.5"), change("BUY", "0.35", "2"), change("SELL", "0.58", "0"), ("last_trade_price", "VALID", "{}")])
    assert b.valid and b.invalid_reason is None
    assert levels(b.bids) == [(0.37, 21.0), (0.35, 2.0), (0.33, 17.5), (0.21, 40.0)] and levels(b.asks) == ASKS[1:]
    untouched = book(spark, [BOOK])
    assert levels(untouched.bids) == BIDS and levels(untouched.asks) == ASKS


def test_nothing_counts_before_a_book_or_inside_a_gap(spark):
    early = change("SELL", "0.7", "3")
    assert state(spark, [early]) == [(False, "delta_before_full_book")]
    rows = [BOOK, ("gap", "GAPPED", "{}"), change("SELL", "0.58", "77"), BOOK]
    assert state(spark, rows) == [(True, None), (False, "coverage_gapped"), (False, "delta_before_full_book"), (True, None)]
    assert levels(book(spark, rows[:3]).asks) == ASKS  # the change inside the gap left no trace


@pytest.mark.parametrize(("event", "reason"), [
    (("book", "VALID", json.dumps({"bids": [], "asks": 5})), "malformed_full_book"),
    (change("BID", "0.3", "1"), "unknown_price_change_side"),
    (change("SELL", "0.3", "-0.5"), "negative_level_size"),
    (("price_change", "VALID", json.dumps({"price_change": {"side": "SELL", "price": "0.6", "size": None}})), "malformed_price_change")])
def test_bad_payloads_name_their_reason(spark, event, reason):
    assert state(spark, [BOOK, event])[1] == (False, reason)


def test_strict_rules_refuse_bad_levels(spark):
    free = tape(spark, [("book", "VALID", full([], [("0", "6")]))])
    assert not books.book_validity(free, strict=True).first().valid
    assert books.book_validity(free).first().valid


def test_checkpoints_and_coverage(spark):
    v = books.book_validity(tape(spark, [BOOK, change("BUY", "0.37", "30"), ("gap", "GAPPED", "{}"), BOOK]))
    shown = {r.event_offset: levels(r.bids) for r in books.checkpoints(v, 2).collect()}
    assert shown == {1: BIDS, 2: [(0.37, 30.0), *BIDS[1:]], 4: BIDS}
    runs = tape_joins.coverage_intervals(v).orderBy("started_at").collect()
    assert [r.state for r in runs] == ["VALID", "GAPPED", "VALID"] and runs[-1].ended_at is None and runs[0].ended_at == runs[1].started_at


def quantise(x, n):
    return round(max(0.0, x) + 1e-12, n)


def brute_walk(asks, limit, target, cap):
    """Plain loop over the stated ladder rules."""
    limit, cap, target = (quantise(min(limit, 1.0), 4), quantise(min(cap, 1.0), 4), quantise(target, 2))
    left, shares, cost, used = quantise(target / limit, 6), 0.0, 0.0, 0
    for p, s in asks:
        p = quantise(min(p, 1.0), 4)
        budget = quantise(target - cost, 2)
        if budget <= 0:
            break
        if p <= 0:
            continue
        take = min(left, quantise(s, 6), quantise(budget / p, 6))
        if take <= 0:
            continue
        if (cost + take * p) / (shares + take) > cap:
            if p <= cap or shares <= 0:
                break
            take = min(take, quantise((cap * shares - cost) / (p - cap), 6))
            if take <= 0:
                break
        shares, cost = quantise(shares + take, 6), quantise(cost + quantise(take * p, 2), 2)
        used, left = used + 1, quantise(left - take, 6)
        if left <= 0:
            break
    return shares, cost, used, left


@pytest.mark.parametrize("asks,limit,target,cap", [
    ([(0.4, 10), (0.5, 100)], 0.4, 25, 0.5), ([(0.4, 10), (0.5, 100)], 0.4, 25, 0.42), ([(0.4, 1000)], 0.4, 25, 0.4), ([], 0.4, 25, 0.5),
    ([(0.4, 0), (0.45, 20), (0.6, 50)], 0.45, 30, 0.5), ([(0.6, 5)], 0.5, 25, 0.5), ([(0.11, 3), (0.12, 3), (0.13, 3), (0.9, 100)], 0.11, 20, 0.2)])
def test_walk_ladder_equals_loop(spark, asks, limit, target, cap):
    df = spark.createDataFrame([([{"price": float(p), "size": float(s)} for p, s in asks],)], f"asks {books.BOOK_LEVEL}")
    w = df.select(books.walk_ladder(F.col("asks"), F.lit(limit), F.lit(float(target)), F.lit(cap)).alias("w")).first().w
    want = brute_walk(asks, limit, target, cap) if asks else (0.0, 0.0, 0, 0.0)
    assert (w.shares, w.cost, w.levels, w.remaining) == pytest.approx(want, abs=1e-9)


def test_sweep_known_result(spark):
    df = spark.createDataFrame([([{"price": 0.5, "size": 100.0}, {"price": 0.4, "size": 10.0}],)], f"asks {books.BOOK_LEVEL}")
    s = df.select(books.sweep_asks(F.col("asks"), F.lit(0.5), F.lit(25.0)).alias("s")).first().s
    assert (s.cost, s.shares, s.vwap) == pytest.approx((25.0, 52.0, 25 / 52))
