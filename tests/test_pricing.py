"""Sizing, post-only quotes, strategy choice and the resolution clock at their boundaries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from skyledger.plans import leaderboard, pricing, replay


def sized(spark, rows, used=None):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, strategy_name string, selected_side string, entry double, depth double")
    exposure = spark.createDataFrame([(i, *(used or {}).get(i, (0.0,) * 5)) for i in range(len(rows))], "k long, used_total double, used_daily double, used_station_date double, used_station_date_side double, used_bucket double")
    return [(r.target_usd, r.size_usd, r.blocked_reason) for r in pricing.size_candidates(df, exposure, ["k"]).orderBy("k").collect()]


def test_stakes_by_price_and_strategy(spark):
    prices = [0.0999, 0.10, 0.2499, 0.25, 0.75, 0.7501]
    got = sized(spark, [("core", "BUY_NO", p, None) for p in prices])
    assert [g[0] for g in got] == [6.25, 15.0, 15.0, 25.0, 25.0, 15.0]
    got = sized(spark, [("pair_consensus", "BUY_NO", 0.5, None), ("pair_consensus", "BUY_YES", 0.5, None), ("Moonshot", "BUY_YES", 0.05, None), ("entry_05_10", "BUY_NO", 0.5, None)])
    assert [g[0] for g in got] == [15.0, 7.5, 2.0, 2.0]


def test_caps_in_order_and_rounding(spark):
    row = ("core", "BUY_NO", 0.5, None)
    used = {0: (1000.0, 500.0, 0.0, 0.0, 0.0), 1: (0.0, 500.0, 150.0, 0.0, 0.0), 2: (0.0, 0.0, 150.0, 120.0, 0.0), 3: (0.0, 0.0, 0.0, 120.0, 80.0), 4: (0.0, 0.0, 0.0, 0.0, 80.0), 5: (0.0, 0.0, 0.0, 0.0, 72.3), 6: (0.0, 0.0, 0.0, 0.0, 79.5)}
    got = sized(spark, [row] * 7, used)
    assert [g[2] for g in got] == ["RISK_TOTAL_OPEN_CAP", "RISK_DAILY_NEW_CAP", "RISK_STATION_DATE_CAP", "RISK_STATION_DATE_SIDE_CAP", "RISK_EXACT_BUCKET_SIDE_CAP", None, "RISK_MIN_ORDER_NOTIONAL"]
    assert got[5][1] == 7.5
    got = sized(spark, [("core", "BUY_NO", 0.5, d) for d in (0.0, 0.7, 8.9, -3.0)])
    assert [(g[1], g[2]) for g in got] == [(0.0, "INSUFFICIENT_DEPTH"), (0.5, "INSUFFICIENT_DEPTH"), (8.5, None), (0.0, "INSUFFICIENT_DEPTH")]


@pytest.mark.parametrize(("sheet", "size", "price", "reason"), [
    (("t", True, None, 0.40, 0.50), 5.0, 0.40, None),
    (("t", True, None, 0.60, 0.50), 5.0, 0.49, None),
    (("t", False, "LATE", 0.40, 0.50), 5.0, None, "LATE"),
    (("t", False, None, 0.40, 0.50), 5.0, None, "PRICE_SHEET_INELIGIBLE"),
    ((None, True, None, 0.40, 0.50), 5.0, None, "MISSING_TOKEN"),
    (("t", True, None, 0.40, None), 5.0, None, "MISSING_BOOK_OR_ASK"),
    (("t", True, None, None, 0.50), 5.0, None, "NO_POST_ONLY_PRICE"),
    (("t", True, None, 0.40, 0.01), 5.0, None, "NO_POST_ONLY_PRICE"),
    (("t", True, None, 0.40, 0.50), 0.5, None, "QUOTE_SIZE_BELOW_MIN")])
def test_post_only_reasons(spark, sheet, size, price, reason):
    df = spark.createDataFrame([sheet], "token_id string, eligible boolean, reject_reason string, max_quote double, best_ask double").withColumn("bids", F.array(F.struct(F.lit(0.45).alias("price"), F.lit(10.0).alias("size"))))
    r = pricing.post_only_quotes(df, [{"name": "s", "ask_offset_cents": 0, "size_usd": size}]).first()
    assert (r.quote_price, r.skip_reason) == (price, reason)


def test_strategies_take_the_better_side(spark):
    rows = [("a", 0.80, 0.65, 0.15, 0.20, 0.40, -0.20, False), ("b", 0.15, 0.06, 0.09, 0.85, 0.96, -0.11, True), ("c", 0.10, 0.30, -0.20, 0.90, 0.72, 0.18, True)]
    df = spark.createDataFrame(rows, "bucket string, fair double, entry double, edge double, fair_no double, entry_no double, edge_no double, holds_progress boolean").withColumn("g", F.lit(1))
    pick = {n: replay.select_strategy(df, ["g"], n, [F.col("bucket")]).first() for n in replay.STRATEGIES}
    assert [(n, r.bucket, r.best_side) for n, r in pick.items()] == [("HIGH_CONVICTION", "c", "BUY_NO"), ("TAIL", "b", "BUY_YES"), ("BEST_BUCKET", "a", "BUY_YES"), ("MAX_SO_FAR", "b", "BUY_YES")]
    assert replay.select_strategy(df, ["g"], "HIGH_CONVICTION", [F.col("bucket")], {"min_probability": 0.95}).first() is None


def test_unresolved_dates_do_not_count(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [("k", dt.date(2024, 1, 1), 0.10, day(1), day(2)), ("k", dt.date(2024, 1, 3), 0.50, day(3), day(9)), ("k", dt.date(2024, 1, 5), -0.3, day(5), day(6)), ("k", dt.date(2024, 1, 8), 0.2, day(8), day(9)), ("k", dt.date(2024, 1, 10), 0.2, day(10), day(11))]
    df = spark.createDataFrame(rows, "model string, d date, r double, first_at timestamp, resolved_at timestamp")
    got = pricing.uncertainty_reserve(df, ["model"], "d", "r", 0.8, 0.02, "first_at", "resolved_at").orderBy("d").collect()
    assert [(r.prior_dates, r.reserve) for r in got] == [(0, 0.02), (1, 0.10), (1, 0.10), (2, 0.10), (4, 0.50)]


def test_dates_without_a_residual_count_for_none(spark):
    given = [0.5, None, 0.1, 0.9, 0.2, 0.3, 0.05, 0.4]
    df = spark.createDataFrame([("k", dt.date(2024, 1, 1 + i), r) for i, r in enumerate(given)], "model string, d date, r double")
    got = pricing.uncertainty_reserve(df, ["model"], "d", "r", 0.8, 0.0).orderBy("d").collect()
    assert [r.prior_dates for r in got] == [0, 1, 1, 2, 3, 4, 5, 6] and [r.reserve for r in got] == [0.0, 0.5, 0.5, 0.5, 0.9, 0.9, 0.5, 0.5]


def test_evidence_labels_and_families(spark):
    rows = [(0, 3, 9, None, None), (4, 0, 9, 9.0, 9.0), (5, 0, 2, 9.0, 9.0), (5, 0, 3, 0.3, 0.26), (5, 0, 3, -0.1, -0.1), (5, 0, 3, -0.1, None), (5, 6, 3, 0.1, 0.1), (5, 5, 3, 0.2, 0.26)]
    df = spark.createDataFrame(rows, "resolved int, pending int, stations int, rr double, sharpe double")
    assert [r[0] for r in df.select(leaderboard.evidence_label()).collect()] == ["PENDING", "TINY_N", "CONCENTRATED", "PROMISING", "WEAK", "WATCH", "PENDING_HEAVY", "WATCH"]
    names = ["x_metar+hrrr_1", "hrrr_rich_2", "hrrr_v2", "obs_x", "x_obs_", "low_1", "global_a", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(leaderboard.family_of(F.col("n"))).collect()]
    assert got == ["metar_hrrr_rich", "hrrr_rich", "hrrr_v2_basic", "obs_pm_us12", "other", "low", "global", "other"]
