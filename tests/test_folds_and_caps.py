import random

from pyspark.sql import functions as F

from skyledger.operators import folds, scan
from skyledger.plans import replay


def rows(n, seed, costs=(5.0, 10.0, 20.0, 30.0, 60.0)):
    rnd = random.Random(seed)
    return [("d0" if rnd.random() < 0.6 else rnd.choice(["d1", "d2"]), rnd.choice("xyz"), i, rnd.choice(costs)) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "d string, s string, i long, cost double").repartition(5)


def test_greedy_cap_rejects_whole_rows_but_takes_later_smaller_ones(spark):
    df = spark.createDataFrame([("a", 1, 30.0), ("a", 2, 25.0), ("a", 3, 20.0)], "g string, i int, cost double")
    assert sorted(r.i for r in folds.greedy_cap(df, ["g"], ["i"], "cost", 50.0).collect()) == [1, 3]


def test_greedy_cap_equals_loop_on_a_hot_group(spark):
    data = rows(2000, 1)
    got = sorted(r.i for r in folds.greedy_cap(frame(spark, data), ["d"], ["i"], "cost", 95.0).collect())
    used, want = {}, []
    for d, _, i, c in data:
        if used.get(d, 0) + c <= 95.0 + 1e-9:
            used[d] = used.get(d, 0) + c
            want.append(i)
    assert got == want


def test_two_caps_equal_loop_with_reasons_for_every_row(spark):
    data = rows(1500, 2)
    out = folds.two_cap_fold(frame(spark, data), ["d"], ["s"], ["i"], "cost", 150.0, 70.0, F.floor(F.col("i") / 100))
    got = {r.i: r.cap_reason for r in out.collect()}
    day, cell, want = {}, {}, {}
    for d, s, i, c in data:
        if day.get(d, 0) + c > 150 + 1e-9:
            want[i] = "OUTER_CAP"
        elif cell.get((d, s), 0) + c > 70 + 1e-9:
            want[i] = "INNER_CAP"
        else:
            day[d], cell[(d, s)] = day.get(d, 0) + c, cell.get((d, s), 0) + c
            want[i] = None
    assert got == want


def test_edge_improve_equals_loop(spark):
    rnd = random.Random(3)
    data = [("g0" if rnd.random() < 0.6 else "g1", i, rnd.choice([None, -0.1, 0.0, round(rnd.random(), 3)])) for i in range(800)]
    df = spark.createDataFrame(data, "g string, i long, edge double")
    got = sorted(r.i for r in folds.edge_improve(df, ["g"], F.floor(F.col("i") / 50), ["i"], "edge").collect())
    last, want = {}, []
    for g, i, e in data:
        if g not in last:
            want.append(i)
            last[g] = e if e is not None and e > 0 else None
        elif e is not None and e > 0 and (last[g] is None or e >= 1.5 * last[g]):
            want.append(i)
            last[g] = e
    assert got == want


def test_portfolio_replay_equals_loop(spark):
    rnd = random.Random(4)
    caps = replay.PortfolioCaps(order=30, daily=200, station_date=90, side=70, bucket=40, minimum=5)
    data = [(rnd.randrange(3), "d0" if rnd.random() < 0.7 else "d1", "HIGH", rnd.choice("ab"), rnd.choice(["60-61F", "62-63F"]), rnd.choice(["BUY_YES", "BUY_NO"]),
             i, rnd.choice([3.0, 10.0, 25.0]), rnd.choice([0.0, 4.0, 8.0, 100.0]), 0.5, rnd.choice([0.5, -0.5])) for i in range(600)]
    df = spark.createDataFrame(data, "spec_rank int, market_date string, market_family string, station string, selected_bucket string, selected_side string, row_id long, target double, depth double, entry double, pnl double")
    out = replay.portfolio_replay(df.withColumn("ts", F.timestamp_seconds("row_id")), caps).collect()
    got, skips = {r.row_id: r.allocated for r in out if r.allocated > 0}, {r.row_id: r.skip for r in out if r.skip}
    used, want, why = {}, {}, {}
    for spec, d, fam, st, b, side, i, target, depth, _, _ in sorted(data, key=lambda r: (r[1], r[0], r[6])):
        keys = [("d", d), ("sd", fam, st, d), ("sds", fam, st, d, side), ("b", fam, st, d, b, side)]
        room = min(c - used.get(k, 0.0) for k, c in zip(keys, (caps.daily, caps.station_date, caps.side, caps.bucket)))
        size = min(target, caps.order, depth, room)
        if size < caps.minimum or size <= 0:
            why[i] = "CAPACITY" if room <= 0 or depth > 0 else "DEPTH"
            continue
        for k in keys:
            used[k] = used.get(k, 0.0) + size
        want[i] = size
    assert got == want and skips == why and len(out) == len(data)


def test_incremental_after_peer_equals_loop(spark):
    def side(seed):
        rnd = random.Random(seed)
        return [("d0" if rnd.random() < 0.6 else "d1", rnd.choice("xy"), i, rnd.choice([5.0, 12.5, 30.0])) for i in range(60)]
    mk = lambda data: spark.createDataFrame(data, "market_date string, station string, i long, cost double").withColumns({"shares": F.col("cost") * 2, "fill_fraction": F.lit(1.0)})
    peer, subject = side(5)[:6], side(6)
    out = replay.incremental_after_peer(mk(subject), mk(peer), 100.0, 160.0, F.floor(F.col("i") / 7), [F.col("i")])
    got = {r.i: (r.cost, r.shares) for r in out.collect()}
    sd, day, want = {}, {}, {}
    for d, s, _, c in peer:
        sd[(d, s)], day[d] = sd.get((d, s), 0) + c, day.get(d, 0) + c
    for d, s, i, c in subject:
        take = min(c, max(100 - sd.get((d, s), 0), 0), max(160 - day.get(d, 0), 0))
        if take > 0:
            want[i] = (take, take * 2)
            sd[(d, s)], day[d] = sd.get((d, s), 0) + take, day.get(d, 0) + take
    assert got == want


def test_day_slice_is_monotone(spark):
    df = spark.range(5).select(scan.day_slice(F.timestamp_seconds(F.col("id") * 50_000)).alias("s"))
    assert [r.s for r in df.collect()] == sorted(r.s for r in df.collect())


def test_candidates_are_rejected_for_the_first_reason(spark):
    day = "2024-01-0"
    rows = [  # id, ts, station, date, ask, sweep (None: none stored), label
        (1, f"{day}1 09:00:00", "a", 1, 0.5, 25.0, 1),  # before activation
        (2, f"{day}2 09:00:00", "a", 1, 0.5, 25.0, 1), (3, f"{day}2 10:00:00", "a", 1, 0.5, 25.0, 0),  # the second of its station and date
        (4, f"{day}2 11:00:00", "b", 1, 0.5, None, 1), (5, f"{day}2 12:00:00", "c", 1, 0.5, 0.0, 1),
        (6, f"{day}2 13:00:00", "d", 1, 0.5, 20.0, 0), (7, f"{day}2 14:00:00", "e", 1, 0.5, 25.0, 1), (8, f"{day}2 15:00:00", "f", 1, 0.5, 5.0, 1),
        (9, f"{day}3 09:00:00", "a", 2, 0.5, 45.0, 1), (10, f"{day}3 09:00:00", "a", 2, 0.9, 25.0, 1),
    ]
    df = spark.createDataFrame([(i, t, s, d, a, x, y) for i, t, s, d, a, x, y in rows], "row_id long, ts string, station string, market_date int, best_ask double, x double, label int").selectExpr(
        "row_id", "CAST(ts AS TIMESTAMP) AS ts", "station", "market_date", "'m' AS model_id", "'H' AS market_family", "'YES' AS selected_side", "0.1D AS edge", "best_ask", "label",
        "CASE WHEN x IS NULL THEN CAST(map() AS MAP<STRING, STRUCT<cost: DOUBLE, shares: DOUBLE, vwap: DOUBLE>>) ELSE map('cap=0.60000000|target=25.00000000', struct(x AS cost, x / best_ask AS shares, CASE WHEN x > 0 THEN best_ask END AS vwap)) END AS sweeps")
    kinds = "candidate_id string, family_id string, model_id string, market_family string, side string, entry_min double, entry_max double, edge_min double, complexity int, execution_version string, price_cap double, target double, daily_cap double, station_date_cap double"
    made = [("own", "f", "m", "H", "ANY", 0.0, 0.6, 0.0, 1, "v1", None, None, 50.0, 30.0), ("old", "f", "m", "H", "ANY", 0.0, 0.6, 0.0, 1, "v0", None, None, None, None), ("none", "f", "z", "H", "ANY", 0.0, 0.6, 0.0, 1, "v1", None, None, None, None)]
    given = spark.createDataFrame(made, kinds).withColumn("activated_at", F.lit("2024-01-02").cast("timestamp"))
    got = {r.candidate_id: r for r in replay.evaluate_candidates(df, given, replay.ForwardDefaults("v1")).collect()}
    own = got["own"]
    assert (own.rows_before, own.rows_since, own.executed, own.dates, own.cost, own.pnl) == (1, 8, 3, 1, 50.0, 25.0 - 20.0 + 5.0)
    assert (own.execution_summary_unavailable, own.no_capped_executable_ask, own.daily_risk_cap, own.station_date_cap) == (1, 1, 1, 1)
    assert own.blockers == "MARKOUTS_UNAVAILABLE,VENUE_SETTLEMENT_UNAVAILABLE"
    assert (got["old"].rows_since, got["old"].executed) == (0, 0) and got["old"].blockers.startswith("EXECUTION_VERSION_MISMATCH,MARKOUTS_UNAVAILABLE,NO_POST")
    assert got["none"].blockers.startswith("MARKOUTS_UNAVAILABLE,NO_POST")
