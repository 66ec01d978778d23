import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyledger.operators import asof, intervals, ranks, scan, select


def hot_rows(n, seed, hot=0.5):
    """Rows over three keys of which one holds about half."""
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < hot else rnd.choice("ab"), rnd.randrange(0, 10**6) * 1000, i, rnd.choice([None, rnd.randrange(100)])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, sec long, id long, v long").withColumn("ts", F.timestamp_seconds("sec"))


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("exact", [True, False])
def test_asof_equals_merge_asof(spark, direction, exact):
    if direction == "nearest" and not exact:
        pytest.skip("nearest is inclusive")
    left, right = hot_rows(300, 1), hot_rows(200, 2)
    got = asof.asof_join(frame(spark, left), frame(spark, right).withColumnRenamed("id", "rid"), ["k"], F.col("ts"), F.col("ts"), {"rid": F.col("rid")},
                         direction, exact, tie=[F.col("rid")], tolerance_us=50_000_000_000)
    got = {r.id: r.rid for r in got.collect()}
    lp = pd.DataFrame(left, columns=["k", "sec", "id", "v"]).sort_values(["sec", "id"])
    rp = pd.DataFrame(right, columns=["k", "sec", "rid", "v"]).sort_values(["sec", "rid"])[["k", "sec", "rid"]]
    want = pd.merge_asof(lp, rp, on="sec", by="k", direction=direction, allow_exact_matches=exact)
    near = pd.merge_asof(lp, rp.assign(at=rp.sec), on="sec", by="k", direction=direction, allow_exact_matches=exact)
    want.loc[(near["at"] - near["sec"]).abs() > 50_000, "rid"] = None
    assert {k: (None if pd.isna(v) else int(v)) for k, v in zip(want.id, want.rid)} == got


def test_stale_latest_row_gives_null_not_the_one_before(spark):
    obs = spark.createDataFrame([("a", 0, 1), ("a", 1000, 2)], "k string, sec long, v int").withColumn("ts", F.timestamp_seconds("sec"))
    ask = spark.createDataFrame([("a", 7000)], "k string, sec long").withColumn("ts", F.timestamp_seconds("sec"))
    r = asof.asof_latest(ask, obs, ["k"], F.col("ts"), F.col("ts"), {"v": F.col("v")}, 5_400_000_000).first()
    assert r.v is None
    later = obs.unionByName(spark.createDataFrame([("a", 8000, 3)], "k string, sec long, v int").withColumn("ts", F.timestamp_seconds("sec")))
    assert asof.asof_latest(ask, later, ["k"], F.col("ts"), F.col("ts"), {"v": F.col("v")}, 5_400_000_000).first().v is None


def test_running_and_drawdown_equal_loops(spark):
    rows = hot_rows(400, 3)
    df = frame(spark, rows).withColumn("x", F.coalesce("v", F.lit(0)) - 50)
    run = scan.running(df, ["k"], scan.day_slice(F.col("ts")), [F.col("ts"), F.col("id")], {"s": ("sum", F.col("x")), "m": ("max", F.col("x"), False)})
    got = {r.id: (r.s, r.m) for r in run.collect()}
    want, falls = {}, {}
    state = {}
    for k, sec, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        x = (v or 0) - 50
        total, best, peak, fall = state.get(k, (0, None, 0, 0))
        want[i] = (total + x, best)
        peak = max(peak, total + x)
        state[k] = (total + x, x if best is None else max(best, x), peak, max(fall, peak - (total + x)))
    assert got == want
    dd = {r.k: (r.total_pnl, r.max_drawdown) for r in scan.drawdown(df, ["k"], scan.day_slice(F.col("ts")), [F.col("ts"), F.col("id")], F.col("x")).collect()}
    assert dd == {k: (s[0], s[3]) for k, s in state.items()}


def test_neighbour_both_ways(spark):
    rows = hot_rows(200, 4)
    df = frame(spark, rows)
    by = scan.day_slice(F.col("ts")), [F.col("ts"), F.col("id")]
    prev = {r.id: r.p for r in scan.neighbour(df, ["k"], *by, "p", F.col("id")).collect()}
    nxt = {r.id: r.p for r in scan.neighbour(df, ["k"], *by, "p", F.col("id"), following=True).collect()}
    for key in {"hot", "a", "b"}:
        ids = [r[2] for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))]
        assert [prev[i] for i in ids] == [None, *ids[:-1]] and [nxt[i] for i in ids] == [*ids[1:], None]


def test_trailing_totals_equal_pairs(spark):
    rows = hot_rows(200, 5)
    ev, dec = frame(spark, rows), frame(spark, hot_rows(80, 6))
    got = intervals.trailing_totals(dec, ev, ["k"], "id", F.unix_micros("ts"), F.unix_micros("ts"), 90_000_000_000_000, {"n": F.lit(1), "s": F.col("v")})
    got = {int(r.id): (int(r.n), int(r.s)) for r in got.collect()}
    for k, sec, i, _ in hot_rows(80, 6):
        inside = [r for r in rows if r[0] == k and sec - 90_000_000 <= r[1] <= sec]
        assert got[i] == (len(inside), sum(r[3] or 0 for r in inside))


def test_covering_interval_with_overlap_and_open_end(spark):
    iv = spark.createDataFrame([("t", 0, 1000, 1), ("t", 100, 200, 2), ("t", 5000, None, 3)], "k string, a long, b long, iid long").select(
        "k", F.timestamp_seconds("a").alias("s"), F.timestamp_seconds("b").alias("e"), "iid")
    pts = spark.createDataFrame([("t", 150, 180), ("t", 300, 900), ("t", 300, 1001), ("t", 6000, 10**6)], "k string, p long, u long").withColumn("ts", F.timestamp_seconds("p"))
    out = intervals.covering_interval(pts, iv, ["k"], F.col("ts"), F.col("u") * 1_000_000, "s", "e", "iid").collect()
    assert {(r.p, r.u): r.interval_id for r in out} == {(150, 180): 2, (300, 900): 1, (300, 1001): None, (6000, 10**6): 3}


def test_order_statistic_and_positions(spark):
    df = frame(spark, hot_rows(300, 8))
    med = {r.k: r.m for r in ranks.order_statistic(df, ["k"], "v", F.floor(F.col("v") / 10), F.floor((F.col("_total") - 1) / 2), "m").collect()}
    rows = pd.DataFrame(hot_rows(300, 8), columns=["k", "sec", "id", "v"]).dropna()
    assert med == {k: sorted(g.v)[(len(g) - 1) // 2] for k, g in rows.groupby("k")}


def test_first_by_scope_limits_rows_before_the_shuffle(spark):
    plan = select.first_by_scope(frame(spark, hot_rows(10, 9)), ["k"], [F.col("ts"), F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_permuted_input_gives_the_same_rows(spark):
    rows = hot_rows(200, 10)
    shuffled = rows[::-1]
    def run(data):
        d = select.first_by_scope(frame(spark, data).repartition(7), ["k"], [F.col("ts"), F.col("id")])
        return sorted(map(tuple, d.collect()))
    assert run(rows) == run(shuffled)
