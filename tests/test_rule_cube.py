"""The cube of conditions against loops over rows and rules."""

import dataclasses
import datetime
import random

import pytest
from pyspark.sql import functions as F
from skyledger.operators import rule_cube
from skyledger.plans import discovery, search

DAY = datetime.date(2024, 1, 1)
ROW = ("model_id string, market_family string, station string, market_date date, ready long, snapshot_id long, mapping_id long, selected_side string, "
       "observation_delay_bucket string, local_hhmm string, best_ask double, edge_at_best double, spread double, label int, cost double")


def made(n, seed):
    draw = random.Random(seed)
    return [(draw.choice("ab"), "H", f"s{draw.randrange(3)}", DAY + datetime.timedelta(days=draw.randrange(20)), draw.randrange(5), draw.randrange(9), i, draw.choice(["YES", "NO", None]),
             draw.choice(["10m", "30m", None]), f"{draw.randrange(24):02d}:30", draw.choice([0.1, 0.2, 0.3, 0.55]), draw.choice([-0.1, 0.0, 0.1, 0.2]), draw.choice([0.01, 0.05, 0.2, None]),
             draw.choice([0, 1, 1, None]), draw.choice([10.0, 25.0, 40.0])) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made(400, 1), ROW).withColumn("sweeps", F.create_map(
        *[x for c in (0.3, 0.6) for x in (F.lit(f"{c:.8f}"), F.when(F.col("best_ask") <= c, F.struct("cost", (F.col("cost") / F.col("best_ask")).alias("shares"), F.col("best_ask").alias("vwap"))))]))


@pytest.fixture(scope="module")
def rules(rows):
    return discovery.rule_grid(rows, ["ANY", "NO"], [None, "10m"], [("00:00", "24:00"), ("06:00", "12:00")], [(0.05, 0.3), (0.15, 0.6)], [0.0, 0.1], [None, 0.05])


def holds(rule, row):
    def within(x, test):
        return x is not None and test(x)

    return (rule.model_id == row.model_id and (rule.selected_side == "ANY" or rule.selected_side == row.selected_side)
            and (rule.observation_delay_bucket is None or rule.observation_delay_bucket == row.observation_delay_bucket) and rule.local_start <= row.local_hhmm < rule.local_end
            and rule.entry_min <= row.best_ask <= rule.entry_max and row.edge_at_best + 1e-12 >= rule.edge_minimum and (rule.spread_maximum is None or within(row.spread, lambda s: s <= rule.spread_maximum + 1e-12)))


def test_matches_are_those_of_a_loop(rows, rules):
    got = {(r.rule_id, r.mapping_id) for r in discovery.match_rules(rows, rules).collect()}
    want = {(u.rule_id, r.mapping_id) for u in rules.collect() for r in rows.collect() if holds(u, r)}
    assert got == want


def test_a_grid_with_gaps_and_no_rows(rows, rules):
    few = rules.where("complexity <> 3 AND model_id = 'a'")
    want = sum(holds(u, r) for u in few.collect() for r in rows.collect())
    assert discovery.match_rules(rows, few).count() == want
    assert discovery.match_rules(rows.where("false"), rules).count() == 0


def test_scores_are_those_of_a_loop(rows, rules):
    dates = sorted({r.market_date for r in rows.collect() if r.label is not None})
    fold = {d: min(i * 3 // (len(dates) - 4), 2) for i, d in enumerate(dates[:-4])}
    given = sorted((r for r in rows.collect() if r.label is not None and r.market_date in fold), key=lambda r: (r.ready, r.snapshot_id, r.mapping_id))
    scored = {r.rule_id: r for r in discovery.score_rules(rows, rules, 3, 4, fill=0.4, daily_cap=60.0, min_dates=2, min_trades=2).collect()}
    for u in rules.collect():
        first, used, days = {}, {}, {}
        for r in given:
            if holds(u, r):
                first.setdefault((r.station, r.market_date), r)
        for r in first.values():
            x = r.sweeps[f"{u.entry_max:.8f}"]
            if x is None or x.cost < 25.0 * 0.4 or used.get(r.market_date, 0.0) + x.cost > 60.0 + 1e-9:
                continue
            used[r.market_date] = used.get(r.market_date, 0.0) + x.cost
            days.setdefault(r.market_date, []).append((x.cost, x.shares - x.cost if r.label else -x.cost, r.station))
        if not days:
            assert u.rule_id not in scored
            continue
        got = scored[u.rule_id]
        flat = [t for d in days.values() for t in d]
        assert got.trades == len(flat) and got.effective_dates == len(days)
        assert got.pnl == pytest.approx(sum(t[1] for t in flat), abs=1e-6)
        assert got.max_station_share == pytest.approx(max(sum(t[2] == s for t in flat) for s in "s0 s1 s2".split()) / len(flat))
        by = {}
        for d, ts in days.items():
            by[fold[d]] = by.get(fold[d], 0.0) + sum(t[1] for t in ts)
        assert (got.populated_folds, got.positive_folds) == (len(by), sum(p > 1e-9 for p in by.values()))


EXECUTIONS = [search.Execution(25.0, 0.3, 0.5), search.Execution(25.0, 0.6, 1.0)]
CONFIG = search.WideSearch(holdout_dates=5, folds=2, minimum_dates=2, minimum_trades=3, minimum_holdout_dates=1, minimum_holdout_trades=1, bootstrap_draws=50, representatives=20, most_conditions=2)


def wide(rows, config=CONFIG):
    named = {f"{e.price_cap:.8f}": e.sweep for e in EXECUTIONS}
    given = rows.withColumn("sweeps", F.transform_keys("sweeps", lambda k, _: F.element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), k)))
    dims = [search.execution_dimension(EXECUTIONS, F.col("best_ask"), F.col("sweeps")), rule_cube.values("selected_side", F.col("selected_side"), ["NO", "YES"]),
            rule_cube.values("geography", F.col("station"), ["s0", "s1", "s2"], [("US", F.col("station") == "s1")]), rule_cube.floors("minimum_edge", F.col("edge_at_best"), [0.2, 0.0]), rule_cube.ceilings("maximum_spread", F.col("spread"), [0.01, 0.05])]
    return search.wide_search(given, dims, EXECUTIONS, config)


def test_wide_search_never_reads_the_holdout_before_its_choice(rows):
    last = sorted({r.market_date for r in rows.where("label IS NOT NULL").collect()})[-5:]
    flipped = rows.withColumn("label", F.when(F.col("market_date").isin(last), 1 - F.col("label")).otherwise(F.col("label")))
    (a, chosen_a), (b, chosen_b) = wide(rows), wide(flipped)
    assert a.count() > 0 and {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    same = [c for c in chosen_a.columns if not c.startswith(("holdout_pnl", "lower", "median", "probability", "survives"))]
    assert {tuple(r) for r in chosen_a.select(*same).collect()} == {tuple(r) for r in chosen_b.select(*same).collect()}
    assert {r.holdout_pnl for r in chosen_a.collect()} != {r.holdout_pnl for r in chosen_b.collect()}


def test_wide_rules_are_distinct_behaviours_within_the_conditions(rows):
    passing, chosen = wide(rows)
    assert passing.where("complexity > 3").count() == 0 and chosen.groupBy("family_id").count().where("count > 1").count() == 0
    alone, _ = wide(rows, dataclasses.replace(CONFIG, most_conditions=0))
    assert {r.complexity for r in alone.collect()} <= {1}


def test_too_many_options_are_refused():
    with pytest.raises(ValueError):
        rule_cube.values("x", F.lit("a"), [str(i) for i in range(rule_cube.MOST_OPTIONS)])
