"""Findings of the third round, second part: each test fails on the code before."""

import pytest
from pyspark.sql import functions as F
from skyledger.operators import rule_cube
from skyledger.plans import search

RUNS = [search.Execution(25.0, 0.3, 0.5), search.Execution(25.0, 0.6, 1.0)]


@pytest.fixture(scope="module")
def small(spark):
    made = spark.range(300).selectExpr("CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS model_id", "'H' AS market_family", "concat('s', CAST(id % 4 AS STRING)) AS station", "date_add(DATE'2024-01-01', CAST(id % 7 AS INT)) AS market_date",
                                       "id % 5 AS ready", "id AS snapshot_id", "id AS mapping_id", "CAST(id * 7 % 2 AS INT) AS label", "CASE WHEN id % 2 = 0 THEN 'YES' ELSE 'NO' END AS side", "(id % 6) / 10D AS ask", "CASE WHEN id % 4 = 0 THEN 10D ELSE 25D END AS cost")
    sweep = {e.sweep: F.when((F.col("ask") <= e.price_cap) & (F.col("ask") > 0), F.struct("cost", (F.col("cost") / F.col("ask")).alias("shares"), F.col("ask").alias("vwap"))) for e in RUNS}
    return made.withColumn("sweeps", F.create_map(*[x for k, v in sweep.items() for x in (F.lit(k), v)]))


def dims():
    return [rule_cube.values("side", F.col("side"), ["YES", "NO"]), search.execution_dimension(RUNS, F.col("ask"), F.col("sweeps")), rule_cube.floors("floor", F.col("ask"), [0.1, 0.3]), rule_cube.values("station", F.col("station"), ["s0", "s1"])]


@pytest.mark.parametrize("most", [0, 1, 2])
def test_few_conditions_are_told_at_once_and_reduced_before_the_executions(small, most):
    sums = {"n": F.sum}
    cells = rule_cube.cells(small, dims()).select("model_id", *[f"_m{i}" for i in range(4)], F.lit(1).cast("long").alias("n"))
    few, every = rule_cube.close(cells, ["model_id"], dims(), sums, most), rule_cube.close(cells, ["model_id"], dims(), sums)
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in every.where(F.col("conditions") <= most).collect()}
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and plan.count("Generate ") == 2 * most + 1


def test_a_day_is_folded_once(small):
    days = search.rule_days(small, dims(), RUNS, (20.0, 60.0), 1)
    assert days._jdf.queryExecution().optimizedPlan().toString().count(" aggregate(") + days._jdf.queryExecution().optimizedPlan().toString().count("[aggregate(") == 1
    # a date whose every trade costs more than the cap has no day, the cap of 20 takes trades of 10 alone
    for r in days.where("daily_cap = 20").collect():
        assert r.cost <= 20.0 and r.trades == r.cost / 10 and len(r.stations) == r.trades
