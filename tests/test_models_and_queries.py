import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from skyledger.operators import dists
from skyledger.plans import calibrate, discovery
from skyledger.queries.replay_queries import grid, rule_rows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def newton(x, y, w, l2):
    X = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ beta))
        g = X.T @ (w * (y - p)) - np.array([0, l2 * beta[1]])
        h = (X * (w * p * (1 - p))[:, None]).T @ X + np.diag([0, l2])
        beta = beta + np.linalg.solve(h, g)
    return beta


def test_logistic_equals_numpy_and_walks_forward(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=400), 2)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + 1.2 * x)))).astype(int)
    w = rng.integers(1, 4, 400).astype(float)
    d = np.arange(400) % 5
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x": x, "y": y, "w": w, "d": d}))
    fit = calibrate.fit_logistic(df, ["g"], ["x"], "y", "w").first()
    assert fit.status == "FITTED" and np.allclose(fit.coefficients, newton(x, y, w, 1.0), atol=1e-6)
    dates = spark.createDataFrame([(i,) for i in range(5)], "eval_date long")
    fits = calibrate.fit_logistic(df, [], ["x"], "y", "w", train_date="d", eval_dates=dates).collect()
    assert sorted(r.eval_date for r in fits) == [1, 2, 3, 4]
    for r in fits:
        m = d < r.eval_date
        assert np.allclose(r.coefficients, newton(x[m], y[m], w[m], 1.0), atol=1e-6)


def test_single_class_falls_back(spark):
    df = spark.createDataFrame([("a", 0.5, 1, 1.0, 0), ("a", 0.6, 1, 1.0, 1)], "g string, p double, y int, w double, d int")
    out = calibrate.walk_forward_calibration(df, "d", "p", "y", "w").orderBy("d").collect()
    assert [(r.fallback_reason, r.calibrated) for r in out] == [("NO_PRIOR_DATES", 0.5), ("INSUFFICIENT_ROWS", 0.6)]


def test_a_label_resolved_after_the_first_decision_teaches_nothing(spark):
    rows = [(d, h, r, 0.3 + 0.1 * (h % 4), (d + h) % 2) for d in range(1, 6) for h in range(12) for r in [d * 100 + (250 if h % 3 == 0 else 50)]]
    df = spark.createDataFrame([(d, d * 100 + h, r, p, y, 1.0) for d, h, r, p, y in rows], "d int, at int, known int, p double, y int, w double")
    out = calibrate.walk_forward_calibration(df, "d", "p", "y", "w", min_rows=4, decided_at="at", resolved_at="known")
    seen = {d: sum(e < d and known < d * 100 for e, _, known, _, _ in rows) for d in range(1, 6)}
    assert {r.d: r.train_rows or 0 for r in out.select("d", "train_rows").distinct().collect()} == seen
    late = df.withColumn("y", F.when(F.col("known") >= 400, 1 - F.col("y")).otherwise(F.col("y")))
    other = calibrate.walk_forward_calibration(late, "d", "p", "y", "w", min_rows=4, decided_at="at", resolved_at="known")
    values = [sorted(r.calibrated for r in o.where("d = 4").collect()) for o in (out, other)]
    assert np.allclose(values[0], values[1]) and seen[4] > 4


def test_changing_holdout_labels_leaves_the_choice(spark):
    rows = rule_rows(spark, "/root/testdata/sf0.01").where("model_id = 'm0'")
    rules = grid(rows).where("model_id = 'm0' and observation_delay_bucket is null and spread_maximum is null")
    last = rows.agg(F.max("market_date")).first()[0]
    flipped = rows.withColumn("label", F.when(F.col("market_date") >= F.date_sub(F.lit(last), 200), 1 - F.col("label")).otherwise(F.col("label")))
    def frozen(data):
        scored = discovery.score_rules(data, rules, 4, 40)
        return discovery.freeze_hash(discovery.family_representatives(scored)).first().freeze_hash
    assert frozen(rows) == frozen(flipped)


def test_known_distributions(spark):
    p = F.array(*[F.lit(float(v)) for v in (0, 0, 1, 0, 0)])
    r = spark.range(1).select(dists.shift_distribution(p, F.lit(0.25)).alias("s"), dists.shift_distribution(p, F.lit(-9.0)).alias("low"),
                              dists.condition_lower(p, F.lit(4.0), 0).alias("c"), dists.normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("z")).first()
    assert np.allclose(r.s, [0, 0, 0.75, 0.25, 0]) and np.allclose(r.low, [1, 0, 0, 0, 0]) and np.allclose(r.c, [0, 0, 0, 0, 1]) and r.z is None


def test_convex_weight_finds_the_minimum(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(0.05, 0.95, 300), rng.uniform(0.05, 0.95, 300)
    w = dists.fit_convex_weight(spark.createDataFrame(pd.DataFrame({"a": a, "b": b})), "a", "b").first().weight
    grid_w = np.linspace(0, 1, 5001)
    best = grid_w[np.argmin([-np.log(g * a + (1 - g) * b).mean() for g in grid_w])]
    assert abs(w - best) < 2e-3


def canonical(df):
    out = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple("~" if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else repr(float(v)) if isinstance(v, (float, np.floating))
                         else str(bool(v)) if isinstance(v, (bool, np.bool_)) else repr(int(v)) if isinstance(v, (int, np.integer)) else str(v) for v in row))
    return sorted(out)


# a cross-section by default; SKYLEDGER_ALL=1 checks every registered query against its SQL
SAMPLE = ["a07_leaderboard", "w05_first_scope_pnl", "a05_slice_tables", "j17_policy_overlap", "j01_value_change", "j04_join_decisions_to_tape", "b08_decision_summaries", "w12_greedy_cap", "d09_shift_distribution",
          "a15_score_distributions", "p05_score_rules", "r01_cluster_bootstrap", "w01_snapshots", "j14_truth_pairs", "s09_parse_markets", "p12_incremental_after_peer", "a14_feed_summary"]
NAMES = sorted(entry_module.oracle_sql()) if os.environ.get("SKYLEDGER_ALL") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(entry_module.oracle_sql()[name]).df()
    got = entry_module.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_entry_returns_the_leaderboard(spark):
    assert entry_module.entry(spark).count() == 12


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
