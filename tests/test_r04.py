"""Findings of the fourth round: each test fails on the code before."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from skyledger.plans import calibrate, replay
from skyledger.queries import ORACLES, model_queries

SF = "/root/testdata/sf0.001"


def counted(spark, df, name):
    """`df` whose text column `name` passes a function that counts the rows it is computed for."""
    seen = spark.sparkContext.accumulator(0)

    def passed(value):
        seen.add(1)
        return value
    return df.withColumn(name, F.udf(passed, "string").asNondeterministic()(name)), seen


def test_m11_makes_each_basket_once(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    made, seen = counted(spark, model_queries.baskets_in(spark, SF).withColumn("mark", F.lit("a")), "mark")
    monkeypatch.setattr(model_queries, "baskets_in", lambda *_: made.where("mark = 'a'"))
    out = model_queries.m11(spark, SF).collect()
    assert seen.value == rows
    db = duckdb.connect()
    db.execute(f"create view lineitem as from '{SF}/lineitem.parquet'")
    want = {r[0]: r[1:] for r in db.execute(ORACLES["m11_fit_clusters"]).fetchall()}
    assert set(want) == {r.model_name for r in out}
    for r in out:
        assert (r.n, pytest.approx(r.by_mass, abs=2e-6), pytest.approx(r.by_context, abs=2e-6)) == want[r.model_name]


def clusters(spark):
    # 8 dates of 30 clusters; every fifth has no label
    return spark.range(240).selectExpr("date_add(DATE'2024-01-01', CAST(id % 8 AS INT)) AS d", "CAST(id AS STRING) AS name", "(1 + id % 5) / 7D AS mass", "(id % 3) / 4D AS ask",
                                       "CASE WHEN id % 5 <> 4 THEN CAST(id * id % 7 < 3 AS INT) END AS y")


def test_clusters_are_read_once_for_both_fits_and_once_for_the_result(spark):
    df, seen = counted(spark, clusters(spark).withColumn("mark", F.lit("a")), "mark")
    df = df.withColumn("mass", F.when(F.col("mark") == "a", F.col("mass")))
    assert calibrate.fit_clusters(df, "d", "mass", "y", ["ask"], 20).select("mass_calibrated", "context_calibrated").collect()
    assert seen.value == 2 * 240


def test_clusters_equal_plain_fits_and_rows_with_counts(spark):
    out = calibrate.fit_clusters(clusters(spark), "d", "mass", "y", ["ask"], 50).toPandas()
    d, y = out.d.to_numpy(), out.y.to_numpy(dtype=float)
    logit = np.log(out.mass / (1 - out.mass)).to_numpy()
    for name, x in (("mass_calibrated", [logit]), ("context_calibrated", [logit, out.ask.to_numpy()])):
        x = np.column_stack([np.ones(len(out)), *x])
        ridge = np.diag([0.0, *[1.0] * (x.shape[1] - 1)])
        for day in sorted(set(d)):
            past, now = (d < day) & ~np.isnan(y), d == day
            if past.sum() < 50:  # rows without a label teach nothing and do not count
                assert np.allclose(out[name][now], out.mass[now])
                continue
            b = np.zeros(x.shape[1])
            for _ in range(30):
                p = 1 / (1 + np.exp(-x[past] @ b))
                b = b + np.linalg.solve((x[past] * (p * (1 - p))[:, None]).T @ x[past] + ridge, x[past].T @ (y[past] - p) - ridge @ b)
            assert np.allclose(out[name][now], 1 / (1 + np.exp(-x[now] @ b)), atol=1e-7)
    alike = clusters(spark).groupBy("d", "mass", "ask", "y").agg(F.count(F.lit(1)).alias("times"))
    few = calibrate.fit_clusters(alike, "d", "mass", "y", ["ask"], 50, n="times").toPandas()
    key = ["d", "mass", "ask", "mass_calibrated", "context_calibrated"]
    assert few.times.sum() == 240 and len(few) < 240
    assert set(map(tuple, few[key].round(7).to_numpy())) == set(map(tuple, out[key].round(7).to_numpy()))


def test_a_basket_is_sorted_once_and_equals_plain_python(spark):
    rng = np.random.default_rng(4)

    def ladder(size):
        return [(None if rng.random() < 0.1 else f"b{rng.integers(4)}", None if rng.random() < 0.1 else float(rng.integers(-1, 4)) / 4, None if rng.random() < 0.1 else float(rng.integers(0, 5)) / 4,
                 [True, False, None][rng.integers(3)]) for _ in range(size)]
    data = [(i, ladder(int(rng.integers(0, 9))) if i else None) for i in range(300)]
    rows = spark.createDataFrame(data, "id int, candidates array<struct<bucket:string,fair_yes:double,yes_ask:double,won:boolean>>")
    out = replay.top_n_basket(rows, 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("array_sort|sort_array", plan)) == 1
    want = {}
    for i, ladder_of in data:
        good = [(-f, a, b, w) for b, f, a, w in ladder_of or [] if b is not None and f is not None and a is not None and f >= 0 and 0 < a < 1]
        top = sorted(good, key=lambda t: (*t[:3], {None: 0, False: 1, True: 2}[t[3]]))[:3]
        if len(top) == 3:
            won = [t[3] for t in top]
            want[i] = (sum(t[1] for t in top), -sum(t[0] for t in top), True if True in won else None if None in won else False, [t[2] for t in top])
    got = {r.id: (r.ask_sum, r.fair_mass, r.hit, r.buckets) for r in out.collect()}
    assert got == want and len(want) > 30


def test_examples_stand_beside_later_dates_by_running_sums(spark):
    rng = np.random.default_rng(5)
    data = [(["a", "b"][i % 2], None if i % 17 == 0 else int(rng.integers(0, 25)), int(rng.integers(3)), int(rng.integers(2)), float(rng.integers(1, 4)), 1) for i in range(200)]
    rows = spark.createDataFrame(data, "g string, d int, x int, y int, _w double, _n long")
    days = [3, 4, 9, 10, 20]
    dates = spark.createDataFrame([(d,) for d in [*days, None]], "eval_date int")
    sums = [F.sum("_w").alias("_w"), F.sum("_n").alias("_n")]
    out = calibrate._known_before(rows, ["g"], ["x"], "y", "d", None, dates, sums)
    want = {}
    for g, d, x, y, w, n in data:
        for e in days:
            if d is not None and d < e:
                at = want.get((g, e, x, y), (0.0, 0))
                want[g, e, x, y] = (at[0] + w, at[1] + n)
    got = out.select("g", "eval_date", "x", "y", "_w", "_n").collect()
    assert len(got) == len(want) and {tuple(r[:4]): tuple(r[4:]) for r in got} == want
    # the dates are the last thing made: rows by example and date are never made for every earlier date and added up after
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[:plan.index("Generate")]
