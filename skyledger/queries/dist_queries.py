"""Distribution kernels and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import prob
from skyledger.operators import dists, metrics
from skyledger.queries.registry import query
from skyledger.queries.views import OBS_SQL, observations, table

# one small distribution per observation: 21 cells, weight falling with the distance from k % 21
CELLS = 21


def dist(spark, sf, spread=1.0):
    rows = observations(spark, sf).withColumn("centre", F.col("k") % CELLS)
    weights = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: 1.0 / (spread + F.abs(i - F.col("centre"))))
    return rows.withColumns({"p": dists.normalize(weights), "local_date": F.to_date("valid"), "target": (F.col("obs_id") % CELLS).cast("int")})


DIST_SQL = OBS_SQL + """, v_cells AS (SELECT obs_id, station, k, k % 21 AS centre, CAST(valid AS DATE) AS local_date, CAST(obs_id % 21 AS INTEGER) AS target, i AS cell, 1.0 / (1 + abs(i - k % 21)) AS w FROM v_obs, (SELECT unnest(range(0, 21)) AS i)),
v_p AS (SELECT *, w / sum(w) OVER (PARTITION BY obs_id) AS p FROM v_cells)"""


def weighted(p, name):
    """Position-weighted digest of an array: it changes when any cell moves."""
    return F.aggregate(F.transform(p, lambda x, i: x * F.pow(i + 1.0, F.lit(2.0))), F.lit(0.0), lambda a, x: a + x).alias(name)


LINES_SQL = """v_lines AS (SELECT l_orderkey AS ladder_id, l_linenumber AS line, l_quantity - 3 AS score, l_discount * 10 AS s1, l_tax * 12 AS s2, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  l_linestatus = 'O' AS progress, l_extendedprice AS price, l_partkey AS partkey FROM lineitem)"""


def lines(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS ladder_id", "l_linenumber AS line", "l_quantity - 3 AS score", "l_discount * 10 AS s1", "l_tax * 12 AS s2",
        "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y", "l_linestatus = 'O' AS progress", "l_extendedprice AS price", "l_partkey AS partkey")


@query("w11_normalize_ladder", f"""WITH {LINES_SQL}, n AS (SELECT *, greatest(score, 0) AS s FROM v_lines), t AS (SELECT ladder_id, sum(s) AS m, count(*) AS c FROM n GROUP BY ladder_id)
  SELECT n.ladder_id, line, partkey, price, CASE WHEN m > 0 THEN s / m ELSE 1.0 / c END AS probability FROM n JOIN t ON t.ladder_id = n.ladder_id""", "probability")
def w11(spark, sf):
    return dists.normalize_ladder(lines(spark, sf), ["ladder_id"], "score", "probability").select("ladder_id", "line", "partkey", "price", "probability")


@query("a16_ladder_metrics", f"""WITH {LINES_SQL}, n AS (SELECT *, greatest(score, 0) AS s FROM v_lines), t AS (SELECT *, sum(s) OVER (PARTITION BY ladder_id) AS m, count(*) OVER (PARTITION BY ladder_id) AS c FROM n),
  q AS (SELECT *, least(greatest(CASE WHEN m > 0 THEN s / m ELSE 1.0 / c END, 1e-12), 1) AS p FROM t), x AS (SELECT *, row_number() OVER (PARTITION BY ladder_id ORDER BY p DESC, line * 10000000 + partkey) AS rk FROM q),
  g AS (SELECT ladder_id, count(*) AS n, sum(CASE WHEN y = 1 THEN -ln(p) END) AS loss, sum(CASE WHEN y = 1 THEN 1 END) AS w, sum((p - y) ** 2) AS sq, sum(y) AS pos, max(CASE WHEN rk = 1 THEN y END) AS top, max(CASE WHEN progress THEN y ELSE 0 END) AS prog FROM x GROUP BY ladder_id)
  SELECT count(*) AS groups, sum(loss) / sum(w) AS grouped_log_loss, sum(sq) / sum(n) AS grouped_brier, avg(top) AS top_accuracy, avg(ln(n)) AS uniform_log_loss, avg((pos * (1.0 / n - 1) ** 2 + (n - pos) * (1.0 / n) ** 2) / n) AS uniform_brier, avg(prog) AS progress_accuracy FROM g""",
       "grouped_log_loss grouped_brier top_accuracy uniform_log_loss uniform_brier progress_accuracy")
def a16(spark, sf):
    df = dists.normalize_ladder(lines(spark, sf), ["ladder_id"], "score", "probability").withColumn("ord", F.col("line") * 10000000 + F.col("partkey"))
    return metrics.ladder_metrics(df, ["ladder_id"], "probability", "y", "progress", "ord")


@query("a50_window_model_comparison", f"""WITH {LINES_SQL}, mm AS (SELECT 'a' AS model, ladder_id % 3 AS win, ladder_id, line, partkey, y, progress, greatest(score, 0) AS s FROM v_lines UNION ALL SELECT 'b', ladder_id % 3, ladder_id, line, partkey, y, progress, price FROM v_lines),
  q AS (SELECT *, least(greatest(CASE WHEN sum(s) OVER w > 0 THEN s / sum(s) OVER w ELSE 1.0 / count(*) OVER w END, 1e-12), 1) AS p FROM mm WINDOW w AS (PARTITION BY model, ladder_id)),
  x AS (SELECT *, row_number() OVER (PARTITION BY model, ladder_id ORDER BY p DESC, line * 10000000 + partkey) AS rk FROM q),
  g AS (SELECT win, model, ladder_id, count(*) AS n, sum(CASE WHEN y = 1 THEN -ln(p) END) AS loss, sum(CASE WHEN y = 1 THEN 1 END) AS w, sum((p - y) ** 2) AS sq, sum(y) AS pos, max(CASE WHEN rk = 1 THEN y END) AS top, max(CASE WHEN progress THEN y ELSE 0 END) AS prog FROM x GROUP BY ALL)
  SELECT win, model, count(*) AS groups, sum(loss) / sum(w) AS grouped_log_loss, sum(sq) / sum(n) AS grouped_brier, avg(top) AS top_accuracy, avg(ln(n)) AS uniform_log_loss, avg((pos * (1.0 / n - 1) ** 2 + (n - pos) * (1.0 / n) ** 2) / n) AS uniform_brier, avg(prog) AS progress_accuracy FROM g GROUP BY ALL""",
       "grouped_log_loss grouped_brier top_accuracy uniform_log_loss uniform_brier progress_accuracy")
def a50(spark, sf):
    df = lines(spark, sf).withColumn("_m", F.explode(F.array(
        F.struct(F.lit("a").alias("model"), F.greatest("score", F.lit(0.0)).alias("s")), F.struct(F.lit("b").alias("model"), F.col("price").alias("s")))))
    df = df.select("ladder_id", (F.col("ladder_id") % 3).alias("win"), "line", "partkey", "y", "progress", "_m.*").withColumn("ord", F.col("line") * 10000000 + F.col("partkey"))
    norm = dists.normalize_ladder(df, ["model", "ladder_id"], "s", "probability")
    return metrics.ladder_metrics(norm, ["ladder_id"], "probability", "y", "progress", "ord", ["win", "model"])


@query("d01_bucket_ladder", f"""WITH {OBS_SQL}, s AS (SELECT station, obs_id, tmpf, floor(tmpf) AS c, i FROM v_obs, (SELECT unnest(range(0, 9)) AS i) WHERE tmpf IS NOT NULL),
  b AS (SELECT *, CASE WHEN i > 0 THEN c - 3 + i - 1 END AS lo, CASE WHEN i < 8 THEN c - 3 + i END AS hi FROM s)
  SELECT station, i AS bucket_index, count(*) AS n, sum(lo) AS lower_sum, sum(hi) AS upper_sum, sum(CASE WHEN (lo IS NULL OR tmpf >= lo) AND (hi IS NULL OR tmpf < hi) THEN 1 ELSE 0 END)::BIGINT AS winners FROM b GROUP BY ALL""", "lower_sum upper_sum")
def d01(spark, sf):
    rows = dists.bucket_ladder(observations(spark, sf), "tmpf", 3)
    return rows.groupBy("station", "bucket_index").agg(F.count(F.lit(1)).alias("n"), F.sum("bucket_lower").alias("lower_sum"),
                                                       F.sum("bucket_upper").alias("upper_sum"), F.sum("target").alias("winners"))


@query("d02_fixed_support", f"""WITH {OBS_SQL} SELECT i AS support_value, count(*) AS n, count(CASE WHEN i > -20 THEN 1 END) AS with_lower, count(CASE WHEN i < 130 THEN 1 END) AS with_upper FROM v_obs, (SELECT unnest(range(-20, 131)) AS i) GROUP BY i""")
def d02(spark, sf):
    return dists.fixed_support(observations(spark, sf)).groupBy("support_value").agg(
        F.count(F.lit(1)).alias("n"), F.count("bucket_lower").alias("with_lower"), F.count("bucket_upper").alias("with_upper"))


@query("d03_threshold_examples", f"""WITH {OBS_SQL}, t AS (SELECT station, tmpf, round_even(tmpf + o, 0) AS threshold FROM v_obs, (SELECT unnest([-4, -3, -2, -1, 0, 1, 2, 3, 4]) AS o) WHERE tmpf IS NOT NULL)
  SELECT station, count(*) AS n, sum(threshold) AS thresholds, sum(CASE WHEN tmpf >= threshold THEN 1 ELSE 0 END)::BIGINT AS targets FROM t GROUP BY station""", "thresholds")
def d03(spark, sf):
    rows = dists.threshold_examples(observations(spark, sf), "tmpf", [-4, -3, -2, -1, 0, 1, 2, 3, 4])
    return rows.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.sum("threshold").alias("thresholds"), F.sum("target").alias("targets"))


@query("d04_empirical_bucket_prob", f"""WITH {OBS_SQL}, r AS (SELECT CASE WHEN k < 40 THEN 'early' ELSE 'late' END AS w, round(tmpf - dwpf - 25, 2) AS v FROM v_obs WHERE tmpf IS NOT NULL AND k >= 20),
  c AS (SELECT obs_id, CASE WHEN k < 20 THEN 'none' WHEN k < 40 THEN 'early' ELSE 'late' END AS w, dwpf + 25 AS mu, CASE WHEN k % 5 <> 0 THEN floor(dwpf + 20) + 0.5 END AS lo, CASE WHEN k % 7 <> 0 THEN floor(dwpf + 26) + 0.5 END AS hi FROM v_obs WHERE obs_id % 10 = 3 OR k >= 0),
  z AS (SELECT CASE WHEN w = 'none' THEN '*' ELSE w END AS w, lo, hi, mu, obs_id FROM c), rr AS (SELECT * FROM r UNION ALL SELECT '*', v FROM r), q AS (SELECT w, v, count(*) AS n FROM rr GROUP BY ALL)
  SELECT obs_id, sum(CASE WHEN (lo IS NULL OR round(v * 1e6) >= round((lo - mu) * 1e6)) AND (hi IS NULL OR round(v * 1e6) < round((hi - mu) * 1e6)) THEN n ELSE 0 END) / sum(n) AS probability FROM z JOIN q ON q.w = z.w GROUP BY obs_id""", "probability")
def d04(spark, sf):
    obs = observations(spark, sf)
    win = F.when(F.col("k") < 40, "early").otherwise("late")
    res = obs.where("tmpf is not null and k >= 20").select(win.alias("window"), F.round(F.col("tmpf") - F.col("dwpf") - 25, 2).alias("residual"))
    cand = obs.select("obs_id", F.when(F.col("k") < 20, "none").otherwise(win).alias("window"), (F.col("dwpf") + 25).alias("mu"),
                      F.when(F.col("k") % 5 != 0, F.floor(F.col("dwpf") + 20) + 0.5).alias("lo"), F.when(F.col("k") % 7 != 0, F.floor(F.col("dwpf") + 26) + 0.5).alias("hi"))
    return dists.empirical_bucket_prob(cand, res, "window", "mu", "lo", "hi", "residual", "probability").select("obs_id", "probability")


def cdf_sql(x: str, mu: str, s: str) -> str:
    z = f"(({x} - {mu}) / ({s} * sqrt(2.0)))"
    t = f"(1.0 / (1.0 + 0.3275911 * abs({z})))"
    poly = f"((((1.061405429 * {t} + -1.453152027) * {t} + 1.421413741) * {t} + -0.284496736) * {t} + 0.254829592)"
    return f"(0.5 * (1 + sign({z}) * (1 - {poly} * {t} * exp(-{z} * {z}))))"


@query("d05_normal_bucket_prob", f"""WITH {OBS_SQL}, c AS (SELECT obs_id, tmpf AS mu, 1.0 + k % 7 AS s, CASE WHEN k % 5 <> 0 THEN floor(tmpf) - 1.0 END AS lo, CASE WHEN k % 3 <> 0 THEN floor(tmpf) + 1.0 END AS hi FROM v_obs WHERE tmpf IS NOT NULL)
  SELECT obs_id, greatest(CASE WHEN hi IS NULL THEN 1.0 ELSE {cdf_sql('hi', 'mu', 's')} END - CASE WHEN lo IS NULL THEN 0.0 ELSE {cdf_sql('lo', 'mu', 's')} END, 0) AS probability FROM c""", "probability")
def d05(spark, sf):
    rows = observations(spark, sf).where("tmpf is not null")
    lo = F.when(F.col("k") % 5 != 0, F.floor("tmpf") - 1.0)
    hi = F.when(F.col("k") % 3 != 0, F.floor("tmpf") + 1.0)
    return rows.select("obs_id", dists.normal_bucket_prob(F.col("tmpf"), 1.0 + F.col("k") % 7, lo, hi).alias("probability"))


@query("d06_normal_support", f"""WITH {OBS_SQL}, c AS (SELECT obs_id, tmpf AS mu, greatest(0.2 + k % 7, 0.5) AS s, v FROM v_obs, (SELECT unnest(range(-20, 131)) AS v) WHERE tmpf IS NOT NULL),
  m AS (SELECT obs_id, v, greatest(CASE WHEN v = 130 THEN 1.0 ELSE {cdf_sql('(v + 0.5)', 'mu', 's')} END - CASE WHEN v = -20 THEN 0.0 ELSE {cdf_sql('(v - 0.5)', 'mu', 's')} END, 0) AS p FROM c)
  SELECT obs_id, sum(p * (v + 21.0) ** 2) / sum(p) AS digest FROM m GROUP BY obs_id""", "digest", 5)
def d06(spark, sf):
    rows = observations(spark, sf).where("tmpf is not null")
    return rows.select("obs_id", weighted(dists.normal_support(F.col("tmpf"), 0.2 + F.col("k") % 7), "digest"))


@query("d07_monotone_bucket_prob", f"""WITH {LINES_SQL}, pt AS (SELECT ladder_id, line AS t, s1 AS s FROM v_lines UNION ALL SELECT ladder_id, line + 1, s2 FROM v_lines),
  c AS (SELECT ladder_id, t, least(greatest(avg(s), 0), 1) AS s FROM pt GROUP BY ALL), q AS (SELECT *, row_number() OVER w AS i, sum(s) OVER w AS upto, count(*) OVER (PARTITION BY ladder_id) AS n FROM c WINDOW w AS (PARTITION BY ladder_id ORDER BY t)),
  g AS (SELECT ladder_id, max(n) AS n, list_prepend(0.0, list(upto ORDER BY i)) AS cs FROM q GROUP BY ladder_id),
  kj AS (SELECT ladder_id, k, j, (cs[j + 1] - cs[k]) / (j - k + 1) AS m FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM g), LATERAL (SELECT unnest(range(k, n + 1)) AS j) x),
  ki AS (SELECT ladder_id, k, j AS i, max(m) OVER (PARTITION BY ladder_id, k ORDER BY j DESC) AS most FROM kj), f AS (SELECT ladder_id, i, min(most) AS fit FROM ki GROUP BY ALL),
  z AS (SELECT q.ladder_id, q.t, f.fit FROM q JOIN f ON f.ladder_id = q.ladder_id AND f.i = q.i)
  SELECT v.ladder_id, line, partkey, price, greatest(a.fit - b.fit, 0) AS probability FROM v_lines v JOIN z a ON a.ladder_id = v.ladder_id AND a.t = line JOIN z b ON b.ladder_id = v.ladder_id AND b.t = line + 1""", "probability")
def d07(spark, sf):
    rows = lines(spark, sf).select("ladder_id", "line", "partkey", "price", F.col("line").cast("double").alias("lower_threshold"), F.col("s1").alias("lower_survival"),
                                   (F.col("line") + 1).cast("double").alias("upper_threshold"), F.col("s2").alias("upper_survival"))
    return dists.monotone_bucket_prob(rows, ["ladder_id"]).select("ladder_id", "line", "partkey", "price", "probability")


@query("d08_condition_lower", f"""WITH {DIST_SQL}, h AS (SELECT *, CAST(round_even((obs_id % 25) * 0.75 - 1.25, 0) AS INTEGER) AS hi FROM v_p), c AS (SELECT *, CASE WHEN cell >= greatest(hi, 0) THEN p ELSE 0 END AS kept FROM h), t AS (SELECT *, sum(kept) OVER (PARTITION BY obs_id) AS m FROM c)
  SELECT obs_id, sum(CASE WHEN m > 0 THEN kept / m WHEN cell = hi THEN 1.0 ELSE 0 END * (cell + 1.0) ** 2) AS digest FROM t GROUP BY obs_id""", "digest")
def d08(spark, sf):
    high = (F.col("obs_id") % 25) * 0.75 - 1.25
    rows = dist(spark, sf)
    return rows.select("obs_id", weighted(dists.condition_lower(F.col("p"), high, 0), "digest"))


@query("d09_shift_distribution", f"""WITH {DIST_SQL}, s AS (SELECT obs_id, p, cell + ((obs_id % 31) - 15) * 0.25 AS dest FROM v_p), d AS (SELECT obs_id, least(greatest(floor(dest), 0), 20) AS cell, p * (1 - (dest - floor(dest))) AS p FROM s UNION ALL SELECT obs_id, least(greatest(ceil(dest), 0), 20), p * (dest - floor(dest)) FROM s)
  SELECT obs_id, sum(p * (cell + 1.0) ** 2) / sum(p) AS digest FROM d GROUP BY obs_id""", "digest")
def d09(spark, sf):
    moved = dists.shift_distribution(F.col("p"), ((F.col("obs_id") % 31) - 15) * 0.25)
    return dist(spark, sf).select("obs_id", weighted(moved, "digest"))


@query("d10_hurdle_distribution", f"""WITH {OBS_SQL}, h AS (SELECT obs_id, 1.0 / (1 + k % 5) AS peak, k % 21 AS hi FROM v_obs), d AS (SELECT obs_id, hi AS cell, peak AS p FROM h UNION ALL SELECT obs_id, least(hi + x.d, 20), (1 - peak) * x.m FROM h, (VALUES (1, 0.5), (2, 0.3), (3, 0.2)) x(d, m))
  SELECT obs_id, sum(p * (cell + 1.0) ** 2) / sum(p) AS digest FROM d GROUP BY obs_id""", "digest")
def d10(spark, sf):
    deltas = F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))
    out = dists.hurdle_distribution(1.0 / (1 + F.col("k") % 5), deltas, F.col("k") % CELLS, 0, 20)
    return observations(spark, sf).select("obs_id", weighted(out, "digest"))


@query("d10_ordinal_deltas", f"""WITH {OBS_SQL}, s AS (SELECT obs_id, 1.0 AS a, (k % 10) / 10.0 AS b, (k % 7) / 7.0 AS c FROM v_obs), f AS (SELECT obs_id, a, least(a, b) AS b, least(a, b, c) AS c FROM s)
  SELECT obs_id, greatest(a - b, 0) AS d1, greatest(b - c, 0) AS d2, greatest(c - 0, 0) AS d3 FROM f""", "d1 d2 d3")
def d10b(spark, sf):
    out = dists.ordinal_deltas(F.array(F.lit(1.0), (F.col("k") % 10) / 10.0, (F.col("k") % 7) / 7.0))
    return observations(spark, sf).withColumn("d", out).select("obs_id", *[F.col("d")[i].alias(f"d{i + 1}") for i in range(3)])


@query("d11_ladder_to_support", f"""WITH {OBS_SQL}, b AS (SELECT obs_id, NULL AS lo, k % 10 + 5 AS hi, 1.0 + k % 3 AS price FROM v_obs UNION ALL SELECT obs_id, k % 10 + 5 + CASE WHEN k % 7 = 0 THEN 1 WHEN k % 11 = 0 THEN -1 ELSE 0 END, k % 10 + 8, 2.0 FROM v_obs UNION ALL SELECT obs_id, k % 10 + 8, NULL, 3.0 FROM v_obs),
  c AS (SELECT b.*, i, sum(1) OVER (PARTITION BY b.obs_id, lo, hi) AS width FROM b, (SELECT unnest(range(0, 21)) AS i) WHERE (lo IS NULL OR i >= lo) AND (hi IS NULL OR i < hi)),
  m AS (SELECT obs_id, sum(price) AS mass FROM b GROUP BY obs_id), z AS (SELECT c.obs_id, i, sum(price / mass / width) AS p, count(*) AS k FROM c JOIN m ON m.obs_id = c.obs_id GROUP BY ALL),
  r AS (SELECT obs_id, CASE WHEN max(k) > 1 THEN 'overlapping_buckets' WHEN count(*) <> 21 THEN 'uncovered_cells' ELSE 'OK' END AS reason, sum(p * (i + 1.0) ** 2) AS digest FROM z GROUP BY obs_id) SELECT obs_id, reason, CASE WHEN reason = 'OK' THEN digest END AS digest FROM r""", "digest")
def d11(spark, sf):
    start = F.col("k") % 10 + 5
    none = F.lit(None).cast("double")
    shift = F.when(F.col("k") % 7 == 0, 1).when(F.col("k") % 11 == 0, -1).otherwise(0)
    def bucket(lo, hi, price):
        return F.struct(lo.cast("double").alias("bucket_lower"), hi.cast("double").alias("bucket_upper"), price.cast("double").alias("price"))
    ladder = F.array(bucket(none, start, 1.0 + F.col("k") % 3), bucket(start + shift, start + 3, F.lit(2.0)), bucket(start + 3, none, F.lit(3.0)))
    rows = observations(spark, sf).select("obs_id", F.explode(ladder).alias("b")).select("obs_id", "b.*")
    out = dists.ladder_to_support(rows, ["obs_id"], "price", 0, 20)
    return out.select("obs_id", F.coalesce("reason", F.lit("OK")).alias("reason"), weighted(F.col("p"), "digest"))


@query("d12_bucket_mass", f"""WITH {DIST_SQL} SELECT obs_id, sum(CASE WHEN (obs_id % 5 = 0 OR cell >= obs_id % 20) AND (obs_id % 7 = 0 OR cell <= obs_id % 20 + 3) THEN p ELSE 0 END) AS mass FROM v_p GROUP BY obs_id""", "mass")
def d12(spark, sf):
    lo = F.when(F.col("obs_id") % 5 != 0, (F.col("obs_id") % 20).cast("double"))
    hi = F.when(F.col("obs_id") % 7 != 0, (F.col("obs_id") % 20 + 3).cast("double"))
    return dist(spark, sf).select("obs_id", dists.bucket_mass(F.col("p"), lo, hi, 0).alias("mass"))


def _narrowing_sql(rounds: int = 3, steps: int = 20) -> str:
    """The grid of each round around the best weight of the round before."""
    out = ["w0 AS (SELECT 0.5::DOUBLE AS weight, 0.5::DOUBLE AS width, 0.0::DOUBLE AS log_loss)"]
    for k in range(rounds):
        out.append(f"e{k} AS (SELECT greatest(0.0, weight - width) AS lo, least(1.0, weight + width) AS hi FROM w{k})")
        out.append(f"l{k} AS (SELECT lo + (hi - lo) * i / {steps} AS w, (hi - lo) / {steps} AS width, avg(-ln(greatest(least((lo + (hi - lo) * i / {steps}) * a + (1 - (lo + (hi - lo) * i / {steps})) * b, 1.0), 1e-12))) AS loss FROM ab, e{k}, (SELECT unnest(range(0, {steps + 1})) AS i) GROUP BY ALL)")
        out.append(f"w{k + 1} AS (SELECT w AS weight, width, loss AS log_loss FROM l{k} ORDER BY loss, w LIMIT 1)")
    return ", ".join(out)


@query("d13_fit_convex_weight", f"""WITH {DIST_SQL}, ab AS (SELECT obs_id, max(p) FILTER (WHERE cell = target) AS a, max(p) FILTER (WHERE cell = (target + k) % 21) AS b FROM v_p GROUP BY obs_id), {_narrowing_sql()}
  SELECT weight, log_loss FROM w3""", "weight log_loss", 5)
def d13(spark, sf):
    rows = dist(spark, sf).withColumns({"a": F.try_element_at("p", F.col("target") + 1), "b": F.try_element_at("p", F.pmod(F.col("target") + F.col("k"), F.lit(CELLS)) + 1)})
    return dists.fit_convex_weight(rows, "a", "b")


@query("d14_temperature_scale", f"""WITH {DIST_SQL}, g AS (SELECT unnest([0.5, 0.8, 1.0, 1.5, 2.5, 4.0]) AS t), s AS (SELECT 'm' || (k % 3) AS model_name, CAST(station % 5 AS VARCHAR) AS station, obs_id, t, target, cell, exp(ln(least(greatest(p, 1e-6), 1 - 1e-6)) / t) AS e FROM v_p, g),
  n AS (SELECT *, e / sum(e) OVER (PARTITION BY obs_id, t) AS q FROM s), l AS (SELECT model_name, station, t, -ln(least(greatest(q, 1e-6), 1 - 1e-6)) AS loss FROM n WHERE cell = target), z AS (SELECT * FROM l UNION ALL SELECT model_name, '*', t, loss FROM l),
  a AS (SELECT model_name, station, t, avg(loss) AS loss, count(*) AS c FROM z GROUP BY ALL) SELECT model_name, station, CAST(arg_min(t, loss) AS DOUBLE) AS temperature, min(loss) AS log_loss, max(c) AS snapshots FROM a WHERE c >= 50 GROUP BY ALL""", "temperature log_loss")
def d14(spark, sf):
    rows = dist(spark, sf).select(F.concat(F.lit("m"), F.col("k") % 3).alias("model_name"), (F.col("station") % 5).cast("string").alias("station"), "p", "target")
    return dists.fit_temperatures(rows, "p", "target", 50, grid=(0.5, 0.8, 1.0, 1.5, 2.5, 4.0))


@query("d15_prune_duplicates", """WITH s AS (SELECT s_suppkey, s_acctbal, CASE WHEN lag(s_acctbal) OVER (ORDER BY s_suppkey) > 2000 THEN 0 ELSE 1 END AS head FROM supplier), g AS (SELECT *, sum(head) OVER (ORDER BY s_suppkey) AS grp FROM s), r AS (SELECT *, min(s_suppkey) OVER (PARTITION BY grp) AS rep FROM g)
  SELECT 's' || s_suppkey AS name, 's' || rep AS representative, CASE WHEN s_suppkey = rep THEN 'RETAIN' ELSE 'COLLAPSE_DUPLICATE' END AS decision FROM r""")
def d15(spark, sf):
    s = table(spark, sf, "supplier")
    names = s.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("name"), F.col("s_suppkey").alias("position"))
    top = s.agg(F.max("s_suppkey").alias("top"))
    edges = s.where("s_acctbal > 2000").join(F.broadcast(top), F.lit(True)).where("s_suppkey < top").select(
        F.concat(F.lit("s"), F.col("s_suppkey")).alias("a"), F.concat(F.lit("s"), F.col("s_suppkey") + 1).alias("b"))
    return dists.prune_duplicates(names, edges)


SCORE_COLS = "log_loss rps threshold_brier top_accuracy entropy"


@query("a15_score_distributions", f"""WITH {DIST_SQL}, c AS (SELECT *, sum(p) OVER (PARTITION BY obs_id ORDER BY cell) AS cum, row_number() OVER (PARTITION BY obs_id ORDER BY p DESC, cell) AS rk FROM v_p),
  r AS (SELECT station, local_date, obs_id, -ln(max(CASE WHEN cell = target THEN least(greatest(p, 1e-12), 1) END)) AS ll, sum((cum - CASE WHEN cell >= target THEN 1 ELSE 0 END) ** 2) AS rps, max(CASE WHEN rk = 1 AND cell = target THEN 1.0 ELSE 0.0 END) AS top, -sum(p * ln(greatest(p, 1e-12))) AS ent FROM c GROUP BY ALL),
  d AS (SELECT station, local_date, count(*) AS n, avg(ll) AS ll, avg(rps) AS rps, avg(rps / 20) AS tb, avg(top) AS top, avg(ent) AS ent FROM r GROUP BY ALL)
  SELECT station, sum(n)::BIGINT AS rows, count(*) AS dates, avg(ll) AS log_loss, avg(rps) AS rps, avg(tb) AS threshold_brier, avg(top) AS top_accuracy, avg(ent) AS entropy FROM d GROUP BY station""", SCORE_COLS)
def a15(spark, sf):
    return metrics.score_distributions(dist(spark, sf), "p", F.col("target"), "local_date", ["station"])


@query("a24_pairwise_models", f"""WITH {OBS_SQL}, x AS (SELECT obs_id, m, i AS cell, 1.0 / (1 + m + abs(i - (k + m * obs_id) % 21)) AS w FROM v_obs, (SELECT unnest(range(0, 21)) AS i), (SELECT unnest([0, 1, 2]) AS m)), p AS (SELECT *, w / sum(w) OVER (PARTITION BY obs_id, m) AS p FROM x),
  j AS (SELECT a.obs_id, a.m AS ma, b.m AS mb, a.cell, a.p AS pa, b.p AS pb FROM p a JOIN p b ON a.obs_id = b.obs_id AND a.cell = b.cell AND a.m < b.m), c AS (SELECT ma, mb, corr(pa, pb) AS pc FROM j GROUP BY ALL),
  r AS (SELECT obs_id, ma, mb, 0.5 * sum(abs(pa - pb)) AS tv, sum(pa * cell) AS ea, sum(pb * cell) AS eb FROM j GROUP BY ALL), s AS (SELECT ma, mb, count(*) AS rows, corr(ea, eb) AS mc, avg(tv) AS tv, avg(abs(ea - eb)) AS md FROM r GROUP BY ALL)
  SELECT 'm' || s.ma AS model_a, 'm' || s.mb AS model_b, rows, pc AS probability_correlation, mc AS mean_correlation, tv AS mean_total_variation, md AS mean_abs_mean_difference FROM s JOIN c ON c.ma = s.ma AND c.mb = s.mb""",
       "probability_correlation mean_correlation mean_total_variation mean_abs_mean_difference")
def a24(spark, sf):
    rows = observations(spark, sf).withColumn("m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    centre = (F.col("k") + F.col("m") * F.col("obs_id")) % CELLS
    cells = F.sequence(F.lit(0), F.lit(CELLS - 1))
    rows = rows.select("obs_id", F.concat(F.lit("m"), F.col("m")).alias("model"), F.transform(cells, lambda i: 1.0 / (1.0 + F.col("m") + F.abs(i - centre))).alias("p"))
    return metrics.pairwise_models(rows, ["obs_id"], "model", "p", cells)


@query("a49_coherence", f"""WITH {DIST_SQL} SELECT station, count(*) AS n, sum(CASE WHEN below > 1e-12 THEN 1 ELSE 0 END)::BIGINT AS violations FROM (SELECT obs_id, station, sum(CASE WHEN cell < k % 4 THEN p ELSE 0 END) AS below FROM v_p GROUP BY ALL) GROUP BY station""")
def a49(spark, sf):
    from skyledger.plans.evaluation import coherence

    return coherence(dist(spark, sf), "p", F.col("k") % 4, ["station"])
