"""The wide rule search over signals, beside a twin that pairs every row with every state it meets."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import rule_cube
from skyledger.plans import search
from skyledger.queries.registry import query
from skyledger.queries.views import SIGNAL_SQL, signals

CONFIG = search.WideSearch(holdout_dates=40, folds=4, minimum_dates=8, minimum_trades=20, bootstrap_draws=200, representatives=250, most_conditions=1)
EXECUTIONS = [search.Execution(t, cap, fill) for t in (25.0, 50.0, 100.0) for cap in (0.35, 0.50) for fill in (0.25, 0.50, 0.75, 1.0)]
WINDOWS = [("00:00", "06:00"), ("06:00", "12:00"), ("09:00", "12:00"), ("12:00", "15:00"), ("12:00", "18:00"), ("18:00", "24:00")]
ENTRY = [0.1, 0.15, 0.2, 0.3]
EDGE = [-0.1, 0.0, 0.02, 0.05, 0.1, 0.2]
SPREAD = [0.02, 0.05, 0.1]
AGE = [5.0, 10.0, 15.0, 20.0]
DELAY = [1000.0, 5000.0, 10000.0, 20000.0]

# what a decision has beside its signal
WIDE = """
id AS snapshot_id
| ts AS ready
| market_date
| market_family
| model_name AS model_id
| concat(CASE WHEN minute_of_day % 2 = 0 THEN 'K' ELSE 'E' END, station) AS station
| selected_side
| strategy_bucket
| fair >= 0.5 AS high_conviction
| obs_delay_bucket
| CASE WHEN minute_of_day < 360 THEN 'early' WHEN minute_of_day < 900 THEN 'peak' ELSE 'late' END AS lifecycle
| selected_bucket
| entry AS best_ask
| edge
| CASE WHEN minute_of_day % 50 > 0 THEN book_age / 1000 END AS spread
| cost / 2 AS age
| CAST(minute_of_day * 17 % 25000 AS DOUBLE) AS delay_ms
| liquidity
| correct AS label
"""
COLUMNS = [c.strip() for c in WIDE.strip().split("\n|")]


def wide_rows(spark, sf):
    """Signals as decisions, with the sweep of each target under each cap: what liquidity there is, at the ask."""
    def sweep(e):
        cost = F.least(F.lit(e.target), F.col("liquidity"))
        return F.when(F.col("entry") <= e.price_cap, F.struct(cost.alias("cost"), (cost / F.col("entry")).alias("shares"), F.col("entry").alias("vwap")))

    kinds = {e.sweep: e for e in EXECUTIONS}
    sweeps = F.create_map(*[x for k, e in kinds.items() for x in (F.lit(k), sweep(e))])
    df = signals(spark, sf).withColumns({"sweeps": sweeps, "mapping_id": F.struct("id", "liquidity"), "hhmm": F.date_format("ts", "HH:mm")})
    return df.selectExpr(*COLUMNS, "sweeps", "mapping_id", "hhmm")


def dimensions(rows):
    """The thirteen dimensions, with the values that the rows hold where a dimension takes values."""
    seen = rows.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in ("strategy_bucket", "selected_side", "obs_delay_bucket", "lifecycle", "station")]).first()
    col, shape = F.col, F.substring("selected_bucket", 1, 2)
    return [
        search.execution_dimension(EXECUTIONS, col("best_ask"), col("sweeps")),
        *[rule_cube.values(n, col(n), seen[n]) for n in ("strategy_bucket", "selected_side")],
        rule_cube.tests("conviction", [("HIGH", col("high_conviction")), ("LOW", ~col("high_conviction"))]),
        *[rule_cube.values(n, col(n), seen[n]) for n in ("obs_delay_bucket", "lifecycle")],
        rule_cube.values("geography", col("station"), seen["station"], [("US", col("station").startswith("K")), ("INTERNATIONAL", ~col("station").startswith("K"))]),
        rule_cube.tests("local_window", [(f"{a}-{b}", (col("hhmm") >= a) & (col("hhmm") < b)) for a, b in WINDOWS]),
        rule_cube.tests("bucket_shape", [("INTERVAL", ~shape.isin("<=", ">=")), ("LOWER_TAIL", shape == "<="), ("UPPER_TAIL", shape == ">=")]),
        rule_cube.floors("entry_floor", col("best_ask"), ENTRY), rule_cube.floors("minimum_edge", col("edge"), EDGE),
        rule_cube.ceilings("maximum_spread", col("spread"), SPREAD), rule_cube.ceilings("maximum_age", col("age"), AGE), rule_cube.ceilings("maximum_delay", col("delay_ms"), DELAY),
    ]


NAMES = ("execution", "strategy_bucket", "selected_side", "conviction", "obs_delay_bucket", "lifecycle", "geography", "local_window", "bucket_shape", "entry_floor", "minimum_edge", "maximum_spread", "maximum_age", "maximum_delay")


def _options_sql() -> str:
    """(dim, i, label) of every option, and row by row the options met, as one list of tests for each dimension."""
    def listed(dim, items):
        return [f"SELECT {dim} AS dim, {i} AS i, '{label}' AS label" for i, label in enumerate(items, 1)]

    seen = {2: "strategy_bucket", 3: "selected_side", 5: "obs_delay_bucket", 6: "lifecycle"}
    parts = [f"SELECT {d} AS dim, row_number() OVER (ORDER BY v) AS i, v AS label FROM (SELECT DISTINCT {c} AS v FROM w) z" for d, c in seen.items()]
    parts += ["SELECT 7, 2 + row_number() OVER (ORDER BY v), v FROM (SELECT DISTINCT station AS v FROM w) z"]
    parts += listed(4, ["HIGH", "LOW"]) + listed(7, ["US", "INTERNATIONAL"]) + listed(8, [f"{a}-{b}" for a, b in WINDOWS]) + listed(9, ["INTERVAL", "LOWER_TAIL", "UPPER_TAIL"])
    for d, bounds in ((10, ENTRY), (11, EDGE), (12, SPREAD[::-1]), (13, AGE[::-1]), (14, DELAY[::-1])):
        parts += listed(d, bounds)
    return " UNION ALL ".join(parts)


MET = " OR ".join([
    *[f"(dim = {d} AND label = {c})" for d, c in ((2, "strategy_bucket"), (3, "selected_side"), (5, "obs_delay_bucket"), (6, "lifecycle"), (7, "station"))],
    "(dim = 4 AND label = CASE WHEN high_conviction THEN 'HIGH' ELSE 'LOW' END)", "(dim = 7 AND label = CASE WHEN station LIKE 'K%' THEN 'US' ELSE 'INTERNATIONAL' END)",
    "(dim = 8 AND hhmm >= label[1:5] AND hhmm < label[7:11])", "(dim = 9 AND label = CASE selected_bucket[1:2] WHEN '<=' THEN 'LOWER_TAIL' WHEN '>=' THEN 'UPPER_TAIL' ELSE 'INTERVAL' END)",
    *[f"(dim = {d} AND {c} >= bound - 1e-12)" for d, c in ((10, "best_ask"), (11, "edge"))], *[f"(dim = {d} AND {c} <= bound + 1e-12)" for d, c in ((12, "spread"), (13, "age"), (14, "delay_ms"))],
])
KEY = "model_id, market_family, ex, dim, i"


def _wide_sql() -> str:
    execs = " UNION ALL ".join(f"SELECT {k} AS ex, '{e.label}' AS exl, CAST({e.target} AS DOUBLE) AS target, CAST({e.price_cap} AS DOUBLE) AS pcap, CAST({e.fill} AS DOUBLE) AS fill" for k, e in enumerate(EXECUTIONS))
    caps = ", ".join(f"CAST({c} AS DOUBLE)" for c in CONFIG.daily_caps)
    name = {d: n for d, n in enumerate(NAMES, 1)}
    labels = ", ".join(["exl AS execution", *[f"CASE WHEN dim = {d} THEN label ELSE 'ANY' END AS {name[d]}" for d in range(2, 15)]])
    rule = "sha256(concat_ws('|', model_id, market_family, " + ", ".join(f"concat('{n}=', {n})" for n in NAMES) + ", CAST(daily_cap AS VARCHAR)))"
    days = """
    {p}f AS (SELECT *, row_number() OVER (PARTITION BY {key}, station, market_date ORDER BY ready, snapshot_id, liquidity) AS rn FROM {src}),
    {p}g AS (SELECT {key}, market_date, list({{'c': c, 'p': CASE WHEN label = 1 THEN c / best_ask - c ELSE -c END, 'v': best_ask, 's': station}} ORDER BY ready, snapshot_id, liquidity) AS t
             FROM (SELECT *, least(target, liquidity) AS c FROM {p}f WHERE rn = 1) z GROUP BY ALL),
    {p}h AS (SELECT {key}, market_date, daily_cap, list_reduce(t, lambda a, x: CASE WHEN a.u + x.c <= daily_cap + 1e-9 THEN {{'u': a.u + x.c, 't': list_append(a.t, x)}} ELSE a END,
             {{'u': CAST(0 AS DOUBLE), 't': CAST([] AS STRUCT(c DOUBLE, p DOUBLE, v DOUBLE, s VARCHAR)[])}}).t AS t FROM {p}g, (SELECT unnest([{caps}]) AS daily_cap) k),
    {p}d AS (SELECT {key}, daily_cap, market_date, len(t) AS trades, round(list_sum(list_transform(t, lambda x: x.c)), 8) AS cost, round(list_sum(list_transform(t, lambda x: x.p)), 8) AS pnl,
             round(list_sum(list_transform(t, lambda x: x.p)) / list_sum(list_transform(t, lambda x: x.c)), 8) AS rr, len(list_filter(t, lambda x: x.p > 0)) AS wins,
             list_sum(list_transform(t, lambda x: x.v)) AS vs, t FROM {p}h WHERE len(t) > 0)"""
    return f"""
    WITH {SIGNAL_SQL}, w AS MATERIALIZED (SELECT {', '.join(COLUMNS)}, strftime(ts, '%H:%M') AS hhmm FROM v_signal WHERE correct IS NOT NULL),
    dts AS (SELECT market_date, row_number() OVER (ORDER BY market_date) - 1 AS j, count(*) OVER () - {CONFIG.holdout_dates} AS n FROM (SELECT DISTINCT market_date FROM w) z),
    fo AS (SELECT market_date, CASE WHEN j < n THEN least(j * {CONFIG.folds} // n, {CONFIG.folds - 1}) END AS fold FROM dts),
    execs AS ({execs}), opts AS ({_options_sql()}), bounds AS (SELECT *, TRY_CAST(label AS DOUBLE) AS bound FROM opts),
    met AS (SELECT w.*, 0 AS dim, 0 AS i, 'ANY' AS label_ FROM w UNION ALL SELECT w.*, dim, i, bounds.label FROM w, bounds WHERE {MET.replace('label =', 'bounds.label =').replace('label[', 'bounds.label[')}),
    hits AS MATERIALIZED (SELECT met.*, ex, exl, target, pcap, fold FROM met JOIN execs ON best_ask <= pcap + 1e-12 AND best_ask <= pcap AND least(target, liquidity) >= target * fill - 1e-9 JOIN fo USING (market_date)),
    beh AS (SELECT {KEY}, any_value(exl) AS exl, any_value(label_) AS label, any_value(target) AS target, any_value(pcap) AS pcap, count(*) AS matched, bit_xor(hash(snapshot_id, liquidity)) AS a, bit_xor(md5_number_lower(snapshot_id || ':' || liquidity)) AS b
            FROM hits WHERE fold IS NOT NULL GROUP BY {KEY} HAVING count(*) >= {CONFIG.minimum_trades}),
    kept AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model_id, market_family, matched, a, b, target, pcap ORDER BY dim > 0, dim, i, ex) AS rn FROM beh) z WHERE rn = 1),
    src AS (SELECT hits.* FROM hits SEMI JOIN kept USING ({KEY}) WHERE fold IS NOT NULL),
    {days.format(p='d', src='src', caps=caps, key=KEY).strip()},
    top AS (SELECT {KEY}, daily_cap, max(n) AS top FROM (SELECT {KEY}, daily_cap, s, count(*) AS n FROM (SELECT {KEY}, daily_cap, unnest(t).s AS s FROM dd) y GROUP BY ALL) z GROUP BY ALL),
    pf AS (SELECT {KEY}, daily_cap, count(*) FILTER (WHERE p > 0) AS positive FROM (SELECT {KEY}, daily_cap, fold, sum(pnl) AS p FROM dd JOIN fo USING (market_date) GROUP BY ALL) z GROUP BY ALL),
    tot AS (SELECT {KEY}, daily_cap, CAST(sum(trades) AS BIGINT) AS trades, count(*) AS effective_dates, round(sum(cost), 8) AS cost, round(sum(pnl), 8) AS pnl, round(sum(pnl) / sum(cost), 8) AS rr, sum(wins) / sum(trades) AS win_rate, sum(vs) / sum(trades) AS average_vwap,
            CASE WHEN count(*) >= 2 THEN round(avg(rr) - 1.645 * stddev_samp(rr) / sqrt(count(*)), 8) ELSE -1e9 END AS lcb, CASE WHEN sum(greatest(pnl, 0)) > 0 THEN round(max(greatest(pnl, 0)) / sum(greatest(pnl, 0)), 8) ELSE 1.0 END AS conc FROM dd GROUP BY ALL),
    good AS (SELECT tot.*, kept.label, kept.exl, matched, top / trades AS max_station_share, positive AS positive_folds, CASE WHEN dim > 0 THEN 2 ELSE 1 END AS complexity, round(lcb - {CONFIG.complexity_penalty} * CASE WHEN dim > 0 THEN 2 ELSE 1 END, 8) AS penalized_lcb
             FROM tot JOIN pf USING ({KEY}, daily_cap) JOIN top USING ({KEY}, daily_cap) JOIN kept USING ({KEY})
             WHERE effective_dates >= {CONFIG.minimum_dates} AND trades >= {CONFIG.minimum_trades} AND positive = {CONFIG.folds} AND lcb > 0 AND conc <= 0.5),
    named AS (SELECT *, {labels} FROM good), ided AS (SELECT *, {rule} AS rule_id FROM named),
    reps AS MATERIALIZED (SELECT * EXCLUDE (fr) FROM (SELECT *, row_number() OVER (PARTITION BY model_id, market_family, strategy_bucket, selected_side, geography ORDER BY penalized_lcb DESC, rr DESC, complexity, rule_id) AS fr FROM ided) z WHERE fr = 1
                          ORDER BY penalized_lcb DESC, rr DESC, complexity, rule_id LIMIT {CONFIG.representatives}),
    late AS (SELECT hits.* FROM hits SEMI JOIN reps USING ({KEY}) WHERE fold IS NULL),
    {days.format(p='l', src='late', caps=caps, key=KEY).strip()},
    hold AS MATERIALIZED (SELECT ld.*, rule_id FROM ld JOIN reps USING ({KEY}, daily_cap)),
    sums AS (SELECT rule_id, CAST(sum(trades) AS BIGINT) AS holdout_trades, count(*) AS holdout_dates, round(sum(cost), 8) AS holdout_cost, round(sum(pnl), 8) AS holdout_pnl FROM hold GROUP BY rule_id),
    ix AS (SELECT rule_id, cost, pnl, row_number() OVER (PARTITION BY rule_id ORDER BY market_date) - 1 AS slot, count(*) OVER (PARTITION BY rule_id) AS n FROM hold),
    dr AS (SELECT rule_id, rep, ('0x' || substr(md5('{CONFIG.seed}:' || rule_id || ':' || rep || ':' || slot), 1, 12))::BIGINT % n AS slot FROM ix, (SELECT unnest(range({CONFIG.bootstrap_draws})) AS rep) r),
    ra AS (SELECT rule_id, rep, sum(pnl) AS p, sum(pnl) / sum(cost) AS v FROM dr JOIN ix USING (rule_id, slot) GROUP BY ALL),
    bo AS (SELECT rule_id, list(v ORDER BY v) AS s, avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END) AS probability_positive FROM ra GROUP BY rule_id),
    bq AS (SELECT rule_id, round(s[CAST(floor(0.05 * (len(s) - 1)) AS INTEGER) + 1], 8) AS lower_5pct, round(s[CAST(floor(0.5 * (len(s) - 1)) AS INTEGER) + 1], 8) AS median, probability_positive FROM bo)
    SELECT model_id, market_family, {', '.join(NAMES)}, daily_cap, matched, complexity, trades, effective_dates, cost, pnl, rr, win_rate, average_vwap, max_station_share, penalized_lcb, holdout_trades, holdout_dates, holdout_cost, holdout_pnl, lower_5pct, median, probability_positive,
           coalesce(holdout_dates >= {min(CONFIG.minimum_holdout_dates, CONFIG.holdout_dates)} AND holdout_trades >= {CONFIG.minimum_holdout_trades} AND holdout_pnl > 0 AND lower_5pct > 0, false) AS survives_holdout
    FROM reps LEFT JOIN sums USING (rule_id) LEFT JOIN bq USING (rule_id)"""


@query("p08_wide_search", _wide_sql(), "cost pnl rr win_rate average_vwap max_station_share penalized_lcb holdout_cost holdout_pnl lower_5pct median probability_positive", 5)
def p08(spark, sf):
    rows = wide_rows(spark, sf)
    _, out = search.wide_search(rows, dimensions(rows.where("label IS NOT NULL")), EXECUTIONS, CONFIG)
    return out.select("model_id", "market_family", *NAMES, "daily_cap", "matched", "complexity", "trades", "effective_dates", "cost", "pnl", "rr", "win_rate", "average_vwap", "max_station_share", "penalized_lcb",
                      "holdout_trades", "holdout_dates", "holdout_cost", "holdout_pnl", "lower_5pct", "median", "probability_positive", "survives_holdout")
