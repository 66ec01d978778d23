"""Rule discovery: grids, matching, scoring with caps and folds, frozen holdouts."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators import folds, rule_cube, select
from skyledger.operators.metrics import ratio
from skyledger.session import materialize


def date_folds(df: DataFrame, date: str, k: int, holdout: int = 0) -> DataFrame:
    """Contiguous chronological folds over the distinct dates; the last `holdout` dates get a null fold.

    The distinct dates are as many as the calendar, so numbering them in one window is bounded.
    """
    dates = df.select(date).where(F.col(date).isNotNull()).distinct()
    order = Window.orderBy(date)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - holdout
    numbered = dates.withColumns({"_i": F.row_number().over(order) - 1, "_n": n})
    fold = F.least(F.floor(F.col("_i") * k / F.col("_n")), F.lit(k - 1))
    return numbered.select(date, F.when(F.col("_i") < F.col("_n"), fold).cast("long").alias("fold"))


def common_dates(df: DataFrame, family: str, candidate: str, date: str) -> DataFrame:
    """Dates on which every candidate of a family has a row, by counting distinct candidates per date."""
    need = df.groupBy(family).agg(F.countDistinct(candidate).alias("_need"))
    have = df.groupBy(family, date).agg(F.countDistinct(candidate).alias("_have"))
    return have.join(need, [family]).where(F.col("_have") == F.col("_need")).select(family, date)


def rule_grid(rows: DataFrame, sides: list[str], delays: list[str | None], windows: list[tuple[str, str]],
              bands: list[tuple[float, float]], edges: list[float], spreads: list[float | None]) -> DataFrame:
    """Every combination of the options per (model_id, market_family) of `rows`, with a content id and its complexity.

    The grid is a product of short option lists known to the caller, so it is generated by explodes from the models.
    """
    from skyledger.functions.money import stable_id

    def options(values, ddl: str) -> Column:
        names = [p.split(" ")[0] for p in ddl.split(", ")]
        types = [p.split(" ")[1] for p in ddl.split(", ")]
        return F.array(*[F.struct(*[F.lit(x).cast(t).alias(n) for n, t, x in zip(names, types, v if isinstance(v, tuple) else (v,))])
                         for v in values])
    df = materialize(rows.select("model_id", "market_family").distinct())
    dims = {
        "side": (sides, "selected_side string"), "delay": (delays, "observation_delay_bucket string"),
        "window": (windows, "local_start string, local_end string"), "band": (bands, "entry_min double, entry_max double"),
        "edge": (edges, "edge_minimum double"), "spread": (spreads, "spread_maximum double")}
    for values, ddl in dims.values():
        df = df.withColumn("_o", F.explode(options(values, ddl))).select("*", "_o.*").drop("_o")
    complexity = (
        F.lit(1) + (F.col("selected_side") != "ANY").cast("int") + F.col("observation_delay_bucket").isNotNull().cast("int")
        + ((F.col("local_start") != "00:00") | (F.col("local_end") != "24:00")).cast("int")
        + (F.col("edge_minimum") > 0).cast("int") + F.col("spread_maximum").isNotNull().cast("int"))
    rule = ["model_id", "market_family", "selected_side", "observation_delay_bucket", "local_start", "local_end",
            "entry_min", "entry_max", "edge_minimum", "spread_maximum"]
    family = ["model_id", "market_family", "selected_side", "entry_min", "entry_max"]
    return df.withColumns({"complexity": complexity, "rule_id": stable_id(*rule), "family_id": stable_id(*family)})


def grid_size(*dims) -> int:
    return len(list(itertools.product(*dims)))


CONDITIONS = {
    "side": ["selected_side"], "delay": ["observation_delay_bucket"], "window": ["local_start", "local_end"],
    "band": ["entry_min", "entry_max"], "edge": ["edge_minimum"], "spread": ["spread_maximum"]}


def rule_dimensions(rules: DataFrame) -> list[rule_cube.Dimension]:
    """The distinct conditions of the rules, dimension by dimension, as a row meets them.

    Distinct conditions come to the driver; they are the option lists that a grid was made of. One more than are allowed is taken,
    so that too many are refused.
    """
    parts = {n: F.struct(*cols, condition_label(n).alias("label")) for n, cols in CONDITIONS.items()}
    seen = rules.agg(*[F.slice(F.sort_array(F.collect_set(c)), 1, rule_cube.MOST_OPTIONS + 1).alias(n) for n, c in parts.items()]).first()

    def test(name: str, o) -> Column:
        if name == "side":
            return F.lit(True) if o.selected_side == "ANY" else F.col("selected_side") == o.selected_side
        if name == "delay":
            return F.lit(True) if o.observation_delay_bucket is None else F.col("observation_delay_bucket") == o.observation_delay_bucket
        if name == "window":
            return (F.col("local_hhmm") >= o.local_start) & (F.col("local_hhmm") < o.local_end)
        if name == "band":
            return (F.col("best_ask") >= o.entry_min) & (F.col("best_ask") <= o.entry_max)
        if name == "edge":
            return F.col("edge_at_best") + 1e-12 >= o.edge_minimum
        return F.lit(True) if o.spread_maximum is None else F.col("spread") <= o.spread_maximum + 1e-12

    return [rule_cube.tests(n, [(o.label, test(n, o)) for o in seen[n]], open=False) for n in CONDITIONS]


def condition_label(dimension: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in CONDITIONS[dimension]])


def rule_states(rules: DataFrame, dims: list[rule_cube.Dimension]) -> DataFrame:
    """`rules` with the state of the cube that each stands for. A rule without any condition that rows can meet has none."""
    state = F.lit(0).cast("long")
    for d, radix in zip(dims, rule_cube.radices(dims), strict=True):
        index = F.create_map(*[F.lit(x) for i, v in enumerate(d.labels) for x in (v, i)])
        state = state + F.element_at(index, condition_label(d.name)).cast("long") * radix
    return rules.withColumn("state", state)


def match_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows joined to the rules they satisfy, by equality alone.

    A row is handed to the conditions it meets, one dimension after the other, which gives the states it meets; a state is a
    rule or, where the rules are no full grid, nothing. So no range is tested on pairs of rows and rules.
    """
    dims = rule_dimensions(rules)
    kept = rule_states(rules, dims).select(*STATE, "rule_id", "family_id", "complexity", F.col("entry_max").alias("rule_cap"))
    met = rule_cube.cells(rows, dims).withColumn("state", F.lit(0).cast("long"))
    for i, radix in enumerate(rule_cube.radices(dims)):
        met = met.withColumn("_o", F.explode(f"_m{i}")).withColumn("state", F.col("state") + F.col("_o").cast("long") * radix).drop("_o", f"_m{i}")
    return met.join(kept, ["model_id", "market_family", "state"]).drop("state")


def rule_counts(rows: DataFrame, rules: DataFrame, row_id: str = "mapping_id") -> DataFrame:
    """`rules` with `matched_rows` and two fingerprints `_a`, `_b` of the rows they match; rules that match none are left out.

    Rows are reduced to cells before anything moves, and cells to states, so the pairs of rows and rules are never formed.
    """
    dims = rule_dimensions(rules)
    found = rule_cube.supports(rows, ["model_id", "market_family"], row_id, dims).withColumnRenamed("matched", "matched_rows").drop("conditions")
    return rule_states(rules, dims).join(found, ["model_id", "market_family", "state"]).drop("state")


ORDER = ["ready", "snapshot_id", "mapping_id"]


MODEL = ["model_id", "market_family"]
STATE = [*MODEL, "state"]


def first_matches(rows: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first matches by state, station and date with the sweep `_x` at the rules' cap; rules with their states).

    Rules are told apart by their state alone up to their scores, which is one number in place of the ids and conditions.
    """
    dims = rule_dimensions(rules)
    named = materialize(rule_states(rules, dims))
    caps = named.select(*STATE, F.format_number("entry_max", 8).alias("_cap")).distinct()
    first = rule_cube.first_rows(rows, [*MODEL, "station", "market_date"], ORDER, dims, ["label", "sweeps"])
    return first.join(caps, STATE).withColumn("_x", F.try_element_at("sweeps", F.col("_cap"))).drop("sweeps", "_cap"), named


def rule_executions(first: DataFrame, target: float, fill: float, daily_cap: float) -> DataFrame:
    """First matches that fill enough, under the whole-row daily cap of their rule.

    A rule has one row a station at most on a date, so a date's rows are folded in place.
    """
    ok = (F.col("_x.cost") >= target * fill) & F.col("_x.vwap").isNotNull()
    row = F.struct(*ORDER, "station", "label", F.col("_x.cost").alias("cost"), F.col("_x.shares").alias("shares"), F.col("_x.vwap").alias("vwap"))
    return with_pnl(folds.greedy_cap_in_place(first.where(ok), [*STATE, "market_date"], row, daily_cap))


def with_pnl(df: DataFrame) -> DataFrame:
    return df.withColumn("pnl", F.when(F.col("label") == 1, F.col("shares") - F.col("cost")).otherwise(-F.col("cost")))


def daily_results(executions: DataFrame) -> DataFrame:
    """Cost, PnL and ratio per rule and date, each rounded to 8 places before anything is built on them, and the date's stations."""
    return executions.groupBy(*STATE, "market_date").agg(
        F.count(F.lit(1)).alias("trades"), F.round(F.sum("cost"), 8).alias("cost"), F.round(F.sum("pnl"), 8).alias("pnl"),
        F.round(F.coalesce(ratio(F.sum("pnl"), F.sum("cost")), F.lit(0.0)), 8).alias("rr"),
        F.sum((F.col("pnl") > 0).cast("int")).alias("wins"), F.sum("vwap").alias("vwap_sum"), F.collect_list("station").alias("stations"))


WORST = -1_000_000_000.0


def cluster_lcb(daily: DataFrame, keys: list[str], rr: str = "rr") -> DataFrame:
    """Mean daily ratio less 1.645 standard errors; fewer than two dates give the worst bound."""
    mean, bound = lcb_columns(rr)
    return daily.groupBy(*keys).agg(mean, F.count(rr).alias("dates"), bound)


def lcb_columns(rr: str = "rr") -> list[Column]:
    n = F.count(rr)
    bound = F.avg(rr) - 1.645 * F.stddev_samp(rr) / F.sqrt(n)
    return [F.round(F.avg(rr), 8).alias("mean_daily_rr"), F.when(n >= 2, F.round(bound, 8)).otherwise(F.lit(WORST)).alias("lcb_daily_rr")]


def score_rules(rows: DataFrame, rules: DataFrame, k: int, holdout: int, target: float = 25.0, fill: float = 0.9,
                daily_cap: float = 100.0, penalty: float = 0.01, min_dates: int = 5, min_trades: int = 10) -> DataFrame:
    """Score every rule on the discovery dates, with folds, stability, the cluster bound and the gate."""
    dates = materialize(date_folds(rows.where("label is not null"), "market_date", k, holdout))
    inside = rows.where("label is not null").join(dates.where("fold is not null"), ["market_date"])
    first, named = first_matches(inside.drop("fold"), rules)
    daily = materialize(daily_results(rule_executions(first, target, fill, daily_cap)))
    per_fold = daily.join(dates, ["market_date"]).groupBy(*STATE, "fold").agg(F.sum("pnl").alias("_p"))
    stable = per_fold.groupBy(*STATE).agg(
        F.count(F.lit(1)).alias("populated_folds"), F.sum((F.col("_p") > 0).cast("int")).alias("positive_folds"))
    stations = daily.select(*STATE, F.explode("stations").alias("_s")).groupBy(*STATE, "_s").agg(F.count(F.lit(1)).alias("_n")).groupBy(*STATE).agg(
        F.max("_n").alias("_top_station"))
    total = daily.groupBy(*STATE).agg(
        F.sum("trades").alias("trades"), F.count(F.lit(1)).alias("effective_dates"), F.round(F.sum("cost"), 8).alias("cost"),
        F.round(F.sum("pnl"), 8).alias("pnl"), ratio(F.sum("pnl"), F.sum("cost")).alias("rr"),
        (F.sum("wins") / F.sum("trades")).alias("win_rate"), (F.sum("vwap_sum") / F.sum("trades")).alias("average_vwap"), *lcb_columns())
    scored = named.select(*STATE, "rule_id", "family_id", "complexity").join(total.join(stable, STATE).join(stations, STATE), STATE).drop(*STATE)
    steady = F.col("positive_folds") / F.col("populated_folds") >= 2 / 3
    return scored.withColumns({
        "stable": steady, "max_station_share": F.col("_top_station") / F.col("trades"),
        "penalized_lcb": F.round(F.col("lcb_daily_rr") - penalty * F.col("complexity"), 8),
        "passes": steady & (F.col("effective_dates") >= min_dates) & (F.col("trades") >= min_trades) & (F.col("pnl") > 0),
    }).drop("_top_station")


def score_compatible(rows: DataFrame, rules: DataFrame, k: int, holdout: int, target: float = 25.0, daily_cap: float = 100.0,
                     penalty: float = 0.01, min_dates: int = 5, min_trades: int = 10) -> DataFrame:
    """The compatibility form: the daily cap counts first matches at their full cost, whether or not they execute; whatever the sweep
    fills is taken; folds run over the dates a rule executed on; rules are compared by penalised return."""
    dates = materialize(date_folds(rows.where("label is not null"), "market_date", k, holdout))
    inside = rows.where("label is not null").join(dates.where("fold is not null").drop("fold"), ["market_date"])
    first, named = first_matches(inside, rules)
    placed = folds.equal_cost_cap(first, [*STATE, "market_date"], [F.col(c) for c in ORDER], target, daily_cap)
    filled = placed.where((F.col("_x.cost") > 0) & F.col("_x.vwap").isNotNull()).select(*STATE, "market_date", "label", F.col("_x.cost").alias("cost"), F.col("_x.shares").alias("shares"))
    daily = materialize(with_pnl(filled).groupBy(*STATE, "market_date").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("cost").alias("cost"), F.sum("pnl").alias("pnl"), F.sum((F.col("label") == 1).cast("int")).alias("wins")))
    # a rule has a row a date here
    w = Window.partitionBy(*STATE)
    place, n = F.row_number().over(w.orderBy("market_date")) - 1, F.count(F.lit(1)).over(w)
    folded = daily.withColumn("fold", F.least(F.floor(place * k / n), F.lit(k - 1)).cast("long"))
    stable = folded.groupBy(*STATE, "fold").agg(F.sum("pnl").alias("_p")).groupBy(*STATE).agg(
        F.count(F.lit(1)).alias("populated_folds"), F.sum((F.round("_p", 6) > 0).cast("int")).alias("positive_folds"))
    total = folded.groupBy(*STATE).agg(
        F.sum("trades").alias("trades"), F.count(F.lit(1)).alias("effective_dates"), F.round(F.sum("cost"), 6).alias("cost"), F.round(F.sum("pnl"), 6).alias("pnl"),
        F.round(F.sum("pnl") / F.sum("cost"), 6).alias("rr"), F.sum("wins").alias("wins"))
    scored = named.select(*STATE, "rule_id", "family_id", "complexity").join(total.join(stable, STATE), STATE).drop(*STATE)
    steady = F.col("positive_folds") / F.col("populated_folds") >= 2 / 3
    return scored.withColumns({
        "stable": steady, "penalized_rr": F.round(F.coalesce("rr", F.lit(0.0)) - penalty * F.col("complexity"), 6),
        "passes": steady & (F.col("effective_dates") >= min_dates) & (F.col("trades") >= min_trades) & (F.col("pnl") > 0)})


def nominations(scored: DataFrame, challengers: int) -> DataFrame:
    """Of each correlated family the first rule by (gate, penalised return, complexity, id); then the few best that pass."""
    rank = [F.col("passes").desc(), F.col("penalized_rr").desc(), F.col("complexity"), F.col("rule_id")]
    return select.first_by_scope(scored, ["family_id"], rank).where("passes").orderBy(*rank).limit(challengers)


def rank_columns() -> list[Column]:
    return [F.col("penalized_lcb").desc(), F.col("pnl").desc(), F.col("complexity"), F.col("rule_id")]


def family_representatives(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """Best passing rule of each correlated family, optionally only the best few families."""
    best = select.first_by_scope(scored.where("passes"), ["family_id"], rank_columns())
    return best if limit is None else best.orderBy(*rank_columns()).limit(limit)


def freeze_hash(reps: DataFrame) -> DataFrame:
    """One hash over the frozen choice: it depends on the set of rules and on nothing that happens later."""
    # hashes of ids under exclusive or: no list of all ids is made
    ids = reps.select("rule_id").distinct()
    return ids.agg(F.sha2(F.concat_ws(",", F.bit_xor(F.xxhash64("rule_id")), F.bit_xor(F.xxhash64(F.lit("b"), "rule_id")), F.count(F.lit(1))), 256).alias("freeze_hash"),
                   F.count(F.lit(1)).alias("rules"))


def evaluate_holdout(rows: DataFrame, rules: DataFrame, reps: DataFrame, k: int, holdout: int, target: float = 25.0,
                     fill: float = 0.9, daily_cap: float = 100.0) -> DataFrame:
    """Only the frozen representatives on the untouched last dates."""
    dates = date_folds(rows.where("label is not null"), "market_date", k, holdout)
    outside = rows.where("label is not null").join(dates.where("fold is null").select("market_date"), ["market_date"])
    chosen = materialize(rules.join(reps.select("rule_id"), ["rule_id"], "left_semi"))
    first, named = first_matches(outside, chosen)
    daily = daily_results(rule_executions(first, target, fill, daily_cap))
    total = daily.groupBy(*STATE).agg(
        F.sum("trades").alias("trades"), F.count(F.lit(1)).alias("effective_dates"), F.round(F.sum("cost"), 8).alias("cost"),
        F.round(F.sum("pnl"), 8).alias("pnl"), ratio(F.sum("pnl"), F.sum("cost")).alias("rr"), lcb_columns()[1])
    return named.select(*STATE, "rule_id").join(total, STATE).drop(*STATE)


def collapse_equivalent(rows: DataFrame, rules: DataFrame, extra: list[str], row_id: str = "mapping_id") -> DataFrame:
    """Rules that select the same rows (and share target and cap) collapse to the least complex one.

    Fingerprints are order-free: the count, and two independent 64-bit hashes of the row ids under exclusive or.
    """
    kept = select.first_by_scope(rule_counts(rows, rules, row_id), ["matched_rows", "_a", "_b", *extra], [F.col("complexity"), F.col("rule_id")])
    return kept.drop("_a", "_b")
