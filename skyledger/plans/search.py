"""Policy grids and the wide rule search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators import metrics, rule_cube, select
from skyledger.operators.metrics import ratio
from skyledger.plans.discovery import WORST, date_folds
from skyledger.session import materialize


def policy_search(rows: DataFrame, windows: list[tuple[str, int, int]], bands: list[tuple[str, float, float]], scopes: list[str], order: list[Column],
                  minimum: int) -> DataFrame:
    """Summary of every delay x window x entry band x scope policy per (model, strategy), from one scan.

    A row is expanded only into the options it satisfies, each a short literal array; then the first row per scope is kept (limited
    per task before the shuffle) and reduced.
    """
    delays = F.array(F.lit("ANY"), F.col("obs_delay_bucket"))
    win = F.array_compact(F.array(*[F.when((F.col("minute_of_day") >= a) & (F.col("minute_of_day") < b), F.lit(n)) for n, a, b in windows]))
    band = F.array_compact(F.array(*[F.when((F.col("entry") >= a) & (F.col("entry") <= b), F.lit(n)) for n, a, b in bands]))
    grid = rows.withColumn("delay", F.explode(delays)).withColumn("window", F.explode(win)).withColumn("band", F.explode(band)).withColumn(
        "scope", F.explode(F.array(*[F.lit(s) for s in scopes])))
    wide = F.col("scope") != "station_date"
    grid = grid.withColumns({"_b": F.when(wide, F.col("selected_bucket")), "_s": F.when(wide, F.col("selected_side")),
                             "_d": F.when(F.col("scope") == "station_date_bucket_side_obs_delay", F.col("obs_delay_bucket"))})
    policy = ["model_name", "strategy_bucket", "delay", "window", "band", "scope"]
    first = select.first_by_scope(grid, [*policy, "station", "market_date", "market_family", "_b", "_s", "_d"], order)
    return metrics.summarize_slice(first, policy, minimum)


@dataclass(frozen=True)
class WideSearch:
    """Sizes of the wide search: holdout and folds, what a rule must show in discovery and in the holdout."""

    holdout_dates: int = 5
    folds: int = 3
    minimum_dates: int = 8
    minimum_trades: int = 20
    minimum_holdout_dates: int = 4
    minimum_holdout_trades: int = 8
    bootstrap_draws: int = 2000
    representatives: int = 250
    complexity_penalty: float = 0.005
    daily_caps: tuple[float, ...] = (100.0, 200.0, 300.0)
    most_conditions: int | None = None
    seed: str = "holdout"


@dataclass(frozen=True)
class Execution:
    """How a matched row is filled: the target cost under a price cap, and the least share of it that must fill."""

    target: float
    price_cap: float
    fill: float

    @property
    def sweep(self) -> str:
        return f"cap={self.price_cap:.8f}|target={self.target:.8f}"

    @property
    def label(self) -> str:
        return f"{self.target:g}/{self.price_cap:g}/{self.fill:g}"


def execution_dimension(executions: list[Execution], ask: Column, sweeps: Column) -> rule_cube.Dimension:
    """Every rule has one execution; a row meets those whose sweep fills enough below the cap."""
    def fills(e: Execution) -> Column:
        got = F.try_element_at(sweeps, F.lit(e.sweep))
        return (ask <= e.price_cap + 1e-12) & got["vwap"].isNotNull() & (got["cost"] >= e.target * e.fill - 1e-9)

    return rule_cube.tests("execution", [(e.label, fills(e)) for e in executions], open=False)


MODEL = ["model_id", "market_family"]
RULE = [*MODEL, "state", "daily_cap"]
ORDER = ["ready", "snapshot_id", "mapping_id"]


SCOPE = [*MODEL, "station", "market_date"]


def sweep_list(executions: list[Execution]) -> Column:
    """`_by`: what each distinct sweep of the executions fills, in the order of `sweep_keys`."""
    return F.array(*[F.try_element_at("sweeps", F.lit(k)) for k in sweep_keys(executions)]).alias("_by")


def sweep_keys(executions: list[Execution]) -> list[str]:
    return list(dict.fromkeys(e.sweep for e in executions))


def rule_days(rows: DataFrame, dims: list[rule_cube.Dimension], executions: list[Execution], caps: tuple[float, ...], most: int | None, states: DataFrame | None = None) -> DataFrame:
    """(rule, market_date, trades, cost, pnl, rr, wins, vwap_sum, stations) of every rule and date.

    A rule takes the first row it matches at each station on a date, in the order of the rows, whole or not at all, while the
    date's cost stays within the cap. A date holds one row a station at most, so its rows are folded in place, all sums in one pass.
    A date has a trade where its least cost is within the cap, which is asked before the fold.
    """
    rows = rows if "_by" in rows.columns else rows.select("*", sweep_list(executions))
    firsts = rule_cube.first_rows(rows, SCOPE, ORDER, dims, ["label", "_by"], most, states)
    keys, run = sweep_keys(executions), rule_cube.option_index(dims, F.col("state"), "execution")
    place = F.element_at(F.array(*[F.lit(keys.index(e.sweep) + 1) for e in executions]), (run + 1).cast("int"))
    got = firsts.withColumn("_x", F.element_at("_by", place))
    pnl = F.when(F.col("label") == 1, F.col("_x.shares") - F.col("_x.cost")).otherwise(-F.col("_x.cost"))
    trade = F.struct(*ORDER, F.col("_x.cost").alias("cost"), pnl.alias("pnl"), F.col("_x.vwap").alias("vwap"), "station")
    by_date = got.groupBy(*MODEL, "state", "conditions", "market_date").agg(F.sort_array(F.collect_list(trade)).alias("_t"), F.min("_x.cost").alias("_least"))
    every = by_date.withColumn("daily_cap", F.explode(F.array(*[F.lit(c) for c in caps]))).where(F.col("_least") <= F.col("daily_cap") + 1e-9)

    def step(acc: Column, t: Column) -> Column:
        fits = acc["cost"] + t["cost"] <= F.col("daily_cap") + 1e-9
        taken = F.struct(
            (acc["cost"] + t["cost"]).alias("cost"), (acc["trades"] + 1).alias("trades"), (acc["pnl"] + t["pnl"]).alias("pnl"),
            (acc["wins"] + (t["pnl"] > 0).cast("long")).alias("wins"), (acc["vwap"] + t["vwap"]).alias("vwap"), F.concat(acc["stations"], F.array(t["station"])).alias("stations"))
        return F.when(fits, taken).otherwise(acc)

    count = F.lit(0).cast("long")
    none = F.struct(F.lit(0.0).alias("cost"), count.alias("trades"), F.lit(0.0).alias("pnl"), count.alias("wins"), F.lit(0.0).alias("vwap"), F.array().cast("array<string>").alias("stations"))
    folded = every.select(*RULE, "conditions", "market_date", F.aggregate("_t", none, step).alias("_f"))
    return folded.select(
        *RULE, "conditions", "market_date", "_f.trades", F.round("_f.cost", 8).alias("cost"), F.round("_f.pnl", 8).alias("pnl"), F.round(F.col("_f.pnl") / F.col("_f.cost"), 8).alias("rr"),
        "_f.wins", F.col("_f.vwap").alias("vwap_sum"), "_f.stations")


def score_days(days: DataFrame, folds: DataFrame, config: WideSearch) -> DataFrame:
    """One row a rule from its days: totals, folds with a profit, the cluster bound of the daily ratios, and the strict gate."""
    dated = days.join(folds, ["market_date"])
    by_fold = dated.groupBy(*RULE, "fold").agg(F.sum("pnl").alias("_p")).groupBy(*RULE).agg(F.sum((F.col("_p") > 0).cast("int")).alias("positive_folds"))
    stations = days.select(*RULE, F.explode("stations").alias("_s")).groupBy(*RULE, "_s").agg(F.count(F.lit(1)).alias("_n")).groupBy(*RULE).agg(F.max("_n").alias("_top"))
    n, win = F.count(F.lit(1)), F.greatest(F.col("pnl"), F.lit(0.0))
    bound = F.avg("rr") - 1.645 * F.stddev_samp("rr") / F.sqrt(n)
    total = days.groupBy(*RULE, "conditions").agg(
        F.sum("trades").alias("trades"), n.alias("effective_dates"), F.round(F.sum("cost"), 8).alias("cost"), F.round(F.sum("pnl"), 8).alias("pnl"),
        F.round(F.sum("pnl") / F.sum("cost"), 8).alias("rr"), (F.sum("wins") / F.sum("trades")).alias("win_rate"), (F.sum("vwap_sum") / F.sum("trades")).alias("average_vwap"),
        F.when(n >= 2, F.round(bound, 8)).otherwise(F.lit(WORST)).alias("lcb"),
        F.when(F.sum(win) > 0, F.round(F.max(win) / F.sum(win), 8)).otherwise(F.lit(1.0)).alias("profit_concentration"))
    scored = total.join(by_fold, RULE).join(stations, RULE)
    complexity = F.col("conditions") + 1
    passes = ((F.col("effective_dates") >= config.minimum_dates) & (F.col("trades") >= config.minimum_trades) & (F.col("positive_folds") == config.folds)
              & (F.col("lcb") > 0) & (F.col("profit_concentration") <= 0.5))
    return scored.withColumns({
        "complexity": complexity, "max_station_share": F.col("_top") / F.col("trades"), "penalized_lcb": F.round(F.col("lcb") - config.complexity_penalty * complexity, 8),
        "passes": passes}).drop("_top", "conditions")


def rule_identity(scored: DataFrame, dims: list[rule_cube.Dimension]) -> DataFrame:
    """Adds a column for each dimension, the rule's id, and the family of rules that move together."""
    named = rule_cube.labelled(scored, dims)
    rule = F.concat_ws("|", *MODEL, *[F.concat(F.lit(f"{d.name}="), F.col(d.name)) for d in dims], F.col("daily_cap").cast("string"))
    held = [d.name for d in dims if d.name in ("selected_side", "strategy_bucket", "geography")]
    return named.withColumns({"rule_id": F.sha2(rule, 256), "family_id": F.sha2(F.concat_ws("|", *MODEL, *held), 256)})


def bootstrap_rules(days: DataFrame, rules: DataFrame, draws: int, seed: str) -> DataFrame:
    """(rule_id, lower_5pct, median, probability_positive): dates of each rule drawn with replacement, draw by draw.

    Draws are a hash of the seed, the rule, the draw and the slot; a date drawn twice counts twice. A rule's ratios are as many
    as the draws.
    """
    own = days.join(rules.select(*RULE, "rule_id"), RULE).select("rule_id", "market_date", "cost", "pnl")
    w = Window.partitionBy("rule_id")
    placed = own.withColumns({"_i": F.row_number().over(w.orderBy("market_date")) - 1, "_n": F.count(F.lit(1)).over(w)})
    slots = placed.select("rule_id", F.col("_i").alias("_slot"), "_n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_draw"))
    picked = slots.withColumn("_i", metrics.draw_index(seed, F.concat_ws(":", "rule_id", "_draw"), F.col("_slot"), F.col("_n")).cast("int"))
    sums = picked.join(placed.select("rule_id", "_i", "cost", "pnl"), ["rule_id", "_i"]).groupBy("rule_id", "_draw").agg(F.sum("pnl").alias("_p"), F.sum("cost").alias("_c"))
    ratios = sums.groupBy("rule_id").agg(F.sort_array(F.collect_list(F.coalesce(ratio(F.col("_p"), F.col("_c")), F.lit(0.0)))).alias("_s"), F.avg((F.col("_p") > 0).cast("double")).alias("probability_positive"))

    def at(q: float) -> Column:
        return F.round(F.element_at("_s", F.floor(F.lit(q) * (F.size("_s") - 1)).cast("int") + 1), 8)

    return ratios.select("rule_id", at(0.05).alias("lower_5pct"), at(0.5).alias("median"), "probability_positive")


def wide_search(rows: DataFrame, dims: list[rule_cube.Dimension], executions: list[Execution], config: WideSearch) -> tuple[DataFrame, DataFrame]:
    """(rules that pass in discovery, representatives of their families with the untouched last dates).

    `rows`: model_id, market_family, station, market_date, ready, snapshot_id, mapping_id, label, sweeps (map of cost, shares, vwap) and
    the columns that the dimensions read. Rows without a label take no part. Rules that match the same discovery rows for the same
    target and cap are one behaviour: the least complex stands for them, whatever the outcomes. Everything up to the choice of the
    representatives reads discovery dates alone.
    """
    resolved = rows.where(F.col("label").isNotNull())
    folds = date_folds(resolved, "market_date", config.folds, config.holdout_dates)
    dated = resolved.join(folds, ["market_date"])
    known = materialize(dated) if config.most_conditions is None else rule_cube.ranked(dated, SCOPE, ORDER, dims, ["label", "fold", sweep_list(executions)])
    inside, outside = known.where("fold IS NOT NULL").drop("fold"), known.where("fold IS NULL").drop("fold")
    found = rule_cube.supports(inside, MODEL, "mapping_id", dims, config.most_conditions)
    sweep = F.element_at(F.create_map(*[F.lit(x) for e in executions for x in (e.label, e.sweep)]), rule_cube.option(dims, F.col("state"), "execution"))
    kept = found.where(F.col("matched") >= config.minimum_trades).withColumn("_sweep", sweep)
    behaviours = materialize(select.first_by_scope(kept, [*MODEL, "matched", "_a", "_b", "_sweep"], [F.col("conditions"), F.col("state")]).select(*MODEL, "state", "matched"))
    days = rule_days(inside, dims, executions, config.daily_caps, config.most_conditions, behaviours)
    scored = score_days(materialize(days), folds, config).where("passes")
    passing = materialize(rule_identity(scored.join(behaviours, [*MODEL, "state"]), dims))
    rank = [F.col("penalized_lcb").desc(), F.coalesce(F.col("rr"), F.lit(WORST)).desc(), F.col("complexity"), F.col("rule_id")]
    chosen = materialize(select.first_by_scope(passing, ["family_id"], rank).orderBy(*rank).limit(config.representatives))
    held = rule_days(outside, dims, executions, config.daily_caps, config.most_conditions, chosen)
    later = materialize(held.join(chosen.select(*RULE), RULE, "left_semi"))
    sums = later.groupBy(*RULE).agg(F.sum("trades").alias("holdout_trades"), F.count(F.lit(1)).alias("holdout_dates"), F.round(F.sum("cost"), 8).alias("holdout_cost"), F.round(F.sum("pnl"), 8).alias("holdout_pnl"))
    drawn = bootstrap_rules(later, chosen, config.bootstrap_draws, config.seed)
    out = chosen.join(sums, RULE, "left").join(drawn, ["rule_id"], "left")
    survives = ((F.col("holdout_dates") >= min(config.minimum_holdout_dates, config.holdout_dates)) & (F.col("holdout_trades") >= config.minimum_holdout_trades)
                & (F.col("holdout_pnl") > 0) & (F.col("lower_5pct") > 0))
    return passing, out.withColumn("survives_holdout", F.coalesce(survives, F.lit(False)))
