"""Policy specs: filters, sources, consensus and the positions they select."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.buckets import bucket_type, bucket_won, in_range, parse_bucket
from skyledger.operators import select

PROGRESS = "PROGRESS"


@dataclass(frozen=True)
class PolicySpec:
    """What a policy keeps; an unset bound keeps everything, a set one drops missing values."""

    name: str
    source: str  # model, consensus or progress
    model: str | None = None
    strategy: str | None = None
    delay: str | None = None
    side: str | None = None
    allow: tuple[str, ...] | None = None
    exclude: tuple[str, ...] | None = None
    entry: tuple[float | None, float | None] = (None, None)
    fair: tuple[float | None, float | None] = (None, None)
    edge: tuple[float | None, float | None] = (None, None)
    bucket_type: str | None = None
    local_window: tuple[str | None, str | None] = (None, None)
    scope: str = "station_date"
    by_strategy: bool = False


def _minutes(text: str) -> int:
    hours, minutes = text.split(":")
    return int(hours) * 60 + int(minutes)


def policy_predicate(spec: PolicySpec, local_time: str = "ts") -> Column:
    """One conjunction of column predicates, so parquet filters are pushed down."""
    keep = F.lit(True)
    if spec.allow is not None:
        keep = keep & F.col("station").isin(*spec.allow)
    if spec.exclude is not None:
        keep = keep & ~F.col("station").isin(*spec.exclude)
    for column, value in (("selected_side", spec.side), ("strategy_bucket", spec.strategy), ("obs_delay_bucket", spec.delay)):
        if value is not None:
            keep = keep & (F.col(column) == value)
    keep = keep & in_range(F.col("entry"), *spec.entry) & in_range(F.col("fair"), *spec.fair) & in_range(F.col("edge"), *spec.edge)
    if spec.bucket_type is not None:
        keep = keep & (bucket_type(F.col("selected_bucket")) == spec.bucket_type)
    start, end = spec.local_window
    minute = F.hour(local_time) * 60 + F.minute(local_time)
    if start is not None:
        keep = keep & (minute >= _minutes(start))
    if end is not None:
        keep = keep & (minute < _minutes(end))
    return keep


def policy_filter(df: DataFrame, spec: PolicySpec, local_time: str = "ts") -> DataFrame:
    return df.where(policy_predicate(spec, local_time))


def source_predicate(spec: PolicySpec) -> Column:
    """Progress rows belong to progress policies only; model policies read one model."""
    if spec.source == "progress":
        return F.col("strategy_bucket") == PROGRESS
    keep = F.col("strategy_bucket") != PROGRESS
    return keep & (F.col("model_name") == spec.model) if spec.model is not None else keep


def policy_candidates(df: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Candidate rows tagged with their source name: a model, a consensus group or the progress strategy."""
    tags = []
    for name, kind in sources.items():
        spec = PolicySpec(name=name, source=kind, model=None if kind == "progress" else name)
        tags.append(F.when(source_predicate(spec), F.lit(name)))
    return df.withColumn("source", F.explode(F.array_compact(F.array(*tags))))


def consensus(snapshots: DataFrame, groups: dict[str, list[str]], order: list[str]) -> DataFrame:
    """Rows on which every model of a group agrees.

    Per key and model the last row by `order` counts; the base row is the smallest id, price fields come from the newest
    row, edge and fair are means. Both steps are struct min/max aggregates, so they combine map-side.
    """
    membership = [F.when(F.col("model_name").isin(*models), F.lit(g)) for g, models in groups.items()]
    need = F.create_map(*[x for g, m in groups.items() for x in (F.lit(g), F.lit(len(m)))])
    rows = snapshots.where(F.col("strategy_bucket") != PROGRESS).withColumn(
        "model_group", F.explode(F.array_compact(F.array(*membership))))
    key = ["model_group", "market_family", "station", "market_date", "obs_delay_bucket", "strategy_bucket",
           "selected_side", "selected_bucket"]
    rank = F.struct(*[F.col(c) for c in order])
    last = rows.groupBy(*key, "model_name").agg(F.max_by(
        F.struct("id", "ts", "entry", "fair", "edge", "liquidity", "book_age", "correct", "pnl"), rank).alias("r"))
    newest = F.struct("r.ts", "r.id")
    joined = last.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.min("r.id").alias("id"), F.max("r.ts").alias("ts"),
        F.max_by("r.liquidity", newest).alias("liquidity"), F.max_by("r.book_age", newest).alias("book_age"),
        F.min_by(F.struct("r.entry", "r.correct", "r.pnl"), "r.id").alias("_b"), F.avg("r.edge").alias("edge"),
        F.avg("r.fair").alias("fair"), F.sort_array(F.collect_list("r.id")).alias("source_ids"))
    full = joined.where(F.col("_n") == need[F.col("model_group")])
    return full.select(*key, "id", "ts", "edge", "fair", "liquidity", "book_age", F.col("_b.entry").alias("entry"),
                       F.col("_b.correct").alias("correct"), F.col("_b.pnl").alias("pnl"), "source_ids")


def relaxed_consensus(df: DataFrame, model_a: str, model_b: str, order: list[str]) -> DataFrame:
    """First row of each of two models per (station, date, side), paired; entry from the first model, fair the mean."""
    key = ["station", "market_date", "selected_side"]
    rank = F.struct(*[F.col(c) for c in order])

    def first(model: str, alias: str) -> DataFrame:
        return df.where(F.col("model_name") == model).groupBy(*key).agg(
            F.min_by(F.struct("id", "entry", "fair", "selected_bucket", "correct"), rank).alias(alias))
    return first(model_a, "a").join(first(model_b, "b"), key).select(
        *key, F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("a.entry").alias("entry"),
        ((F.col("a.fair") + F.col("b.fair")) / 2).alias("fair"), F.col("a.selected_bucket").alias("selected_bucket"),
        F.col("a.correct").alias("correct"))


def disagreement(candidates: DataFrame, observed: DataFrame, minimum: float, edge_max: float | None = None,
                 null_fair_passes: bool = True) -> DataFrame:
    """Candidates whose fair beats the observation consensus by a margin, or their own entry when nothing matches.

    Of several observation rows on a key the last one by (ts, id) counts.
    """
    key = ["market_family", "station", "market_date", "obs_delay_bucket", "strategy_bucket", "selected_side", "selected_bucket"]
    lookup = observed.groupBy(*key).agg(F.max_by(F.struct("fair", "edge"), F.struct("ts", "id")).alias("_o")).select(
        *[F.col(k).alias(f"_k_{k}") for k in key], "_o")
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]
    rows = candidates.where("entry is not null and fair is not null").join(lookup, on, "left")
    matched = F.col("_o").isNotNull()
    too_strong = F.lit(False) if edge_max is None else F.coalesce(F.col("_o.edge") >= edge_max, F.lit(False))
    against = F.coalesce(F.col("fair") - F.col("_o.fair") >= minimum, F.lit(null_fair_passes))
    keep = F.when(matched, ~too_strong & against).otherwise(F.col("fair") - F.col("entry") >= minimum)
    return rows.where(keep).drop("_o", *[f"_k_{k}" for k in key])


def score_snapshots(df: DataFrame, temp: str) -> DataFrame:
    """Side against outcome: correct, and PnL of one share; an unparsed bucket or missing outcome stays unscored."""
    won = bucket_won(F.col(temp), parse_bucket(F.col("selected_bucket")))
    correct = F.when(F.col("selected_side") == "BUY_YES", won).when(F.col("selected_side") == "BUY_NO", ~won).cast("int")
    return df.withColumn("correct", correct).withColumn(
        "pnl", F.when(F.col("correct") == 1, 1 - F.col("entry")).when(F.col("correct") == 0, -F.col("entry")))


def score_with_progress(df: DataFrame, final: str, progress: str, zone: str, as_of: Column, cutoff_hour: int = 19) -> DataFrame:
    """Score by the final value, or by the progress value once the local cutoff of the market date has passed."""
    local = F.from_utc_timestamp(as_of, F.col(zone))
    ready = (F.to_date(local) > F.col("market_date")) | (
        (F.to_date(local) == F.col("market_date")) & (F.hour(local) >= cutoff_hour))
    temp = F.coalesce(F.col(final), F.when(ready, F.col(progress)))
    source = F.when(F.col(final).isNotNull(), "official").when(temp.isNotNull(), "preliminary")
    return score_snapshots(df.withColumns({"_temp": temp, "outcome_source": source}), "_temp").drop("_temp")


def policy_positions(df: DataFrame, specs: list[PolicySpec], order: list[str], consensus_rows: DataFrame | None = None) -> DataFrame:
    """Positions of every spec: candidates, filters, first row per scope.

    All specs run over one scan: a row is copied to the specs it passes, then the first row of each scope is kept.
    """
    def tagged(rows: DataFrame, chosen: list[PolicySpec], source) -> DataFrame | None:
        if not chosen:
            return None
        tags = [F.when(source(s) & policy_predicate(s), F.struct(
            F.lit(s.name).alias("policy"), F.lit(s.scope).alias("scope"), F.lit(s.by_strategy).alias("by_strategy"))) for s in chosen]
        return rows.withColumn("_p", F.explode(F.array_compact(F.array(*tags)))).select("*", "_p.*").drop("_p")
    parts = [tagged(df, [s for s in specs if s.source != "consensus"], source_predicate)]
    if consensus_rows is not None:
        parts.append(tagged(consensus_rows, [s for s in specs if s.source == "consensus"],
                            lambda s: F.col("model_group") == s.model if s.model else F.lit(True)))
    columns = ["policy", "scope", "by_strategy", "id", "ts", "station", "market_date", "market_family", "selected_side",
               "selected_bucket", "obs_delay_bucket", "strategy_bucket", "entry", "fair", "edge", "liquidity", "correct", "pnl"]
    rows = None
    for part in parts:
        if part is not None:
            part = part.select(*columns)
            rows = part if rows is None else rows.unionByName(part)
    wide = F.col("scope") != "station_date"
    rows = rows.withColumns({
        "_bucket": F.when(wide, F.col("selected_bucket")), "_side": F.when(wide, F.col("selected_side")),
        "_delay": F.when(F.col("scope") == "station_date_bucket_side_obs_delay", F.col("obs_delay_bucket")),
        "_strategy": F.when(F.col("by_strategy"), F.col("strategy_bucket"))})
    scope = ["policy", "station", "market_date", "market_family", "_bucket", "_side", "_delay", "_strategy"]
    first = select.first_by_scope(rows, scope, [F.col(c) for c in order])
    return first.drop("_bucket", "_side", "_delay", "_strategy", "scope", "by_strategy")
