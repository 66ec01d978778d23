"""Checks around an evaluation: feature coverage, coherence, acceptance, cutoff leaks, dataset diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators import dists
from skyledger.operators.metrics import ratio


def coherence(df: DataFrame, p: str, lowest_cell: Column, keys: list[str]) -> DataFrame:
    """Distributions that keep mass below a cell already ruled out."""
    below = dists.total(F.slice(F.col(p), 1, lowest_cell.cast("int")))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum((below > 1e-12).cast("int")).alias("violations"))


def feature_coverage(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Share of present values per column in two cohorts, one aggregate each, as long rows."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
        return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("share")) for c in columns])).alias("x")).select(
            "x.feature", F.col("x.share").alias(name))
    return shares(a, "first_share").join(shares(b, "second_share"), ["feature"])


def acceptance_checks(metrics: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Named booleans over a one-row metrics table; a missing value fails its check."""
    return metrics.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passes")) for n, c in checks.items()])).alias("x")).select("x.*")


def cutoff_leak(df: DataFrame, keys: list[str], local_time: str, hour: int) -> DataFrame:
    """Groups whose latest row inside the hour bucket lies after the exact cutoff: count, rate and median minute."""
    inside = df.where(F.hour(local_time) <= hour)
    last = inside.groupBy(*keys).agg(F.max(local_time).alias("_t"))
    seconds = F.hour("_t") * 3600 + F.minute("_t") * 60 + F.second("_t")
    leak = seconds > hour * 3600
    return last.agg(
        F.count(F.lit(1)).alias("groups"), F.sum(leak.cast("int")).alias("leaks"), F.avg(leak.cast("double")).alias("leak_rate"),
        F.percentile(F.when(leak, F.minute("_t")), F.lit(0.5)).alias("median_leak_minute"))


def validate_dataset(df: DataFrame, required: list[str], features: list[str], target: str, date: str, value: str, threshold: str,
                     leak_names: tuple[str, ...] = ("final", "outcome", "result")) -> DataFrame:
    """Issues of a training table as (check, detail, n) rows.

    Column statistics are one aggregate; contradictory duplicates are found by a hash of the feature vector, grouped with
    map-side combine. An issue with n = 0 is not listed.
    """
    spark = df.sparkSession
    issues = [("missing_column", c, 1) for c in required if c not in df.columns]
    issues += [("leakage_name", c, 1) for c in features if any(w in c.lower() for w in leak_names)]
    static = spark.createDataFrame(issues, "check string, detail string, n long") if issues else spark.createDataFrame([], "check string, detail string, n long")
    stats = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(F.col(target).isin(0, 1), 0).otherwise(1)).alias("bad_target"),
        F.sum(F.when(F.col(target) != (F.col(value) >= F.col(threshold)).cast("int"), 1).otherwise(0)).alias("inconsistent"),
        *[F.sum(F.col(c).isNull().cast("int")).alias(f"null_{c}") for c in features],
        *[F.min(c).alias(f"min_{c}") for c in features], *[F.max(c).alias(f"max_{c}") for c in features])
    rows = [F.struct(F.lit("non_binary_target").alias("check"), F.lit(target).alias("detail"), F.col("bad_target").alias("n")),
            F.struct(F.lit("inconsistent_target").alias("check"), F.lit(target).alias("detail"), F.col("inconsistent").alias("n"))]
    for c in features:
        rows.append(F.struct(F.lit("null_values").alias("check"), F.lit(c).alias("detail"), F.col(f"null_{c}").alias("n")))
        constant = F.when(F.col(f"min_{c}") == F.col(f"max_{c}"), F.col("rows")).otherwise(0)
        rows.append(F.struct(F.lit("constant_column").alias("check"), F.lit(c).alias("detail"), constant.alias("n")))
    column_issues = stats.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    vectors = df.groupBy(F.sha2(F.to_json(F.struct(*features), {"ignoreNullFields": "false"}), 256).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(target).alias("_lo"), F.max(target).alias("_hi"))
    twins = vectors.where("_lo <> _hi").agg(F.lit("contradictory_duplicates").alias("check"), F.lit("features").alias("detail"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    return static.unionByName(column_issues).unionByName(twins).where("n > 0")


def split_health(df: DataFrame, date: str, target: str, boundary: Column) -> DataFrame:
    """Rows, dates and target rate on both sides of a chronological split."""
    side = F.when(F.col(date) < boundary, "train").otherwise("validation")
    return df.groupBy(side.alias("split")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(date).alias("dates"), F.avg(F.col(target).cast("double")).alias("target_rate"),
        F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def spatial_means(df: DataFrame, keys: list[str], values: dict[str, tuple[str, str]], residual: str, travel: str) -> DataFrame:
    """Weighted means over neighbours, the population deviation of the residual and the shortest travel time."""
    def mean(value: str, weight: str) -> Column:
        ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.col(weight) > 0)
        return ratio(F.sum(F.when(ok, F.col(value) * F.col(weight))), F.sum(F.when(ok, F.col(weight))))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("neighbor_count"), *[mean(v, w).alias(n) for n, (v, w) in values.items()],
        F.stddev_pop(residual).alias("boundary_score"), F.min(travel).alias("min_travel_hours"))


def signal_backtest(df: DataFrame, fair: str, ask: str, bid: str, label: str, threshold: float) -> DataFrame:
    """Buy YES at the ask on enough edge, else buy NO against the bid; the NO rule overrides when both hold."""
    yes = F.col(fair) - F.col(ask) >= threshold
    no = F.col(bid) - F.col(fair) >= threshold
    signal = F.when(no, "BUY_NO").when(yes, "BUY_YES").otherwise("HOLD")
    pnl = F.when(no, F.col(bid) - F.col(label)).when(yes, F.col(label) - F.col(ask)).otherwise(0.0)
    return df.withColumns({"signal": signal, "pnl": pnl})


def backtest_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    traded = F.col("signal") != "HOLD"
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(traded.cast("int")).alias("trades"), F.sum("pnl").alias("total_pnl"),
        F.avg(F.when(traded, F.col("pnl"))).alias("avg_pnl"), F.avg(F.when(traded, (F.col("pnl") > 0).cast("double"))).alias("win_rate"))
