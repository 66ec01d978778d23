"""Exact positions and order statistics inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators import scan


def exact_position(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column]) -> DataFrame:
    """Add `_pos` (1-based, in row order) and `_total` per group; a hot group is numbered slice by slice."""
    numbered = scan.running(df, keys, slice_by, order, {"_pos": ("sum", F.lit(1))})
    return scan.with_totals(numbered, keys, _total=F.count(F.lit(1)))


def rank_sum_auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """ROC AUC with average ranks for ties, from one row per (group, distinct score in [0, 1])."""
    per_score = df.groupBy(*keys, score).agg(
        F.sum(F.col(label).cast("double")).alias("_pos"), F.sum(1.0 - F.col(label)).alias("_neg"))
    seen = scan.running(per_score, keys, F.floor(F.col(score) * 1024), [F.col(score)],
                        {"_below": ("sum", F.col("_neg"))}, inclusive=False)
    wins = F.sum(F.col("_pos") * (F.col("_below") + 0.5 * F.col("_neg")))
    pos, neg = F.sum("_pos"), F.sum("_neg")
    return seen.groupBy(*keys).agg(F.when((pos > 0) & (neg > 0), wins / (pos * neg)).alias("auc"))


def _cumulated(df: DataFrame, keys: list[str], value: str, slice_by: Column) -> DataFrame:
    """One row per distinct value with its count `_n`, the count up to it `_upto` and the group's `_total`."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = scan.running(counts, keys, slice_by, [F.col(value)], {"_upto": ("sum", F.col("_n"))})
    return scan.with_totals(upto, keys, _total=F.sum("_n"))


def _holds(index: Column) -> Column:
    return (F.col("_upto") > index) & (F.col("_upto") - F.col("_n") <= index)


def order_statistic(df: DataFrame, keys: list[str], value: str, slice_by: Column, index: Column, name: str) -> DataFrame:
    """Value at a 0-based index of the sorted group; the index is an expression over `_total`.

    Equal values are merged first, so the sorted list is as long as the distinct values of a slice.
    """
    return _cumulated(df, keys, value, slice_by).where(_holds(index)).groupBy(*keys).agg(F.min(value).alias(name))


def median(df: DataFrame, keys: list[str], value: str, slice_by: Column, name: str) -> DataFrame:
    """Mean of the middle one or two values of a group of any size."""
    middle = (F.col("_total") - 1) / 2
    hit = _holds(F.floor(middle)) | _holds(F.ceil(middle))
    return _cumulated(df, keys, value, slice_by).where(hit).groupBy(*keys).agg(((F.min(value) + F.max(value)) / 2).alias(name))
