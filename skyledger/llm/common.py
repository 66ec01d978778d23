"""Helpers the document operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOLDS = 5
FINGERPRINT_SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that no model learns from; a row without an id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def text_key(text: str = "text") -> Column:
    """Names the content of a row, so rows that repeat an id with other text stay apart (null and empty differ)."""
    return F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.xxhash64(F.col(text)))


def lower_ascii(col: Column) -> Column:
    """Folds A-Z alone; texts that are ASCII throughout take the faster way."""
    folded = F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(folded)


def first_ranked(df: DataFrame, group: str, hashed: Column, order: list[str], most: int) -> DataFrame:
    """The `most` first rows of every group, by a hash of 64 bits and then `order`.

    Rows are counted by group and the hash's first 12 bits, and only those below the bound that this sets are ranked: `most`
    and a 4096th of the group, wherever its rows lie.
    """
    rows = df.withColumn("_hash", hashed).withColumn("_bits", F.shiftright("_hash", 52))
    counts = rows.groupBy(group, "_bits").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_bits").rowsBetween(Window.unboundedPreceding, -1))
    within = counts.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < most).select(group, "_bits")
    near = rows.join(within, [group, "_bits"], "left_semi")
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy("_hash", *order)))
    return ranked.filter(F.col("_rank") <= most).drop("_rank", "_hash", "_bits")
