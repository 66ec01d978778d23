"""Source-artifact vintages: immutable rows identified by source, key and content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators import select


def identify(df: DataFrame) -> DataFrame:
    """Content id and causal time: the provider's ingestion time where the rule trusts it, else the first observation."""
    causal = F.when(F.col("time_rule") == "PROVIDER_INGESTION", F.col("provider_available_at")).otherwise(F.col("first_observed_at"))
    return df.withColumns({
        "artifact_id": F.sha2(F.concat_ws("|", "source_id", "source_key", "content_sha256"), 256), "causal_available_at": causal})


def ingest_artifacts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to append: the same content is a no-op, changed content is a new vintage; of repeats in a batch the first seen stays."""
    rows = select.first_by_scope(identify(new), ["artifact_id"], [F.col("first_observed_at"), F.col("content_sha256")])
    return rows.join(existing.select("artifact_id"), ["artifact_id"], "left_anti")


def artifact_coverage(artifacts: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """Count, bytes, causal range, station-dates and revised keys per source, with attempts by status beside them."""
    main = artifacts.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("artifacts"), F.sum("byte_count").alias("bytes"), F.min("causal_available_at").alias("first_causal"),
        F.max("causal_available_at").alias("last_causal"), F.countDistinct("station", "market_date").alias("station_dates"))
    # a key is revised when its smallest and largest content hash differ: no distinct set is built
    keys = artifacts.groupBy("source_id", "source_key").agg((F.min("content_sha256") != F.max("content_sha256")).alias("_r"))
    revised = keys.groupBy("source_id").agg(F.sum(F.col("_r").cast("int")).alias("revised_keys"))
    out = main.join(revised, ["source_id"])
    if attempts is None:
        return out
    tries = attempts.groupBy("source_id", "status").agg(F.count(F.lit(1)).alias("n")).groupBy("source_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("attempts"))
    return out.join(tries, ["source_id"], "left")


def visible_at(artifacts: DataFrame, as_of) -> DataFrame:
    """Vintages usable at an instant, the instant itself included."""
    return artifacts.where(F.col("causal_available_at") <= as_of)
