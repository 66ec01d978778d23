"""Policy-neutral view of every snapshot: causal book, sweep, markouts, both settlement labels and all reasons against it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.buckets import bucket_won, parse_bucket
from skyledger.functions.times import source_reasons
from skyledger.operators.books import BOOK_LEVEL, sweep_asks
from skyledger.operators.tape_joins import MARKOUT_SECONDS

DISCOVERY_CAP = 0.50  # fixed value: the sweep's price cap


def broad_view(snapshots: DataFrame, provider: Callable[[DataFrame], DataFrame], pre_signal_seconds: int = 60, target: float = 25.0,
               cap: float = DISCOVERY_CAP, horizons: dict[str, int] | None = None) -> DataFrame:
    """One row per snapshot; nothing is dropped, a row that may not be used says why.

    Snapshots carry snapshot_id, token_id (null where not catalogued), snapshot_at, quote_ready, decision_at, observed_at,
    resolved_at, fair, selected_side, selected_bucket, outcome and venue_side. `provider(requests)` answers requests
    (decision_id, token_id, quote_ready, pre_seconds) with bids, asks and a reason; one pass answers the entry and all horizons.
    A markout list ends at the first horizon without a two-sided book.
    """
    horizons = horizons or MARKOUT_SECONDS
    asked = [("", 0, pre_signal_seconds), *[(n, s, s) for n, s in sorted(horizons.items(), key=lambda h: h[1])]]
    grid = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(s).alias("after"), F.lit(p).cast("long").alias("pre")) for n, s, p in asked])
    requests = snapshots.where("token_id is not null and quote_ready is not null").select("snapshot_id", "token_id", "quote_ready", F.explode(grid).alias("g")).select(
        F.concat_ws("@", F.col("snapshot_id").cast("string"), "g.label").alias("decision_id"), "snapshot_id", "token_id", F.col("g.label").alias("label"), F.col("g.after").alias("after"),
        F.col("g.pre").alias("pre_seconds"), F.timestamp_micros(F.unix_micros("quote_ready") + F.col("g.after").cast("long") * 1_000_000).alias("quote_ready"))
    book = provider(requests).select("snapshot_id", "label", "after", "bids", "asks", "reason")
    bid, ask = (f(F.transform(c, lambda x: x["price"])) for f, c in ((F.array_max, "bids"), (F.array_min, "asks")))
    entry = F.col("label") == ""
    mid = F.when(F.col("reason").isNull(), F.round((bid + ask) / 2, 12))
    found = book.groupBy("snapshot_id").agg(
        F.first(F.when(entry, F.struct("bids", "asks", "reason")), True).alias("b"),
        F.array_sort(F.collect_list(F.when(~entry, F.struct("after", "label", mid.alias("mid"))))).alias("marks"))  # one per horizon
    unbroken = F.filter("marks", lambda m, i: ~F.exists(F.slice("marks", 1, i + 1), lambda x: x["mid"].isNull()))
    found = found.select("snapshot_id", "b.*", F.transform(unbroken, lambda m: F.struct(m["label"].alias("label"), m["mid"].alias("mid"))).alias("markout_midpoints"))
    rows = snapshots.join(found, ["snapshot_id"], "left")

    none = F.array().cast(BOOK_LEVEL)
    rows = rows.withColumns({"bids": F.coalesce("bids", none), "asks": F.coalesce("asks", none), "tape_reason": F.when(F.col("quote_ready").isNull(), "invalid_snapshot_timestamp").otherwise(F.col("reason"))})
    rows = rows.withColumns({"best_bid": F.array_max(F.transform("bids", lambda x: x["price"])), "best_ask": F.array_min(F.transform("asks", lambda x: x["price"]))})
    swept = sweep_asks(F.col("asks"), F.lit(cap), F.lit(target))
    won = bucket_won(F.col("outcome"), parse_bucket(F.col("selected_bucket")))
    venue = F.regexp_replace(F.upper("venue_side"), "^BUY_", "")
    rows = rows.withColumns({
        "taker": swept, "research_label": F.when(F.col("selected_side") == "BUY_YES", won).otherwise(~won).cast("int"),
        "venue_label": F.when(venue.isin("YES", "NO"), (F.col("selected_side") == F.concat(F.lit("BUY_"), venue)).cast("int"))})
    rows = rows.withColumn("settlement_disagreement", F.col("research_label") != F.col("venue_label"))
    against = F.array_compact(F.array(
        F.when(F.col("token_id").isNull(), "TOKEN_NOT_CATALOGED"), F.when(F.col("tape_reason").isNotNull(), F.concat(F.lit("TAPE:"), "tape_reason")),
        F.when(F.col("best_bid") > F.col("best_ask"), "TAPE:CROSSED_BOOK"), F.when(F.col("taker.cost") <= 0, "TAPE:NO_ASKS_AT_OR_BELOW_DISCOVERY_CAP"),
        F.when(F.col("research_label").isNull() & F.col("venue_label").isNull(), "MISSING_SETTLEMENT_LABEL"), F.when(F.col("settlement_disagreement"), "SETTLEMENT_DISAGREEMENT")))
    source = source_reasons(F.col("snapshot_at"), F.col("decision_at"), F.col("observed_at"), F.col("resolved_at"), F.col("fair"), F.col("selected_side"))
    usable = F.col("token_id").isNotNull() & F.col("tape_reason").isNull()
    return rows.withColumns({
        "tape_eligible": usable & F.col("best_ask").isNotNull(), "spread": F.col("best_ask") - F.col("best_bid"),
        "depth_at_best_ask": F.get(F.filter("asks", lambda x: x["price"] == F.col("best_ask")), F.lit(0))["size"],
        "fill_fraction": F.least(F.col("taker.cost") / target, F.lit(1.0)), "markouts_valid": F.coalesce(F.size("markout_midpoints") == len(horizons), F.lit(False)),
        "reasons": F.array_sort(F.array_distinct(F.concat(source, against)))}).withColumn("eligible", F.size("reasons") == 0).drop("reason")
