"""Order books and coverage as keyed streaming state."""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skyledger.operators.books import _number, parse_events
from skyledger.session import materialize

OUTPUT = ("token_id string, receipt_sequence long, received_at timestamp, kind string, coverage string, bids array<struct<price:double,size:double>>, "
          "asks array<struct<price:double,size:double>>")
STATE = "bids string, asks string, valid boolean, seen_book boolean, coverage string, count long, last_sequence long"


def stream_books(events: DataFrame, every: int = 100, idle: str = "1 hour") -> DataFrame:
    """Book state per token over a stream of tape events, in receipt order.

    Emits a `coverage` row at every change of coverage state, a `checkpoint` row on each full book and after every `every` events
    while the book is valid, and a `late` row for an event whose sequence does not increase (it is never applied). A token idle
    beyond the bound in event time gives up its state. The state of a token is its two price maps, as long as its book is deep.
    """
    parsed = parse_events(events.withWatermark("received_at", idle))
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = parsed.select(
        "token_id", "receipt_sequence", "received_at", "is_full", "is_delta", "bad_reason", "delta_side",
        F.col("delta_price").cast("double").alias("delta_price"), F.col("delta_size").cast("double").alias("delta_size"),
        F.coalesce(F.unix_millis("received_at"), F.lit(0)).alias("at_ms"),
        *[F.transform(f"_p.{c}", lambda x: F.struct(_number(x["price"]).cast("double").alias("price"), _number(x["size"]).cast("double").alias("size"))).alias(f"full_{c}") for c in ("bids", "asks")])

    names = rows.columns
    Event = namedtuple("Event", names)  # made in each worker from these names

    def ladder(levels) -> dict[float, float]:
        return {float(x["price"]): float(x["size"]) for x in (levels if levels is not None else []) if x["price"] is not None and x["size"] is not None and x["size"] > 0}

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            bids_json, asks_json, valid, seen, coverage, count, last = state.get
            bids, asks = ({float(k): v for k, v in json.loads(t).items()} for t in (bids_json, asks_json))
        else:
            bids, asks, valid, seen, coverage, count, last = {}, {}, False, False, None, 0, -1
        out = []
        # a token has few events in a batch, so no frame and no class is made for it
        events = [row for batch in batches for row in zip(*[batch[c].tolist() for c in names], strict=True)]
        for row in map(Event._make, sorted(events, key=lambda e: e[1])):
            def emit(kind, show=False):
                out.append((row.token_id, row.receipt_sequence, row.received_at, kind, coverage,
                            [{"price": p, "size": s} for p, s in sorted(bids.items(), reverse=True)] if show else None,
                            [{"price": p, "size": s} for p, s in sorted(asks.items())] if show else None))
            if row.receipt_sequence <= last:
                emit("late")
                continue
            last, count = row.receipt_sequence, count + 1
            if row.is_full:
                bids, asks, valid, seen = ladder(row.full_bids), ladder(row.full_asks), True, True
            elif row.bad_reason is not None:
                valid = False
            elif row.is_delta and valid:
                side = bids if row.delta_side == "BUY" else asks
                if row.delta_size == 0:
                    side.pop(row.delta_price, None)
                else:
                    side[row.delta_price] = row.delta_size
            now = "VALID" if valid else "GAPPED" if seen else "RESYNCING"
            if now != coverage:
                coverage = now
                emit("coverage")
            if valid and (row.is_full or count % every == 0):
                emit("checkpoint", True)
        state.update((json.dumps(bids), json.dumps(asks), valid, seen, coverage, count, int(last)))
        # the watermark is zero in the first batch and lags by the bound: a token's own last time says when it is idle
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), *(e[names.index("at_ms")] for e in events), 0) + idle_ms + 1)
        yield pd.DataFrame(out, columns=["token_id", "receipt_sequence", "received_at", "kind", "coverage", "bids", "asks"])
    return rows.groupBy("token_id").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def transition_coverage(open_intervals: DataFrame, changes: DataFrame) -> DataFrame:
    """Close open intervals at the first newer change of their token and append the new states, in one pass.

    `open_intervals`: token_id, state, started_at. `changes`: token_id, state, started_at. Repeated deliveries of a change are one row.
    """
    from skyledger.operators import scan

    rows = open_intervals.select("token_id", "state", "started_at").unionByName(changes.select("token_id", "state", "started_at")).distinct()
    return scan.neighbour(rows, ["token_id"], scan.day_slice(F.col("started_at")), [F.col("started_at"), F.col("state")], "ended_at", F.col("started_at"), following=True)


def upsert_coverage(changes: DataFrame, path: str, checkpoint: str):
    """Streaming sink of coverage intervals: each batch of changes (token_id, state, started_at) closes open intervals and opens new ones.

    A batch writes the intervals it closed and the state it leaves (one open interval a token) under its own number, replacing
    what is there, from the state of the batch before. A batch that is delivered again thus writes the same and changes nothing.
    Changes of a token arrive in the order of their times; one that is not newer than the open interval is no change.
    """
    kind = "token_id string, state string, started_at timestamp"

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = [n for n in batch_numbers(spark, f"{path}/open") if n < number]
        opened = spark.read.schema(kind).parquet(f"{path}/open/batch={max(held)}") if held else spark.createDataFrame([], kind)
        last = opened.select("token_id", F.col("started_at").alias("_last"))
        newer = batch.select("token_id", "state", "started_at").join(last, ["token_id"], "left").where("_last IS NULL OR started_at > _last").drop("_last")
        joined = materialize(transition_coverage(opened, newer))
        joined.where("ended_at IS NOT NULL").write.mode("overwrite").parquet(f"{path}/closed/batch={number}")
        joined.where("ended_at IS NULL").select("token_id", "state", "started_at").write.mode("overwrite").parquet(f"{path}/open/batch={number}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def batch_numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that wrote below a folder, listed through Spark's file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(where) if s.getPath().getName().startswith("batch="))


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(token_id, state, started_at, ended_at): all closed intervals and those the last batch left open."""
    kind = "token_id string, state string, started_at timestamp"
    closed = spark.read.schema(f"{kind}, ended_at timestamp").parquet(*[f"{path}/closed/batch={n}" for n in batch_numbers(spark, f"{path}/closed")])
    opened = spark.read.schema(kind).parquet(f"{path}/open/batch={batch_numbers(spark, f'{path}/open')[-1]}").withColumn("ended_at", F.lit(None).cast("timestamp"))
    return closed.unionByName(opened)
