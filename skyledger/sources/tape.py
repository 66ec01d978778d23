"""Raw tape segments and feed messages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = ("struct<collector_session_id:string,token_id:string,market_id:string,event_type:string,raw_payload:string,feed_timestamp:string,received_at_utc:string,"
         "received_monotonic_ns:bigint,receipt_sequence:bigint,subscription_generation:int,coverage_state:string,gap_id:string,stable_event_id:string,append_offset:bigint>")


def read_tape(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events of JSON-lines segments and a quarantine of lines that fail a check, each with its reason.

    Every line is `{"event": ..., "sha256": ...}`; the checksum covers the event text as it stands in the line, so it is cut out
    and never re-serialised. The byte offset of a line is the length of those before it in its file; an event that states another
    one is refused, as is a last line without its end. Events that state none are not held against it. Lines of a file are put in
    order by the block they were read from and their place in it, so segments (one rotation each) are as long as a task. Compressed
    segments are one block, and their last line is judged by its text alone.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("segment"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    before = Window.partitionBy("segment").orderBy("_block", "_at").rowsBetween(Window.unboundedPreceding, -1)
    lines = rows.withColumn("byte_offset", F.coalesce(F.sum(F.octet_length("value") + 1).over(before), F.lit(0)).cast("long")).where(F.trim("value") != "")
    body = F.regexp_extract("value", r'^\s*\{"event":\s*(\{.*\})\s*,\s*"sha256":\s*"[0-9a-f]*"\s*\}\s*$', 1)
    stated = F.regexp_extract("value", r'"sha256":\s*"([0-9a-f]*)"\s*\}\s*$', 1)
    checked = lines.withColumns({"_body": body, "_sha": stated}).withColumn("_e", F.from_json("_body", EVENT))
    cut = ~F.col("segment").endswith(".gz") & (F.col("byte_offset") + F.octet_length("value") >= F.col("_size"))
    reason = (
        F.when((F.col("_body") == "") | cut, "truncated_or_malformed_line").when(F.sha2("_body", 256) != F.col("_sha"), "checksum_mismatch")
        .when(F.col("_e.token_id").isNull() | F.col("_e.receipt_sequence").isNull(), "missing_event_fields")
        .when(F.col("_e.append_offset") != F.col("byte_offset"), "stored_offset_mismatch"))
    judged = checked.withColumn("reason", reason)
    good = judged.where("reason is null").select("segment", "_e.*").withColumn("received_at", F.col("received_at_utc").try_cast("timestamp"))
    return good, judged.where("reason is not null").select("segment", "byte_offset", "value", "reason")


def write_segments(events: DataFrame, path: str, rotation_seconds: int = 300) -> None:
    """Events as envelope lines that state their byte offset, one file for each session and rotation bucket, in receipt order.

    `events` has the columns of an event but the offset, and received_at. A bucket is written by one task, which carries the length
    of what it wrote.
    """
    head = F.to_json(F.struct(*[F.col(c) for c in events.columns if c not in ("received_at", "append_offset")]))
    rows = partition_columns(events, rotation_seconds).select("collector_session_id", "part", "receipt_sequence", head.alias("head"))
    dealt = rows.repartition("collector_session_id", "part").sortWithinPartitions("collector_session_id", "part", "receipt_sequence")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, offset = None, 0
        for batch in batches:
            out = []
            for session, part, text in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if (session, part) != bucket:
                    bucket, offset = (session, part), 0
                body = f'{text[:-1]},"append_offset":{offset}}}'
                out.append('{"event": %s, "sha256": "%s"}' % (body, hashlib.sha256(body.encode()).hexdigest()))
                offset += len(out[-1].encode()) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["collector_session_id", "part", "value"])

    written = dealt.mapInArrow(lines, "collector_session_id string, part long, value string")
    written.write.mode("append").partitionBy("collector_session_id", "part").text(path)


def encode_tape(events: DataFrame) -> DataFrame:
    """Events as envelope lines with the checksum of their text."""
    body = F.to_json(F.struct(*[F.col(c) for c in events.columns if c not in ("part", "session_part")]))
    return events.withColumn("_b", body).withColumn("value", F.concat(F.lit('{"event": '), F.col("_b"), F.lit(', "sha256": "'), F.sha2("_b", 256), F.lit('"}'))).drop("_b")


def partition_columns(events: DataFrame, rotation_seconds: int = 300) -> DataFrame:
    """Session and rotation bucket of the receipt time, the layout of the sink."""
    bucket = F.floor(F.unix_seconds("received_at") / rotation_seconds) * rotation_seconds
    return events.withColumn("part", bucket.cast("long"))


def write_tape(events: DataFrame, path: str, rotation_seconds: int = 300, fmt: str = "parquet") -> None:
    """Partition by session and rotation bucket; rows are clustered first so that a bucket is a few files."""
    rows = partition_columns(events, rotation_seconds).repartition("collector_session_id", "part", F.pmod(F.xxhash64("token_id"), F.lit(8)))
    rows = rows.sortWithinPartitions("collector_session_id", "part", "receipt_sequence")
    writer = rows.write.mode("append").partitionBy("collector_session_id", "part")
    (writer.option("compression", "gzip").json(path) if fmt == "json" else writer.parquet(path))


def stream_tape(events: DataFrame, path: str, checkpoint: str, rotation_seconds: int = 300):
    """Streaming sink of the same layout."""
    return partition_columns(events, rotation_seconds).writeStream.format("parquet").partitionBy("collector_session_id", "part").option(
        "checkpointLocation", checkpoint).option("path", path)


MESSAGE = ("struct<event_type:string,type:string,asset_id:string,token_id:string,side:string,price:string,size:string,bids:array<struct<price:string,size:string>>,"
           "asks:array<struct<price:string,size:string>>,price_changes:array<struct<asset_id:string,token_id:string,side:string,price:string,size:string>>>")


def explode_messages(df: DataFrame, message: str = "message") -> DataFrame:
    """Feed messages (an object or a list of objects) to one row per token event.

    A message with `price_changes` becomes one unit per change that keeps its parent's type; any other message is one unit.
    """
    text = F.trim(F.col(message))
    listed = F.when(text.startswith("["), F.from_json(text, f"array<{MESSAGE}>")).otherwise(F.array(F.from_json(text, MESSAGE)))
    rows = df.withColumn("_m", F.explode(listed)).where("_m is not null")
    change = F.struct(F.col("_m.asset_id").alias("asset_id"), F.col("_m.token_id").alias("token_id"), F.col("_m.side").alias("side"), F.col("_m.price").alias("price"), F.col("_m.size").alias("size"))
    units = F.when(F.col("_m.price_changes").isNotNull(), F.col("_m.price_changes")).otherwise(F.array(change))
    rows = rows.withColumn("_u", F.explode(units))
    has_parent = F.col("_m.price_changes").isNotNull()
    payload = F.when(has_parent, F.to_json(F.struct(F.col("_u").alias("price_change")))).otherwise(F.to_json(F.col("_m")))
    return rows.withColumns({
        "token_id": F.coalesce("_u.asset_id", "_u.token_id"), "event_type": F.coalesce("_m.event_type", "_m.type", F.lit("unknown")), "raw_payload": payload}).where(
        "token_id is not null").drop("_m", "_u")
