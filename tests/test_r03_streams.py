"""Findings of the third round on streams: the test fails on the code before."""

import datetime as dt

from skyledger.queries import source_queries
from skyledger.session import new_table
from skyledger.streaming.books import stream_books


def test_deliveries_of_many_files_keep_a_token_that_is_not_idle(spark):
    book = '{"bids": [{"price": "0.4", "size": "2"}], "asks": [{"price": "0.5", "size": "3"}]}'

    def events(token, first, day):
        rows = [(token, first + i, dt.datetime(2024, 1, 1) + dt.timedelta(days=day, minutes=i), "book", "VALID", book) for i in range(8)]
        return spark.createDataFrame(rows, "token_id string, receipt_sequence long, received_at timestamp, event_type string, coverage_state string, raw_payload string").repartition(4)

    # token b's events, 300 days later, bring the watermark past zero while token a has none in their delivery
    parts, files, path = [events("a", 1, 0), events("b", 100, 300), events("a", 1, 0)], [], new_table(spark)

    def stream(arriving):
        return stream_books(arriving, 100, "400 days").writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows")

    source_queries.take_in(spark, parts, lambda arriving: files.append(arriving) or stream(arriving))
    got = {(r.token_id, r.kind): r["count"] for r in spark.read.parquet(f"{path}/rows").groupBy("token_id", "kind").count().collect()}
    assert len(files) == 3 and got == {("a", "coverage"): 1, ("a", "checkpoint"): 8, ("a", "late"): 8, ("b", "coverage"): 1, ("b", "checkpoint"): 8}


def test_coverage_changes_are_made_once(spark, tmp_path, monkeypatch):
    from skyledger.queries import QUERIES

    rows = [(i, i % 3, kind, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 5.0, '{"k": 7}') for i, kind in enumerate(["signup", "error", "view"] * 8)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    stored, delivered = [], []
    keep, take = source_queries.materialize, source_queries.take_in
    monkeypatch.setattr(source_queries, "materialize", lambda df: stored.append(keep(df)) or stored[-1])
    monkeypatch.setattr(source_queries, "take_in", lambda s, parts, stream: delivered.extend(parts) or take(s, parts, stream))
    out = QUERIES["t07_coverage_upsert"](spark, str(tmp_path))
    assert out.agg({"n": "sum"}).first()[0] == stored[0].count() and len(delivered) == 6
    assert all("Window" not in p._jdf.queryExecution().optimizedPlan().toString() for p in delivered)
