import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions import buckets, weather
from skyledger.operators import books, tape_joins
from skyledger.queries.views import tape as tape_view
from skyledger.sources import markets, tables, tape
from skyledger.streaming.books import read_coverage, stream_books, transition_coverage, upsert_coverage
from skyledger.streaming.guards import dedupe, interval_metrics

SF = "/root/testdata/sf0.001"


def run_stream(spark, df_files, schema, build, out, tmp_path):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(df_files)
    q = build(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def test_stream_equals_batch(spark, tmp_path):
    events = tape_view(spark, SF).select("token_id", "receipt_sequence", "received_at", "event_type", "coverage_state", "raw_payload").cache()
    src = str(tmp_path / "in")
    # arrival order is receipt order: one file per time range, written one after the other
    cuts = events.agg(F.percentile("receipt_sequence", F.array(F.lit(0.3), F.lit(0.6)))).first()[0]
    bounds = [-1, int(cuts[0]), int(cuts[1]), 10**12]
    for lo, hi in zip(bounds, bounds[1:]):
        events.where((F.col("receipt_sequence") > lo) & (F.col("receipt_sequence") <= hi)).coalesce(1).write.mode("append").parquet(src)
    got = run_stream(spark, src, events.schema, lambda s: stream_books(s, 5, "40 days"), str(tmp_path / "out"), tmp_path)
    state = books.book_validity(events, reasons=False)
    want = books.checkpoints(state, 5)
    pack = lambda r: (r.token_id, r[1], tuple(map(tuple, r.bids or [])), tuple(map(tuple, r.asks or [])))
    chk = got.where("kind = 'checkpoint'").select("token_id", "receipt_sequence", "bids", "asks")
    assert sorted(map(pack, chk.collect())) == sorted(map(pack, want.select("token_id", "event_offset", "bids", "asks").collect()))
    cov = got.where("kind = 'coverage'").select("token_id", "coverage", "received_at").collect()
    runs = tape_joins.coverage_intervals(state).select("token_id", "state", "started_at").collect()
    assert sorted(map(tuple, cov)) == sorted(map(tuple, runs))
    assert got.where("kind = 'late'").count() == 0


def test_repeated_events_are_late_and_change_nothing(spark, tmp_path):
    events = tape_view(spark, SF).select("token_id", "receipt_sequence", "received_at", "event_type", "coverage_state", "raw_payload").where("token_id = '1'")
    src = str(tmp_path / "in")
    events.coalesce(1).write.mode("append").parquet(src)
    events.coalesce(1).write.mode("append").parquet(src)
    n = events.count()
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_books(source, 5, "40 days").writeStream.format("memory").queryName("late_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count(*) from late_rows where kind = 'late'").first()[0] == n


def test_stream_metrics_and_dedupe(spark, tmp_path):
    events = tape_view(spark, SF).withColumns({"receipt_lag_ms": F.col("k") * 1.0, "stable_event_id": F.col("receipt_sequence").cast("string")})
    src = str(tmp_path / "in")
    events.coalesce(1).write.parquet(src)
    source = spark.readStream.schema(events.schema).parquet(src)
    q = dedupe(source, "1 hour").writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count(*) from deduped").first()[0] == events.count()
    total = interval_metrics(events, "1 hour").agg(F.sum("events")).first()[0]
    assert total == events.count()


def test_transition_coverage_closes_and_appends(spark):
    mk = lambda rows: spark.createDataFrame(rows, "token_id string, state string, s long").withColumn("started_at", F.timestamp_seconds("s")).drop("s")
    out = transition_coverage(mk([("t", "RESYNCING", 0)]), mk([("t", "VALID", 10), ("t", "VALID", 10), ("t", "GAPPED", 20)])).orderBy("started_at").collect()
    assert [(r.state, r.ended_at is None) for r in out] == [("RESYNCING", False), ("VALID", False), ("GAPPED", True)]


def test_tape_segments_round_trip_and_quarantine(spark, tmp_path):
    event = lambda i: json.dumps({"collector_session_id": "s", "token_id": "t", "event_type": "book", "raw_payload": "{}", "received_at_utc": f"2024-01-01T00:00:{i:02d}Z", "receipt_sequence": i, "coverage_state": "VALID"})
    line = lambda body: '{"event": %s, "sha256": "%s"}' % (body, hashlib.sha256(body.encode()).hexdigest())
    good = [line(event(i)) for i in range(3)]
    bad = [good[0][:40], '{"event": %s, "sha256": "%s"}' % (event(9), "0" * 64)]
    with gzip.open(tmp_path / "seg.json.gz", "wt") as f:
        f.write("\n".join(good + bad))
    ok, quarantine = tape.read_tape(spark, str(tmp_path / "seg.json.gz"))
    assert sorted(r.receipt_sequence for r in ok.collect()) == [0, 1, 2]
    assert sorted(r.reason for r in quarantine.collect()) == ["checksum_mismatch", "truncated_or_malformed_line"]
    tape.write_tape(ok.drop("segment"), str(tmp_path / "sink"), 300)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 3
    encoded = tape.encode_tape(ok.drop("segment", "received_at")).select("value")
    encoded.write.text(str(tmp_path / "enc"))
    again, none = tape.read_tape(spark, str(tmp_path / "enc"))
    assert again.count() == 3 and none.count() == 0


def test_offsets_and_cut_lines(spark, tmp_path):
    rows = [("s", "t", "book", "{}", f"2024-01-01T00:0{i % 3}:{i:02d}.000000Z", i, "VALID" + "é" * (i % 4)) for i in range(40)]
    events = spark.createDataFrame(rows, "collector_session_id string, token_id string, event_type string, raw_payload string, received_at_utc string, receipt_sequence long, coverage_state string")
    tape.write_segments(events.withColumn("received_at", F.col("received_at_utc").cast("timestamp")), str(tmp_path / "seg"), 60)
    files = sorted((tmp_path / "seg").rglob("*.txt"))
    good, refused = tape.read_tape(spark, str(tmp_path / "seg"))
    assert len(files) == 3 and good.count() == 40 and refused.count() == 0
    (tmp_path / "bad").mkdir()
    lines = files[0].read_bytes().splitlines(keepends=True)
    (tmp_path / "bad" / "gap.txt").write_bytes(b"".join(lines[:3] + lines[4:]))  # a line is gone, so all after it stand elsewhere
    (tmp_path / "bad" / "cut.txt").write_bytes(b"".join(lines)[:-1])  # whole JSON, but no end of the line
    good, refused = tape.read_tape(spark, str(tmp_path / "bad"))
    by = {}
    for r in refused.collect():
        by.setdefault(r.segment.rsplit("/", 1)[1], []).append(r.reason)
    assert by == {"gap.txt": ["stored_offset_mismatch"] * (len(lines) - 4), "cut.txt": ["truncated_or_malformed_line"]}
    assert good.count() == 3 + len(lines) - 1
    offsets = {r.byte_offset for r in refused.where("reason = 'truncated_or_malformed_line'").collect()}
    assert offsets == {sum(map(len, lines[:-1]))}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    try:
        assert tape.read_tape(spark, str(tmp_path / "seg"))[0].count() == 40  # read in many blocks
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_batch_delivered_again_changes_nothing(spark, tmp_path):
    mk = lambda rows: spark.createDataFrame(rows, "token_id string, state string, s long").withColumn("started_at", F.timestamp_seconds("s")).drop("s")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    first, second = mk([("t", "RESYNCING", 0), ("u", "VALID", 5)]), mk([("t", "VALID", 10), ("t", "VALID", 10), ("t", "GAPPED", 20)])

    def run(state):
        stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(src)
        upsert_coverage(stream, out, str(tmp_path / state)).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.token_id, r.state, r.ended_at is None) for r in read_coverage(spark, out).collect())

    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(src)
    want = [("t", "GAPPED", True), ("t", "RESYNCING", False), ("t", "VALID", False), ("u", "VALID", True)]
    assert run("a") == want
    assert run("b") == want  # the stream's own record is lost and every batch comes again


def test_messages_fan_out(spark):
    msgs = [json.dumps([{"event_type": "book", "asset_id": "a", "bids": [{"price": "0.4", "size": "1"}], "asks": []}]),
            json.dumps({"event_type": "price_change", "price_changes": [{"asset_id": "a", "side": "BUY", "price": "0.4", "size": "2"}, {"token_id": "b", "side": "SELL", "price": "0.5", "size": "0"}]}),
            json.dumps({"type": "hello"})]
    out = tape.explode_messages(spark.createDataFrame([(m,) for m in msgs], "message string"))
    assert sorted((r.token_id, r.event_type) for r in out.collect()) == [("a", "book"), ("a", "price_change"), ("b", "price_change")]


def test_asos_and_truth_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("station,valid,TMPF,dwpf,p01i,skyc1\nNYC,2024-01-01 00:51,50.0,M,T,OVC\nNYC,2024-01-01 01:51,M,40.0,0.10,M\nNYC,bad,1,2,3,CLR\n")
    rows = tables.read_asos(spark, str(tmp_path / "a.csv")).orderBy("valid").collect()
    assert [(r.tmpf, r.dwpf, r.p01i, r.skyc1) for r in rows] == [(50.0, None, 0.0, "OVC"), (None, 40.0, 0.1, None)]
    (tmp_path / "t.csv").write_text("Daily maximum\nYear,Month,Day,Value,Completeness\n2024,1,2,20.5,C\n2024,1,3,***,\n2024,2,31,1,C\n")
    out = tables.read_daily_truth(spark, str(tmp_path / "t.csv"), "high").collect()
    assert [(str(r.market_date), r.high) for r in out] == [("2024-01-02", 20.5)]


def test_missing_columns_load_as_null(spark, tmp_path):
    (tmp_path / "f.csv").write_text("station,current_temp\nNYC,nan\nLGA,3\n")
    schema = T.StructType.fromDDL("station string, current_temp double, dewpoint double")
    assert sorted((r.station, r.current_temp, r.dewpoint) for r in tables.read_features(spark, str(tmp_path / "f.csv"), schema).collect()) == [("LGA", 3.0, None), ("NYC", None, None)]


@pytest.mark.parametrize("text,want", [
    ("Will the highest temperature in NYC be between 70-71°F on May 1, 2025?", (70.0, 71.0, "F")), ("Will it be 80°F or higher on May 1, 2025?", (80.0, None, "F")),
    ("Will it be 12°C or below on May 1, 2025?", (None, 12.0, "C")), ("Will the high be 75°F on May 1, 2025?", (75.0, 75.0, "F")), ("Will it rain?", (None, None, "F"))])
def test_market_questions(spark, text, want):
    r = markets.parse_markets(spark.createDataFrame([(text,)], "q string"), "q").first()
    assert (r.lower, r.upper, r.unit) == want


@pytest.mark.parametrize("label,want", [("<=65F", (None, 65.0)), (">=80", (80.0, None)), ("70-71F", (70.0, 71.0)), ("-3--1", (-3.0, -1.0)), ("about 3", None)])
def test_bucket_labels(spark, label, want):
    b = spark.createDataFrame([(label,)], "b string").select(buckets.parse_bucket(F.col("b")).alias("p")).first().p
    assert (None if b is None else tuple(b)) == want


def test_containments_and_rounding_differ_where_they_should(spark):
    one = spark.range(1)
    b = F.struct(F.lit(70.0).alias("lower"), F.lit(71.0).alias("upper"))
    r = one.select(buckets.bucket_won(F.lit(71.0), b).alias("market"), buckets.ladder_contains(F.lit(71.0), F.lit(70.0), F.lit(71.0)).alias("ladder"),
                   buckets.round_half_up(F.lit(2.5)).alias("up"), F.rint(F.lit(2.5)).alias("even"), weather.cloud_code(F.lit("few"), F.lit(None).cast("string")).alias("cloud")).first()
    assert (r.market, r.ladder, r.up, r.even, r.cloud) == (True, False, 3, 2.0, 1)
