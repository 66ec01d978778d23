"""Sources, sinks and streams as round trips: the given tables are written in a source's form, read back and compared with themselves."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.operators import tape_joins
from skyledger.queries.registry import query
from skyledger.queries.tape_queries import CHK_SQL, COV_SQL, validity
from skyledger.queries.views import OBS_SQL, SIGNAL_SQL, TAPE_SQL, observations, signals, table, tape
from skyledger.session import materialize, new_table
from skyledger.sources import tables
from skyledger.sources import tape as tapes
from skyledger.streaming.books import read_coverage, stream_books, upsert_coverage


@query("s01_feature_csv", f"WITH {SIGNAL_SQL} SELECT station, count(*) AS n, sum(fair) AS fair, count(*) FILTER (WHERE minute_of_day % 5 > 0) AS edges, 0::BIGINT AS absent FROM v_signal GROUP BY station", "fair", 4)
def s01(spark, sf):
    """Features as CSV with a header; NaN text and a column that the file lacks come back as null."""
    path = new_table(spark)
    rows = signals(spark, sf).select("station", F.when(F.col("minute_of_day") % 5 == 0, F.lit("nan")).otherwise(F.col("edge").cast("string")).alias("edge"), "fair")
    tables.write_report(rows, path, "csv")
    back = tables.read_features(spark, path, T.StructType.fromDDL("station string, fair double, edge double, dewpoint double"))
    return back.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.sum("fair").alias("fair"), F.count("edge").alias("edges"), F.count("dewpoint").alias("absent"))


@query("s02_asos_csv", f"WITH {OBS_SQL} SELECT station, count(*) AS n, count(tmpf) AS temps, sum(tmpf) AS tmpf, sum(CASE WHEN k % 7 = 0 THEN 0.0 ELSE k / 100 END) AS rain, max(valid) AS latest FROM v_obs GROUP BY station", "tmpf rain", 4, "latest")
def s02(spark, sf):
    """Observations as the export writes them: mixed-case header, M for a gap, T for a trace, text times."""
    path = new_table(spark)
    rows = observations(spark, sf).select(F.col("station").cast("string").alias("station"), F.date_format("valid", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("valid"), F.coalesce(F.col("tmpf").cast("string"), F.lit("M")).alias("TMPF"),
                                          F.when(F.col("k") % 7 == 0, "T").otherwise((F.col("k") / 100).cast("string")).alias("P01I"))
    rows.write.option("header", True).csv(path)
    back = tables.read_asos(spark, path)
    return back.groupBy(F.col("station").cast("long").alias("station")).agg(F.count(F.lit(1)).alias("n"), F.count("tmpf").alias("temps"), F.sum("tmpf").alias("tmpf"), F.sum("p01i").alias("rain"), F.max("valid").alias("latest"))


@query("s03_daily_truth_csv", f"WITH {OBS_SQL}, d AS (SELECT CAST(valid AS DATE) AS market_date, round(max(tmpf), 2) AS high, count(*) AS n FROM v_obs GROUP BY ALL) SELECT market_date, high, CASE WHEN n % 2 = 0 THEN 'C' ELSE '#' END AS completeness FROM d WHERE n % 9 > 0 AND high IS NOT NULL", "high", dates="market_date")
def s03(spark, sf):
    """Daily maxima under two lines of preamble; days marked *** have no value."""
    path = new_table(spark)
    day = F.to_date("valid")
    rows = observations(spark, sf).groupBy(day.alias("d")).agg(F.round(F.max("tmpf"), 2).alias("high"), F.count(F.lit(1)).alias("n"))
    body = rows.select(F.concat_ws(",", F.year("d"), F.month("d"), F.dayofmonth("d"), F.when(F.col("n") % 9 == 0, "***").otherwise(F.coalesce(F.col("high").cast("string"), F.lit(""))), F.when(F.col("n") % 2 == 0, "C").otherwise("#")).alias("value"))
    head = spark.createDataFrame([("Daily Maximum Temperature",), ("Year,Month,Day,Value,Completeness",)], "value string")
    head.coalesce(1).unionByName(body).write.text(path)
    return tables.read_daily_truth(spark, path, "high")


def event_rows(spark, sf):
    """Tape events with the columns of an envelope."""
    return tape(spark, sf).select(F.col("session_id").alias("collector_session_id"), "token_id", "event_type", "raw_payload", F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("received_at_utc"), "receipt_sequence", "coverage_state", "received_at")


@query("s04_tape_segments", f"""WITH {TAPE_SQL} SELECT session_id, 'OK' AS verdict, count(*) AS n, count(DISTINCT floor(epoch(received_at) / 86400)) AS segments, CAST(sum(receipt_sequence) AS BIGINT) AS sequences FROM v_tape WHERE receipt_sequence % 50 > 0 GROUP BY session_id
  UNION ALL SELECT session_id, 'checksum_mismatch', count(*), NULL, NULL FROM v_tape WHERE receipt_sequence % 50 = 0 GROUP BY session_id""")
def s04(spark, sf):
    """Segments with stated offsets, in which every fiftieth checksum is changed before they are read: the others are whole and
    stand where they say."""
    path, changed = new_table(spark), new_table(spark)
    tapes.write_segments(event_rows(spark, sf), path, 86400)
    at = F.length("value") - 65  # the first digit of the checksum, before the closing quote and brace
    digit = F.translate(F.substr("value", at, F.lit(1)), "0123456789abcdef", "123456789abcdef0")
    bad = F.regexp_extract("value", r'"receipt_sequence":(\d+)', 1).cast("long") % 50 == 0
    lines = spark.read.text(path).withColumn("value", F.when(bad, F.concat(F.substr("value", F.lit(1), at - 1), digit, F.substr("value", at + 1))).otherwise(F.col("value")))
    lines.write.partitionBy("collector_session_id", "part").text(changed)
    good, refused = tapes.read_tape(spark, changed)
    ok = good.groupBy(F.col("collector_session_id").alias("session_id"), F.lit("OK").alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("segment").alias("segments"), F.sum("receipt_sequence").alias("sequences"))
    session = F.regexp_extract("segment", "collector_session_id=([^/]+)", 1)
    no = refused.groupBy(session.alias("session_id"), F.col("reason").alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("segments"), F.lit(None).cast("long").alias("sequences"))
    return ok.unionByName(no)


@query("s05_tape_sink", f"WITH {TAPE_SQL} SELECT session_id, CAST(floor(epoch(received_at) / 3600) * 3600 AS BIGINT) AS part, count(*) AS n, min(receipt_sequence) AS first, max(receipt_sequence) AS last FROM v_tape GROUP BY ALL")
def s05(spark, sf):
    path = new_table(spark)
    tapes.write_tape(event_rows(spark, sf), path, 3600)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("collector_session_id").alias("session_id"), F.col("part").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("receipt_sequence").alias("first"), F.max("receipt_sequence").alias("last"))


@query("s06_feed_messages", f"""WITH {TAPE_SQL}, u AS (SELECT token_id, 'book' AS event_type FROM v_tape WHERE event_type = 'book' UNION ALL SELECT token_id, 'price_change' FROM v_tape WHERE event_type = 'price_change' UNION ALL SELECT 'x' || token_id, 'price_change' FROM v_tape WHERE event_type = 'price_change' UNION ALL SELECT token_id, 'last_trade_price' FROM v_tape WHERE event_type = 'last_trade_price')
  SELECT token_id, event_type, count(*) AS n FROM u GROUP BY ALL""")
def s06(spark, sf):
    """Messages as a feed sends them: books in a list, two changes in one message, trades alone, and others without a token."""
    price = (F.col("tick") / 100).cast("string")
    size = F.col("size").cast("string")
    book = F.to_json(F.array(F.struct(F.lit("book").alias("event_type"), F.col("token_id").alias("asset_id"), F.array(F.struct(price.alias("price"), size.alias("size"))).alias("bids"))))
    changes = F.to_json(F.struct(F.lit("price_change").alias("event_type"), F.array(F.struct(F.col("token_id").alias("asset_id"), F.lit(None).cast("string").alias("token_id"), "side", price.alias("price"), size.alias("size")),
                                                                                    F.struct(F.lit(None).cast("string").alias("asset_id"), F.concat(F.lit("x"), "token_id").alias("token_id"), "side", price.alias("price"), size.alias("size"))).alias("price_changes")))
    trade = F.to_json(F.struct(F.lit("last_trade_price").alias("type"), F.col("token_id").alias("asset_id"), price.alias("price")))
    kind = F.col("event_type")
    rows = tape(spark, sf).select(F.when(kind == "book", book).when(kind == "price_change", changes).when(kind == "last_trade_price", trade).otherwise(F.lit('{"type": "ping"}')).alias("message"))
    return tapes.explode_messages(rows).groupBy("token_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("s08_station_table", f"WITH {SIGNAL_SQL} SELECT n_name AS timezone, count(*) AS n, sum(entry) AS entry FROM v_signal JOIN nation ON station = 's' || n_nationkey GROUP BY n_name", "entry")
def s08(spark, sf):
    """The station dimension as a CSV file, joined to signals."""
    path = new_table(spark)
    rows = table(spark, sf, "nation").select(F.lit("c").alias("city"), F.concat(F.lit("s"), "n_nationkey").alias("station"), F.col("n_name").alias("timezone"), (F.col("n_nationkey") + 0.5).alias("latitude"))
    tables.write_report(rows, path, "csv")
    dimension = tables.stations(spark, path).select("station", "timezone")
    return signals(spark, sf).join(dimension, ["station"]).groupBy("timezone").agg(F.count(F.lit(1)).alias("n"), F.sum("entry").alias("entry"))


def take_in(spark, deliveries, stream) -> None:
    """Each delivery is written as the files of all its tasks, then `stream` takes in what is new as one batch, going on from its
    checkpoint. So the order of deliveries holds without one file, or one task, for each of them."""
    path = new_table(spark)
    for rows in deliveries:
        rows.write.mode("append").parquet(path)
        stream(spark.readStream.schema(rows.schema).parquet(path)).trigger(availableNow=True).start().awaitTermination()


def thirds(rows, by, at) -> list:
    """The rows in three parts by the order of `by`, cut about where the shares `at` end."""
    cuts = [0, *rows.agg(F.percentile_approx(by, at)).first()[0], 1 << 62]
    return [rows.where((by >= low) & (by < high)) for low, high in zip(cuts, cuts[1:], strict=False)]


@query("t03_stream_books", f"""WITH {COV_SQL}, {CHK_SQL}, k AS (SELECT token_id, 'checkpoint' AS kind FROM v_chk UNION ALL SELECT token_id, 'coverage' FROM v_cov UNION ALL SELECT token_id, 'late' FROM v_state) SELECT token_id, kind, count(*) AS n FROM k GROUP BY ALL""")
def t03(spark, sf):
    """Books over a stream that delivers every event twice: the second delivery is late throughout and changes nothing."""
    events = materialize(tape(spark, sf).select("token_id", "receipt_sequence", "received_at", "event_type", "coverage_state", "raw_payload"))
    path = new_table(spark)
    parts = thirds(events, F.col("receipt_sequence"), [0.34, 0.67])
    take_in(spark, [*parts, *parts], lambda arriving: stream_books(arriving, 5, "400 days").writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows"))
    return spark.read.parquet(f"{path}/rows").groupBy("token_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("t07_coverage_upsert", f"""WITH {COV_SQL} SELECT token_id, state, count(*) AS n, count(ended_at) AS closed, sum(epoch(ended_at) - epoch(started_at)) AS seconds FROM v_cov GROUP BY ALL""", "seconds", 3)
def t07(spark, sf):
    """Coverage intervals kept by a streaming upsert; every delivery of changes comes twice."""
    changes = materialize(tape_joins.coverage_intervals(validity(tape(spark, sf))).select("token_id", "state", "started_at"))
    path = new_table(spark)
    parts = thirds(changes, F.unix_micros("started_at"), [0.3, 0.6])
    take_in(spark, [p for part in parts for p in (part, part)], lambda arriving: upsert_coverage(arriving, f"{path}/coverage", f"{path}/state"))
    seconds = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6
    return read_coverage(spark, f"{path}/coverage").groupBy("token_id", "state").agg(F.count(F.lit(1)).alias("n"), F.count("ended_at").alias("closed"), F.sum(seconds).alias("seconds"))
