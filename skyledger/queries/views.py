"""Views that rename the driver tables into the columns the operators expect, as Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as it is stored. Where a session names `skyledger.scan.partitions`, the larger tables are dealt over so many
    partitions first: for local runs whose tables are single files of one row group, which no setting of Spark splits."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    dealt = spark.conf.get("skyledger.scan.partitions", None)
    return df.repartition(int(dealt)) if dealt and name in LARGE else df


LARGE = ("lineitem", "events")


# ---- signals: one model decision per line item ----

SIGNAL = """
(l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS id
| concat('s', CAST(l_suppkey % 20 AS STRING)) AS station
| CAST(date_trunc('week', l_shipdate) AS DATE) AS market_date
| CASE WHEN l_suppkey % 5 = 0 THEN 'LOW_TEMP' ELSE 'HIGH_TEMP' END AS market_family
| concat('m', CAST(l_partkey % 4 AS STRING)) AS model_name
| CASE l_linenumber % 3 WHEN 0 THEN 'BEST_EDGE' WHEN 1 THEN 'FIRST' ELSE 'PROGRESS' END AS strategy_bucket
| CASE l_linenumber % 4 WHEN 0 THEN 'instant' WHEN 1 THEN '10m' WHEN 2 THEN '15m' ELSE '30m' END AS obs_delay_bucket
| CASE l_linestatus WHEN 'O' THEN 'BUY_YES' ELSE 'BUY_NO' END AS selected_side
| CASE l_partkey % 7 WHEN 0 THEN concat('<=', CAST(60 + l_partkey % 20 AS STRING)) WHEN 1 THEN concat('>=', CAST(60 + l_partkey % 20 AS STRING), 'F') ELSE concat(CAST(60 + l_partkey % 20 AS STRING), '-', CAST(61 + l_partkey % 20 AS STRING), 'F') END AS selected_bucket
| round(0.05 + l_tax * 10, 4) AS entry
| round(0.05 + l_discount * 9, 4) AS fair
| round(l_discount * 9 - l_tax * 10, 4) AS edge
| CAST(l_partkey % 1440 AS INT) AS minute_of_day
| CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS correct
| l_quantity AS cost
| l_extendedprice / 1000 AS liquidity
| l_quantity * 3 AS book_age
"""


def _columns(spec: str) -> list[str]:
    return [part.strip() for part in spec.strip().split("\n|")]


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").selectExpr(
        *_columns(SIGNAL), "CAST(l_shipdate AS TIMESTAMP) + make_dt_interval(0, 0, CAST(l_partkey % 1440 AS INT), 0) AS ts")
    return df.selectExpr(
        "*", "CASE WHEN correct = 1 THEN 1 - entry WHEN correct = 0 THEN -entry END AS pnl")


def _duck(spec: str) -> str:
    return ", ".join(_columns(spec)).replace("AS STRING", "AS VARCHAR").replace("AS INT)", "AS INTEGER)")


SIGNAL_SQL = (
    f"v_signal AS (SELECT *, CASE WHEN correct = 1 THEN 1 - entry WHEN correct = 0 THEN -entry END AS pnl FROM "
    f"(SELECT {_duck(SIGNAL)}, CAST(l_shipdate AS TIMESTAMP) + to_minutes(CAST(l_partkey % 1440 AS INTEGER)) AS ts FROM lineitem))"
)

# ---- observations and tape: one row per event ----

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
OBS = f"""
user_id % 20 AS station
| event_id AS obs_id
| CASE WHEN {K} % 10 = 0 THEN NULL ELSE round(20 + value / 5, 2) END AS tmpf
| round(10 + value * 0.12, 2) AS dwpf
| CAST({K} AS DOUBLE) AS relh
| CAST({K} * 3.6 AS DOUBLE) AS drct
| {K} AS k
"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_columns(OBS), "CAST(ts AS TIMESTAMP) AS valid")


OBS_SQL = f"v_obs AS (SELECT {_duck(OBS)}, ts AS valid FROM events)"

TAPE = f"""
CAST(user_id AS STRING) AS token_id
| event_id AS receipt_sequence
| CASE event_type WHEN 'signup' THEN 'book' WHEN 'click' THEN 'price_change' WHEN 'view' THEN 'price_change' WHEN 'purchase' THEN 'last_trade_price' ELSE 'gap' END AS event_type
| CASE WHEN event_type = 'error' THEN 'GAPPED' ELSE 'VALID' END AS coverage_state
| CASE event_type WHEN 'click' THEN 'BUY' WHEN 'view' THEN 'SELL' WHEN 'purchase' THEN 'SELL' END AS side
| CASE WHEN event_type = 'view' THEN {K} % 48 + 51 ELSE {K} % 48 + 1 END AS tick
| CASE WHEN {K} % 10 = 0 AND event_type IN ('click', 'view') THEN 0.0 ELSE value END AS size
| {K} AS k
| concat('sess', CAST(user_id % 3 AS STRING)) AS session_id
"""

def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tape events with a JSON payload: a full book has four levels a side around the event's tick."""
    df = table(spark, sf_dir, "events").selectExpr(*_columns(TAPE), "CAST(ts AS TIMESTAMP) AS received_at")
    bids = "transform(sequence(0, 3), i -> struct(CAST((tick + i) / 100D AS STRING) AS price, CAST(size + i AS STRING) AS size))"
    asks = "transform(sequence(0, 3), i -> struct(CAST((tick + 50 + i) / 100D AS STRING) AS price, CAST(size + 10 * i AS STRING) AS size))"
    return df.selectExpr("*", f"""
        CASE WHEN event_type = 'book' THEN to_json(struct({bids} AS bids, {asks} AS asks))
             WHEN event_type = 'price_change' THEN to_json(struct(struct(side, CAST(tick / 100D AS STRING) AS price, CAST(size AS STRING) AS size) AS price_change))
             ELSE to_json(struct(side, CAST(tick / 100D AS STRING) AS price, CAST(size AS STRING) AS size)) END AS raw_payload""")


TAPE_SQL = f"v_tape AS (SELECT {_duck(TAPE)}, ts AS received_at FROM events)"

# state of each token after each event, written as the SQL twin of the book rules
BOOK_SQL = TAPE_SQL + """,
b0 AS (SELECT *, max(CASE WHEN event_type = 'book' THEN receipt_sequence END) OVER w AS epoch,
              max(CASE WHEN event_type = 'gap' THEN receipt_sequence END) OVER w AS bad
       FROM v_tape WINDOW w AS (PARTITION BY token_id ORDER BY receipt_sequence)),
b1 AS (SELECT *, epoch IS NOT NULL AND (bad IS NULL OR epoch > bad) AS valid FROM b0),
b2 AS (SELECT *, CASE WHEN event_type = 'gap' THEN 'coverage_gapped' WHEN event_type = 'price_change' AND NOT valid
                      THEN 'delta_before_full_book' END AS names FROM b1),
b3 AS (SELECT *, max(CASE WHEN names IS NOT NULL THEN receipt_sequence END) OVER w AS why_seq
       FROM b2 WINDOW w AS (PARTITION BY token_id ORDER BY receipt_sequence)),
v_state AS (SELECT b3.*, CASE WHEN NOT b3.valid AND (b3.epoch IS NULL OR b3.why_seq > b3.epoch) THEN n.names END AS invalid_reason
            FROM b3 LEFT JOIN b2 n ON n.token_id = b3.token_id AND n.receipt_sequence = b3.why_seq),
v_levels AS (
  SELECT token_id, epoch, receipt_sequence, received_at, 'BUY' AS side, tick + i AS tick, size + i AS size
  FROM v_state, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE event_type = 'book' AND size + i > 0
  UNION ALL
  SELECT token_id, epoch, receipt_sequence, received_at, 'SELL', tick + 50 + i, size + 10 * i
  FROM v_state, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE event_type = 'book' AND size + 10 * i > 0
  UNION ALL
  SELECT token_id, epoch, receipt_sequence, received_at, side, tick, size
  FROM v_state WHERE event_type = 'price_change' AND valid)"""


# ---- ladders: one ladder per order, one bucket per line ----

LADDER = """
l_orderkey AS ladder_id
| l_orderkey % 50 AS station_no
| l_linenumber AS line
| l_partkey AS partkey
| l_quantity AS score
| l_extendedprice AS price
| CAST(l_shipdate AS DATE) AS local_date
"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "CAST(o_orderdate AS TIMESTAMP) AS o_orderdate", "o_orderpriority")
