"""Views of the given tables that queries share, as one text for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TXN = """
SELECT
  concat('event-', lpad(CAST(event_id AS STRING), 8, '0')) AS event_id,
  concat('txn-', lpad(CAST(event_id AS STRING), 8, '0')) AS transaction_id,
  concat('customer-', lpad(CAST(user_id AS STRING), 6, '0')) AS customer_id,
  concat('merchant-', lpad(CAST(k % 20 AS STRING), 3, '0')) AS merchant_id,
  event_type AS merchant_category,
  concat('device-', lpad(CAST((user_id * 3 + k % 3) AS STRING), 6, '0')) AS device_id,
  round(value * 10, 2) AS transaction_amount,
  CASE g WHEN 0 THEN 'USD' WHEN 1 THEN 'GBP' WHEN 2 THEN 'JPY' WHEN 3 THEN 'BRL' ELSE 'INR' END AS currency,
  CASE event_type WHEN 'view' THEN 'cash_withdrawal' WHEN 'click' THEN 'transfer' WHEN 'error' THEN 'refund' ELSE 'purchase' END AS transaction_type,
  CASE WHEN event_type = 'error' THEN 'declined' WHEN k % 10 = 0 THEN 'reversed' ELSE 'approved' END AS transaction_status,
  k % 2 = 0 AS card_present,
  CASE g WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'JP' WHEN 3 THEN 'BR' ELSE 'IN' END AS country,
  CAST(CASE g WHEN 0 THEN 40.7128 WHEN 1 THEN 51.5074 WHEN 2 THEN 35.6762 WHEN 3 THEN -23.5505 ELSE 19.0760 END AS DOUBLE) AS latitude,
  CAST(CASE g WHEN 0 THEN -74.0060 WHEN 1 THEN -0.1278 WHEN 2 THEN 139.6503 WHEN 3 THEN -46.6333 ELSE 72.8777 END AS DOUBLE) AS longitude,
  ts AS event_time, k, event_id AS n,
  CASE WHEN k >= 90 OR (event_type = 'error' AND k % 3 = 0) THEN 1 ELSE 0 END AS fraud_label
FROM (
  SELECT *, CAST((user_id + CAST(floor(k / 25) AS BIGINT)) % 5 AS INT) AS g
  FROM (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {events}) a
) b
"""


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions made of the events table, all of them."""
    return spark.sql(TXN, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


TXN_CTE = "txn AS (" + TXN.format(events="events").replace("ts AS event_time", "ts AS event_time, epoch_us(ts) AS us") + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_txn(body: str, *more: str) -> str:
    """Oracle SQL over `txn` and further CTEs."""
    return "WITH " + ", ".join([TXN_CTE, *more]) + body
