"""Shape the driver tables into ticks, bars and messages.

Every adapter is a projection or one pre-aggregated roll-up, so the filters and column lists of the
operators above it still reach the Parquet scan.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PRICE = "decimal(24,8)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_third(a: str, b: str, c: str) -> Column:
    r = F.col("user_id") % 3
    return F.when(r == 0, a).when(r == 1, b).otherwise(c)


def tick_columns(dense: bool = False) -> list[Column]:
    """Projection of ``events`` onto the tick schema."""
    ts = F.col("ts")
    if dense:  # one tick every two seconds
        ts = F.expr("timestampadd(SECOND, cast(event_id * 2 AS int), TIMESTAMP_NTZ '2024-01-01 00:00:00')")
    return [
        F.col("event_id"),
        F.upper("event_type").alias("symbol"),
        _by_third("BINANCE", "ALPACA", "SIMULATOR").alias("source"),
        F.col("event_id").cast("string").alias("trade_id"),
        (F.col("value") + 1).cast(PRICE).alias("price"),
        (F.lit(1) + F.col("user_id") % 10).cast(PRICE).alias("volume"),
        _by_third("BINANCE", "IEX", "SIM").alias("exchange"),
        ts.alias("ts"),
        _by_third("CRYPTO", "STOCK", "STOCK").alias("market_type"),
        (F.col("event_id") % 1000 - 5).alias("latency_ms"),
    ]


def ticks(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    return table(spark, sf_dir, "events").select(*tick_columns(dense))


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from ``lineitem``: one partial aggregation, then one row per symbol and day."""
    px = F.col("l_extendedprice").cast(PRICE)
    order = F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_linenumber")
    li = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string")).alias("symbol"),
        F.col("l_shipdate").cast("date").alias("trade_date"),
        px.alias("px"), F.col("l_quantity").cast(PRICE).alias("q"), order.alias("k"))
    return (li.groupBy("symbol", "trade_date")
            .agg(F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
                 F.max_by("px", "k").alias("close"), F.sum("q").cast(PRICE).alias("volume"),
                 F.count("*").alias("tick_count"))
            .select("symbol", "trade_date", F.lit("BINANCE").alias("source"), F.lit("CRYPTO").alias("market_type"),
                    "open", "high", "low", "close", "volume", "tick_count"))


# The same shapes as DuckDB text, for the SQL checks.
SQL_TICK_BODY = """
 SELECT event_id, upper(event_type) AS symbol,
  CASE user_id % 3 WHEN 0 THEN 'BINANCE' WHEN 1 THEN 'ALPACA' ELSE 'SIMULATOR' END AS source,
  CAST(event_id AS VARCHAR) AS trade_id,
  CAST(value + 1 AS DECIMAL(24,8)) AS price,
  CAST(1 + user_id % 10 AS DECIMAL(24,8)) AS volume,
  CASE user_id % 3 WHEN 0 THEN 'BINANCE' WHEN 1 THEN 'IEX' ELSE 'SIM' END AS exchange,
  {ts} AS ts,
  CASE user_id % 3 WHEN 0 THEN 'CRYPTO' ELSE 'STOCK' END AS market_type,
  event_id % 1000 - 5 AS latency_ms
 FROM events"""
SQL_TICKS = "ticks AS (" + SQL_TICK_BODY.format(ts="ts") + ")"
SQL_DENSE = "dense AS (" + SQL_TICK_BODY.format(
    ts="TIMESTAMP '2024-01-01 00:00:00' + to_seconds(event_id * 2)") + ")"
SQL_BARS = """bars AS (
 SELECT 'S' || CAST(l_suppkey % 10 AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
  'BINANCE' AS source, 'CRYPTO' AS market_type,
  CAST(arg_min(px, k) AS DECIMAL(24,8)) AS open, CAST(max(px) AS DECIMAL(24,8)) AS high,
  CAST(min(px) AS DECIMAL(24,8)) AS low, CAST(arg_max(px, k) AS DECIMAL(24,8)) AS close,
  CAST(sum(q) AS DECIMAL(24,8)) AS volume, count(*) AS tick_count
 FROM (SELECT l_suppkey, l_shipdate, CAST(l_extendedprice AS DECIMAL(24,8)) AS px,
   CAST(l_quantity AS DECIMAL(24,8)) AS q,
   l_orderkey * 100000000 + l_partkey * 1000 + l_linenumber AS k FROM lineitem) t
 GROUP BY 1, 2)"""
SQL_MINUTES = """minutes AS (
 SELECT symbol, source, date_trunc('minute', ts) AS bucket,
  arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close,
  CAST(sum(volume) AS DECIMAL(32,8)) AS volume, count(*) AS trade_count
 FROM dense GROUP BY 1, 2, 3)"""
# Stored candles: official ones on minutes divisible by 7 (close raised by one), live ones elsewhere,
# none on minutes divisible by 11.
SQL_STORED = """stored AS (
 SELECT symbol, source, bucket, open, high + 1 AS high, low, close + 1 AS close, volume,
  CAST(NULL AS DECIMAL(32,8)) AS quote_volume, trade_count, 'EXCHANGE' AS origin
 FROM minutes WHERE minute(bucket) % 7 = 0 AND minute(bucket) % 11 <> 0
 UNION ALL
 SELECT symbol, source, bucket, open, high, low,
  CASE WHEN minute(bucket) % 5 = 0 THEN close + 2 ELSE close END, volume,
  NULL, NULL, 'LIVE'
 FROM minutes WHERE minute(bucket) % 7 <> 0 AND minute(bucket) % 11 <> 0)"""
