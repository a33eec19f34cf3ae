"""AGG: candles, coverage, rankings."""
from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import candles as C, coverage as V
from tickloom.sources import adapters as A
from .registry import query
from .shapes import D

DENSE_MIN = f"WITH {A.SQL_DENSE}, {A.SQL_MINUTES}"
CANDLE_COLS = "CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low, " \
              "CAST(close AS DOUBLE) AS close, CAST(volume AS DOUBLE) AS volume"


@query("AGG1_minute_ohlcv", f"{DENSE_MIN} SELECT symbol, source, bucket, {CANDLE_COLS}, trade_count FROM minutes")
def minute_ohlcv(spark, sf):
    return C.minute_ohlcv(A.ticks(spark, sf, dense=True))


@query("AGG2_daily_ohlcv", f"""WITH {A.SQL_TICKS}
SELECT symbol, CAST(ts AS DATE) AS trade_date, market_type, source,
 CAST(arg_min(price, ts) AS DOUBLE) AS open, CAST(max(price) AS DOUBLE) AS high, CAST(min(price) AS DOUBLE) AS low,
 CAST(arg_max(price, ts) AS DOUBLE) AS close, CAST(sum(volume) AS DOUBLE) AS volume, count(*) AS tick_count
FROM ticks GROUP BY 1, 2, 3, 4""")
def daily_ohlcv(spark, sf):
    return C.daily_ohlcv(A.ticks(spark, sf))


def _rebucket_sql(sec):
    return f"""{DENSE_MIN} SELECT symbol, source, time_bucket(INTERVAL '{sec} seconds', bucket, TIMESTAMP '1970-01-01') AS bucket,
 CAST(arg_min(open, bucket) AS DOUBLE) AS open, CAST(max(high) AS DOUBLE) AS high, CAST(min(low) AS DOUBLE) AS low,
 CAST(arg_max(close, bucket) AS DOUBLE) AS close, CAST(sum(volume) AS DOUBLE) AS volume,
 CAST(sum(trade_count) AS BIGINT) AS trade_count
FROM minutes GROUP BY 1, 2, 3"""


def _register_rebucket(interval, sec):
    @query(f"AGG3_rebucket_{interval}", _rebucket_sql(sec))
    def rebucket(spark, sf):
        return C.rebucket(C.minute_ohlcv(A.ticks(spark, sf, dense=True)), interval)


for _i, _s in C.INTERVAL_SECONDS.items():
    _register_rebucket(_i, _s)


@query("AGG4_known_trade_count", f"""{DENSE_MIN}, live AS (
 SELECT *, CASE WHEN minute(bucket) % 7 = 0 THEN trade_count END AS known FROM minutes)
SELECT symbol, source, time_bucket(INTERVAL '5 minutes', bucket, TIMESTAMP '1970-01-01') AS bucket,
 CAST(CASE WHEN count(known) = count(*) THEN sum(known) END AS BIGINT) AS trade_count, count(*) AS minutes
FROM live GROUP BY 1, 2, 3""")
def known_trade_count(spark, sf):
    """Live minutes do not know their trade count, so a mixed bucket has none."""
    m = C.minute_ohlcv(A.ticks(spark, sf, dense=True))
    m = m.withColumn("trade_count", F.when(F.minute("bucket") % 7 == 0, F.col("trade_count")))
    return (m.groupBy("symbol", "source", F.window("bucket", "5 minutes").start.alias("b"))
            .agg(C.known_sum("trade_count").alias("trade_count"), F.count("*").alias("minutes"))
            .withColumnRenamed("b", "bucket"))


# The stored candles of the top-up stop 20 minutes before the end of the range.
TOP_UP = f"""{DENSE_MIN}, lim AS (SELECT date_trunc('hour', max(ts)) AS e FROM dense),
kept AS (SELECT minutes.* FROM minutes, lim WHERE bucket < e - INTERVAL '20 minutes'
  AND NOT (source = 'ALPACA' AND bucket >= e - INTERVAL '26 minutes')
  AND bucket >= e - INTERVAL '3 hours'),
cut AS (SELECT symbol, source, max(bucket) + INTERVAL '1 minute' AS cutoff FROM kept GROUP BY 1, 2),
fresh AS (SELECT symbol, source, date_trunc('minute', ts) AS bucket, arg_min(price, ts) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, ts) AS close, CAST(sum(volume) AS DECIMAL(32,8)) AS volume, count(*) AS trade_count
 FROM dense LEFT JOIN cut USING (symbol, source), lim
 WHERE ts >= e - INTERVAL '30 minutes' AND ts < e AND (cutoff IS NULL OR ts >= cutoff) GROUP BY 1, 2, 3),
alltogether AS (SELECT symbol, source, bucket, open, high, low, close, volume, trade_count FROM kept
 UNION ALL SELECT * FROM fresh)"""


def _range_end(ticks):
    return ticks.agg(F.date_trunc("hour", F.max("ts").cast("timestamp")).cast("timestamp_ntz").alias("e"))


def _kept(spark, sf):
    ticks = A.ticks(spark, sf, dense=True)
    end = _range_end(ticks).scalar()
    minutes = C.minute_ohlcv(ticks)
    kept = minutes.filter(
        (F.col("bucket") < end - F.expr("INTERVAL 20 MINUTES"))
        & ~((F.col("source") == "ALPACA") & (F.col("bucket") >= end - F.expr("INTERVAL 26 MINUTES"))))
    return ticks, kept, end - F.expr("INTERVAL 3 HOURS"), end


@query("AGG5_top_up_5m", TOP_UP + """
SELECT symbol, source, time_bucket(INTERVAL '5 minutes', bucket, TIMESTAMP '1970-01-01') AS bucket,
 CAST(arg_min(open, bucket) AS DOUBLE) AS open, CAST(max(high) AS DOUBLE) AS high, CAST(min(low) AS DOUBLE) AS low,
 CAST(arg_max(close, bucket) AS DOUBLE) AS close, CAST(sum(volume) AS DOUBLE) AS volume,
 CAST(sum(trade_count) AS BIGINT) AS trade_count
FROM alltogether GROUP BY 1, 2, 3""")
def top_up(spark, sf):
    ticks, kept, start, end = _kept(spark, sf)
    return C.intraday(kept, ticks, "5m", start, end)


@query("SET1_union_stored_and_tick_minutes", TOP_UP + f"""
SELECT symbol, source, bucket, {CANDLE_COLS}, trade_count FROM alltogether""")
def union_minutes(spark, sf):
    ticks, kept, start, end = _kept(spark, sf)
    return C.topped_up_minutes(kept, ticks, start, end)


@query("AGG6_latest_source", f"""{DENSE_MIN}
SELECT symbol, source FROM (SELECT symbol, source,
  row_number() OVER (PARTITION BY symbol ORDER BY max(bucket) DESC, source) AS rn FROM minutes
  WHERE bucket >= (SELECT max(ts) FROM dense) - INTERVAL '3 days' GROUP BY 1, 2) t WHERE rn = 1""")
def latest_source(spark, sf):
    ticks = A.ticks(spark, sf, dense=True)
    return C.latest_source(C.minute_ohlcv(ticks), ticks.agg(F.max("ts")).scalar())


def _coverage_sql(src, ts, step):
    return f"""SELECT symbol, source, min({ts}) AS first_ts, max({ts}) AS last_ts, count(*) AS row_count,
 CAST(greatest(0, floor((epoch(CAST(max({ts}) AS TIMESTAMP)) - epoch(CAST(min({ts}) AS TIMESTAMP))) / {step}) + 1 - count(*)) AS BIGINT) AS missing_count,
 CASE WHEN floor((epoch(CAST(max({ts}) AS TIMESTAMP)) - epoch(CAST(min({ts}) AS TIMESTAMP))) / {step}) + 1 - count(*) <= 0
  THEN 'COMPLETE' ELSE 'GAPS' END AS status FROM {src} GROUP BY 1, 2"""


@query("AGG7_coverage_1m", f"{DENSE_MIN} " + _coverage_sql("minutes", "bucket", 60))
def coverage_minutes(spark, sf):
    return V.coverage(C.minute_ohlcv(A.ticks(spark, sf, dense=True)), "bucket", 60)


@query("AGG7_coverage_1d", f"WITH {A.SQL_BARS} " + _coverage_sql("bars", "trade_date", 86400))
def coverage_days(spark, sf):
    return V.coverage(A.bars_daily(spark, sf), "trade_date", 86400)


@query("AGG8_date_coverage", f"""WITH {A.SQL_BARS}
SELECT symbol, source, min(trade_date) AS first_date, max(trade_date) AS last_date,
 count(DISTINCT trade_date) AS bar_count FROM bars GROUP BY 1, 2""")
def date_coverage(spark, sf):
    return V.date_coverage(A.bars_daily(spark, sf))


@query("AGG9_history_before", f"""WITH {A.SQL_BARS}
SELECT symbol, source, count(DISTINCT trade_date) AS history_bars FROM bars
WHERE trade_date < DATE '1998-01-01' GROUP BY 1, 2""")
def history_before(spark, sf):
    return V.history_before(A.bars_daily(spark, sf), D("1998-01-01"))


@query("AGG10_eligible_symbols", f"""WITH {A.SQL_BARS}
SELECT symbol FROM bars WHERE source = 'BINANCE' AND market_type = 'CRYPTO' GROUP BY symbol
HAVING count(DISTINCT trade_date) FILTER (trade_date BETWEEN DATE '1998-03-02' AND DATE '1998-03-06') = 5
 AND count(DISTINCT trade_date) FILTER (trade_date < DATE '1998-03-02') >= 50""")
def eligible(spark, sf):
    return V.eligible_symbols(A.bars_daily(spark, sf), D("1998-03-02"), D("1998-03-06"), 50)


@query("AGG11_known_symbols", f"""WITH {A.SQL_BARS}
SELECT count(DISTINCT symbol) AS symbol_count FROM bars WHERE source = 'BINANCE' AND market_type = 'CRYPTO'""")
def known_symbols(spark, sf):
    return V.known_symbols(A.bars_daily(spark, sf))


@query("AGG12_top_by_turnover", f"""WITH {A.SQL_BARS}, traded AS (
 SELECT DISTINCT 'S' || CAST(s_suppkey % 10 AS VARCHAR) AS symbol FROM supplier WHERE s_acctbal > 0 AND s_nationkey < 12),
coins AS (SELECT symbol, trade_date, CASE WHEN symbol = 'S3' THEN CAST(0.00002341 AS DECIMAL(24,8)) ELSE CAST(close AS DECIMAL(24,8)) END AS close,
 CASE WHEN symbol = 'S3' THEN CAST(900000000000 AS DECIMAL(32,8)) ELSE CAST(volume AS DECIMAL(32,8)) END AS volume FROM bars)
SELECT symbol, CAST(sum(CAST(CAST(close AS DECIMAL(18,8)) * CAST(volume AS DECIMAL(20,8)) AS DECIMAL(38,6))) AS DOUBLE) AS quote_volume
FROM coins WHERE trade_date >= DATE '2001-11-04' - 30 AND symbol IN (SELECT symbol FROM traded UNION ALL SELECT 'S3')
GROUP BY symbol ORDER BY quote_volume DESC, symbol LIMIT 5""")
def top_by_turnover(spark, sf):
    """One of the symbols is a cheap coin with a very large volume."""
    traded = (A.table(spark, sf, "supplier").filter((F.col("s_acctbal") > 0) & (F.col("s_nationkey") < 12))
              .select(F.concat(F.lit("S"), (F.col("s_suppkey") % 10).cast("string")).alias("symbol")))
    traded = traded.unionByName(spark.range(1).select(F.lit("S3").alias("symbol")))
    cheap = F.col("symbol") == "S3"
    bars = A.bars_daily(spark, sf).withColumns({
        "close": F.when(cheap, F.lit("0.00002341").cast("decimal(24,8)")).otherwise(F.col("close")),
        "volume": F.when(cheap, F.lit("900000000000").cast("decimal(32,8)")).otherwise(F.col("volume"))})
    return V.top_by_turnover(bars, traded, D("2001-11-04"), 5)


@query("AGG13_top_by_quote_volume", """SELECT symbol, quote_volume FROM (
 SELECT upper(replace(p_brand, '#', '')) || CASE WHEN p_size % 3 = 0 THEN 'BTC' ELSE 'USDT' END AS symbol,
  CAST(sum(CAST(p_retailprice AS DECIMAL(18,4))) AS DOUBLE) AS quote_volume FROM part GROUP BY 1) t
WHERE symbol LIKE '%USDT' ORDER BY quote_volume DESC, symbol LIMIT 10""")
def top_by_quote_volume(spark, sf):
    part = A.table(spark, sf, "part")
    symbol = F.concat(F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))),
                      F.when(F.col("p_size") % 3 == 0, "BTC").otherwise("USDT"))
    tickers = part.groupBy(symbol.alias("symbol")).agg(
        F.sum(F.col("p_retailprice").cast("decimal(18,4)")).alias("quote_volume"))
    return V.top_by_quote_volume(tickers, 10)


def _register_health(by):
    @query(f"AGG14_ticks_by_{by}", f"""WITH {A.SQL_TICKS}
SELECT {by}, count(*) AS cnt FROM ticks GROUP BY 1 ORDER BY cnt DESC, {by} LIMIT 10""")
    def health(spark, sf):
        return V.tick_health(A.ticks(spark, sf), by)


for _b in ("source", "symbol"):
    _register_health(_b)


@query("AGG14_staleness", f"""WITH {A.SQL_TICKS}
SELECT count(*) AS rows, max(ts) AS last_trade_ts,
 CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(max(ts))) AS BIGINT) AS staleness_s FROM ticks""")
def staleness(spark, sf):
    return V.tick_staleness(A.ticks(spark, sf), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@query("AGG15_newest_trade", f"""WITH {A.SQL_TICKS}
SELECT symbol, arg_max(source, ts) AS source, CAST(arg_max(price, ts) AS DOUBLE) AS price,
 CAST(arg_max(volume, ts) AS DOUBLE) AS volume, arg_max(exchange, ts) AS exchange, max(ts) AS ts,
 arg_max(market_type, ts) AS market_type, arg_max(event_id, ts) AS event_id FROM ticks GROUP BY symbol""")
def newest_trade(spark, sf):
    return C.newest_trade(A.ticks(spark, sf))


@query("AGG16_previous_close", f"""WITH {A.SQL_BARS}
SELECT symbol, CAST(arg_max(close, trade_date) AS DOUBLE) AS prev_close FROM bars GROUP BY symbol""")
def previous_close(spark, sf):
    return C.previous_close(A.bars_daily(spark, sf))
