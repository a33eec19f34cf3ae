"""JON, TOP, VAL1-7, VAL11, SNK11, WIN16-18, WIN22."""
from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import candles as C, indicators as I, market as K, merge as M, series as R, validation as V
from tickloom.sources import adapters as A, sinks as S
from .merging import TRADED, daily_stored, traded_symbols
from .normalizing import BROKEN, broken_bars
from .registry import query
from .shapes import D, TS
from .technical import BASE, W, rs

BARS = f"WITH {A.SQL_BARS}"
NEXT_GONE = "NOT EXISTS (SELECT 1 FROM bars c WHERE c.symbol = p.symbol AND c.trade_date = p.trade_date + 1)"


@query("JON1_vanished_symbols", f"{BARS} SELECT symbol, trade_date + 1 AS trade_date FROM bars p WHERE {NEXT_GONE}")
def vanished(spark, sf):
    return V.vanished_symbols(A.bars_daily(spark, sf))


MOVES = f"""{BARS} SELECT c.symbol, c.source, c.trade_date, CAST(p.close AS DOUBLE) AS prev_close, CAST(c.close AS DOUBLE) AS curr_close,
 CAST(round(CAST(CAST(c.close - p.close AS DOUBLE) / CAST(p.close AS DOUBLE) AS DECIMAL(30,12)) * 100, 2) AS DOUBLE) AS change_pct
FROM bars c JOIN bars p ON c.symbol = p.symbol AND c.source = p.source AND p.trade_date = c.trade_date - 1
WHERE p.close > 0 AND abs(CAST(c.close - p.close AS DOUBLE) / CAST(p.close AS DOUBLE)) > 0.5"""


@query("JON2_extreme_moves", MOVES)
def extreme_moves(spark, sf):
    return V.extreme_moves(A.bars_daily(spark, sf))


@query("JON3_without_indicators", f"{BARS} SELECT DISTINCT symbol, trade_date FROM bars WHERE day(trade_date) IN (9, 19)")
def without_indicators(spark, sf):
    b = A.bars_daily(spark, sf)
    have = I.daily_indicators(b).filter(~F.dayofmonth("trade_date").isin(9, 19))
    return V.without_indicators(b, have)


# Live prices of the newest ten days of ticks for three symbols; previous closes from the ticks before, for four.
MARKET = f"""WITH {A.SQL_TICKS}, inst AS (SELECT symbol, 'Name ' || symbol AS name, max(market_type) AS market_type FROM ticks GROUP BY symbol
  UNION ALL SELECT 'NOPRICE', 'None', 'STOCK'),
live AS (SELECT symbol, arg_max(price, ts) AS price FROM ticks WHERE symbol IN ('CLICK', 'VIEW', 'ERROR') GROUP BY symbol),
prev AS (SELECT symbol, arg_max(price, ts) AS prev_close FROM ticks WHERE ts < TIMESTAMP '2024-01-20' AND symbol <> 'ERROR' GROUP BY symbol),
snap AS (SELECT symbol, price, CASE WHEN prev_close > 0 THEN price - prev_close ELSE 0 END AS change,
  CASE WHEN prev_close > 0 THEN round(round(CAST(CAST(price - prev_close AS DOUBLE) / CAST(prev_close AS DOUBLE) AS DECIMAL(30,12)), 4) * 100, 2) ELSE 0 END AS pct
  FROM live LEFT JOIN prev USING (symbol)),
items AS (SELECT inst.symbol, name, market_type, CAST(coalesce(price, prev_close) AS DOUBLE) AS current_price, CAST(prev_close AS DOUBLE) AS prev_close,
  CAST(CASE WHEN price IS NULL THEN 0 ELSE change END AS DOUBLE) AS change, CAST(CASE WHEN price IS NULL THEN 0 ELSE pct END AS DOUBLE) AS change_percent,
  price IS NOT NULL AS realtime FROM inst LEFT JOIN snap USING (symbol) LEFT JOIN prev USING (symbol) WHERE price IS NOT NULL OR prev_close IS NOT NULL)"""


def market_inputs(spark, sf):
    t = A.ticks(spark, sf)
    inst = t.groupBy("symbol").agg(F.max("market_type").alias("market_type")).select("symbol", F.concat(F.lit("Name "), "symbol").alias("name"), "market_type")
    inst = inst.unionByName(spark.range(1).select(F.lit("NOPRICE").alias("symbol"), F.lit("None").alias("name"), F.lit("STOCK").alias("market_type")))
    prev = (t.filter((F.col("ts") < TS("2024-01-20 00:00:00")) & (F.col("symbol") != "ERROR")).groupBy("symbol")
            .agg(F.max_by("price", "ts").alias("prev_close")))
    live = C.newest_trade(t.filter(F.col("symbol").isin("CLICK", "VIEW", "ERROR")))
    return inst, K.snapshots(live, prev), prev


@query("JON4_market_overview", MARKET + " SELECT * FROM items")
def overview(spark, sf):
    return K.overview(*market_inputs(spark, sf))


@query("JON13_instruments_with_price", MARKET + """ SELECT inst.symbol, name, market_type, CAST(price AS DOUBLE) AS price, CAST(change AS DOUBLE) AS change,
 CAST(pct AS DOUBLE) AS change_percent FROM inst LEFT JOIN snap USING (symbol)""")
def with_price(spark, sf):
    inst, snaps, _ = market_inputs(spark, sf)
    return K.instruments_with_price(inst, snaps)


@query("TOP1_gainers", MARKET + " SELECT symbol, change_percent FROM items ORDER BY change_percent DESC, symbol LIMIT 10")
def gainers(spark, sf):
    return K.gainers(K.overview(*market_inputs(spark, sf))).select("symbol", "change_percent")


@query("TOP1_losers", MARKET + " SELECT symbol, change_percent FROM items ORDER BY change_percent, symbol LIMIT 10")
def losers(spark, sf):
    return K.losers(K.overview(*market_inputs(spark, sf))).select("symbol", "change_percent")


DENSE = f"WITH {A.SQL_DENSE}, {A.SQL_MINUTES}"


@query("JON8_ticks_after_cutoff", f"""{DENSE}, cut AS (SELECT symbol, source, max(bucket) + INTERVAL '1 minute' AS cutoff FROM minutes
 WHERE minute(bucket) < 20 GROUP BY 1, 2) SELECT d.event_id, d.symbol, d.source, d.ts FROM dense d JOIN cut USING (symbol, source) WHERE d.ts >= cutoff""")
def ticks_after_cutoff(spark, sf):
    """Ticks newer than the stored candles of their symbol; the small side carries one row per symbol and source."""
    t = A.ticks(spark, sf, dense=True)
    stored = C.minute_ohlcv(t).filter(F.minute("bucket") < 20)
    cut = C.cutoffs(stored, TS("2024-01-01 00:00:00"), TS("2030-01-01 00:00:00"))
    return t.join(cut, ["symbol", "source"]).filter(F.col("ts") >= F.col("cutoff")).select("event_id", "symbol", "source", "ts")


@query("JON10_not_stored", f"""{BARS} SELECT symbol, trade_date FROM bars WHERE day(trade_date) % 4 = 0""")
def not_stored(spark, sf):
    b = A.bars_daily(spark, sf)
    return M.insert_missing(daily_stored(b), b, ["symbol", "trade_date", "source"]).select("symbol", "trade_date")


@query("JON11_traded_only", f"{BARS} SELECT symbol, trade_date, CAST(close AS DOUBLE) AS close FROM bars WHERE symbol IN ({TRADED})")
def traded_only(spark, sf):
    return A.bars_daily(spark, sf).join(traded_symbols(spark, sf), "symbol", "left_semi").select("symbol", "trade_date", "close")


@query("JON11_delisted", f"""SELECT DISTINCT 'S' || CAST(c_custkey % 14 AS VARCHAR) AS symbol FROM customer
 WHERE 'S' || CAST(c_custkey % 14 AS VARCHAR) NOT IN ({TRADED})""")
def delisted(spark, sf):
    archive = A.table(spark, sf, "customer").select(F.concat(F.lit("S"), (F.col("c_custkey") % 14).cast("string")).alias("symbol")).distinct()
    return archive.join(traded_symbols(spark, sf), "symbol", "left_anti")


@query("TOP2_latest_ticks", f"WITH {A.SQL_TICKS} SELECT event_id, symbol, source, CAST(price AS DOUBLE) AS price, ts FROM ticks ORDER BY ts DESC LIMIT 25")
def latest_ticks(spark, sf):
    return K.latest(A.ticks(spark, sf).select("event_id", "symbol", "source", "price", "ts"), "ts", 25, "event_id")


@query("TOP2_latest_minutes", DENSE + " SELECT symbol, source, bucket, CAST(close AS DOUBLE) AS close FROM minutes ORDER BY bucket DESC, symbol, source LIMIT 30")
def latest_minutes(spark, sf):
    m = C.minute_ohlcv(A.ticks(spark, sf, dense=True)).select("symbol", "source", "bucket", "close")
    return K.latest(m, "bucket", 30, "symbol", "source")


@query("TOP3_last_indicators", f"""{BASE}, s AS (SELECT symbol, trade_date, CASE WHEN rn >= 20 THEN CAST(sum(close) OVER ({W} ROWS 19 PRECEDING) AS DOUBLE) / 20 END AS m,
 row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back FROM b) SELECT symbol, trade_date, {rs('m', 'bb_middle')} FROM s WHERE back <= 5""")
def last_indicators(spark, sf):
    from tickloom.operators.dedup import newest_per_key
    ind = I.daily_indicators(A.bars_daily(spark, sf)).select("symbol", "trade_date", F.round("ma20", 4).alias("bb_middle"))
    return newest_per_key(ind, ["symbol"], 5, F.col("trade_date"))


@query("TOP4_ranged_candles", f"{BARS} SELECT symbol, trade_date, CAST(close AS DOUBLE) AS close FROM bars WHERE trade_date BETWEEN DATE '1997-03-01' AND DATE '1997-06-30'")
def ranged_candles(spark, sf):
    return K.ranged(A.bars_daily(spark, sf).select("symbol", "trade_date", "close"), "trade_date", D("1997-03-01"), D("1997-06-30"))


@query("TOP6_active_snapshots", f"""WITH {A.SQL_TICKS}, n AS (SELECT symbol || source AS symbol, arg_max(price, ts) AS price, max(ts) AS ts FROM ticks GROUP BY 1)
SELECT symbol, CAST(price AS DOUBLE) AS price, ts FROM n WHERE ts > (SELECT max(ts) FROM ticks) - INTERVAL '3600 seconds'""")
def active_snapshots(spark, sf):
    t = A.ticks(spark, sf).withColumn("symbol", F.concat("symbol", "source"))
    now = t.agg(F.max("ts")).scalar()
    return K.active_snapshots(C.newest_trade(t).select("symbol", "price", "ts"), now, 3600)


# -- validation ----------------------------------------------------------------------------------

@query("VAL1_gap_check", f"""{BARS} SELECT trade_date + 1 AS target, count(*) AS missing FROM bars p WHERE {NEXT_GONE} GROUP BY 1""")
def gap_check(spark, sf):
    return V.vanished_symbols(A.bars_daily(spark, sf)).groupBy(F.col("trade_date").alias("target")).agg(F.count("*").alias("missing"))


@query("SNK11_validation_rows", f"""{BARS} SELECT 'validation_gap_check' AS job_name, 'SUCCESS' AS status,
 '{{"checkName":"gap_check","targetDate":"' || CAST(trade_date + 1 AS VARCHAR) || '","result":{{"missingCount":' || CAST(count(*) AS VARCHAR) || '}}}}' AS meta
FROM bars p WHERE {NEXT_GONE} GROUP BY trade_date""")
def validation_rows(spark, sf):
    counts = gap_check(spark, sf)
    return counts.select(*S.validation_row("gap_check", F.col("target"), F.struct(F.col("missing").alias("missingCount"))))


@query("VAL2_ohlc_anomalies", BROKEN + """ SELECT symbol, trade_date, CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high,
 CAST(low AS DOUBLE) AS low, CAST(close AS DOUBLE) AS close FROM broken WHERE high < greatest(open, close) OR low > least(open, close)""")
def ohlc_anomalies(spark, sf):
    return V.anomalies(broken_bars(A.bars_daily(spark, sf)))


@query("VAL3_extreme_movement", MOVES.replace("SELECT c.symbol, c.source, c.trade_date,", "SELECT c.trade_date AS target, count(*) AS extremes FROM (SELECT c.symbol, c.source, c.trade_date,", 1) + ") c GROUP BY 1")
def extreme_movement(spark, sf):
    return V.extreme_moves(A.bars_daily(spark, sf)).groupBy(F.col("trade_date").alias("target")).agg(F.count("*").alias("extremes"))


@query("VAL4_indicator_coverage", f"""{BARS} SELECT trade_date, count(DISTINCT symbol) AS symbols,
 count(DISTINCT symbol) FILTER (day(trade_date) IN (9, 19)) AS missing FROM bars GROUP BY 1""")
def indicator_coverage(spark, sf):
    b = A.bars_daily(spark, sf)
    gone = without_indicators(spark, sf).withColumn("gone", F.lit(1))
    days = b.select("symbol", "trade_date").distinct().join(gone, ["symbol", "trade_date"], "left")
    return days.groupBy("trade_date").agg(F.count("*").alias("symbols"), F.count("gone").alias("missing"))


@query("VAL5_backtest_readiness", f"""{BARS}, a AS (SELECT symbol, source, count(DISTINCT trade_date) AS observation_count, min(trade_date) AS first_date,
 max(trade_date) AS last_date FROM bars WHERE trade_date <= DATE '1999-12-31' GROUP BY 1, 2),
g AS (SELECT *, greatest(date_diff('day', last_date, DATE '1999-12-31'), 0) AS stale_days,
 greatest(date_diff('day', first_date, last_date) + 1 - observation_count, 0) AS internal_gap_days FROM a)
SELECT *, observation_count >= 50 AND stale_days = 0 AND internal_gap_days = 0 AS ready FROM g""")
def backtest_readiness(spark, sf):
    return V.backtest_readiness(A.bars_daily(spark, sf), D("1999-12-31"))


@query("VAL6_daily_readiness", f"""{BARS}, a AS (SELECT symbol, source, min(trade_date) AS first_date, max(trade_date) AS last_date,
 count(DISTINCT trade_date) FILTER (trade_date BETWEEN DATE '1998-03-02' AND DATE '1998-03-06') AS selected_bars,
 count(DISTINCT trade_date) FILTER (trade_date < DATE '1998-03-02') AS history_bars FROM bars GROUP BY 1, 2)
SELECT *, CAST(5 AS BIGINT) AS expected_bars, greatest(5 - selected_bars, 0) AS missing_bars,
 CASE WHEN selected_bars = 0 THEN 'no daily bars in the range' WHEN history_bars < 50 THEN 'not enough history before the range'
  WHEN selected_bars < 5 THEN 'missing daily bars in the range' END AS reason,
 CASE WHEN selected_bars = 5 AND history_bars >= 50 THEN 'READY' ELSE 'BLOCKED' END AS status FROM a""")
def daily_readiness(spark, sf):
    return V.daily_readiness(A.bars_daily(spark, sf), D("1998-03-02"), D("1998-03-06"), 50)


@query("VAL7_intraday_readiness", f"""{DENSE}, a AS (SELECT symbol, source, count(*) FILTER (bucket >= TIMESTAMP '2024-01-01 03:00:00') AS selected_bars,
 count(*) FILTER (bucket < TIMESTAMP '2024-01-01 03:00:00') AS history_bars, min(bucket) AS first_bar, max(bucket) AS last_bar FROM minutes
 WHERE bucket >= TIMESTAMP '2024-01-01 01:20:00' AND bucket < TIMESTAMP '2024-01-01 03:10:00' GROUP BY 1, 2)
SELECT *, CAST(10 AS BIGINT) AS expected_bars, greatest(10 - selected_bars, 0) AS missing_bars,
 CASE WHEN selected_bars = 0 THEN 'no minute bars in the range' WHEN selected_bars < 10 THEN 'missing minute bars in the range'
  WHEN history_bars < 50 THEN 'not enough history before the range' END AS reason,
 CASE WHEN selected_bars = 10 AND history_bars >= 50 THEN 'READY' ELSE 'BLOCKED' END AS status FROM a""")
def intraday_readiness(spark, sf):
    m = C.minute_ohlcv(A.ticks(spark, sf, dense=True))
    return V.intraday_readiness(m, TS("2024-01-01 03:00:00"), TS("2024-01-01 03:10:00"), 50)


LAG = f"""WITH {A.SQL_DENSE}, smp AS (SELECT source AS group_id, event_id % 12 AS part, date_trunc('minute', ts) AS ts,
 CAST(floor(CAST(price AS DOUBLE) * 400) AS BIGINT) AS lag, event_id % 5000 AS margin FROM dense),
g AS (SELECT group_id, ts, CAST(sum(lag) AS BIGINT) AS total_lag, min(CASE WHEN lag > 100 THEN margin END) AS mm FROM smp GROUP BY 1, 2),
sl AS (SELECT *, regr_slope(total_lag, epoch(ts) - 1700000000) OVER (PARTITION BY group_id ORDER BY ts RANGE INTERVAL '900 seconds' PRECEDING) AS slope FROM g),
c AS (SELECT *, total_lag > 50000 AS hi, coalesce(slope > 0 AND total_lag > 10000, false) AS gr, coalesce(mm < 1000, false) AS cl FROM sl)"""


def _held(c, s):
    over = f"OVER (PARTITION BY group_id ORDER BY ts RANGE INTERVAL '{s} seconds' PRECEDING)"
    return f"bool_and({c}) {over} AND min(ts) {over} <= ts - INTERVAL '{s} seconds'"


@query("VAL11_lag_alerts", LAG + f""" SELECT group_id, ts, total_lag, {_held('hi', 300)} AS lag_high, {_held('gr', 900)} AS lag_growing,
 {_held('cl', 120)} AS near_retention FROM c""")
def lag_alerts(spark, sf):
    t = A.ticks(spark, sf, dense=True)
    s = t.select(F.col("source").alias("group_id"), (F.col("event_id") % 12).alias("partition"),
                 F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts"),
                 F.floor(F.col("price").cast("double") * 400).alias("lag"), (F.col("event_id") % 5000).alias("margin"))
    return V.lag_alerts(s)


# -- series --------------------------------------------------------------------------------------

# Daily closes with a spike every 15 June.
SPIKED = f"""{BARS}, sp AS (SELECT symbol, CAST(trade_date AS TIMESTAMP) AS ts, CAST(close AS DOUBLE) * CASE WHEN day(trade_date) = 15 AND month(trade_date) = 6 THEN 100 ELSE 1 END AS close FROM bars),
lim AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM sp GROUP BY 1),
days AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM lim),
grid AS (SELECT days.symbol, days.ts, close FROM days LEFT JOIN sp USING (symbol, ts)),
med AS (SELECT *, CASE WHEN count(close) OVER f >= 5 THEN close - quantile_cont(close, 0.5) OVER f END AS resid FROM grid
 WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)),
cl AS (SELECT symbol, ts, CASE WHEN abs(resid) > 8 * stddev_samp(resid) OVER (PARTITION BY symbol) THEN NULL ELSE close END AS close FROM med),
nb AS (SELECT symbol, ts, close, last_value(close IGNORE NULLS) OVER p AS pv, max(CASE WHEN close IS NOT NULL THEN ts END) OVER p AS pt,
  first_value(close IGNORE NULLS) OVER n AS nv, min(CASE WHEN close IS NOT NULL THEN ts END) OVER n AS nt FROM cl
 WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ip AS (SELECT symbol, ts, CASE WHEN close IS NOT NULL THEN close WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv
  ELSE pv + (nv - pv) * (epoch(ts) - epoch(pt)) / (epoch(nt) - epoch(pt)) END AS close FROM nb)"""


def spiked(spark, sf):
    b = A.bars_daily(spark, sf)
    spike = (F.dayofmonth("trade_date") == 15) & (F.month("trade_date") == 6)
    return b.select("symbol", F.col("trade_date").cast("timestamp_ntz").alias("ts"),
                    (F.col("close").cast("double") * F.when(spike, 100).otherwise(1)).alias("close"))


DAY_S = 86400


@query("WIN16_regular_grid", SPIKED + " SELECT symbol, ts, close FROM grid")
def regular_grid(spark, sf):
    return R.regular_grid(spiked(spark, sf), ["symbol"], "ts", "close", DAY_S)


@query("WIN16_regular_grid_1m", f"""{DENSE}, lim AS (SELECT symbol, source, min(bucket) AS lo, max(bucket) AS hi FROM minutes GROUP BY 1, 2),
g AS (SELECT symbol, source, unnest(generate_series(lo, hi, INTERVAL 1 MINUTE)) AS bucket FROM lim)
SELECT g.symbol, g.source, g.bucket, CAST(close AS DOUBLE) AS close FROM g LEFT JOIN minutes USING (symbol, source, bucket)""")
def regular_grid_minutes(spark, sf):
    m = C.minute_ohlcv(A.ticks(spark, sf, dense=True)).select("symbol", "source", "bucket", "close")
    return R.regular_grid(m, ["symbol", "source"], "bucket", "close", 60)


@query("WIN17_outliers_removed", SPIKED + " SELECT symbol, ts, close FROM cl")
def outliers(spark, sf):
    grid = R.regular_grid(spiked(spark, sf), ["symbol"], "ts", "close", DAY_S)
    return R.drop_outliers(grid, ["symbol"], "ts", "close", DAY_S)


@query("WIN18_interpolated", SPIKED + f" SELECT symbol, ts, {rs('close', 'close', 4, 10)} FROM ip")
def interpolated(spark, sf):
    grid = R.regular_grid(spiked(spark, sf), ["symbol"], "ts", "close", DAY_S)
    out = R.fill_gaps(grid, ["symbol"], "ts", "close", DAY_S)
    return out.select("symbol", "ts", F.round(F.col("close").cast("decimal(28,10)"), 4).alias("close"))


@query("FCT8_clean_series", SPIKED + f", n AS (SELECT symbol FROM ip GROUP BY 1 HAVING count(*) >= 50) SELECT symbol, ts, {rs('close', 'close', 4, 10)} FROM ip WHERE symbol IN (SELECT symbol FROM n)")
def clean_series(spark, sf):
    out = R.clean(spiked(spark, sf), ["symbol"], "ts", "close", DAY_S)
    return out.select("symbol", "ts", F.round(F.col("close").cast("decimal(28,10)"), 4).alias("close"))


FAULTY = f"""{BARS}, f AS (SELECT symbol, trade_date AS d, CASE WHEN symbol = 'S2' AND day(trade_date) = 5 THEN 0 WHEN symbol = 'S3' AND day(trade_date) = 6 THEN NULL ELSE close END AS close FROM bars
 UNION ALL SELECT symbol, trade_date, close FROM bars WHERE symbol = 'S1' AND day(trade_date) = 7),
u AS (SELECT symbol, d, count(*) AS n, min(close) AS v, count(*) FILTER (close IS NULL) AS bad FROM f GROUP BY 1, 2),
l AS (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY symbol ORDER BY d), d) AS gap FROM u),
a AS (SELECT symbol, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n > 1) AS duplicates, CAST(sum(bad) AS BIGINT) AS invalid, count(*) FILTER (v <= 0) AS not_positive,
 count(*) FILTER (gap > 1) AS gaps FROM l GROUP BY 1)"""


@query("WIN22_series_validation", FAULTY + """ SELECT *, CASE WHEN duplicates > 0 THEN 'duplicate timestamps' WHEN invalid > 0 THEN 'invalid values'
 WHEN not_positive > 0 THEN 'prices must be positive' WHEN gaps > 0 THEN 'missing rows' END AS violation FROM a""")
def series_validation(spark, sf):
    b = A.bars_daily(spark, sf)
    d, s = F.dayofmonth("trade_date"), F.col("symbol")
    close = F.when((s == "S2") & (d == 5), F.lit(0).cast("decimal(24,8)")).when((s == "S3") & (d == 6), F.lit(None)).otherwise(F.col("close"))
    faulty = b.select("symbol", F.col("trade_date").cast("timestamp_ntz").alias("ts"), close.alias("close"))
    again = b.filter((s == "S1") & (d == 7)).select("symbol", F.col("trade_date").cast("timestamp_ntz").alias("ts"), "close")
    return R.validate(faulty.unionByName(again), ["symbol"], "ts", "close", DAY_S, exact=False)


@query("WIN22_minute_validation", f"""{DENSE}, l AS (SELECT symbol, source, bucket - lag(bucket) OVER (PARTITION BY symbol, source ORDER BY bucket) AS gap FROM minutes)
SELECT symbol, source, count(*) AS rows, count(*) FILTER (gap <> INTERVAL '1 minute') AS gaps,
 CASE WHEN count(*) FILTER (gap <> INTERVAL '1 minute') > 0 THEN 'missing rows' END AS violation FROM l GROUP BY 1, 2""")
def minute_validation(spark, sf):
    m = C.minute_ohlcv(A.ticks(spark, sf, dense=True))
    return R.validate(m, ["symbol", "source"], "bucket", "close", 60, exact=True).select("symbol", "source", "rows", "gaps", "violation")
