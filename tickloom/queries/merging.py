"""DUP, MERGE, SNK, SET."""
from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import candles as C, dedup as U, history as H, merge as M
from tickloom.session import work_path
from tickloom.sources import adapters as A, sinks as S
from .normalizing import ERR_CODE, P
from .registry import query
from .shapes import D, TS, stored_candles

REDELIVERED = f"""WITH {A.SQL_TICKS}, again AS (SELECT *, event_id AS id FROM ticks
 UNION ALL SELECT *, event_id + 1000000000 FROM ticks WHERE event_id % 10 = 0)"""


def redelivered(spark, sf):
    """Ticks with every tenth delivered twice."""
    t = A.ticks(spark, sf)
    twice = t.filter(F.col("event_id") % 10 == 0).withColumn("id", F.col("event_id") + 1_000_000_000)
    return t.withColumn("id", F.col("event_id")).unionByName(twice)


@query("DUP1_lowest_id", REDELIVERED + """ SELECT source, trade_id, ts, min(id) AS id, CAST(arg_min(price, id) AS DOUBLE) AS price
FROM again GROUP BY 1, 2, 3""")
def lowest_id(spark, sf):
    return U.lowest_id_per_trade(redelivered(spark, sf), with_symbol=False).select("source", "trade_id", "ts", "id", "price")


@query("DUP2_lowest_id_per_symbol", REDELIVERED + """ SELECT symbol, source, trade_id, ts, min(id) AS id,
 CAST(arg_min(price, id) AS DOUBLE) AS price FROM again GROUP BY 1, 2, 3, 4""")
def lowest_id_symbol(spark, sf):
    return U.lowest_id_per_trade(redelivered(spark, sf)).select("symbol", "source", "trade_id", "ts", "id", "price")


OFFICIAL = f"""WITH {A.SQL_DENSE}, {A.SQL_MINUTES}, {A.SQL_STORED}, official AS (
 SELECT symbol, source, bucket, open, high + 1 AS high, low, close + 1 AS close, volume, volume * 2 AS quote_volume, trade_count
 FROM minutes WHERE minute(bucket) % 2 = 0
 UNION ALL SELECT symbol, source, bucket, open, high + 5, low, close + 5, volume, NULL, NULL FROM minutes WHERE minute(bucket) % 4 = 0),
one AS (SELECT * FROM official QUALIFY row_number() OVER (PARTITION BY symbol, source, bucket ORDER BY trade_count DESC NULLS LAST) = 1)"""
# A stored live candle knows no trade count.
STORED_FIX = "SELECT * REPLACE (CASE WHEN origin = 'EXCHANGE' THEN trade_count END AS trade_count) FROM stored"
NUMS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("open", "high", "low", "close", "volume"))


def minutes(spark, sf):
    return C.minute_ohlcv(A.ticks(spark, sf, dense=True))


def official_minutes(m):
    add = lambda c, k: (F.col(c) + k).cast("decimal(24,8)").alias(c)
    first = m.filter(F.minute("bucket") % 2 == 0).select(
        "symbol", "source", "bucket", "open", add("high", 1), "low", add("close", 1), "volume",
        (F.col("volume") * 2).cast("decimal(32,8)").alias("quote_volume"), "trade_count")
    second = m.filter(F.minute("bucket") % 4 == 0).select(
        "symbol", "source", "bucket", "open", add("high", 5), "low", add("close", 5), "volume",
        F.lit(None).cast("decimal(32,8)").alias("quote_volume"), F.lit(None).cast("long").alias("trade_count"))
    return first.unionByName(second)


@query("DUP4_fullest_minute", OFFICIAL + f" SELECT symbol, source, bucket, {NUMS}, trade_count FROM one")
def fullest_minute(spark, sf):
    return U.fullest_minute(official_minutes(minutes(spark, sf))).drop("quote_volume")


RECOMPUTED = f"""WITH {A.SQL_BARS}, versions AS (
 SELECT symbol, trade_date, source, close, TIMESTAMP '2024-01-01' AS computed_at FROM bars
 UNION ALL SELECT symbol, trade_date, 'BINANCE', close + 1, TIMESTAMP '2024-01-02' FROM bars WHERE day(trade_date) % 2 = 0
 UNION ALL SELECT symbol, trade_date, 'ALPACA', close + 2, TIMESTAMP '2024-01-03' FROM bars WHERE day(trade_date) % 3 = 0)"""


def versions(spark, sf):
    b = A.bars_daily(spark, sf)
    d = F.dayofmonth("trade_date")
    pick = lambda df, src, add, at: df.select("symbol", "trade_date", F.lit(src).alias("source"),
                                              (F.col("close") + add).cast("decimal(24,8)").alias("close"), TS(at).alias("computed_at"))
    return (pick(b, "BINANCE", 0, "2024-01-01 00:00:00")
            .unionByName(pick(b.filter(d % 2 == 0), "BINANCE", 1, "2024-01-02 00:00:00"))
            .unionByName(pick(b.filter(d % 3 == 0), "ALPACA", 2, "2024-01-03 00:00:00")))


@query("DUP5_latest_computed", RECOMPUTED + """ SELECT symbol, source, trade_date, CAST(arg_max(close, computed_at) AS DOUBLE) AS close,
 max(computed_at) AS computed_at FROM versions GROUP BY 1, 2, 3""")
def latest_computed(spark, sf):
    return U.latest_computed(versions(spark, sf))


@query("DUP6_first_source", RECOMPUTED + """, v AS (SELECT symbol, trade_date, source, arg_max(close, computed_at) AS close FROM versions GROUP BY 1, 2, 3)
SELECT symbol, trade_date, min(source) AS source, CAST(arg_min(close, source) AS DOUBLE) AS close FROM v GROUP BY 1, 2""")
def first_source(spark, sf):
    return U.first_source(U.latest_computed(versions(spark, sf)).drop("computed_at"))


@query("DUP7_last_loaded", RECOMPUTED + """ SELECT symbol, trade_date, CAST(arg_max(close, computed_at) AS DOUBLE) AS close FROM versions GROUP BY 1, 2""")
def last_loaded(spark, sf):
    return U.last_loaded(versions(spark, sf), ["symbol", "trade_date"], "close", "computed_at")


@query("MERGE1_live", OFFICIAL + f""", s AS ({STORED_FIX})
SELECT coalesce(s.symbol, m.symbol) AS symbol, coalesce(s.source, m.source) AS source, coalesce(s.bucket, m.bucket) AS bucket,
 CAST(coalesce(s.open, m.open) AS DOUBLE) AS open, CAST(CASE WHEN s.origin = 'EXCHANGE' THEN s.high ELSE m.high END AS DOUBLE) AS high,
 CAST(coalesce(s.low, m.low) AS DOUBLE) AS low, CAST(CASE WHEN s.origin = 'EXCHANGE' THEN s.close ELSE m.close END AS DOUBLE) AS close,
 CAST(coalesce(s.volume, m.volume) AS DOUBLE) AS volume, s.trade_count, coalesce(s.origin, 'LIVE') AS origin,
 s.symbol IS NULL OR (s.origin = 'LIVE' AND s.close <> m.close) AS changed
FROM s FULL JOIN minutes m ON s.symbol = m.symbol AND s.source = m.source AND s.bucket = m.bucket""")
def merge_live(spark, sf):
    m = minutes(spark, sf)
    return M.merge_live(stored_candles(m), m.drop("trade_count")).drop("quote_volume")


MERGE2_SQL = OFFICIAL + f""", s AS ({STORED_FIX}),
j AS (SELECT coalesce(s.symbol, n.symbol) AS symbol, coalesce(s.source, n.source) AS source, coalesce(s.bucket, n.bucket) AS bucket, s.*EXCLUDE (symbol, source, bucket),
 n.symbol IS NOT NULL AND (s.symbol IS NULL OR s.origin = 'LIVE' OR (s.open, s.high, s.low, s.close, s.volume, s.trade_count) IS DISTINCT FROM (n.open, n.high, n.low, n.close, n.volume, n.trade_count)) AS changed,
 n.open AS n_open, n.high AS n_high, n.low AS n_low, n.close AS n_close, n.volume AS n_volume, n.quote_volume AS n_quote_volume, n.trade_count AS n_trade_count
 FROM s FULL JOIN one n ON s.symbol = n.symbol AND s.source = n.source AND s.bucket = n.bucket),
r AS (SELECT symbol, source, bucket,
 {", ".join(f"CAST(CASE WHEN changed THEN n_{c} ELSE {c} END AS DOUBLE) AS {c}" for c in ("open", "high", "low", "close", "volume", "quote_volume"))},
 CASE WHEN changed THEN n_trade_count ELSE trade_count END AS trade_count, CASE WHEN changed THEN 'EXCHANGE' ELSE origin END AS origin, changed FROM j)"""


@query("MERGE2_exchange", MERGE2_SQL + " SELECT * FROM r")
def merge_exchange(spark, sf):
    m = minutes(spark, sf)
    return M.merge_exchange(stored_candles(m), official_minutes(m))


DAILY_STORED = """SELECT symbol, trade_date, source, market_type, open, high, low, close, volume, tick_count,
 CASE WHEN day(trade_date) % 5 = 0 THEN 'EXCHANGE' END AS origin FROM bars WHERE day(trade_date) % 4 <> 0"""


def daily_stored(bars):
    d = F.dayofmonth("trade_date")
    return bars.filter(d % 4 != 0).select("symbol", "trade_date", "source", "market_type", "open", "high", "low", "close",
                                          F.col("volume").cast("decimal(32,8)").alias("volume"), "tick_count",
                                          F.when(d % 5 == 0, "EXCHANGE").alias("origin"))


def official_daily(bars):
    return bars.filter(F.dayofmonth("trade_date") % 2 == 0).select(
        "symbol", "source", F.col("trade_date").cast("timestamp_ntz").alias("bucket"), "open", "high", "low",
        (F.col("close") + 1).cast("decimal(24,8)").alias("close"), F.col("volume").cast("decimal(32,8)").alias("volume"),
        F.col("tick_count").alias("trade_count"))


DAILY_J = f"""WITH {A.SQL_BARS}, s AS ({DAILY_STORED})"""
DAILY_OUT = "CAST(b.open AS DOUBLE) AS open, CAST(b.high AS DOUBLE) AS high, CAST(b.low AS DOUBLE) AS low, " \
            "CAST(b.volume AS DOUBLE) AS volume, b.tick_count"


MERGE3_SQL = DAILY_J + f""" SELECT b.symbol, b.trade_date, b.source, b.market_type, {DAILY_OUT},
 CAST(CASE WHEN day(b.trade_date) % 2 = 0 THEN b.close + 1 ELSE b.close END AS DOUBLE) AS close,
 CASE WHEN day(b.trade_date) % 2 = 0 THEN 'EXCHANGE' ELSE s.origin END AS origin, day(b.trade_date) % 2 = 0 AS changed
FROM bars b LEFT JOIN s USING (symbol, trade_date, source)"""


@query("MERGE3_daily_exchange", MERGE3_SQL)
def merge_daily(spark, sf):
    b = A.bars_daily(spark, sf)
    return M.merge_daily_exchange(daily_stored(b), official_daily(b), "CRYPTO")


@query("MERGE3_computed_at", DAILY_J + """ SELECT b.symbol, b.trade_date, b.source,
 CASE WHEN day(b.trade_date) % 2 = 0 THEN TIMESTAMP '2024-03-01' WHEN s.origin = 'EXCHANGE' THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS computed_at
FROM bars b LEFT JOIN s USING (symbol, trade_date, source)""")
def merge_computed_at(spark, sf):
    """Stored days, a roll-up over them, then official days: the time of the last write of each row, one row per day by DUP5."""
    b = A.bars_daily(spark, sf)
    stored = daily_stored(b).withColumn("computed_at", TS("2024-01-01 00:00:00"))
    roll = b.withColumn("close", (F.col("close") + 3).cast("decimal(24,8)"))
    second = M.merge_daily_rollup(stored, roll, TS("2024-02-01 00:00:00"), only_changes=True).drop("changed")
    third = M.merge_daily_exchange(second, official_daily(b), "CRYPTO", TS("2024-03-01 00:00:00")).drop("changed")
    return U.latest_computed(third).select("symbol", "trade_date", "source", "computed_at")


# -- sinks: every one writes a table in the shared folder and reads it back -----------------------

def with_day(df, ts="ts"):
    return df.withColumn("day", F.col(ts).cast("date"))


@query("SNK1_bulk_insert", f"WITH {A.SQL_TICKS} SELECT event_id, symbol, source, trade_id, ts, CAST(price AS DOUBLE) AS price FROM ticks")
def bulk_insert(spark, sf):
    """Two overlapping deliveries into one table; the second inserts only what is new."""
    path = work_path(spark, "ticks")
    t = with_day(A.ticks(spark, sf))
    key = ["symbol", "source", "trade_id", "ts"]
    S.append_new(spark, t.filter(F.col("ts") < TS("2024-01-20 00:00:00")), path, key, "day")
    S.append_new(spark, t.unionByName(t.filter(F.col("event_id") % 10 == 0)), path, key, "day")
    return spark.read.parquet(path).select("event_id", "symbol", "source", "trade_id", "ts", "price")


@query("SNK2_daily_rollup_upsert", DAILY_J + f""" SELECT b.symbol, b.trade_date, b.source, b.market_type, {DAILY_OUT},
 CAST(CASE WHEN s.origin = 'EXCHANGE' THEN b.close ELSE b.close + 3 END AS DOUBLE) AS close, s.origin
FROM bars b LEFT JOIN s USING (symbol, trade_date, source)""")
def daily_rollup(spark, sf):
    """Rolled-up daily candles replace everything but official rows."""
    path = work_path(spark, "daily")
    b = A.bars_daily(spark, sf)
    year = lambda df: df.withColumn("year", F.year("trade_date"))
    S.write_table(year(daily_stored(b)), path, "year")
    roll = year(b.withColumn("close", (F.col("close") + 3).cast("decimal(24,8)")))
    S.merge_into(spark, path, roll, "year", lambda s, n: M.merge_daily_rollup(s, n))
    return spark.read.parquet(path).drop("year")


@query("SNK3_stage_and_merge", MERGE2_SQL + """ SELECT symbol, source, bucket, open, high, low, close, volume, quote_volume, trade_count, origin,
 (SELECT count(*) FROM r WHERE changed) AS changed_rows FROM r""")
def stage_and_merge(spark, sf):
    """Official minutes staged, merged and written over the touched days; also the changed row count."""
    path = work_path(spark, "candles")
    m = minutes(spark, sf)
    S.write_table(with_day(stored_candles(m), "bucket"), path, "day", ["symbol", "source", "bucket"])
    staged = S.merge_into(spark, path, with_day(official_minutes(m), "bucket"), "day", lambda s, n: M.merge_exchange(s, n))
    return spark.read.parquet(path).drop("day").withColumn("changed_rows", S.changed_count(staged).scalar())


@query("SNK4_indicator_upsert", f"""WITH {A.SQL_BARS} SELECT symbol, trade_date,
 CAST(CASE WHEN year(trade_date) >= 1998 THEN close * 2 ELSE close END AS DOUBLE) AS ma5 FROM bars""")
def indicator_upsert(spark, sf):
    path = work_path(spark, "indicators")
    rows = A.bars_daily(spark, sf).select("symbol", "trade_date", F.col("close").alias("ma5"), F.year("trade_date").alias("year"))
    S.write_table(rows.filter(F.col("year") < 2000), path, "year")
    newer = rows.filter(F.col("year") >= 1998).withColumn("ma5", (F.col("ma5") * 2).cast("decimal(24,8)"))
    S.merge_into(spark, path, newer, "year", lambda s, n: M.merge_newest(s, n, ["symbol", "trade_date"]))
    return spark.read.parquet(path).drop("year")


@query("SNK5_exchange_daily_upsert", MERGE3_SQL)
def exchange_daily(spark, sf):
    path = work_path(spark, "daily")
    b = A.bars_daily(spark, sf)
    year = lambda df, c: df.withColumn("year", F.year(c))
    S.write_table(year(daily_stored(b), "trade_date"), path, "year")
    staged = S.merge_into(spark, path, year(official_daily(b), "bucket"), "year",
                          lambda s, n: M.merge_daily_exchange(s.drop("year"), n, "CRYPTO").withColumn("year", F.year("trade_date")))
    flags = staged.select("symbol", "trade_date", "source", "changed")
    now = spark.read.parquet(path).drop("year")
    untouched = now.join(flags, ["symbol", "trade_date", "source"], "left")
    return untouched.withColumn("changed", F.coalesce("changed", F.lit(False)))


@query("SNK6_insert_missing_days", f"""{DAILY_J} SELECT b.symbol, count(*) AS fetched, count(s.symbol) AS existing,
 count(*) - count(s.symbol) AS missing, min(b.trade_date) FILTER (s.symbol IS NULL) AS first_missing,
 max(b.trade_date) FILTER (s.symbol IS NULL) AS last_missing FROM bars b LEFT JOIN s USING (symbol, trade_date, source) GROUP BY 1""")
def insert_missing_days(spark, sf):
    """Dry run: the counts of what an insert of the missing days would do."""
    b = A.bars_daily(spark, sf)
    stored = daily_stored(b).select("symbol", "trade_date", "source", F.lit(True).alias("has"))
    j = b.join(stored, ["symbol", "trade_date", "source"], "left")
    gone = F.col("has").isNull()
    return j.groupBy("symbol").agg(
        F.count("*").alias("fetched"), F.count("has").alias("existing"), F.count_if(gone).alias("missing"),
        F.min(F.when(gone, F.col("trade_date"))).alias("first_missing"), F.max(F.when(gone, F.col("trade_date"))).alias("last_missing"))


FAILED = f"""WITH e AS (SELECT event_id AS offset_no, user_id % 12 AS part, {ERR_CODE} AS code, event_id % 5 AS retry_count, upper(event_type) AS symbol FROM events)"""


def failed_records(spark, sf):
    e = F.col("event_id")
    ev = A.table(spark, sf, "events").select(
        (F.col("user_id") % 12).cast("int").alias("partition"), e.alias("offset"), F.upper("event_type").alias("symbol"),
        F.to_json(F.struct(e.alias("a"))).alias("value"), F.expr(ERR_CODE).alias("code"), (e % 5).cast("int").alias("retry_count"))
    return ev.withColumn("error_message", F.concat(F.lit("failed "), "code")).withColumn("error_type", P.error_class("code", "error_message"))


@query("SNK7_dead_letters", FAILED + """ SELECT 'ticks' AS original_topic, CAST(part AS BIGINT) AS original_partition, offset_no AS original_offset,
 '{"a":' || CAST(offset_no AS VARCHAR) || '}' AS original_message, CAST(retry_count AS BIGINT) AS retry_count, 'storage' AS consumer_group,
 CAST(row_number() OVER (PARTITION BY part, offset_no // 500 ORDER BY offset_no) - 1 AS VARCHAR) AS batch_index,
 CAST(count(*) OVER (PARTITION BY part, offset_no // 500) AS VARCHAR) AS batch_size, TIMESTAMP '2024-02-01' AS failed_at FROM e""")
def dead_letters(spark, sf):
    path = work_path(spark, "dlq")
    S.write_table(S.dead_letters(failed_records(spark, sf), "ticks", "storage", TS("2024-02-01 00:00:00")), path)
    return spark.read.parquet(path).select(
        "original_topic", "original_partition", "original_offset", "original_message", "retry_count", "consumer_group",
        F.col("metadata")["batchIndex"].alias("batch_index"), F.col("metadata")["batchSize"].alias("batch_size"), "failed_at")


@query("SNK8_retries", FAILED + """ SELECT symbol AS key, CAST(retry_count + 1 AS VARCHAR) AS retry_count, 'ticks' AS original_topic,
 CAST(epoch_ms(TIMESTAMP '2024-02-01') AS VARCHAR) AS retry_timestamp, coalesce('failed ' || code, '') AS error_message FROM e""")
def retries(spark, sf):
    path = work_path(spark, "retry")
    S.write_table(S.retries(failed_records(spark, sf), "ticks", TS("2024-02-01 00:00:00")), path)
    h = F.col("headers")
    return spark.read.parquet(path).select("key", h["retry-count"].alias("retry_count"), h["original-topic"].alias("original_topic"),
                                           h["retry-timestamp"].alias("retry_timestamp"), h["error-message"].alias("error_message"))


# -- prediction history --------------------------------------------------------------------------

def responses(bars):
    """A forecast response per bar: two models, one nameless model, a bad and a repeated point."""
    iso = lambda days: F.concat(F.date_format(F.date_add("trade_date", days), "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    y = F.col("close").cast("double")
    point = lambda ts, v: F.struct(ts.alias("ts"), v.alias("yhat"), (v - 10).alias("yhat_lower"), (v + 10).alias("yhat_upper"))
    model = lambda name, add: F.struct(
        F.lit(name).alias("model"), F.lit("2024-01-01T00:00:00Z").alias("trained_at"),
        F.struct(F.lit(add + 1.5).alias("mae"), F.lit(add + 2.5).alias("rmse")).alias("metrics"),
        F.array(point(iso(1), y + add), point(iso(2), y + add + 1), point(F.lit("soon"), y), point(iso(1), y + 99)).alias("forecast"))
    body = F.struct(
        F.when(F.dayofmonth("trade_date") == 31, "unknown").otherwise(iso(0)).alias("last_ts"), y.alias("last_value"),
        F.array(model("ARIMA", 1), model(" Log-return ARIMA ", 2), model("", 3)).alias("models"))
    return bars.select(F.lower("symbol").alias("symbol"), F.lit("1d").alias("interval"), F.lit(2).alias("horizon"),
                       F.concat(F.lit(" "), "source").alias("source"), F.lit(7).alias("latency_ms"), F.to_json(body).alias("value"))


RUNS = f"""WITH {A.SQL_BARS}, runs AS (SELECT symbol, '1d' AS interval, CAST(2 AS BIGINT) AS horizon, source, CAST(trade_date AS TIMESTAMP) AS base_ts,
  CAST(close AS DOUBLE) AS base_value, CAST(7 AS BIGINT) AS latency_ms FROM bars WHERE day(trade_date) <> 31),
pts AS (SELECT symbol, base_ts, model, base_ts + to_days(CAST(k AS INT)) AS ts, base_value + a + k - 1 AS yhat, base_value + a + k - 11 AS yhat_lower,
  base_value + a + k + 9 AS yhat_upper, a + 1.5 AS mae FROM runs, (VALUES ('ARIMA', 1), ('Log-return ARIMA', 2)) m(model, a), (VALUES (1), (2)) s(k))"""


@query("SNK10_prediction_runs", RUNS + " SELECT * FROM runs")
def prediction_runs(spark, sf):
    """Runs stored in two deliveries; a run key that exists is skipped."""
    path = work_path(spark, "runs")
    parsed = H.parse_responses(responses(A.bars_daily(spark, sf)))
    runs = H.runs_of(parsed)
    S.write_table(runs.filter(F.col("base_ts") < TS("1998-01-01 00:00:00")), path)
    H.new_runs(spark.read.parquet(path), runs).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("SNK10_prediction_points", RUNS + """ SELECT symbol, base_ts, model, ts, CAST(yhat AS DOUBLE) AS yhat, CAST(yhat_lower AS DOUBLE) AS yhat_lower,
 CAST(yhat_upper AS DOUBLE) AS yhat_upper, CAST(mae AS DOUBLE) AS mae, TIMESTAMP '2024-01-01' AS trained_at FROM pts""")
def prediction_points(spark, sf):
    points = H.points_of(H.parse_responses(responses(A.bars_daily(spark, sf))))
    return points.select("symbol", "base_ts", "model", "ts", "yhat", "yhat_lower", "yhat_upper", "mae", "trained_at")


@query("JON12_nested_history", RUNS + """ SELECT r.symbol, r.base_ts, r.base_value, count(DISTINCT model) AS models, count(*) AS points,
 min(model) AS first_model, CAST(sum(CAST(yhat AS DECIMAL(24,4))) AS DOUBLE) AS yhat_sum FROM runs r JOIN pts p USING (symbol, base_ts) GROUP BY 1, 2, 3""")
def nested_history(spark, sf):
    parsed = H.parse_responses(responses(A.bars_daily(spark, sf)))
    n = H.nested(H.runs_of(parsed), H.points_of(parsed))
    flat = F.flatten(F.transform("models", lambda m: m["points"]))
    return n.select("symbol", "base_ts", "base_value", F.size("models").cast("long").alias("models"), F.size(flat).cast("long").alias("points"),
                    F.element_at("models", 1)["model"].alias("first_model"),
                    F.aggregate(flat, F.lit(0).cast("decimal(24,4)"), lambda a, p: (a + p["yhat"].cast("decimal(24,4)")).cast("decimal(24,4)")).alias("yhat_sum"))


@query("TOP5_recent_runs", RUNS + " SELECT * FROM runs ORDER BY base_ts DESC, symbol DESC LIMIT 20")
def recent_runs(spark, sf):
    return H.recent_runs(H.runs_of(H.parse_responses(responses(A.bars_daily(spark, sf)))), 20)


# -- set operations ------------------------------------------------------------------------------

TRADED = "SELECT DISTINCT 'S' || CAST(s_suppkey % 10 AS VARCHAR) AS symbol FROM supplier WHERE s_acctbal > 0 AND s_nationkey < 12"


def traded_symbols(spark, sf):
    sup = A.table(spark, sf, "supplier").filter((F.col("s_acctbal") > 0) & (F.col("s_nationkey") < 12))
    return sup.select(F.concat(F.lit("S"), (F.col("s_suppkey") % 10).cast("string")).alias("symbol")).distinct()


DAY = "1998-03-02"


@query("SET2_day_symbols_traded", f"WITH {A.SQL_BARS} SELECT symbol FROM bars WHERE trade_date = DATE '{DAY}' INTERSECT {TRADED}")
def day_symbols_traded(spark, sf):
    b = A.bars_daily(spark, sf).filter(F.col("trade_date") == D(DAY))
    return b.select("symbol").intersect(traded_symbols(spark, sf))


@query("SET3_archive_minus_traded", f"WITH {A.SQL_BARS} SELECT DISTINCT symbol FROM bars EXCEPT {TRADED}")
def archive_minus_traded(spark, sf):
    return A.bars_daily(spark, sf).select("symbol").subtract(traded_symbols(spark, sf))


@query("SET4_symbols_on_day", f"WITH {A.SQL_BARS} SELECT DISTINCT symbol FROM bars WHERE trade_date = DATE '{DAY}'")
def symbols_on_day(spark, sf):
    return A.bars_daily(spark, sf).filter(F.col("trade_date") == D(DAY)).select("symbol").distinct()
