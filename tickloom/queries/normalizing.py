"""NRM, SRC3-6, FUN: messages, parsing, predicates. Raw messages are written from the tick table."""
from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import pricing as P, timeparse as TP
from tickloom.operators import candles as C, normalize as N
from tickloom.session import work_path
from tickloom.sources import adapters as A, candle_files as CF, sinks as S
from .registry import query
from .shapes import D, TS

RECEIVED = 1704067200000
MS = "CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT)"
PROCESSING = "2024-03-01 00:00:00"
PROCESSING_MS = 1709251200000


def crypto_messages(ticks):
    """aggTrade JSON; every second one in an envelope, every 50th broken in one of three ways."""
    e = F.col("event_id")
    price = F.when(e % 50 == 1, "0").otherwise(F.col("price").cast("string"))
    body = F.struct(
        F.lit("aggTrade").alias("e"), F.col("symbol").alias("s"), F.when(e % 50 != 0, price).alias("p"),
        F.when(e % 50 == 2, "-1").otherwise(F.col("volume").cast("string")).alias("q"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("T"), e.alias("a"))
    text = F.when(e % 2 == 0, F.to_json(F.struct(body.alias("data")))).otherwise(F.to_json(body))
    return ticks.select(text.alias("value"))


@query("NRM1_crypto_trade", f"""WITH {A.SQL_TICKS}
SELECT 'BINANCE' AS source, symbol, CAST(price AS DOUBLE) AS price, CAST(volume AS DOUBLE) AS volume, trade_id,
 'BINANCE' AS exchange, {MS} AS timestamp, CAST({RECEIVED} AS BIGINT) AS received_at, 'CRYPTO' AS market_type
FROM ticks WHERE event_id % 50 NOT IN (0, 1, 2)""")
def crypto_trade(spark, sf):
    return N.crypto_trades(crypto_messages(A.ticks(spark, sf)), received_at=F.lit(RECEIVED).cast("long"))


def _rfc3339(nanos="123"):
    return F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(nanos + "Z"))


def equity_messages(ticks):
    """Arrays of a trade, a quote and a control item; every 50th message is not JSON at all."""
    e = F.col("event_id")
    trade = F.struct(
        F.lit("t").alias("T"), F.col("symbol").alias("S"),
        F.when(e % 50 == 1, "abc").otherwise(F.col("price").cast("string")).alias("p"),
        F.col("volume").cast("int").cast("string").alias("s"),
        F.when(e % 50 == 2, "yesterday").otherwise(_rfc3339()).alias("t"),
        F.when(e % 5 != 0, F.col("exchange")).alias("x"), F.when(e % 2 == 0, F.col("trade_id")).alias("i"))
    quote = F.struct(
        F.lit("q").alias("T"), F.col("symbol").alias("S"), _rfc3339().alias("t"),
        F.when(e % 50 == 3, "0").otherwise(F.col("price").cast("string")).alias("bp"),
        (F.col("price") + 1).cast("decimal(24,8)").cast("string").alias("ap"),
        F.when(e % 3 == 0, F.col("exchange")).alias("bx"), F.when(e % 3 == 1, F.col("exchange")).alias("ax"))
    items = F.concat_ws(",", F.to_json(trade), F.to_json(quote), F.lit('{"T":"subscription","trades":["A"]}'))
    single = F.to_json(trade)
    text = (F.when(e % 50 == 0, "{not json").when(e % 7 == 0, single)
            .otherwise(F.concat(F.lit("["), items, F.lit("]"))))
    return ticks.select(text.alias("value"))


EQ = f"""WITH {A.SQL_TICKS}, m AS (SELECT *, event_id AS e, {MS} AS ms,
  CASE WHEN event_id % 50 = 2 THEN {PROCESSING_MS} ELSE {MS} END AS tms,
  CASE WHEN event_id % 5 <> 0 THEN exchange ELSE 'UNKNOWN' END AS tx,
  CASE WHEN event_id % 3 <> 2 THEN exchange ELSE 'UNKNOWN' END AS qx FROM ticks WHERE event_id % 50 <> 0)"""
EQ_TRADES = f"""SELECT 'ALPACA' AS source, symbol, CAST(price AS DOUBLE) AS price, CAST(volume AS DOUBLE) AS volume,
 CASE WHEN e % 2 = 0 THEN trade_id ELSE tx || '_' || CAST(tms AS VARCHAR) || '_' || symbol || '_' || CAST(CAST(volume AS INT) AS VARCHAR) END AS trade_id,
 tx AS exchange, CAST(tms AS BIGINT) AS timestamp, CAST({RECEIVED} AS BIGINT) AS received_at, 'STOCK' AS market_type,
 e % 50 = 2 AS ts_fallback FROM m WHERE e % 50 <> 1"""


def _items(spark, sf):
    return N.equity_items(equity_messages(A.ticks(spark, sf)))


@query("NRM2_equity_trade", f"{EQ} {EQ_TRADES}")
def equity_trade(spark, sf):
    return N.equity_trades(_items(spark, sf), F.lit(RECEIVED).cast("long"), TS(PROCESSING))


@query("NRM3_equity_quote", f"""{EQ}
SELECT 'ALPACA' AS source, symbol, CAST(price AS DOUBLE) + 0.5 AS price, CAST(0 AS DOUBLE) AS volume,
 qx || '_QUOTE_' || CAST(ms AS VARCHAR) || '_' || symbol AS trade_id, qx AS exchange, ms AS timestamp,
 CAST({RECEIVED} AS BIGINT) AS received_at, 'STOCK' AS market_type, false AS ts_fallback
FROM m WHERE e % 7 <> 0 AND e % 50 <> 3""")
def equity_quote(spark, sf):
    return N.equity_quotes(_items(spark, sf), F.lit(RECEIVED).cast("long"), TS(PROCESSING))


@query("NRM4_message_routing", f"""{EQ}
SELECT 't' AS kind, count(*) AS items, count(*) FILTER (e % 50 <> 1) AS ticks FROM m
UNION ALL SELECT 'q', count(*), 0 FROM m WHERE e % 7 <> 0
UNION ALL SELECT 'subscription', count(*), 0 FROM m WHERE e % 7 <> 0""")
def message_routing(spark, sf):
    """Items per kind and the ticks they give: only trades are kept, one bad item drops no other."""
    items = _items(spark, sf)
    kinds = items.groupBy(F.col("m")["T"].alias("kind")).agg(F.count("*").alias("items"))
    kept = N.equity_trades(items, F.lit(0).cast("long"), TS(PROCESSING)).agg(F.count("*").alias("n")).scalar()
    return kinds.select("kind", "items", F.when(F.col("kind") == "t", kept).otherwise(0).cast("long").alias("ticks"))


@query("NRM5_rfc3339_millis", f"""WITH {A.SQL_TICKS}
SELECT event_id, CASE WHEN event_id % 50 = 49 THEN {PROCESSING_MS}
  WHEN event_id % 4 = 0 THEN CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) * 1000 ELSE {MS} END AS ts_ms,
 event_id % 50 = 49 AS ts_fallback FROM ticks""")
def rfc3339(spark, sf):
    """Fractions of 0, 3, 6 and 9 digits, with Z or an offset; unreadable text takes the processing time."""
    fmt = lambda p: F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss" + p)
    k = F.col("event_id") % 4
    text = (F.when(F.col("event_id") % 50 == 49, "n/a").when(k == 0, F.concat(fmt(""), F.lit("Z")))
            .when(k == 1, F.concat(fmt(".SSS"), F.lit("+00:00"))).when(k == 2, F.concat(fmt(".SSSSSS"), F.lit("Z")))
            .otherwise(F.concat(fmt(".SSSSSS"), F.lit("789Z"))))
    millis, fell_back = TP.rfc3339_millis(F.col("text"), TS(PROCESSING))
    return A.ticks(spark, sf).withColumn("text", text).select("event_id", millis.alias("ts_ms"), fell_back.alias("ts_fallback"))


@query("NRM6_archive_epoch", f"""WITH {A.SQL_TICKS}
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN make_timestamp({MS} * 1000) ELSE ts END AS ts FROM ticks""")
def archive_epoch(spark, sf):
    raw = F.when(F.col("event_id") % 2 == 0, F.unix_millis(F.col("ts").cast("timestamp"))).otherwise(TP.micros("ts"))
    return A.ticks(spark, sf).select("event_id", TP.archive_time(raw).alias("ts"))


@query("NRM7_epoch_to_millis", f"""WITH {A.SQL_TICKS} SELECT event_id, {MS} AS ts_ms FROM ticks""")
def epoch_to_millis(spark, sf):
    us, k = TP.micros("ts"), F.col("event_id") % 3
    raw = F.when(k == 0, us * 1000).when(k == 1, us).otherwise(F.unix_millis(F.col("ts").cast("timestamp")))
    return A.ticks(spark, sf).select("event_id", TP.epoch_to_millis(raw).alias("ts_ms"))


@query("NRM8_price_check", f"""WITH {A.SQL_TICKS}
SELECT symbol, count(*) FILTER (event_id % 40 > 1) AS valid, count(*) FILTER (event_id % 40 <= 1) AS rejected
FROM ticks GROUP BY symbol""")
def price_check(spark, sf):
    e = F.col("event_id") % 40
    price = F.when(e == 0, F.lit(None)).when(e == 1, F.lit(0)).otherwise(F.col("price"))
    t = A.ticks(spark, sf).withColumn("ok", P.valid_price(price))
    return t.groupBy("symbol").agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("rejected"))


def event_rows(ticks):
    """Topic JSON from ticks; some rows lack a field, have no price or are not JSON."""
    e = F.col("event_id")
    t = ticks.withColumns({
        "timestamp": F.unix_millis(F.col("ts").cast("timestamp")), "received_at": F.lit(RECEIVED).cast("long"),
        "exchange": F.when(e % 30 != 0, F.col("exchange")), "price": F.when(e % 30 == 1, F.lit(0).cast("decimal(24,8)")).otherwise(F.col("price"))})
    return t.select("event_id", F.when(e % 30 == 2, "oops").otherwise(N.event_json()).alias("value"))


@query("NRM9_field_contract", f"""WITH {A.SQL_TICKS}, f AS (
 SELECT unnest(['source','symbol','price','volume','trade_id','exchange','timestamp','received_at','market_type','price<=0']) AS rule)
SELECT rule, count(*) AS violations FROM f, ticks
WHERE (event_id % 30 = 0 AND rule = 'exchange') OR (event_id % 30 = 1 AND rule = 'price<=0')
 OR (event_id % 30 = 2 AND rule <> 'price<=0') GROUP BY rule""")
def field_contract(spark, sf):
    parsed = N.parse_events(event_rows(A.ticks(spark, sf)))
    return parsed.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("violations"))


@query("NRM10_clean_symbols", """SELECT upper(trim(c_mktsegment)) AS symbol, min(c_custkey) AS first_pos FROM customer
WHERE c_custkey % 9 <> 0 GROUP BY 1""")
def clean_symbols(spark, sf):
    k = F.col("c_custkey")
    raw = (F.when(k % 9 == 0, "   ").when(k % 2 == 0, F.lower("c_mktsegment"))
           .otherwise(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))))
    return N.clean_symbols(A.table(spark, sf, "customer").select(raw.alias("symbol"), k.alias("pos")))


BASES = ["BTC", "ETHUP", "BULL", "USDC", "JUP", "WBTC", "EUR", "ADA", "1INCHDOWN", "PUP", "XRPBEAR", ""]


@query("NRM11_coin_pairs", f"""WITH s AS (
 SELECT list_extract({BASES!r}, CAST(c_custkey % 12 + 1 AS INT)) || CASE WHEN c_nationkey % 4 = 0 THEN 'USD' ELSE 'USDT' END AS symbol
 FROM customer)
SELECT symbol, count(*) AS n FROM s WHERE symbol IN ('BTCUSDT', 'JUPUSDT', 'ADAUSDT', 'PUPUSDT') GROUP BY symbol""")
def coin_pairs(spark, sf):
    base = F.element_at(F.array(*[F.lit(b) for b in BASES]), (F.col("c_custkey") % 12 + 1).cast("int"))
    sym = F.concat(base, F.when(F.col("c_nationkey") % 4 == 0, "USD").otherwise("USDT"))
    pairs = A.table(spark, sf, "customer").select(sym.alias("symbol"))
    return pairs.filter(P.is_coin_pair("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


def broken_bars(bars):
    """Daily bars with a few defects, chosen by the day of the month."""
    d = F.dayofmonth("trade_date")
    return bars.withColumns({
        "trade_count": F.when(d == 3, -1).otherwise(F.col("tick_count")),
        "high": F.when(d == 13, (F.least("open", "close") / 2).cast("decimal(24,8)")).otherwise(F.col("high")),
        "low": F.when(d == 17, (F.greatest("open", "close") * 2).cast("decimal(24,8)")).otherwise(F.col("low")),
        "open": F.when(d == 23, F.lit(0).cast("decimal(24,8)")).otherwise(F.col("open"))})


BROKEN = f"""WITH {A.SQL_BARS}, broken AS (SELECT symbol, trade_date, source, market_type,
 CASE WHEN day(trade_date) = 23 THEN 0 ELSE open END AS open,
 CASE WHEN day(trade_date) = 13 THEN CAST(least(open, close) AS DOUBLE) / 2 ELSE CAST(high AS DOUBLE) END AS high,
 CASE WHEN day(trade_date) = 17 THEN CAST(greatest(open, close) AS DOUBLE) * 2 ELSE CAST(low AS DOUBLE) END AS low,
 close, volume, CASE WHEN day(trade_date) = 3 THEN -1 ELSE tick_count END AS trade_count FROM bars)"""


@query("NRM12_valid_klines", BROKEN + """
SELECT symbol, count(*) AS kept FROM broken WHERE day(trade_date) NOT IN (3, 13, 17, 23) GROUP BY symbol""")
def valid_klines(spark, sf):
    b = broken_bars(A.bars_daily(spark, sf))
    return b.filter(P.valid_kline()).groupBy("symbol").agg(F.count("*").alias("kept"))


@query("NRM13_sane_candles", BROKEN + """
SELECT symbol, trade_date, trade_count FROM broken
WHERE high >= greatest(open, close) AND low <= least(open, close)""")
def sane_candles(spark, sf):
    return broken_bars(A.bars_daily(spark, sf)).filter(P.sane_candle()).select("symbol", "trade_date", "trade_count")


ERR_CODE = """CASE event_type WHEN 'purchase' THEN 'TIMEOUT' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'SQL' ELSE 'CONNECT' END
 WHEN 'signup' THEN 'ILLEGAL_ARGUMENT' WHEN 'click' THEN 'OTHER' ELSE CASE WHEN event_id % 2 = 0 THEN 'DATA_ACCESS' END END"""


@query("NRM14_error_class", f"""WITH e AS (SELECT {ERR_CODE} AS code,
  CASE WHEN event_id % 3 = 0 THEN 'Connection refused by host' WHEN event_id % 3 = 1 THEN 'boom' END AS message FROM events),
k AS (SELECT CASE WHEN code IS NULL AND message IS NULL THEN 'UNKNOWN_ERROR' WHEN code = 'TIMEOUT' THEN 'TIMEOUT_ERROR'
  WHEN code = 'CONNECT' THEN 'STORAGE_CONNECTION_ERROR' WHEN code = 'SQL' THEN 'STORAGE_ERROR'
  WHEN code = 'ILLEGAL_ARGUMENT' THEN 'VALIDATION_ERROR' WHEN message LIKE '%Connection refused%' THEN 'STORAGE_CONNECTION_ERROR'
  WHEN code = 'DATA_ACCESS' THEN 'STORAGE_ERROR' ELSE 'PROCESSING_ERROR' END AS error_type FROM e)
SELECT error_type, error_type IN ('STORAGE_CONNECTION_ERROR', 'STORAGE_ERROR', 'TIMEOUT_ERROR') AS retryable, count(*) AS n
FROM k GROUP BY 1, 2""")
def error_class(spark, sf):
    e = F.col("event_id")
    ev = A.table(spark, sf, "events").select(
        F.expr(ERR_CODE).alias("code"), F.when(e % 3 == 0, "Connection refused by host").when(e % 3 == 1, "boom").alias("message"))
    return (ev.select(P.error_class("code", "message").alias("error_type"))
            .groupBy("error_type", P.is_retryable("error_type").alias("retryable")).agg(F.count("*").alias("n")))


INSTR = f"""WITH {A.SQL_TICKS}, stored AS (
 SELECT symbol, 'CRYPTO' AS market_type, 'OLD' AS exchange, 'Name ' || symbol AS name, symbol <> 'CLICK' AS is_active,
  min(ts) AS first_seen_at, min(ts) AS last_seen_at FROM ticks WHERE symbol IN ('CLICK', 'VIEW') AND ts < TIMESTAMP '2024-01-10' GROUP BY symbol
 UNION ALL SELECT 'DELISTED', 'STOCK', 'IEX', 'Gone', false, TIMESTAMP '2023-01-01', TIMESTAMP '2023-02-01'),
seen AS (SELECT symbol, arg_min(market_type, ts) AS market_type, arg_min(exchange, ts) AS exchange, min(ts) AS f, max(ts) AS l
 FROM ticks WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY symbol),
merged AS (SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(n.market_type, o.market_type) AS market_type,
 coalesce(n.exchange, o.exchange) AS exchange, coalesce(n.symbol, o.name) AS name, coalesce(o.is_active, true) AS is_active,
 coalesce(o.first_seen_at, n.f) AS first_seen_at, coalesce(greatest(o.last_seen_at, n.l), n.l, o.last_seen_at) AS last_seen_at
 FROM stored o FULL JOIN seen n ON o.symbol = n.symbol)"""


def merged_instruments(spark, sf):
    t = A.ticks(spark, sf)
    old = t.filter(F.col("symbol").isin("CLICK", "VIEW") & (F.col("ts") < TS("2024-01-10 00:00:00")))
    stored = old.groupBy("symbol").agg(F.min("ts").alias("first_seen_at"), F.min("ts").alias("last_seen_at")).select(
        "symbol", F.lit("CRYPTO").alias("market_type"), F.lit("OLD").alias("exchange"),
        F.concat(F.lit("Name "), "symbol").alias("name"), (F.col("symbol") != "CLICK").alias("is_active"), "first_seen_at", "last_seen_at")
    gone = spark.range(1).select(
        F.lit("DELISTED").alias("symbol"), F.lit("STOCK").alias("market_type"), F.lit("IEX").alias("exchange"),
        F.lit("Gone").alias("name"), F.lit(False).alias("is_active"), TS("2023-01-01 00:00:00").alias("first_seen_at"),
        TS("2023-02-01 00:00:00").alias("last_seen_at"))
    return N.upsert_instruments(stored.unionByName(gone), N.instruments_of(t.filter(F.col("ts") >= TS("2024-01-10 00:00:00"))))


@query("NRM15_instrument_upsert", INSTR + " SELECT * FROM merged")
def instrument_upsert(spark, sf):
    return merged_instruments(spark, sf)


@query("NRM16_instrument_listing", INSTR + """ SELECT symbol, market_type, CASE WHEN symbol = 'VIEW' THEN 'NEWX' ELSE exchange END AS exchange,
 name, is_active, first_seen_at, last_seen_at FROM merged WHERE is_active AND symbol <> 'ERROR'""")
def instrument_listing(spark, sf):
    edited = N.edit_instrument(merged_instruments(spark, sf), "view", exchange="NEWX")
    return N.list_instruments(N.edit_instrument(edited, "ERROR", active=False))


# -- candle sources ------------------------------------------------------------------------------

def archive_rows(minutes):
    """12-column archive text of minute bars: millis and micros mixed, one header line per symbol."""
    us = TP.micros("bucket")
    micro = F.minute("bucket") % 2 == 1
    unit = lambda x: F.when(micro, x).otherwise(F.floor(x / 1000)).cast("string")
    text = lambda x: F.col(x).cast("string")
    body = minutes.select(
        "symbol", "source", unit(us).alias("open_time"), *[text(x) for x in ("open", "high", "low", "close", "volume")],
        unit(us + 59_999_000).alias("close_time"), text("volume").alias("quote_volume"), text("trade_count"),
        F.lit("0").alias("taker_base"), F.lit("0").alias("taker_quote"), F.lit("0").alias("ignore"))
    names = [c for c in body.columns if c not in ("symbol", "source")]
    header = minutes.select("symbol", "source").distinct().select("symbol", "source", *[F.lit(n).alias(n) for n in names])
    return body.unionByName(header)


ARCHIVE_SQL = f"""WITH {A.SQL_DENSE}, {A.SQL_MINUTES}
SELECT symbol, source, bucket, CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low,
 CAST(close AS DOUBLE) AS close, CAST(volume AS DOUBLE) AS volume, bucket + INTERVAL '59999 milliseconds' AS close_time,
 CAST(volume AS DOUBLE) AS quote_volume, trade_count FROM minutes"""


@query("SRC3_archive_csv", ARCHIVE_SQL)
def archive_csv(spark, sf):
    """Write the archive layout (symbol and source directories of CSV files), then read it back."""
    path = work_path(spark, "archive")
    rows = archive_rows(C.minute_ohlcv(A.ticks(spark, sf, dense=True)))
    rows.write.partitionBy("symbol", "source").csv(path)
    return CF.read_archive_csv(spark, path, "symbol", "source")


@query("SRC3_month_periods", """WITH r AS (SELECT o_orderpriority AS symbol, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)
SELECT symbol, strftime(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)), '%Y-%m') AS period FROM r""")
def month_periods(spark, sf):
    r = A.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("symbol")).agg(
        F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return r.select("symbol", F.explode(CF.month_periods(F.col("a"), F.col("b"))).alias("period"))


@query("SRC4_kline_pages", ARCHIVE_SQL + """ WHERE bucket + INTERVAL '59999 milliseconds' < TIMESTAMP '2024-01-01 05:00:00'
 AND bucket >= TIMESTAMP '2024-01-01 01:00:00' AND bucket < TIMESTAMP '2024-01-01 05:30:00'""")
def kline_pages(spark, sf):
    """One JSON page per symbol, source and hour; only closed candles inside the page count."""
    m = C.minute_ohlcv(A.ticks(spark, sf, dense=True))
    us = TP.micros("bucket")
    text = lambda x: F.col(x).cast("string")
    row = F.array(F.floor(us / 1000).cast("string"), *[text(x) for x in ("open", "high", "low", "close", "volume")],
                  F.floor((us + 59_999_000) / 1000).cast("string"), text("volume"), text("trade_count"))
    pages = m.groupBy("symbol", "source", F.date_trunc("hour", F.col("bucket").cast("timestamp")).alias("h")).agg(
        F.to_json(F.collect_list(row)).alias("payload"))
    return CF.parse_kline_page(pages, "payload", TS("2024-01-01 05:00:00"), TS("2024-01-01 01:00:00"),
                               TS("2024-01-01 05:30:00"), keep=("symbol", "source"))


def _ohlcv_sql(src, ts):
    return f"""SELECT symbol, source, {ts} AS ts, CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high,
 CAST(low AS DOUBLE) AS low, CAST(close AS DOUBLE) AS close, CAST(volume AS DOUBLE) AS volume FROM {src}"""


@query("SRC5_newest_ohlcv", f"WITH {A.SQL_BARS} " + _ohlcv_sql("bars", "trade_date") + """
 QUALIFY row_number() OVER (PARTITION BY symbol, source ORDER BY trade_date DESC) <= 2000""")
def newest_ohlcv(spark, sf):
    return CF.load_ohlcv(A.bars_daily(spark, sf), "trade_date", 2000, "BINANCE")


@query("SRC6_ranged_minutes", f"WITH {A.SQL_DENSE}, {A.SQL_MINUTES} " + _ohlcv_sql("minutes", "bucket") + """
 WHERE bucket >= TIMESTAMP '2024-01-01 01:00:00' AND bucket < TIMESTAMP '2024-01-01 03:00:00' AND source = 'BINANCE'""")
def ranged_minutes(spark, sf):
    return CF.load_range(C.minute_ohlcv(A.ticks(spark, sf, dense=True)), "bucket", TS("2024-01-01 01:00:00"),
                         TS("2024-01-01 03:00:00"), "BINANCE")


@query("SRC2_ranged_ticks", f"""WITH {A.SQL_TICKS} SELECT event_id, symbol, source, trade_id, CAST(price AS DOUBLE) AS price,
 CAST(volume AS DOUBLE) AS volume, ts FROM ticks WHERE symbol = 'VIEW' AND source = 'BINANCE'
 AND ts >= TIMESTAMP '2024-01-03 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:00:00'""")
def ranged_ticks(spark, sf):
    """Read from a tick table laid out by day, so the range prunes directories."""
    path = work_path(spark, "ticks")
    t = A.ticks(spark, sf).withColumn("trade_date", F.col("ts").cast("date"))
    S.write_table(t, path, "trade_date", ["symbol", "source", "ts"])
    got = CF.read_ticks(spark, path, TS("2024-01-03 06:00:00"), TS("2024-01-12 18:00:00"), "view", "binance")
    return got.select("event_id", "symbol", "source", "trade_id", "price", "volume", "ts")


# -- scalar functions ----------------------------------------------------------------------------

@query("FUN1_change_percent", f"""WITH {A.SQL_TICKS}, p AS (SELECT symbol, arg_max(price, ts) AS prev FROM ticks
 WHERE ts < TIMESTAMP '2024-01-15' AND symbol <> 'VIEW' GROUP BY symbol)
SELECT event_id, CAST(CASE WHEN prev > 0 THEN price - prev ELSE 0 END AS DOUBLE) AS change,
 CAST(CASE WHEN prev > 0 THEN round(round(CAST(CAST(price - prev AS DOUBLE) / CAST(prev AS DOUBLE) AS DECIMAL(24,12)), 4) * 100, 2) ELSE 0 END AS DOUBLE) AS change_pct
FROM ticks LEFT JOIN p USING (symbol)""")
def change_percent(spark, sf):
    t = A.ticks(spark, sf)
    prev = t.filter((F.col("ts") < TS("2024-01-15 00:00:00")) & (F.col("symbol") != "VIEW")).groupBy("symbol").agg(
        F.max_by("price", "ts").alias("prev"))
    j = t.join(prev, "symbol", "left")
    return j.select("event_id", P.change("price", "prev").alias("change"), P.change_percent("price", "prev").alias("change_pct"))


@query("FUN2_text", """SELECT c_custkey, upper(trim(lower('  ' || c_mktsegment || ' '))) AS cleaned,
 coalesce(nullif(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END, ''), 'UNKNOWN') AS filled,
 'channel:' || c_mktsegment || ':' || CAST(c_custkey AS VARCHAR) AS key, c_mktsegment LIKE '%ING' AS suffixed FROM customer""")
def text_functions(spark, sf):
    seg = F.col("c_mktsegment")
    return A.table(spark, sf, "customer").select(
        "c_custkey", P.clean_symbol(F.lower(F.concat(F.lit("  "), seg, F.lit(" ")))).alias("cleaned"),
        P.or_default(F.when(F.col("c_custkey") % 4 == 0, "").otherwise(seg), "UNKNOWN").alias("filled"),
        F.format_string("channel:%s:%d", seg, F.col("c_custkey")).alias("key"), seg.endswith("ING").alias("suffixed"))


@query("FUN3_time", """SELECT event_id, CAST(ts AS DATE) AS day, date_trunc('minute', ts) AS minute,
 time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS quarter, CAST(floor(floor(epoch(ts)) / 900) * 900 AS BIGINT) AS quarter_s,
 CAST(ts AS DATE) + 7 AS next_week, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS age_days FROM events""")
def time_functions(spark, sf):
    sec = TP.seconds("ts")
    return A.table(spark, sf, "events").select(
        "event_id", F.to_date("ts").alias("day"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("minute"),
        TP.floor_bucket("ts", 900).alias("quarter"), (F.floor(sec / 900) * 900).alias("quarter_s"),
        F.date_add(F.to_date("ts"), 7).alias("next_week"), F.datediff(F.to_date("ts"), D("2024-01-01")).alias("age_days"))


@query("FUN4_math", """SELECT event_id, greatest(value, 10) AS hi, least(value, 10) AS lo, abs(value - 20) AS dist,
 CAST(round(CAST(sqrt(value) AS DECIMAL(24,8)), 6) AS DOUBLE) AS root, CAST(round(CAST(ln(value + 1) AS DECIMAL(24,8)), 6) AS DOUBLE) AS logv,
 CAST(round(CAST(exp(value / 100) AS DECIMAL(24,8)), 6) AS DOUBLE) AS expv, CAST(round(CAST(value * value AS DECIMAL(24,8)), 4) AS DOUBLE) AS squared FROM events""")
def math_functions(spark, sf):
    v = F.col("value")
    r = lambda x, n: F.round(x.cast("decimal(24,8)"), n)
    return A.table(spark, sf, "events").select(
        "event_id", F.greatest(v, F.lit(10.0)).alias("hi"), F.least(v, F.lit(10.0)).alias("lo"), F.abs(v - 20).alias("dist"),
        r(F.sqrt(v), 6).alias("root"), r(F.ln(v + 1), 6).alias("logv"), r(F.exp(v / 100), 6).alias("expv"), r(F.pow(v, F.lit(2)), 4).alias("squared"))


@query("FUN5_predicates", """SELECT c_mktsegment AS segment,
 count(*) FILTER (c_acctbal BETWEEN 0 AND 5000) AS between_n, count(*) FILTER (c_nationkey IN (1, 2, 3)) AS in_n,
 count(*) FILTER (CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END IS DISTINCT FROM 7) AS distinct_n,
 count(*) FILTER ((c_nationkey, c_custkey) > (12, 500)) AS row_n,
 count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS no_orders FROM customer GROUP BY 1""")
def predicates(spark, sf):
    cust = A.table(spark, sf, "customer")
    buyers = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("buys", F.lit(True))
    k = F.col("c_nationkey")
    row_cmp = F.struct(k.cast("long"), "c_custkey") > F.struct(F.lit(12).cast("long"), F.lit(500).cast("long"))
    return cust.join(buyers, "c_custkey", "left").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count_if(F.col("c_acctbal").between(0, 5000)).alias("between_n"), F.count_if(k.isin(1, 2, 3)).alias("in_n"),
        F.count_if(~F.when(F.col("c_custkey") % 5 != 0, k).eqNullSafe(F.lit(7))).alias("distinct_n"),
        F.count_if(row_cmp).alias("row_n"), F.count_if(F.col("buys").isNull()).alias("no_orders"))


@query("FUN6_regex_and_params", r"""SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)$', 1) AS digits,
 regexp_matches(p_brand, '#[1-3]') AS low_brand,
 coalesce(TRY_CAST(CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN 'x' END AS INT), 14) AS period,
 CASE WHEN p_partkey % 3 = 1 THEN 'Parameter ''period'' must be an integer, got: x' END AS error FROM part""")
def regex_and_params(spark, sf):
    """Pattern match and extract; a parameter read as a number, defaulted when absent, an error when not one."""
    raw = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 3 == 1, "x")
    number = raw.try_cast("int")
    error = F.when(raw.isNotNull() & number.isNull(), F.concat(F.lit("Parameter 'period' must be an integer, got: "), raw))
    return A.table(spark, sf, "part").select(
        "p_partkey", F.regexp_extract("p_brand", "([0-9]+)$", 1).alias("digits"), F.col("p_brand").rlike("#[1-3]").alias("low_brand"),
        F.coalesce(number, F.lit(14)).cast("long").alias("period"), error.alias("error"))


@query("FUN7_json", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
 CASE WHEN event_id % 20 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS parsed,
 '{"event":' || CAST(event_id AS VARCHAR) || ',"type":"' || event_type || '"}' AS written FROM events""")
def json_functions(spark, sf):
    broken = F.when(F.col("event_id") % 20 == 0, "{\"k\":").otherwise(F.col("props"))
    return A.table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.from_json(broken, "k long")["k"].alias("parsed"),
        F.to_json(F.struct(F.col("event_id").alias("event"), F.col("event_type").alias("type"))).alias("written"))


@query("FUN8_future_points", f"""WITH {A.SQL_BARS}, l AS (SELECT symbol, max(trade_date) AS last FROM bars GROUP BY symbol)
SELECT symbol, CAST(k AS BIGINT) AS step, CAST(last AS TIMESTAMP) + to_days(CAST(k AS INT)) AS ts FROM l, (SELECT unnest(range(1, 11)) AS k) s""")
def future_points(spark, sf):
    last = A.bars_daily(spark, sf).groupBy("symbol").agg(F.max("trade_date").alias("last"))
    points = last.select("symbol", F.posexplode(TP.future_points("last", 86400, 10)).alias("pos", "ts"))
    return points.select("symbol", (F.col("pos") + 1).cast("long").alias("step"), "ts")


@query("FUN9_us_session", """SELECT event_id, isodow(e) <= 5 AND hour(e) * 60 + minute(e) >= 570 AND hour(e) * 60 + minute(e) < 960 AS in_session
FROM (SELECT event_id, ts - INTERVAL '5 hours' AS e FROM events) t""")
def us_session(spark, sf):
    """January rows, where Eastern time is five hours behind."""
    return A.table(spark, sf, "events").select("event_id", TP.in_us_regular_session("ts").alias("in_session"))
