"""Exchange messages: missing fields, bad numbers, nanosecond times, arrays with one bad item."""
import datetime as dt

from pyspark.sql import functions as F

from tickloom.functions import pricing as P, timeparse as TP
from tickloom.operators import normalize as N
from tickloom.session import work_path
from tickloom.sources import candle_files as CF


def raw(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_crypto_messages(spark):
    good = '{"s":"BTCUSDT","p":"0.001","q":"100","T":123456785,"a":12345}'
    out = N.crypto_trades(raw(spark, good, '{"data":' + good + "}", '{"s":"BTCUSDT"}', good.replace("0.001", "0"), good.replace('"100"', '"-1"'), "x")).collect()
    assert len(out) == 2
    assert (out[0].symbol, float(out[0].price), out[0].trade_id, out[0].timestamp, out[0].market_type) == ("BTCUSDT", 0.001, "12345", 123456785, "CRYPTO")


def test_equity_array_keeps_good_items(spark):
    t = '{"T":"t","S":"AAPL","p":150.25,"s":100,"t":"2023-01-01T12:00:00.123456789Z","x":"IEX"}'
    msg = "[" + ",".join([t, t.replace("150.25", '"abc"'), '{"T":"q","S":"AAPL","bp":1,"ap":3,"t":"2023-01-01T12:00:00Z"}', '{"T":"success","msg":"authenticated"}', "5"]) + "]"
    items = N.equity_items(raw(spark, msg, t, "{bad"))
    trades = N.equity_trades(items).collect()
    assert len(trades) == 2
    assert trades[0].timestamp == 1672574400123 and trades[0].trade_id == "IEX_1672574400123_AAPL_100"
    q = N.equity_quotes(items).collect()
    assert len(q) == 1 and float(q[0].price) == 2 and q[0].trade_id == "UNKNOWN_QUOTE_1672574400000_AAPL" and q[0].exchange == "UNKNOWN"


def test_unreadable_time_is_flagged(spark):
    ms, flag = TP.rfc3339_millis(F.lit("yesterday"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    r = spark.range(1).select(ms.alias("ms"), flag.alias("flag")).first()
    assert r.flag and r.ms == 1704067200000


def test_archive_csv_skips_header_and_reads_both_units(spark):
    path = work_path(spark, "csv")
    line = lambda t, c: f"{t},1,2,0.5,1.5,10,{c},15,7,0,0,0"
    rows = ["open_time,open,high,low,close,volume,close_time,quote_volume,count,a,b,c", line(1735689600000, 1735689659999), line(1735689600000000, 1735689659999999)]
    spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1).write.text(path)
    out = CF.read_archive_csv(spark, path).collect()
    assert len(out) == 2 and {r.bucket for r in out} == {dt.datetime(2025, 1, 1)} and out[0].trade_count == 7


def test_coin_pairs(spark):
    pairs = ["BTCUSDT", "JUPUSDT", "USDCUSDT", "ETHUPUSDT", "BULLUSDT", "USDT", "BTCBUSD", "WBTCUSDT"]
    got = spark.createDataFrame([(s,) for s in pairs], "s string").filter(P.is_coin_pair("s")).collect()
    assert [r.s for r in got] == ["BTCUSDT", "JUPUSDT"]


def test_change_percent_rounds_twice(spark):
    r = spark.range(1).select(P.change_percent(F.lit("100.555").cast("decimal(24,8)"), F.lit("100").cast("decimal(24,8)")).alias("x"),
                              P.change_percent(F.lit("1").cast("decimal(24,8)"), F.lit("0").cast("decimal(24,8)")).alias("y")).first()
    assert float(r.x) == 0.56 and float(r.y) == 0.0
