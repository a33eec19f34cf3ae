"""Live and official merges, coverage, gap repair: the reference's database scenarios on small tables."""
import datetime as dt

from pyspark.sql import functions as F

from tickloom.operators import candles as C, coverage as V, dedup as U, merge as M
from tickloom.plans import repair as RP

T0 = dt.datetime(2026, 9, 20, 10, 0)
TICK = "event_id long, symbol string, source string, trade_id string, price decimal(24,8), volume decimal(24,8), exchange string, ts timestamp_ntz, market_type string"
CANDLE = "symbol string, source string, bucket timestamp_ntz, open decimal(24,8), high decimal(24,8), low decimal(24,8), close decimal(24,8), volume decimal(32,8), quote_volume decimal(32,8), trade_count long, origin string"


def ticks(spark, *rows):
    from decimal import Decimal as D
    return spark.createDataFrame([(i, "BTC", "BINANCE", str(i), D(p), D(v), "BINANCE", T0 + dt.timedelta(seconds=s), "CRYPTO") for i, (s, p, v) in enumerate(rows)], TICK)


def candle(minute, close, origin="EXCHANGE", count=7, symbol="BTC", start=T0):
    from decimal import Decimal as D
    return (symbol, "BINANCE", start + dt.timedelta(minutes=minute), D(1), D(200), D(1), D(close), D(3), None, count, origin)


def stored(spark, *rows):
    return spark.createDataFrame(list(rows), CANDLE)


def by_minute(df):
    return {r.bucket: r for r in df.collect()}


def test_ticks_become_live_minutes_and_late_tick_lowers_low(spark):
    rows = [(5, 100, 1), (50, 102, 2), (70, 101, 1)]
    empty = stored(spark, candle(0, 1)).limit(0)
    first = M.merge_live(empty, C.minute_ohlcv(ticks(spark, *rows)).drop("trade_count"))
    m = by_minute(first)
    assert len(m) == 2 and all(r.changed and r.origin == "LIVE" for r in m.values())
    assert [float(m[T0][c]) for c in ("open", "high", "low", "close", "volume")] == [100, 102, 100, 102, 3]
    again = M.merge_live(first.drop("changed"), C.minute_ohlcv(ticks(spark, *rows)).drop("trade_count"))
    assert not any(r.changed for r in again.collect())
    late = M.merge_live(first.drop("changed"), C.minute_ohlcv(ticks(spark, *rows, (20, 90, 1))).drop("trade_count"))
    m = by_minute(late)
    assert m[T0].changed and float(m[T0].low) == 90 and not m[T0 + dt.timedelta(minutes=1)].changed


def test_live_never_touches_official(spark):
    out = M.merge_live(stored(spark, candle(0, 55)), C.minute_ohlcv(ticks(spark, (5, 100, 1))).drop("trade_count"))
    r = out.first()
    assert r.origin == "EXCHANGE" and float(r.close) == 55 and not r.changed


def test_official_overwrites_and_is_idempotent(spark):
    old = stored(spark, candle(0, 9, "LIVE", None), candle(1, 5))
    new = stored(spark, candle(0, 10), candle(1, 5), candle(1, 4, count=None), candle(4, 7))
    out = M.merge_exchange(old, new)
    m = by_minute(out)
    assert float(m[T0].close) == 10 and m[T0].origin == "EXCHANGE" and m[T0].changed
    one = T0 + dt.timedelta(minutes=1)
    assert float(m[one].close) == 5 and not m[one].changed
    assert not any(r.changed for r in M.merge_exchange(out.drop("changed"), new).collect())


def test_duplicate_minutes_keep_fullest(spark):
    rows = U.fullest_minute(stored(spark, candle(0, 1, count=None), candle(0, 2, count=3), candle(0, 3, count=9))).collect()
    assert len(rows) == 1 and float(rows[0].close) == 3


def test_coverage_counts_missing(spark):
    r = V.coverage(stored(spark, candle(0, 1), candle(1, 1), candle(4, 1)), "bucket", 60).first()
    assert (r.row_count, r.missing_count, r.status) == (3, 2, "GAPS")


def test_repair_scenario(spark):
    end = dt.datetime(2026, 9, 20, 11, 50)
    start = end - dt.timedelta(hours=6)
    live = lambda sym, a, b, skip=(): [candle(i, 9, "LIVE", None, sym, start) for i in range(a, b) if i not in skip]
    rows = live("GAPPY", 0, 360, {100, 101, 300}) + live("FULL", 0, 360) + live("DEAD", 0, 360, {5}) + live("SILENT", -180, 0) + live("NEW", 355, 360)
    candles = stored(spark, *rows)
    traded = spark.createDataFrame([(s,) for s in ("GAPPY", "FULL", "SILENT", "NEW")], "symbol string")
    official = stored(spark, *[candle(i, 1, symbol=s, start=start) for s in ("GAPPY", "FULL", "DEAD", "SILENT") for i in range(360)],
                      *[candle(i, 1, symbol="NEW", start=start) for i in range(355, 360)])
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    merged, summary = RP.fill(candles, official, traded, a, b)
    s = summary.first()
    assert (s.symbols_checked, s.symbols_with_gaps, s.missing_minutes, s.unfillable) == (4, 3, 3 + 360 + 355, 355)
    after = merged.drop("changed")
    n = {(r.symbol, r.origin): r["count"] for r in after.groupBy("symbol", "origin").count().collect()}
    assert n[("GAPPY", "EXCHANGE")] == 360 and n[("SILENT", "EXCHANGE")] == 360 and ("FULL", "EXCHANGE") not in n and n[("DEAD", "LIVE")] == 359
    assert RP.gaps(after, traded, a, b).filter("missing > 0").count() == 0
