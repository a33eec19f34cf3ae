"""Tick roll-ups and candle re-bucketing.

All roll-ups are hash aggregates with a map-side partial step: a symbol that owns a third of the
ticks still leaves every task as one row per bucket.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.timeparse import floor_bucket, micros

INTERVAL_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600}


def _tick_order(bucket_start: Column, bucket_seconds: int) -> Column:
    """Position of a tick in its bucket as one long: microsecond offset, then hashed trade id.

    A struct key would force a sort-based aggregate; one long keeps the aggregate hashed and still
    gives ticks of the same microsecond a fixed order.
    """
    offset_bits = (bucket_seconds * 1_000_000).bit_length()
    tie_bits = 63 - offset_bits
    offset = micros("ts") - micros(bucket_start)
    tie = F.xxhash64("trade_id").bitwiseAND(F.lit((1 << tie_bits) - 1))
    return F.shiftleft(offset, tie_bits).bitwiseOR(tie)


def _ohlcv(order: Column) -> list[Column]:
    return [
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("volume").cast("decimal(32,8)").alias("volume"),
    ]


def minute_ohlcv(ticks: DataFrame) -> DataFrame:
    """One row per minute, symbol and source; ``trade_count`` counts the ticks."""
    bucket = floor_bucket("ts", 60)
    return (ticks.groupBy("symbol", "source", bucket.alias("bucket"))
            .agg(*_ohlcv(_tick_order(bucket, 60)), F.count("*").alias("trade_count")))


def daily_ohlcv(ticks: DataFrame) -> DataFrame:
    """One row per UTC day, symbol, market type and source."""
    day_start = floor_bucket("ts", 86400)
    return (ticks.groupBy("symbol", day_start.cast("date").alias("trade_date"), "market_type", "source")
            .agg(*_ohlcv(_tick_order(day_start, 86400)), F.count("*").alias("tick_count")))


def known_sum(col: str) -> Column:
    """Sum that is NULL as soon as one member is NULL."""
    return F.when(F.count(col) == F.count("*"), F.sum(col))


def rebucket(candles: DataFrame, interval: str) -> DataFrame:
    """1-minute candles to a coarser fixed-width interval, per symbol and source."""
    bucket = floor_bucket("bucket", INTERVAL_SECONDS[interval])
    return (candles.groupBy("symbol", "source", bucket.alias("start"))
            .agg(F.min_by("open", "bucket").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                 F.max_by("close", "bucket").alias("close"), F.sum("volume").cast("decimal(32,8)").alias("volume"),
                 known_sum("trade_count").alias("trade_count"))
            .withColumnRenamed("start", "bucket"))


def cutoffs(candles: DataFrame, start: Column, end: Column) -> DataFrame:
    """First minute per symbol and source that the stored candles of [start, end) do not cover."""
    in_range = candles.filter((F.col("bucket") >= start) & (F.col("bucket") < end))
    return in_range.groupBy("symbol", "source").agg(
        (F.max("bucket") + F.expr("INTERVAL 1 MINUTE")).alias("cutoff"))


def topped_up_minutes(candles: DataFrame, ticks: DataFrame, start: Column, end: Column,
                      top_up_minutes: int = 30) -> DataFrame:
    """Stored minutes plus, after the last stored one, minutes rolled up from raw ticks.

    Only the last ``top_up_minutes`` of ticks are read, and they are rolled up before the cutoff
    join: a cutoff is a whole minute, so filtering minutes equals filtering ticks.
    """
    stored = candles.filter((F.col("bucket") >= start) & (F.col("bucket") < end))
    tick_from = F.greatest(start, end - F.expr(f"INTERVAL {top_up_minutes} MINUTES"))
    recent = minute_ohlcv(ticks.filter((F.col("ts") >= tick_from) & (F.col("ts") < end)))
    fresh = (recent.join(cutoffs(candles, start, end), ["symbol", "source"], "left")
             .filter(F.col("bucket") >= F.coalesce("cutoff", start)).drop("cutoff"))
    cols = ["symbol", "source", "bucket", "open", "high", "low", "close", "volume", "trade_count"]
    return stored.select(*cols).unionByName(fresh.select(*cols))


def intraday(candles: DataFrame, ticks: DataFrame, interval: str, start: Column, end: Column) -> DataFrame:
    """Intraday read: stored minutes topped up from ticks, re-bucketed."""
    return rebucket(topped_up_minutes(candles, ticks, start, end), interval)


def latest_source(candles: DataFrame, now: Column, days: int = 3) -> DataFrame:
    """Per symbol the source with the newest candle of the last days; ties to the first name."""
    recent = candles.filter(F.col("bucket") >= now - F.expr(f"INTERVAL {days} DAYS"))
    per_source = recent.groupBy("symbol", "source").agg(F.max("bucket").alias("newest"))
    best = per_source.groupBy("symbol").agg(F.min(F.struct((-micros("newest")).alias("age"), "source")).alias("best"))
    return best.select("symbol", F.col("best.source").alias("source"))


def newest_trade(ticks: DataFrame, order: str = "event_id") -> DataFrame:
    """Newest tick per symbol; a later position wins a tie."""
    cols = ["source", "price", "volume", "exchange", "ts", "market_type"]
    picked = ticks.groupBy("symbol").agg(
        F.max_by(F.struct(*cols, order), F.struct("ts", order)).alias("t"))
    return picked.select("symbol", "t.*")


def previous_close(daily: DataFrame) -> DataFrame:
    """Latest daily close per symbol; the last source name settles a day with several."""
    return daily.groupBy("symbol").agg(
        F.max_by("close", F.struct("trade_date", "source")).alias("prev_close"))
