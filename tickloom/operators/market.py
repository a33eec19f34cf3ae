"""Market overview, joins against snapshots, top lists."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions import pricing as P


def snapshots(newest: DataFrame, prev_close: DataFrame) -> DataFrame:
    """Latest price per symbol with its change against the previous close."""
    j = newest.join(prev_close, "symbol", "left")
    return j.select("symbol", "price", "volume", "exchange", "ts", P.change("price", "prev_close").alias("change"),
                    P.change_percent("price", "prev_close").alias("change_percent"), "market_type")


def active_snapshots(snaps: DataFrame, now: Column, ttl_seconds: int = 60, ts: str = "ts") -> DataFrame:
    """Snapshots younger than their time to live, by symbol."""
    alive = F.col(ts) > now - F.expr(f"INTERVAL {ttl_seconds} SECONDS")
    return snaps.filter(alive).orderBy("symbol")


def overview(instruments: DataFrame, snaps: DataFrame, prev_close: DataFrame) -> DataFrame:
    """Instruments with a price: live where there is a snapshot, else the previous close with change 0."""
    s = snaps.select("symbol", F.col("price").alias("live"), "change", "change_percent")
    j = instruments.join(s, "symbol", "left").join(prev_close, "symbol", "left")
    priced = j.filter(F.col("live").isNotNull() | F.col("prev_close").isNotNull())
    zero = F.lit(0).cast("decimal(18,2)")
    return priced.select(
        "symbol", "name", "market_type", F.coalesce("live", "prev_close").alias("current_price"), "prev_close",
        F.when(F.col("live").isNotNull(), F.col("change")).otherwise(zero).alias("change"),
        F.when(F.col("live").isNotNull(), F.col("change_percent")).otherwise(zero).alias("change_percent"),
        F.col("live").isNotNull().alias("realtime"))


def gainers(items: DataFrame, n: int = 10) -> DataFrame:
    return items.orderBy(F.desc("change_percent"), "symbol").limit(n)


def losers(items: DataFrame, n: int = 10) -> DataFrame:
    return items.orderBy("change_percent", "symbol").limit(n)


def instruments_with_price(instruments: DataFrame, snaps: DataFrame) -> DataFrame:
    """Every instrument; price and change are NULL without a snapshot."""
    return instruments.join(snaps.select("symbol", "price", "change", "change_percent"), "symbol", "left")


def latest(df: DataFrame, ts: str, n: int, *tie: str) -> DataFrame:
    """Newest ``n`` rows."""
    return df.orderBy(F.desc(ts), *tie).limit(n)


def ranged(df: DataFrame, day: str, start: Column, end: Column) -> DataFrame:
    """Rows with start <= day <= end, ascending."""
    return df.filter(F.col(day).between(start, end)).orderBy(day)
