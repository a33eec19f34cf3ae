"""De-duplication as aggregates, never as a window over the copies.

Copies of one record may make up a large part of the input. An aggregate folds them on the map side,
where ``row_number`` would first bring every copy of a key into one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_extreme(df: DataFrame, key: list[str], order: Column, largest: bool) -> DataFrame:
    """Whole row with the smallest or largest order value per key."""
    rest = [c for c in df.columns if c not in key]
    pick = F.max_by if largest else F.min_by
    picked = df.groupBy(*key).agg(pick(F.struct(*rest), order).alias("_r"))
    return picked.select(*key, "_r.*").select(*df.columns)


def lowest_id_per_trade(ticks: DataFrame, with_symbol: bool = True, row_id: str = "id") -> DataFrame:
    """Keep the lowest row id per (symbol,) source, trade id and time."""
    key = (["symbol"] if with_symbol else []) + ["source", "trade_id", "ts"]
    return keep_extreme(ticks, key, F.col(row_id), largest=False)


def fullest_minute(candles: DataFrame) -> DataFrame:
    """One candle per minute: the largest trade count, unknown counts last."""
    order = F.struct(F.col("trade_count").isNotNull(), F.coalesce("trade_count", F.lit(0)), "volume", "close")
    return keep_extreme(candles, ["symbol", "source", "bucket"], order, largest=True)


def latest_computed(daily: DataFrame) -> DataFrame:
    """One daily bar per symbol, source and date: the one computed last."""
    return keep_extreme(daily, ["symbol", "source", "trade_date"], F.struct("computed_at", "close"), largest=True)


def first_source(daily: DataFrame) -> DataFrame:
    """One daily bar per symbol and date: the alphabetically first source."""
    return keep_extreme(daily, ["symbol", "trade_date"], F.col("source"), largest=False)


def last_loaded(series: DataFrame, key: list[str], value: str, load_order: str) -> DataFrame:
    """One value per key and time: the one loaded last."""
    return series.groupBy(*key).agg(F.max_by(value, load_order).alias(value))


def newest_per_key(df: DataFrame, key: list[str], n: int, order: Column) -> DataFrame:
    """Newest ``n`` rows per key (the window group limit prunes on the map side)."""
    w = Window.partitionBy(*key).orderBy(order.desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
