"""Candle merges as full-outer joins on the whole candle key.

The key includes the time bucket, so a hot symbol spreads over all partitions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .dedup import fullest_minute

CANDLE_KEY = ["symbol", "source", "bucket"]
DAILY_KEY = ["symbol", "trade_date", "source"]
LIVE_VALUES = ["open", "high", "low", "close", "volume"]


def _distinct(values: list[str]) -> Column:
    """IS DISTINCT FROM over several columns."""
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"o.{v}").eqNullSafe(F.col(f"n.{v}"))
    return differs


def merge_rows(stored: DataFrame, incoming: DataFrame, key: list[str], may_update: Column,
               keep_when_updated: tuple[str, ...] = ()) -> DataFrame:
    """Upsert ``incoming`` into ``stored``; ``may_update`` decides on matched rows.

    Inside ``may_update`` the old row is ``o`` and the new one ``n``. Adds ``changed``: inserted or
    updated. Columns in ``keep_when_updated`` keep the old value on an update.
    """
    rest = [c for c in stored.columns if c not in key]
    old = stored.select(*key, F.struct(*rest).alias("o"))
    new = incoming.select(*key, F.struct(*[F.col(c) for c in rest]).alias("n"))
    joined = old.join(new, key, "full_outer")
    inserted = F.col("o").isNull()
    updated = F.col("o").isNotNull() & F.col("n").isNotNull() & may_update
    take_new = inserted | F.coalesce(updated, F.lit(False))
    out = []
    for c in rest:
        fresh = F.when(inserted, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in keep_when_updated else F.col(f"n.{c}")
        out.append(F.when(take_new, fresh).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*key, *out, take_new.alias("changed"))


def merge_live(stored: DataFrame, live: DataFrame) -> DataFrame:
    """LIVE candles: never touch EXCHANGE rows, update LIVE rows only where values differ."""
    incoming = _fill(live, stored).withColumn("origin", F.lit("LIVE"))
    rule = (F.col("o.origin") == "LIVE") & _distinct(LIVE_VALUES)
    return merge_rows(stored, incoming, CANDLE_KEY, rule, keep_when_updated=("quote_volume", "trade_count"))


def merge_exchange(stored: DataFrame, official: DataFrame) -> DataFrame:
    """EXCHANGE candles: overwrite LIVE always, EXCHANGE only where values differ."""
    incoming = fullest_minute(_fill(official, stored)).withColumn("origin", F.lit("EXCHANGE"))
    rule = (F.col("o.origin") == "LIVE") | _distinct(LIVE_VALUES + ["trade_count"])
    return merge_rows(stored, incoming, CANDLE_KEY, rule)


def _computed(incoming: DataFrame, stored: DataFrame, at: Column | None) -> DataFrame:
    """``computed_at`` of new rows, if the stored table has that column."""
    if "computed_at" not in stored.columns:
        return incoming
    kind = dict(stored.dtypes)["computed_at"]
    return incoming.withColumn("computed_at", (F.current_timestamp() if at is None else at).cast(kind))


def merge_daily_exchange(stored: DataFrame, official: DataFrame, market_type: str, computed_at: Column | None = None) -> DataFrame:
    """Official daily candles keyed by the UTC date of their bucket; they always win."""
    one = fullest_minute(official)
    incoming = one.select(
        "symbol", F.col("bucket").cast("date").alias("trade_date"), "source", F.lit(market_type).alias("market_type"),
        "open", "high", "low", "close", "volume", F.col("trade_count").alias("tick_count"),
        F.lit("EXCHANGE").alias("origin"))
    return merge_rows(stored, _computed(incoming, stored, computed_at), DAILY_KEY, F.lit(True))


def merge_daily_rollup(stored: DataFrame, rollup: DataFrame, computed_at: Column | None = None, only_changes: bool = False) -> DataFrame:
    """Daily candles rolled up from ticks: they never overwrite an official row.

    With ``only_changes`` a row whose values are stored already stays as it is, its ``computed_at`` too, so that a job that
    runs again changes nothing.
    """
    incoming = _computed(_fill(rollup, stored), stored, computed_at)
    rule = ~F.col("o.origin").eqNullSafe("EXCHANGE")
    if only_changes:
        rule = rule & _distinct([*LIVE_VALUES, "market_type", "tick_count"])
    return merge_rows(stored, incoming, DAILY_KEY, rule, keep_when_updated=("origin",))


def merge_newest(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Plain upsert: the new side wins."""
    return merge_rows(stored, incoming, key, F.lit(True))


def insert_missing(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not stored yet."""
    return incoming.join(stored.select(*key), key, "left_anti")


def _fill(df: DataFrame, like: DataFrame) -> DataFrame:
    """Add the columns of ``like`` that ``df`` lacks as NULL, in the same types."""
    types = dict(like.dtypes)
    return df.select(*[F.col(c).cast(types[c]) if c in df.columns else F.lit(None).cast(types[c]).alias(c)
                       for c in like.columns])
