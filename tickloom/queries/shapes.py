"""Input shapes that several registered queries share."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


NTZ = "timestamp_ntz"


def D(text: str):
    return F.lit(text).cast("date")


def TS(text: str):
    return F.lit(text).cast(NTZ)


def stored_candles(minutes: DataFrame) -> DataFrame:
    """Stored 1-minute candles: official rows on every 7th minute, live rows elsewhere, some absent."""
    minute = F.minute("bucket")
    official = minute % 7 == 0
    return minutes.filter(minute % 11 != 0).select(
        "symbol", "source", "bucket", "open",
        F.when(official, (F.col("high") + 1).cast("decimal(24,8)")).otherwise(F.col("high")).alias("high"), "low",
        F.when(official, (F.col("close") + 1).cast("decimal(24,8)"))
        .when(minute % 5 == 0, (F.col("close") + 2).cast("decimal(24,8)")).otherwise(F.col("close")).alias("close"),
        "volume", F.lit(None).cast("decimal(32,8)").alias("quote_volume"),
        F.when(official, F.col("trade_count")).alias("trade_count"),
        F.when(official, "EXCHANGE").otherwise("LIVE").alias("origin"))
