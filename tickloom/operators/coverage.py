"""Coverage, eligibility and ranking aggregates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.pricing import PEGGED, QUOTE
from tickloom.functions.timeparse import seconds


def coverage(df: DataFrame, ts: str, step_seconds: int, status: str | None = None) -> DataFrame:
    """First, last, count and missing rows per symbol and source on a continuous grid."""
    agg = df.groupBy("symbol", "source").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("row_count"))
    expected = F.floor((seconds("last_ts") - seconds("first_ts")) / step_seconds) + 1
    missing = F.greatest(F.lit(0), expected - F.col("row_count")).cast("long")
    derived = (F.when(F.col("first_ts").isNull(), "UNKNOWN")
               .when(F.col("missing_count") == 0, "COMPLETE").otherwise("GAPS"))
    return agg.withColumn("missing_count", missing).withColumn("status", F.lit(status) if status else derived)


def date_coverage(daily: DataFrame) -> DataFrame:
    return daily.groupBy("symbol", "source").agg(
        F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"),
        F.countDistinct("trade_date").alias("bar_count"))


def history_before(daily: DataFrame, day: Column) -> DataFrame:
    """Distinct days per symbol and source before ``day``."""
    return daily.filter(F.col("trade_date") < day).groupBy("symbol", "source").agg(
        F.countDistinct("trade_date").alias("history_bars"))


def eligible_symbols(daily: DataFrame, start: Column, end: Column, minimum_history: int,
                     source: str = "BINANCE", market_type: str = "CRYPTO") -> DataFrame:
    """Symbols with every day of [start, end] and enough days before it.

    Days are made distinct once, then counted by condition: one shuffle on (symbol, day) and one on
    symbol, instead of two distinct sets per symbol.
    """
    days = (daily.filter((F.col("source") == source) & (F.col("market_type") == market_type))
            .select("symbol", "trade_date").distinct())
    in_range = F.col("trade_date").between(start, end)
    counts = days.groupBy("symbol").agg(F.count_if(in_range).alias("in_range"),
                                        F.count_if(F.col("trade_date") < start).alias("before"))
    expected = F.datediff(end, start) + 1
    return counts.filter((F.col("in_range") == expected) & (F.col("before") >= minimum_history)).select("symbol")


def known_symbols(daily: DataFrame, source: str = "BINANCE", market_type: str = "CRYPTO") -> DataFrame:
    return daily.filter((F.col("source") == source) & (F.col("market_type") == market_type)).agg(
        F.countDistinct("symbol").alias("symbol_count"))


def top_by_turnover(daily: DataFrame, traded: DataFrame, today: Column, n: int, days: int = 30,
                    source: str = "BINANCE") -> DataFrame:
    """Top ``n`` traded, unpegged symbols by the sum of close times volume over the last days.

    The product keeps all digits of both factors that a decimal can hold (at least six behind the point).
    """
    recent = daily.filter((F.col("source") == source) & (F.col("trade_date") >= F.date_sub(today, days))
                          & ~F.col("symbol").isin(PEGGED))
    turnover = F.sum((F.col("close") * F.col("volume")).cast("decimal(38,6)")).alias("quote_volume")
    ranked = recent.groupBy("symbol").agg(turnover).join(traded.select("symbol").distinct(), "symbol", "left_semi")
    return ranked.orderBy(F.desc("quote_volume"), "symbol").limit(n)


def top_by_quote_volume(tickers: DataFrame, n: int, suffix: str = QUOTE) -> DataFrame:
    """Top ``n`` symbols of the quote currency by 24-hour volume; 0 keeps all."""
    ranked = tickers.filter(F.col("symbol").endswith(suffix)).orderBy(F.desc("quote_volume"), "symbol")
    return ranked.limit(n) if n > 0 else ranked


def tick_health(ticks: DataFrame, by: str, n: int = 10) -> DataFrame:
    """Row counts of the ``n`` largest groups."""
    return ticks.groupBy(by).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), by).limit(n)


def tick_staleness(ticks: DataFrame, now: Column) -> DataFrame:
    """Total rows, newest time and its age."""
    return ticks.agg(F.count("*").alias("rows"), F.max("ts").alias("last_trade_ts")).withColumn(
        "staleness_s", seconds(now) - seconds("last_trade_ts"))
