"""Data-quality checks and readiness. Every check covers all dates at once; filter for one date."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.pricing import sane_candle
from tickloom.functions.timeparse import seconds
from .neighbors import with_halo

# Readiness limits.
MIN_HISTORY, EXTREME_MOVE = 50, 0.5


def vanished_symbols(daily: DataFrame) -> DataFrame:
    """Symbols with a candle on one day and none on the next, by that next day."""
    days = daily.select("symbol", "trade_date").distinct()
    expected = days.select("symbol", F.date_add("trade_date", 1).alias("trade_date"))
    return expected.join(days, ["symbol", "trade_date"], "left_anti")


def anomalies(daily: DataFrame) -> DataFrame:
    return daily.filter(~sane_candle()).select("symbol", "trade_date", "open", "high", "low", "close")


def extreme_moves(daily: DataFrame) -> DataFrame:
    """Closes that moved more than half since the day before, same symbol and source."""
    curr = daily.select("symbol", "source", "trade_date", F.col("close").alias("curr_close"))
    prev = daily.select("symbol", "source", F.date_add("trade_date", 1).alias("trade_date"), F.col("close").alias("prev_close"))
    joined = curr.join(prev.filter(F.col("prev_close") > 0), ["symbol", "source", "trade_date"])
    move = ((F.col("curr_close") - F.col("prev_close")) / F.col("prev_close")).cast("decimal(30,12)")
    return joined.withColumn("_m", move).filter(F.abs("_m") > EXTREME_MOVE).select(
        "symbol", "source", "trade_date", "prev_close", "curr_close", F.round(F.col("_m") * 100, 2).cast("decimal(18,2)").alias("change_pct"))


def without_indicators(daily: DataFrame, indicators: DataFrame) -> DataFrame:
    """Symbol days with a candle but no indicator row."""
    return daily.select("symbol", "trade_date").distinct().join(
        indicators.select("symbol", "trade_date"), ["symbol", "trade_date"], "left_anti")


def backtest_readiness(daily: DataFrame, target: Column) -> DataFrame:
    """Observations, stale days and internal gaps per symbol and source up to ``target``."""
    agg = daily.filter(F.col("trade_date") <= target).groupBy("symbol", "source").agg(
        F.countDistinct("trade_date").alias("observation_count"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))
    stale = F.greatest(F.datediff(target, "last_date"), F.lit(0)).cast("long")
    inner = F.greatest(F.datediff("last_date", "first_date") + 1 - F.col("observation_count"), F.lit(0)).cast("long")
    ready = (F.col("observation_count") >= MIN_HISTORY) & (F.col("stale_days") == 0) & (F.col("internal_gap_days") == 0)
    return agg.withColumns({"stale_days": stale, "internal_gap_days": inner}).withColumn("ready", ready)


def daily_readiness(daily: DataFrame, start: Column, end: Column, minimum_history: int) -> DataFrame:
    """READY or BLOCKED per symbol and source with the first failing reason."""
    days = daily.select("symbol", "source", "trade_date").distinct()
    agg = days.groupBy("symbol", "source").agg(
        F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"),
        F.count_if(F.col("trade_date").between(start, end)).alias("selected_bars"),
        F.count_if(F.col("trade_date") < start).alias("history_bars"))
    expected = (F.datediff(end, start) + 1).cast("long")
    agg = agg.withColumn("expected_bars", expected).withColumn(
        "missing_bars", F.greatest(F.lit(0).cast("long"), F.col("expected_bars") - F.col("selected_bars")))
    reason = (F.when(F.col("selected_bars") == 0, "no daily bars in the range")
              .when(F.col("history_bars") < minimum_history, "not enough history before the range")
              .when(F.col("missing_bars") > 0, "missing daily bars in the range"))
    return agg.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "READY").otherwise("BLOCKED"))


def intraday_readiness(minutes: DataFrame, start: Column, end: Column, minimum_history: int) -> DataFrame:
    """READY or BLOCKED per symbol and source for a minute range, with history twice the minimum back."""
    if not 50 <= minimum_history <= 500:
        raise ValueError("minimumHistoryBars must be between 50 and 500")
    back = start - F.expr(f"INTERVAL {2 * minimum_history} MINUTES")
    near = minutes.filter((F.col("bucket") >= back) & (F.col("bucket") < end))
    agg = near.groupBy("symbol", "source").agg(
        F.count_if(F.col("bucket") >= start).alias("selected_bars"), F.count_if(F.col("bucket") < start).alias("history_bars"),
        F.min("bucket").alias("first_bar"), F.max("bucket").alias("last_bar"))
    expected = F.floor((seconds(end) - seconds(start)) / 60)
    agg = agg.withColumn("expected_bars", expected).withColumn(
        "missing_bars", F.greatest(F.lit(0).cast("long"), F.col("expected_bars") - F.col("selected_bars")))
    reason = (F.when(F.col("selected_bars") == 0, "no minute bars in the range")
              .when(F.col("missing_bars") > 0, "missing minute bars in the range")
              .when(F.col("history_bars") < minimum_history, "not enough history before the range"))
    return agg.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "READY").otherwise("BLOCKED"))


# Alert limits.
LAG_HIGH, LAG_GROWING, MARGIN_LOW, LAG_AT_RISK = 50000, 10000, 1000, 100


def _held(cond: str, seconds_: int) -> Column:
    """The condition is true at every sample of the last ``seconds_``, and samples reach back that far."""
    w = Window.partitionBy("group_id", "_span").orderBy("_t").rangeBetween(-seconds_, 0)
    return F.every(cond).over(w) & (F.min("_t").over(w) <= F.col("_t") - seconds_)


def lag_alerts(samples: DataFrame) -> DataFrame:
    """Alert states per group and sample time.

    ``samples``: group_id, partition, ts, lag, margin. They are summed per group and time first, so the
    windows see one row per group and sample time. A group's samples are cut into days; each day brings the half hour before
    it, as far as a growth alert looks back (a quarter of slopes, each over a quarter of samples).
    """
    at_risk = F.min(F.when(F.col("lag") > LAG_AT_RISK, F.col("margin")))
    g = samples.groupBy("group_id", "ts").agg(F.sum("lag").alias("total_lag"), at_risk.alias("min_margin"))
    g = with_halo(g, "ts", 86400, 1800, 0).withColumn("_t", seconds("ts"))
    quarter = Window.partitionBy("group_id", "_span").orderBy("_t").rangeBetween(-900, 0)
    # time relative to the row keeps the slope exact for large epochs; a shift does not change it
    slope = F.regr_slope(F.col("total_lag").cast("double"), (F.col("_t") - F.lit(1_700_000_000)).cast("double")).over(quarter)
    g = g.withColumn("slope", slope)
    g = g.withColumns({
        "_high": F.col("total_lag") > LAG_HIGH,
        "_grow": F.coalesce((F.col("slope") > 0) & (F.col("total_lag") > LAG_GROWING), F.lit(False)),
        "_cliff": F.coalesce(F.col("min_margin") < MARGIN_LOW, F.lit(False))})
    held = g.withColumns({"lag_high": _held("_high", 300), "lag_growing": _held("_grow", 900), "near_retention": _held("_cliff", 120)})
    return held.filter(~F.col("_halo")).select("group_id", "ts", "total_lag", "lag_high", "lag_growing", "near_retention")
