"""Gap repair and day confirmation from official candles."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.functions.timeparse import seconds
from tickloom.operators import coverage as V, merge as M
from tickloom.session import drop_path
from tickloom.sources import sinks as S
from tickloom.sources.commits import publish, read


def pending(candles: DataFrame, start: Column, end: Column, source: str = "BINANCE") -> DataFrame:
    """Per symbol seen since a day before ``start``: where the check begins and the minutes present after it.

    Minutes up to the last official candle are complete. One aggregation finds that candle; the count
    joins it back on the symbol, and both sides are minute rows of the last day and hours only.
    """
    near = candles.filter((F.col("source") == source) & (F.col("bucket") >= start - F.expr("INTERVAL 1 DAY")) & (F.col("bucket") < end))
    seen = near.groupBy("symbol").agg(F.max(F.when(F.col("origin") == "EXCHANGE", F.col("bucket"))).alias("official"))
    begin = seen.select("symbol", F.greatest(start, F.coalesce(F.col("official") + F.expr("INTERVAL 1 MINUTE"), start)).alias("start_at"))
    per_minute = near.filter(F.col("bucket") >= start).select("symbol", "bucket")
    counted = per_minute.join(begin, "symbol").filter(F.col("bucket") >= F.col("start_at")).groupBy("symbol").agg(F.count("*").alias("present"))
    return begin.join(counted, "symbol", "left").withColumn("present", F.coalesce("present", F.lit(0).cast("long")))


def gaps(candles: DataFrame, traded: DataFrame, start: Column, end: Column, source: str = "BINANCE") -> DataFrame:
    """Traded symbols that lack minutes: expected, present, missing."""
    p = pending(candles, start, end, source).join(traded, "symbol", "left_semi")
    expected = F.floor((seconds(end) - seconds("start_at")) / 60)
    return p.withColumn("expected", expected).withColumn("missing", F.greatest(F.lit(0).cast("long"), F.col("expected") - F.col("present")))


def fill(candles: DataFrame, official: DataFrame, traded: DataFrame, start: Column, end: Column, source: str = "BINANCE"):
    """Official candles merged over the gaps; also the summary of what was filled and what cannot be."""
    missing = gaps(candles, traded, start, end, source)
    offer = offered(official, missing, start, end, source)
    return M.merge_exchange(candles, offer), summarized(missing, offer)


def offered(official: DataFrame, missing: DataFrame, start: Column, end: Column, source: str) -> DataFrame:
    """Official candles of symbols with gaps, from where their check begins."""
    open_ranges = missing.filter(F.col("missing") > 0)
    return (official.filter((F.col("source") == source) & (F.col("bucket") >= start) & (F.col("bucket") < end))
            .join(open_ranges.select("symbol", "start_at"), "symbol").filter(F.col("bucket") >= F.col("start_at")).drop("start_at"))


def summarized(missing: DataFrame, offer: DataFrame) -> DataFrame:
    """Symbols checked and with gaps, minutes that are missing and that no official candle can fill."""
    got = offer.groupBy("symbol").agg(F.countDistinct("bucket").alias("offered"))
    totals = missing.join(got, "symbol", "left").withColumn("offered", F.coalesce("offered", F.lit(0).cast("long")))
    has = F.col("missing") > 0
    return totals.agg(
        F.count("*").alias("symbols_checked"), F.count_if(has).alias("symbols_with_gaps"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_minutes"),
        F.coalesce(F.sum(F.when(has, F.greatest(F.lit(0).cast("long"), F.col("expected") - F.col("offered")))), F.lit(0)).alias("unfillable"))


def fill_into(spark: SparkSession, path: str, official: DataFrame, traded: DataFrame, start: Column, end: Column, source: str = "BINANCE") -> DataFrame:
    """Fill the gaps of a stored minute table (directories by ``day``) and count what was done.

    Only the days of the range and the one before are read to find the gaps, only the days of the offered candles to merge them,
    and only days with a changed minute are written. ``filled`` counts inserted and changed minutes.
    """
    near = F.col("day").between(F.to_date(start - F.expr("INTERVAL 1 DAY")), F.to_date(end))
    missing, gaps_path = S.staged(spark, gaps(spark.read.parquet(path).filter(near).drop("day"), traded, start, end, source), "gaps")
    offer, offer_path = S.staged(spark, offered(official, missing, start, end, source).withColumn("day", F.to_date("bucket")), "offer")
    merged = S.merge_into(spark, path, offer, "day", lambda s, n: M.merge_exchange(s.drop("day"), n.drop("day")).withColumn("day", F.to_date("bucket")))
    counts, _ = S.staged(spark, S.changed_count(merged).select(F.col("changed_rows").alias("filled")), "filled")
    out, _ = S.staged(spark, summarized(missing, offer).select("*", counts.scalar().alias("filled")), "repair-summary")
    for stage in (gaps_path, offer_path):
        drop_path(spark, stage)
    return out


def store_candles(spark: SparkSession, root: str, minutes: DataFrame, days: DataFrame) -> None:
    """First load of the two candle tables as one commit of days."""
    publish(spark, root, {"minutes": minutes.withColumn("day", F.to_date("bucket")), "days": days.withColumn("day", F.col("trade_date"))}, "day", replace=True)


def stored_minutes(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "minutes", "day").drop("day")


def stored_days(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "days", "day").drop("day")


def confirm_day_into(spark: SparkSession, root: str, official_minutes: DataFrame, official_daily: DataFrame, traded: DataFrame, day: str,
                     source: str = "BINANCE", market_type: str = "CRYPTO") -> dict[str, int]:
    """Confirm one day in both stored candle tables by one commit: readers see the official rows in both or in none.

    No other day is read or written, and a day whose rows are confirmed already is not written again. Returns the numbers of changed
    minutes and days.
    """
    target = F.lit(day).cast("date")
    first = F.lit(day).cast("timestamp_ntz")
    on_day = lambda df: df.filter((F.col("source") == source) & (F.col("bucket") >= first) & (F.col("bucket") < first + F.expr("INTERVAL 1 DAY")))
    minutes, days = (read(spark, root, name, "day").filter(F.col("day") == target).drop("day") for name in ("minutes", "days"))
    symbols = on_day(minutes).select("symbol").distinct().join(traded.select("symbol"), "symbol", "left_semi")
    offer = lambda df: on_day(df).join(symbols, "symbol", "left_semi")
    new_minutes, a = S.staged(spark, M.merge_exchange(minutes, offer(official_minutes)).withColumn("day", target), "confirmed-minutes")
    daily = M.merge_daily_exchange(days, offer(official_daily), market_type)
    same = days.select(*M.DAILY_KEY, F.struct(*M.LIVE_VALUES, "tick_count", "origin", "market_type").alias("_was"))
    daily = daily.join(same, M.DAILY_KEY, "left").withColumn(
        "changed", F.col("changed") & ~F.struct(*M.LIVE_VALUES, "tick_count", "origin", "market_type").eqNullSafe(F.col("_was"))).drop("_was")
    new_days, b = S.staged(spark, daily.withColumn("day", target), "confirmed-days")
    changed = {"minutes": new_minutes.filter("changed").count(), "days": new_days.filter("changed").count()}
    if any(changed.values()):
        publish(spark, root, {"minutes": new_minutes.drop("changed"), "days": new_days.drop("changed")}, "day", replace=True)
    for stage in (a, b):
        drop_path(spark, stage)
    return changed


def confirm_day(candles: DataFrame, daily: DataFrame, official_minutes: DataFrame, official_daily: DataFrame, traded: DataFrame,
                day: Column, source: str = "BINANCE", market_type: str = "CRYPTO"):
    """Replace one day by official candles: merged minutes, merged daily rows, fresh daily coverage."""
    first, last = day.cast("timestamp_ntz"), (day.cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    on_day = lambda df: df.filter((F.col("source") == source) & (F.col("bucket") >= first) & (F.col("bucket") < last))
    symbols = on_day(candles).select("symbol").intersect(traded.select("symbol"))
    minutes = M.merge_exchange(candles, on_day(official_minutes).join(symbols, "symbol", "left_semi"))
    days = M.merge_daily_exchange(daily, on_day(official_daily).join(symbols, "symbol", "left_semi"), market_type)
    return minutes, days, V.coverage(days, "trade_date", 86400)
