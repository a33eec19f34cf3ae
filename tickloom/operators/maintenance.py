"""Table upkeep: retention, compaction, purge of a source, seeding of a past range."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.session import day_folders, drop_path, work_path
from tickloom.sources import sinks as S
from . import candles as C, merge as M

# Days kept.
TICK_DAYS, MINUTE_DAYS = 400, 1095


def _date(spark: SparkSession, value: Column):
    return spark.range(1).select(value.cast("date")).first()[0]


def expired_days(spark: SparkSession, path: str, day: str, today: Column, keep_days: int) -> DataFrame:
    """Day partitions past their retention, by the directory names: one row per day of the table at most."""
    rows = spark.createDataFrame([(d,) for d in day_folders(spark, path, day)], f"{day} string")
    return rows.select(F.col(day).cast("date").alias(day)).filter(F.col(day) < F.date_sub(today, keep_days))


def retain(spark: SparkSession, path: str, day: str, today: Column, keep_days: int) -> int:
    """Drop the day directories past their retention; kept days are not read or written."""
    days = [row[0] for row in expired_days(spark, path, day, today, keep_days).collect()]
    for d in days:
        drop_path(spark, f"{path}/{day}={d}")
    return len(days)


def compact(spark: SparkSession, path: str, day: str, before: Column, keys=("symbol", "source"), ts: str = "ts") -> None:
    """Rewrite old days into few files, each sorted by series and newest time first.

    Rows are split by ranges of (day, series, time), so a hot symbol spreads over several files.
    """
    limit = str(_date(spark, before))
    if not any(d < limit for d in day_folders(spark, path, day)):
        return
    stage = work_path(spark, "compact")
    old = spark.read.parquet(path).filter(F.col(day) < before)
    order = [F.col(day), *[F.col(k) for k in keys], F.col(ts).desc()]
    old.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(day).parquet(stage)
    (spark.read.schema(old.schema).parquet(stage).sortWithinPartitions(*order).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path))
    drop_path(spark, stage)


def _replace_days(spark: SparkSession, path: str, day: str, days: list[str], kept: DataFrame, name: str) -> None:
    """Put ``kept`` in the place of these days; days without a row lose their directory."""
    stage = work_path(spark, name)
    kept.write.partitionBy(day).parquet(stage)
    left = set(day_folders(spark, stage, day))
    if left:
        S.overwrite_days(spark.read.schema(kept.schema).parquet(stage), path, day)
    for d in days:
        if d not in left:
            drop_path(spark, f"{path}/{day}={d}")
    drop_path(spark, stage)


def purge_source(spark: SparkSession, ticks: str, minutes: str, source: str, start: Column, end: Column, day: str = "day",
                 daily: str | None = None) -> None:
    """Remove one source in [start, end) from the ticks and re-aggregate what was rolled up from them.

    Minutes that the range cuts are rolled up again from the ticks left in them. ``daily`` names the table of daily
    candles (partitioned by ``day`` as well), whose touched days are rolled up again.
    """
    in_range = (F.col("ts") >= start) & (F.col("ts") < end)
    bounds = str(_date(spark, start)), str(_date(spark, end))
    held = lambda path: [d for d in day_folders(spark, path, day) if bounds[0] <= d <= bounds[1]]
    touched = lambda path: spark.read.parquet(path).filter(F.col(day).between(*[F.lit(b).cast("date") for b in bounds]))
    shape = {path: spark.read.parquet(path).schema for path in (ticks, minutes, daily) if path}

    _replace_days(spark, ticks, day, held(ticks), touched(ticks).filter(~(in_range & (F.col("source") == source))), "purge-ticks")
    # a table that lost all its days can still be read as empty
    left = spark.read.schema(shape[ticks]).parquet(ticks).filter(F.col(day).between(*[F.lit(b).cast("date") for b in bounds]))

    minute = lambda c: F.date_trunc("minute", c.cast("timestamp")).cast("timestamp_ntz")
    first, last = minute(start), minute(end)
    last = F.when(last < end, last + F.expr("INTERVAL 1 MINUTE")).otherwise(last)
    hit = (F.col("bucket") >= first) & (F.col("bucket") < last)
    stored = touched(minutes)
    again = C.minute_ohlcv(left.filter((F.col("ts") >= first) & (F.col("ts") < last)))
    again = again.withColumn(day, F.to_date("bucket")).select(*stored.columns)
    _replace_days(spark, minutes, day, held(minutes), stored.filter(~hit).unionByName(again), "purge-minutes")

    if daily:
        again = C.daily_ohlcv(left).withColumn(day, F.col("trade_date"))
        _replace_days(spark, daily, day, held(daily), again.select(*shape[daily].names), "purge-daily")


def seed_live(spark: SparkSession, table: str, ticks: DataFrame, start: Column, end: Column) -> DataFrame:
    """Copy a past range of minutes into the stored candles; all days of the range run in one job."""
    rollup = C.minute_ohlcv(ticks.filter((F.col("ts") >= start) & (F.col("ts") < end))).drop("trade_count")
    incoming = rollup.withColumn("day", F.to_date("bucket"))
    return S.merge_into(spark, table, incoming, "day",
                        lambda s, n: M.merge_live(s.drop("day"), n.drop("day")).withColumn("day", F.to_date("bucket")))
