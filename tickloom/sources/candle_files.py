"""Official candles: archive CSV files and kline JSON pages; stored OHLCV reads."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tickloom.functions.timeparse import archive_time, c
from tickloom.operators.dedup import newest_per_key
from tickloom.schemas import ARCHIVE_CSV

NUM = "decimal(24,8)"


def month_periods(first: Column, last: Column) -> Column:
    """'yyyy-MM' of every month from ``first`` to ``last``."""
    months = F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("INTERVAL 1 MONTH"))
    return F.transform(months, lambda d: F.date_format(d, "yyyy-MM"))


def typed_candles(df: DataFrame, *keep: str) -> DataFrame:
    """Text columns of an archive row to typed candle columns."""
    return df.select(
        *keep, archive_time("open_time").alias("bucket"), *[F.col(x).cast(NUM).alias(x) for x in ("open", "high", "low", "close")],
        F.col("volume").cast("decimal(32,8)").alias("volume"), archive_time("close_time").alias("close_time"),
        F.col("quote_volume").cast("decimal(32,8)").alias("quote_volume"), F.col("trade_count").cast("long").alias("trade_count"))


def read_archive_csv(spark: SparkSession, path: str, *keep: str) -> DataFrame:
    """Archive candles below ``path``; lines that do not start with a digit are skipped.

    ``keep`` names directory columns such as ``symbol`` and ``period``.
    """
    schema = T.StructType(list(ARCHIVE_CSV.fields) + [T.StructField(k, T.StringType()) for k in keep])
    raw = spark.read.schema(schema).csv(path)
    return typed_candles(raw.filter(F.col("open_time").rlike("^[0-9]")), *keep)


def parse_kline_page(pages: DataFrame, payload: str, now: Column, start: Column, end: Column,
                     keep: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Kline pages (JSON array of arrays) to closed candles of [start, end)."""
    rows = pages.select(*keep, F.explode(F.from_json(payload, "array<array<string>>")).alias("r"))
    named = rows.select(*keep, *[F.col("r")[i].alias(n) for i, n in enumerate(
        ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trade_count"])])
    typed = typed_candles(named, *keep)
    return typed.filter((F.col("close_time") < now) & (F.col("bucket") >= start) & (F.col("bucket") < end))


def load_ohlcv(candles: DataFrame, ts: str, limit: int, source: str | None = None) -> DataFrame:
    """Newest ``limit`` rows per symbol and source, numbers coerced to double (bad text to NULL)."""
    rows = candles if source is None else candles.filter(F.col("source") == source)
    num = lambda x: F.col(x).try_cast("double").alias(x)
    newest = newest_per_key(rows, ["symbol", "source"], limit, c(ts))
    return newest.select("symbol", "source", F.col(ts).alias("ts"), *[num(x) for x in ("open", "high", "low", "close", "volume")])


def load_range(candles: DataFrame, ts: str, start: Column, end: Column, source: str | None = None) -> DataFrame:
    """Rows of [start, end)."""
    rows = candles.filter((F.col(ts) >= start) & (F.col(ts) < end))
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    num = lambda x: F.col(x).try_cast("double").alias(x)
    return rows.select("symbol", "source", F.col(ts).alias("ts"), *[num(x) for x in ("open", "high", "low", "close", "volume")])


def read_ticks(spark: SparkSession, path: str, start: Column, end: Column, symbol: str | None = None,
               source: str | None = None) -> DataFrame:
    """Ticks of a table partitioned by ``trade_date``; the day bounds prune partitions."""
    ticks = spark.read.parquet(path)
    ticks = ticks.filter((F.col("trade_date") >= start.cast("date")) & (F.col("trade_date") <= end.cast("date"))
                         & (F.col("ts") >= start) & (F.col("ts") < end))
    if symbol:
        ticks = ticks.filter(F.col("symbol") == symbol.upper())
    if source:
        ticks = ticks.filter(F.col("source") == source.upper())
    return ticks
