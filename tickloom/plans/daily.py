"""The daily batch in order: candles, previous closes, indicators, validation.

``run`` derives everything from all ticks. ``run_day`` does one target date and keeps the tables up to date:

=============  ==============================  =====================================================
folder         partition                       rows
=============  ==============================  =====================================================
candles        trade_date                      one per symbol and source, upserted, official rows stay
prev_close     asof                            newest close per symbol up to that day
carry          asof                            the newest ``LOOKBACK`` bars per symbol up to that day
indicators     trade_date                      one per symbol with a bar that day
validation     target_date                     one row
=============  ==============================  =====================================================

A run reads the ticks of its date, the candles of its date and the day before, and the newest carry before its date. Candle days
between that carry and the date are read too; there are none in a daily schedule. A run whose candles changed drops the carries of
later days, so the days after it, run again, start from the corrected ones.
"""
from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.functions.pricing import sane_candle
from tickloom.functions.timeparse import floor_bucket
from tickloom.operators import candles as C, dedup as U, indicators as I, merge as M, validation as V
from tickloom.session import day_folders, drop_path, folder, work_path
from tickloom.sources import sinks as S

#: Days whose carry is kept; an older date that runs again reads the candles since the carry before it.
CARRIES = 8
BAR = ["symbol", "trade_date", "source", "open", "high", "low", "close", "volume"]


def run(spark: SparkSession, ticks: DataFrame) -> dict[str, DataFrame]:
    """Roll ticks up and derive everything else from the stored candles; every step is a table."""
    root = work_path(spark, "daily")

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    daily = store(C.daily_ohlcv(ticks).filter(sane_candle()), "candles")
    prev = store(C.previous_close(daily), "prev_close")
    indicators = store(I.daily_indicators(U.first_source(daily), keys=("symbol",)), "indicators")
    vanished = V.vanished_symbols(daily).agg(F.count("*").alias("n")).scalar()
    checks = daily.agg(
        vanished.alias("vanished"), F.count_if(~sane_candle()).alias("anomalies"),
        V.extreme_moves(daily).agg(F.count("*").alias("n")).scalar().alias("extremes"),
        V.without_indicators(daily, indicators).agg(F.count("*").alias("n")).scalar().alias("without_indicators"))
    return {"candles": daily, "prev_close": prev, "indicators": indicators, "validation": store(checks, "validation")}


def _complete(spark: SparkSession, path: str) -> list[str]:
    """Days of a table whose write was finished."""
    files, _ = folder(spark, path)
    done = spark._jvm.org.apache.hadoop.fs.Path
    return [d for d in day_folders(spark, path, "asof") if files.exists(done(f"{path}/asof={d}/_SUCCESS"))]


def _candles_between(spark: SparkSession, root: str, after: str | None, before: str) -> DataFrame | None:
    """Stored candles with after < trade_date < before; only their directories are read."""
    days = [d for d in day_folders(spark, f"{root}/candles", "trade_date") if (after or "") < d < before]
    return S.touched(spark.read.parquet(f"{root}/candles"), [date.fromisoformat(d) for d in days], "trade_date") if days else None


def _bars(candles: DataFrame) -> DataFrame:
    return U.first_source(candles.select(*BAR))


def _close_rows(candles: DataFrame) -> DataFrame:
    """symbol, trade_date, source, close of each symbol's newest candle; the last source name settles a day with several."""
    newest = candles.groupBy("symbol").agg(F.max_by(F.struct("trade_date", "source", "close"), F.struct("trade_date", "source")).alias("r"))
    return newest.select("symbol", "r.*")


def _history(spark: SparkSession, root: str, name: str, day: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Rows of a carried table as of the day before ``day``: its newest partition and what the candles since then add."""
    asof = max((d for d in _complete(spark, f"{root}/{name}") if d < day), default=None)
    since = _candles_between(spark, root, asof, day)
    known = spark.read.parquet(f"{root}/{name}/asof={asof}") if asof else None
    parts = [x for x in (known, of(since) if since is not None else None) if x is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else None


def _with(history: DataFrame | None, rows: DataFrame) -> DataFrame:
    return rows if history is None else history.select(*rows.columns).unionByName(rows)


def _save_asof(spark: SparkSession, rows: DataFrame, path: str, day: str, stale: bool) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/asof={day}")
    days = day_folders(spark, path, "asof")
    old = [d for d in days if d < day][:-CARRIES + 1]
    for d in [*old, *(d for d in days if d > day and stale)]:
        drop_path(spark, f"{path}/asof={d}")


def _candles_of(ticks: DataFrame, computed_at: Column | None) -> DataFrame:
    at = F.current_timestamp() if computed_at is None else computed_at
    return C.daily_ohlcv(ticks).filter(sane_candle()).withColumns({
        "origin": F.lit(None).cast("string"), "computed_at": at.cast("timestamp_ntz")})


def backfill(spark: SparkSession, ticks: DataFrame, root: str, until: str, computed_at: Column | None = None) -> None:
    """First load: candles and indicators of all days up to ``until`` at once, and the carried tables as of that day."""
    upto = ticks.filter(floor_bucket("ts", 86400).cast("date") <= F.lit(until).cast("date"))
    S.overwrite_days(_candles_of(upto, computed_at), f"{root}/candles", "trade_date")
    candles = spark.read.parquet(f"{root}/candles")
    S.overwrite_days(I.daily_indicators(_bars(candles), keys=("symbol",)), f"{root}/indicators", "trade_date")
    _save_asof(spark, _close_rows(candles), f"{root}/prev_close", until, True)
    _save_asof(spark, U.newest_per_key(_bars(candles), ["symbol"], I.LOOKBACK, F.col("trade_date")), f"{root}/carry", until, True)


def run_day(spark: SparkSession, ticks: DataFrame, root: str, day: str, computed_at: Column | None = None) -> DataFrame:
    """The daily batch of one target date (``YYYY-MM-DD``, UTC); returns its validation row.

    ``ticks`` may be a table partitioned by a column ``day``; then only that directory is read. Running a date again gives the
    same tables.
    """
    target = F.lit(day).cast("date")
    start = F.lit(day).cast("timestamp_ntz")
    own = ticks.filter((F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 1 DAY")))
    if "day" in ticks.columns:
        own = own.filter(F.col("day") == target)
    fresh, path = _candles_of(own, computed_at), f"{root}/candles"
    if S.table_exists(spark, path):
        merged = S.merge_into(spark, path, fresh, "trade_date", lambda s, n: M.merge_daily_rollup(s, n, computed_at, only_changes=True))
        stale = not merged.filter("changed").isEmpty()
    else:
        S.overwrite_days(fresh, path, "trade_date")
        stale = False
    stored = [d for d in day_folders(spark, path, "trade_date") if d == day]
    candles = S.touched(spark.read.parquet(path), [date.fromisoformat(d) for d in stored], "trade_date")

    closes = _with(_history(spark, root, "prev_close", day, _close_rows), _close_rows(candles))
    _save_asof(spark, _close_rows(closes), f"{root}/prev_close", day, stale)

    bars = _with(_history(spark, root, "carry", day, _bars), _bars(candles))
    newest = U.newest_per_key(bars, ["symbol"], I.LOOKBACK, F.col("trade_date"))
    _save_asof(spark, newest, f"{root}/carry", day, stale)
    carried = spark.read.parquet(f"{root}/carry/asof={day}")
    active = carried.join(carried.filter(F.col("trade_date") == target).select("symbol"), "symbol", "left_semi")
    todays = I.daily_indicators(active, keys=("symbol",)).filter(F.col("trade_date") == target)
    S.overwrite_days(todays, f"{root}/indicators", "trade_date")

    checks = validate_day(spark, root, day)
    checks.write.mode("overwrite").parquet(f"{root}/validation/target_date={day}")
    return spark.read.parquet(f"{root}/validation/target_date={day}")


def validate_day(spark: SparkSession, root: str, day: str) -> DataFrame:
    """Counts of one target date: vanished symbols, bad candles, extreme moves, candles without indicators."""
    target, before = date.fromisoformat(day), date.fromisoformat(day) - timedelta(days=1)
    both = S.touched(spark.read.parquet(f"{root}/candles"), [before, target], "trade_date")
    own = both.filter(F.col("trade_date") == F.lit(target))
    indicators = S.touched(spark.read.parquet(f"{root}/indicators"), [target], "trade_date")
    on_target = F.col("trade_date") == F.lit(target)
    n = F.count(F.lit(1)).alias("n")
    return own.agg(
        V.vanished_symbols(both).filter(on_target).agg(n).scalar().alias("vanished"), F.count_if(~sane_candle()).alias("anomalies"),
        V.extreme_moves(both).filter(on_target).agg(n).scalar().alias("extremes"),
        V.without_indicators(own, indicators).agg(n).scalar().alias("without_indicators"))


def previous_closes(spark: SparkSession, root: str, day: str) -> DataFrame:
    """symbol, prev_close as of a day that was run."""
    return spark.read.parquet(f"{root}/prev_close/asof={day}").select("symbol", F.col("close").alias("prev_close"))
