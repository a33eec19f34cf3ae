"""Streaming jobs over the tick stream.

Every ``foreachBatch`` write is keyed by the batch id or by the rows' own key, so a batch that runs
again after a lost executor gives the same table.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.functions import pricing as P
from tickloom.operators import candles as C, market as K, merge as M, normalize as N
from tickloom.session import drop_path, work_path
from tickloom.sources import sinks as S

# Horizons and limits of the live paths.
CANDLE_HORIZON, REDELIVERY_WINDOW, MAX_RETRIES, PRICE_TTL_SECONDS = "3 hours", "600 seconds", 3, 60
TICK_KEY = ["symbol", "source", "trade_id", "ts"]
ATTEMPT_KEY = ["topic", "partition", "offset", "retry_count"]


def read_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Tick topic as a stream of JSON values (needs the Kafka package on the cluster)."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
           .option("startingOffsets", "earliest").load())
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "partition", "offset")


def read_files(spark: SparkSession, path: str, schema, glob: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    """The same stream from Parquet files, oldest first."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def with_event_time(ticks: DataFrame, delay: str) -> DataFrame:
    """Watermarks need a zoned timestamp; files may hold a zone-less one."""
    return ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def drain(stream: DataFrame, name: str, write: Callable[[DataFrame, int], None], mode: str = "append",
          checkpoint: str | None = None) -> int:
    """Run a stream over everything available now; returns the number of rows read.

    ``checkpoint`` is the folder a later run resumes from; without one the run starts fresh in the
    shared folder.
    """
    spark = stream.sparkSession
    where = checkpoint or work_path(spark, f"{name}-checkpoint")
    query = (stream.writeStream.outputMode(mode).trigger(availableNow=True)
             .option("checkpointLocation", where).foreachBatch(write).start())
    query.awaitTermination()
    return sum(max(0, p["numInputRows"]) for p in query.recentProgress)


def batch_table(path: str) -> Callable[[DataFrame, int], None]:
    """Writer that puts each batch in its own directory and replaces it when the batch runs again."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def newest_updates(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """Last update per key of a batch table."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*key, "r.*")


def minute_candles(ticks: DataFrame) -> DataFrame:
    """1-minute candles kept fresh while ticks of the last hours may still arrive (update mode)."""
    return C.minute_ohlcv(with_event_time(ticks, CANDLE_HORIZON))


def live_candles_into(spark: SparkSession, ticks: DataFrame, table: str, checkpoint: str | None = None) -> None:
    """Candle updates merged into the stored table: a late tick re-opens its minute, official rows stay.

    The merge stages the updates of a batch, so the stateful part of the plan runs a single time per batch; a batch
    that comes again changes nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        live = batch.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")).drop("trade_count")
        live = live.withColumn("day", F.to_date("bucket"))
        S.merge_into(spark, table, live, "day", lambda s, n: M.merge_live(s.drop("day"), n.drop("day")).withColumn("day", F.to_date("bucket")))
    drain(minute_candles(ticks), "live-candles", write, "update", checkpoint)


def stored_candles_into(spark: SparkSession, ticks: DataFrame, table: str, checkpoint: str | None = None) -> None:
    """The plain candle sink: one stored row per candle, replaced by its newer update."""
    def write(batch: DataFrame, batch_id: int) -> None:
        live = batch.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")).withColumn("day", F.to_date("bucket"))
        if not S.table_exists(spark, table):
            S.overwrite_days(live, table, "day")
            return
        S.merge_into(spark, table, live, "day", lambda s, n: M.merge_newest(s, n, [*M.CANDLE_KEY, "day"]))
    drain(minute_candles(ticks), "candles", write, "update", checkpoint)


def without_redelivery(ticks: DataFrame, within: str = REDELIVERY_WINDOW) -> DataFrame:
    """Drop repeats of a tick key that arrive within the redelivery window."""
    return with_event_time(ticks, within).dropDuplicatesWithinWatermark(TICK_KEY)


def newer(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One row per symbol: the one with the newer time, the new one at equal times."""
    cols = [c for c in new.columns if c != "symbol"]
    both = stored.withColumn("_o", F.lit(0)).unionByName(new.select(*stored.columns).withColumn("_o", F.lit(1)))
    return both.groupBy("symbol").agg(F.max_by(F.struct(*cols), F.struct("ts", "_o")).alias("r")).select("symbol", "r.*")


def latest_prices_into(spark: SparkSession, ticks: DataFrame, prev_close: DataFrame, path: str, dead: str | None = None,
                       checkpoint: str | None = None) -> None:
    """Newest price per symbol with its change against the previous close, one row per symbol in the table.

    Ticks with a price that is not positive go to the dead letters. Each task keeps one row per symbol before the shuffle,
    so a hot symbol costs no more than a quiet one. The previous closes are stored once for all batches.
    """
    closes, closes_path = S.staged(spark, prev_close, "prev-close")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows, stage = S.staged(spark, batch, "price-batch")
        good = F.coalesce(P.valid_price("price"), F.lit(False))
        if dead:
            S.append_new(spark, rows.filter(~good).withColumn("day", F.to_date("ts")), dead, TICK_KEY, "day")
        merge_keyed(spark, path, K.snapshots(C.newest_trade(rows.filter(good)), closes), newer)
        drop_path(spark, stage)
    try:
        drain(ticks, "latest-prices", write, checkpoint=checkpoint)
    finally:
        drop_path(spark, closes_path)


def newest_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def live_snapshots(spark: SparkSession, path: str, now: Column, ttl_seconds: int = PRICE_TTL_SECONDS) -> DataFrame:
    """Latest prices younger than their time to live."""
    return K.active_snapshots(newest_snapshots(spark, path), now, ttl_seconds)


def batch_latest_into(spark: SparkSession, events: DataFrame, path: str, dead: str, checkpoint: str | None = None) -> None:
    """Micro-batch path: records that break the contract go to the dead letters, the rest gives one row per symbol."""
    def write(batch: DataFrame, batch_id: int) -> None:
        parsed, stage = S.staged(spark, N.parse_events(batch, keep=("event_id",)), "event-batch")
        bad = parsed.filter(~F.col("is_valid")).select("event_id", "raw", "violations", F.lit(0).alias("part"))
        S.append_new(spark, bad, dead, ["event_id", "raw"], "part")
        valid = parsed.filter("is_valid").select("event_id", "symbol", "source", "price", "volume", "exchange", "ts", "market_type")
        merge_keyed(spark, path, C.newest_trade(valid), newer)
        drop_path(spark, stage)
    drain(events, "batch-latest", write, checkpoint=checkpoint)


def store_ticks_into(spark: SparkSession, ticks: DataFrame, table: str, instruments: str, checkpoint: str | None = None) -> None:
    """Storage path: insert new ticks, then refresh the instruments seen in the batch.

    Both tables are merged by their own keys, so a batch may come again, from this checkpoint or a new one.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows, stage = S.staged(spark, batch.withColumn("day", F.to_date("ts")), "tick-batch")
        S.append_new(spark, rows, table, TICK_KEY, "day")
        merge_keyed(spark, instruments, N.instruments_of(rows), N.upsert_instruments)
        drop_path(spark, stage)
    drain(ticks, "store-ticks", write, checkpoint=checkpoint)


def merge_keyed(spark: SparkSession, path: str, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame],
                key: str = "symbol", parts: int = 8) -> None:
    """Merge rows into a small table with one row per key, kept in ``parts`` partitions by the key."""
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")
    if not S.table_exists(spark, path):
        S.overwrite_days(new.select("*", part), path, "part")
        return
    S.merge_into(spark, path, new.select("*", part), "part",
                 lambda s, n: merge(s.drop("part"), n.drop("part")).select("*", part, F.lit(True).alias("changed")))


def stored_instruments(spark: SparkSession, instruments: str) -> DataFrame:
    return spark.read.parquet(instruments).drop("part")


def route(failed: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Route of a failed record: retry while the error may pass and attempts are left, else dead letter."""
    again = P.is_retryable("error_type") & (F.col("retry_count") < max_retries)
    return failed.withColumn("route", F.when(again, "RETRY").otherwise("DLQ"))


def route_into(spark: SparkSession, failed: DataFrame, dead: str, retry: str, checkpoint: str | None = None) -> int:
    """Failed records to the dead letters or, with the next attempt's number, to the retry store; returns the number of rows read.

    Both are tables keyed by ``ATTEMPT_KEY`` that only take what they lack, so a batch may come again, from this checkpoint or from a new
    one, and no record is lost or stored twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        routed, stage = S.staged(spark, route(batch), "routed-batch")
        try:
            S.append_new(spark, routed.filter(F.col("route") == "DLQ").drop("route"), dead, ATTEMPT_KEY, "retry_count")
            again = routed.filter(F.col("route") == "RETRY").drop("route").withColumn("retry_count", F.col("retry_count") + 1)
            S.append_new(spark, again, retry, ATTEMPT_KEY, "retry_count")
        finally:
            drop_path(spark, stage)
    return drain(failed, "route", write, checkpoint=checkpoint)


def retry_all(spark: SparkSession, schema, dead: str, retry: str, checkpoint: str | None = None) -> int:
    """Stream the retry store until no attempt is left; returns the number of attempts.

    One stream reads the store of all attempts. Attempts that fail again come back to it as new files, which its next run takes.
    """
    checkpoint = checkpoint or work_path(spark, "retry-checkpoint")
    attempts = 0
    while read := route_into(spark, read_files(spark, retry, schema), dead, retry, checkpoint):
        attempts += read
    return attempts


def settled(minutes: DataFrame, now: Column, lookback_minutes: int, settle_minutes: int) -> DataFrame:
    """Minutes old enough to be final and young enough to be looked at again."""
    from tickloom.functions.timeparse import settled_window
    start, end = settled_window(now, lookback_minutes, settle_minutes)
    return minutes.filter((F.col("bucket") >= start) & (F.col("bucket") < end))
