"""Latest prices as keyed state that expires: one value per symbol with a time to live, in RocksDB.

The state of a symbol is its newest tick. A tick that is newer replaces it and starts its time to live again; when that has passed
without one, a timer drops the state and the stream says so. Both changes go to a table with one row per symbol, so readers see which
prices are active without looking at a clock.

The time to live counts from the tick's own time against the newest tick of the stream, so a replay gives the same rows at any speed. Timers
of the processing time are not used: a run over what is available now would wait for them.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions import pricing as P
from tickloom.operators import market as K
from tickloom.session import drop_path, with_conf, work_path
from tickloom.sources import sinks as S
from .jobs import PRICE_TTL_SECONDS, TICK_KEY, drain, merge_keyed

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
#: The state of a symbol; ``at`` is the tick's time in epoch microseconds.
TICK = "price decimal(24,8), volume decimal(24,8), exchange string, market_type string, at long, event_id long"
FIELDS = [f.split()[0] for f in TICK.split(", ")]
CHANGE = f"symbol string, kind string, {TICK}"


class LatestPrice(StatefulProcessor):
    """Newest tick of a symbol; emits PRICE when it changes and EXPIRED when its time to live has passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", TICK)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = max(rows, key=lambda r: (r.at, r.event_id))
        held = self.newest.get() if self.newest.exists() else None
        if held is not None and tuple(held)[-2:] >= (best.at, best.event_id):
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        values = tuple(getattr(best, f) for f in FIELDS)
        self.newest.update(values)
        # the watermark runs one time to live behind the newest tick, so a tick is over when the watermark passes its own time
        self.handle.registerTimer(best.at // 1000 - 1)
        yield Row(symbol=key[0], kind="PRICE", **dict(zip(FIELDS, values)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.newest.exists():
            values = self.newest.get()
            self.newest.clear()
            yield Row(symbol=key[0], kind="EXPIRED", **dict(zip(FIELDS, values)))

    def close(self) -> None:
        pass


def newest_of_batches(ticks: DataFrame) -> DataFrame:
    """The newest tick per symbol of each Arrow batch, before the shuffle: a symbol with most of the ticks sends few."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch]).sort_by([("at", "ascending"), ("event_id", "ascending")])
                rows = rows.append_column("_i", pa.array(range(rows.num_rows), pa.int64()))
                last = rows.group_by("symbol").aggregate([("_i", "max")]).column("_i_max")
                yield from rows.drop_columns(["_i"]).take(last).combine_chunks().to_batches()
    return ticks.mapInArrow(run, ticks.schema)


def price_changes(ticks: DataFrame, ttl_seconds: int = PRICE_TTL_SECONDS) -> DataFrame:
    """PRICE and EXPIRED rows of a stream of ticks with good prices."""
    ticks = ticks.withColumns({"ts": F.col("ts").cast("timestamp"), "at": F.unix_micros(F.col("ts").cast("timestamp"))})
    slim = newest_of_batches(ticks.select("symbol", "ts", *[F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in TICK.split(", ")]))
    timed = slim.withWatermark("ts", f"{ttl_seconds} seconds")
    changes = timed.groupBy("symbol").transformWithState(LatestPrice(), CHANGE, "Update", "EventTime")
    return changes.withColumn("ts", F.timestamp_micros("at").cast("timestamp_ntz"))


def _newest_state(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One row per symbol: the newer tick; of one tick the expiry over the price."""
    cols = [c for c in new.columns if c != "symbol"]
    both = stored.unionByName(new.select(*stored.columns))
    return both.groupBy("symbol").agg(F.max_by(F.struct(*cols), F.struct("ts", "event_id", ~F.col("active"))).alias("r")).select("symbol", "r.*")


def expiring_prices_into(spark: SparkSession, ticks: DataFrame, prev_close: DataFrame, path: str, dead: str, checkpoint: str | None = None,
                         ttl_seconds: int = PRICE_TTL_SECONDS) -> None:
    """Keep ``path`` at one row per symbol: newest price, change against the previous close, and whether it is active.

    Ticks with a price that is not positive go to the dead letters ``dead``, each once, however often the stream starts again.
    """
    checkpoint = checkpoint or work_path(spark, "expiring-prices-checkpoint")
    good = F.coalesce(P.valid_price("price"), F.lit(False))

    def bury(batch: DataFrame, batch_id: int) -> None:
        S.append_new(spark, batch.withColumn("day", F.to_date("ts")), dead, TICK_KEY, "day")
    drain(ticks.filter(~good), "dead-prices", bury, checkpoint=f"{checkpoint}/dead")

    closes, closes_path = S.staged(spark, prev_close, "prev-close")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows, stage = S.staged(spark, batch, "price-changes")
        try:
            newest = rows.groupBy("symbol").agg(F.max_by(F.struct("kind", "ts", *FIELDS), F.struct("at", "event_id", F.col("kind") == "EXPIRED")).alias("r"))
            newest = newest.select("symbol", "r.*")
            priced = K.snapshots(newest, closes).join(newest.select("symbol", "event_id", (F.col("kind") == "PRICE").alias("active")), "symbol")
            merge_keyed(spark, path, priced, _newest_state)
        finally:
            drop_path(spark, stage)
    try:
        with with_conf(spark, ROCKSDB):
            drain(price_changes(ticks.filter(good), ttl_seconds), "expiring-prices", write, "update", f"{checkpoint}/prices")
    finally:
        drop_path(spark, closes_path)


def active_prices(spark: SparkSession, path: str) -> DataFrame:
    """Prices whose time to live has not passed."""
    return spark.read.parquet(path).filter("active").drop("part")
