"""Jobs that rewrite stored tables: purge, compaction, merges, live tables after a restart."""
import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tickloom.operators import candles as C, maintenance as MT, merge as M
from tickloom.session import day_folders, folder, work_path
from tickloom.sources import adapters as A, sinks as S
from tickloom.streaming import jobs as J

T0 = dt.datetime(2026, 9, 20, 10, 0)
TICK = "event_id long, symbol string, source string, trade_id string, price decimal(24,8), volume decimal(24,8), exchange string, ts timestamp_ntz, market_type string"


def ticks(spark, *rows):
    """Rows of (seconds after T0, price, source, symbol)."""
    return spark.createDataFrame([(i, sym, src, str(i), D(p), D(1), "X", T0 + dt.timedelta(seconds=s), "CRYPTO") for i, (s, p, src, sym) in enumerate(rows)], TICK)


def tables(spark, t):
    paths = [work_path(spark, n) for n in ("ticks", "minutes", "daily")]
    for path, df, ts in zip(paths, (t, C.minute_ohlcv(t), C.daily_ohlcv(t)), ("ts", "bucket", "trade_date")):
        S.write_table(df.withColumn("day", F.to_date(ts)), path, "day")
    return paths


def at(seconds):
    return F.lit(T0 + dt.timedelta(seconds=seconds)).cast("timestamp_ntz")


DAY = 86400


def test_purge_cut_minutes_and_emptied_days(spark):
    t = ticks(spark, (5, 100, "A", "S"), (50, 102, "A", "S"), (20, 7, "B", "S"), (DAY, 9, "A", "S"))
    ticks_at, minutes, daily = tables(spark, t)
    MT.purge_source(spark, ticks_at, minutes, "A", at(0), at(30), daily=daily)  # the range ends inside the minute
    left = {(r.source, float(r.close), r.trade_count) for r in spark.read.parquet(minutes).filter("day = '2026-09-20'").collect()}
    assert left == {("A", 102.0, 1), ("B", 7.0, 1)}
    MT.purge_source(spark, ticks_at, minutes, "A", at(DAY - 3600), at(DAY + 3600), daily=daily)  # this day holds nothing else
    for path in (ticks_at, minutes, daily):
        assert day_folders(spark, path, "day") == ["2026-09-20"]
    assert {(r.source, r.tick_count) for r in spark.read.parquet(daily).collect()} == {("A", 1), ("B", 1)}


def test_purge_leaves_nothing(spark):
    paths = tables(spark, ticks(spark, (5, 100, "A", "S"), (DAY, 9, "A", "S")))
    MT.purge_source(spark, *paths[:2], "A", at(-DAY), at(3 * DAY), daily=paths[2])
    assert [day_folders(spark, p, "day") for p in paths] == [[], [], []]


def test_compaction_without_old_days(spark):
    path = tables(spark, ticks(spark, (5, 100, "A", "S")))[0]
    MT.compact(spark, path, "day", F.lit("2020-01-01").cast("date"))
    assert spark.read.parquet(path).count() == 1
    MT.compact(spark, path, "day", F.lit("2027-01-01").cast("date"))
    assert spark.read.parquet(path).count() == 1


def changed_at(spark, path):
    files, _ = folder(spark, path)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    return {d: files.listStatus(Path(f"{path}/day={d}"))[0].getModificationTime() for d in day_folders(spark, path, "day")}


def test_merge_writes_only_days_with_changes(spark):
    t = ticks(spark, *[(k * DAY, 100 + k, "A", "S") for k in range(5)])
    path = work_path(spark, "stored")
    rows = C.minute_ohlcv(t).drop("trade_count").withColumns({"quote_volume": F.lit(None).cast("decimal(32,8)"), "trade_count": F.lit(None).cast("long"),
                                                             "origin": F.lit("LIVE"), "day": F.to_date("bucket")})
    S.write_table(rows, path, "day")
    before = changed_at(spark, path)
    new = rows.filter(F.dayofmonth("day").isin(20, 22, 24)).withColumn("close", F.when(F.dayofmonth("day") != 22, F.lit(1).cast("decimal(24,8)")).otherwise(F.col("close")))
    merged = S.merge_into(spark, path, new, "day", lambda s, n: M.merge_live(s.drop("day"), n.drop("day")).withColumn("day", F.to_date("bucket")))
    assert S.changed_count(merged).first()[0] == 2
    after = changed_at(spark, path)
    assert {d[-2:] for d in before if before[d] != after[d]} == {"20", "24"} and spark.read.parquet(path).count() == 5


def stream(spark, path, schema):
    return J.read_files(spark, path, schema, per_trigger=1)


@pytest.mark.parametrize("fresh", [False, True])
def test_live_tables_after_a_restart(spark, sf, fresh):
    """The second half arrives after a restart, from the checkpoint or from a lost one, with a symbol not seen before."""
    t = A.ticks(spark, sf, dense=True)
    path, ckpt = work_path(spark, "in"), work_path(spark, "ckpt")
    late = (F.col("event_id") >= 500) | (F.col("symbol") == "VIEW")
    inst, ticks_at, candles, latest, dead = (work_path(spark, n) for n in ("inst", "ticks", "candles", "latest", "dead"))
    closes = t.groupBy("symbol").agg(F.min("price").alias("prev_close"))
    bad = F.when(F.col("event_id") % 50 == 0, F.lit(-1).cast("decimal(24,8)")).otherwise(F.col("price"))
    for k, part in enumerate((t.filter(~late), t.filter(late))):
        part.withColumn("price", bad).coalesce(1).write.mode("append").parquet(path)
        where = (lambda n: None) if fresh else (lambda n: f"{ckpt}-{n}")
        J.store_ticks_into(spark, stream(spark, path, t.schema), ticks_at, inst, where("ticks"))
        J.latest_prices_into(spark, stream(spark, path, t.schema), closes, latest, dead, where("latest"))
        J.stored_candles_into(spark, stream(spark, path, t.schema), candles, where("candles"))
    assert spark.read.parquet(ticks_at).count() == t.count()
    assert {r.symbol for r in J.stored_instruments(spark, inst).collect()} == {r.symbol for r in t.select("symbol").distinct().collect()}
    newest = {r.symbol: r.ts for r in t.filter("event_id % 50 <> 0").groupBy("symbol").agg(F.max("ts").alias("ts")).collect()}
    assert {r.symbol: r.ts for r in J.newest_snapshots(spark, latest).collect()} == newest
    assert spark.read.parquet(dead).count() == t.filter("event_id % 50 = 0").count()
    now = F.lit(max(newest.values()) + dt.timedelta(seconds=59)).cast("timestamp_ntz")
    alive = {s for s, x in newest.items() if x > max(newest.values()) - dt.timedelta(seconds=1)}
    assert {r.symbol for r in J.live_snapshots(spark, latest, now).collect()} == alive
    if not fresh:  # with its state kept, every candle is that of a batch over all ticks
        want = C.minute_ohlcv(t.withColumn("price", bad)).select("symbol", "bucket", "source", "close", "trade_count")
        got = spark.read.parquet(candles).select("symbol", "bucket", "source", "close", "trade_count")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
