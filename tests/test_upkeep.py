"""Jobs that keep tables up to date: daily job of a date, expiring prices, retries, linked commits, exact quantiles."""
import datetime as dt
import random
import statistics
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tickloom.operators import candles as C, indicators as I, merge as M, metrics as ME, ranks as RK, validation as V
from tickloom.plans import daily as DP, repair as RP
from tickloom.session import day_folders, drop_path, work_path
from tickloom.sources import commits as CM, sinks as S
from tickloom.streaming import jobs as J, prices as PS

TICK = "event_id long, symbol string, source string, trade_id string, price decimal(24,8), volume decimal(24,8), exchange string, ts timestamp_ntz, market_type string"
START = dt.date(2025, 1, 1)


def same(a, b):
    cols = sorted(a.columns)
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def daily_ticks(spark, days=80, seed=1):
    """Two symbols, several ticks a day; B has no ticks on every ninth day and two sources on some."""
    rnd, rows = random.Random(seed), []
    for d in range(days):
        for symbol in "AB":
            if symbol == "B" and d % 9 == 4:
                continue
            for k in range(3):
                source = "ALPACA" if symbol == "B" and d % 5 == 0 and k == 2 else "BINANCE"
                at = dt.datetime.combine(START + dt.timedelta(days=d), dt.time(3 * k + 1, rnd.randrange(60), rnd.randrange(60)))
                rows.append((len(rows), symbol, source, str(len(rows)), D(f"{rnd.uniform(90, 110):.4f}"), D(rnd.randint(1, 9)), "X", at, "CRYPTO"))
    return spark.createDataFrame(rows, TICK).withColumn("day", F.to_date("ts"))


def tables(spark, root, last):
    return {"candles": spark.read.parquet(f"{root}/candles"), "indicators": spark.read.parquet(f"{root}/indicators"),
            "closes": DP.previous_closes(spark, root, last), "carry": spark.read.parquet(f"{root}/carry/asof={last}")}


def at():
    return F.lit("2026-01-01").cast("timestamp_ntz")


def day(n):
    return (START + dt.timedelta(days=n)).isoformat()


@pytest.fixture(scope="module")
def stored_ticks(spark):
    path = work_path(spark, "ticks")
    S.write_table(daily_ticks(spark), path, "day")
    return spark.read.parquet(path)


def test_daily_runs_equal_one_full_load(spark, stored_ticks):
    """80 days: longer than the carried history. Days run one by one, twice, and after a gap in the schedule."""
    full, root = work_path(spark, "full"), work_path(spark, "daily")
    DP.backfill(spark, stored_ticks, full, day(79), at())
    DP.backfill(spark, stored_ticks, root, day(75), at())
    for n in (76, 77, 77, 78, 79):
        DP.run_day(spark, stored_ticks, root, day(n), at())
    want, got = tables(spark, full, day(79)), tables(spark, root, day(79))
    assert want["indicators"].filter("ma60 is not null").count() > 0
    for name in want:
        assert same(want[name], got[name]), name


def test_a_rerun_writes_no_candle_and_a_correction_reaches_the_next_day(spark, stored_ticks):
    root = work_path(spark, "daily")
    DP.backfill(spark, stored_ticks, root, day(60), at())
    for n in (61, 62):
        DP.run_day(spark, stored_ticks, root, day(n), at())
    files = sorted(f for f in spark.read.parquet(f"{root}/candles").inputFiles())
    DP.run_day(spark, stored_ticks, root, day(62), F.lit("2027-01-01").cast("timestamp_ntz"))
    assert sorted(spark.read.parquet(f"{root}/candles").inputFiles()) == files
    late = stored_ticks.filter(F.col("day") == F.lit(day(61)).cast("date")).limit(1).withColumns(
        {"price": F.lit(500).cast("decimal(24,8)"), "event_id": F.lit(10 ** 6).cast("long"), "trade_id": F.lit("late"), "ts": F.lit(f"{day(61)} 23:59:59").cast("timestamp_ntz")})
    corrected = stored_ticks.unionByName(late)
    DP.run_day(spark, corrected, root, day(61), at())
    assert day_folders(spark, f"{root}/carry", "asof")[-1] == day(61)  # what followed rested on other candles
    DP.run_day(spark, corrected, root, day(62), at())
    full = work_path(spark, "full")
    DP.backfill(spark, corrected, full, day(62), at())
    want, got = tables(spark, full, day(62)), tables(spark, root, day(62))
    for name in ("indicators", "closes", "carry"):
        assert same(want[name], got[name]), name


def test_daily_job_reads_one_day_of_ticks(spark, stored_ticks):
    own = stored_ticks.filter((F.col("ts") >= F.lit(day(7)).cast("timestamp_ntz")) & (F.col("day") == F.lit(day(7)).cast("date")))
    assert len(own.inputFiles()) > 1 and "PartitionFilters: [isnotnull(day" in own._jdf.queryExecution().executedPlan().toString()
    root = work_path(spark, "daily")
    DP.run_day(spark, stored_ticks, root, day(7), at())  # without any table before it
    assert day_folders(spark, f"{root}/candles", "trade_date") == [day(7)]
    checks = DP.run_day(spark, stored_ticks, root, day(13), at()).first()
    assert (checks.vanished, checks.anomalies, checks.without_indicators) == (0, 0, 0)  # day 12 was never run


def test_official_days_stay_and_days_without_ticks_vanish(spark, stored_ticks):
    root = work_path(spark, "daily")
    DP.backfill(spark, stored_ticks, root, day(11), at())
    stored = spark.read.parquet(f"{root}/candles").filter(F.col("trade_date") == F.lit(day(11)).cast("date"))
    official = stored.select("symbol", "source", F.col("trade_date").cast("timestamp_ntz").alias("bucket"), "open", "high", "low",
                             F.lit(100).cast("decimal(24,8)").alias("close"), "volume", F.col("tick_count").alias("trade_count"))
    S.merge_into(spark, f"{root}/candles", official.withColumn("trade_date", F.to_date("bucket")), "trade_date",
                 lambda s, n: M.merge_daily_exchange(s, n.drop("trade_date"), "CRYPTO", at()))
    DP.run_day(spark, stored_ticks, root, day(11), at())
    rows = spark.read.parquet(f"{root}/candles").filter(F.col("trade_date") == F.lit(day(11)).cast("date")).collect()
    assert rows and all(r.origin == "EXCHANGE" and r.close == 100 for r in rows)
    DP.run_day(spark, stored_ticks, root, day(12), at())
    assert DP.run_day(spark, stored_ticks, root, day(13), at()).first().vanished == 1  # B has no ticks that day
    assert {r.symbol for r in DP.previous_closes(spark, root, day(13)).collect()} == {"A", "B"}


# -- expiring prices -------------------------------------------------------------------------------

def tick(i, symbol, seconds, price):
    at = dt.datetime(2026, 9, 20, 10) + dt.timedelta(seconds=seconds)
    return (i, symbol, "BINANCE", str(i), D(price), D(1), "X", at, "CRYPTO")


def put(spark, path, *rows):
    spark.createDataFrame(list(rows), TICK).coalesce(1).write.mode("append").parquet(path)


def state(spark, path):
    return {r.symbol: (float(r.price), r.active) for r in spark.read.parquet(path).collect()}


def test_prices_expire_inside_the_stream_and_the_state_survives_a_restart(spark):
    source, path, dead, ckpt = (work_path(spark, n) for n in ("in", "prices", "dead", "ckpt"))
    prev = spark.createDataFrame([("A", D(100)), ("B", D(50))], "symbol string, prev_close decimal(24,8)")
    run = lambda: PS.expiring_prices_into(spark, J.read_files(spark, source, TICK, per_trigger=1), prev, path, dead, ckpt)
    put(spark, source, tick(1, "A", 0, 110), tick(2, "B", 10, 60), tick(3, "A", 5, 120), tick(4, "B", 11, 0), tick(5, "C", 12, 7))
    run()
    assert state(spark, path) == {"A": (120, True), "B": (60, True), "C": (7, True)}
    row = spark.read.parquet(path).filter("symbol = 'A'").first()
    assert (float(row.change), float(row.change_percent)) == (20, 20)
    put(spark, source, tick(6, "B", 66, 61))  # A's newest tick is 61 seconds old, C's 54
    run()
    assert state(spark, path) == {"A": (120, False), "B": (61, True), "C": (7, True)}
    put(spark, source, tick(7, "A", 70, 130), tick(8, "B", 65, 99))  # an older tick changes nothing
    run()
    assert state(spark, path) == {"A": (130, True), "B": (61, True), "C": (7, True)}
    put(spark, source, tick(9, "A", 200, -1), tick(10, "A", 127, 131))
    run()
    assert state(spark, path) == {"A": (131, True), "B": (61, False), "C": (7, False)}
    assert {r.symbol for r in PS.active_prices(spark, path).collect()} == {"A"}
    assert sorted(r.event_id for r in spark.read.parquet(dead).collect()) == [4, 9]
    PS.expiring_prices_into(spark, J.read_files(spark, source, TICK), prev, path, dead)  # a lost checkpoint
    assert sorted(r.event_id for r in spark.read.parquet(dead).collect()) == [4, 9]
    assert state(spark, path) == {"A": (131, True), "B": (61, False), "C": (7, False)}


def test_state_settings_are_restored(spark):
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or "")


# -- retries ---------------------------------------------------------------------------------------

FAILED = "topic string, partition int, offset long, symbol string, value string, error_type string, error_message string, retry_count int"


def test_retries_survive_lost_checkpoints(spark):
    source, dead, retry, ckpt = (work_path(spark, n) for n in ("failed", "dead", "retry", "ckpt"))
    kinds = ["TIMEOUT_ERROR", "VALIDATION_ERROR", "STORAGE_ERROR"]
    rows = [("t", i % 3, i, "A", "{}", kinds[i % 3], "x", i % 2) for i in range(30)]
    spark.createDataFrame(rows[:15], FAILED).write.parquet(source)
    stream = lambda: J.read_files(spark, source, FAILED)
    schema = spark.createDataFrame([], FAILED).schema
    J.route_into(spark, stream(), dead, retry, f"{ckpt}/a")
    J.route_into(spark, stream(), dead, retry)  # a new checkpoint: everything comes again
    assert spark.read.parquet(dead).count() == 5 and spark.read.parquet(retry).count() == 10
    spark.createDataFrame(rows[15:], FAILED).write.mode("append").parquet(source)
    J.route_into(spark, stream(), dead, retry, f"{ckpt}/a")
    attempts = J.retry_all(spark, schema, dead, retry, f"{ckpt}/r")
    assert attempts == sum(3 - r[7] for r in rows if r[5] != "VALIDATION_ERROR")
    assert J.retry_all(spark, schema, dead, retry, f"{ckpt}/r") == 0
    J.retry_all(spark, schema, dead, retry)
    got = sorted((r.offset, r.retry_count) for r in spark.read.parquet(dead).collect())
    assert got == sorted((r[2], r[7] if r[5] == "VALIDATION_ERROR" else 3) for r in rows)


def test_append_takes_the_same_one_of_equal_keys(spark):
    rows = spark.createDataFrame([(1, "b", "d"), (1, "a", "d"), (2, None, "d"), (1, "c", "d")], "k int, v string, day string")
    for n in (1, 4):
        path = work_path(spark, "append")
        S.append_new(spark, rows.repartition(n), path, ["k"], "day")
        S.append_new(spark, rows.filter("v = 'c'"), path, ["k"], "day")
        assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, None)]


# -- linked commits and repair ---------------------------------------------------------------------

def test_a_crash_between_two_tables_leaves_nothing_visible(spark, monkeypatch):
    root = work_path(spark, "commits")
    runs = lambda *keys: spark.createDataFrame([(k, len(k)) for k in keys], "run_key string, v int")
    assert CM.publish(spark, root, {"runs": runs("a", "b"), "curve": runs("a", "a", "b")}, "run_key") == 2

    class Crash(Exception):
        pass

    def crash(*_):
        raise Crash
    with pytest.raises(Crash):
        monkeypatch.setattr(CM.F, "current_timestamp", crash)  # the commit's last write
        CM.publish(spark, root, {"runs": runs("c"), "curve": runs("c", "c")}, "run_key")
    monkeypatch.undo()
    keys = lambda name: sorted(r.run_key for r in CM.read(spark, root, name, "run_key").collect())
    assert keys("runs") == ["a", "b"] and keys("curve") == ["a", "a", "b"]
    assert CM.publish(spark, root, {"runs": runs("c", "a"), "curve": runs("c", "c", "a")}, "run_key") == 1  # a is known
    assert keys("runs") == ["a", "b", "c"] and keys("curve") == ["a", "a", "b", "c", "c"]
    assert CM.publish(spark, root, {"runs": runs("c"), "curve": runs("c")}, "run_key") == 0


CANDLE = "symbol string, source string, bucket timestamp_ntz, open decimal(24,8), high decimal(24,8), low decimal(24,8), close decimal(24,8), volume decimal(32,8), quote_volume decimal(32,8), trade_count long, origin string"


def minute(n, close, origin="EXCHANGE", symbol="BTC", start=dt.datetime(2026, 9, 20, 10)):
    return (symbol, "BINANCE", start + dt.timedelta(minutes=n), D(1), D(200), D(1), D(close), D(3), None, 7, origin)


def test_repair_writes_only_touched_days_and_counts(spark):
    path = work_path(spark, "minutes")
    old = [minute(n, 5, "LIVE", start=dt.datetime(2026, 9, 1)) for n in range(3)] + [minute(n, 5) for n in range(0, 60, 2)]
    S.write_table(spark.createDataFrame(old, CANDLE).withColumn("day", F.to_date("bucket")), path, "day")
    before = {f for f in spark.read.parquet(path).inputFiles() if "2026-09-01" in f}
    start, end = (F.lit(f"2026-09-20 {t}").cast("timestamp_ntz") for t in ("10:00:00", "11:30:00"))
    offer = spark.createDataFrame([minute(n, 6) for n in range(0, 80)], CANDLE).drop("origin")
    traded = spark.createDataFrame([("BTC",)], "symbol string")
    s = RP.fill_into(spark, path, offer, traded, start, end).first()
    # the newest official minute is 10:58, so 31 minutes are checked, and the exchange knows 21 of them
    assert (s.symbols_checked, s.symbols_with_gaps, s.missing_minutes, s.filled, s.unfillable) == (1, 1, 31, 21, 10)
    assert {f for f in spark.read.parquet(path).inputFiles() if "2026-09-01" in f} == before
    again = RP.fill_into(spark, path, offer, traded, start, end).first()
    assert (again.missing_minutes, again.filled, again.unfillable) == (10, 0, 10)


def test_confirmation_of_a_day_is_one_commit(spark):
    root, at = work_path(spark, "candles"), dt.datetime(2026, 9, 20)
    minutes = spark.createDataFrame([minute(n, 5, "LIVE") for n in range(4)] + [minute(n, 5, "LIVE", start=dt.datetime(2026, 9, 19)) for n in range(4)], CANDLE)
    daily = spark.createDataFrame([("BTC", d.date(), "BINANCE", "CRYPTO", D(1), D(9), D(1), D(5), D(3), 4, None) for d in (at, at - dt.timedelta(days=1))],
                                  "symbol string, trade_date date, source string, market_type string, open decimal(24,8), high decimal(24,8), low decimal(24,8), close decimal(24,8), volume decimal(32,8), tick_count long, origin string")
    RP.store_candles(spark, root, minutes, daily)
    official = spark.createDataFrame([minute(n, 6) for n in range(6)], CANDLE).drop("origin")
    official_day = spark.createDataFrame([("BTC", "BINANCE", at, D(1), D(9), D(1), D(6), D(3), 4)],
                                         "symbol string, source string, bucket timestamp_ntz, open decimal(24,8), high decimal(24,8), low decimal(24,8), close decimal(24,8), volume decimal(32,8), trade_count long")
    traded = spark.createDataFrame([("BTC",)], "symbol string")
    run = lambda: RP.confirm_day_into(spark, root, official, official_day, traded, "2026-09-20")
    assert run() == {"minutes": 6, "days": 1} and run() == {"minutes": 0, "days": 0}
    got = {r.trade_date.day: (float(r.close), r.origin) for r in RP.stored_days(spark, root).collect()}
    assert got == {20: (6, "EXCHANGE"), 19: (5, None)}
    rows = RP.stored_minutes(spark, root).groupBy(F.to_date("bucket").alias("d"), "origin").count().collect()
    assert sorted((r.d.day, r.origin, r["count"]) for r in rows) == [(19, "LIVE", 4), (20, "EXCHANGE", 6)]


# -- exact quantiles and alerts ----------------------------------------------------------------------

def test_quantiles_equal_those_of_sorted_values(spark):
    rnd = random.Random(3)
    rows = [("hot", rnd.choice([rnd.gauss(0, 9), 1.5])) for _ in range(3000)] + [(f"k{i % 7}", rnd.random()) for i in range(60)] + [("one", 4.0), ("none", None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: (r.m, r.q) for r in RK.exact_quantiles(df, ["k"], F.col("v"), {"m": 0.5, "q": 0.9}).collect()}
    values = {}
    for k, v in rows:
        if v is not None:
            values.setdefault(k, []).append(v)
    assert set(got) == set(values)
    for k, vs in values.items():
        vs.sort()
        at = 0.9 * (len(vs) - 1)
        low = int(at)
        q = vs[low] + (vs[min(low + 1, len(vs) - 1)] - vs[low]) * (at - low)
        assert got[k][0] == pytest.approx(statistics.median(vs), abs=1e-12) and got[k][1] == pytest.approx(q, abs=1e-9)


def test_no_quantile_buffers_a_key(spark):
    runs = spark.range(100).select(F.lit("a").alias("condition"), F.lit("m").alias("metric"), F.col("id").cast("double").alias("value"))
    plan = ME.medians_against(runs, "a")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "median(" not in plan


def test_alerts_over_several_days_equal_one_window(spark, monkeypatch):
    rnd, at = random.Random(8), dt.datetime(2026, 1, 1)
    rows = []
    for _ in range(900):
        at += dt.timedelta(seconds=rnd.choice([30, 60, 60, 400]))
        rows += [("g", p, at, rnd.choice([100, 9000, 30000, 60000]), rnd.choice([500, 5000])) for p in range(2)]
    samples = spark.createDataFrame(rows, "group_id string, partition int, ts timestamp_ntz, lag long, margin long")
    days = V.lag_alerts(samples).collect()
    monkeypatch.setattr(V, "with_halo", lambda g, *_: g.withColumns({"_span": F.lit(0), "_halo": F.lit(False)}))
    whole = V.lag_alerts(samples).collect()
    assert sorted(map(tuple, days)) == sorted(map(tuple, whole)) and len({r.ts.date() for r in days}) > 1
