"""Streams over several files; results independent of partitioning and of hot keys."""
from pyspark.sql import functions as F

from tickloom.operators import candles as C, dedup as U, series as R, spans as SP
from tickloom.queries import QUERIES
from tickloom.session import work_path
from tickloom.sources import adapters as A
from tickloom.streaming import jobs as J


def same(a, b):
    cols = sorted(a.columns)
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_stream_over_ordered_files_equals_batch(spark, sf):
    t = A.ticks(spark, sf, dense=True)
    path = work_path(spark, "in")
    for i in range(4):  # files in time order, minutes shared across a file border
        part = t.filter((F.col("event_id") >= i * 250) & (F.col("event_id") < (i + 1) * 250))
        part.coalesce(1).write.mode("append").parquet(path)
    out = work_path(spark, "out")
    J.drain(J.minute_candles(J.read_files(spark, path, t.schema, per_trigger=1)), "c", J.batch_table(out), "update")
    got = J.newest_updates(spark, out, ["symbol", "source", "bucket"]).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
    assert same(got, C.minute_ohlcv(t))


def test_results_do_not_depend_on_partitions_or_order(spark, sf):
    t = A.ticks(spark, sf, dense=True)
    # several ticks of one microsecond: the order must still be fixed
    tied = t.withColumn("ts", F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(C.minute_ohlcv(tied.repartition(int(n) + 2).orderBy(F.rand(int(n)))).collect())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(str, results[0])) == sorted(map(str, results[1]))


def test_minute_rollup_is_a_hash_aggregate(spark, sf):
    plan = C.minute_ohlcv(A.ticks(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_span_context_equals_plain_windows(spark):
    from pyspark.sql import Window
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
                                  F.when(F.col("id") % 17 == 5, F.col("id")).alias("v"))
    w = Window.partitionBy("k").orderBy("ts")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    plain = df.withColumns({"prev_v": F.lag("v").over(w), "next_ts": F.lead("ts").over(w), "i": (F.row_number().over(w) - 1).cast("long"),
                            "last_x": F.last("v", ignorenulls=True).over(up), "first_x": F.first("v", ignorenulls=True).over(down)})
    for span in (3600, 500, 10 ** 9):
        got = SP.with_context(df, ["k"], "ts", span, prev=("v",), following=("ts",), known={"x": F.col("v")}, number="i")
        assert same(got, plain)


def test_what_follows_a_row_costs_no_frame_to_the_end(spark):
    """Such a frame is computed anew for every row, so it grows with the square of a span or a series."""
    from pyspark.sql import Window
    df = spark.range(600).select((F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
                                 F.when(F.col("id") % 17 == 5, F.col("id")).alias("v"))
    w = Window.partitionBy("k").orderBy("ts")
    plain = df.withColumns({"last_x": F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                            "first_x": F.first("v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    for span in (6000, None):
        got = SP.with_context(df, ["k"], "ts", span, known={"x": F.col("v")})
        assert got.columns == plain.columns and same(got, plain)
        assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_cleaning_does_not_depend_on_span(spark, monkeypatch):
    df = spark.range(3000).filter("id % 7 <> 3").select(F.lit("S").alias("k"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
                                 F.when(F.col("id") % 500 == 11, 9000.0).otherwise(100 + F.sin(F.col("id") / 9.0)).alias("v"))
    got = []
    for rows in (4096, 64):
        monkeypatch.setattr(R, "SPAN_ROWS", rows)
        got.append([(r.ts, round(r.v, 9)) for r in R.clean(df, ["k"], "ts", "v", 60).orderBy("ts").collect()])
    assert got[0] == got[1] and len(got[0]) == 2999  # minute 2999 is absent
    assert max(v for _, v in got[0]) < 200


def test_hot_copies_fold_before_the_shuffle(spark):
    rows = spark.range(10000).select(F.lit("S").alias("symbol"), F.lit("X").alias("source"), F.lit("1").alias("trade_id"),
                                     F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.col("id"))
    out = U.lowest_id_per_trade(rows)
    assert [r.id for r in out.collect()] == [0]
    assert "partial_min_by" in out._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_a_name_and_runs_lazily_small(spark, sf):
    for name in ("AGG1_minute_ohlcv", "NRM4_message_routing", "WIN22_series_validation", "STR8_dead_letters"):
        assert QUERIES[name](spark, sf).count() > 0


def test_storage_path_survives_a_restart(spark, sf):
    """A second run from the same checkpoint, and a third from a lost one, add nothing twice."""
    t = A.ticks(spark, sf)
    path, table, inst, ckpt = (work_path(spark, n) for n in ("in", "ticks", "inst", "ckpt"))
    half = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    t.filter(half).coalesce(1).write.parquet(path)
    stream = lambda: J.read_files(spark, path, t.schema, per_trigger=1)
    J.store_ticks_into(spark, stream(), table, inst, ckpt)
    t.filter(~half).coalesce(1).write.mode("append").parquet(path)
    J.store_ticks_into(spark, stream(), table, inst, ckpt)
    assert spark.read.parquet(table).count() == t.count()
    J.store_ticks_into(spark, stream(), table, inst)
    assert spark.read.parquet(table).count() == t.count()
    ends = {r.symbol: (r.first_seen_at, r.last_seen_at) for r in J.stored_instruments(spark, inst).collect()}
    want = {r.symbol: (r.a, r.b) for r in t.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()}
    assert ends == want
