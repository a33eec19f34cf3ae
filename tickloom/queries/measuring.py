"""AGG20-28: latency, throughput, lag, repeated runs, sweeps, probes, logs. Shaped from the events table."""
from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import metrics as M
from tickloom.sources import adapters as A
from .registry import query

T = f"WITH {A.SQL_TICKS}"


def dec(c, n):
    return F.round(F.col(c).cast("decimal(28,10)"), n).alias(c)


def rs(e, name, n):
    return f"CAST(round(CAST({e} AS DECIMAL(28,10)), {n}) AS DOUBLE) AS {name}"


@query("AGG20_latency", T + f""" SELECT source, count(*) FILTER (latency_ms >= 0) AS samples, count(*) FILTER (latency_ms < 0) AS discarded,
 {rs('avg(latency_ms) FILTER (latency_ms >= 0)', 'avg', 6)}, min(latency_ms) FILTER (latency_ms >= 0) AS min, max(latency_ms) FILTER (latency_ms >= 0) AS max,
 {", ".join(rs(f'quantile_cont(latency_ms, {q}) FILTER (latency_ms >= 0)', f'p{int(q * 100)}', 6) for q in (0.5, 0.9, 0.95, 0.99))} FROM ticks GROUP BY source""")
def latency(spark, sf):
    m = M.latency(A.ticks(spark, sf), "source")
    return m.select("source", "samples", "discarded", dec("avg", 6), "min", "max", *[dec(f"p{int(q * 100)}", 6) for q in M.QUANTILES])


@query("AGG20_sampled_keys", T + " SELECT source, count(*) AS sampled FROM ticks WHERE CAST('0x' || substr(md5(trade_id), 1, 8) AS BIGINT) % 10 = 0 GROUP BY 1")
def sampled_keys(spark, sf):
    """One in ten trade ids, chosen by hash, with the share they make up (the sampling operator itself)."""
    return M.sampled(A.ticks(spark, sf), "trade_id", 10).groupBy("source").agg(F.count("*").alias("sampled"))


@query("AGG21_throughput", T + f""", e AS (SELECT source, ts, event_id % 25 <> 0 AS ok, CASE WHEN event_id % 7 <> 0 THEN event_id % 90 END AS ms FROM ticks),
a AS (SELECT source, count(*) FILTER (ok) AS processed, count(*) FILTER (NOT ok) AS failed, sum(ms) AS s, count(ms) AS n, epoch_ms(max(ts)) - epoch_ms(min(ts)) AS el FROM e GROUP BY 1)
SELECT source, processed, failed, {rs('processed * 1000.0 / el', 'per_second', 6)}, {rs('failed * 100.0 / (processed + failed)', 'error_rate', 6)}, {rs('s * 1.0 / n', 'avg_ms', 6)} FROM a""")
def throughput(spark, sf):
    e = F.col("event_id")
    t = A.ticks(spark, sf).select("source", "ts", (e % 25 != 0).alias("ok"), F.when(e % 7 != 0, e % 90).alias("processing_ms"))
    return M.throughput(t, "source").select("source", "processed", "failed", *[dec(c, 6) for c in ("per_second", "error_rate", "avg_ms")])


@query("AGG22_consumer_lag", T + """, o AS (SELECT source AS group_id, event_id % 12 AS partition, max(event_id) AS end_offset, min(event_id) AS begin_offset,
  CASE WHEN event_id % 12 <> 3 THEN max(event_id) FILTER (CAST(price AS DOUBLE) < 30) END AS commit_offset FROM ticks GROUP BY 1, 2, event_id % 12)
SELECT group_id, partition, greatest(0, end_offset - coalesce(commit_offset, begin_offset)) AS lag, greatest(0, coalesce(commit_offset, begin_offset) - begin_offset) AS margin FROM o""")
def consumer_lag(spark, sf):
    t = A.ticks(spark, sf).withColumn("partition", F.col("event_id") % 12)
    o = t.groupBy(F.col("source").alias("group_id"), "partition").agg(
        F.max("event_id").alias("end_offset"), F.min("event_id").alias("begin_offset"),
        F.max(F.when(F.col("price").cast("double") < 30, F.col("event_id"))).alias("_c"))
    return M.consumer_lag(o.withColumn("commit_offset", F.when(F.col("partition") != 3, F.col("_c"))))


@query("AGG23_counter_means", T + f""", x AS (SELECT symbol AS stage, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS c0, sum(latency_ms) FILTER (ts < TIMESTAMP '2024-01-15') AS s0,
 count(*) AS c1, sum(latency_ms) AS s1 FROM ticks GROUP BY 1)
SELECT stage, c1 - c0 AS events, {rs('(s1 - s0) * 1.0 / (c1 - c0) * 1000', 'mean_ms', 4)} FROM x WHERE c1 > c0""")
def counter_means(spark, sf):
    t = A.ticks(spark, sf)
    snap = lambda df: df.groupBy(F.col("symbol").alias("stage")).agg(F.count("*").alias("count"), F.sum("latency_ms").alias("sum"))
    m = M.counter_means(snap(t.filter(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))), snap(t), "stage")
    return m.select("stage", "events", dec("mean_ms", 4))


@query("AGG24_run_medians", T + f""", r AS (SELECT source AS condition, symbol AS metric, CAST(ts AS DATE) AS run, avg(CAST(price AS DOUBLE)) AS value FROM ticks GROUP BY 1, 2, 3),
m AS (SELECT condition, metric, median(value) AS med FROM r GROUP BY 1, 2)
SELECT m.condition, m.metric, {rs('m.med', 'median', 6)}, {rs('b.med / m.med', 'ratio', 6)} FROM m LEFT JOIN m b ON b.metric = m.metric AND b.condition = 'BINANCE'""")
def run_medians(spark, sf):
    r = A.ticks(spark, sf).groupBy(F.col("source").alias("condition"), F.col("symbol").alias("metric"), F.to_date("ts").alias("run")).agg(
        F.avg(F.col("price").cast("double")).alias("value"))
    return M.medians_against(r, "BINANCE").select("condition", "metric", dec("median", 6), dec("ratio", 6))


# One sweep step per day and source: the rate, what was sent and consumed, lag and drain time.
STEPS = """SELECT source, CAST(day(ts) * 1000 AS BIGINT) AS rate, CAST(count(*) AS DOUBLE) AS effective_send,
 CASE WHEN day(ts) % 13 = 0 THEN 'NA' ELSE CAST(count(*) FILTER (event_id % 10 <> 0 OR day(ts) < 12) - day(ts) AS VARCHAR) END AS consume_realtime,
 max(event_id % 1000) AS peak_lag_rt, CASE WHEN day(ts) > 25 THEN 6000 ELSE 10 END AS end_lag_rt, CASE WHEN day(ts) % 17 = 0 THEN 'timeout' ELSE '5' END AS drain_s
FROM ticks GROUP BY source, day(ts)"""
VERDICT = f"""{T}, st AS ({STEPS}), v AS (SELECT *, CASE WHEN NOT effective_send > 0 OR TRY_CAST(consume_realtime AS DOUBLE) IS NULL THEN '?'
 WHEN drain_s = 'timeout' OR end_lag_rt > 5000 OR CAST(consume_realtime AS DOUBLE) < effective_send * 0.8 THEN 'SATURATED'
 WHEN CAST(consume_realtime AS DOUBLE) >= effective_send * 0.9 AND peak_lag_rt < effective_send * 8 THEN 'KEPT_UP' ELSE 'MARGINAL' END AS verdict FROM st)"""


def steps(spark, sf):
    t = A.ticks(spark, sf).withColumn("d", F.dayofmonth("ts"))
    got = (F.count_if((F.col("event_id") % 10 != 0) | (F.col("d") < 12)) - F.first("d")).cast("string")
    g = t.groupBy("source", "d").agg(F.count("*").cast("double").alias("effective_send"), got.alias("_got"),
                                     F.max(F.col("event_id") % 1000).alias("peak_lag_rt"))
    return g.select("source", (F.col("d") * 1000).cast("long").alias("rate"), "effective_send",
                    F.when(F.col("d") % 13 == 0, "NA").otherwise(F.col("_got")).alias("consume_realtime"), "peak_lag_rt",
                    F.when(F.col("d") > 25, 6000).otherwise(10).alias("end_lag_rt"), F.when(F.col("d") % 17 == 0, "timeout").otherwise("5").alias("drain_s"))


@query("AGG25_sweep_verdict", VERDICT + " SELECT source, rate, verdict FROM v")
def sweep_verdict(spark, sf):
    return steps(spark, sf).select("source", "rate", M.verdict().alias("verdict"))


@query("AGG26_ceiling", VERDICT + """ SELECT source, max(rate) FILTER (verdict = 'KEPT_UP') AS sustained_rate, min(rate) FILTER (verdict = 'SATURATED') AS first_saturated FROM v GROUP BY 1""")
def ceiling(spark, sf):
    return M.ceiling(steps(spark, sf).withColumn("verdict", M.verdict()), "source")


@query("AGG26_hold_resources", T + """ SELECT source, CAST(day(ts) AS BIGINT) AS rate, max(CAST(price AS DOUBLE)) AS peak_cpu_app, max(CAST(volume AS DOUBLE)) AS peak_load1,
 min(CAST(price AS DOUBLE)) AS min_mem_free_mb FROM ticks WHERE event_id % 3 = 0 GROUP BY 1, 2""")
def hold_resources(spark, sf):
    t = A.ticks(spark, sf).select("source", F.dayofmonth("ts").cast("long").alias("rate"), F.when(F.col("event_id") % 3 == 0, "hold").otherwise("ramp").alias("phase"),
                                  F.col("price").cast("double").alias("cpu_app"), F.col("volume").cast("double").alias("load1"), F.col("price").cast("double").alias("mem_free_mb"))
    return M.hold_resources(t, "source", "rate")


@query("AGG27_probe_stats", T + """, c AS (SELECT symbol, CASE WHEN event_id % 9 = 0 THEN '000' ELSE ' 200 ' END AS http, CASE WHEN event_id % 11 = 0 THEN 'x' ELSE CAST(CAST(price AS DOUBLE) AS VARCHAR) END AS sec FROM ticks)
SELECT symbol, count(*) AS calls, count(*) FILTER (trim(http) = '200') AS ok, count(*) FILTER (trim(http) <> '200') AS failed,
 min(TRY_CAST(sec AS DOUBLE)) FILTER (trim(http) = '200') AS min_s, CAST(round(CAST(quantile_cont(TRY_CAST(sec AS DOUBLE), 0.5) FILTER (trim(http) = '200') AS DECIMAL(28,10)), 6) AS DOUBLE) AS median_s,
 max(TRY_CAST(sec AS DOUBLE)) FILTER (trim(http) = '200') AS max_s FROM c GROUP BY 1""")
def probe_stats(spark, sf):
    e = F.col("event_id")
    c = A.ticks(spark, sf).select("symbol", F.when(e % 9 == 0, "000").otherwise(" 200 ").alias("http"),
                                  F.when(e % 11 == 0, "x").otherwise(F.col("price").cast("double").cast("string")).alias("seconds"))
    return M.probe_stats(c, "symbol").select("symbol", "calls", "ok", "failed", "min_s", dec("median_s", 6), "max_s")


@query("AGG28_log_levels", "SELECT upper(event_type) AS level, date_trunc('minute', ts) AS minute, count(*) AS lines FROM events GROUP BY 1, 2")
def log_levels(spark, sf):
    return M.log_levels(A.table(spark, sf, "events").select(F.upper("event_type").alias("level"), "ts"))


STATUS = "CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 500 ELSE 503 END WHEN 'signup' THEN 201 ELSE 200 END"


def requests(spark, sf):
    return A.table(spark, sf, "events").select("ts", F.expr(STATUS).cast("long").alias("status"))


@query("AGG28_request_rates", f"""SELECT time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS requests, {rs('count(*) / 300.0', 'per_second', 6)},
 {rs(f'count(*) FILTER ({STATUS} >= 500) * 100.0 / count(*)', 'error_pct', 4)} FROM events GROUP BY 1""")
def request_rates(spark, sf):
    return M.request_rates(requests(spark, sf)).select("start", "requests", dec("per_second", 6), dec("error_pct", 4))


@query("AGG28_status_breakdown", f"SELECT CAST({STATUS} AS BIGINT) AS status, count(*) AS requests FROM events GROUP BY 1")
def status_breakdown(spark, sf):
    return M.status_breakdown(requests(spark, sf))
