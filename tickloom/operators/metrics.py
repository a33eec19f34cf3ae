"""Measurement aggregates: errors, latency, throughput, lag, repeated runs, sweeps, logs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranks import exact_quantiles

QUANTILES = [0.5, 0.9, 0.95, 0.99]


def signal_counts(signals: DataFrame, *keys: str) -> DataFrame:
    """Signals per kind; rows without a signal are forecasts that failed."""
    return signals.groupBy(*keys).agg(*[F.count_if(F.col("signal") == s).alias(f"{s.lower()}_count") for s in ("BUY", "HOLD", "SELL")],
                                      F.count_if(F.col("signal").isNull()).alias("failed_count"))


def error_measures(predicted: str = "predicted_price", actual: str = "actual_price") -> list[Column]:
    """MAE, RMSE and both in percent of the actual value."""
    err = F.col(predicted).cast("double") - F.col(actual).cast("double")
    pct = err / F.col(actual).cast("double") * 100.0
    return [F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
            F.avg(F.abs(pct)).alias("mae_pct"), F.sqrt(F.avg(pct * pct)).alias("rmse_pct")]


def report_summary(rows: DataFrame, keys=("strategy", "model")) -> DataFrame:
    """Per strategy and model: outcomes and means over successful rows, NULLs left out, 6 digits."""
    ok = F.col("status") == "SUCCESS"
    mean = lambda c, name: F.round(F.avg(F.when(ok, F.col(c)).cast("decimal(24,8)")), 6).cast("decimal(24,6)").alias(name)
    return rows.groupBy(*keys).agg(
        F.count_if(ok).alias("successful_runs"), F.count_if(~ok).alias("failed_runs"),
        F.count_if(ok & (F.col("total_return_pct") > 0)).alias("positive_return_count"),
        mean("total_return_pct", "average_total_return_pct"), mean("mdd_pct", "average_mdd_pct"), mean("mae_pct", "average_mae_pct"),
        mean("rmse_pct", "average_rmse_pct"), mean("trade_count", "average_trade_count"))


def latency(samples: DataFrame, *keys: str, value: str = "latency_ms") -> DataFrame:
    """Exact latency figures; negative samples are discarded and counted.

    Equal values are counted first, so a percentile works on (value, count) pairs instead of rows.
    """
    counts = samples.groupBy(*keys, value).agg(F.count("*").alias("n"))
    v, n = F.col(value), F.col("n")
    good = v >= 0
    kept = F.when(good, v)
    total = F.sum(F.when(good, n))
    pct = lambda q: F.percentile(kept, F.lit(q), F.when(good, n).otherwise(0)).alias(f"p{int(q * 100)}")
    return counts.groupBy(*keys).agg(
        total.alias("samples"), F.coalesce(F.sum(F.when(~good, n)), F.lit(0)).cast("long").alias("discarded"),
        (F.sum(F.when(good, v * n)) / total).alias("avg"), F.min(kept).alias("min"), F.max(kept).alias("max"), *[pct(q) for q in QUANTILES])


def sampled(df: DataFrame, key: str, every: int) -> DataFrame:
    """One in ``every`` keys by their MD5 hash, the same ones on every run and in every engine."""
    return df.filter(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % every == 0)


def throughput(events: DataFrame, *keys: str) -> DataFrame:
    """Rate, error rate and mean processing time; 0 where nothing was measured."""
    ok = F.col("ok")
    agg = events.groupBy(*keys).agg(
        F.count_if(ok).alias("processed"), F.count_if(~ok).alias("failed"), F.sum("processing_ms").alias("_sum"),
        F.count("processing_ms").alias("_n"), (F.unix_millis(F.max("ts").cast("timestamp")) - F.unix_millis(F.min("ts").cast("timestamp"))).alias("_ms"))
    ratio = lambda a, b, k: F.when(b > 0, a * k / b).otherwise(0.0)
    total = F.col("processed") + F.col("failed")
    return agg.select(*keys, "processed", "failed", ratio(F.col("processed"), F.col("_ms"), 1000.0).alias("per_second"),
                      ratio(F.col("failed"), total, 100.0).alias("error_rate"), ratio(F.col("_sum"), F.col("_n"), 1.0).alias("avg_ms"))


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """Lag and retention margin per group and partition; without a commit the begin offset counts."""
    commit = F.coalesce("commit_offset", "begin_offset")
    zero = F.lit(0).cast("long")
    return offsets.select("group_id", "partition", F.greatest(zero, F.col("end_offset") - commit).alias("lag"),
                          F.greatest(zero, commit - F.col("begin_offset")).alias("margin"))


def counter_means(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Mean per event between two counter snapshots; stages without new events are left out."""
    b = before.select(*keys, F.col("count").alias("_c0"), F.col("sum").alias("_s0"))
    j = after.join(b, list(keys), "left")
    dc = F.col("count") - F.coalesce("_c0", F.lit(0))
    ds = F.col("sum") - F.coalesce("_s0", F.lit(0))
    return j.withColumns({"events": dc, "_ds": ds}).filter(F.col("events") > 0).select(
        *keys, F.col("events").cast("long").alias("events"), (F.col("_ds") / F.col("events") * 1000).alias("mean_ms"))


def medians_against(runs: DataFrame, baseline: str) -> DataFrame:
    """Median per condition and metric over repeated runs, and the baseline's median divided by it."""
    med = exact_quantiles(runs, ["condition", "metric"], F.col("value"), {"median": 0.5})
    known = runs.select("condition", "metric").distinct()  # conditions without a value have a null median
    med = known.join(med, ["condition", "metric"], "left")
    base = med.filter(F.col("condition") == baseline).select("metric", F.col("median").alias("_b"))
    return med.join(base, "metric", "left").select(
        "condition", "metric", "median", F.when(F.col("median") != 0, F.col("_b") / F.col("median")).alias("ratio"))


def verdict() -> Column:
    """Sweep step: SATURATED, KEPT_UP or MARGINAL; '?' when it was not measured."""
    send, consume = F.col("effective_send").cast("double"), F.col("consume_realtime").try_cast("double")
    saturated = (F.col("drain_s") == "timeout") | (F.col("end_lag_rt") > 5000) | (consume < send * 0.8)
    kept = (consume >= send * 0.9) & (F.col("peak_lag_rt") < send * 8)
    return (F.when(~F.coalesce(send > 0, F.lit(False)) | consume.isNull(), "?").when(saturated, "SATURATED")
            .when(kept, "KEPT_UP").otherwise("MARGINAL"))


def ceiling(steps: DataFrame, *keys: str) -> DataFrame:
    """Highest rate that kept up and lowest that saturated."""
    at = lambda v: F.when(F.col("verdict") == v, F.col("rate"))
    return steps.groupBy(*keys).agg(F.max(at("KEPT_UP")).alias("sustained_rate"), F.min(at("SATURATED")).alias("first_saturated"))


def hold_resources(timeline: DataFrame, *keys: str) -> DataFrame:
    """Peak and lowest resource figures of the hold phase; 0 without a sample."""
    hold = timeline.filter(F.col("phase") == "hold")
    peak = lambda c: F.coalesce(F.max(c), F.lit(0.0)).alias(f"peak_{c}")
    return hold.groupBy(*keys).agg(peak("cpu_app"), peak("load1"), F.coalesce(F.min("mem_free_mb"), F.lit(0.0)).alias("min_mem_free_mb"))


def probe_stats(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls, outcomes and the exact min, median and max of successful calls."""
    ok = F.trim("http") == "200"
    secs = F.when(ok, F.col("seconds").try_cast("double"))
    counts = calls.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.min(secs).alias("min_s"), F.max(secs).alias("max_s"))
    return counts.join(exact_quantiles(calls, list(keys), secs, {"median_s": 0.5}), list(keys), "left").select(
        *keys, "calls", "ok", "failed", "min_s", "median_s", "max_s")


def log_levels(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level", F.window("ts", "1 minute").start.alias("minute")).agg(F.count("*").alias("lines"))


def request_rates(requests: DataFrame, window: str = "5 minutes", seconds_: int = 300) -> DataFrame:
    """Requests per second, share of 5xx and number of answers per window."""
    server = F.col("status").cast("string").startswith("5")
    return requests.groupBy(F.window("ts", window).start.alias("start")).agg(
        F.count("*").alias("requests"), (F.count("*") / F.lit(float(seconds_))).alias("per_second"),
        (F.count_if(server) * 100.0 / F.count("*")).alias("error_pct"))


def status_breakdown(requests: DataFrame) -> DataFrame:
    return requests.groupBy("status").agg(F.count("*").alias("requests"))
