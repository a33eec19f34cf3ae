"""Prediction history: response documents to run and point tables, and back to nested form."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.pricing import once
from .merge import insert_missing

RUN_KEY = ["symbol", "interval", "horizon", "source", "base_ts"]

_POINT = "struct<ts:string,yhat:string,yhat_lower:string,yhat_upper:string>"
_MODEL = f"struct<model:string,trained_at:string,metrics:struct<mae:string,rmse:string>,forecast:array<{_POINT}>>"
RESPONSE = f"struct<last_ts:string,last_value:string,models:array<{_MODEL}>>"


def _time(col):
    return F.try_to_timestamp(col).cast("timestamp_ntz")


def parse_responses(responses: DataFrame, value: str = "value") -> DataFrame:
    """Typed responses; a response without a readable base time is dropped."""
    v = responses.withColumn("v", once(F.from_json(value, RESPONSE)))
    return (v.withColumn("base_ts", _time(F.col("v.last_ts"))).filter(F.col("base_ts").isNotNull())
            .withColumn("symbol", F.upper("symbol"))
            .withColumn("source", F.trim(F.coalesce("source", F.lit("")))))


def runs_of(parsed: DataFrame) -> DataFrame:
    """One row per run key."""
    return (parsed.groupBy(*RUN_KEY)
            .agg(F.min(F.col("v.last_value").try_cast("double")).alias("base_value"), F.min("latency_ms").alias("latency_ms")))


def points_of(parsed: DataFrame) -> DataFrame:
    """Forecast points: nameless models and unreadable points are skipped, repeated times keep the first."""
    models = parsed.select(*RUN_KEY, F.posexplode("v.models").alias("mpos", "m"))
    named = models.withColumn("model", F.trim(F.coalesce("m.model", F.lit("")))).filter(F.col("model") != "")
    pts = named.select(*RUN_KEY, "model", "mpos", _time(F.col("m.trained_at")).alias("trained_at"),
                       F.col("m.metrics.mae").try_cast("double").alias("mae"), F.col("m.metrics.rmse").try_cast("double").alias("rmse"),
                       F.posexplode("m.forecast").alias("ppos", "p"))
    typed = pts.select(*RUN_KEY, "model", "mpos", "ppos", _time(F.col("p.ts")).alias("ts"), F.col("p.yhat").try_cast("double").alias("yhat"),
                       F.col("p.yhat_lower").try_cast("double").alias("yhat_lower"), F.col("p.yhat_upper").try_cast("double").alias("yhat_upper"),
                       "trained_at", "mae", "rmse")
    ok = typed.filter(F.col("ts").isNotNull() & F.col("yhat").isNotNull())
    vals = F.struct("yhat", "yhat_lower", "yhat_upper", "trained_at", "mae", "rmse")
    return (ok.groupBy(*RUN_KEY, "model", "ts").agg(F.min_by(vals, F.struct("mpos", "ppos")).alias("r"))
            .select(*RUN_KEY, "model", "ts", "r.*"))


def new_runs(stored_runs: DataFrame, runs: DataFrame) -> DataFrame:
    return insert_missing(stored_runs, runs, RUN_KEY)


def nested(runs: DataFrame, points: DataFrame) -> DataFrame:
    """run -> models -> points; a run has a bounded number of models and horizon steps."""
    models = (points.groupBy(*RUN_KEY, "model")
              .agg(F.first("trained_at").alias("trained_at"), F.first("mae").alias("mae"), F.first("rmse").alias("rmse"),
                   F.sort_array(F.collect_list(F.struct("ts", "yhat", "yhat_lower", "yhat_upper"))).alias("points")))
    per_run = models.groupBy(*RUN_KEY).agg(
        F.sort_array(F.collect_list(F.struct("model", "trained_at", "mae", "rmse", "points"))).alias("models"))
    return runs.join(per_run, RUN_KEY, "left")


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.desc("base_ts"), F.desc("symbol")).limit(n)
