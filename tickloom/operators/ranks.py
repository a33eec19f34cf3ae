"""Ranks and exact quantiles of very large keys: values are dealt by ranges, never brought together by key.

Rows are range-partitioned by (key, value) with Spark's sampled pivots and sorted in their partitions. One row per partition and key
says how many of the key's values lie there; a window over these rows turns them into the rank at which each partition begins.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.session import drop_path
from tickloom.sources.sinks import staged


def ranked(df: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, str]:
    """The rows with ``rank`` (0-based in the order of their key) and ``size`` (rows of the key), and the folder that holds them.

    Null keys are a key like any other. The caller drops the folder.
    """
    columns = [F.col(k) for k in keys]
    placed, path = staged(df.sparkSession, df.repartitionByRange(*columns, *order).sortWithinPartitions(*columns, *order)
                          .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumns({"_key": F.struct(*columns), "_part": F.shiftright("_at", 33)})
    parts = placed.groupBy("_part", "_key").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of_key = Window.partitionBy("_key")
    before = F.coalesce(F.sum("_n").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_part", "_key", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(of_key).alias("size"))
    out = placed.join(starts, ["_part", "_key"])
    return out.withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_key", "_shift"), path


def exact_quantiles(df: DataFrame, keys: list[str], value: Column, quantiles: dict[str, float]) -> DataFrame:
    """Per key the exact quantiles (name: share) of the non-null values, linear between the two nearest ranks.

    A table of one row per key and quantile; only the rows at the asked ranks are aggregated. Values are doubles.
    """
    spark = df.sparkSession
    values = df.select(*keys, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    rows, path = ranked(values, keys, [F.col("_v")])
    picked = []
    for name, share in quantiles.items():
        at = F.lit(float(share)) * (F.col("size") - 1)
        low, high = F.floor(at), F.ceil(at)
        weight = F.when(low == high, 1.0).when(F.col("rank") == low, high - at).when(F.col("rank") == high, at - low)
        picked.append(F.sum(F.when((F.col("rank") == low) | (F.col("rank") == high), F.col("_v") * weight)).alias(name))
    wanted = F.lit(False)
    for share in quantiles.values():
        at = F.lit(float(share)) * (F.col("size") - 1)
        wanted = wanted | (F.col("rank") == F.floor(at)) | (F.col("rank") == F.ceil(at))
    out, _ = staged(spark, rows.filter(wanted).groupBy(*keys).agg(*picked), "quantiles")
    drop_path(spark, path)
    return out
