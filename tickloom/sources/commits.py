"""Several tables written as one: readers see all rows of a unit (a run, a day) in every table, or none.

Rows go to ``<root>/<table>/commit=<id>``; the last write is the commit's list of units. A job that stops before it leaves rows that no
reader sees, and runs again under a new id. A unit that is committed again replaces itself or, as a known run, is skipped.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.sources.sinks import by_day, staged, table_exists
from tickloom.session import drop_path


def committed(spark: SparkSession, root: str, unit: str) -> DataFrame | None:
    """unit, commit: the commit that holds each unit, the newest one of several; None before the first commit."""
    path = f"{root}/commits"
    if not table_exists(spark, path):
        return None
    return spark.read.parquet(path).groupBy(unit).agg(F.max_by("commit", F.struct("at", "commit")).alias("commit"))


def unknown(spark: SparkSession, root: str, rows: DataFrame, unit: str) -> DataFrame:
    """The rows whose unit is not committed yet."""
    known = committed(spark, root, unit)
    return rows if known is None else rows.join(known.select(unit), unit, "left_anti")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], unit: str, replace: bool = False) -> int:
    """Write the tables (each with the column ``unit``) as one commit; returns the number of units it holds.

    The units are those of the first table. Without ``replace`` units that are known are skipped; with it they are directories, so that a
    reader of a few units opens only these.
    """
    commit = uuid.uuid4().hex
    head = next(iter(tables.values())).select(unit).distinct()
    units, stage = staged(spark, head if replace else unknown(spark, root, head, unit), "units")
    try:
        n = units.count()
        if n:
            for name, rows in tables.items():
                own = rows.join(units, unit, "left_semi").withColumn("commit", F.lit(commit))
                (by_day(own, unit) if replace else own).write.mode("append").partitionBy("commit", *([unit] if replace else [])).parquet(f"{root}/{name}")
            units.select(unit, F.lit(commit).alias("commit"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{root}/commits")
        return n
    finally:
        drop_path(spark, stage)


def read(spark: SparkSession, root: str, name: str, unit: str) -> DataFrame:
    """The committed rows of a table."""
    rows = spark.read.parquet(f"{root}/{name}")
    return rows.join(committed(spark, root, unit), [unit, "commit"], "left_semi").drop("commit")
