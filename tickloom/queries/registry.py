"""Registry of checked queries: a name, a DataFrame builder and, where it exists, DuckDB SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tickloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with the SQL that must give the same rows."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return presentable(fn(prepare(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return register


def presentable(df: DataFrame) -> DataFrame:
    """Decimals as doubles and zone-less timestamps, so both engines print the same value."""
    cols = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            col = col.cast("double").alias(field.name)
        elif isinstance(field.dataType, T.TimestampType):
            col = col.cast("timestamp_ntz").alias(field.name)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            col = col.cast("long").alias(field.name)
        cols.append(col)
    return df.select(*cols)
