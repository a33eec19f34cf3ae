"""Joins by keys of which a few may hold much of all rows, and row numbers without a single sorted task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.common import stored

#: A key is hot from this share of all rows on, so at most this many keys are.
HOT_KEYS = 1000


def left_by_count(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` left join ``keyed`` (one row per key) on ``key``; ``count`` says how many rows a key has, ``total`` all rows.

    Keys with a thousandth of the rows or more, so at most ``HOT_KEYS``, are broadcast; their rows are not shuffled.
    ``rows`` are read twice and should be a stored table.
    """
    more = [c for c in keyed.columns if c != key]
    is_hot = F.col(count) * HOT_KEYS >= F.lit(total)
    hot = keyed.filter(is_hot).select(key, F.struct(*more).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    taken = marked.filter(F.col("_hot").isNotNull()).select(*rows.columns, "_hot.*")
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot").join(keyed.filter(~is_hot), key, "left")
    return taken.unionByName(rest.select(*rows.columns, *more))


def numbered(rows: DataFrame, name: str, column: str, group: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """``rows`` with ``column``, the place from 0 on within ``group`` (all rows without one), and ``column``_of, the group's size.

    With ``order`` the places follow it, else any order that holds from here on. Rows are dealt by ranges and sorted in their
    partitions; a table with one row per partition and group carries the counts, so no group is sorted in one task.
    """
    if order:
        first = [F.col(group)] if group else []
        rows = rows.repartitionByRange(*first, *order).sortWithinPartitions(*first, *order)
    placed = stored(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    part, at = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")
    placed = placed.withColumns({"_part": part, "_at": at, "_group": F.col(group) if group else F.lit(0)})
    sizes = placed.groupBy("_part", "_group").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", "_group", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias(f"{column}_of"))
    out = placed.join(starts, ["_part", "_group"])
    return out.withColumn(column, F.col("_at") + F.col("_shift")).select(*rows.columns, column, f"{column}_of")
