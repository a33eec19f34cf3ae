"""Exponentially decayed running sums as a two-level scan.

y[j] = a * y[j-1] + x[j] looks sequential, but it is a weighted prefix sum. A series is cut into
chunks of rows: a window inside each chunk gives the local part, one row per chunk carries the rest.
Weights never leave one chunk, so they cannot overflow, and a long series spreads over many tasks.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F


def decayed_sums(df: DataFrame, keys: list[str], pos: str, cols: dict[str, str], a: float, chunk: int = 512) -> DataFrame:
    """Add, for each ``out: x`` of ``cols``, y[j] = a*y[j-1] + x[j] over the 0-based position ``pos``."""
    at = F.col(pos) % chunk
    df = df.withColumn("_chunk", F.floor(F.col(pos) / chunk))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    up, down = F.pow(F.lit(a), -at.cast("double")), F.pow(F.lit(a), at.cast("double"))
    local = df.withColumns({f"_l_{y}": F.sum(F.col(x) * up).over(inside) * down for y, x in cols.items()})
    to_end = F.pow(F.lit(a), (F.lit(chunk - 1) - at).cast("double"))
    ends = df.groupBy(*keys, "_chunk").agg(*[F.sum(F.col(x) * to_end).alias(f"_t_{y}") for y, x in cols.items()])
    # beyond this many chunks the weight is exactly 0.0 in a double
    reach = max(1, math.ceil(745 / (-math.log(a) * chunk)))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-reach, -1)
    fold = lambda c: F.aggregate(F.collect_list(c).over(before), F.lit(0.0), lambda s, t: s * (a ** chunk) + t)
    carry = ends.select(*keys, "_chunk", *[fold(f"_t_{y}").alias(f"_c_{y}") for y in cols])
    joined = local.join(carry, [*keys, "_chunk"], "left")
    out = joined.withColumns({y: F.col(f"_l_{y}") + F.col(f"_c_{y}") * down * a for y in cols})
    return out.drop("_chunk", *[f"_{p}_{y}" for p in "lc" for y in cols])
