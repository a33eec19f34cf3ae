"""Time spans of a series, and the rows around a span's edges that its frames reach.

A plain window puts the whole history of a symbol into one task. With spans it runs inside (key, span).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.timeparse import seconds


def with_span(df: DataFrame, ts: str, span_seconds: int) -> DataFrame:
    return df.withColumn("_span", F.floor(seconds(ts) / span_seconds))


def with_halo(df: DataFrame, ts: str, span_seconds: int, before_seconds: int, after_seconds: int) -> DataFrame:
    """Copy rows near a span edge into the neighbouring span(s), marked ``_halo``.

    After this a window over (key, ``_span``) sees ``before_seconds`` of history and
    ``after_seconds`` of future of every row it owns. Both must not exceed the span.
    """
    sec = seconds(ts)
    own = F.floor(sec / span_seconds)
    into_next = F.floor((sec + before_seconds) / span_seconds)
    into_prev = F.floor((sec - after_seconds) / span_seconds)
    spans = F.array_distinct(F.array(own, into_next, into_prev))
    return df.withColumn("_own", own).withColumn("_span", F.explode(spans)).withColumn(
        "_halo", F.col("_span") != F.col("_own")).drop("_own")
