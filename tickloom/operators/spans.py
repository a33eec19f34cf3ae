"""What a row needs of the rest of its series, without one task per series.

A series is cut into time spans. One aggregate gives a row per span, one window over these rows carries everything into each span
(the row before it, the row after it, the last known value before and the first one after, the number of earlier rows), one join
brings it to the rows, and windows inside the spans do the rest. So any number of neighbours costs one shuffle of the rows.

A frame up to the end of its partition is computed anew for every row, so what comes after a row is read in reversed order, where
the frame grows row by row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .neighbors import with_span

#: Rows of a series in one span, if the series has no gaps.
SPAN_ROWS = 4096
DAY = 86400


def span_of(step: int, rows: int = SPAN_ROWS) -> int | None:
    """Seconds of a span for a series with a row every ``step`` seconds; None (one span) from a row a day on.

    The calendar bounds such a series: a century has 36,525 days. Finer series grow without bound.
    """
    return None if step >= DAY else step * rows


def with_context(df: DataFrame, keys: list[str], ts: str, span_seconds: int | None, *, prev: tuple[str, ...] = (), following: tuple[str, ...] = (),
                 known: dict[str, Column] | None = None, number: str | None = None, keep_span: bool = False) -> DataFrame:
    """Add, in time order per key:

    - ``prev_<c>`` and ``next_<c>``: the value of the row before / after;
    - for each ``name: expression`` of ``known``: ``last_<name>``, its last non-null value up to this row, and ``first_<name>``,
      its first from this row on;
    - ``number``: the 0-based number of the row.

    Rows that have a column ``_span`` already keep it; if they are dealt by key and span, they are not shuffled again. Without
    ``span_seconds`` (see ``span_of``) and ``_span`` plain windows over the keys do it.
    """
    known = known or {}
    if span_seconds is None and "_span" not in df.columns:
        return _whole(df, keys, ts, prev, following, known, number)
    df = (df if "_span" in df.columns else with_span(df, ts, span_seconds)).withColumns({f"_k_{k}": e for k, e in known.items()} or {"_k": F.lit(None)})
    inner, outer = Window.partitionBy(*keys, "_span").orderBy(ts), Window.partitionBy(*keys).orderBy("_span")
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    rows, carried = [F.count(F.lit(1)).alias("_n")], []
    for c in prev:
        rows.append(F.max_by(c, ts).alias(f"_l_{c}"))
        carried.append(F.lag(f"_l_{c}").over(outer).alias(f"_pe_{c}"))
    for c in following:
        rows.append(F.min_by(c, ts).alias(f"_f_{c}"))
        carried.append(F.lead(f"_f_{c}").over(outer).alias(f"_ne_{c}"))
    for k in known:
        at = F.when(F.col(f"_k_{k}").isNotNull(), F.col(ts))
        rows += [F.max_by(f"_k_{k}", at).alias(f"_lk_{k}"), F.min_by(f"_k_{k}", at).alias(f"_fk_{k}")]
        carried += [F.last(f"_lk_{k}", ignorenulls=True).over(before).alias(f"_be_{k}"),
                    F.last(f"_fk_{k}", ignorenulls=True).over(after).alias(f"_af_{k}")]
    if number:
        carried.append(F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"))
    carry = df.groupBy(*keys, "_span").agg(*rows).select(*keys, "_span", *carried)
    joined = df.join(carry, [*keys, "_span"], "left")
    out: dict[str, Column] = {}
    up = inner.rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "_span").orderBy(F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0)
    for c in prev:
        out[f"prev_{c}"] = F.when(F.lag(F.lit(1)).over(inner).isNotNull(), F.lag(c).over(inner)).otherwise(F.col(f"_pe_{c}"))
    for c in following:
        out[f"next_{c}"] = F.when(F.lead(F.lit(1)).over(inner).isNotNull(), F.lead(c).over(inner)).otherwise(F.col(f"_ne_{c}"))
    for k in known:
        out[f"last_{k}"] = F.coalesce(F.last(f"_k_{k}", ignorenulls=True).over(up), F.col(f"_be_{k}"))
    if number:
        out[number] = F.col("_earlier") + F.row_number().over(inner) - 1
    added = joined.withColumns(out | ({"_row": F.row_number().over(inner)} if known else {}))
    ahead = {f"first_{k}": F.coalesce(F.last(f"_k_{k}", ignorenulls=True).over(down), F.col(f"_af_{k}")) for k in known}
    added = added.withColumns(ahead) if known else added
    helpers = ["_k", "_row", *(f"_{p}_{k}" for p in ("k", "be", "af") for k in known), *(f"_pe_{c}" for c in prev), *(f"_ne_{c}" for c in following), "_earlier"]
    return added.drop(*helpers, *([] if keep_span else ["_span"]))


def _whole(df: DataFrame, keys: list[str], ts: str, prev, following, known: dict[str, Column], number: str | None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(ts)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0)
    out = {**{f"prev_{c}": F.lag(c).over(w) for c in prev}, **{f"next_{c}": F.lead(c).over(w) for c in following}}
    for k, e in known.items():
        out |= {f"_k_{k}": e, f"last_{k}": F.last(e, ignorenulls=True).over(up)}
    if number:
        out[number] = (F.row_number().over(w) - 1).cast("long")
    if not known:
        return df.withColumns(out)
    added = df.withColumns({**out, "_row": F.row_number().over(w)})
    ahead = {f"first_{k}": F.last(f"_k_{k}", ignorenulls=True).over(down) for k in known}
    return added.withColumns(ahead).drop("_row", *(f"_k_{k}" for k in known))


def with_row_chunks(df: DataFrame, number: str, chunk: int, before: int) -> DataFrame:
    """Chunks of ``chunk`` numbered rows in column ``_chunk``; the last ``before`` rows of a chunk are also in the next, marked ``_halo``."""
    own = F.floor(F.col(number) / chunk)
    chunks = F.array_distinct(F.array(own, F.floor((F.col(number) + before) / chunk)))
    return df.withColumn("_own", own).withColumn("_chunk", F.explode(chunks)).withColumn("_halo", F.col("_chunk") != F.col("_own")).drop("_own")
