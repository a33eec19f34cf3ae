"""Close series: regular grid, outliers, interpolation, returns, volatility, validation.

Minute series can be long, so their windows run over time spans (see ``spans``); a span holds a
bounded number of rows however much of the data one symbol owns.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.timeparse import from_seconds, seconds
from .neighbors import with_halo
from .spans import SPAN_ROWS, span_of, with_context

# Outlier rule and the least number of observations a model needs.
OUTLIER_WINDOW, OUTLIER_MIN, OUTLIER_Z, MIN_OBS = 20, 5, 8.0, 50


def log_return(price: str, w) -> Column:
    p = F.col(price).cast("double")
    prev = F.lag(p).over(w)
    return F.when((p > 0) & (prev > 0), F.ln(p / prev))


def restored_price(price: str, returns: str, w) -> Column:
    """Price rebuilt from the first price and the cumulated returns."""
    first = F.first(F.col(price).cast("double")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.coalesce(F.sum(returns).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return first * F.exp(total)


def volatility_pct(bars: DataFrame, price: str, w, window: int) -> DataFrame:
    """Add the sample deviation of the last ``window`` log returns in percent.

    0 with fewer than three prices or when a price of the frame is not positive.
    """
    frame, prices = w.rowsBetween(-(window - 1), 0), w.rowsBetween(-window, 0)
    p = F.col(price).cast("double")
    df = bars.withColumn("_r", log_return(price, w))
    usable = (F.count(F.col("_r")).over(frame) >= 2) & (F.min(p).over(prices) > 0)
    value = F.when(usable, F.stddev_samp("_r").over(frame) * 100).otherwise(0.0)
    return df.withColumn("volatility_pct", value).drop("_r")


def regular_grid(series: DataFrame, keys: list[str], ts: str, value: str, step: int) -> DataFrame:
    """Every grid time from the first to the last observation; gaps hold NULL.

    Each observation fills the gap up to the next one, so no row ever needs the whole series.
    """
    nxt = with_context(series.select(*keys, ts, value), keys, ts, span_of(step, SPAN_ROWS), following=(ts,))
    start, stop = seconds(ts), F.coalesce(seconds(f"next_{ts}") - step, seconds(ts))
    slots = nxt.select(*keys, F.col(ts).alias("_obs"), value, F.explode(F.sequence(start, stop, F.lit(step).cast("long"))).alias("_s"))
    at = from_seconds("_s")
    return slots.select(*keys, at.alias(ts), F.when(at == F.col("_obs").cast("timestamp_ntz"), F.col(value)).alias(value))


def _marked(grid: DataFrame, keys: list[str], ts: str, value: str, step: int, z: float) -> DataFrame:
    """The grid without its outliers, still dealt by key and ``_span``.

    The deviation of a series' residuals comes from one row per span (count, mean, squared deviations), so the rows never meet by
    their bare key.
    """
    half, span = OUTLIER_WINDOW // 2, span_of(step, SPAN_ROWS)
    v = F.col(value).cast("double")
    spread = with_halo(grid, ts, span, half * step, half * step) if span else grid.withColumns({"_span": F.lit(0), "_halo": F.lit(False)})
    w = Window.partitionBy(*keys, "_span").orderBy(ts).rowsBetween(-half, half - 1)
    med = F.when(F.count(v).over(w) >= OUTLIER_MIN, F.percentile(v, F.lit(0.5)).over(w))
    # dealt once more, so that the medians are not computed for each of the steps that read the residuals
    resid = spread.withColumn("_resid", v - med).filter(~F.col("_halo")).drop("_halo").repartition(*keys, "_span")
    spans = resid.groupBy(*keys, "_span").agg(F.count("_resid").alias("_c"), F.avg("_resid").alias("_m"),
                                              (F.var_pop("_resid") * F.count("_resid")).alias("_q"), F.count(value).alias("_o"))
    whole = Window.partitionBy(*keys)
    total = F.sum("_c").over(whole)
    spans = spans.withColumn("_mean", F.sum(F.col("_m") * F.col("_c")).over(whole) / total)
    squares = F.sum(F.col("_q") + F.col("_c") * F.pow(F.col("_m") - F.col("_mean"), 2)).over(whole)
    stats = spans.select(*keys, "_span", F.when(total > 1, F.sqrt(squares / (total - 1))).alias("_sd"), F.sum("_o").over(whole).alias("_n"))
    out = (F.col("_n") > 10) & (F.col("_sd") > 0) & (F.abs("_resid") > F.col("_sd") * z)
    return resid.join(stats, [*keys, "_span"]).withColumn(value, F.when(~F.coalesce(out, F.lit(False)), F.col(value))).drop("_resid", "_sd", "_n")


def drop_outliers(grid: DataFrame, keys: list[str], ts: str, value: str, step: int, z: float = OUTLIER_Z) -> DataFrame:
    """NULL the values far from the centred rolling median of 20 grid rows.

    The rule is |residual| > z times the sample deviation of all residuals of the series, and holds
    for series with more than ten observations.
    """
    return _marked(grid, keys, ts, value, step, z).drop("_span")


def interpolate(grid: DataFrame, keys: list[str], ts: str, value: str, step: int) -> DataFrame:
    """Time-linear between observations, the nearest one before the first and after the last.

    Both neighbours of every row come from one pass over the spans. A series without any observation gives no rows.
    """
    v, at = F.col(value).cast("double"), seconds(ts)
    seen = F.when(v.isNotNull(), F.struct(at.alias("s"), v.alias("v")))
    span = [c for c in grid.columns if c == "_span"]
    both = with_context(grid.select(*keys, ts, v.alias(value), *span), keys, ts, span_of(step, SPAN_ROWS), known={"seen": seen})
    a, b = F.col("last_seen"), F.col("first_seen")
    share = (at - a["s"]) / (b["s"] - a["s"])
    filled = F.when(v.isNotNull(), v).when(a.isNotNull() & b.isNotNull(), a["v"] + (b["v"] - a["v"]) * share).otherwise(F.coalesce(a["v"], b["v"]))
    return both.filter(a.isNotNull() | b.isNotNull()).select(*keys, F.col(ts).cast("timestamp_ntz").alias(ts), filled.alias(value))


def fill_gaps(grid: DataFrame, keys: list[str], ts: str, value: str, step: int, z: float = OUTLIER_Z) -> DataFrame:
    """Outliers out, then interpolated: the rows are dealt by key and span once for both."""
    return interpolate(_marked(grid, keys, ts, value, step, z), keys, ts, value, step)


def by_row(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """``df`` with the times replaced by the number of the row in its series, in seconds since 1970, and the times beside
    them: the steps of a calendar with closed days. Only for one row a day or fewer."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(ts))
    return df.withColumn("_at", F.col(ts)).withColumn(ts, from_seconds(row.cast("long")))


def clean(series: DataFrame, keys: list[str], ts: str, value: str, step: int, load_order: str | None = None,
          regular: bool = True) -> DataFrame:
    """Model input: last load wins, regular grid, outliers out, interpolated; short series dropped.

    ``regular=False`` keeps a calendar with closed days as it is, without a grid: outliers and gaps are then found and filled
    in the order of the rows.
    """
    one = series.groupBy(*keys, ts).agg(F.max_by(value, load_order or value).alias(value))
    if regular:
        grid = regular_grid(one, keys, ts, value, step)
        whole = fill_gaps(grid, keys, ts, value, step)
    else:
        rows = by_row(one, keys, ts)
        filled = fill_gaps(rows.drop("_at"), keys, ts, value, 1)
        whole = filled.join(rows.select(*keys, ts, "_at"), [*keys, ts]).select(*keys, F.col("_at").alias(ts), value)
    enough = whole.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= MIN_OBS).select(*keys)
    return whole.join(enough, keys, "left_semi")


def validate(series: DataFrame, keys: list[str], ts: str, value: str, step: int, exact: bool, gaps: bool = True) -> DataFrame:
    """First violated rule per series, or NULL.

    ``exact`` asks for a gap of exactly one step (minutes); otherwise no gap may exceed a step (days). Without ``gaps``
    (a calendar with closed days) rows may lie any time apart.
    """
    v = F.col(value).cast("double")
    dup = series.groupBy(*keys, ts).agg(F.count("*").alias("_n"), F.min(v).alias("_v"),
                                        F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("_bad"))
    linked = with_context(dup, keys, ts, span_of(step, SPAN_ROWS), prev=(ts,))
    gap = seconds(ts) - seconds(f"prev_{ts}")
    broken = F.lit(False) if not gaps else (gap != step) if exact else (gap > step)
    agg = linked.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.count_if(F.col("_n") > 1).alias("duplicates"), F.sum("_bad").alias("invalid"),
        F.count_if(F.col("_v") <= 0).alias("not_positive"), F.count_if(broken).alias("gaps"))
    rule = (F.when(F.col("duplicates") > 0, "duplicate timestamps").when(F.col("invalid") > 0, "invalid values")
            .when(F.col("not_positive") > 0, "prices must be positive").when(F.col("gaps") > 0, "missing rows"))
    return agg.withColumn("violation", rule)
