"""Walk-forward forecasts, end-of-series forecasts, order choice, hold-out errors.

A walk-forward run refits every few bars on a bounded trailing history. Bars are cut into chunks of
blocks; a chunk also receives the history its first block needs, so chunks are independent, of bounded
size, and a symbol of any length spreads over many tasks. A refit inside a chunk is batched numpy.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions import arma
from tickloom.functions.timeparse import future_points, seconds
from .series import validate
from .signals import classify, threshold_pct

# Model names, defaults, order grid, hold-out rules.
PRICE_ARIMA, LOG_RETURN_ARIMA, AR_DIFF = "ARIMA", "LOG_RETURN_ARIMA", "ARIMA_110"
WARMUP, REFIT_EVERY, MAX_HISTORY, VOL_WINDOW, VOL_MULTIPLIER = 50, 5, 200, 20, 0.5
P_VALUES, D_VALUES, Q_VALUES = (0, 1, 2, 3), (0, 1), (0, 1, 2, 3)
MIN_RETURNS, MIN_TRAIN, HOLDOUT_MIN, HOLDOUT_SHARE, HOLDOUT_MAX_RETURNS = 30, 30, 10, 0.1, 30
#: Fits of one batch: enough that numpy's cost of a call is small beside its work.
BLOCKS_PER_CHUNK = 2048


def _fit_one_order(y, p, d, q, lengths, closed):
    batch = len(y)
    sizes = None if lengths is None else np.asarray(lengths) - d
    return arma.fit(np.diff(y, axis=1) if d else y, np.full(batch, p), np.full(batch, q), np.full(batch, d == 0), sizes, closed=closed)


def price_arima(history: np.ndarray, steps: int, lengths=None, order=(1, 1, 1), closed=False):
    """Mean, lower and upper of the next prices; one row per history, right-aligned to ``lengths``; ``closed`` see ``arma.fit``."""
    p, d, q = order
    mean, sd = arma.forecast(_fit_one_order(history, p, d, q, lengths, closed), steps, history[:, -1] if d else None)
    return mean, mean - arma.Z95 * sd, mean + arma.Z95 * sd


def log_return_arima(history: np.ndarray, steps: int, lengths=None, order=(1, 0, 1), closed=False):
    """ARIMA on log returns; mean and bounds are cumulated and restored to prices."""
    sizes = np.full(len(history), history.shape[1]) if lengths is None else np.asarray(lengths)
    if sizes.min() <= MIN_RETURNS:
        raise ValueError("insufficient history for log-return ARIMA")
    out = price_arima(np.diff(np.log(history), axis=1), steps, sizes - 1, order, closed)
    return tuple(history[:, -1:] * np.exp(np.cumsum(x, axis=1)) for x in out)


# Pluggable forecasters: (histories [block, time], steps) -> mean, lower, upper [block, step]. The
# built-in ones also take the real length of each right-aligned history, to fit blocks of a series start
# in one batch (minutes by closed forms); others are called once per length.
FORECASTERS = {PRICE_ARIMA: price_arima, LOG_RETURN_ARIMA: log_return_arima}


def positions(series: DataFrame, keys: list[str], t: str, start: Column, end: Column, step: int | None) -> DataFrame:
    """Add ``pos``: 0 at the first bar of the range, negative before it.

    On a gap-free grid (``step`` seconds) the position follows from the time alone and the range is [start, end).
    A calendar with closed days needs a rank, over one row per day, and the range is [start, end].
    """
    if step:
        first = F.ceil(seconds(start) / step) * step
        return series.withColumn("pos", F.floor((seconds(t) - first) / step)).filter(F.col(t) < end)
    w = Window.partitionBy(*keys)
    ranked = F.row_number().over(w.orderBy(t)) - 1 - F.count_if(F.col(t) < start).over(w)
    return series.filter(F.col(t) <= end).withColumn("pos", ranked.cast("long"))


def _volatility(history: np.ndarray, window: int) -> np.ndarray:
    tail = history[:, -(window + 1):]
    if tail.shape[1] < 3:
        return np.zeros(len(history))
    with np.errstate(all="ignore"):
        value = np.diff(np.log(tail), axis=1).std(axis=1, ddof=1) * 100.0
    return np.where((tail > 0).all(axis=1) & np.isfinite(value), value, 0.0)


def walk_forward(series: DataFrame, keys: list[str], t: str, value: str, models: list[str], start: Column, end: Column,
                 step: int | None = None, warmup: int = WARMUP, refit_every: int = REFIT_EVERY, max_history: int = MAX_HISTORY,
                 vol_window: int = VOL_WINDOW, forecasters=None) -> DataFrame:
    """Forecast rows per model and execution time, without thresholds.

    Blocks without enough history or with a forecast that is not finite and positive carry ``error``.
    """
    if warmup < 50 or refit_every < 1 or max_history < warmup:
        raise ValueError("invalid warmup, refit_every, or max_history")
    known = forecasters or FORECASTERS
    unknown = [m for m in models if m not in known]
    if unknown:
        raise ValueError(f"unsupported prediction model: {unknown}")
    span = refit_every * BLOCKS_PER_CHUNK
    series, refused = valid_series(series, keys, t, value, step, models)
    placed = positions(series.select(*keys, t, F.col(value).cast("double").alias("v")), keys, t, start, end, step)
    low = F.greatest(F.lit(0), F.floor(F.col("pos") / span))
    high = F.floor((F.col("pos") + max_history) / span)
    chunks = placed.filter(F.col("pos") >= -max_history).withColumn("chunk", F.explode(F.sequence(low, high)))
    chunks = chunks.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    key_types = dict(placed.dtypes)
    schema = ", ".join([f"{k} {key_types[k]}" for k in keys] + [
        "model string", f"signal_time {key_types[t]}", f"execution_time {key_types[t]}", "step int",
        "reference_price double", "predicted_price double", "volatility_pct double", "error string"])

    def run(key, pdf):
        chunk, model = int(key[-2]), key[-1]
        pdf = pdf.sort_values("pos")
        pos, v, times = pdf["pos"].to_numpy(), pdf["v"].to_numpy(float), pdf[t].to_numpy()
        starts = np.arange(chunk * span, min((chunk + 1) * span, int(pos[-1]) + 1), refit_every)
        at = np.searchsorted(pos, starts)
        keep = at < len(pos)
        parts, by_length = [], {}
        together = known is FORECASTERS
        for i in at[keep]:
            n = min(int(i), max_history)
            by_length.setdefault(n if n < warmup or not together else max_history, []).append(int(i))
        for n, heads in by_length.items():
            heads = np.array(heads)
            sizes = np.minimum(heads, n)
            if n < warmup:
                guess, vol, error = None, np.zeros(len(heads)), f"at least {warmup} observations are required (found {n})"
            else:
                history = v[np.maximum(heads[:, None] + np.arange(-n, 0)[None, :], 0)]
                error, vol = None, _volatility(history, vol_window)
                try:
                    more = {"lengths": sizes, "closed": step is not None} if together else {}
                    guess = np.asarray(known[model](history, refit_every, **more)[0], float)
                    if guess.shape != (len(heads), refit_every):
                        guess, error = None, "forecast returned the wrong number of values"
                except (ValueError, np.linalg.LinAlgError) as failure:
                    guess, error = None, str(failure)
            block, k = np.nonzero(heads[:, None] + np.arange(refit_every)[None, :] < len(pos))
            i = heads[block]
            p = guess[block, k] if guess is not None else np.full(len(i), np.nan)
            with np.errstate(invalid="ignore"):
                good = np.isfinite(p) & (p > 0)
            before = pd.Series(times[i - 1])
            parts.append(pd.DataFrame({
                **{name: [x] * len(i) for name, x in zip(keys, key)}, "model": model, "signal_time": before.where(pd.Series(i > 0), None),
                "execution_time": times[i + k], "step": (k + 1).astype(np.int32), "reference_price": np.where(i > 0, v[i - 1], np.nan),
                "predicted_price": np.where(good, p, np.nan) if error is None else np.full(len(i), np.nan), "volatility_pct": vol[block],
                "error": error if error is not None else np.where(good, None, "forecast returned invalid prediction values")}))
        names = [*keys, "model", "signal_time", "execution_time", "step", "reference_price", "predicted_price", "volatility_pct", "error"]
        return pd.concat(parts, ignore_index=True)[names] if parts else pd.DataFrame([], columns=names)

    return chunks.groupBy(*keys, "chunk", "model").applyInPandas(run, schema).unionByName(refused)


def valid_series(series: DataFrame, keys: list[str], t: str, value: str, step: int | None, models: list[str]) -> tuple[DataFrame, DataFrame]:
    """The series that may be forecast, and one row with ``error`` per model for each of the others.

    Minutes must follow each other without a gap; calendars with closed days may have gaps of any length.
    """
    rules = validate(series, keys, t, value, step or 86400, exact=step is not None, gaps=step is not None)
    broken = rules.filter(F.col("violation").isNotNull())
    none = lambda kind: F.lit(None).cast(kind)
    when = dict(series.dtypes)[t]
    refused = broken.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))).select(
        *keys, "model", none(when).alias("signal_time"), none(when).alias("execution_time"), none("int").alias("step"),
        *[none("double").alias(c) for c in ("reference_price", "predicted_price", "volatility_pct")], F.col("violation").alias("error"))
    return series.join(broken.select(*keys), keys, "left_anti"), refused


def ar_walk_forward(series: DataFrame, keys: list[str], t: str, value: str, start: Column, end: Column, step: int | None = None,
                    refit_every: int = REFIT_EVERY, max_history: int = MAX_HISTORY, vol_window: int = VOL_WINDOW,
                    warmup: int = WARMUP) -> DataFrame:
    """ARIMA(1,1,0) walk-forward by conditional least squares, all in window frames.

    The coefficient of a block is a ratio of two sums over its history, so no task-side code is needed.
    On a gap-free grid the frames run over time spans with the history copied in front.
    """
    series, refused = valid_series(series, keys, t, value, step, [AR_DIFF])
    placed = positions(series.select(*keys, t, F.col(value).cast("double").alias("v")), keys, t, start, end, step)
    part = list(keys)
    if step:
        reach, span = max_history + 2, 4096
        own, ahead = F.floor(F.col("pos") / span), F.floor((F.col("pos") + reach) / span)
        placed = placed.withColumn("_span", F.explode(F.array_distinct(F.array(own, ahead)))).withColumn("_halo", F.col("_span") != own)
        part.append("_span")
    w = Window.partitionBy(*part).orderBy("pos")
    d = F.col("v") - F.lag("v").over(w)
    df = placed.withColumns({"_d": d, "_r": F.ln(F.col("v") / F.lag("v").over(w))})
    df = df.withColumn("_pd", F.lag("_d").over(w))
    hist = w.rowsBetween(-(max_history - 2), -1)
    num, den = F.sum(F.col("_d") * F.col("_pd")).over(hist), F.sum(F.when(F.col("_d").isNotNull(), F.col("_pd") * F.col("_pd"))).over(hist)
    vol = F.stddev_samp("_r").over(w.rowsBetween(-vol_window, -1)) * 100
    seen = F.count("v").over(w.rowsBetween(-max_history, -1))
    df = df.withColumns({"_phi": F.when(den > 0, num / den).otherwise(0.0), "_vol": F.coalesce(vol, F.lit(0.0)), "_seen": seen,
                         "_last": F.lag("v").over(w), "_ld": F.lag("_d").over(w), "_st": F.lag(t).over(w)})
    if step:
        df = df.filter(~F.col("_halo"))
    df = df.filter(F.col("pos") >= 0).withColumn("_block", F.floor(F.col("pos") / refit_every))
    head = Window.partitionBy(*keys, "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda c: F.first(c).over(head)
    k = (F.col("pos") - F.col("_block") * refit_every + 1).cast("int")
    df = df.withColumns({"step": k, "phi": at("_phi"), "volatility_pct": at("_vol"), "history": at("_seen"), "reference_price": at("_last"),
                         "signal_time": at("_st"), "_ld0": at("_ld")})
    growth = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0.0), lambda acc, j: acc + F.pow(F.col("phi"), j))
    guess = F.col("reference_price") + F.coalesce("_ld0", F.lit(0.0)) * growth
    error = (F.when(F.col("history") < warmup, f"at least {warmup} observations are required")
             .when(~F.coalesce(guess > 0, F.lit(False)), "forecast returned invalid prediction values"))
    return df.select(*keys, F.lit(AR_DIFF).alias("model"), "signal_time", F.col(t).alias("execution_time"), "step", "reference_price",
                     F.when(error.isNull(), guess).alias("predicted_price"), "volatility_pct", error.alias("error")).unionByName(refused)


def decide(forecasts: DataFrame, multiplier: float | Column = VOL_MULTIPLIER, fee_bps: float = 10.0, slippage_bps: float = 5.0) -> DataFrame:
    """Expected return, threshold and signal of each forecast row."""
    expected = (F.col("predicted_price") / F.col("reference_price") - 1.0) * 100.0
    limit = threshold_pct(F.col("volatility_pct"), F.col("step").cast("double"), multiplier, fee_bps, slippage_bps)
    return forecasts.withColumns({"expected_return_pct": expected, "threshold_pct": limit}).withColumn(
        "signal", F.when(F.col("error").isNull(), classify(F.col("expected_return_pct"), F.col("threshold_pct"))))


def align(bars: DataFrame, signals: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Signal of every bar by execution time; a missing or repeated one is an error of that row."""
    book = [*keys, "model"]
    per_time = signals.groupBy(*book, F.col("execution_time").alias(t)).agg(
        F.count("*").alias("_n"), F.min("signal").alias("signal"), F.min("error").alias("_e"))
    books = signals.select(*book).distinct()
    grid = bars.join(books, keys).join(per_time, [*book, t], "left")
    error = (F.when(F.col("_n").isNull(), "missing prediction signal").when(F.col("_n") > 1, "duplicate prediction signal")
             .otherwise(F.col("_e")))
    return grid.withColumn("error", error).drop("_n", "_e")


# -- forecasts at the end of a series --------------------------------------------------------------

def forecast_ends(series: DataFrame, keys: list[str], t: str, value: str, models: list[str], horizon: int, step: int,
                  orders: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """``horizon`` points with 95 % bounds per model, from all observations of a series.

    A series is fitted in one task: daily bars, one row a day. Intraday series go through ``walk_forward``, whose
    chunks are bounded; a step below one day is refused here. A series that cannot be fitted has one row with ``error``.
    """
    if step < 86400:
        raise ValueError("forecasts at the end of intraday series are walk-forward runs")
    jobs = series.select(*keys, t, F.col(value).cast("double").alias("v")).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    types = dict(series.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["model string", "step int", "yhat double", "yhat_lower double",
                                                             "yhat_upper double", "last_value double", f"last_ts {types[t]}", "error string"])

    def run(key, pdf):
        pdf = pdf.sort_values(t)
        v = pdf["v"].to_numpy(float)[None, :]
        end = {"last_value": v[0, -1], "last_ts": pdf[t].iloc[-1]}
        try:
            kind, order = (key[-1], None) if orders is None else (key[-1], orders.get(key[-1]))
            mean, low, high = FORECASTERS[kind](v, horizon, **({"order": order} if order else {}))
            if not np.isfinite(mean).all():
                raise ValueError("forecast returned invalid prediction values")
        except (ValueError, np.linalg.LinAlgError) as failure:
            return pd.DataFrame({**{k: [x] for k, x in zip(keys, key)}, "model": key[-1], "step": None, "yhat": None, "yhat_lower": None,
                                 "yhat_upper": None, **end, "error": str(failure)})
        return pd.DataFrame({**{k: [x] * horizon for k, x in zip(keys, key)}, "model": key[-1], "step": np.arange(1, horizon + 1),
                             "yhat": mean[0], "yhat_lower": low[0], "yhat_upper": high[0], **end, "error": None})

    points = jobs.groupBy(*keys, "model").applyInPandas(run, schema)
    return points.withColumn("ts", F.when(F.col("error").isNull(), F.element_at(future_points("last_ts", step, horizon), F.coalesce("step", F.lit(1)))))


def order_scores(series: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """AIC of every order of the grid; one task per series, differencing and AR order."""
    jobs = (series.select(*keys, t, F.col(value).cast("double").alias("v"))
            .withColumn("d", F.explode(F.array(*[F.lit(d) for d in D_VALUES])))
            .withColumn("p", F.explode(F.array(*[F.lit(p) for p in P_VALUES]))))
    types = dict(series.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["p int", "d int", "q int", "aic double"])

    def run(key, pdf):
        d, p = int(key[-2]), int(key[-1])
        y = pdf.sort_values(t)["v"].to_numpy(float)
        y = np.diff(y) if d else y
        qs = np.array(Q_VALUES)
        m = arma.fit(np.tile(y, (len(qs), 1)), np.full(len(qs), p), qs, np.full(len(qs), d == 0))
        return pd.DataFrame({**{k: [x] * len(qs) for k, x in zip(keys, key)}, "p": p, "d": d, "q": qs, "aic": m["aic"]})

    return jobs.groupBy(*keys, "d", "p").applyInPandas(run, schema)


def best_order(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Order with the smallest finite AIC; the earlier order wins a tie. (1, 1, 1) where no fit has a finite AIC."""
    finite = F.col("aic").isNotNull() & ~F.isnan("aic") & (F.abs("aic") < float("inf"))
    best = scores.groupBy(*keys).agg(F.min(F.when(finite, F.struct("aic", "p", "d", "q"))).alias("b"))
    return best.select(*keys, *[F.coalesce(f"b.{c}", F.lit(1)).alias(c) for c in ("p", "d", "q")], "b.aic")


def split_holdout(series: DataFrame, keys: list[str], t: str, log_return: bool = False) -> DataFrame:
    """Mark the last rows of each series as test rows; series too short to train are dropped."""
    n = F.count("*").over(Window.partitionBy(*keys))
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(t).desc()))
    size = F.greatest(F.lit(HOLDOUT_MIN), F.floor(F.col("_n") * HOLDOUT_SHARE).cast("int"))
    size = F.least(F.lit(HOLDOUT_MAX_RETURNS), size) if log_return else size
    least = MIN_TRAIN + 1 if log_return else MIN_TRAIN
    df = series.withColumns({"_n": n, "_back": back}).withColumn("test_size", size)
    return df.filter(F.col("_n") - F.col("test_size") >= least).withColumn("is_test", F.col("_back") <= F.col("test_size")).drop("_n", "_back")


def holdout(series: DataFrame, keys: list[str], t: str, value: str, model: str, order: tuple[int, int, int] | None = None) -> DataFrame:
    """Forecast the held-out end of each series in one go; the errors are aggregated by Spark.

    Log returns need positive prices, other rows leave before the split. A series that cannot be fitted keeps its rows
    with an ``error`` and without predictions.
    """
    rows = series.select(*keys, t, F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    if model == LOG_RETURN_ARIMA:
        rows = rows.filter("v > 0")
    marked = split_holdout(rows, keys, t, model == LOG_RETURN_ARIMA)
    types = dict(series.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"{t} {types[t]}", "predicted_price double", "actual_price double", "test_size int", "error string"])

    def run(key, pdf):
        pdf = pdf.sort_values(t)
        test = pdf["is_test"].to_numpy(bool)
        v, steps = pdf["v"].to_numpy(float), int(test.sum())
        mean, error = np.full(steps, np.nan), None
        try:
            mean = FORECASTERS[model](v[~test][None, :], steps, **({"order": order} if order else {}))[0][0]
        except (ValueError, np.linalg.LinAlgError) as failure:
            error = str(failure)
        return pd.DataFrame({**{k: [x] * steps for k, x in zip(keys, key)}, t: pdf[t].to_numpy()[test], "predicted_price": mean if error is None else None,
                             "actual_price": v[test], "test_size": steps, "error": error})

    return marked.groupBy(*keys).applyInPandas(run, schema)
