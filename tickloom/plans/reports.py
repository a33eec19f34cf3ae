"""Performance reports: books of symbols x strategies, run together, summarized per strategy and model."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.operators import backtest as B, forecast as FC, metrics as M, signals as G
from tickloom.operators.coverage import eligible_symbols
from tickloom.session import cut_lineage

# Report defaults.
REPORT_MULTIPLIER, SWEEP = 0.25, [0.15, 0.25, 0.35]
FEE_BPS, SLIPPAGE_BPS = 10.0, 5.0


def in_range(bars: DataFrame, t: str, start: Column, end: Column) -> DataFrame:
    """Days of [start, end]; of a time column the bars of [start, end)."""
    day = dict(bars.dtypes)[t] == "date"
    return bars.filter((F.col(t) >= start) & ((F.col(t) <= end) if day else (F.col(t) < end)))


def buy_and_hold_rows(bars: DataFrame, t: str, start: Column, end: Column) -> DataFrame:
    """One BUY_AND_HOLD row per symbol: at the close, without cost."""
    signals = G.buy_and_hold(in_range(bars, t, start, end), ["symbol"], t)
    done = B.summary(B.equity_curve(signals, ["symbol"], t), ["symbol"], t)
    nothing = F.lit(None).cast("double")
    return done.select("symbol", F.lit("BUY_AND_HOLD").alias("strategy"), F.lit(None).cast("string").alias("model"), "status",
                       "total_return_pct", "mdd_pct", nothing.alias("mae_pct"), nothing.alias("rmse_pct"), "trade_count", "error_summary")


def prediction_rows(bars: DataFrame, decided: DataFrame, t: str, start: Column, end: Column, extra: list[str] | None = None) -> DataFrame:
    """One PREDICTION row per symbol and model: at the open of the execution bar, with cost.

    ``decided`` holds forecast rows with signals; a book with a missing, repeated or invalid signal
    fails on its own row and leaves the others alone.
    """
    keys = ["symbol", *(extra or [])]
    chosen = in_range(bars, t, start, end)
    if extra:
        chosen = chosen.join(decided.select(*keys).distinct(), "symbol")
    aligned = FC.align(chosen, decided, keys, t)
    book = [*keys, "model"]
    bad = aligned.groupBy(*book).agg(F.min("error").alias("signal_error"))
    clean = aligned.withColumn("signal", F.coalesce("signal", F.lit("HOLD")))
    run = B.summary(B.equity_curve(clean, book, t, True, FEE_BPS, SLIPPAGE_BPS), book, t)
    actual = chosen.select(*keys, F.col(t).alias("execution_time"), F.col("close").cast("double").alias("actual_price"))
    errors = decided.join(actual, [*keys, "execution_time"]).groupBy(*book).agg(*M.error_measures())
    joined = run.join(bad, book).join(errors, book, "left")
    ok = (F.col("status") == "SUCCESS") & F.col("signal_error").isNull()
    value = lambda c: F.when(ok, F.col(c)).alias(c)
    return joined.select(*keys, F.lit("PREDICTION").alias("strategy"), "model", F.when(ok, "SUCCESS").otherwise("FAILED").alias("status"),
                         *[value(c) for c in ("total_return_pct", "mdd_pct", "mae_pct", "rmse_pct", "trade_count")],
                         F.coalesce("signal_error", "error_summary").alias("error_summary"))


def performance_rows(bars: DataFrame, forecasts: DataFrame, t: str, start: Column, end: Column,
                     multiplier: float = REPORT_MULTIPLIER) -> DataFrame:
    """The report grid: buy-and-hold plus every forecast model, one row per symbol and model.

    The forecasts feed several joins, so they are checkpointed instead of fitted again for each.
    """
    decided = FC.decide(cut_lineage(forecasts), multiplier, FEE_BPS, SLIPPAGE_BPS)
    return buy_and_hold_rows(bars, t, start, end).unionByName(prediction_rows(bars, decided, t, start, end))


def threshold_rows(bars: DataFrame, forecasts: DataFrame, t: str, start: Column, end: Column, sweep=None) -> DataFrame:
    """The forecast rows once, decided with every multiplier, one book per symbol, model and multiplier."""
    multipliers = F.array(*[F.lit(float(m)) for m in (sweep or SWEEP)])
    spread = cut_lineage(forecasts).withColumn("multiplier", F.explode(multipliers))
    return prediction_rows(bars, FC.decide(spread, F.col("multiplier"), FEE_BPS, SLIPPAGE_BPS), t, start, end, ["multiplier"])


def eligible_bars(bars: DataFrame, start: Column, end: Column, minimum_history: int = FC.WARMUP) -> DataFrame:
    """Bars of the symbols with a complete range and enough history."""
    return bars.join(eligible_symbols(bars, start, end, minimum_history), "symbol", "left_semi")


def summarize(rows: DataFrame, keys=("strategy", "model")) -> DataFrame:
    return M.report_summary(rows, keys)
