"""Strategies: functions from ordered bars to a signal column, without look-ahead.

``STRATEGIES`` is the registry; a strategy takes (bars, book keys, time column, parameters, seconds from bar to bar) and
adds ``signal``. Books of any length run in spans of bars (see ``spans``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .recurrence import decayed_sums
from .spans import DAY, SPAN_ROWS, span_of, with_context, with_row_chunks

# Default parameters.
DEFAULTS = {
    "BUY_AND_HOLD": {},
    "MA_CROSSOVER": {"shortPeriod": 5, "longPeriod": 20},
    "RSI": {"period": 14, "oversold": 30.0, "overbought": 70.0},
}


def buy_and_hold(bars: DataFrame, keys: list[str], t: str, step: int = DAY) -> DataFrame:
    seen = with_context(bars.withColumn("_one", F.lit(1)), keys, t, span_of(step, SPAN_ROWS), prev=("_one",))
    return seen.withColumn("signal", F.when(F.col("prev__one").isNull(), "BUY").otherwise("HOLD")).drop("_one", "prev__one")


def ma_crossover(bars: DataFrame, keys: list[str], t: str, shortPeriod: int = 5, longPeriod: int = 20, step: int = DAY) -> DataFrame:
    """Crossings of two moving averages. Rows are numbered and cut into chunks that bring the rows their frames reach back to."""
    if not 1 <= shortPeriod < longPeriod:
        raise ValueError("require 1 <= shortPeriod < longPeriod")
    numbered = with_context(bars, keys, t, span_of(step, SPAN_ROWS), number="_i")
    whole = span_of(step) is None
    cut = numbered if whole else with_row_chunks(numbered, "_i", max(SPAN_ROWS, longPeriod + 1), longPeriod)
    w = Window.partitionBy(*keys).orderBy(t) if whole else Window.partitionBy(*keys, "_chunk").orderBy(t)
    price = F.col("close").cast("double")
    cut = cut.withColumns({"_s": F.avg(price).over(w.rowsBetween(-(shortPeriod - 1), 0)), "_l": F.avg(price).over(w.rowsBetween(-(longPeriod - 1), 0))})
    ps, pl = F.lag("_s").over(w), F.lag("_l").over(w)
    golden = (ps <= pl) & (F.col("_s") > F.col("_l"))
    dead = (ps >= pl) & (F.col("_s") < F.col("_l"))
    ready = F.col("_i") >= longPeriod
    signal = F.when(ready & golden, "BUY").when(ready & dead, "SELL").otherwise("HOLD")
    out = cut.withColumn("signal", signal)
    return (out if whole else out.filter(~F.col("_halo"))).drop("_s", "_l", "_i", "_chunk", "_halo")


def with_rsi(bars: DataFrame, keys: list[str], t: str, period: int, step: int = DAY) -> DataFrame:
    """Wilder RSI over the full history; NULL up to the seed row, which only seeds.

    The seed is the mean of the first ``period`` moves. Fed as moves grown by what the decay takes from them until the seed row, they
    sum to that mean there, so no row has to find its series' beginning.
    """
    bars = bars.withColumn("_close", F.col("close").cast("double"))
    seen = with_context(bars, keys, t, span_of(step, SPAN_ROWS), prev=("_close",), number="_i")
    d, zero, a = F.col("_close") - F.col("prev__close"), F.lit(0.0), (period - 1) / period
    grown = F.when(F.col("_i") <= period, F.pow(F.lit(a), (F.col("_i") - period).cast("double"))).otherwise(1.0)
    fed = seen.withColumns({"_xg": F.greatest(d, zero) / period * grown, "_xb": F.greatest(-d, zero) / period * grown})
    run = decayed_sums(fed, keys, "_i", {"_ag": "_xg", "_ab": "_xb"}, a)
    value = F.when(F.col("_ab") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.col("_ag") / F.col("_ab")))
    return run.withColumn("rsi", F.when(F.col("_i") > period, value)).drop("_i", "_close", "prev__close", "_xg", "_xb", "_ag", "_ab")


def rsi_signals(bars: DataFrame, keys: list[str], t: str, period: int = 14, oversold: float = 30.0,
                overbought: float = 70.0, step: int = DAY) -> DataFrame:
    if period < 2 or not 0 < oversold < overbought < 100:
        raise ValueError("require period >= 2 and 0 < oversold < overbought < 100")
    r = with_rsi(bars, keys, t, period, step)
    signal = F.when(F.col("rsi") <= oversold, "BUY").when(F.col("rsi") >= overbought, "SELL").otherwise("HOLD")
    return r.withColumn("signal", signal).drop("rsi")


STRATEGIES = {"BUY_AND_HOLD": buy_and_hold, "MA_CROSSOVER": ma_crossover, "RSI": rsi_signals}


def signals_for(strategy: str, bars: DataFrame, keys: list[str], t: str, params: dict | None = None, step: int = DAY) -> DataFrame:
    """Signals of a named strategy; text parameters are read as numbers. ``step``: seconds from bar to bar."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unsupported strategy: {strategy}")
    chosen = {}
    for name, default in DEFAULTS[strategy].items():
        raw = (params or {}).get(name, default)
        try:
            chosen[name] = type(default)(raw)
        except (TypeError, ValueError):
            raise ValueError(f"Parameter '{name}' must be a number, got: {raw}") from None
    return STRATEGIES[strategy](bars, keys, t, step=step, **chosen)


def delayed(signals: DataFrame, keys: list[str], t: str, initial: Column, step: int = DAY) -> DataFrame:
    """Signal of bar i-1 executes on bar i; the first bar takes ``initial``."""
    linked = with_context(signals, keys, t, span_of(step, SPAN_ROWS), prev=("signal",))
    return linked.withColumn("signal", F.coalesce("prev_signal", initial)).drop("prev_signal")


def classify(expected_pct: Column, threshold_pct: Column) -> Column:
    return F.when(expected_pct > threshold_pct, "BUY").when(expected_pct < -threshold_pct, "SELL").otherwise("HOLD")


def threshold_pct(volatility_pct: Column, step: Column, multiplier: float | Column = 0.5, fee_bps: float = 10.0,
                  slippage_bps: float = 5.0) -> Column:
    """Round-trip cost plus a volatility margin that grows with the square root of the step."""
    k = multiplier if isinstance(multiplier, Column) else F.lit(multiplier)
    return F.lit(2.0 * (fee_bps + slippage_bps) / 100.0) + k * volatility_pct * F.sqrt(step)
