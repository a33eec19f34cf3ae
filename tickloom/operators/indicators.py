"""Daily technical indicators for every date at once.

An indicator of a date sees the newest 60 rows up to that date. One window specification per symbol
and source gives all of them in a single sort; a series has one row per day, so its size is bounded
by the calendar. Plain averages come from frames; the recursive ones (EMA, MACD signal, RSI) from one
fold over the 60 closes of the frame.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LOOKBACK = 60
# Periods of the indicator set.
BAND, STOCH_K, STOCH_D, ATR, RSI, FAST, SLOW, SIGNAL = 20, 14, 3, 14, 14, 12, 26, 9
SERIES = ["symbol", "source"]


def _series_window(keys=SERIES, order="trade_date"):
    return Window.partitionBy(*keys).orderBy(order)


def _rows(w, n: int):
    return w.rowsBetween(-(n - 1), 0)


def sma(value: str, n: int, w) -> Column:
    """Mean of the last ``n`` values half up to 8 digits, NULL while there are fewer."""
    frame = _rows(w, n)
    return F.when(F.count(value).over(frame) == n, F.round(F.sum(value).over(frame) / n, 8)).cast("decimal(24,8)")


def stddev(value: str, n: int, w) -> Column:
    frame = _rows(w, n)
    sd = F.stddev_pop(F.col(value).cast("double")).over(frame)
    return F.when(F.count(value).over(frame) == n, F.round(sd.cast("decimal(28,12)"), 8)).cast("decimal(24,8)")


def stochastic_k(n: int, w) -> Column:
    frame = _rows(w, n)
    low, high = F.min("low").over(frame), F.max("high").over(frame)
    spread = high - low
    k = F.when(spread == 0, F.lit(50)).otherwise(F.round((F.col("close") - low) / spread * 100, 4))
    return F.when(F.count("close").over(frame) == n, k).cast("decimal(8,4)")


def true_range(prev_close: Column) -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev_close), F.abs(F.col("low") - prev_close))


def _ema_step(i: Column, acc: Column, x: Column, n: int) -> Column:
    """Running sum up to ``n`` values, their mean at ``n``, then the exponential step."""
    alpha = 2.0 / (n + 1)
    return F.when(i < n, acc + x).when(i == n, (acc + x) / n).otherwise(x * alpha + acc * (1 - alpha))


def _wilder_step(j: Column, acc: Column, x: Column, n: int) -> Column:
    return F.when(j < n, acc + x).when(j == n, (acc + x) / n).otherwise(x / n + acc * (1 - 1.0 / n))


def _fold(closes: Column) -> Column:
    """One pass over the closes: both EMAs, the MACD signal, Wilder gain and loss."""
    zero = F.lit(0.0)
    start = F.struct(F.lit(0).alias("i"), zero.alias("fast"), zero.alias("slow"), zero.alias("sig"),
                     zero.alias("prev"), zero.alias("gain"), zero.alias("loss"))

    def step(s, x):
        i = s["i"] + 1
        fast, slow = _ema_step(i, s["fast"], x, FAST), _ema_step(i, s["slow"], x, SLOW)
        k = i - (SLOW - 1)
        sig = F.when(k < 1, zero).otherwise(_ema_step(k, s["sig"], fast - slow, SIGNAL))
        d = F.when(i == 1, zero).otherwise(x - s["prev"])
        j = i - 1
        return F.struct(i.alias("i"), fast.alias("fast"), slow.alias("slow"), sig.alias("sig"), x.alias("prev"),
                        _wilder_step(j, s["gain"], F.greatest(d, zero), RSI).alias("gain"),
                        _wilder_step(j, s["loss"], F.greatest(-d, zero), RSI).alias("loss"))

    return F.aggregate(closes, start, step)


def ema(closes: Column, n: int) -> Column:
    """EMA of an array of closes, oldest first; NULL while it has fewer than ``n``."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("e"))
    folded = F.aggregate(closes, start, lambda s, x: F.struct(
        (s["i"] + 1).alias("i"), _ema_step(s["i"] + 1, s["e"], x, n).alias("e")), lambda s: s["e"])
    return F.when(F.size(closes) >= n, _dec(folded))


def rsi(closes: Column, n: int) -> Column:
    """Wilder RSI of an array of closes, 4 digits; 100 without losses, NULL while it is short."""
    zero = F.lit(0.0)
    start = F.struct(F.lit(0).alias("i"), zero.alias("prev"), zero.alias("g"), zero.alias("l"))

    def step(s, x):
        d = F.when(s["i"] == 0, zero).otherwise(x - s["prev"])
        return F.struct((s["i"] + 1).alias("i"), x.alias("prev"),
                        _wilder_step(s["i"], s["g"], F.greatest(d, zero), n).alias("g"),
                        _wilder_step(s["i"], s["l"], F.greatest(-d, zero), n).alias("l"))

    end = F.aggregate(closes, start, step)
    return F.when(F.size(closes) > n, _rsi_of(end["g"], end["l"]))


def _rsi_of(gain: Column, loss: Column) -> Column:
    value = F.when(loss == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + gain / loss))
    return F.round(value.cast("decimal(18,10)"), 4).cast("decimal(8,4)")


def _dec(value: Column) -> Column:
    return F.round(value.cast("decimal(28,12)"), 8).cast("decimal(24,8)")


def daily_indicators(bars: DataFrame, keys=tuple(SERIES)) -> DataFrame:
    """All indicators per series and date; ``bars`` holds one row per series and date."""
    w = _series_window(keys)
    framed = bars.select(
        *keys, "trade_date", "close", "high", "low", "volume",
        F.row_number().over(w).alias("rn"),
        F.lag("close").over(w).alias("pc"),
        F.collect_list(F.col("close").cast("double")).over(_rows(w, LOOKBACK)).alias("closes"),
        sma("close", 5, w).alias("ma5"), sma("close", 20, w).alias("ma20"), sma("close", 60, w).alias("ma60"),
        stddev("close", BAND, w).alias("sd"), stochastic_k(STOCH_K, w).alias("stoch_k"))
    volume = F.floor("volume").cast("long")
    signed = (F.when(F.col("pc").isNull(), F.lit(0)).when(F.col("close") > F.col("pc"), volume)
              .when(F.col("close") < F.col("pc"), -volume).otherwise(F.lit(0)))
    stepped = framed.withColumns({"tr": true_range(F.col("pc")), "signed": signed.cast("long"), "f": _fold(F.col("closes"))})
    n = F.size("closes")
    line = F.when(n >= SLOW, _dec(_dec(F.col("f.fast")) - _dec(F.col("f.slow"))))
    sig = F.when(n >= SLOW + SIGNAL - 1, _dec(F.col("f.sig")))
    band = F.col("sd") * 2
    return stepped.select(
        *keys, "trade_date", "ma5", "ma20", "ma60",
        F.when(n > RSI, _rsi_of(F.col("f.gain"), F.col("f.loss"))).alias("rsi14"),
        line.alias("macd_line"), sig.alias("macd_signal"), (line - sig).cast("decimal(24,8)").alias("macd_hist"),
        (F.col("ma20") + band).cast("decimal(24,8)").alias("bb_upper"), (F.col("ma20") - band).cast("decimal(24,8)").alias("bb_lower"),
        "stoch_k", sma("stoch_k", STOCH_D, w).alias("stoch_d"),
        F.when(F.col("rn") > ATR, F.round(F.sum("tr").over(_rows(w, ATR)) / ATR, 8)).cast("decimal(24,8)").alias("atr14"),
        F.sum("signed").over(_rows(w, LOOKBACK - 1)).alias("obv"))
