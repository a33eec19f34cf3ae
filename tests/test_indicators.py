"""Hand-computed indicator values."""
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import indicators as I


def arr(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def daily(spark, closes, high=None, low=None, volume=None):
    rows = [("S", "X", i, float(c), float((high or closes)[i]), float((low or closes)[i]), float((volume or [1] * len(closes))[i])) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "symbol string, source string, i int, close double, high double, low double, volume double")
    return df.select("symbol", "source", F.date_add(F.lit("2025-01-01").cast("date"), F.col("i")).alias("trade_date"),
                     *[F.col(c).cast("decimal(24,8)").alias(c) for c in ("close", "high", "low", "volume")])


def last(spark, df):
    return I.daily_indicators(df).orderBy(F.desc("trade_date")).first()


def test_ema_seeds_with_mean(spark):
    assert float(one(spark, I.ema(arr(1, 2, 3, 4, 5), 3))) == 4.0
    assert one(spark, I.ema(arr(1, 2), 3)) is None


def test_rsi_wilder(spark):
    assert float(one(spark, I.rsi(arr(10, 11, 10, 12), 2))) == 83.3333
    assert float(one(spark, I.rsi(arr(1, 2, 3, 4), 2))) == 100.0
    assert one(spark, I.rsi(arr(1, 2), 2)) is None


def test_bollinger(spark):
    r = last(spark, daily(spark, [10] * 19 + [30]))
    assert float(r.ma20) == 11.0
    assert float(r.bb_upper) == 19.71779788 and float(r.bb_lower) == 2.28220212


def test_short_history_has_no_long_averages(spark):
    r = last(spark, daily(spark, [1, 2, 3, 4, 5]))
    assert float(r.ma5) == 3.0 and r.ma20 is None and r.ma60 is None and r.rsi14 is None and r.macd_line is None


def test_stochastic_flat_range_is_neutral(spark):
    assert float(last(spark, daily(spark, [5] * 14)).stoch_k) == 50.0


def test_obv_direction(spark):
    assert last(spark, daily(spark, [10, 11, 11, 9], volume=[100, 200, 300, 400])).obv == -200


def test_atr(spark):
    closes = [10] * 16
    assert float(last(spark, daily(spark, closes, [c + 2 for c in closes], [c - 1 for c in closes])).atr14) == 3.0


def reference_fold(closes):
    """The recursions, step by step, over one 60-row frame."""
    def ema(xs, p):
        if len(xs) < p:
            return None
        e = sum(xs[:p]) / p
        for x in xs[p:]:
            e = x * 2 / (p + 1) + e * (1 - 2 / (p + 1))
        return e
    line = ema(closes, 12) - ema(closes, 26) if len(closes) >= 26 else None
    lines = [ema(closes[:i], 12) - ema(closes[:i], 26) for i in range(26, len(closes) + 1)]
    return line, ema(lines, 9) if len(lines) >= 9 else None


@pytest.mark.parametrize("n", [25, 26, 33, 34, 60, 75])
def test_macd_against_loop(spark, n):
    rnd = random.Random(n)
    closes = [round(100 + rnd.random() * 20, 2) for _ in range(n)]
    r = last(spark, daily(spark, closes))
    line, sig = reference_fold(closes[-60:])
    for got, want in ((r.macd_line, line), (r.macd_signal, sig)):
        assert (got is None) == (want is None)
        if want is not None:
            assert abs(float(got) - want) < 1e-6
