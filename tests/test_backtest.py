"""Engine values, costs, ignored signals, and random books against a sequential loop."""
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import backtest as B, signals as G


def bars(spark, rows, book="b"):
    df = spark.createDataFrame([(book, i, float(o), float(c), s) for i, (o, c, s) in enumerate(rows)], "symbol string, i int, open double, close double, signal string")
    return df.select("symbol", F.date_add(F.lit("2025-01-01").cast("date"), F.col("i")).alias("d"), "open", "close", "signal")


def run(spark, rows, cash=1000.0, **mode):
    curve = B.equity_curve(bars(spark, rows), ["symbol"], "d", cash=cash, **mode)
    return curve, B.summary(curve, ["symbol"], "d", cash).first()


def test_doubling(spark):
    _, s = run(spark, [(100, 100, "BUY"), (150, 150, "HOLD"), (200, 200, "HOLD")])
    assert float(s.final_equity) == 2000 and float(s.total_return_pct) == 100 and s.win_rate_pct is None


def test_drawdown(spark):
    _, s = run(spark, [(100, 100, "BUY"), (200, 200, "HOLD"), (100, 100, "HOLD")])
    assert float(s.mdd_pct) == 50


def test_round_trip(spark):
    curve, s = run(spark, [(100, 100, "BUY"), (120, 120, "SELL")])
    t = B.trades(curve, ["symbol"], "d").orderBy("seq").collect()
    assert [x.side for x in t] == ["BUY", "SELL"] and float(t[1].pnl_pct) == 20 and float(s.win_rate_pct) == 100


def test_open_execution_and_costs(spark):
    curve, _ = run(spark, [(100, 150, "BUY"), (100, 100, "SELL")], at_open=True, fee_bps=100, slippage_bps=100)
    prices = [float(x.price) for x in B.trades(curve, ["symbol"], "d").orderBy("seq").collect()]
    assert prices == [101.0, 99.0]


def test_invalid_signals_are_ignored(spark):
    curve, _ = run(spark, [(10, 10, "SELL"), (10, 10, "BUY"), (10, 10, "BUY")])
    assert [x.side for x in B.trades(curve, ["symbol"], "d").collect()] == ["BUY"]


def test_bad_price_fails_only_its_book(spark):
    both = bars(spark, [(10, 10, "BUY"), (0, 0, "SELL")], "bad").unionByName(bars(spark, [(10, 10, "BUY"), (11, 11, "SELL")], "good"))
    rows = {r.symbol: r for r in B.summary(B.equity_curve(both, ["symbol"], "d"), ["symbol"], "d").collect()}
    assert rows["bad"].status == "FAILED" and rows["bad"].final_equity is None
    assert rows["good"].status == "SUCCESS" and float(rows["good"].total_return_pct) == 10


@pytest.mark.parametrize("kw", [dict(fee_bps=-1), dict(slippage_bps=10000), dict(cash=0)])
def test_guards(spark, kw):
    with pytest.raises(ValueError):
        B.equity_curve(bars(spark, [(1, 1, "BUY")]), ["symbol"], "d", **kw)


def loop(rows, cash, fee, slip):
    money, qty, peak, mdd, out = cash, 0.0, cash, 0.0, []
    for o, c, s in rows:
        if s == "BUY" and qty == 0:
            qty, money = money / (o * (1 + slip) * (1 + fee)), 0.0
        elif s == "SELL" and qty > 0:
            money, qty = qty * o * (1 - slip) * (1 - fee), 0.0
        eq = money + qty * c
        peak = max(peak, eq)
        mdd = max(mdd, (peak - eq) / peak * 100)
        out.append(eq)
    return out, mdd


def test_random_book_matches_loop(spark):
    rnd = random.Random(5)
    rows = [(rnd.uniform(90, 110), rnd.uniform(90, 110), rnd.choice(["BUY", "SELL", "HOLD"])) for _ in range(300)]
    curve, s = run(spark, rows, 10000.0, at_open=True, fee_bps=10, slippage_bps=5)
    got = [float(r.equity) for r in curve.orderBy("d").collect()]
    want, mdd = loop(rows, 10000.0, 0.001, 0.0005)
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-6
    assert abs(float(s.mdd_pct) - mdd) < 1e-5


def test_crossover_contains_buy(spark):
    closes = [100, 98, 96, 94, 92, 95, 100, 108, 118, 130]
    df = bars(spark, [(c, c, "HOLD") for c in closes]).drop("signal")
    got = [r.signal for r in G.signals_for("MA_CROSSOVER", df, ["symbol"], "d", {"shortPeriod": "3", "longPeriod": 5}).orderBy("d").collect()]
    assert "BUY" in got and set(got[:5]) == {"HOLD"}
    with pytest.raises(ValueError):
        G.signals_for("MA_CROSSOVER", df, ["symbol"], "d", {"shortPeriod": "x"})
    with pytest.raises(ValueError):
        G.signals_for("PREDICTION", df, ["symbol"], "d")


@pytest.mark.parametrize("period", [2, 14])
def test_rsi_scan_matches_loop(spark, period):
    """1,300 rows cross several chunks of the two-level scan."""
    rnd = random.Random(period)
    closes = [100 + rnd.gauss(0, 5) for _ in range(1300)]
    df = bars(spark, [(c, c, "HOLD") for c in closes]).drop("signal")
    got = [r.rsi for r in G.with_rsi(df, ["symbol"], "d", period).orderBy("d").collect()]
    d = [b - a for a, b in zip(closes, closes[1:])]
    g, l = sum(max(x, 0) for x in d[:period]) / period, sum(max(-x, 0) for x in d[:period]) / period
    want = [None] * (period + 1)
    for x in d[period:]:
        g, l = (g * (period - 1) + max(x, 0)) / period, (l * (period - 1) + max(-x, 0)) / period
        want.append(100.0 if l == 0 else 100 - 100 / (1 + g / l))
    assert all((a is None) == (b is None) for a, b in zip(got, want))
    assert max(abs(a - b) for a, b in zip(got, want) if b is not None) < 1e-8


@pytest.mark.parametrize("span_rows", [1, 7, 64])
def test_books_cut_into_spans_equal_whole_books(spark, monkeypatch, span_rows):
    """Positions, products, entries and peaks pass from span to span, whatever the spans hold."""
    rnd = random.Random(span_rows)
    rows = [(rnd.uniform(50, 150), rnd.uniform(50, 150), rnd.choice(["BUY", "SELL", *["HOLD"] * 6])) for _ in range(200)]
    many = bars(spark, rows).unionByName(bars(spark, rows[100:], "late")).unionByName(bars(spark, [(1, 1, "HOLD")] * 30, "idle"))

    def figures():
        curve = B.equity_curve(many, ["symbol"], "d", True, 10, 5, 10000.0, step)
        flat = [(r.symbol, str(r.d), r.fill, r.held, round(float(r.equity), 5), round(float(r.drawdown_pct), 4), r.pnl_pct and round(float(r.pnl_pct), 4)) for r in curve.collect()]
        return sorted(flat, key=str), sorted((r.symbol, r.seq, str(r.d), r.side) for r in B.trades(curve, ["symbol"], "d", step).collect())
    step = 86400
    whole = figures()
    monkeypatch.setattr(B, "SPAN_ROWS", span_rows * 24)
    step = 3600  # spans of ``span_rows`` days
    assert figures() == whole


def test_signals_of_minute_books_do_not_depend_on_spans(spark, monkeypatch):
    rnd, closes = random.Random(4), [200.0]
    while len(closes) < 900:
        closes.append(closes[-1] + rnd.gauss(0, 1))
    df = spark.createDataFrame([("b", i, c) for i, c in enumerate(closes)], "symbol string, i int, close double").select(
        "symbol", F.timestamp_seconds(F.col("i") * 60).cast("timestamp_ntz").alias("ts"), "close")

    def signals():
        out = []
        for name, params in (("BUY_AND_HOLD", {}), ("MA_CROSSOVER", {"shortPeriod": 3, "longPeriod": 40}), ("RSI", {"period": 14})):
            out.append([r.signal for r in G.signals_for(name, df, ["symbol"], "ts", params, 60).orderBy("ts").collect()])
        out.append([r.signal for r in G.delayed(G.signals_for("RSI", df, ["symbol"], "ts", step=60), ["symbol"], "ts", F.lit("HOLD"), 60).orderBy("ts").collect()])
        return out
    whole = signals()
    monkeypatch.setattr(G, "SPAN_ROWS", 50)
    assert signals() == whole and all(len(set(s)) > 1 for s in whole)


def test_a_long_book_spreads_over_tasks(spark):
    """No window of the run is keyed by the book alone except over one row per span."""
    df = spark.range(0, 40_000).select(F.lit("b").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
                                       (F.lit(100) + F.sin("id")).alias("open"), (F.lit(100) + F.cos("id")).alias("close"))
    curve = B.equity_curve(G.signals_for("RSI", df, ["symbol"], "ts", step=60), ["symbol"], "ts", step=60)
    plan = curve._jdf.queryExecution().optimizedPlan().toString()
    keyed_by_book = [line for line in plan.splitlines() if "Window [" in line and line.rstrip().split("], [")[-2:][0].count("#") == 1]
    assert all("_span" in line or "_chunk" in line for line in keyed_by_book) and "Window [" in plan
    assert B.summary(curve, ["symbol"], "ts").first().bar_count == 40_000
