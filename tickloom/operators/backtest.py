"""All-in long-only backtests of any number of books of any length as window algebra.

With market price m, slippage s and fee f a BUY fill multiplies the book by 1/(m(1+s)(1+f)), a SELL
fill by m(1-s)(1-f). Equity is cash times the running product of these factors, times the close while
the book holds.

A book is cut into spans of bars. What a span does to a book depends on the bars before it only by whether the book holds
at its start, by the product so far, by the factor of the last BUY and by the peak. So every span is run for both starts
(flat and holding) in windows of its own, one row per span says what it does to either, and a window over these rows
composes them. All windows over bars share one partitioning by book and span. Books of daily bars, which the calendar bounds,
are one span each.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .neighbors import with_span
from .spans import DAY, SPAN_ROWS, span_of, with_context

DEFAULT_CASH = 10000.0
BPS = 10000.0


def _rates(fee_bps: float, slippage_bps: float) -> tuple[float, float]:
    fee, slip = fee_bps / BPS, slippage_bps / BPS
    if not (0 <= fee < 1 and 0 <= slip < 1):
        raise ValueError("fee and slippage rates must be in [0, 1)")
    return fee, slip


def _dec(value: Column, scale: int) -> Column:
    """Half up at a scale; a value too large for a decimal becomes NULL instead of failing the job."""
    return F.round(value.try_cast("decimal(38,12)"), scale)


def _pick(column: str) -> Column:
    """The value for the start that the book really has in this span."""
    return F.when(F.col("_held"), F.col(f"_{column}_h")).otherwise(F.col(f"_{column}_f"))


def _composed(df: DataFrame, book: list[str], t: str, starts, equity_of) -> DataFrame:
    """One row per book and span: whether the book holds at its start, product and last BUY factor before it, peak before it."""
    bought = lambda x: F.when((F.col(f"_fill_{x}") == "BUY") & F.col(f"_f_{x}").isNotNull(), F.col(t))
    spans = df.groupBy(*book, "_span").agg(
        F.max_by("_d", F.when(F.col("_d").isNotNull(), F.col(t))).alias("_d"), *[c for x in starts for c in (
            F.coalesce(F.product(f"_f_{x}"), F.lit(1.0)).alias(f"_p_{x}"), F.max_by(f"_f_{x}", bought(x)).alias(f"_e_{x}"), F.max(f"_v_{x}").alias(f"_v_{x}"))])
    earlier = Window.partitionBy(*book).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_held", F.coalesce(F.last("_d", ignorenulls=True).over(earlier) == "BUY", F.lit(False)))
    spans = spans.select(*book, "_span", "_held", _pick("v").alias("_v"), F.coalesce(F.product(_pick("p")).over(earlier), F.lit(1.0)).alias("_before"),
                         F.last(_pick("e"), ignorenulls=True).over(earlier).alias("_bought"))
    return spans.withColumn("_top", equity_of(F.col("_before") * F.col("_v"))).select(
        *book, "_span", "_held", "_before", "_bought", F.max("_top").over(earlier).alias("_peak"))


def equity_curve(bars: DataFrame, book: list[str], t: str, at_open: bool = False, fee_bps: float = 0.0,
                 slippage_bps: float = 0.0, cash: float = DEFAULT_CASH, step: int = DAY) -> DataFrame:
    """One row per bar: fill, equity, drawdown. ``bars`` has open, close and ``signal``; ``step``: seconds from bar to bar."""
    if cash <= 0:
        raise ValueError("initialCash must be positive")
    fee, slip = _rates(fee_bps, slippage_bps)
    span = span_of(step, SPAN_ROWS)
    w = Window.partitionBy(*book, *(["_span"] if span else [])).orderBy(t)
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    df = (with_span(bars, t, span) if span else bars).withColumns({
        "_m": F.col("open" if at_open else "close").cast("double"), "_c": F.col("close").cast("double"),
        "_d": F.when(F.col("signal") != "HOLD", F.col("signal"))})
    df = df.withColumns({"_d0": F.last("_d", ignorenulls=True).over(before), "_d1": F.last("_d", ignorenulls=True).over(so_far)})
    starts = {"f": "SELL", "h": "BUY"} if span else {"f": "SELL"}  # flat or holding at the start of a span, as after such a signal
    for x, signal in starts.items():
        was, held = (F.coalesce(d, F.lit(signal)) == "BUY" for d in ("_d0", "_d1"))
        fill = F.when(~was & held, "BUY").when(was & ~held, "SELL")
        factor = (F.when(~(F.col("_m") > 0), F.lit(None).cast("double"))
                  .when(fill == "BUY", 1.0 / (F.col("_m") * (1 + slip) * (1 + fee)))
                  .when(fill == "SELL", F.col("_m") * (1 - slip) * (1 - fee)).otherwise(1.0))
        df = df.withColumns({f"_is_{x}": held, f"_fill_{x}": fill, f"_f_{x}": factor})
    df = df.withColumns({c: e for x in starts for c, e in {
        f"_p_{x}": F.coalesce(F.product(f"_f_{x}").over(so_far), F.lit(1.0)),
        f"_e_{x}": F.last(F.when(F.col(f"_fill_{x}") == "BUY", F.col(f"_f_{x}")), ignorenulls=True).over(before)}.items()})
    df = df.withColumns({f"_v_{x}": F.col(f"_p_{x}") * F.when(F.col(f"_is_{x}"), F.col("_c")).otherwise(1.0) for x in starts})

    def equity_of(value: Column) -> Column:
        return _dec(F.lit(cash) * value, 8).try_cast("decimal(28,8)")
    if span:
        carry = _composed(df, book, t, starts, equity_of)
        df = df.join(carry, [*book, "_span"])
    else:
        df = df.withColumns({"_held": F.lit(False), "_before": F.lit(1.0), "_bought": F.lit(None).cast("double"), "_peak": F.lit(None).cast("decimal(28,8)")})
    pick = _pick if span else lambda c: F.col(f"_{c}_f")
    df = df.withColumns({
        "_is": pick("is"), "fill": pick("fill"), "_f": pick("f"), "_p": F.col("_before") * pick("p"), "_entry": F.coalesce(pick("e"), F.col("_bought"))})
    df = df.withColumn("equity", equity_of(F.col("_p") * F.when(F.col("_is"), F.col("_c")).otherwise(1.0)))
    peak = F.greatest(F.lit(cash).cast("decimal(28,8)"), F.col("_peak"), F.max("equity").over(so_far)).cast("double")
    drawdown = _dec((peak - F.col("equity").cast("double")) / peak * 100, 6).try_cast("decimal(18,6)")
    pnl = F.when(F.col("fill") == "SELL", _dec((F.col("_entry") * F.col("_f") - 1) * 100, 6).try_cast("decimal(18,6)"))
    exec_price = F.when(F.col("fill") == "BUY", F.col("_m") * (1 + slip)).when(F.col("fill") == "SELL", F.col("_m") * (1 - slip))
    quantity = F.when(F.col("fill") == "BUY", F.lit(cash) * F.col("_p")).when(F.col("fill") == "SELL", F.lit(cash) * F.col("_p") / F.col("_f"))
    return df.select(
        *book, t, "signal", "fill", F.col("_is").alias("held"), "equity", drawdown.alias("drawdown_pct"), pnl.alias("pnl_pct"),
        F.when(F.col("fill").isNotNull(), _dec(exec_price, 8).try_cast("decimal(24,8)")).alias("price"),
        quantity.alias("quantity"), F.when(F.col("fill") == "SELL", F.lit(cash) * F.col("_p")).when(F.col("fill") == "BUY", F.lit(0.0)).alias("cash"),
        (F.col("_m").isNull() | (F.col("_m") <= 0)).alias("bad_price"))


def trades(curve: DataFrame, book: list[str], t: str, step: int = DAY) -> DataFrame:
    """Fills in order, numbered per book."""
    fills = with_context(curve.filter(F.col("fill").isNotNull()), book, t, span_of(step, SPAN_ROWS), number="_i")
    return fills.select(*book, (F.col("_i") + 1).cast("int").alias("seq"), t, F.col("fill").alias("side"), "price", "quantity", "cash", "equity", "pnl_pct")


def summary(curve: DataFrame, book: list[str], t: str, cash: float = DEFAULT_CASH) -> DataFrame:
    """Final figures per book; a book with a price that is not positive fails with a message."""
    agg = curve.groupBy(*book).agg(
        F.max_by("equity", t).alias("final_equity"), F.max("drawdown_pct").alias("mdd_pct"),
        F.count_if(F.col("fill") == "SELL").alias("round_trips"), F.count_if(F.col("pnl_pct") > 0).alias("wins"),
        F.count("fill").alias("trade_count"), F.count("*").alias("bar_count"), F.min(t).alias("first_bar"), F.max(t).alias("last_bar"),
        F.count_if(F.col("bad_price") | F.col("equity").isNull()).alias("bad"))
    final = F.col("final_equity").cast("double")
    days = F.datediff(F.col("last_bar").cast("date"), F.col("first_bar").cast("date"))
    ok = F.col("bad") == 0
    value = lambda c: F.when(ok, c)
    yearly = F.when((days > 0) & (final > 0), (F.pow(final / cash, 365.25 / days) - 1) * 100)
    # a few days of a strong move annualize to figures beyond any decimal; those stay as they are
    growth = F.when(F.abs(yearly) < float("inf"), F.coalesce(_dec(yearly, 6).cast("double"), yearly))
    return agg.select(
        *book, F.when(ok, "SUCCESS").otherwise("FAILED").alias("status"),
        F.when(~ok, "execution price must be positive").alias("error_summary"), value(F.col("final_equity")).alias("final_equity"),
        value(_dec((final - cash) / cash * 100, 6).try_cast("decimal(24,6)")).alias("total_return_pct"), value(growth).alias("cagr_pct"),
        value(F.col("mdd_pct")).alias("mdd_pct"), value(F.col("round_trips")).alias("round_trips"), value(F.col("wins")).alias("wins"),
        value(F.when(F.col("round_trips") > 0, _dec(F.col("wins") / F.col("round_trips") * 100, 4).try_cast("decimal(18,4)"))).alias("win_rate_pct"),
        "trade_count", "bar_count")
