"""WIN1-15, WIN19-21, WIN23-28: indicators, strategies, backtests over the daily bars."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from tickloom.operators import backtest as B, candles as C, indicators as I, signals as G
from tickloom.sources import adapters as A
from .registry import query


def r(col, n=4):
    return F.round(F.col(col), n).alias(col)


def at_scale(expr, scale):
    """Half up at the scale the value is stored with."""
    return f"round(CAST({expr} AS DECIMAL(38,12)), {scale})"


def rs(expr, name, n=4, scale=8):
    """A stored value (8 digits, 6 for percentages), then rounded to ``n`` digits for the comparison."""
    return f"CAST(round({at_scale(expr, scale)}, {n}) AS DOUBLE) AS {name}"


W = "PARTITION BY symbol ORDER BY trade_date"
BASE = f"""WITH {A.SQL_BARS}, b AS (SELECT *, row_number() OVER ({W}) AS rn, lag(close) OVER ({W}) AS pc FROM bars)"""


def _mean(n, x="close"):
    return f"CASE WHEN rn >= {n} THEN CAST(sum({x}) OVER ({W} ROWS {n - 1} PRECEDING) AS DOUBLE) / {n} END"


def indicators(spark, sf):
    return I.daily_indicators(A.bars_daily(spark, sf))


def _register(name, cols, sql, digits=4):
    @query(name, sql)
    def run(spark, sf):
        return indicators(spark, sf).select("symbol", "trade_date", *[r(c, digits) if c != "obv" else F.col(c) for c in cols])


_register("WIN1_sma", ["ma5", "ma20", "ma60"], f"""{BASE} SELECT symbol, trade_date, {rs(_mean(5), 'ma5')}, {rs(_mean(20), 'ma20')}, {rs(_mean(60), 'ma60')} FROM b""")

SD = f"CASE WHEN rn >= 20 THEN stddev_pop(CAST(close AS DOUBLE)) OVER ({W} ROWS 19 PRECEDING) END"


@query("WIN2_stddev", f"{BASE} SELECT symbol, trade_date, {rs(SD, 'sd')} FROM b")
def stddev(spark, sf):
    w = Window.partitionBy("symbol").orderBy("trade_date")
    return A.bars_daily(spark, sf).select("symbol", "trade_date", F.round(I.stddev("close", 20, w), 4).alias("sd"))


_register("WIN3_bollinger", ["bb_upper", "bb_lower"], f"""{BASE}, s AS (SELECT symbol, trade_date, {_mean(20)} AS m, {SD} AS sd FROM b)
SELECT symbol, trade_date, {rs('m + 2 * sd', 'bb_upper', 3)}, {rs('m - 2 * sd', 'bb_lower', 3)} FROM s""", 3)

K = f"""CASE WHEN rn >= 14 THEN CASE WHEN hi = lo THEN 50.0 ELSE CAST(close - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE) * 100 END END"""
STOCH = f"""{BASE}, h AS (SELECT *, min(low) OVER ({W} ROWS 13 PRECEDING) AS lo, max(high) OVER ({W} ROWS 13 PRECEDING) AS hi FROM b),
k AS (SELECT symbol, trade_date, rn, CAST(round(CAST({K} AS DECIMAL(28,10)), 4) AS DOUBLE) AS stoch_k FROM h)"""
_register("WIN4_stochastic_k", ["stoch_k"], STOCH + " SELECT symbol, trade_date, stoch_k FROM k")
_register("WIN5_stochastic_d", ["stoch_d"], STOCH + f""" SELECT symbol, trade_date,
 {rs(f"CASE WHEN rn >= 16 THEN avg(stoch_k) OVER ({W} ROWS 2 PRECEDING) END", 'stoch_d', 3)} FROM k""", 3)
_register("WIN6_atr", ["atr14"], f"""{BASE}, t AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM b)
SELECT symbol, trade_date, {rs(f"CASE WHEN rn >= 15 THEN CAST(sum(tr) OVER ({W} ROWS 13 PRECEDING) AS DOUBLE) / 14 END", 'atr14')} FROM t""")
_register("WIN7_obv", ["obv"], f"""{BASE}, s AS (SELECT *, CASE WHEN close > pc THEN CAST(floor(volume) AS BIGINT)
  WHEN close < pc THEN -CAST(floor(volume) AS BIGINT) ELSE 0 END AS signed FROM b)
SELECT symbol, trade_date, CAST(sum(signed) OVER ({W} ROWS 58 PRECEDING) AS BIGINT) AS obv FROM s""")


# Every 60-row frame unrolled to one row per position; recursions become weighted prefix sums.
def _ema_sql(x, i, n, alpha):
    q = f"(1.0 - {alpha})"
    return f"""pow({q}, {i}) * (avg({x}) FILTER ({i} BETWEEN 1 AND {n}) OVER fr * pow({q}, -{n})
  + coalesce(sum({x} * {alpha} * pow({q}, -{i})) FILTER ({i} > {n}) OVER up, 0))"""


FRAMES = f"""{BASE}, fr0 AS (SELECT symbol, trade_date, list(CAST(close AS DOUBLE)) OVER ({W} ROWS 59 PRECEDING) AS c FROM b),
u AS (SELECT symbol, trade_date, len(c) AS n, unnest(c) AS x, unnest(range(1, len(c) + 1)) AS i FROM fr0),
e AS (SELECT symbol, trade_date, n, i, x, x - lag(x) OVER up AS d,
  CASE WHEN i >= 12 THEN {_ema_sql('x', 'i', 12, '(2.0/13)')} END AS e12, CASE WHEN i >= 26 THEN {_ema_sql('x', 'i', 26, '(2.0/27)')} END AS e26
 FROM u WINDOW fr AS (PARTITION BY symbol, trade_date), up AS (PARTITION BY symbol, trade_date ORDER BY i)),
g AS (SELECT symbol, trade_date, n, i, e12, e26, CAST({at_scale('e12', 8)} - {at_scale('e26', 8)} AS DOUBLE) AS line, i - 25 AS k, i - 1 AS j, greatest(d, 0) AS gain, greatest(-d, 0) AS loss FROM e),
z AS (SELECT symbol, trade_date, n, i, e12, e26, line,
  CASE WHEN i >= 34 THEN {_ema_sql('line', 'k', 9, '0.2')} END AS sig,
  CASE WHEN i >= 15 THEN {_ema_sql('gain', 'j', 14, '(1.0/14)')} END AS ag, CASE WHEN i >= 15 THEN {_ema_sql('loss', 'j', 14, '(1.0/14)')} END AS al
 FROM g WINDOW fr AS (PARTITION BY symbol, trade_date), up AS (PARTITION BY symbol, trade_date ORDER BY i)),
m AS (SELECT * FROM z WHERE i = n)"""


@query("WIN8_ema", FRAMES + f" SELECT symbol, trade_date, {rs('e12', 'ema12')}, {rs('e26', 'ema26')} FROM m")
def ema(spark, sf):
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(-59, 0)
    c = A.bars_daily(spark, sf).select("symbol", "trade_date", F.collect_list(F.col("close").cast("double")).over(w).alias("c"))
    return c.select("symbol", "trade_date", *[F.round(I.ema(F.col("c"), n), 4).alias(f"ema{n}") for n in (12, 26)])


_register("WIN9_macd_line", ["macd_line"], FRAMES + f" SELECT symbol, trade_date, {rs('line', 'macd_line')} FROM m")
_register("WIN10_macd_signal", ["macd_signal"], FRAMES + f" SELECT symbol, trade_date, {rs('sig', 'macd_signal')} FROM m")
_register("WIN11_macd_histogram", ["macd_hist"], FRAMES + f" SELECT symbol, trade_date, {rs(f"line - CAST({at_scale('sig', 8)} AS DOUBLE)", 'macd_hist')} FROM m")
_register("WIN12_rsi14", ["rsi14"], FRAMES + f" SELECT symbol, trade_date, {rs('CASE WHEN al = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / al) END', 'rsi14', 4, 10)} FROM m")

# -- strategies ----------------------------------------------------------------------------------

MA = f"""avg(CAST(close AS DOUBLE)) OVER ({W} ROWS 4 PRECEDING) AS s, avg(CAST(close AS DOUBLE)) OVER ({W} ROWS 19 PRECEDING) AS l"""
CROSS = f"""{BASE}, ma AS (SELECT symbol, trade_date, rn, open, close, {MA} FROM b),
pv AS (SELECT *, lag(s) OVER ({W}) AS ps, lag(l) OVER ({W}) AS pl FROM ma),
sg AS (SELECT symbol, trade_date, rn, open, close, CASE WHEN rn > 20 AND ps <= pl AND s > l THEN 'BUY' WHEN rn > 20 AND ps >= pl AND s < l THEN 'SELL' ELSE 'HOLD' END AS signal FROM pv)"""
RSI = f"""{BASE}, dd AS (SELECT symbol, trade_date, rn - 1 AS i, open, close, greatest(CAST(close - pc AS DOUBLE), 0) AS g, greatest(CAST(pc - close AS DOUBLE), 0) AS l FROM b),
x AS (SELECT *, avg(g) FILTER (i BETWEEN 1 AND 14) OVER (PARTITION BY symbol) AS g0, avg(l) FILTER (i BETWEEN 1 AND 14) OVER (PARTITION BY symbol) AS l0,
  sum(g / 14 * pow(13.0 / 14, -i)) FILTER (i > 14) OVER ({W}) AS cg, sum(l / 14 * pow(13.0 / 14, -i)) FILTER (i > 14) OVER ({W}) AS cl FROM dd),
y AS (SELECT symbol, trade_date, i, open, close, g0 * pow(13.0 / 14, i - 14) + cg * pow(13.0 / 14, i) AS ag, l0 * pow(13.0 / 14, i - 14) + cl * pow(13.0 / 14, i) AS al FROM x),
v AS (SELECT symbol, trade_date, open, close, CASE WHEN i > 14 THEN CASE WHEN al = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / al) END END AS rsi FROM y),
sg AS (SELECT symbol, trade_date, open, close, CASE WHEN rsi <= 30 THEN 'BUY' WHEN rsi >= 70 THEN 'SELL' ELSE 'HOLD' END AS signal FROM v)"""
HOLD = f"{BASE}, sg AS (SELECT symbol, trade_date, open, close, CASE WHEN rn = 1 THEN 'BUY' ELSE 'HOLD' END AS signal FROM b)"

KEYS = ["symbol"]


def signals(spark, sf, strategy, params=None):
    return G.signals_for(strategy, A.bars_daily(spark, sf), KEYS, "trade_date", params)


def _register_strategy(name, strategy, sql):
    @query(name, sql + " SELECT symbol, trade_date, signal FROM sg")
    def run(spark, sf):
        return signals(spark, sf, strategy).select("symbol", "trade_date", "signal")


_register_strategy("WIN13_buy_and_hold", "BUY_AND_HOLD", HOLD)
_register_strategy("WIN14_ma_crossover", "MA_CROSSOVER", CROSS)
_register_strategy("WIN15_rsi_strategy", "RSI", RSI)


@query("WIN15_rsi_values", RSI + f" SELECT symbol, trade_date, {rs('rsi', 'rsi', 4, 10)} FROM v")
def rsi_values(spark, sf):
    v = G.with_rsi(A.bars_daily(spark, sf), KEYS, "trade_date", 14)
    return v.select("symbol", "trade_date", F.round(F.col("rsi").cast("decimal(28,10)"), 4).alias("rsi"))


# -- returns and thresholds ----------------------------------------------------------------------

RETURNS = f"{BASE}, lr AS (SELECT symbol, trade_date, rn, close, ln(CAST(close AS DOUBLE) / CAST(pc AS DOUBLE)) AS ret FROM b)"


@query("WIN19_log_returns", RETURNS + f""" SELECT symbol, trade_date, {rs('ret', 'ret', 6, 10)},
 {rs(f"first_value(CAST(close AS DOUBLE)) OVER ({W}) * exp(coalesce(sum(ret) OVER ({W}), 0))", 'restored', 3, 10)} FROM lr""")
def log_returns(spark, sf):
    """Returns, and the price restored from the first close and the cumulated returns."""
    from tickloom.operators.series import log_return, restored_price
    w = Window.partitionBy("symbol").orderBy("trade_date")
    rets = A.bars_daily(spark, sf).withColumn("ret", log_return("close", w))
    return rets.select("symbol", "trade_date", F.round(F.col("ret").cast("decimal(28,10)"), 6).alias("ret"),
                       F.round(restored_price("close", "ret", w).cast("decimal(28,10)"), 3).alias("restored"))


VOL = RETURNS + f""", vol AS (SELECT symbol, trade_date, rn, close, CASE WHEN count(ret) OVER ({W} ROWS 19 PRECEDING) >= 2
 THEN stddev_samp(ret) OVER ({W} ROWS 19 PRECEDING) * 100 ELSE 0 END AS vol FROM lr)"""


@query("WIN20_volatility", VOL + f" SELECT symbol, trade_date, {rs('vol', 'vol', 5, 10)} FROM vol")
def volatility(spark, sf):
    from tickloom.operators.series import volatility_pct
    w = Window.partitionBy("symbol").orderBy("trade_date")
    v = volatility_pct(A.bars_daily(spark, sf), "close", w, 20)
    return v.select("symbol", "trade_date", F.round(F.col("volatility_pct").cast("decimal(28,10)"), 5).alias("vol"))


@query("WIN21_threshold_signal", VOL + f""", t AS (SELECT symbol, trade_date, (CAST(lead(close) OVER ({W}) AS DOUBLE) / CAST(close AS DOUBLE) - 1) * 100 AS ex,
 2.0 * 15 / 100 + 0.5 * vol AS thr FROM vol)
SELECT symbol, trade_date, {rs('thr', 'threshold_pct', 5, 10)}, CASE WHEN ex > thr THEN 'BUY' WHEN ex < -thr THEN 'SELL' ELSE 'HOLD' END AS signal FROM t""")
def threshold_signal(spark, sf):
    """The next close stands in for a one-step forecast."""
    from tickloom.operators.series import volatility_pct
    w = Window.partitionBy("symbol").orderBy("trade_date")
    v = volatility_pct(A.bars_daily(spark, sf), "close", w, 20)
    close = F.col("close").cast("double")
    v = v.withColumns({"ex": (F.lead(close).over(w) / close - 1) * 100, "thr": G.threshold_pct(F.col("volatility_pct"), F.lit(1.0))})
    return v.select("symbol", "trade_date", F.round(F.col("thr").cast("decimal(28,10)"), 5).alias("threshold_pct"),
                    G.classify(F.col("ex"), F.col("thr")).alias("signal"))


# -- backtests -----------------------------------------------------------------------------------

@query("WIN23_execution_delay", CROSS + f" SELECT symbol, trade_date, coalesce(lag(signal) OVER ({W}), 'BUY') AS signal FROM sg")
def execution_delay(spark, sf):
    return G.delayed(signals(spark, sf, "MA_CROSSOVER"), KEYS, "trade_date", F.lit("BUY")).select("symbol", "trade_date", "signal")


def _engine(source, price="close", fee=0.0, slip=0.0):
    return f"""{source}, st AS (SELECT *, CAST({price} AS DOUBLE) AS m, CAST(close AS DOUBLE) AS c,
  coalesce(last_value(CASE WHEN signal <> 'HOLD' THEN signal END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'BUY', false) AS was,
  coalesce(last_value(CASE WHEN signal <> 'HOLD' THEN signal END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) = 'BUY', false) AS held FROM sg),
fl AS (SELECT *, CASE WHEN held AND NOT was THEN 'BUY' WHEN was AND NOT held THEN 'SELL' END AS fill,
  CASE WHEN held AND NOT was THEN 1.0 / (m * {1 + slip} * {1 + fee}) WHEN was AND NOT held THEN m * {1 - slip} * {1 - fee} ELSE 1.0 END AS f FROM st),
eq AS (SELECT *, CAST({at_scale(f'10000.0 * exp(sum(ln(f)) OVER ({W} ROWS UNBOUNDED PRECEDING)) * CASE WHEN held THEN c ELSE 1 END', 8)} AS DOUBLE) AS equity,
  last_value(CASE WHEN fill = 'BUY' THEN f END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ef FROM fl),
cv AS (SELECT *, CASE WHEN fill = 'SELL' THEN (ef * f - 1) * 100 END AS pnl,
  greatest(10000.0, max(equity) OVER ({W} ROWS UNBOUNDED PRECEDING)) AS peak FROM eq)"""


SUMMARY = f""" SELECT symbol, 'SUCCESS' AS status, {rs('arg_max(equity, trade_date)', 'final_equity', 3)},
 {rs('(arg_max(equity, trade_date) - 10000) / 100', 'total_return_pct', 4, 6)},
 {rs("CASE WHEN arg_max(equity, trade_date) > 0 THEN (pow(arg_max(equity, trade_date) / 10000, 365.25 / date_diff('day', min(trade_date), max(trade_date))) - 1) * 100 END", 'cagr_pct', 4, 6)},
 {rs('max((peak - equity) / peak * 100)', 'mdd_pct', 4, 6)}, count(*) FILTER (fill = 'SELL') AS round_trips,
 count(*) FILTER (pnl > 0) AS wins, {rs("CASE WHEN count(*) FILTER (fill = 'SELL') > 0 THEN 100.0 * count(*) FILTER (pnl > 0) / count(*) FILTER (fill = 'SELL') END", 'win_rate_pct', 3, 4)},
 count(fill) AS trade_count, count(*) AS bar_count FROM cv GROUP BY symbol"""


def _curve(spark, sf, strategy, **mode):
    return B.equity_curve(signals(spark, sf, strategy), KEYS, "trade_date", **mode)


def _summary(curve):
    return B.summary(curve, KEYS, "trade_date").select(
        "symbol", "status", r("final_equity", 3), r("total_return_pct"), r("cagr_pct"), r("mdd_pct"), "round_trips", "wins",
        r("win_rate_pct", 3), "trade_count", "bar_count")


@query("WIN24_positions", _engine(CROSS) + " SELECT symbol, trade_date, held, fill FROM cv")
def positions(spark, sf):
    return _curve(spark, sf, "MA_CROSSOVER").select("symbol", "trade_date", "held", "fill")


@query("WIN25_equity_path", _engine(CROSS, "open", 0.001, 0.0005) + f" SELECT symbol, trade_date, {rs('equity', 'equity', 3)} FROM cv")
def equity_path(spark, sf):
    c = _curve(spark, sf, "MA_CROSSOVER", at_open=True, fee_bps=10, slippage_bps=5)
    return c.select("symbol", "trade_date", r("equity", 3))


@query("WIN26_drawdown", _engine(RSI) + f" SELECT symbol, trade_date, {rs('(peak - equity) / peak * 100', 'drawdown_pct', 4, 6)} FROM cv")
def drawdown(spark, sf):
    return _curve(spark, sf, "RSI").select("symbol", "trade_date", r("drawdown_pct"))


@query("WIN27_trades", _engine(CROSS, "open", 0.001, 0.0005) + f""" SELECT symbol, row_number() OVER ({W}) AS seq, trade_date, fill AS side,
 {rs("CASE fill WHEN 'BUY' THEN m * 1.0005 ELSE m * 0.9995 END", 'price', 4)}, {rs('pnl', 'pnl_pct', 4, 6)} FROM cv WHERE fill IS NOT NULL""")
def trade_list(spark, sf):
    c = _curve(spark, sf, "MA_CROSSOVER", at_open=True, fee_bps=10, slippage_bps=5)
    return B.trades(c, KEYS, "trade_date").select("symbol", "seq", "trade_date", "side", r("price"), r("pnl_pct"))


@query("WIN28_run_summary", _engine(CROSS, "open", 0.001, 0.0005) + SUMMARY)
def run_summary(spark, sf):
    return _summary(_curve(spark, sf, "MA_CROSSOVER", at_open=True, fee_bps=10, slippage_bps=5))


def _register_run(name, strategy, source):
    @query(name, _engine(source) + SUMMARY)
    def run(spark, sf):
        return _summary(_curve(spark, sf, strategy))


_register_run("RPT4_buy_and_hold_run", "BUY_AND_HOLD", HOLD)
_register_run("RPT4_ma_crossover_run", "MA_CROSSOVER", CROSS)
_register_run("RPT4_rsi_run", "RSI", RSI)


# -- minute books: the same by spans of bars --------------------------------------------------------

MINUTE_BARS = f"""{A.SQL_DENSE}, {A.SQL_MINUTES}, bars AS (SELECT symbol || ' ' || source AS symbol, bucket AS trade_date, open, high, low, close, volume FROM minutes)"""


def of_minutes(sql):
    return sql.replace(A.SQL_BARS, MINUTE_BARS)


def minute_signals(spark, sf, strategy):
    m = C.minute_ohlcv(A.ticks(spark, sf, dense=True))
    bars = m.select(F.concat_ws(" ", "symbol", "source").alias("symbol"), F.col("bucket").alias("trade_date"), "open", "close")
    return G.signals_for(strategy, bars, KEYS, "trade_date", step=60)


@query("WIN14_minute_crossover", of_minutes(CROSS) + " SELECT symbol, trade_date, signal FROM sg")
def minute_crossover(spark, sf):
    return minute_signals(spark, sf, "MA_CROSSOVER").select("symbol", "trade_date", "signal")


@query("WIN15_minute_rsi", of_minutes(RSI) + " SELECT symbol, trade_date, signal FROM sg")
def minute_rsi(spark, sf):
    return minute_signals(spark, sf, "RSI").select("symbol", "trade_date", "signal")


@query("WIN26_minute_drawdown", of_minutes(_engine(RSI, "open", 0.001, 0.0005)) + f" SELECT symbol, trade_date, held, fill, {rs('equity', 'equity', 3)}, {rs('(peak - equity) / peak * 100', 'drawdown_pct', 4, 6)} FROM cv")
def minute_drawdown(spark, sf):
    c = B.equity_curve(minute_signals(spark, sf, "RSI"), KEYS, "trade_date", at_open=True, fee_bps=10, slippage_bps=5, step=60)
    return c.select("symbol", "trade_date", "held", "fill", r("equity", 3), r("drawdown_pct"))
