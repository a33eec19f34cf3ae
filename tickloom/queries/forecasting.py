"""FCT, JON5-7, AGG17-19, RPT1-3, UDF1: forecasts, their errors, report grids.

ARIMA fits have no SQL twin; ``tests`` compare them with a direct likelihood. The closed-form
ARIMA(1,1,0) runs through the same walk-forward rules and is checked by SQL.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import candles as C, forecast as FC, metrics as M, series as R
from tickloom.plans import reports as P
from tickloom.sources import adapters as A
from .registry import query
from .shapes import D, TS
from .technical import W, rs

START, END = "1995-04-01", "2001-11-04"
DAY_S = 86400

AR = f"""WITH {A.SQL_BARS}, b AS (SELECT symbol, trade_date, open, close AS px, CAST(close AS DOUBLE) AS c, row_number() OVER ({W}) - 1 AS idx FROM bars
  WHERE trade_date <= DATE '{END}'),
d AS (SELECT *, c - lag(c) OVER ({W}) AS d, ln(c / lag(c) OVER ({W})) AS r FROM b), e AS (SELECT *, lag(d) OVER ({W}) AS pd FROM d),
st AS (SELECT *, min(idx) FILTER (trade_date >= DATE '{START}') OVER (PARTITION BY symbol) AS first_idx,
  sum(d * pd) OVER ({W} ROWS BETWEEN 198 PRECEDING AND 1 PRECEDING) / sum(CASE WHEN d IS NOT NULL THEN pd * pd END) OVER ({W} ROWS BETWEEN 198 PRECEDING AND 1 PRECEDING) AS phi,
  stddev_samp(r) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) * 100 AS vol, lag(c) OVER ({W}) AS last, lag(d) OVER ({W}) AS ld,
  lag(trade_date) OVER ({W}) AS sd, count(c) OVER ({W} ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) AS hist FROM e),
t AS (SELECT *, idx - first_idx AS pos, (idx - first_idx) // 5 AS blk, (idx - first_idx) % 5 + 1 AS step FROM st WHERE idx >= first_idx),
h AS (SELECT symbol, blk, phi, vol, last, ld, sd, hist FROM t WHERE step = 1),
g AS (SELECT t.symbol, t.blk, t.trade_date, t.step, t.c AS actual, t.open, h.sd AS signal_time, h.last AS ref, h.vol, h.hist,
  h.last + h.ld * list_sum(list_transform(range(1, t.step + 1), lambda j: pow(h.phi, j))) AS pred FROM t JOIN h USING (symbol, blk)),
gx AS (SELECT *, CASE WHEN hist < 50 THEN 'at least 50 observations are required' WHEN NOT coalesce(pred > 0, false) THEN 'forecast returned invalid prediction values' END AS error FROM g),
fc AS (SELECT * REPLACE (CASE WHEN error IS NULL THEN pred END AS pred), CASE WHEN error IS NULL THEN (pred / ref - 1) * 100 END AS ex FROM gx)"""


def _decide(mult):
    thr = f"(2.0 * 15 / 100 + {mult} * vol * sqrt(step))"
    return f"CASE WHEN ex IS NULL THEN NULL WHEN ex > {thr} THEN 'BUY' WHEN ex < -{thr} THEN 'SELL' ELSE 'HOLD' END"


def ar_forecasts(spark, sf):
    return FC.ar_walk_forward(A.bars_daily(spark, sf), ["symbol"], "trade_date", "close", D(START), D(END))


def dec(c, n):
    return F.round(F.col(c).cast("decimal(28,10)"), n).alias(c)


@query("FCT1_walk_forward_closed_form", AR + f""" SELECT symbol, signal_time, trade_date AS execution_time, step, {rs('ref', 'reference_price', 4, 10)},
 {rs('pred', 'predicted_price', 3, 10)}, {rs('ex', 'expected_return_pct', 4, 10)}, {rs('2.0 * 15 / 100 + 0.5 * vol * sqrt(step)', 'threshold_pct', 4, 10)},
 {_decide(0.5)} AS signal, error FROM fc""")
def walk_forward_closed_form(spark, sf):
    d = FC.decide(ar_forecasts(spark, sf))
    return d.select("symbol", "signal_time", "execution_time", "step", dec("reference_price", 4), dec("predicted_price", 3),
                    dec("expected_return_pct", 4), dec("threshold_pct", 4), "signal", "error")


def arima_forecasts(spark, sf, models):
    return FC.walk_forward(A.bars_daily(spark, sf), ["symbol"], "trade_date", "close", models, D(START), D(END))


@query("FCT1_arima_rows", AR + f""", m AS (SELECT unnest(['ARIMA', 'LOG_RETURN_ARIMA']) AS model)
SELECT symbol, m.model, signal_time, trade_date AS execution_time, step, {rs('ref', 'reference_price', 4, 10)}, {rs('vol', 'volatility_pct', 4, 10)} FROM gx, m""")
def arima_rows(spark, sf):
    """The rows of the ARIMA runs without the fitted prices."""
    f = arima_forecasts(spark, sf, [FC.PRICE_ARIMA, FC.LOG_RETURN_ARIMA])
    return f.select("symbol", "model", "signal_time", "execution_time", "step", dec("reference_price", 4), dec("volatility_pct", 4))


@query("FCT1_walk_forward_arima")
def walk_forward_arima(spark, sf):
    """Daily walk-forward of both ARIMA models over every symbol."""
    return FC.decide(arima_forecasts(spark, sf, [FC.PRICE_ARIMA, FC.LOG_RETURN_ARIMA]))


def gap_free_minutes(spark, sf):
    """Minute closes on a regular grid; gaps interpolated, as before a model fit."""
    m = C.minute_ohlcv(A.ticks(spark, sf, dense=True)).select("symbol", "source", "bucket", "close")
    grid = R.regular_grid(m, ["symbol", "source"], "bucket", "close", 60)
    return R.interpolate(grid, ["symbol", "source"], "bucket", "close", 60)


MW = "PARTITION BY symbol, source ORDER BY ts"
#: The runs take all minutes from FROM_MINUTE on (LAST_MINUTE lies behind the data); a query of its own ends inside the data.
FROM_MINUTE, LAST_MINUTE, INSIDE = "2024-01-01 01:30:00", "2030-01-01 00:00:00", "2024-01-01 05:10:00"


def minute_ar(end):
    return f"""WITH {A.SQL_DENSE}, {A.SQL_MINUTES}, lim AS (SELECT symbol, source, min(bucket) AS lo, max(bucket) AS hi FROM minutes GROUP BY 1, 2),
slots AS (SELECT symbol, source, unnest(generate_series(lo, hi, INTERVAL 1 MINUTE)) AS ts FROM lim),
gr AS (SELECT s.symbol, s.source, s.ts, CAST(close AS DOUBLE) AS close FROM slots s LEFT JOIN minutes m ON s.symbol = m.symbol AND s.source = m.source AND s.ts = m.bucket),
nb AS (SELECT *, last_value(close IGNORE NULLS) OVER p AS pv, max(CASE WHEN close IS NOT NULL THEN ts END) OVER p AS pt,
  first_value(close IGNORE NULLS) OVER n AS nv, min(CASE WHEN close IS NOT NULL THEN ts END) OVER n AS nt FROM gr
  WINDOW p AS ({MW} ROWS UNBOUNDED PRECEDING), n AS ({MW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
b AS (SELECT symbol, source, ts, CASE WHEN close IS NOT NULL THEN close ELSE pv + (nv - pv) * (epoch(ts) - epoch(pt)) / (epoch(nt) - epoch(pt)) END AS c FROM nb
  WHERE ts < TIMESTAMP '{end}'),
d AS (SELECT *, c - lag(c) OVER ({MW}) AS d, ln(c / lag(c) OVER ({MW})) AS r FROM b), e AS (SELECT *, lag(d) OVER ({MW}) AS pd FROM d),
st AS (SELECT *, CAST((epoch(ts) - epoch(TIMESTAMP '2024-01-01 01:30:00')) / 60 AS BIGINT) AS pos,
  sum(d * pd) OVER ({MW} ROWS BETWEEN 198 PRECEDING AND 1 PRECEDING) AS num, sum(CASE WHEN d IS NOT NULL THEN pd * pd END) OVER ({MW} ROWS BETWEEN 198 PRECEDING AND 1 PRECEDING) AS den,
  stddev_samp(r) OVER ({MW} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) * 100 AS vol, lag(c) OVER ({MW}) AS last, lag(d) OVER ({MW}) AS ld,
  count(c) OVER ({MW} ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) AS hist FROM e),
t AS (SELECT *, pos // 5 AS blk, pos % 5 + 1 AS step FROM st WHERE pos >= 0),
h AS (SELECT symbol, source, blk, CASE WHEN den > 0 THEN num / den ELSE 0 END AS phi, vol, last, ld, hist FROM t WHERE step = 1),
g AS (SELECT t.symbol, t.source, t.ts, t.step, h.last AS ref, h.vol, h.hist,
  h.last + h.ld * list_sum(list_transform(range(1, t.step + 1), lambda j: pow(h.phi, j))) AS pred FROM t JOIN h USING (symbol, source, blk)),
gx AS (SELECT *, CASE WHEN hist < 50 THEN 'at least 50 observations are required' WHEN NOT coalesce(pred > 0, false) THEN 'forecast returned invalid prediction values' END AS error FROM g),
fc AS (SELECT * REPLACE (CASE WHEN error IS NULL THEN pred END AS pred), CASE WHEN error IS NULL THEN (pred / ref - 1) * 100 END AS ex FROM gx)"""


MINUTE_ROWS = f""" SELECT symbol, source, ts AS execution_time, step, {rs('ref', 'reference_price', 4, 10)},
 {rs('pred', 'predicted_price', 3, 10)}, {_decide(0.5)} AS signal, error FROM fc"""


def intraday_rows(spark, sf, end):
    f = FC.ar_walk_forward(gap_free_minutes(spark, sf), ["symbol", "source"], "bucket", "close", TS(FROM_MINUTE), TS(end), step=60)
    d = FC.decide(f)
    return d.select("symbol", "source", "execution_time", "step", dec("reference_price", 4), dec("predicted_price", 3), "signal", "error")


@query("FCT2_intraday_closed_form", minute_ar(LAST_MINUTE) + MINUTE_ROWS)
def intraday_closed_form(spark, sf):
    return intraday_rows(spark, sf, LAST_MINUTE)


@query("FCT2_intraday_half_open", minute_ar(INSIDE) + MINUTE_ROWS)
def intraday_half_open(spark, sf):
    """The range is half-open and ends inside the data."""
    return intraday_rows(spark, sf, INSIDE)


@query("FCT2_refused_series", f"""WITH {A.SQL_DENSE}, {A.SQL_MINUTES}, l AS (SELECT symbol, source, close, bucket - lag(bucket) OVER (PARTITION BY symbol, source ORDER BY bucket) AS gap FROM minutes)
SELECT symbol, source, 'ARIMA_110' AS model, 'missing rows' AS error FROM l GROUP BY 1, 2 HAVING count(*) FILTER (gap <> INTERVAL '1 minute') > 0""")
def refused_series(spark, sf):
    """Minutes with gaps are not forecast; each such series has one row that says why."""
    m = C.minute_ohlcv(A.ticks(spark, sf, dense=True))
    f = FC.ar_walk_forward(m, ["symbol", "source"], "bucket", "close", TS("2024-01-01 01:30:00"), TS("2024-01-01 05:10:00"), step=60)
    return f.filter("execution_time is null").select("symbol", "source", "model", "error")


@query("FCT2_intraday_arima")
def intraday_arima(spark, sf):
    """Minute walk-forward; the position follows from the clock, so a long symbol splits into chunks."""
    f = FC.walk_forward(gap_free_minutes(spark, sf), ["symbol", "source"], "bucket", "close", [FC.PRICE_ARIMA, FC.LOG_RETURN_ARIMA],
                        TS(FROM_MINUTE), TS(LAST_MINUTE), step=60)
    return FC.decide(f)


@query("FCT2_arima_rows", minute_ar(LAST_MINUTE) + f""", m AS (SELECT unnest(['ARIMA', 'LOG_RETURN_ARIMA']) AS model)
SELECT symbol, source, m.model, ts AS execution_time, step, {rs('ref', 'reference_price', 4, 10)}, {rs('vol', 'volatility_pct', 4, 10)}, hist < 50 AS refused FROM fc, m""")
def intraday_arima_rows(spark, sf):
    """The rows of the ARIMA runs without the fitted prices."""
    f = intraday_arima(spark, sf)
    return f.select("symbol", "source", "model", "execution_time", "step", dec("reference_price", 4), dec("volatility_pct", 4), F.col("error").isNotNull().alias("refused"))


KEY, DAILY = ["symbol"], ("trade_date", "close")
RANDOM_WALK, DRIFT = {FC.PRICE_ARIMA: (0, 1, 0)}, {FC.LOG_RETURN_ARIMA: (0, 0, 0)}
# Orders whose forecast is a closed form: (0, 1, 0) on prices repeats the last one, (0, 0, 0) on log returns adds their mean.
ENDS = f"""WITH {A.SQL_BARS}, c AS (SELECT symbol, trade_date, CAST(close AS DOUBLE) AS v, CAST(close AS DOUBLE) - lag(CAST(close AS DOUBLE)) OVER ({W}) AS d,
  ln(CAST(close AS DOUBLE) / lag(CAST(close AS DOUBLE)) OVER ({W})) AS r FROM bars),
e AS (SELECT symbol, arg_max(v, trade_date) AS last, max(trade_date) AS last_ts, sqrt(avg(d * d)) AS sd, avg(r) AS mu, stddev_pop(r) AS sr FROM c GROUP BY 1),
h AS (SELECT e.*, x.h FROM e, (SELECT unnest(range(1, 11)) AS h) x)"""
POINTS = ["symbol", "model", "step", "ts", "last_ts", "error"]


def points(df, digits=3):
    return df.select(*POINTS, *[dec(c, digits) for c in ("yhat", "yhat_lower", "yhat_upper", "last_value")])


def _point_sql(model, mean, half):
    low, high = (f"last - {half}", f"last + {half}") if model == "ARIMA" else (f"last * exp({mean} - {half})", f"last * exp({mean} + {half})")
    yhat = "last" if model == "ARIMA" else f"last * exp({mean})"
    return f"""SELECT symbol, '{model}' AS model, CAST(h AS BIGINT) AS step, last_ts + CAST(h AS INTEGER) * INTERVAL 1 DAY AS ts, last_ts, CAST(NULL AS VARCHAR) AS error,
 {rs(yhat, 'yhat', 3, 10)}, {rs(low, 'yhat_lower', 3, 10)}, {rs(high, 'yhat_upper', 3, 10)}, {rs('last', 'last_value', 3, 10)} FROM h"""


WALK_SQL, DRIFT_SQL = _point_sql("ARIMA", "0", "1.959963984540054 * sd * sqrt(h)"), _point_sql("LOG_RETURN_ARIMA", "h * mu", "1.959963984540054 * h * sr")


def ends(spark, sf, models, orders=None):
    return FC.forecast_ends(A.bars_daily(spark, sf), KEY, *DAILY, models, 10, DAY_S, orders)


@query("FCT3_price_arima")
def price_arima(spark, sf):
    return ends(spark, sf, [FC.PRICE_ARIMA])


@query("FCT3_random_walk", f"{ENDS} {WALK_SQL}")
def random_walk(spark, sf):
    return points(ends(spark, sf, [FC.PRICE_ARIMA], RANDOM_WALK))


@query("FCT4_order_choice")
def order_choice(spark, sf):
    return FC.best_order(FC.order_scores(A.bars_daily(spark, sf), KEY, *DAILY), KEY)


@query("FCT4_closed_form_scores", f"""WITH {A.SQL_BARS}, c AS (SELECT symbol, CAST(close AS DOUBLE) AS v, CAST(close AS DOUBLE) - lag(CAST(close AS DOUBLE)) OVER ({W}) AS d FROM bars),
a AS (SELECT symbol, count(v) * (ln(2 * pi() * var_pop(v)) + 1) + 4 AS level, count(d) * (ln(2 * pi() * avg(d * d)) + 1) + 2 AS diff FROM c GROUP BY 1)
SELECT symbol, 0::BIGINT AS d, {rs('level', 'aic', 3, 10)} FROM a UNION ALL SELECT symbol, 1::BIGINT, {rs('diff', 'aic', 3, 10)} FROM a""")
def closed_form_scores(spark, sf):
    """AIC of a constant level and of a random walk, as the order search scores them."""
    scores = FC.order_scores(A.bars_daily(spark, sf), KEY, *DAILY).filter("p = 0 and q = 0")
    return scores.select("symbol", F.col("d").cast("long").alias("d"), dec("aic", 3))


@query("FCT5_log_return_arima")
def log_return_arima(spark, sf):
    return ends(spark, sf, [FC.LOG_RETURN_ARIMA])


@query("FCT5_drift", f"{ENDS} {DRIFT_SQL}")
def drift(spark, sf):
    return points(ends(spark, sf, [FC.LOG_RETURN_ARIMA], DRIFT))


def holdout_errors(h):
    return h.groupBy("symbol").agg(F.max("test_size").alias("test_size"), *M.error_measures(), F.max("error").alias("error"))


def _register_holdout(name, model):
    @query(name)
    def run(spark, sf):
        """Hold-out errors per symbol."""
        return holdout_errors(FC.holdout(A.bars_daily(spark, sf), KEY, *DAILY, model))


_register_holdout("FCT6_holdout_price", FC.PRICE_ARIMA)
_register_holdout("FCT6_holdout_log_return", FC.LOG_RETURN_ARIMA)


def _register_closed_holdout(name, model, order, share, yhat):
    measures = [("mae", "avg(abs(v - y))"), ("rmse", "sqrt(avg(pow(v - y, 2)))"), ("mae_pct", "avg(abs((y - v) / v * 100))"), ("rmse_pct", "sqrt(avg(pow((y - v) / v * 100, 2)))")]
    sql = f"""WITH {A.SQL_BARS}, c AS (SELECT symbol, trade_date, CAST(close AS DOUBLE) AS v, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back FROM bars),
s AS (SELECT *, {share} AS size FROM c), r AS (SELECT *, ln(v / lag(v) OVER ({W})) AS r FROM s), tr AS (SELECT symbol, arg_max(v, trade_date) AS last, avg(r) AS mu FROM r WHERE back > size GROUP BY 1),
f AS (SELECT r.symbol, v, size, {yhat} AS y FROM r JOIN tr USING (symbol) WHERE back <= size)
SELECT symbol, CAST(max(size) AS BIGINT) AS test_size, {', '.join(rs(e, n, 3, 10) for n, e in measures)}, CAST(NULL AS VARCHAR) AS error FROM f GROUP BY symbol"""

    @query(name, sql)
    def run(spark, sf):
        e = holdout_errors(FC.holdout(A.bars_daily(spark, sf), KEY, *DAILY, model, order))
        return e.select("symbol", "test_size", *[dec(c, 3) for c in ("mae", "rmse", "mae_pct", "rmse_pct")], "error")


_register_closed_holdout("FCT6_holdout_random_walk", FC.PRICE_ARIMA, (0, 1, 0), "greatest(10, CAST(floor(n * 0.1) AS BIGINT))", "last")
_register_closed_holdout("FCT6_holdout_drift", FC.LOG_RETURN_ARIMA, (0, 0, 0), "least(30, greatest(10, CAST(floor(n * 0.1) AS BIGINT)))", "last * exp(mu * (size - back + 1))")


@query("FCT6_holdout_split", f"""WITH {A.SQL_BARS}, s AS (SELECT symbol, trade_date, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
SELECT symbol, trade_date, greatest(10, CAST(floor(n * 0.1) AS BIGINT)) AS test_size, back <= greatest(10, floor(n * 0.1)) AS is_test FROM s""")
def holdout_split(spark, sf):
    return FC.split_holdout(A.bars_daily(spark, sf), KEY, "trade_date").select("symbol", "trade_date", "test_size", "is_test")


@query("FCT7_model_comparison")
def model_comparison(spark, sf):
    """Both models on the same series, nested per run; a model that cannot be fitted has its error."""
    p = ends(spark, sf, [FC.PRICE_ARIMA, FC.LOG_RETURN_ARIMA])
    models = p.groupBy("symbol", "last_ts", "last_value", "model").agg(F.max("error").alias("error"),
        F.sort_array(F.collect_list(F.when(F.col("error").isNull(), F.struct("ts", "yhat", "yhat_lower", "yhat_upper")))).alias("forecast"))
    nested = models.groupBy("symbol", "last_ts", "last_value").agg(F.sort_array(F.collect_list(F.struct("model", "error", "forecast"))).alias("models"))
    return nested.withColumn("models", F.to_json("models"))


@query("FCT7_closed_forms", f"{ENDS} {WALK_SQL} UNION ALL {DRIFT_SQL}")
def closed_forms(spark, sf):
    """The comparison of two models whose forecasts are closed forms, one row per point."""
    return points(ends(spark, sf, [FC.PRICE_ARIMA, FC.LOG_RETURN_ARIMA], {**RANDOM_WALK, **DRIFT}))


@query("UDF1_custom_forecaster", AR.replace("h.last + h.ld * list_sum(list_transform(range(1, t.step + 1), lambda j: pow(h.phi, j)))", "h.last * (1 + 0.01 * t.step)") +
       f" SELECT symbol, trade_date AS execution_time, step, {rs('pred', 'predicted_price', 4, 10)}, CAST(NULL AS VARCHAR) AS error FROM g WHERE hist >= 50")
def custom_forecaster(spark, sf):
    """A forecaster of the user's own, plugged into the walk-forward run: one percent up per step."""
    import numpy as np
    up = {"UP": lambda history, steps: (history[:, -1:] * (1 + 0.01 * np.arange(1, steps + 1)), None, None)}
    f = FC.walk_forward(A.bars_daily(spark, sf), ["symbol"], "trade_date", "close", ["UP"], D(START), D(END), forecasters=up)
    return f.select("symbol", "execution_time", "step", dec("predicted_price", 4), "error")


# -- joins over forecasts ------------------------------------------------------------------------

@query("JON5_aligned_signals", AR + f""", s AS (SELECT symbol, trade_date, {_decide(0.5)} AS signal, error FROM fc),
x AS (SELECT * FROM s WHERE day(trade_date) <> 10 UNION ALL SELECT symbol, trade_date, signal, error FROM s WHERE day(trade_date) = 20),
n AS (SELECT symbol, trade_date, count(*) AS n, min(signal) AS signal, min(error) AS e FROM x GROUP BY 1, 2)
SELECT b.symbol, b.trade_date, n.signal, CASE WHEN n.n IS NULL THEN 'missing prediction signal' WHEN n.n > 1 THEN 'duplicate prediction signal' ELSE n.e END AS error
FROM bars b LEFT JOIN n USING (symbol, trade_date) WHERE b.trade_date >= DATE '{START}'""")
def aligned_signals(spark, sf):
    """Signals of the 10th are missing and those of the 20th come twice."""
    d = FC.decide(ar_forecasts(spark, sf))
    day = F.dayofmonth("execution_time")
    faulty = d.filter(day != 10).unionByName(d.filter(day == 20))
    bars = P.in_range(A.bars_daily(spark, sf), "trade_date", D(START), D(END)).select("symbol", "trade_date")
    return FC.align(bars, faulty, ["symbol"], "trade_date").select("symbol", "trade_date", "signal", "error")


def with_actual(spark, sf):
    actual = A.bars_daily(spark, sf).select("symbol", F.col("trade_date").alias("execution_time"), F.col("close").cast("double").alias("actual_price"))
    return FC.decide(ar_forecasts(spark, sf)).join(actual, ["symbol", "execution_time"])


@query("JON6_predicted_vs_actual", AR + f" SELECT symbol, trade_date AS execution_time, {rs('pred', 'predicted_price', 3, 10)}, {rs('actual', 'actual_price', 3, 10)}, error FROM fc")
def predicted_vs_actual(spark, sf):
    return with_actual(spark, sf).select("symbol", "execution_time", dec("predicted_price", 3), dec("actual_price", 3), "error")


@query("JON7_block_history", AR + """ SELECT symbol, blk AS block, hist AS history, signal_time AS last_bar, round(CAST(ref AS DECIMAL(28,10)), 4)::DOUBLE AS reference_price FROM g WHERE step = 1""")
def block_history(spark, sf):
    """Each walk-forward block with the size and end of its trailing history."""
    import numpy as np
    sized = {"LEN": lambda history, steps: (np.full((len(history), steps), float(history.shape[1])), None, None)}
    f = FC.walk_forward(A.bars_daily(spark, sf), ["symbol"], "trade_date", "close", ["LEN"], D(START), D(END), forecasters=sized)
    heads = f.filter(F.col("step") == 1)
    from pyspark.sql import Window
    block = F.row_number().over(Window.partitionBy("symbol").orderBy("execution_time")) - 1
    return heads.select("symbol", block.cast("long").alias("block"), F.col("predicted_price").cast("long").alias("history"),
                        F.col("signal_time").alias("last_bar"), dec("reference_price", 4))


@query("AGG17_signal_counts", AR + f""", s AS (SELECT symbol, {_decide(0.5)} AS signal FROM fc)
SELECT symbol, count(*) FILTER (signal = 'BUY') AS buy_count, count(*) FILTER (signal = 'HOLD') AS hold_count, count(*) FILTER (signal = 'SELL') AS sell_count, count(*) FILTER (signal IS NULL) AS failed_count FROM s GROUP BY 1""")
def signal_counts(spark, sf):
    return M.signal_counts(FC.decide(ar_forecasts(spark, sf)), "symbol")


ERRORS = """avg(abs(pred - actual)) AS mae, sqrt(avg(pow(pred - actual, 2))) AS rmse,
 avg(abs((pred - actual) / actual * 100)) AS mae_pct, sqrt(avg(pow((pred - actual) / actual * 100, 2))) AS rmse_pct"""


@query("AGG18_forecast_errors", AR + f""", m AS (SELECT symbol, {ERRORS}, count(error) AS failed_count FROM fc GROUP BY symbol)
SELECT symbol, {rs('mae', 'mae', 4, 10)}, {rs('rmse', 'rmse', 4, 10)}, {rs('mae_pct', 'mae_pct', 4, 10)}, {rs('rmse_pct', 'rmse_pct', 4, 10)}, failed_count FROM m""")
def forecast_errors(spark, sf):
    m = with_actual(spark, sf).groupBy("symbol").agg(*M.error_measures(), F.count("error").alias("failed_count"))
    return m.select("symbol", *[dec(c, 4) for c in ("mae", "rmse", "mae_pct", "rmse_pct")], "failed_count")


# -- reports -------------------------------------------------------------------------------------

def _book_sql(book, source, price, fee, slip):
    """Backtest of the signal rows ``source`` (book, d, open, c, signal)."""
    part = f"PARTITION BY {book} ORDER BY d"
    was = f"coalesce(last_value(CASE WHEN signal <> 'HOLD' THEN signal END IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'BUY', false)"
    held = f"coalesce(last_value(CASE WHEN signal <> 'HOLD' THEN signal END IGNORE NULLS) OVER ({part} ROWS UNBOUNDED PRECEDING) = 'BUY', false)"
    return f"""(SELECT {book}, (arg_max(equity, d) - 10000) / 100 AS total_return_pct, max((peak - equity) / peak * 100) AS mdd_pct, count(fill) AS trade_count FROM
 (SELECT *, greatest(10000.0, max(equity) OVER ({part} ROWS UNBOUNDED PRECEDING)) AS peak FROM
  (SELECT *, round(CAST(10000.0 * exp(sum(ln(f)) OVER ({part} ROWS UNBOUNDED PRECEDING)) * CASE WHEN held THEN c ELSE 1 END AS DECIMAL(38,12)), 8)::DOUBLE AS equity FROM
   (SELECT *, CASE WHEN held AND NOT was THEN 'BUY' WHEN was AND NOT held THEN 'SELL' END AS fill,
     CASE WHEN held AND NOT was THEN 1.0 / ({price} * {1 + slip} * {1 + fee}) WHEN was AND NOT held THEN {price} * {1 - slip} * {1 - fee} ELSE 1.0 END AS f FROM
    (SELECT *, {was} AS was, {held} AS held FROM {source}) s1) s2) s3) s4 GROUP BY {book})"""


HOLD_ROWS = f"(SELECT symbol, trade_date AS d, CAST(open AS DOUBLE) AS open, c, CASE WHEN step = 1 AND blk = 0 THEN 'BUY' ELSE 'HOLD' END AS signal FROM g0)"
# A book with any invalid forecast fails; the range below keeps all forecasts valid for most symbols.
REPORT = AR + f""", g0 AS (SELECT * FROM g), okay AS (SELECT symbol, bool_and(pred > 0) AS ok FROM g GROUP BY 1),
pr AS (SELECT symbol, trade_date AS d, CAST(open AS DOUBLE) AS open, actual AS c, {_decide(0.25)} AS signal FROM (SELECT *, (pred / ref - 1) * 100 AS ex FROM g) q),
er AS (SELECT symbol, {ERRORS} FROM g GROUP BY 1), bh AS {_book_sql('symbol', HOLD_ROWS.replace(', c,', ', actual AS c,'), 'c', 0.0, 0.0)}, pb AS {_book_sql('symbol', 'pr', 'open', 0.001, 0.0005)},
rw AS (SELECT symbol, 'BUY_AND_HOLD' AS strategy, NULL AS model, 'SUCCESS' AS status, total_return_pct, mdd_pct, NULL AS mae_pct, NULL AS rmse_pct, trade_count FROM bh
 UNION ALL SELECT symbol, 'PREDICTION', 'ARIMA_110', CASE WHEN ok THEN 'SUCCESS' ELSE 'FAILED' END, CASE WHEN ok THEN total_return_pct END, CASE WHEN ok THEN mdd_pct END,
  CASE WHEN ok THEN mae_pct END, CASE WHEN ok THEN rmse_pct END, CASE WHEN ok THEN trade_count END FROM pb JOIN er USING (symbol) JOIN okay USING (symbol))"""


def report_rows(spark, sf):
    return P.performance_rows(A.bars_daily(spark, sf), ar_forecasts(spark, sf), "trade_date", D(START), D(END))


@query("RPT1_performance_grid", REPORT + f""" SELECT symbol, strategy, model, status, {rs('total_return_pct', 'total_return_pct', 3, 6)}, {rs('mdd_pct', 'mdd_pct', 3, 6)},
 {rs('mae_pct', 'mae_pct', 3, 10)}, {rs('rmse_pct', 'rmse_pct', 3, 10)}, trade_count FROM rw""")
def performance_grid(spark, sf):
    r = report_rows(spark, sf)
    return r.select("symbol", "strategy", "model", "status", *[dec(c, 3) for c in ("total_return_pct", "mdd_pct", "mae_pct", "rmse_pct")], "trade_count")


def _mean(c, digits=3):
    return f"{rs(f'avg(CAST(round(CAST({c} AS DECIMAL(28,10)), 6) AS DOUBLE))', 'average_' + c, digits, 6)}"


@query("AGG19_report_summary", REPORT + f""" SELECT strategy, model, count(*) FILTER (status = 'SUCCESS') AS successful_runs, count(*) FILTER (status <> 'SUCCESS') AS failed_runs,
 count(*) FILTER (status = 'SUCCESS' AND total_return_pct > 0) AS positive_return_count, {_mean('total_return_pct')}, {_mean('mdd_pct')}, {_mean('mae_pct')}, {_mean('rmse_pct')},
 {_mean('trade_count')} FROM rw GROUP BY 1, 2""")
def report_summary(spark, sf):
    s = P.summarize(report_rows(spark, sf))
    avg = [f"average_{c}" for c in ("total_return_pct", "mdd_pct", "mae_pct", "rmse_pct", "trade_count")]
    return s.select("strategy", "model", "successful_runs", "failed_runs", "positive_return_count", *[dec(c, 3) for c in avg])


SWEEP = AR + f""", okay AS (SELECT symbol, bool_and(pred > 0) AS ok FROM g GROUP BY 1),
pr AS (SELECT symbol, m.mult AS multiplier, trade_date AS d, CAST(open AS DOUBLE) AS open, actual AS c, {_decide('m.mult')} AS signal
 FROM (SELECT *, (pred / ref - 1) * 100 AS ex FROM g) q, (VALUES (0.15::DOUBLE), (0.25::DOUBLE), (0.35::DOUBLE)) m(mult)),
pb AS {_book_sql('symbol, multiplier', 'pr', 'open', 0.001, 0.0005)}"""


@query("RPT2_threshold_sweep", SWEEP + f""" SELECT multiplier, count(*) FILTER (ok) AS successful_runs, count(*) FILTER (NOT ok) AS failed_runs,
 count(*) FILTER (ok AND total_return_pct > 0) AS positive_return_count, {rs("avg(CASE WHEN ok THEN trade_count END)", 'average_trade_count', 3, 6)}
FROM pb JOIN okay USING (symbol) GROUP BY 1""")
def threshold_sweep(spark, sf):
    rows = P.threshold_rows(A.bars_daily(spark, sf), ar_forecasts(spark, sf), "trade_date", D(START), D(END))
    return P.summarize(rows, ("multiplier",)).select("multiplier", "successful_runs", "failed_runs", "positive_return_count", dec("average_trade_count", 3))


@query("RPT1_performance_arima")
def performance_arima(spark, sf):
    """The report grid with both ARIMA models."""
    f = arima_forecasts(spark, sf, [FC.PRICE_ARIMA, FC.LOG_RETURN_ARIMA])
    return P.performance_rows(A.bars_daily(spark, sf), f, "trade_date", D(START), D(END))


@query("RPT3_eligible_universe")
def eligible_universe(spark, sf):
    """Summary over the symbols with a complete week and enough history, both ARIMA models."""
    start, end = D("1998-03-02"), D("1998-03-06")
    bars = P.eligible_bars(A.bars_daily(spark, sf), start, end)
    f = FC.walk_forward(bars, ["symbol"], "trade_date", "close", [FC.PRICE_ARIMA, FC.LOG_RETURN_ARIMA], start, end)
    return P.summarize(P.performance_rows(bars, f, "trade_date", start, end))
