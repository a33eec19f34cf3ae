"""ARMA likelihood against the direct normal density; walk-forward rules."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import arma
from tickloom.operators import forecast as FC, series as R


def density(phi, theta, s2, x):
    n = len(x)
    g0 = (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi)
    g1 = (1 + phi * theta) * (phi + theta) / (1 - phi * phi)
    cov = s2 * np.r_[g0, g1 * phi ** np.arange(n - 1)][np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    return -0.5 * (n * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + x @ np.linalg.solve(cov, x))


def simulate(batch, n, phi=0.6, theta=0.3, seed=0):
    e = np.random.default_rng(seed).normal(size=(batch, n + 1))
    y = np.zeros((batch, n))
    for t in range(n):
        y[:, t] = (phi * y[:, t - 1] if t else 0) + e[:, t + 1] + theta * e[:, t]
    return y


def test_fit_is_a_maximum_of_the_exact_likelihood():
    y = simulate(4, 150)
    m = arma.fit(y, np.ones(4, int), np.ones(4, int), np.zeros(4, bool))
    for i in range(4):
        at = density(m["phi"][i, 0], m["theta"][i, 0], m["s2"][i], y[i])
        assert abs(at - m["llf"][i]) < 1e-6
        near = max(density(m["phi"][i, 0] + a, m["theta"][i, 0] + b, m["s2"][i], y[i]) for a in (-.02, 0, .02) for b in (-.02, 0, .02))
        assert near <= at + 1e-4


def test_general_filter_agrees_with_first_order():
    y = simulate(3, 80)
    first = arma._filter_first_order(y, np.full(3, .5), np.full(3, .2), np.ones(3, bool), np.zeros(3, int))
    pad = np.c_[np.full(3, .5), np.zeros(3)], np.c_[np.full(3, .2), np.zeros(3)]
    general = arma._filter(y, *pad, np.ones(3, bool), np.zeros(3, int))
    assert np.allclose(first[0], general[0]) and np.allclose(first[1], general[1])


def test_likelihood_of_the_search_is_that_of_the_model_to_the_last_bit():
    r = np.random.default_rng(5)
    y, begin = simulate(40, 90), r.integers(0, 30, 40)
    y[np.arange(90)[None, :] < begin[:, None]] = 0.0
    phi, theta = r.uniform(-.99, .99, 40), r.uniform(-.99, .99, 40)
    for const in (np.zeros(40, bool), np.ones(40, bool), np.arange(40) % 3 == 0):
        whole = arma._profile(y, phi[:, None], theta[:, None], const, begin)[0]
        assert np.array_equal(whole, arma._first_order_llf(np.ascontiguousarray(y.T), phi, theta, const, begin))


def test_a_pass_of_the_search_is_bounded(monkeypatch):
    seen, llf = [], arma._first_order_llf
    monkeypatch.setattr(arma, "_first_order_llf", lambda y, *a: seen.append(y.shape[1]) or llf(y, *a))
    y, one = simulate(30, 60), np.ones(30, int)
    whole = arma.fit(y, one, one, np.ones(30, bool))
    monkeypatch.setattr(arma, "LANES", 100)
    seen.clear()
    parts = arma.fit(y, one, one, np.ones(30, bool))
    assert 0 < max(seen) <= 100
    assert all(np.array_equal(whole[k], parts[k]) for k in whole)


def first_order_cases():
    """Series, left-aligned copies, sizes and parameters up to the edge of the search."""
    r = np.random.default_rng(7)
    y, begin = simulate(60, 120, -.4, .9), r.integers(0, 60, 60)
    y = (y + r.normal(size=(60, 1))) * 10.0 ** r.integers(-3, 4, (60, 1))
    y[np.arange(120)[None, :] < begin[:, None]] = 0.0
    left = np.stack([np.r_[row[b:], np.zeros(b)] for row, b in zip(y, begin)])
    phi, theta = r.uniform(-.99, .99, 60), r.uniform(-.99, .99, 60)
    phi[:8], theta[4:16], theta[16:20] = 0, [-.9998] * 6 + [.9998] * 6, 0
    return np.ascontiguousarray(y.T), np.ascontiguousarray(left.T), begin, 120 - begin, phi, theta


@pytest.mark.parametrize("const", [np.zeros(60, bool), np.ones(60, bool), np.arange(60) % 3 == 0])
def test_closed_likelihood_and_its_slopes_are_those_of_the_filter(const):
    y, left, begin, size, phi, theta = first_order_cases()
    sums, slopes = arma._first_order_sums(y, left, -theta, slope=True)
    llf, kept = arma._closed_llf(sums, y.sum(0), size, phi, theta, const)
    assert (kept > arma.CANCELLED).all()
    want = arma._first_order_llf(y, phi, theta, const, begin)
    assert np.allclose(llf, want, rtol=0, atol=1e-7)
    by_phi, by_turn, _ = arma._closed_slopes(sums, slopes, y.sum(0), size, phi, theta, const)
    h = 1e-6
    inside = np.abs(theta) < .995
    for got, dp, dt in ((by_phi, h, 0), (by_turn, 0, -h)):
        near = (arma._first_order_llf(y, phi + dp, theta + dt, const, begin) - arma._first_order_llf(y, phi - dp, theta - dt, const, begin)) / (2 * h)
        assert np.allclose(got[inside], near[inside], rtol=1e-5, atol=1e-4)
    h = 1e-8
    near = (arma._first_order_llf(y, phi, theta - h, const, begin) - arma._first_order_llf(y, phi, theta + h, const, begin)) / (2 * h)
    assert np.allclose(by_turn, near, rtol=1e-3, atol=1e-2)


@pytest.mark.parametrize("constant", [True, False])
def test_a_search_filters_few_series(monkeypatch, constant):
    """Over-differenced series draw the search to the edge, through hundreds of likelihoods a fit."""
    seen, llf = [], arma._first_order_llf
    monkeypatch.setattr(arma, "_first_order_llf", lambda y, *a: seen.append(y.shape[1]) or llf(y, *a))
    y, one = np.diff(np.random.default_rng(2).normal(size=(50, 200)), axis=1), np.ones(50, int)
    m = arma.fit(y, one, one, np.full(50, constant), closed=True)
    assert sum(seen) <= 3 * 50 and m["converged"].all() and np.median(m["theta"]) < -.95


@pytest.mark.parametrize("constant", [True, False])
def test_the_search_ends_where_it_ends_by_filtered_likelihoods(constant):
    """White noise has many equally good starts (phi = -theta), smooth series a second optimum: rounding must not choose among them."""
    r = np.random.default_rng(11)
    noise = r.normal(size=(60, 90))
    smooth = np.stack([np.interp(np.arange(91), np.r_[0, np.sort(r.choice(np.arange(1, 90), 25, False)), 90], r.normal(size=27)) for _ in range(60)])
    y = np.concatenate([noise, np.diff(noise, axis=1, prepend=0), np.diff(smooth, axis=1)])
    one, const = np.ones(len(y), int), np.full(len(y), constant)
    sizes = np.where(np.arange(len(y)) % 3, 90, 60)
    fast, slow = (arma.fit(y, one, one, const, sizes, closed=closed) for closed in (True, False))
    assert np.abs(fast["llf"] - slow["llf"]).max() < 1e-4 and fast["converged"].all()
    a, b = (arma.forecast(m, 5)[0] for m in (fast, slow))
    assert np.allclose(a, b, rtol=0, atol=1e-3 * y.std())


def test_series_whose_sums_cancel_are_filtered():
    t = np.arange(150.0)
    y = np.stack([np.ones(150), 100 + 1e-3 * t, 1e6 + np.sin(t), np.r_[1e5, np.random.default_rng(1).normal(size=149)]])
    one, none = np.ones(4, int), np.zeros(4, bool)
    m = arma.fit(y, one, one, none, closed=True)
    assert m["converged"].all() and np.isfinite(m["llf"]).all()
    again = arma._first_order_llf(np.ascontiguousarray(y.T), m["phi"][:, 0], m["theta"][:, 0], none, np.zeros(4, int))
    assert np.allclose(m["llf"], again, rtol=1e-9)
    for phi, theta in ((.9, 0.), (.99, .5), (.999, 0.), (0., 0.), (.3, .3)):
        other = arma._first_order_llf(np.ascontiguousarray(y.T), np.full(4, phi), np.full(4, theta), none, np.zeros(4, int))
        assert (m["llf"] >= other - 1e-6).all()


def test_short_rows_fit_as_if_alone():
    y = simulate(1, 120)[0]
    alone = arma.fit(y[None, 40:], np.ones(1, int), np.ones(1, int), np.ones(1, bool))
    padded = np.stack([y, np.r_[np.zeros(40), y[40:]]])
    both = arma.fit(padded, np.ones(2, int), np.ones(2, int), np.ones(2, bool), lengths=np.array([120, 80]))
    assert abs(alone["llf"][0] - both["llf"][1]) < 1e-5


def linear_days(spark, n=70, skip=()):
    start = dt.date(2026, 1, 1)
    rows = [("S", start + dt.timedelta(days=i), 100 + 20 * i / (n - 1)) for i in range(n) if i not in skip]
    return spark.createDataFrame(rows, "symbol string, d date, close double")


def walk(spark, calls=None, **kw):
    start, end = F.lit("2026-02-20").cast("date"), F.lit("2026-03-01").cast("date")
    up = {"UP": lambda h, steps: (h[:, -1:] * np.full((1, steps), 1.5), None, None)}
    return FC.walk_forward(linear_days(spark), ["symbol"], "d", "close", ["UP"], start, end, forecasters=up, **kw)


def test_signals_use_prior_closes_only(spark):
    rows = FC.decide(walk(spark)).orderBy("execution_time").collect()
    assert len(rows) == 10 and [r.step for r in rows] == [1, 2, 3, 4, 5] * 2
    assert rows[0].signal_time == dt.date(2026, 2, 19) and rows[0].execution_time == dt.date(2026, 2, 20)
    assert all(r.signal == "BUY" for r in rows)
    assert abs(rows[0].reference_price - (100 + 20 * 49 / 69)) < 1e-4  # the numeric gradient of a batch rounds differently


def test_warmup_is_required(spark):
    start, end = F.lit("2026-02-10").cast("date"), F.lit("2026-02-12").cast("date")
    up = {"UP": lambda h, steps: (h[:, -1:] * np.ones((1, steps)), None, None)}
    rows = FC.walk_forward(linear_days(spark), ["symbol"], "d", "close", ["UP"], start, end, forecasters=up).collect()
    assert rows and all("at least 50 observations" in r.error for r in rows)
    with pytest.raises(ValueError):
        walk(spark, warmup=10)


def test_bad_forecasts_are_errors(spark):
    start, end = F.lit("2026-02-20").cast("date"), F.lit("2026-02-24").cast("date")
    bad = {"NAN": lambda h, steps: (np.full((len(h), steps), np.nan), None, None), "SHORT": lambda h, steps: (h[:, -1:], None, None)}
    rows = FC.walk_forward(linear_days(spark), ["symbol"], "d", "close", ["NAN", "SHORT"], start, end, forecasters=bad).collect()
    assert len(rows) == 10 and all(r.error for r in rows)


def test_chunks_do_not_change_results(spark, monkeypatch):
    series = spark.range(400).select(F.lit("S").alias("symbol"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"),
                                     (100 + F.sin(F.col("id") / 7.0) * 10).alias("close"))
    start, end = F.lit("2020-03-15").cast("date"), F.lit("2030-01-01").cast("date")
    last = {"MEAN": lambda h, steps: (np.repeat(h.mean(axis=1, keepdims=True), steps, axis=1), None, None)}
    got = []
    for blocks in (64, 3):
        monkeypatch.setattr(FC, "BLOCKS_PER_CHUNK", blocks)
        f = FC.walk_forward(series, ["symbol"], "d", "close", ["MEAN"], start, end, forecasters=last)
        got.append([(r.execution_time, r.predicted_price) for r in f.orderBy("execution_time").collect()])
    assert got[0] == got[1] and len(got[0]) == 400 - 74


def test_a_fit_does_not_depend_on_its_batch_and_converges():
    r = np.random.default_rng(3)
    y = np.cumsum(r.normal(size=(6, 250)), axis=1)
    d = np.diff(y, axis=1)
    two = np.full(6, 2)
    together = arma.fit(d, two, two, np.full(6, False))
    for i in range(6):
        alone = arma.fit(d[i:i + 1], two[:1], two[:1], np.full(1, False))
        assert abs(alone["aic"][0] - together["aic"][i]) < 1e-4  # the numeric gradient of a batch rounds differently
    assert together["converged"].all()
    # no better value near the one found
    for i in range(6):
        finer = arma.fit(d[i:i + 1], two[:1], two[:1], np.full(1, False), tolerance=1e-12)
        assert together["aic"][i] - finer["aic"][0] < 0.01


def test_series_with_gaps_or_bad_prices_give_error_rows(spark):
    import datetime as dt
    t0 = dt.datetime(2026, 9, 25, 8)
    rows = [(s, t0 + dt.timedelta(minutes=k), v) for s, skip, bad in (("OK", None, None), ("GAP", 70, None), ("NEG", None, 30))
            for k in range(100) if k != skip for v in [100.0 + k % 7 if k != bad else -1.0]]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    start, end = (F.lit(t0 + dt.timedelta(minutes=m)).cast("timestamp_ntz") for m in (60, 70))
    for out in (FC.walk_forward(df, ["k"], "ts", "v", [FC.PRICE_ARIMA], start, end, step=60), FC.ar_walk_forward(df, ["k"], "ts", "v", start, end, step=60)):
        got = {}
        for r in out.collect():
            got.setdefault(r.k, []).append(r.error)
        assert got["GAP"] == ["missing rows"] and got["NEG"] == ["prices must be positive"]
        assert got["OK"] == [None] * 10  # half-open: ten minutes, ten rows


def test_calendar_with_closed_days_is_cleaned(spark):
    import datetime as dt
    days = [d for d in (dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(120)) if d.weekday() < 5]
    rows = [("S", d, 9000.0 if i == 40 else None if i == 20 else 100 + np.sin(i / 9.0)) for i, d in enumerate(days)]
    out = R.clean(spark.createDataFrame([(k, d, None if v is None else float(v)) for k, d, v in rows], "k string, d date, v double"),
                  ["k"], "d", "v", 86400, regular=False).orderBy("d").collect()
    assert [r.d for r in out] == days and max(r.v for r in out) < 102
    assert abs(out[20].v - (out[19].v + out[21].v) / 2) < 1e-9


def test_registered_intraday_runs_reach_the_last_minute(spark):
    from tickloom.queries import QUERIES, forecasting as Q
    sf, key = "/root/testdata/sf0.01", ["symbol", "source"]
    last = {tuple(r) for r in Q.gap_free_minutes(spark, sf).groupBy(*key).agg(F.max("bucket")).collect()}
    for name in ("FCT2_intraday_closed_form", "FCT2_arima_rows"):
        assert {tuple(r) for r in QUERIES[name](spark, sf).groupBy(*key).agg(F.max("execution_time")).collect()} == last
    assert max(r[0] for r in QUERIES["FCT2_intraday_half_open"](spark, sf).select("execution_time").collect()) == dt.datetime(2024, 1, 1, 5, 9)
