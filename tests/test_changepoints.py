"""Changepoints selected by an L1 penalty on hinge slopes."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import regress as rg


def _moments(x, y):
    return x.T @ x, x.T @ y[:, None]


def _design(n, knots=10):
    t = np.arange(n) / (n - 1)
    return np.column_stack([np.ones(n), t, *[np.maximum(t - k / (knots + 1), 0) for k in range(1, knots + 1)]])


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x = rng.normal(size=(50, 6)) @ rng.normal(size=(6, 6))
        g, c = x.T @ x, x.T @ rng.normal(size=50)
        pen = rng.uniform(0, 1, 6) * np.abs(c)
        b = rg.lasso(g, c, pen)
        grad = c - g @ b
        scale = 1e-7 * max(1.0, np.abs(c).max())
        assert (np.abs(grad) <= pen + scale).all()
        assert np.allclose(grad[b != 0], (pen * np.sign(b))[b != 0], atol=scale)


def test_planted_changepoints_are_found_and_others_are_zero():
    rng = np.random.default_rng(2)
    x = _design(2000)
    y = 3 + 2 * x[:, 1] + 30 * x[:, 1 + 3] - 50 * x[:, 1 + 8] + rng.normal(size=2000) * 0.05
    xtx, xty = _moments(x, y)
    beta = rg.changepoints(xtx, xty, range(2, 12), 0.02)[:, 0]
    slopes = beta[2:]
    assert abs(slopes[2]) > 15 and slopes[7] < -25
    assert (slopes[[0, 4, 5, 9]] == 0.0).all()
    assert (rg.changepoints(xtx, xty, range(2, 12), 1.0)[2:] == 0.0).all()
    np.testing.assert_allclose(rg.changepoints(xtx, xty, range(2, 12), 0.0)[:, 0], np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-4)


def test_other_columns_are_their_least_squares_given_the_slopes():
    rng = np.random.default_rng(3)
    x = np.column_stack([_design(300, 4), rng.normal(size=300)])
    y = rng.normal(size=300).cumsum()
    xtx, xty = _moments(x, y)
    beta = rg.changepoints(xtx, xty, range(2, 6), 0.3)[:, 0]
    rest = [0, 1, 6]
    np.testing.assert_allclose(x[:, rest].T @ (y - x @ beta), 0, atol=1e-6 * np.abs(y).max() * 300)


def test_forecast_selects_and_is_deterministic(spark):
    rng = np.random.default_rng(4)
    n = 500
    t = np.arange(n)
    y = 20 + 0.02 * t + 0.3 * np.maximum(t - 250, 0) + rng.normal(size=n) * 0.3
    df = spark.createDataFrame([("a", dt.date(2019, 1, 1) + dt.timedelta(days=int(i)), float(v)) for i, v in zip(t, y)], "k string, ts date, v double")
    out = rg.ar_trend_forecast(df, ["k"], "ts", "v", lags=2, horizon=2, changepoints=7, block_rows=64)
    got = out.where(F.col("split") == "test").orderBy("step").collect()
    assert len(got) == 2 and all(abs(r.yhat - r.actual) < 2.0 and r.alpha in rg.L1_SHARES for r in got)
