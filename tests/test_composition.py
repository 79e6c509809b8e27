"""G12 in the backtest: every fold equals the composition on its own training rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.operators import composition as cp
from tidemark.operators import regress as rg
from tidemark.operators.indicators import centred_mean_reflect, positions


def _series(n, seed, key):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    y = 100 + 0.3 * t + 6 * np.sin(2 * np.pi * t / 5) + np.cumsum(rng.normal(size=n))
    return [(key, dt.date(2021, 1, 4) + dt.timedelta(days=int(i)), float(v)) for i, v in zip(t, y)]


@pytest.mark.parametrize("period,fixed", [(5, False), (4, True)])
def test_folds_equal_the_composition_of_their_rows(spark, period, fixed):
    rows = _series(160, 1, "a") + _series(143, 2, "b")
    df = spark.createDataFrame(rows, "k string, ts date, y double")
    cfg = bt.ForecastConfig(n_tests=6, n_forecasts=2, seasonal_periods=period, n_lags=3)
    gap, h = period // 2, 2
    b = [[0.1, 0.5, 0.02, 0.1, 0.3], [0.2, 0.4, -0.01, 0.2, 0.1]]
    kw = {"betas": b, "trend_params": (0.4, 0.2)} if fixed else {}
    got = cp.fold_composition(positions(df, ["k"], "ts"), ["k"], "y", cfg, block_rows=64, **kw).toPandas()
    assert len(got) == 2 * 4 * 2
    if fixed:
        kw["betas"] = [[0.0]] * gap + b
    n = {"a": 160, "b": 143}
    for fold in (-1, 2):
        part = df.where(F.col("ts") < F.when(F.col("k") == "a", F.lit(rows[n["a"] - h * (fold + 1) - 1][1])).otherwise(
            F.lit(rows[n["a"] + n["b"] - h * (fold + 1) - 1][1])) + F.expr("interval 1 day"))
        want = rg.price_composition(part, ["k"], "ts", "y", period, lags=3, horizon=gap + h, method="classical", block_rows=64, **kw).toPandas()
        for r in got[got.fold == fold].itertuples():
            w = want[(want.k == r.k) & (want.step == gap + r.step)].iloc[0]
            np.testing.assert_allclose([r.residual, r.trend, r.seasonal, r.yhat], [w.residual, w.trend, w.seasonal, w.forecast], rtol=1e-6, atol=1e-6)


def test_smoothed_end_equals_the_window_operator(spark):
    season = np.array([3.0, -1.0, 0.5, -2.5])
    y = [("a", dt.date(2021, 1, 1) + dt.timedelta(days=i), float(season[i % 4])) for i in range(30)]
    df = spark.createDataFrame(y, "k string, ts date, s double")
    want = [r.o for r in centred_mean_reflect(df, ["k"], "ts", "s", out="o").orderBy("ts").collect()][-5:]
    np.testing.assert_allclose(cp.smoothed_end(season, 29 % 4, 5), want)


def test_run_all_takes_the_composition(spark):
    df = spark.createDataFrame(_series(170, 3, "a") + _series(30, 4, "short"), "k string, ts date, y double")
    cfg = bt.ForecastConfig(n_tests=6, n_forecasts=2, seasonal_periods=5, n_lags=2)
    art = bt.run_all(df, ["k"], "ts", "y", ["price_composition", "drift"], cfg)
    m = {(r["run_model"], r["Model"]): r["MAE"] for r in art.metrics.collect()}
    assert np.isfinite(m["price_composition", "price_composition"]) and m["price_composition", "price_composition"] < 20
    assert {r.k for r in art.rejected.collect()} == {"short"}
    assert art.forecast.where("model = 'price_composition'").count() == 2
