"""[N] solvers: recovery of known components and optimality conditions."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import decompose as dc
from tidemark.operators import smoothing as sm
from tidemark.operators.stl import stl


def test_stl_recovers_components_and_isolates_outlier():
    rng = np.random.default_rng(1)
    t = np.arange(600)
    season, trend = 5 * np.sin(2 * np.pi * t / 12), 0.05 * t + 10
    y = trend + season + rng.normal(scale=0.3, size=t.size)
    y[300] += 50
    s, tr, r, w = stl(y, 12)
    assert np.max(np.abs(s + tr + r - y)) < 1e-9
    assert np.max(np.abs(s[24:-24] - season[24:-24])) < 1.0
    assert np.max(np.abs(tr[24:-24] - trend[24:-24])) < 0.5
    assert r[300] > 45 and w[300] == 0.0


def test_hp_filter_normal_equations_and_linear_input():
    rng = np.random.default_rng(0)
    for n in (3, 4, 50, 300):
        y = rng.normal(size=n).cumsum()
        d = np.zeros((n - 2, n))
        for i in range(n - 2):
            d[i, i:i + 3] = [1, -2, 1]
        tau = dc._hp_trend(y, 129600.0)
        assert np.allclose((np.eye(n) + 129600.0 * d.T @ d) @ tau, y, atol=1e-6)
    line = 3.0 + 0.5 * np.arange(40)
    assert np.allclose(dc._hp_trend(line, 129600.0), line, atol=1e-6)


def test_holt_winters_fixed_recursion_and_grid_optimum():
    rng = np.random.default_rng(2)
    t = np.arange(120)
    y = 50 + 0.2 * t + 3 * np.sin(2 * np.pi * t / 12) + rng.normal(scale=0.2, size=t.size)
    s, best = sm.fit(y, 12)
    assert s.sse[best] == s.sse.min() and len(s.sse) == 1000
    fc = s.forecast(best, 2)
    assert abs(fc[0] - (50 + 0.2 * 120 + 3 * np.sin(2 * np.pi * 120 / 12))) < 2.0


def test_fourier_normal_equations(spark):
    rows = [("s", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(100 + 0.1 * i + 5 * np.sin(2 * np.pi * i / 7)))
            for i in range(400)]
    df = spark.createDataFrame(rows, "series_id string, ts date, value double")
    out = dc.fourier(df, ["series_id"], "ts", "value").orderBy("ts").toPandas()
    assert np.allclose(out["trend"] + out["seasonal"] + out["residual"], out["value"])
    # a weekly sine is inside the design, so the fit explains almost all of it
    assert out["residual"].abs().max() < 0.5


def test_direct_ridge_beats_naive_on_ar_series(spark):
    from tidemark.operators import regress as rg
    rng = np.random.default_rng(0)
    rows = []
    for k in range(3):
        y = [5.0, -5.0]
        for _ in range(500):
            y.append(0.2 * y[-1] - 0.7 * y[-2] + rng.normal(scale=0.2))
        rows += [(f"s{k}", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "series_id string, ts date, value double")
    out = rg.direct_forecast(df, ["series_id"], "ts", "value", lags=4, horizon=2, block_rows=64).toPandas()
    again = rg.direct_forecast(df, ["series_id"], "ts", "value", lags=4, horizon=2, block_rows=64).toPandas()
    key = ["series_id", "split", "step"]
    assert np.allclose(out.sort_values(key)["yhat"], again.sort_values(key)["yhat"])  # deterministic
    win = rg.windows(df, ["series_id"], "ts", "value", 4, 2).toPandas()
    ev = win[(win.rn + 2 <= win.n) & (win.rn >= 4)]
    model_err, naive_err = [], []
    sol = rg.solve(rg.normal_equations(rg.windows(df, ["series_id"], "ts", "value", 4, 2), ["series_id"], 2),
                   ["series_id"], 5, 2, alphas=[0.0]).toPandas()
    for _, r in ev.sample(200, random_state=0).iterrows():
        b = sol[(sol.series_id == r.series_id) & (sol.step == 1)].beta.iloc[0]
        model_err.append(abs(np.dot(r.x, b) - r.y[0]))
        naive_err.append(abs(r.x[1] - r.y[0]))
    assert np.mean(model_err) < 0.5 * np.mean(naive_err)
    assert set(out.split) == {"val", "test", "future"}


def test_fourier_forecast_recovers_signal(spark):
    rows, y, r = [], [], 0.0
    rng = np.random.default_rng(5)
    day = dt.date(2021, 1, 4)
    i = 0
    while len(rows) < 500:
        if day.weekday() < 5:
            r = 0.8 * r + rng.normal(scale=0.05)
            rows.append(("s", day, float(50 + 0.01 * i + 2 * np.sin(2 * np.pi * i / 7) + r)))
        day += dt.timedelta(days=1)
        i += 1
    df = spark.createDataFrame(rows, "series_id string, ts date, value double")
    fc = dc.fourier_forecast(df, ["series_id"], "ts", "value", n_steps=2, ar_order=2).orderBy("step").toPandas()
    assert list(fc["step"]) == [1, 2]
    assert [d.weekday() < 5 for d in fc["ts"]] == [True, True]
    assert np.allclose(fc["trend"] + fc["seasonal"] + fc["residual"], fc["forecast"])
    last = rows[-1][2]
    assert abs(fc["forecast"].iloc[0] - last) < 5.0


def _business(n, f, key="s", start=dt.date(2020, 1, 1)):
    days = [d for d in (start + dt.timedelta(days=i) for i in range(2 * n + 10)) if d.weekday() < 5][:n]
    return [(key, d, float(f(i))) for i, d in enumerate(days)]


def test_smoothing_scan_equals_plain_fit(spark):
    """All folds from one streamed pass, over tiny Arrow batches, equal a fit on each fold's history."""
    from tidemark.operators import backtest as bt
    rng = np.random.default_rng(9)
    rows = [r for k in range(3) for r in _business(60 + k, lambda i: 20 + 0.3 * i + 4 * np.sin(i) + rng.normal(), f"s{k}")]
    rows += _business(11, lambda i: i, "short")
    df = spark.createDataFrame(rows, "series_id string, ts date, value double")
    cfg = bt.ForecastConfig(n_tests=6, n_forecasts=2, seasonal_periods=5, n_lags=2)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for model, m in (("holt_winters", 5), ("holt", 1)):
            pos = bt.positions(bt.prepare(df, ["series_id"], "ts", "value"), ["series_id"], "ts")
            got = {(r.series_id, r.fold, r.step): r.yhat for r in bt.predictions(pos, ["series_id"], "y", cfg, model).collect()}
            for k in range(3):
                y = [v for s, _, v in rows if s == f"s{k}"]
                for fold in (-1, 0, 1, 2):
                    s, best = sm.fit(y[:len(y) - 2 * (fold + 1)], m)
                    assert np.allclose([got[f"s{k}", fold, 1], got[f"s{k}", fold, 2]], s.forecast(best, 2))
        art = bt.run_backtest(df, ["series_id"], "ts", "value", cfg, model="holt", baseline="holt_winters")
        assert [r.series_id for r in art.rejected.collect()] == ["short"] and art.metrics.count() == 6
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_fitted_components(spark):
    rows = _business(80, lambda i: 10 + 0.1 * i + 3 * (i % 5), "a") + _business(7, lambda i: i, "b")
    df = spark.createDataFrame(rows, "series_id string, ts date, value double")
    out = sm.fitted_components(df, ["series_id"], "ts", "value", 5).toPandas().sort_values(["series_id", "ts"])
    a, b = out[out.series_id == "a"], out[out.series_id == "b"]
    assert len(a) == 80 and len(b) == 7 and b["fitted"].isna().all()
    assert np.abs(a["fitted"] - a["value"]).tail(20).max() < 0.02
    assert np.allclose((a["level"] + a["season"]).tail(20), a["value"].tail(20), atol=0.02)


def test_blocked_solvers_equal_whole(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=1500).cumsum()
    rows = _business(1500, lambda i: y[i])
    df = spark.createDataFrame(rows, "series_id string, ts date, value double")
    got = dc.hp_filter(df, ["series_id"], "ts", "value", lamb=100.0, block_rows=200).orderBy("ts").toPandas()
    assert np.allclose(got["trend"], dc._hp_trend(y, 100.0), atol=1e-9)
    from tidemark.operators.stl import stl_decompose
    got = stl_decompose(df, ["series_id"], "ts", "value", 5, robust=False, block_rows=400).orderBy("ts").toPandas()
    s, t, _, _ = stl(y, 5, robust=False)
    # at a series' ends LOESS falls back to a flat fit by a rule on the length of what it is given
    off = np.maximum(np.abs(got["trend"] - t), np.abs(got["seasonal"] - s)).to_numpy()
    assert off[50:-50].max() < 1e-6 and off.max() < 0.1


def test_regression_scales_with_the_data(spark):
    """Forecasts of a series times 1e6 (and far from zero) are the forecasts times 1e6; alpha 0 is least squares."""
    from tidemark.operators import regress as rg
    rng = np.random.default_rng(0)
    y = [10.0]
    for _ in range(400):
        y.append(4 + 0.6 * y[-1] + rng.normal())
    rows = [(f"x{p}", d, v * 10.0 ** p) for p in (0, 6) for _, d, v in _business(len(y), lambda i: y[i])]
    df = spark.createDataFrame(rows, "series_id string, ts date, value double")
    for alphas in ([0.0], rg.DEFAULT_ALPHAS):
        for model in (lambda: rg.direct_forecast(df, ["series_id"], "ts", "value", 2, 2, alphas=alphas), lambda: rg.ar_trend_forecast(df, ["series_id"], "ts", "value", 2, 2)):
            out = model().toPandas().sort_values(["split", "step"])
            a, b = out[out.series_id == "x0"], out[out.series_id == "x6"]
            assert np.allclose(a["yhat"].to_numpy() * 1e6, b["yhat"].to_numpy(), rtol=1e-7)
    got = rg.direct_forecast(df, ["series_id"], "ts", "value", 1, 1, alphas=[0.0]).toPandas()
    slope, icept = np.polyfit(y[:-3], y[1:-2], 1)  # targets up to the one before the validation target
    want = {"future": icept + slope * y[-1], "test": icept + slope * y[-2], "val": icept + slope * y[-3]}
    for r in got[got.series_id == "x0"].itertuples():
        assert abs(r.yhat - want[r.split]) < 1e-8


def test_learned_models_in_the_backtest(spark):
    """Fold forecasts equal least squares on each fold's own rows, and every model gives a result."""
    from tidemark.operators import backtest as bt
    from tidemark.operators import regress as rg
    rng = np.random.default_rng(1)
    y = [100.0]
    for _ in range(200):
        y.append(40 + 0.6 * y[-1] + rng.normal())
    df = spark.createDataFrame(_business(len(y), lambda i: y[i]), "series_id string, ts date, value double")
    cfg = bt.ForecastConfig(n_tests=6, n_forecasts=2, seasonal_periods=5, n_lags=1)
    d = df.select("series_id", "ts", F.col("value").alias("y"))
    got = {(r.fold, r.step): r.yhat for r in rg.fold_forecasts(d, ["series_id"], "y", cfg, alpha=0.0).collect()}
    for fold in (-1, 0, 1, 2):
        hist = y[:len(y) - 2 * (fold + 1)]
        for step in (1, 2):
            n = len(hist) - 2
            slope, icept = np.polyfit(hist[:n], hist[step:n + step], 1)
            assert abs(got[fold, step] - (icept + slope * hist[-1])) < 1e-7
    models = ["ridge", "change_ridge", "ar_trend"]
    art = bt.run_all(df, ["series_id"], "ts", "value", models, cfg)
    assert {r.run_model for r in art.metrics.collect()} == set(models)
    assert art.forecast.count() == 6 and art.forecast.where("`Future Predictions` is null").count() == 0


def test_price_composition(spark):
    """On a line with a weekly season the composed forecast goes on with both."""
    from tidemark.operators import regress as rg
    f = lambda i: 100 + 0.5 * i + 2 * np.sin(2 * np.pi * i / 5)
    df = spark.createDataFrame(_business(300, f), "series_id string, ts date, value double")
    out = rg.price_composition(df, ["series_id"], "ts", "value", 5).orderBy("step").toPandas()
    assert list(out["step"]) == [1, 2] and np.allclose(out["residual"] + out["trend"] + out["seasonal"], out["forecast"])
    assert np.abs(out["trend"] - [100 + 0.5 * 300, 100 + 0.5 * 301]).max() < 0.5
    assert np.abs(out["forecast"] - [f(300), f(301)]).max() < 4.5  # the smoothed season is flat
