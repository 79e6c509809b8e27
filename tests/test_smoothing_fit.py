"""Fitted smoothing: exact initial states, blocks, and never worse than the grid."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import smoothing as sm
from tidemark.operators import smoothing_fit as sf


def _errors(y, cell, state, m):
    level, trend, season = state[0], state[1], list(state[2:])
    out = []
    for t, v in enumerate(y):
        s = season[t % m]
        f = level + trend + s
        if t >= m and v == v:
            out.append(v - f)
        v = f if v != v else v
        new = cell[0] * (v - s) + (1 - cell[0]) * (level + trend)
        trend = cell[1] * (new - level) + (1 - cell[1]) * trend
        if m > 1:
            season[t % m] = cell[2] * (v - new) + (1 - cell[2]) * s
        level = new
    return np.array(out)


def _series(rng, n, m):
    t = np.arange(n)
    return 100 + 0.5 * t + 8 * np.sin(2 * np.pi * t / max(m, 2)) + rng.normal(size=n).cumsum()


@pytest.mark.parametrize("m", [1, 4])
def test_forms_give_the_errors_and_their_best_state(m):
    rng = np.random.default_rng(1)
    y = _series(rng, 40, m)
    y[[13, 20]] = np.nan
    cells = rng.uniform(0.05, 0.95, (3, 3))
    total = [np.zeros((m + 3, m + 3)) for _ in cells]
    so_far = [np.eye(m + 3) for _ in cells]
    for a in range(0, 40, 9):  # blocks composed
        maps, forms = sf.block_forms(y[a:a + 9], cells, m, a)
        for k in range(len(cells)):
            total[k] = total[k] + so_far[k].T @ forms[k] @ so_far[k]
            so_far[k] = maps[k] @ so_far[k]
    for k, cell in enumerate(cells):
        for _ in range(5):
            z = np.r_[rng.normal(size=m + 2) * 10, 1.0]
            np.testing.assert_allclose(z @ total[k] @ z, (_errors(y, cell, z[:-1], m) ** 2).sum(), rtol=1e-7)
        sse, state = sf.best_state(total[k], np.r_[y[0], np.zeros(m + 1)])
        np.testing.assert_allclose(sse, (_errors(y, cell, state, m) ** 2).sum(), rtol=1e-6)
        for _ in range(50):
            assert (_errors(y, cell, state + rng.normal(size=m + 2), m) ** 2).sum() >= sse * (1 - 1e-7)


def test_search_is_never_worse_than_the_grid_and_blocks_do_not_matter(spark):
    rng = np.random.default_rng(2)
    y = {"a": _series(rng, 60, 4), "b": _series(rng, 90, 4) + 5 * rng.normal(size=90), "short": np.arange(5.0)}
    y["gaps"] = y["a"].copy()
    y["gaps"][[9, 30, 31]] = np.nan
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), None if v != v else float(v)) for k, s in y.items() for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "k string, ts date, v double").repartition(3)
    fits = {k: sm.fit(s, 4) for k, s in y.items() if k != "short"}
    start = spark.createDataFrame([(k, *map(float, sm.grid(4)[best])) for k, (_, best) in fits.items()], "k string, alpha double, beta double, gamma double")
    got = {r.k: r for r in sf.optimise(df, ["k"], "ts", "v", 4, start, rounds=4, block_rows=16).collect()}
    one = {r.k: r for r in sf.optimise(df, ["k"], "ts", "v", 4, start, rounds=4, block_rows=4096).collect()}
    for k, (s, best) in fits.items():
        r = got[k]
        assert r.sse <= s.sse[best] * (1 + 1e-9)
        np.testing.assert_allclose((_errors(y[k], (r.alpha, r.beta, r.gamma), np.array(r.state), 4) ** 2).sum(), r.sse, rtol=1e-6)
        np.testing.assert_allclose([one[k].alpha, one[k].sse], [r.alpha, r.sse], rtol=1e-6)
        assert all(sf.BOUNDS[0] <= p <= sf.BOUNDS[1] for p in (r.alpha, r.beta, r.gamma))
    assert "short" not in got


def test_trials_stay_in_bounds():
    x = sf.around(np.array([sf.BOUNDS[0], 0.5, sf.BOUNDS[1]]), 0.05, 7)
    assert (x >= sf.BOUNDS[0]).all() and (x <= sf.BOUNDS[1]).all() and any((r == [sf.BOUNDS[0], 0.5, sf.BOUNDS[1]]).all() for r in x)


def test_fitted_components_use_the_estimated_state(spark):
    rng = np.random.default_rng(5)
    y = _series(rng, 70, 5)
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)], "k string, ts date, v double")
    grid = sm.fitted_components(df, ["k"], "ts", "v", 5).toPandas().sort_values("ts")
    best = sm.fitted_components(df, ["k"], "ts", "v", 5, rounds=3, block_rows=16).toPandas().sort_values("ts")
    sse = [((p.v - p.fitted)[5:] ** 2).sum() for p in (grid, best)]
    assert sse[1] < sse[0]
