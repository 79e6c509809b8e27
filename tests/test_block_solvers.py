"""HP filter and fixed-parameter smoothing over blocks: equal to one system, one recursion."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import decompose as dc
from tidemark.operators import smoothing as sm

DAY = dt.date(2000, 1, 1)


def _rows(key, y):
    return [(key, DAY + dt.timedelta(days=i), None if v != v else float(v)) for i, v in enumerate(y)]


def _dense(y, lamb):
    n = len(y)
    d = np.zeros((max(n - 2, 0), n))
    for i in range(n - 2):
        d[i, i:i + 3] = [1, -2, 1]
    return np.diag((~np.isnan(y)) * 1.0) + lamb * d.T @ d


def test_hp_kernel_solves_the_weighted_system():
    rng = np.random.default_rng(0)
    for n in (3, 4, 5, 6, 7, 50, 301):
        for miss in (0, 1, n // 3):
            y = rng.normal(size=n).cumsum()
            y[rng.choice(n, miss, replace=False)] = np.nan
            if (~np.isnan(y)).sum() >= 2:
                t = dc._hp_trend(y, 1600.0)
                np.testing.assert_allclose(_dense(y, 1600.0) @ t, np.nan_to_num(y), atol=1e-8)


@pytest.mark.parametrize("block_rows", [4, 6, 64])
def test_hp_blocks_equal_one_system(spark, block_rows):
    """Gaps inside, across and beside blocks, odd and even lengths, series of one row, one value, no value."""
    rng = np.random.default_rng(1)
    series = {f"s{n}": rng.normal(size=n).cumsum() for n in (1, 2, 3, 4, 5, 8, 9, 63, 64, 65, 200)}
    series["gaps"] = rng.normal(size=150).cumsum()
    series["gaps"][[0, 1, 5, 149]] = np.nan
    series["gaps"][40:90] = np.nan
    series["one"], series["none"] = np.full(20, np.nan), np.full(9, np.nan)
    series["one"][7] = 5.0
    df = spark.createDataFrame([r for k, y in series.items() for r in _rows(k, y)], "k string, ts date, value double").withColumn("note", F.lit("x"))
    got = dc.hp_filter(df, ["k"], "ts", "value", lamb=1600.0, block_rows=block_rows).orderBy("ts").toPandas()
    assert list(got.columns) == ["k", "ts", "value", "note", "trend", "seasonal", "residual"]
    for k, y in series.items():
        part = got[got.k == k]
        known = ~np.isnan(y)
        if known.sum() == 0:
            assert part.trend.isna().all() and part.seasonal.isna().all()
            continue
        want = np.full(len(y), y[known][0]) if known.sum() == 1 else y if len(y) < 3 else np.linalg.solve(_dense(y, 1600.0), np.nan_to_num(y))
        np.testing.assert_allclose(part.trend.to_numpy(dtype=float), want, atol=1e-7)
        assert (part.residual.isna().to_numpy() == ~known).all()


def test_hp_bridges_a_gap_with_a_line():
    y = np.r_[np.arange(40.0), np.full(30, np.nan), np.arange(70.0, 120.0)]
    np.testing.assert_allclose(dc._hp_trend(y, 129600.0), np.arange(120.0), atol=1e-5)


def _plain(y, period, a, b, g):
    """The recursion, one value after the other."""
    s = sm.Smoother(np.array([[a, b, g]]), period)
    s.first = [float(v) for v in y[:2 * period]]
    if not s.start():
        return np.full((len(y), 4), np.nan)
    out = []
    for v in y:
        i = s.t % period
        f = s.step(float(v))
        out.append((f[0], s.level[0], s.trend[0], s.season[0, i]))
    return np.array(out)


@pytest.mark.parametrize("period,block_rows", [(1, 3), (1, 64), (4, 5), (7, 16), (7, 4096)])
def test_smoothing_blocks_equal_the_recursion(spark, period, block_rows):
    rng = np.random.default_rng(2)
    series = {f"s{n}": 50 + 0.2 * np.arange(n) + 4 * np.sin(np.arange(n)) + rng.normal(size=n) for n in (1, 2, 9, 14, 15, 120)}
    series["gaps"] = series["s120"].copy()
    series["gaps"][[0, 3, 50, 51, 52, 119]] = np.nan
    series["none"] = np.full(40, np.nan)
    df = spark.createDataFrame([r for k, y in series.items() for r in _rows(k, y)], "k string, ts date, value double").withColumn("b", F.lit(0.2))
    got = sm.smooth_fixed(df, ["k"], "ts", "value", period, 0.4, "b", 0.3, block_rows=block_rows).orderBy("ts").toPandas()
    for k, y in series.items():
        want = _plain(y, period, 0.4, 0.2, 0.3)
        np.testing.assert_allclose(got[got.k == k][sm.OUT].to_numpy(dtype=float), want, rtol=1e-10, atol=1e-9)


def test_smoothing_map_is_affine():
    """A block's map applied to any state equals running its rows from that state."""
    rng = np.random.default_rng(3)
    y = rng.normal(size=23)
    y[4] = np.nan
    m = sm.Lanes((0.3, 0.2, 0.5), 5).run(y, 3)
    for _ in range(5):
        state = rng.normal(size=7)
        s = sm.Smoother(np.array([[0.3, 0.2, 0.5]]), 5)
        s.level, s.trend, s.season, s.sse, s.t = state[:1].copy(), state[1:2].copy(), state[None, 2:].copy(), np.zeros(1), 3
        for v in y:
            s.step(float(v))
        np.testing.assert_allclose(m[:, :-1] @ state + m[:, -1], np.r_[s.level, s.trend, s.season[0]], atol=1e-12)
