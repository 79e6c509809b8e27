"""STL over blocks equals STL over the whole series; exact medians by digits."""

import datetime as dt

import numpy as np

from tidemark.operators import quantile, stl


def _series(n, seed, key, gaps=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    y = 10 + 0.01 * t + 4 * np.sin(2 * np.pi * t / 7) + rng.normal(size=n) * np.where(t < n // 2, 0.3, 3.0)
    y[rng.choice(n, n // 100, replace=False)] += 40
    y = [float(v) for v in y]
    for i in rng.choice(n, gaps, replace=False):
        y[i] = None
    for i in range(50, 50 + 3 * gaps):
        y[i] = None  # a gap longer than the seasonal window of one phase
    day = dt.date(1900, 1, 1)
    return [(key, day + dt.timedelta(days=i), y[i]) for i in range(n)]


def test_blocks_equal_the_whole_series(spark):
    """Noise that changes, outliers, NULLs and a long gap; a short series and one without values beside them."""
    rows = _series(3000, 1, "a") + _series(2101, 2, "gaps", 30) + _series(300, 3, "short") + [("tiny", dt.date(1900, 1, 1), 1.0)]
    rows += [("none", d, None) for _, d, _ in _series(700, 4, "none")]
    df = spark.createDataFrame(rows, "k string, ts date, value double").repartition(5)
    cols = ["trend", "seasonal", "residual", "robust_weight"]
    got = stl.stl_decompose(df, ["k"], "ts", "value", 7, block_rows=512, outer=3).orderBy("k", "ts").toPandas()
    one = stl.stl_decompose(df, ["k"], "ts", "value", 7, block_rows=1 << 20, outer=3).orderBy("k", "ts").toPandas()
    for key, part in got.groupby("k"):
        y = np.array([np.nan if v is None else v for _, _, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1])])
        s, t, r, w = stl.stl(y, 7, outer=3) if len(y) >= 14 else [np.full(len(y), np.nan)] * 4
        for name, want in zip(cols, (t, s, r, w)):
            for have in (part[name], one[one.k == key][name]):
                np.testing.assert_allclose(have.to_numpy(dtype=float), want, rtol=0, atol=1e-9)
        if key == "gaps":
            assert np.isfinite(t).all() and np.isnan(r).sum() == np.isnan(y).sum() > 100


def test_missing_values_take_the_pattern_around_them():
    t = np.arange(280)
    full = 0.1 * t + 3 * np.sin(2 * np.pi * t / 7)
    y = full.copy()
    y[[20, 21, 150, 151, 152, 277]] = np.nan
    s, tr, r, w = stl.stl(y, 7)
    np.testing.assert_allclose((s + tr)[np.isnan(y)], full[np.isnan(y)], atol=0.2)


def test_exact_medians(spark):
    rng = np.random.default_rng(5)
    vals = {"odd": rng.exponential(size=101), "even": rng.exponential(size=1000) * 10.0 ** rng.integers(-300, 300, 1000), "ties": rng.integers(0, 3, 500).astype(float),
            "one": np.array([0.0]), "two": np.array([5e-324, 1.7e300]), "same": np.zeros(300), "many": rng.normal(size=20_000).round(3)}
    rows = [(k, float(b)) for k, v in vals.items() for b in v] + [("none", None), ("odd", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    for accuracy in (50, quantile.ACCURACY):
        got = {r.k: r.median for r in quantile.exact_median(df, "k", "v", accuracy=accuracy).collect()}
        assert got == {k: (np.sort(v)[(len(v) - 1) // 2] + np.sort(v)[len(v) // 2]) / 2 for k, v in vals.items()}
