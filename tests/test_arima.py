"""Exact autoregressive likelihood against the multivariate normal density, and its maximum."""

import datetime as dt

import numpy as np

from tidemark.operators import arima


def _density(y, phi, mean, sigma2):
    """Log-density of the stationary series as one multivariate normal."""
    n, p = len(y), len(phi)
    psi = np.zeros(4000)
    psi[0] = 1.0
    for k in range(1, len(psi)):
        psi[k] = sum(phi[i] * psi[k - 1 - i] for i in range(min(p, k)))
    gamma = np.array([psi[:len(psi) - k] @ psi[k:] for k in range(n)]) * sigma2
    cov = gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    z = y - mean
    return -0.5 * (n * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + z @ np.linalg.solve(cov, z))


def _sums(y, p):
    z = np.array([[1.0, *y[t::-1][:p + 1]] for t in range(p, len(y))])
    return z.T @ z, y[:p]


def _ar(rng, n, phi, mean=0.0):
    y = np.zeros(n + 200)
    for t in range(len(phi), len(y)):
        y[t] = sum(f * y[t - 1 - i] for i, f in enumerate(phi)) + rng.normal()
    return y[200:] + mean


def test_likelihood_equals_the_multivariate_normal():
    rng = np.random.default_rng(1)
    for p in (1, 2, 5):
        for _ in range(5):
            r = rng.uniform(-0.8, 0.8, p)
            phi = arima.levinson(r)[0][p]
            np.testing.assert_allclose(arima.partials(phi), r, atol=1e-10)
            y = rng.normal(size=12) * 2 + 1
            got = arima.log_likelihood(r, 0.7, 1.3, *_sums(y, p))
            np.testing.assert_allclose(got, _density(y, phi, 0.7, 1.3), rtol=1e-8)


def test_fit_is_the_maximum_and_stationary():
    rng = np.random.default_rng(2)
    for phi in ([0.9], [0.5, -0.3], [0.4, 0.2, 0.1, -0.2, 0.3], [0.999]):
        p = len(phi)
        sums, first = _sums(_ar(rng, 60, phi, 5.0), p)
        mean, got, s2, ll = arima.fit(sums, first)
        r = arima.partials(got)  # raises unless stationary
        for _ in range(300):
            q = np.tanh(np.arctanh(r) + rng.normal(size=p) * rng.choice([0.01, 0.1, 1.0]))
            assert arima.log_likelihood(q, mean + rng.normal() * 0.1, s2 * np.exp(rng.normal() * 0.1), sums, first) <= ll + 1e-7


def test_operator_recovers_and_forecasts(spark):
    rng = np.random.default_rng(3)
    y = {"a": _ar(rng, 3000, [0.6, 0.25], 1e4), "b": _ar(rng, 25, [0.5], -3.0), "flat": np.full(30, 7.0), "few": np.array([1.0, 2.0])}
    rows = [(k, dt.date(2000, 1, 1) + dt.timedelta(days=i), float(v)) for k, s in y.items() for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "k string, ts date, v double").repartition(4)
    got = {r.k: r for r in arima.exact_ar(df, ["k"], "ts", "v", 2, n_steps=3, block_rows=64).collect()}
    assert set(got) == {"a", "b", "flat"}
    assert np.allclose(got["a"].phi, [0.6, 0.25], atol=0.06) and abs(got["a"].mean - 1e4) < 1
    for k in ("a", "b"):
        mean, phi, s2, ll = arima.fit(*_sums(y[k] - y[k].mean(), 2))
        assert np.allclose([got[k].mean - y[k].mean(), got[k].sigma2, got[k].loglik], [mean, s2, ll], rtol=1e-4, atol=1e-4)
        past, want = list(y[k] - got[k].mean), []
        for _ in range(3):
            past.append(got[k].phi[0] * past[-1] + got[k].phi[1] * past[-2])
            want.append(past[-1] + got[k].mean)
        assert np.allclose(got[k].forecast, want)
    assert np.allclose(got["flat"].forecast, 7.0)
