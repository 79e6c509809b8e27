"""Autoregressive models by exact Gaussian likelihood (the residual model of G6).

The likelihood is the product of one-step prediction densities.  The first p values are predicted from fewer values:
their coefficients and variances come from the partial autocorrelations (Durbin-Levinson), as a Kalman filter from
the stationary state gives them.  All later values enter through sums of products of p + 1 neighbouring values, so a
series is one pass of partial sums, and its fit needs a (p + 2) x (p + 2) matrix and p values, whatever its length.

Partial autocorrelations are tanh of free numbers, which keeps every trial stationary; mean and variance have closed
forms given them.  Windows with a missing value leave the sums; the first p values are those of the first complete
window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require_keys
from . import regress as rg


def levinson(r: Sequence[float]) -> tuple[list[np.ndarray], np.ndarray]:
    """(coefficients of orders 0..p, prediction variances of orders 0..p) of partial autocorrelations; the last
    variance is 1."""
    phi, every = np.zeros(0), [np.zeros(0)]
    for x in r:
        phi = np.r_[phi - x * phi[::-1], x]
        every.append(phi)
    v = np.ones(len(r) + 1)
    for k in range(len(r) - 1, -1, -1):
        v[k] = v[k + 1] / (1.0 - r[k] * r[k])
    return every, v


def partials(phi: Sequence[float]) -> np.ndarray:
    """Partial autocorrelations of a stationary autoregression; raises ValueError for another."""
    phi, out = np.asarray(phi, dtype=float), []
    while len(phi):
        x = phi[-1]
        if not abs(x) < 1:
            raise ValueError("the autoregression is not stationary")
        out.append(x)
        phi = (phi[:-1] + x * phi[:-1][::-1]) / (1 - x * x)
    return np.array(out[::-1])


def quadratic(r: Sequence[float], sums: np.ndarray, first: np.ndarray) -> tuple[float, float, float, float, float]:
    """(q0, q1, q2, log of variances, n): the scaled sum of squared prediction errors is q0 - 2 q1 mean + q2 mean^2.

    ``sums`` is Z'Z over the complete windows, Z = (1, y_t, ..., y_{t-p}); ``first`` the first p values.
    """
    every, v = levinson(r)
    p = len(first)
    a = np.r_[1.0, -every[p]]
    c = a.sum()
    q0, q1, q2 = a @ sums[1:, 1:] @ a, c * (a @ sums[0, 1:]), c * c * sums[0, 0]
    for t in range(p):
        b = np.r_[1.0, -every[t]]
        e, d = b @ first[t::-1] if t else first[0], b.sum()
        q0, q1, q2 = q0 + e * e / v[t], q1 + d * e / v[t], q2 + d * d / v[t]
    return q0, q1, q2, float(np.log(v[:p]).sum()), sums[0, 0] + p


def log_likelihood(r: Sequence[float], mean: float, sigma2: float, sums: np.ndarray, first: np.ndarray) -> float:
    q0, q1, q2, logs, n = quadratic(r, sums, first)
    return -0.5 * (n * np.log(2 * np.pi * sigma2) + logs + (q0 - 2 * q1 * mean + q2 * mean * mean) / sigma2)


def minimise(f, x: np.ndarray, rounds: int = 200) -> np.ndarray:
    """BFGS with central differences and backtracking, for a handful of variables."""
    step = 1e-5

    def slope(x):
        return np.array([(f(x + step * e) - f(x - step * e)) / (2 * step) for e in np.eye(len(x))])

    h, g, now = np.eye(len(x)), slope(x), f(x)
    for _ in range(rounds):
        d = -h @ g
        if d @ g >= 0:
            h, d = np.eye(len(x)), -g
        size = 1.0
        while size > 1e-10 and not f(x + size * d) <= now + 1e-4 * size * (d @ g):
            size /= 2
        if size <= 1e-10:
            break
        s = size * d
        x = x + s
        was, now, old = now, f(x), g
        g = slope(x)
        y = g - old
        if (sy := s @ y) > 1e-12:
            left = np.eye(len(x)) - np.outer(s, y) / sy
            h = left @ h @ left.T + np.outer(s, s) / sy
        if np.abs(g).max() < 1e-7 * max(1.0, abs(now)) or was - now < 1e-13 * max(1.0, abs(now)):
            break
    return x


def fit(sums: np.ndarray, first: np.ndarray) -> tuple[float, np.ndarray, float, float]:
    """(mean, coefficients, variance, log-likelihood) of greatest likelihood."""
    p = len(first)
    n, scale = sums[0, 0] + p, max(float(np.trace(sums[1:, 1:])), float(first @ first))
    if not scale > 0:
        return float(first.mean()) if p else 0.0, np.zeros(p), 0.0, np.nan

    def best(u):
        q0, q1, q2, logs, _ = quadratic(np.tanh(u), sums, first)
        mean = q1 / q2 if q2 > 0 else 0.0
        return max(q0 - q1 * mean, 1e-14 * scale), mean, logs

    def cost(u):
        q, _, logs = best(u)
        return np.log(q / n) + logs / n

    # from no autocorrelation, and from the least-squares coefficients where they are stationary
    starts = [np.zeros(p)]
    try:
        s = sums[2:, 2:] - np.outer(sums[0, 2:], sums[0, 2:]) / max(sums[0, 0], 1.0)
        y = sums[1, 2:] - sums[0, 1] * sums[0, 2:] / max(sums[0, 0], 1.0)
        starts.append(np.arctanh(np.clip(partials(np.linalg.lstsq(s, y, rcond=1e-10)[0]), -0.999, 0.999)))
    except ValueError:
        pass
    u = min((minimise(cost, x) for x in starts), key=cost)
    q, mean, _ = best(u)
    r = np.tanh(u)
    return mean, levinson(r)[0][p], q / n, log_likelihood(r, mean, q / n, sums, first)


def statistics(df: DataFrame, keys, ts: str, col: str, order: int, **kw) -> DataFrame:
    """(keys, mu, i, j, v arrays, first array, last array): sums over complete windows of p + 1 values less ``mu``,
    the first complete window's p older values and the last row's p newest ones, in order of time."""
    keys, p = require_keys(keys), int(order)
    win = rg.windows(df, keys, ts, col, p + 1, 1, **kw).withColumn("y", F.array(F.lit(0.0)))
    whole = win.where(~F.exists("x", lambda v: v.isNull()))
    sums = rg._moments(win, keys).where(F.col("j") <= p + 1)
    packed = sums.groupBy(*keys).agg(F.collect_list(F.struct("i", "j", "v")).alias("_e"))  # (p + 2) squared numbers
    ends = whole.groupBy(*keys).agg(F.min_by("x", "rn").alias("_f"), F.max_by("x", "rn").alias("_l"), F.first("mu").alias("mu"))
    out = packed.join(ends, keys)
    return out.select(*keys, "mu", F.col("_e.i").alias("i"), F.col("_e.j").alias("j"), F.col("_e.v").alias("v"),
                      F.reverse(F.slice("_f", 3, p)).alias("first"), F.reverse(F.slice("_l", 2, p)).alias("last"))


def _sums(i, j, v, p: int) -> np.ndarray:
    m = np.zeros((p + 2, p + 2))
    m[np.asarray(i, int), np.asarray(j, int)] = v
    return np.triu(m) + np.triu(m, 1).T


def exact_ar(df: DataFrame, keys, ts: str, col: str, order: int = 5, n_steps: int = 0, **kw) -> DataFrame:
    """(keys, mean, phi, sigma2, loglik, forecast array of ``n_steps``): AR(p) of greatest exact likelihood.

    A series with fewer than p + 1 values in a row gives no row.
    """
    keys, p = require_keys(keys), int(order)
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:  # one row a series
            out = []
            for *key, mu, i, j, v, first, last in pdf.itertuples(index=False, name=None):
                mean, phi, sigma2, ll = fit(_sums(i, j, v, p), np.asarray(first, dtype=float))
                past, ahead = [x - mean for x in last], []
                for _ in range(n_steps):
                    past.append(float(phi @ np.array(past[:-p - 1:-1])) if p else 0.0)
                    ahead.append(past[-1] + mean + mu)
                out.append((*key, mean + mu, phi.tolist(), sigma2, ll, ahead))
            yield pd.DataFrame(out, columns=[*keys, "mean", "phi", "sigma2", "loglik", "forecast"])

    return statistics(df, keys, ts, col, p, **kw).mapInPandas(run, f"{types}, mean double, phi array<double>, sigma2 double, loglik double, forecast array<double>")


def ar_log_likelihood(df: DataFrame, keys, ts: str, col: str, phi: Sequence[float], mean: float, sigma2: float, **kw) -> DataFrame:
    """(keys, loglik) of given parameters."""
    keys, p, r = require_keys(keys), len(phi), partials(phi)
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            out = [(*key, float(log_likelihood(r, mean - mu, sigma2, _sums(i, j, v, p), np.asarray(first, dtype=float))))
                   for *key, mu, i, j, v, first, _ in pdf.itertuples(index=False, name=None)]
            yield pd.DataFrame(out, columns=[*keys, "loglik"])

    return statistics(df, keys, ts, col, p, **kw).mapInPandas(run, f"{types}, loglik double")
