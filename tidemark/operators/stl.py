"""STL decomposition (G2): seasonal-trend decomposition by LOESS.

NumPy implementation of the published algorithm (Cleveland, Cleveland,
McRae & Terpenning, 1990): inner loop of cycle-subseries smoothing, low-pass
filtering and trend smoothing; robust outer loop with bisquare weights.
LOESS (degree 1, tricube) is vectorised over evaluation points.

A series longer than a block is solved in blocks of rows with the same result: LOESS looks a known number of rows
around, so an outer round of a block needs only so many halo rows with the last round's trend and weights.  Each
outer round is a Spark pass; its scale, six times the median of all of a series' |residual|, is found by exact
counting (``quantile``), and trend and weights go back to the blocks.

A missing value keeps its place with weight 0: it gets a trend and a season, but no residual and no weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require_keys
from ..session import cut_lineage
from . import quantile
from . import sequence as seq

_CHUNK = 2048


def _odd(x: float) -> int:
    n = int(np.ceil(x))
    return n if n % 2 else n + 1


def _loess(y: np.ndarray, q: int, at: np.ndarray, rw: np.ndarray | None, span: float | None = None) -> np.ndarray:
    """Degree-1 LOESS of ``y`` (x = 0..m-1) with ``q`` nearest points, evaluated at ``at``.

    ``span`` is the range of x of the whole series when ``y`` is a part of it.
    """
    m = len(y)
    if m == 0:
        return np.full(len(at), np.nan)
    x = np.arange(m, dtype=float)
    w_rob = np.ones(m) if rw is None else rw
    qq = min(q, m)
    rng = x[-1] - x[0] if span is None else span
    out = np.empty(len(at))
    for s in range(0, len(at), _CHUNK):
        x0 = at[s:s + _CHUNK].astype(float)
        left = np.clip(np.floor(x0 - (qq - 1) / 2.0 + 0.5).astype(int), 0, m - qq)
        idx = left[:, None] + np.arange(qq)[None, :]
        xs = x[idx]
        h = np.maximum(np.abs(x0 - xs[:, 0]), np.abs(xs[:, -1] - x0))
        if q > m:
            h = h + (q - m) / 2.0
        r = np.abs(xs - x0[:, None])
        hh = h[:, None]
        w = np.where(r <= 0.001 * hh, 1.0, np.where(r <= 0.999 * hh, (1 - (r / np.where(hh > 0, hh, 1)) ** 3) ** 3,
                                                   0.0))
        w = w * w_rob[idx]
        tot = w.sum(axis=1)
        ok = tot > 0
        wn = np.where(ok[:, None], w / np.where(ok, tot, 1)[:, None], 0.0)
        off = xs - x0[:, None]  # offsets from the point, so that a block rounds as the whole series does
        a = (wn * off).sum(axis=1)
        c = (wn * (off - a[:, None]) ** 2).sum(axis=1)
        lin = c > (0.001 * rng) ** 2
        adj = 1 - a[:, None] * (off - a[:, None]) / np.where(lin, c, 1)[:, None]
        wn = np.where(lin[:, None], wn * adj, wn)
        val = (wn * y[idx]).sum(axis=1)
        # all weights zero (robustness): fall back to the observation itself
        fallback = y[np.clip(np.rint(x0).astype(int), 0, m - 1)]
        out[s:s + _CHUNK] = np.where(ok, val, fallback)
    return out


def _ma(x: np.ndarray, k: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, k).mean(axis=1)


@dataclass(frozen=True)
class Spec:
    """Window lengths and rounds."""

    period: int
    seasonal: int
    trend: int
    low_pass: int
    inner: int
    outer: int

    @classmethod
    def of(cls, period: int, seasonal: int = 7, trend: int | None = None, low_pass: int | None = None, robust: bool = True,
           inner: int | None = None, outer: int | None = None) -> Spec:
        ns = max(3, _odd(seasonal))
        return cls(int(period), ns, trend or _odd(1.5 * period / (1 - 1.5 / ns)), low_pass or _odd(period + 1),
                   inner if inner is not None else (2 if robust else 5), outer if outer is not None else (15 if robust else 0))

    def halo(self) -> int:
        """Rows around that an outer round's result at a row depends on, and a few more."""
        each = (self.seasonal // 2 + 1) * self.period + self.period + 2 + self.low_pass // 2 + 1 + self.trend // 2 + 1
        return self.inner * each + self.period


def smooth(y: np.ndarray, trend: np.ndarray, weight: np.ndarray | None, spec: Spec, start: int = 0, n: int | None = None):
    """(season, trend) after the inner loop; ``y`` holds rows start .. of a series of ``n`` rows, NaN where missing."""
    npd, rows = spec.period, len(y)
    n = rows if n is None else n
    missing = np.isnan(y)
    if missing.any():
        weight = np.where(missing, 0.0, 1.0 if weight is None else weight)
    at, season = np.arange(rows, dtype=float), np.zeros(rows)
    for _ in range(spec.inner):
        detr = np.where(missing, 0.0, y - trend)
        c = np.empty(rows + 2 * npd)
        for j in range(npd):
            sub = detr[j::npd]
            if not len(sub):
                continue
            whole = -(-(n - (start + j) % npd) // npd)  # the subseries' rows in the whole series
            c[j::npd][:len(sub) + 2] = _loess(sub, spec.seasonal, np.arange(-1, len(sub) + 1, dtype=float), None if weight is None else weight[j::npd], whole - 1.0)
        low = _loess(_ma(_ma(_ma(c, npd), npd), 3), spec.low_pass, at, None, n - 1.0)
        season = c[npd:npd + rows] - low
        trend = _loess(np.where(missing, trend, y - season), spec.trend, at, weight, n - 1.0)
    return season, trend


def bisquare(r: np.ndarray, median: float) -> np.ndarray:
    """Robustness weights of |residual| for the series' median of it."""
    if not median > 0:
        return np.where(np.isnan(r), np.nan, 1.0)
    u = r / (6.0 * median)
    return np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - u ** 2) ** 2, np.where(np.isnan(u), np.nan, 0.0)))


def stl(y: np.ndarray, period: int, seasonal: int = 7, trend: int | None = None, low_pass: int | None = None,
        robust: bool = True, inner: int | None = None, outer: int | None = None):
    """Return (seasonal, trend, residual, weights) arrays; where ``y`` is NaN, residual and weight are."""
    y = np.asarray(y, dtype=float)
    n, npd = len(y), int(period)
    if npd < 2 or n < 2 * npd:
        raise ValueError(f"STL needs period >= 2 and at least two periods ({2 * npd} rows), got {n}")
    return solve(y, Spec.of(period, seasonal, trend, low_pass, robust, inner, outer))


def solve(y: np.ndarray, spec: Spec):
    """``stl`` of a whole series."""
    n = len(y)
    season, tr, rw = np.zeros(n), np.zeros(n), None
    if np.isnan(y).all():
        return (np.full(n, np.nan),) * 4
    for k in range(spec.outer + 1):
        season, tr = smooth(y, tr, rw, spec)
        if k < spec.outer:
            r = np.abs(y - season - tr)
            rw = bisquare(r, np.nanmedian(r))
    return season, tr, y - season - tr, np.where(np.isnan(y), np.nan, 1.0 if rw is None else rw)


def stl_decompose(df: DataFrame, keys, ts: str, col: str, period: int, seasonal: int = 7,
                  robust: bool = True, block_rows: int = 8192, bucket: str = seq.DEFAULT_BUCKET, outer: int | None = None) -> DataFrame:
    """STL per series; adds ``trend``, ``seasonal``, ``residual``, ``robust_weight``.

    Series of at most ``block_rows`` rows are solved in one go; of longer ones, every outer round is a Spark pass
    over their blocks, which gives the same components.  Series shorter than two seasons, or without any value,
    get NULL components.
    """
    keys = require_keys(keys)
    spec = Spec.of(period, seasonal, robust=robust, outer=outer)
    if spec.period < 2:
        raise ValueError("STL needs period >= 2")
    sizes = seq.series_sizes(df, keys, "_n")
    placed = seq.index_rows(df, keys, ts, bucket=bucket)
    out = _whole(placed.join(sizes.where(F.col("_n") <= block_rows).select(*keys), keys), df, keys, col, spec)
    long = sizes.where((F.col("_n") > block_rows) & (F.col("_n") >= 2 * spec.period))
    if not long.isEmpty():
        there = placed.join(long, keys)
        parts = _rounds(there.select(*keys, seq.RN, "_n", F.nanvl(F.col(col).cast("double"), F.lit(None)).alias("_y")), keys, spec, block_rows)
        out = out.unionByName(there.drop("_n").join(parts, [*keys, seq.RN], "left").drop(seq.RN))
    return out


PARTS = ["trend", "seasonal", "residual", "robust_weight"]


def _whole(x: DataFrame, df: DataFrame, keys: list[str], col: str, spec: Spec) -> DataFrame:
    names = df.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"{c} double" for c in PARTS])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:  # block_rows at most
        pdf = pdf.sort_values(seq.RN)
        y = pdf[col].to_numpy(dtype=float)
        s, t, r, w = solve(y, spec) if len(y) >= 2 * spec.period else [np.full(len(y), np.nan)] * 4
        return pdf[names].assign(trend=t, seasonal=s, residual=r, robust_weight=w)

    out = x.groupBy(*keys).applyInPandas(run, schema)
    return out.withColumns({c: F.nanvl(c, F.lit(None)) for c in PARTS})


def _rounds(x: DataFrame, keys: list[str], spec: Spec, block_rows: int) -> DataFrame:
    """(keys, position, components) of series longer than a block; an outer round is a pass and a checkpoint."""
    halo = spec.halo()
    fields = ["_n", "_y", "_trend", "_season"]
    schema = ", ".join([*(f"`{k}` {x.schema[k].dataType.simpleString()}" for k in keys), f"{seq.RN} long, _n long, _y double, _trend double, _season double"])

    def block(pdf: pd.DataFrame) -> pd.DataFrame:  # a block and its halos
        pdf = pdf.sort_values(seq.RN)
        y, w = pdf["_y"].to_numpy(dtype=float), pdf["_weight"].to_numpy(dtype=float)
        season, trend = smooth(y, pdf["_trend"].to_numpy(dtype=float), w, spec, int(pdf[seq.RN].iloc[0]) - 1, int(pdf["_n"].iloc[0]))
        out = pdf[[*keys, seq.RN, "_n", "_y"]].assign(_trend=trend, _season=season)
        return out[~pdf[seq.HALO].to_numpy(bool)][[*keys, seq.RN, *fields]]

    residual = F.col("_y") - F.col("_season") - F.col("_trend")
    unit = F.abs(residual) / (6.0 * F.col("_median"))
    weight = F.when(F.col("_y").isNull(), 0.0).when(F.coalesce("_median", F.lit(0.0)) <= 0, 1.0).when(unit <= 0.001, 1.0) \
        .when(unit <= 0.999, (1 - unit * unit) * (1 - unit * unit)).otherwise(0.0)
    state = x.select(*keys, seq.RN, "_n", "_y", F.lit(0.0).alias("_trend"), F.lit(1.0).alias("_weight"))
    for k in range(spec.outer + 1):
        d = seq.with_halo(state, keys, before=halo, after=halo, block_rows=block_rows)
        done = cut_lineage(d.groupBy(*keys, seq.BLK).applyInPandas(block, schema)).withColumn("_y", F.nanvl("_y", F.lit(None)))
        if k < spec.outer:
            middle = quantile.exact_median(done.withColumn("_r", F.abs(residual)), keys, "_r", "_median")
            state = done.join(middle, keys, "left") \
                .select(*keys, seq.RN, "_n", "_y", "_trend", weight.alias("_weight"))
    known = done.groupBy(*keys).agg((F.count("_y") > 0).alias("_some"))
    last = state.select(*keys, seq.RN, "_weight")
    out = done.join(last, [*keys, seq.RN]).join(known, keys)
    some = lambda c: F.when(F.col("_some"), c)  # noqa: E731  a series without any value has no components
    return out.select(*keys, seq.RN, some(F.col("_trend")).alias("trend"), some(F.col("_season")).alias("seasonal"), residual.alias("residual"),
                      F.when(F.col("_y").isNotNull(), F.col("_weight")).alias("robust_weight"))
