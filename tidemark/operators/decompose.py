"""Series decomposition.

* ``classical`` (G3): centred moving-average trend, phase means of the
  detrended series centred to zero, remainder -- all native windows and
  aggregates.
* ``fourier`` (G5): OLS on cubic time + annual (order 3) + weekly (order 1)
  Fourier columns.  The design matrix is built natively; the normal equations
  come from one grouped aggregate of sufficient statistics (``X'X``, ``X'y``)
  per series, so the data is never gathered; only the 12x12 systems are
  solved in a pandas function over the tiny statistics table.
* ``hp_filter`` (G4): Hodrick-Prescott trend, a block elimination of each series' pentadiagonal system: blocks of
  rows in parallel, two unknowns a block left to solve together.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require_keys
from ..session import cut_lineage
from . import sequence as seq


# G3 ----------------------------------------------------------------------------
def moving_trend(col: str, period: int):
    """Window computation of ``trend``: centred mean over a period (even: 2 x m, half weights at both ends)."""
    m = int(period)
    h = m // 2

    def compute(d, w):
        frame = w.rowsBetween(-h, h)
        full = F.count(F.col(col)).over(frame) == (2 * h + 1)
        if m % 2:
            tr = F.avg(col).over(frame)
        else:
            tr = (F.sum(col).over(frame) - 0.5 * (F.lag(col, h).over(w) + F.lead(col, h).over(w))) / m
        return d.withColumn("trend", F.when(full, tr))

    return compute


def classical(df: DataFrame, keys, ts: str, col: str, period: int, **kw) -> DataFrame:
    """Additive classical decomposition by row position (``seasonal_decompose``)."""
    keys = require_keys(keys)
    m = int(period)
    h = m // 2
    d = seq.bounded(df, keys, ts, moving_trend(col, m), before=h, after=h, keep_rn=True, **kw)
    d = d.withColumn("_phase", (F.col(seq.RN) - 1) % m).withColumn("_detr", F.col(col) - F.col("trend"))
    phase = d.groupBy(*keys, "_phase").agg(F.avg("_detr").alias("_pm"))
    centre = phase.groupBy(*keys).agg(F.avg("_pm").alias("_pc"))
    season = phase.join(centre, keys).select(*keys, "_phase", (F.col("_pm") - F.col("_pc")).alias("seasonal"))
    out = d.join(season, [*keys, "_phase"])
    return (out.withColumn("residual", F.col(col) - F.col("trend") - F.col("seasonal"))
            .drop("_phase", "_detr", seq.RN))


# G5 / G6 -----------------------------------------------------------------------
def fourier_design(ts_col: str, t, annual: int = 3, weekly: int = 1) -> dict:
    """Design columns: const, t, t^2, t^3 (t: position over the number of rows) and Fourier terms of the
    share of the calendar year and of the week (from Monday) that has passed."""
    days = F.date_trunc("year", F.col(ts_col)).cast("date")
    year = (F.dayofyear(ts_col) - 1) / F.datediff(F.add_months(days, 12), days)
    week = F.weekday(ts_col) / F.lit(7.0)
    cols = {"x_const": F.lit(1.0), "x_t1": t, "x_t2": t * t, "x_t3": t * t * t}
    for k in range(1, annual + 1):
        cols[f"x_ys{k}"] = F.sin(F.lit(2 * math.pi * k) * year)
        cols[f"x_yc{k}"] = F.cos(F.lit(2 * math.pi * k) * year)
    for k in range(1, weekly + 1):
        cols[f"x_ws{k}"] = F.sin(F.lit(2 * math.pi * k) * week)
        cols[f"x_wc{k}"] = F.cos(F.lit(2 * math.pi * k) * week)
    return cols


TREND_COLS = ["x_const", "x_t1", "x_t2", "x_t3"]


def _solve_groups(stats: DataFrame, keys: list[str], names: list[str], ridge: float = 1e-9) -> DataFrame:
    p = len(names)
    key_types = ", ".join(f"`{k}` {stats.schema[k].dataType.simpleString()}" for k in keys)
    schema = key_types + ", " + ", ".join(f"b_{n} double" for n in names)

    def solve(batches):
        i, j = np.triu_indices(p)
        for pdf in batches:  # one row a series, all of a batch solved at once
            xtx = np.zeros((len(pdf), p, p))
            xtx[:, i, j] = pdf[[f"s_{a}_{b}" for a, b in zip(i, j)]].to_numpy(float)
            xtx[:, j, i] = xtx[:, i, j]
            xty = pdf[[f"y_{a}" for a in range(p)]].to_numpy(float)
            xtx += ridge * np.eye(p) * np.maximum(1.0, np.trace(xtx, axis1=1, axis2=2) / p)[:, None, None]
            beta = (np.linalg.pinv(xtx, rcond=1e-14, hermitian=True) @ xty[:, :, None])[:, :, 0]
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(beta, columns=[f"b_{n}" for n in names])], axis=1)

    return stats.mapInPandas(solve, schema)


def fourier_fit(df: DataFrame, keys, ts: str, col: str, annual: int = 3, weekly: int = 1):
    """Fit the Fourier regression; returns (rows with design columns, coefficient table, names)."""
    keys = require_keys(keys)
    span = seq.series_sizes(df, keys, "_span")
    d = seq.index_rows(df, keys, ts).join(span, keys)
    design = fourier_design(ts, F.col(seq.RN) / F.col("_span"), annual, weekly)
    names = list(design)
    d = d.withColumns(design)
    y = F.col(col)
    aggs = []
    for i, a in enumerate(names):
        for j in range(i, len(names)):
            aggs.append(F.sum(F.when(y.isNotNull(), F.col(a) * F.col(names[j]))).alias(f"s_{i}_{j}"))
        aggs.append(F.sum(F.col(a) * y).alias(f"y_{i}"))
    stats = d.groupBy(*keys).agg(*aggs)
    beta = _solve_groups(stats, keys, names).join(span, keys)
    return d.drop(seq.RN, "_span"), beta, names


def _parts(names: list[str]):
    fit = sum((F.col(n) * F.col(f"b_{n}") for n in names[1:]), F.col(names[0]) * F.col(f"b_{names[0]}"))
    trend = sum((F.col(n) * F.col(f"b_{n}") for n in TREND_COLS[1:]), F.col("x_const") * F.col("b_x_const"))
    return fit, trend


def fourier(df: DataFrame, keys, ts: str, col: str, annual: int = 3, weekly: int = 1) -> DataFrame:
    """Fourier regression decomposition: trend = polynomial part, seasonal = Fourier
    part, residual = y - fit.  Adds ``fit``, ``trend``, ``seasonal``, ``residual``."""
    keys = require_keys(keys)
    d, beta, names = fourier_fit(df, keys, ts, col, annual, weekly)
    out = d.join(beta.drop("_span"), keys)
    fit, trend = _parts(names)
    out = out.withColumn("fit", fit).withColumn("trend", trend)
    out = out.withColumn("seasonal", F.col("fit") - F.col("trend")).withColumn("residual", F.col(col) - F.col("fit"))
    return out.drop(*names, *[f"b_{n}" for n in names])


def recompose(parts: dict[str, DataFrame], keys, on: str = "step", out: str = "forecast") -> DataFrame:
    """Join (keys, step, part) tables and add the parts into ``out``."""
    keys = require_keys(keys)
    items = list(parts.items())
    res = items[0][1]
    for _, df in items[1:]:
        res = res.join(df, [*keys, on])
    total = sum((F.col(n) for n, _ in items[1:]), F.col(items[0][0]))
    return res.withColumn(out, total)


def fourier_forecast(df: DataFrame, keys, ts: str, col: str, n_steps: int = 2, ar_order: int = 5,
                     exact: bool = True, **kw) -> DataFrame:
    """Future trend + seasonal from the Fourier fit on the next business days, plus an
    AR(p) forecast of the residual (by exact likelihood, or conditional least squares), recomposed (G10).

    Input should be densified and filled (D3 + D1), as in the source.  Returns
    (keys, step, ts, trend, seasonal, residual, forecast).
    """
    from .indicators import next_business_days
    keys = require_keys(keys)
    d, beta, names = fourier_fit(df, keys, ts, col)
    fit, trend = _parts(names)
    beta = cut_lineage(beta)  # small: one row a series
    # read for the AR statistics and for the last p rows
    hist = cut_lineage(d.join(beta.drop("_span"), keys).withColumn("residual", F.col(col) - fit).select(*keys, ts, "residual"))
    fut = next_business_days(df, keys, ts, n_steps).join(beta, keys)
    fut = fut.withColumns(fourier_design(ts, (F.col("_span") + F.col("step")) / F.col("_span")))
    fut = fut.withColumn("_fit", fit).withColumn("trend", trend).withColumn("seasonal", F.col("_fit") - F.col("trend"))
    trend_season = fut.select(*keys, "step", ts, "trend", "seasonal")

    p = int(ar_order)
    if exact:
        from .arima import exact_ar
        ahead = exact_ar(hist, keys, ts, "residual", p, n_steps, **kw)
        resid_fc = ahead.select(*keys, F.posexplode("forecast").alias("_p", "residual")).select(*keys, (F.col("_p") + 1).alias("step"), "residual")
    else:
        resid_fc = _least_squares_ar(hist, keys, ts, p, n_steps, **kw)
    out = recompose({"trend": trend_season, "residual": resid_fc}, keys)
    return out.withColumn("forecast", F.col("trend") + F.col("seasonal") + F.col("residual")) \
        .select(*keys, "step", ts, "trend", "seasonal", "residual", "forecast")


def _least_squares_ar(hist: DataFrame, keys: list[str], ts: str, p: int, n_steps: int, **kw) -> DataFrame:
    """(keys, step, residual): AR(p) by least squares on (1, r_t .. r_{t-p+1}) -> r_{t+1}, unrolled."""
    from . import regress as rg
    from .indicators import positions
    win = rg.windows(hist, keys, ts, "residual", p, 1, **kw)
    coef = rg.solve(rg.normal_equations(win, keys, 1), keys, p + 1, 1, alphas=[0.0]).select(*keys, "beta")
    last = positions(hist, keys, ts).where(F.col("rn_desc") <= p) \
        .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rn_desc", "residual"))).alias("_last"))
    # _last is bounded by p rows per series by construction
    state = last.join(coef, keys).join(hist.groupBy(*keys).agg(F.avg("residual").alias("_mu")), keys)
    key_types = ", ".join(f"`{k}` {state.schema[k].dataType.simpleString()}" for k in keys)

    state = state.select(*keys, F.transform("_last", lambda e: e["residual"] - F.col("_mu")).alias("_past"), "beta", "_mu")

    def unroll(batches):
        for pdf in batches:
            rows = []
            for *key, past, beta_, mu in pdf.itertuples(index=False, name=None):
                past, b = [float(x) for x in past], np.asarray(beta_, dtype=float)  # newest first
                for k in range(1, n_steps + 1):
                    past.insert(0, float(b[0] + np.dot(b[1:], past[:p])))
                    rows.append([*key, k, past[0] + mu])
            yield pd.DataFrame(rows, columns=[*keys, "step", "residual"])

    return state.mapInPandas(unroll, f"{key_types}, step int, residual double")


# G4 ----------------------------------------------------------------------------
def _bands(i: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, first and second off-diagonal of D'D at 1-based rows ``i``; D takes second differences of n rows."""
    first, mid, last = i <= n - 2, (i >= 2) & (i <= n - 1), (i >= 3) & (i <= n)
    return first + 4.0 * mid + last, -2.0 * first - 2.0 * mid, 1.0 * first


def _pairs(start: int, y: np.ndarray, n: int, lamb: float):
    """The system (W + lamb D'D) x = W y on rows start.. (1-based, odd) as pairs of rows: D, E (to the next pair), f.

    W is 0 where ``y`` is NaN.  A row past the end stands alone with x = 0.
    """
    k = -(-len(y) // 2)
    i = np.arange(start, start + 2 * k)
    c0, c1, c2 = (lamb * c for c in _bands(i, n))
    w = np.zeros(2 * k)
    w[:len(y)] = ~np.isnan(y)
    w[i > n] = 1.0
    f = np.zeros(2 * k)
    f[:len(y)] = np.nan_to_num(y)
    d, e = np.zeros((k, 2, 2)), np.zeros((k, 2, 2))
    d[:, 0, 0], d[:, 1, 1] = (w + c0)[::2], (w + c0)[1::2]
    d[:, 0, 1] = d[:, 1, 0] = c1[::2]
    e[:, 0, 0], e[:, 1, 0], e[:, 1, 1] = c2[::2], c1[1::2], c2[1::2]
    return d, e, f.reshape(k, 2, 1)


def _solve_pairs(d: np.ndarray, e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Symmetric block tridiagonal solve by cyclic reduction: ``e[k]`` couples pair k to k + 1; f is (k, 2, columns).

    Each level eliminates every other pair at once, so the work is a few batched 2x2 products a level.
    """
    k = len(d)
    if k == 0:
        return f
    if k == 1:
        return np.linalg.solve(d, f)
    t = lambda x: np.swapaxes(x, 1, 2)
    inv = np.linalg.inv(d[1::2])
    left, right = e[0:k - 1:2], e[1:k - 1:2]  # of the odd pairs: from the pair before, to the pair after
    m, r = len(inv), len(right)
    fo = f[1::2]
    de, fe = d[0::2].copy(), f[0::2].copy()
    pull = left @ inv  # the even pair before takes E inv(D)
    de[:m] -= pull @ t(left)
    fe[:m] -= pull @ fo
    push = t(right) @ inv[:r]  # the even pair after
    de[1:r + 1] -= push @ right
    fe[1:r + 1] -= push @ fo[:r]
    x = np.empty_like(f)
    x[0::2] = xe = _solve_pairs(de, -(pull[:r] @ right), fe)
    rest = fo - t(left) @ xe[:m]
    rest[:r] -= right @ xe[1:r + 1]
    x[1::2] = inv @ rest
    return x


def _inside(d: np.ndarray, e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Pairs 1.. of a block solved for (its values, the block's first pair, the next block's first pair) as sources."""
    k = len(d)
    rhs = np.zeros((k - 1, 2, 5))
    rhs[:, :, :1] = f[1:]
    rhs[0, :, 1:3] = e[0].T
    rhs[-1, :, 3:5] = e[-1]
    return _solve_pairs(d[1:], e[1:-1], rhs)


def _hp_trend(y: np.ndarray, lamb: float) -> np.ndarray:
    """Solve (W + lamb D'D) tau = W y with D the second-difference operator; NaN rows have weight 0."""
    y = np.asarray(y, dtype=float)
    known = ~np.isnan(y)
    if len(y) < 3 or known.sum() < 2:
        return np.where(known, y, y[known][0] if known.any() else np.nan) if known.sum() == 1 else y.copy()
    d, e, f = _pairs(1, y, len(y), lamb)
    return _solve_pairs(d, e[:-1], f).reshape(-1)[:len(y)]


def hp_filter(df: DataFrame, keys, ts: str, col: str, lamb: float = 129600.0, block_rows: int = 8192,
              bucket: str = seq.DEFAULT_BUCKET) -> DataFrame:
    """HP trend per series; seasonal := 0, residual := cycle.

    Exact at any length: every block of rows eliminates all but its first two, the few equations left of a series
    are solved together (two unknowns a block), and the blocks fill in the rest.  A missing value has weight 0: it
    gets a trend but no residual.  A series with one value has it as its trend, one without values has NULL.
    """
    keys = require_keys(keys)
    rows = max(4, block_rows + block_rows % 2)
    value = F.nanvl(F.col(col).cast("double"), F.lit(None))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count(value).alias("_known"), F.max(value).alias("_one"))
    placed = seq.index_rows(df, keys, ts, bucket=bucket).join(sizes, keys).withColumn(seq.BLK, F.floor((F.col(seq.RN) - 1) / rows).cast("long"))
    key_types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def block(pdf: pd.DataFrame):
        pdf = pdf.sort_values(seq.RN)
        start, n = int(pdf[seq.RN].iloc[0]), int(pdf["_n"].iloc[0])
        d, e, f = _pairs(start, pdf["_y"].to_numpy(dtype=float), n, lamb)
        return pdf, d, e, f, start + len(pdf) > n

    def eliminate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, d, e, f, last = block(pdf)
        if len(d) == 1:
            own, b, to, add, c = d[0], f[0, :, 0], e[0], np.zeros((2, 2)), np.zeros(2)
        else:
            g = _inside(d, e, f)
            own, b, to = d[0] - e[0] @ g[0, :, 1:3], f[0, :, 0] - e[0] @ g[0, :, 0], -e[0] @ g[0, :, 3:5]
            add, c = -e[-1].T @ g[-1, :, 3:5], -e[-1].T @ g[-1, :, 0]
        return pd.DataFrame([[*pdf[keys].iloc[0], pdf[seq.BLK].iloc[0], *own.ravel(), *b, *to.ravel(), *add.ravel(), *c]], columns=[*keys, seq.BLK, *cells])

    cells = [f"_c{i}" for i in range(16)]
    few = placed.where((F.col("_known") >= 2) & (F.col("_n") >= 3)).select(*keys, seq.BLK, seq.RN, "_n", value.alias("_y"))
    left = few.groupBy(*keys, seq.BLK).applyInPandas(eliminate, f"{key_types}, {seq.BLK} long, " + ", ".join(f"{c} double" for c in cells))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:  # one row a block of a series
        pdf = pdf.sort_values(seq.BLK)
        x = pdf[cells].to_numpy(dtype=float)
        k = len(x)
        d, f, e = x[:, :4].reshape(k, 2, 2).copy(), x[:, 4:6].reshape(k, 2, 1).copy(), x[:, 6:10].reshape(k, 2, 2)
        d[1:] += x[:-1, 10:14].reshape(k - 1, 2, 2)
        f[1:, :, 0] += x[:-1, 14:16]
        got = _solve_pairs(d, e[:-1], f)[:, :, 0]
        after = np.r_[got[1:], np.zeros((1, 2))]
        return pdf[[*keys, seq.BLK]].assign(_x0=got[:, 0], _x1=got[:, 1], _x2=after[:, 0], _x3=after[:, 1])

    ends = left.groupBy(*keys).applyInPandas(meet, f"{key_types}, {seq.BLK} long, _x0 double, _x1 double, _x2 double, _x3 double")
    names = [f.name for f in df.schema.fields]
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + ["trend double"])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:  # one block
        if np.isnan(pdf["_x0"].iloc[0]):
            few = pdf["_known"].iloc[0] == 1
            return pdf[names].assign(trend=np.full(len(pdf), pdf["_one"].iloc[0]) if few else pdf["_y"].to_numpy(dtype=float))
        pdf, d, e, f, _ = block(pdf)
        ends = pdf[["_x0", "_x1", "_x2", "_x3"]].iloc[0].to_numpy(dtype=float)
        trend = ends[:2]
        if len(d) > 1:
            g = _inside(d, e, f)
            trend = np.r_[trend, (g[:, :, 0] - g[:, :, 1:5] @ ends).ravel()]
        return pdf[names].assign(trend=trend[:len(pdf)])

    out = placed.withColumn("_y", value).join(ends, [*keys, seq.BLK], "left").groupBy(*keys, seq.BLK).applyInPandas(fill, out_schema)
    out = out.withColumn("trend", F.nanvl("trend", F.lit(None)))
    return out.withColumn("seasonal", F.when(F.col("trend").isNotNull(), 0.0)).withColumn("residual", value - F.col("trend"))


def decompose(df: DataFrame, keys, ts: str, col: str, period: int, method: str = "stl", **kw) -> DataFrame:
    """G1 dispatcher: period < 2 -> HP filter; else STL (robust), classical or Fourier; adds E9 encodings."""
    from .indicators import calendar_encoding
    if period < 2:
        out = hp_filter(df, keys, ts, col, **kw)
    elif method == "classical":
        out = classical(df, keys, ts, col, period, **kw)
    elif method == "fourier":
        out = fourier(df, keys, ts, col)
    elif method == "stl":
        from .stl import stl_decompose
        out = stl_decompose(df, keys, ts, col, period, **kw).drop("robust_weight")
    else:
        raise ValueError("method must be 'classical', 'stl' or 'fourier'")
    return calendar_encoding(out, ts)
