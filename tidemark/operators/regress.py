"""Windowed multi-horizon regression (G11-G15, G24), the slot the neural models fill.

A direct multi-step linear model per series: the inputs at origin ``t`` are
the last ``L`` values (plus optional design columns), the outputs are the next
``H`` values, one coefficient vector per step.

Scale plan:
* lag / lead columns come from halo-block windows (no whole-series task);
* the normal equations ``X'X`` and ``X'Y`` are partial sums computed per Arrow
  batch (``mapInPandas``), emitted as (series, entry, value) rows and combined
  by a Spark aggregate -- map-side combined, so a long series is reduced
  before the shuffle;
* each series' small p x p system is solved for a grid of ridge penalties in
  one grouped call whose size depends on p, not on the data;
* predictions are native dot products of the origin's feature array with the
  coefficient array.

Split per series (positions from the end): the test origin's targets are the
last H rows, the validation origin's targets the H rows before them, and
training origins have all targets before the validation targets.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import as_list, require_keys
from . import sequence as seq
from .backtest import register_scan

DEFAULT_ALPHAS = (0.0, 0.1, 1.0, 10.0, 100.0)


def windows(df: DataFrame, keys, ts: str, value: str, lags: int, horizon: int,
            extra: Sequence[str] = (), **kw) -> DataFrame:
    """(keys, ts, rn, n, mu, x array<double>, y array<double>) for every origin row.

    ``x`` = [1, value_t, value_{t-1}, ..., value_{t-L+1}, extra_t...];
    ``y`` = [value_{t+1}, ..., value_{t+H}] (NULL entries where the series ends).  Values are less the
    series' mean ``mu``, so sums of squares lose no digits on a series far from zero.
    """
    keys = require_keys(keys)
    L, H = int(lags), int(horizon)
    extra = as_list(extra)

    def compute(d, w):
        xs = [F.lit(1.0)] + [F.lag(value, i).over(w) if i else F.col(value) for i in range(L)] \
            + [F.col(c).cast("double") for c in extra]
        ys = [F.lead(value, k).over(w) for k in range(1, H + 1)]
        return d.withColumn("x", F.array(*[c.cast("double") for c in xs])) \
                .withColumn("y", F.array(*[c.cast("double") for c in ys]))

    d = seq.bounded(df.select(*keys, ts, value, *extra), keys, ts, compute, before=L - 1, after=H,
                    keep_rn=True, **kw)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.col(value).cast("double")), F.lit(0.0)).alias("mu"))
    d = d.join(sizes, keys).withColumnRenamed(seq.RN, "rn")
    lagged = F.transform("x", lambda v, i: F.when((i >= 1) & (i <= L), v - F.col("mu")).otherwise(v))
    return d.withColumns({"x": lagged, "y": F.transform("y", lambda v: v - F.col("mu"))})


def _split(rn, n, horizon: int):
    test = rn == n - horizon
    val = rn == n - 2 * horizon
    train = rn + horizon <= n - 2 * horizon
    return train, val, test


def normal_equations(win: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """(keys, i, j, v): entries of X'X (j < p) and X'Y (j = p + step - 1) over training origins."""
    train, _, _ = _split(F.col("rn"), F.col("n"), horizon)
    return _moments(win.where(train), keys)


def _moments(t: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries of X'X and X'Y over the complete rows of ``t``, one sum per group and entry."""
    keys = list(keys)
    key_types = ", ".join(f"`{k}` {t.schema[k].dataType.simpleString()}" for k in keys)
    t = t.where(~F.exists("x", lambda v: v.isNull()) & ~F.exists("y", lambda v: v.isNull())).select(*keys, "x", "y")
    schema = f"{key_types}, i int, j int, v double"

    def partial(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            for kv, g in pdf.groupby(keys, sort=False):
                x = np.stack(g["x"].to_numpy())
                y = np.stack(g["y"].to_numpy())
                p = x.shape[1]
                xtx = x.T @ x
                xty = x.T @ y
                iu, ju = np.triu_indices(p)
                ii = np.r_[iu, np.repeat(np.arange(p), y.shape[1])]
                jj = np.r_[ju, np.tile(p + np.arange(y.shape[1]), p)]
                vv = np.r_[xtx[iu, ju], xty.ravel()]
                kv = kv if isinstance(kv, tuple) else (kv,)
                out = pd.DataFrame({"i": ii.astype("int32"), "j": jj.astype("int32"), "v": vv})
                for k, val in zip(keys, kv):
                    out.insert(0, k, val)
                yield out[[*keys, "i", "j", "v"]]

    return t.mapInPandas(partial, schema).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def ridge(xtx: np.ndarray, xty: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients from normal equations whose first column is the intercept.

    Columns are centred and scaled by their own mean and deviation (both are in X'X), the penalty acts on the
    scaled slopes only and the intercept is free, so results scale with the data; ``alpha`` 0 is least squares
    (of least norm where columns are dependent), and a constant column gets coefficient 0.
    """
    n = xtx[0, 0]
    out = np.zeros_like(xty)
    if n <= 0:
        return np.full_like(xty, np.nan)
    mean, ymean = xtx[0, 1:] / n, xty[0] / n
    cov = xtx[1:, 1:] / n - np.outer(mean, mean)
    cross = xty[1:] / n - np.outer(mean, ymean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    use = sd > 1e-9 * np.maximum(1.0, np.sqrt(np.diag(xtx)[1:] / n))
    if use.any():
        r = cov[np.ix_(use, use)] / np.outer(sd[use], sd[use]) + np.eye(int(use.sum())) * (alpha / n)
        slope = np.linalg.lstsq(r, cross[use] / sd[use][:, None], rcond=1e-11)[0] / sd[use][:, None]
        out[1:][use] = slope
    out[0] = ymean - mean @ out[1:]
    return out


def lasso(g: np.ndarray, c: np.ndarray, penalty: np.ndarray, rounds: int = 10_000) -> np.ndarray:
    """Slopes that minimise b'Gb/2 - c'b + sum(penalty |b|), by coordinate descent on the sums of products."""
    b, grad = np.zeros(len(c)), c.astype(float).copy()  # grad = c - G b
    live = np.flatnonzero(np.diag(g) > 0)
    for _ in range(rounds):
        most = 0.0
        for j in live:
            free = grad[j] + g[j, j] * b[j]
            new = np.sign(free) * max(abs(free) - penalty[j], 0.0) / g[j, j]
            if new != b[j]:
                grad -= g[:, j] * (new - b[j])
                most = max(most, abs(new - b[j]) * np.sqrt(g[j, j]))
                b[j] = new
        if most <= 1e-12 * max(1.0, np.abs(c).max()):
            break
    return b


def changepoints(xtx: np.ndarray, xty: np.ndarray, hinges: Sequence[int], share: float) -> np.ndarray:
    """Coefficients with an L1 penalty on the hinge slopes only, per step.

    The other columns are projected out exactly; hinges are penalised on the scale of what is left of them, by
    ``share`` of the least penalty that leaves none.  Slopes that are not needed are exactly 0.
    """
    p = len(xtx)
    h = np.asarray(hinges, dtype=int)
    u = np.setdiff1d(np.arange(p), h)
    scale = np.sqrt(np.maximum(np.diag(xtx), 1e-300))
    a, y = xtx / np.outer(scale, scale), xty / scale[:, None]
    inv = np.linalg.pinv(a[np.ix_(u, u)], rcond=1e-11, hermitian=True)
    cross = inv @ a[np.ix_(u, h)]
    g, c = a[np.ix_(h, h)] - a[np.ix_(h, u)] @ cross, y[h] - cross.T @ y[u]
    left = np.sqrt(np.maximum(np.diag(g), 0.0))
    g[left < 1e-6] = 0.0
    g[:, left < 1e-6] = 0.0
    out = np.zeros_like(xty)
    for k in range(y.shape[1]):
        c_k = np.where(left < 1e-6, 0.0, c[:, k])
        top = np.max(np.abs(c_k) / np.where(left < 1e-6, np.inf, left), initial=0.0)
        b = lasso(g, c_k, share * top * left)
        out[h, k] = b / scale[h]
        out[u, k] = (inv @ y[u, k] - cross @ b) / scale[u]
    return out


def solve(stats: DataFrame, keys: Sequence[str], p: int, horizon: int,
          alphas: Sequence[float] = DEFAULT_ALPHAS, hinges: Sequence[int] = ()) -> DataFrame:
    """(keys, alpha, step, beta array<double>) ridge solutions; the intercept is not penalised.  With ``hinges``
    (columns) the penalties are shares of an L1 penalty on those alone (``changepoints``).

    One row a series reaches Python (p x (p + H) numbers), many series in an Arrow batch.
    """
    keys = list(keys)
    key_types = ", ".join(f"`{k}` {stats.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{key_types}, alpha double, step int, beta array<double>"
    # at most p * (p + H) entries a series
    packed = stats.groupBy(*keys).agg(F.collect_list(F.struct("i", "j", "v")).alias("_e")).select(
        *keys, F.transform("_e", lambda e: e["i"]).alias("_i"), F.transform("_e", lambda e: e["j"]).alias("_j"),
        F.transform("_e", lambda e: e["v"]).alias("_v"))

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False, name=None):
                m = np.zeros((p, p + horizon))
                i, j = np.asarray(r[-3], int), np.asarray(r[-2], int)
                m[i, j] = r[-1]
                xtx = np.triu(m[:, :p]) + np.triu(m[:, :p], 1).T
                for a in alphas:
                    beta = changepoints(xtx, m[:, p:], hinges, float(a)) if len(hinges) else ridge(xtx, m[:, p:], float(a))
                    rows += [(*r[:-3], float(a), k + 1, beta[:, k].tolist()) for k in range(horizon)]
            yield pd.DataFrame(rows, columns=[*keys, "alpha", "step", "beta"])

    return packed.mapInPandas(run, schema)


def _dot(x: str, beta: str):
    return F.aggregate(F.zip_with(F.col(x), F.col(beta), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def direct_forecast(df: DataFrame, keys, ts: str, value: str, lags: int = 5, horizon: int = 2,
                    extra: Sequence[str] = (), alphas: Sequence[float] = DEFAULT_ALPHAS, hinges: Sequence[str] = (), **kw) -> DataFrame:
    """Per-series direct ridge model; the penalty is chosen per series on the
    validation origin (G24), then the test origin and the future origin are predicted.

    Returns (keys, split in {'val','test','future'}, origin, step, target_ts, yhat, actual, alpha);
    ``target_ts`` is set on the future rows (next business days, G12).
    """
    keys = require_keys(keys)
    p = 1 + int(lags) + len(as_list(extra))
    win = windows(df, keys, ts, value, lags, horizon, extra, **kw)
    at = [1 + int(lags) + as_list(extra).index(c) for c in hinges]
    betas = solve(normal_equations(win, keys, horizon), keys, p, horizon, alphas, at)
    _, val, test = _split(F.col("rn"), F.col("n"), horizon)
    future = F.col("rn") == F.col("n")
    origins = win.where(val | test | future).select(
        *keys, F.col(ts).alias("origin"), "mu", "x", "y",
        F.when(val, "val").when(test, "test").otherwise("future").alias("split"))
    pred = origins.join(betas, keys).withColumn("yhat", _dot("x", "beta") + F.col("mu"))
    pred = pred.withColumn("actual", F.element_at("y", F.col("step")) + F.col("mu"))
    err = (pred.where(F.col("split") == "val").groupBy(*keys, "alpha")
           .agg(F.avg(F.abs(F.col("actual") - F.col("yhat"))).alias("val_mae")))
    best = err.groupBy(*keys).agg(F.min_by("alpha", F.struct(F.col("val_mae"), F.col("alpha"))).alias("best_alpha"))
    out = pred.join(best, keys).where(F.col("alpha") == F.col("best_alpha"))
    # The future block is dated on the next business days (no holidays)
    from .indicators import next_business_days
    dates = next_business_days(df, keys, ts, horizon, out="target_ts").withColumn("split", F.lit("future"))
    out = out.join(dates, [*keys, "split", "step"], "left")
    return out.select(*keys, "split", "origin", "step", "target_ts", "yhat", "actual", "alpha")


def trend_fourier_design(df: DataFrame, keys, ts: str, changepoints: int = 10, yearly: int = 3,
                         weekly: int = 1) -> tuple[DataFrame, list[str]]:
    """G15 design columns: scaled time, hinge terms at evenly spaced changepoints, Fourier terms."""
    import math
    keys = require_keys(keys)
    span = df.groupBy(*keys).agg(F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    d = df.join(span, keys)
    days = F.datediff(F.col(ts), F.col("_t0")).cast("double")
    total = F.greatest(F.datediff(F.col("_t1"), F.col("_t0")).cast("double"), F.lit(1.0))
    t = days / total
    cols = {"d_t": t}
    for k in range(1, changepoints + 1):
        cols[f"d_h{k}"] = F.greatest(t - F.lit(k / (changepoints + 1.0)), F.lit(0.0))
    for k in range(1, yearly + 1):
        cols[f"d_ys{k}"] = F.sin(F.lit(2 * math.pi * k / 365.25) * days)
        cols[f"d_yc{k}"] = F.cos(F.lit(2 * math.pi * k / 365.25) * days)
    for k in range(1, weekly + 1):
        cols[f"d_ws{k}"] = F.sin(F.lit(2 * math.pi * k / 7.0) * days)
        cols[f"d_wc{k}"] = F.cos(F.lit(2 * math.pi * k / 7.0) * days)
    return d.withColumns(cols).drop("_t0", "_t1"), list(cols)


#: Shares of the least L1 penalty that leaves no changepoint.
L1_SHARES = (0.01, 0.05, 0.2, 0.5, 1.0)


def ar_trend_forecast(df: DataFrame, keys, ts: str, value: str, lags: int = 5, horizon: int = 2,
                      changepoints: int = 10, l1: Sequence[float] | None = L1_SHARES, **kw) -> DataFrame:
    """Autoregressive lags + piecewise-linear trend + yearly/weekly season, direct n-step (the linear re-aim of
    the source's neural forecaster).  Changepoints are selected by an L1 penalty on their slopes, whose share is
    chosen per series on the validation origin; with ``l1`` None all columns are ridge-regularised instead."""
    d, extra = trend_fourier_design(df, keys, ts, changepoints)
    if l1 is None:
        return direct_forecast(d, keys, ts, value, lags, horizon, extra, **kw)
    return direct_forecast(d, keys, ts, value, lags, horizon, extra, alphas=l1, hinges=[c for c in extra if c.startswith("d_h")], **kw)


def change_forecast(df: DataFrame, keys, ts: str, value: str, lags: int = 5, horizon: int = 2,
                    **kw) -> DataFrame:
    """The same model on percent changes; predicted changes are compounded into
    prices from the last actual value at or before each origin (C6 + E14)."""
    from .indicators import pct_change
    keys = require_keys(keys)
    chg = pct_change(df, keys, ts, value, "_chg")
    fc = direct_forecast(chg.select(*keys, ts, "_chg").where(F.col("_chg").isNotNull()), keys, ts, "_chg",
                         lags, horizon, **kw)
    base = df.select(*keys, F.col(ts).alias("origin"), F.col(value).alias("_base"))
    fc = fc.join(base, [*keys, "origin"])
    from pyspark.sql import Window
    # product over the steps of one origin: a bounded group of `horizon` rows
    w = Window.partitionBy(*keys, "split", "origin").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    out = fc.withColumn("price", F.col("_base") * F.product(F.lit(1.0) + F.col("yhat")).over(w))
    return out.drop("_base")


def _points(win: DataFrame, lags: int, horizon: int) -> DataFrame:
    """(step, x array<double>, label, weight): the rows of ``win`` (``_x0``.. the lags, ``_y1``.. the targets) as a
    few weighted points a task and step, whose weight, mean and covariance are those of the task's complete rows.

    Least squares know rows by those alone, so a fit on the points is the fit on the rows.  A task adds its Arrow
    batches up about running means; points lie in pairs around the mean, along the axes of the covariance.  Their
    number is a power of two, so that weights (count / number) are exact.
    """
    L, H = int(lags), int(horizon)
    xs, ys = [f"_x{i}" for i in range(L)], [f"_y{k}" for k in range(1, H + 1)]
    d = L + 1
    m = 1 << (2 * d - 1).bit_length()

    def points(n: int, mean: np.ndarray, m2: np.ndarray) -> np.ndarray:
        out = np.tile(mean, (m, 1))
        if not np.isfinite(m2).all():
            return out + np.nan  # refused by the fit, as the rows would be
        use = np.flatnonzero(np.diag(m2) > 0)
        if len(use):
            root, axes = np.linalg.eigh(m2[np.ix_(use, use)] / n)
            step = (axes * np.sqrt(np.maximum(root, 0.0) * (m / 2))).T
            out[np.ix_(np.arange(len(use)), use)] += step
            out[np.ix_(np.arange(d, d + len(use)), use)] -= step
        return out

    def run(batches):
        sums = {k: (0, np.zeros(d), np.zeros((d, d))) for k in range(H)}
        for batch in batches:
            z = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in [*xs, *ys]]) if batch.num_rows else np.zeros((0, L + H))
            for k in range(H):
                known = batch.column(ys[k]).is_valid().to_numpy(zero_copy_only=False)
                a = z[known][:, [*range(L), L + k]]
                if not len(a):
                    continue
                n, mean, m2 = sums[k]
                a0 = a - a[0]  # a constant column stays exact
                at = a0.mean(axis=0)
                a0 -= at
                at = at + a[0]
                gap = at - mean if n else np.zeros(d)
                both = n + len(a)
                sums[k] = both, mean + gap * (len(a) / both) if n else at, m2 + a0.T @ a0 + np.outer(gap, gap) * (n * len(a) / both)
        for k, (n, mean, m2) in sums.items():
            if n:
                p = points(n, mean, m2)
                yield pa.RecordBatch.from_arrays([pa.array([k + 1] * m, pa.int32()), pa.array(p[:, :L].tolist(), pa.list_(pa.float64())),
                                                  pa.array(p[:, L]), pa.array([n / m] * m)], ["step", "x", "label", "weight"])

    return win.select(*xs, *ys).mapInArrow(run, "step int, x array<double>, label double, weight double")


def pooled_linear(df: DataFrame, keys, ts: str, value: str, lags: int = 5, horizon: int = 2,
                  reg_params: Sequence[float] = (0.0, 0.01, 0.1), elastic: Sequence[float] = (0.0, 0.5),
                  **kw) -> DataFrame:
    """G11/G24 with MLlib: one ``LinearRegression`` per step pooled over all series; every cell of the grid
    (regParam, elasticNetParam) is fitted on the training rows and the one with the smallest mean absolute error
    on the validation origins, whose targets lie after all training targets, is kept.

    Positions are taken once.  All training rows are read once, into the weighted points of ``_points``, on which
    the grid is fitted; the origins' windows are made of the last rows of each series alone.

    Returns predictions for every origin: (keys, origin, step, yhat, actual, split).
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import ParamGridBuilder

    from pyspark import StorageLevel

    from ..session import cut_lineage

    keys = require_keys(keys)
    L, H = int(lags), int(horizon)

    def compute(d, w):
        return d.withColumns({**{f"_x{i}": (F.lag(value, i).over(w) if i else F.col(value)).cast("double") for i in range(L)},
                              **{f"_y{k}": F.lead(value, k).over(w).cast("double") for k in range(1, H + 1)}})

    def wide(d):  # one model for all series: values as they are
        out = seq.bounded(d, keys, ts, compute, before=L - 1, after=H, keep_rn=True, **kw)
        for i in range(L):
            out = out.where(F.col(f"_x{i}").isNotNull())
        return out.withColumnRenamed(seq.RN, "rn")

    idx = {k: v for k, v in kw.items() if k in ("bucket", "tiebreak", "counts_from", "local_rn")}
    # read twice (training rows, origins): narrow rows, spilling to disk if needed
    pos = seq.index_rows(df.select(*keys, ts, value), keys, ts, size="n", **idx).persist(StorageLevel.MEMORY_AND_DISK)
    train, val, test = _split(F.col("rn"), F.col("n"), H)
    try:
        # a few rows a task, fitted by every cell of the grid
        points = cut_lineage(_points(wide(pos).where(train), L, H))
        # the rows to predict (3 origins per series) are small: checkpoint them
        ends = pos.where(F.col(seq.RN) > F.col("n") - 2 * H - L)
        origins = cut_lineage(wide(ends).where(val | test | (F.col("rn") == F.col("n"))).select(
            *keys, ts, "rn", "n", F.array(*[f"_y{k}" for k in range(1, H + 1)]).alias("y"),
            array_to_vector(F.array(*[f"_x{i}" for i in range(L)])).alias("features"),
            F.when(val, "val").when(test, "test").otherwise("future").alias("split")))
    finally:
        pos.unpersist()
    outs = []
    for k in range(1, H + 1):
        lr = LinearRegression(featuresCol="features", labelCol="label", weightCol="weight", standardization=True)
        grid = ParamGridBuilder().addGrid(lr.regParam, list(reg_params)) \
            .addGrid(lr.elasticNetParam, list(elastic)).build()
        lab = points.where(F.col("step") == k).select(array_to_vector("x").alias("features"), "label", "weight")
        held = origins.where(F.col("split") == "val").withColumn("label", F.element_at("y", k)).where(F.col("label").isNotNull())
        errors = [(m.transform(held).agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0], i, m)
                  for i, m in enumerate(lr.fit(lab, grid))]
        model = min(errors, key=lambda e: (float("inf") if e[0] is None else e[0], e[1]))[2]
        pred = model.transform(origins.withColumn("label", F.element_at("y", k)))
        outs.append(pred.select(*keys, F.col(ts).alias("origin"), F.lit(k).alias("step"),
                                F.col("prediction").alias("yhat"), F.col("label").alias("actual"), "split"))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


# ---------------------------------------------------------------- forecasters of the backtest (U4)
def fold_forecasts(d: DataFrame, keys: list[str], value: str, cfg, extra: Sequence[str] = (), alpha: float = 1.0) -> DataFrame:
    """(keys, fold, step, o, ots, yo, yhat) of the direct ridge model for every fold from one pass.

    A training row belongs to the folds whose origin its targets do not pass; it is counted for the newest
    backtest fold that still may use it, and a running sum over the folds (at most n_tests / H + 1 rows a
    series and entry) gives each fold its normal equations, so the history is never copied.
    """
    from pyspark.sql import Window

    h, folds, lags = cfg.n_forecasts, cfg.n_folds, cfg.n_lags
    win = windows(d, keys, "ts", value, lags, h, extra)
    last = F.floor((F.col("n") - F.col("rn") - h) / h) - 1  # the oldest fold whose origin is not before the targets
    era = F.least(last, F.lit(folds - 1)).cast("int")
    parts = _moments(win.where(F.col("rn") + h <= F.col("n")).withColumn("fold", era), [*keys, "fold"])
    upto = Window.partitionBy(*keys, "i", "j").orderBy(F.col("fold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    betas = solve(parts.withColumn("v", F.sum("v").over(upto)), [*keys, "fold"], 1 + lags + len(as_list(extra)), h, [alpha])
    back = F.col("n") - F.col("rn")
    at = win.where((back % h == 0) & (back <= folds * h)).select(
        *keys, (F.floor(back / h) - 1).cast("int").alias("fold"), F.col("rn").alias("o"), F.col("ts").alias("ots"),
        F.col(value).alias("yo"), "mu", "x")
    out = at.join(betas, [*keys, "fold"]).withColumn("yhat", _dot("x", "beta") + F.col("mu"))
    return out.select(*keys, "fold", "step", "o", "ots", "yo", "yhat")


def _lag_rows(cfg) -> int:
    """Rows that leave the oldest fold as many training rows as there are coefficients, and one more."""
    return cfg.n_folds * cfg.n_forecasts + cfg.n_forecasts + 2 * cfg.n_lags + 2


@register_scan("ridge", _lag_rows)
def _ridge(pos: DataFrame, keys: list[str], value: str, cfg) -> DataFrame:
    """Direct ridge on the last n_lags values."""
    return fold_forecasts(pos.select(*keys, "ts", value), keys, value, cfg)


@register_scan("change_ridge", lambda cfg: _lag_rows(cfg) + 1)
def _change(pos: DataFrame, keys: list[str], value: str, cfg) -> DataFrame:
    """The same on percent changes, compounded from the value at the origin (a change from 0 counts as 0)."""
    from pyspark.sql import Window

    from .indicators import pct_change
    d = pct_change(pos.select(*keys, "ts", value, F.col("rn").alias("_rn0")), keys, "ts", value, "_chg")
    chg = d.withColumn("_chg", F.when(F.col("_rn0") == 1, None).when(F.abs("_chg") < float("inf"), F.col("_chg")).otherwise(0.0))
    fc = fold_forecasts(chg.select(*keys, "ts", "_chg"), keys, "_chg", cfg)
    fc = fc.drop("yo").join(pos.select(*keys, F.col("rn").alias("o"), F.col(value).alias("yo")), [*keys, "o"])
    w = Window.partitionBy(*keys, "fold").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # H rows
    return fc.withColumn("yhat", F.col("yo") * F.product(F.lit(1.0) + F.col("yhat")).over(w))


@register_scan("ar_trend", lambda cfg: _lag_rows(cfg) + 40)
def _ar_trend(pos: DataFrame, keys: list[str], value: str, cfg) -> DataFrame:
    """Lags, piecewise-linear trend and yearly and weekly season."""
    d, extra = trend_fourier_design(pos.select(*keys, "ts", value), keys, "ts")
    return fold_forecasts(d, keys, value, cfg, extra)


# ---------------------------------------------------------------- price composition
FEATURES = ("residual", "trend", "seasonal", "dow_sin", "dow_cos", "month_sin", "month_cos")


def price_composition(df: DataFrame, keys, ts: str, value: str, period: int, lags: int = 5, horizon: int = 2, method: str = "stl",
                      alpha: float = 1.0, betas: Sequence[Sequence[float]] | None = None,
                      trend_params: tuple[float, float] | None = None, **kw) -> DataFrame:
    """(keys, step, ts, residual, trend, seasonal, forecast) of the next ``horizon`` business days.

    The series is decomposed (G1); windows over the seven features predict the residual by direct ridge, Holt
    continues the trend, and the last ``horizon`` values of the smoothed season (E12) are repeated; the parts
    are added (G10).  ``betas`` (per step: intercept, then all features of lag 0, of lag 1, ...) and
    ``trend_params`` (alpha, beta) fix the two models instead of fitting them.  Rows without a complete
    decomposition are left out first, so dates go on from the last complete row.
    """
    from ..session import cut_lineage
    from . import smoothing as sm
    from .decompose import decompose, recompose
    from .indicators import centred_mean_reflect, next_business_days, positions
    keys = require_keys(keys)
    parts = decompose(df.select(*keys, ts, value), keys, ts, value, period, method, **kw).select(*keys, ts, *FEATURES)
    d = cut_lineage(parts.where(F.col("trend").isNotNull() & F.col("seasonal").isNotNull() & F.col("residual").isNotNull()))

    # windows over all features: the residual's lags come from ``windows``, those of the others as extra columns
    others = FEATURES[1:]
    extra = [f"_{c}_{i}" for i in range(lags) for c in others]

    def lagged(x, w):
        return x.withColumns({f"_{c}_{i}": F.lag(c, i).over(w) if i else F.col(c) for i in range(lags) for c in others})

    win = windows(seq.bounded(d, keys, ts, lagged, before=lags - 1, **kw), keys, ts, "residual", lags, horizon, extra, **kw)
    last = win.where(F.col("rn") == F.col("n"))
    if betas is None:
        coef = solve(_moments(win.where(F.col("rn") + horizon <= F.col("n")), keys), keys, 1 + lags * len(FEATURES), horizon, [alpha])
        resid = last.join(coef, keys).select(*keys, "step", (_dot("x", "beta") + F.col("mu")).alias("residual"))
    else:
        order = [0] + [1 + i if f == 0 else 1 + lags + i * len(others) + f - 1 for i in range(lags) for f in range(len(FEATURES))]
        fixed = []
        for b in betas:
            x = [0.0] * (1 + lags * len(FEATURES))
            for at, v in zip(order, b):
                x[at] = float(v)
            fixed.append(x)
        beta = F.array(*[F.array(*[F.lit(v) for v in b]) for b in fixed])
        raw = F.transform("x", lambda v, i: F.when((i >= 1) & (i <= lags), v + F.col("mu")).otherwise(v))
        steps = last.select(*keys, raw.alias("x"), F.posexplode(beta).alias("_p", "beta"))
        resid = steps.select(*keys, (F.col("_p") + 1).alias("step"), _dot("x", "beta").alias("residual"))

    end = positions(d, keys, ts)
    if trend_params is None:
        got = sm.scan_forecasts(end.withColumn("_mark", F.when(F.col("rn_desc") == 1, 0)), keys, ts, "trend", "_mark", 1, horizon)
        trend = got.select(*keys, F.posexplode("f").alias("_p", "trend")).select(*keys, (F.col("_p") + 1).alias("step"), "trend")
    else:
        held = sm.smooth_fixed(d.select(*keys, ts, F.col("trend").alias("_t")), keys, ts, "_t", 1, *trend_params, 0.0)
        at = held.groupBy(*keys).agg(F.max_by(F.struct("level", "trend"), ts).alias("_s"))
        trend = at.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "_s").select(
            *keys, "step", (F.col("_s.level") + F.col("step") * F.col("_s.trend")).alias("trend"))

    smooth = centred_mean_reflect(d.select(*keys, ts, "seasonal"), keys, ts, "seasonal", out="_season", **kw)
    season = smooth.join(end.where(F.col("rn_desc") <= horizon).select(*keys, ts, "rn_desc"), [*keys, ts]).select(
        *keys, (F.lit(horizon + 1) - F.col("rn_desc")).cast("int").alias("step"), F.col("_season").alias("seasonal"))
    dates = next_business_days(d, keys, ts, horizon)
    out = recompose({"residual": resid, "trend": trend, "seasonal": season}, keys)
    return out.join(dates, [*keys, "step"]).select(*keys, "step", ts, "residual", "trend", "seasonal", "forecast")
