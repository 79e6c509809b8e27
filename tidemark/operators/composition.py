"""Price composition in the rolling-origin backtest (G12 in G18).

Every fold decomposes, fits and forecasts from its own training rows, but nothing is copied per fold:

* the centred trend of a row is the same in every fold that has the rows around it, so it is computed once; a fold's
  trend ends half a season before its origin, and the parts are forecast from there;
* a fold's season, the centred phase means, comes from sums and counts by phase that grow with the folds;
* the residual of a fold is the detrended value less that season, so the normal equations of its windows follow from
  sums of products of detrended values, trends and calendar columns **by phase**: within a phase a fold's season is a
  constant.  Those sums too grow with the folds; a row counts for the newest fold's era that may not use it yet.

A series' sums are one row (seasons x squared window columns, whatever its length); that row gives all its folds.
The result equals ``price_composition`` on each fold's rows alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sequence as seq
from .backtest import ForecastConfig, origins, register_scan
from .regress import FEATURES, _moments, ridge

CALENDAR = FEATURES[3:]


def window_map(season: np.ndarray, phase: int, lags: int) -> np.ndarray:
    """Matrix that turns base columns (1, detrended lags, trend lags, calendar lags) at a phase into the features
    (1, then the seven of each lag) under a fold's season."""
    m, each = len(season), len(FEATURES)
    t = np.zeros((1 + each * lags, 1 + (2 + len(CALENDAR)) * lags))
    t[0, 0] = 1.0
    for j in range(lags):
        s, row = season[(phase - j) % m], 1 + each * j
        t[row, 1 + j], t[row, 0] = 1.0, -s
        t[row + 1, 1 + lags + j] = 1.0
        t[row + 2, 0] = s
        for c in range(len(CALENDAR)):
            t[row + 3 + c, 1 + 2 * lags + len(CALENDAR) * j + c] = 1.0
    return t


def smoothed_end(season: np.ndarray, phase: int, steps: int, size: int = 7) -> np.ndarray:
    """Last ``steps`` values of the season smoothed by a centred mean with mirrored ends (E12), ending at ``phase``."""
    back = np.arange(-size // 2 + 1, size // 2 + 1)[None, :] + np.arange(steps - 1, -1, -1)[:, None]  # rows before the end
    back = np.where(back < 0, -back - 1, back)
    return season[(phase - back) % len(season)].mean(axis=1)


def fold_composition(pos: DataFrame, keys: list[str], value: str, cfg: ForecastConfig, alpha: float = 1.0,
                     betas: Sequence[Sequence[float]] | None = None, trend_params: tuple[float, float] | None = None,
                     block_rows: int = seq.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(keys, fold, step, o, ots, yo, residual, trend, seasonal, yhat) for every fold; ``betas`` and
    ``trend_params`` as in ``price_composition``."""
    from . import smoothing as sm
    from .decompose import moving_trend
    from .indicators import calendar_encoding
    m, lags, h, folds = cfg.seasonal_periods, cfg.n_lags, cfg.n_forecasts, cfg.n_folds
    gap = m // 2
    n = F.col("rn") + F.col("rn_desc") - 1
    rows = pos.select(*keys, "ts", F.col("rn").alias(seq.RN), F.col("rn").cast("long").alias("rn"), n.cast("long").alias("n"), F.col(value).cast("double").alias("_y"))
    rows = seq.bounded(rows, keys, "ts", moving_trend("_y", m), before=gap, after=gap, block_rows=block_rows, keep_rn=True)
    rows = rows.withColumn("_d", F.col("_y") - F.col("trend")).where(F.col("_d").isNotNull())
    rows = calendar_encoding(rows, "ts").withColumn("_phase", ((F.col("rn") - 1) % m).cast("int"))

    def era(ahead: int):
        """Oldest fold whose training rows hold a row and the ``ahead`` rows after it."""
        return F.least(F.floor((F.col("n") - F.col("rn") - ahead) / h) - 1, F.lit(folds - 1)).cast("int")

    def lagged(d, w):
        at = lambda c, j: F.lag(c, j).over(w) if j else F.col(c)
        z = [F.lit(1.0), *[at("_d", j) for j in range(lags)], *[at("trend", j) for j in range(lags)], *[at(c, j) for j in range(lags) for c in CALENDAR]]
        return d.withColumns({"x": F.array(*z), "y": F.array(*[F.lead("_d", gap + k).over(w) for k in range(1, h + 1)])})

    wide = seq.bounded(rows, keys, "ts", lagged, before=lags - 1, after=gap + h, block_rows=block_rows, keep_rn=True)
    sums = _moments(wide.where(F.col("rn") + 2 * gap + h <= F.col("n")).withColumn("_era", era(2 * gap + h)), [*keys, "_era", "_phase"])
    season = rows.groupBy(*keys, era(gap).alias("_era"), "_phase").agg(F.sum("_d").alias("_s"), F.count("_d").cast("double").alias("_c"))
    season = season.select(*keys, "_era", "_phase", F.explode(F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("j"), F.col("_s").alias("v")),
                                                                   F.struct(F.lit(-1).alias("i"), F.lit(1).alias("j"), F.col("_c").alias("v")))).alias("e")).select(*keys, "_era", "_phase", "e.*")
    both = sums.unionByName(season).groupBy(*keys).agg(F.collect_list(F.struct("_era", "_phase", "i", "j", "v")).alias("_e"))
    fields = ("_era", "_phase", "i", "j", "v")
    both = both.select(*keys, *[F.col(f"_e.{f}").alias(f"_e{f}") for f in fields])

    back = F.col("n") - F.col("rn") - gap
    fold = F.when((back % h == 0) & (back >= 0) & (back <= folds * h), F.floor(back / h) - 1).cast("int")
    at = wide.withColumn("fold", fold).where(F.col("fold").isNotNull()).groupBy(*keys).agg(F.collect_list(F.struct("fold", "_phase", "x")).alias("_o"))
    at = at.select(*keys, *[F.col(f"_o.{f}").alias(f"_o{f}") for f in ("fold", "_phase", "x")])
    types = ", ".join(f"`{k}` {pos.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "fold", "step", "residual", "seasonal"]
    fixed = None if betas is None else np.array([[*b, *[0.0] * (1 + len(FEATURES) * lags - len(b))] for b in betas]).T

    def run(batches):
        for pdf in batches:  # one row a series
            out = []
            for *key, era_, phase, i, j, v, o_fold, o_phase, o_x in pdf.itertuples(index=False, name=None):
                era_, phase, i, j, v = np.asarray(era_), np.asarray(phase), np.asarray(i), np.asarray(j), np.asarray(v, dtype=float)
                p = 1 + (2 + len(CALENDAR)) * lags
                z, total = np.zeros((m, p, p + h)), np.zeros((m, 2))
                origin = {f: (ph, np.asarray(x, dtype=float)) for f, ph, x in zip(o_fold, o_phase, o_x)}
                for f in range(folds - 1, -2, -1):
                    now = era_ == f
                    mean = now & (i < 0)
                    np.add.at(total, (phase[mean], j[mean]), v[mean])
                    cell = now & (i >= 0)
                    np.add.at(z, (phase[cell], i[cell], j[cell]), v[cell])
                    if f not in origin:
                        continue
                    with np.errstate(invalid="ignore"):
                        s = total[:, 0] / total[:, 1]
                    s = s - s.mean()
                    ph, x = origin[f]
                    if fixed is None:
                        xtx, xty = 0.0, 0.0
                        for k in range(m):
                            zz = np.triu(z[k, :, :p]) + np.triu(z[k, :, :p], 1).T
                            t = window_map(s, k, lags)
                            xtx = xtx + t @ zz @ t.T
                            xty = xty + t @ z[k, :, p:] - np.outer(t @ zz[0], s[(k + gap + 1 + np.arange(h)) % m])
                        beta = ridge(xtx, xty, alpha) if np.isfinite(xtx).all() else np.full((1 + len(FEATURES) * lags, h), np.nan)
                    else:
                        beta = fixed
                    resid, smooth = (window_map(s, ph, lags) @ x) @ beta, smoothed_end(s, ph, h)
                    out += [(*key, f, k + 1, float(resid[k]), float(smooth[k])) for k in range(h)]
            yield pd.DataFrame(out, columns=names)

    parts = both.join(at, keys).mapInPandas(run, f"{types}, fold int, step int, residual double, seasonal double")
    if trend_params is None:
        got = sm.scan_forecasts(rows.withColumn("_mark", fold), keys, "rn", "trend", "_mark", 1, gap + h)
        trend = got.select(*keys, F.col("mark").alias("fold"), F.posexplode(F.slice("f", gap + 1, h)).alias("_p", "trend"))
    else:
        held = sm.smooth_fixed(rows.select(*keys, "ts", fold.alias("fold"), F.col("trend").alias("_t")), keys, "ts", "_t", 1, *trend_params, 0.0, block_rows=min(block_rows, sm.default_block(1)))
        ahead = F.transform(F.sequence(F.lit(1), F.lit(h)), lambda k: F.col("level") + (gap + k) * F.col("trend"))
        trend = held.where(F.col("fold").isNotNull()).select(*keys, "fold", F.posexplode(ahead).alias("_p", "trend"))
    trend = trend.withColumn("step", F.col("_p") + 1).drop("_p")
    out = parts.join(trend, [*keys, "fold", "step"]).join(origins(pos, keys, value, cfg), [*keys, "fold"])
    return out.withColumn("yhat", F.col("residual") + F.col("trend") + F.col("seasonal"))


def rows_needed(cfg: ForecastConfig) -> int:
    """Rows that leave the oldest fold two seasons and more windows than features."""
    return cfg.n_folds * cfg.n_forecasts + 2 * (cfg.seasonal_periods // 2) + max(2 * cfg.seasonal_periods, 0) + cfg.n_forecasts + 8 * cfg.n_lags + 2


@register_scan("price_composition", rows_needed)
def _price_composition(pos: DataFrame, keys: list[str], value: str, cfg: ForecastConfig) -> DataFrame:
    """Classical decomposition, ridge on windows over the seven features, Holt trend by grid search, smoothed season."""
    return fold_composition(pos, keys, value, cfg)
