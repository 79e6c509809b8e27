"""Feature selection, autocorrelation and scalers.

Correlations for all candidate columns come from one aggregate pass; the
per-series ranking runs over that small (series x feature) table.  Scaler
statistics are per-series aggregates joined back (broadcast by AQE when small).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import as_list, require_keys
from . import sequence as seq

# Name fragments excluded from feature selection (case-insensitive).
EXCLUDE_KEYWORDS = ("trend", "seasonal", "residual", "dow_sin", "dow_cos", "month_sin", "month_cos")
NUMERIC = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.ShortType, T.DecimalType)


def candidate_features(df: DataFrame, target: str, keys: Sequence[str] = (),
                       exclude: Sequence[str] = EXCLUDE_KEYWORDS) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name != target and f.name not in keys
            and not any(k in f.name.lower() for k in exclude)]


def correlations(df: DataFrame, keys, target: str, features: Sequence[str] | None = None) -> DataFrame:
    """(keys, feature, corr): Pearson correlation with pairwise-complete rows.

    Constant columns give NULL (not an ANSI divide-by-zero error).
    """
    keys = require_keys(keys)
    feats = list(features) if features is not None else candidate_features(df, target, keys)
    t = F.col(target)
    aggs = []
    for i, c in enumerate(feats):
        x = F.col(f"`{c}`")
        both = x.isNotNull() & t.isNotNull()
        sx = F.stddev_samp(F.when(both, x))
        sy = F.stddev_samp(F.when(both, t))
        aggs.append(F.try_divide(F.covar_samp(x, t), F.when((sx * sy) != 0, sx * sy)).alias(f"c{i}"))
    wide = df.groupBy(*keys).agg(*aggs)
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("corr"))
                                  for i, c in enumerate(feats)]))
    return wide.select(*keys, stacked.alias("_s")).select(*keys, "_s.*")


def top_correlated(df: DataFrame, keys, target: str, k: int = 10, features=None) -> DataFrame:
    """the ``k`` features with largest |corr| per series (NULLs last, name breaks ties)."""
    keys = require_keys(keys)
    c = correlations(df, keys, target, features)
    w = Window.partitionBy(*keys).orderBy(F.abs("corr").desc_nulls_last(), F.col("feature"))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def select_top_correlated(df: DataFrame, target: str, k: int = 10, keys=("_all",)) -> DataFrame:
    """F9 as in the source: ``df[[target] + top_k]`` (one small collect of k names)."""
    d = df.withColumn("_all", F.lit(1)) if list(keys) == ["_all"] else df
    names = [r.feature for r in top_correlated(d, list(keys), target, k).orderBy("rank").collect()]
    return df.select(target, *names)


def seasonality_strength(decomposed: DataFrame, keys, resid: str = "residual", seasonal: str = "seasonal") -> DataFrame:
    """1 - var(resid) / (var(resid) + var(seasonal)), sample variances, per series."""
    keys = require_keys(keys)
    vr, vs = F.var_samp(resid), F.var_samp(seasonal)
    return decomposed.groupBy(*keys).agg((F.lit(1.0) - F.try_divide(vr, vr + vs)).alias("seasonality_strength"))


def acf(df: DataFrame, keys, ts: str, col: str, max_lag: int = 60, **kw) -> DataFrame:
    """autocorrelation of ``col`` for lags 1..max_lag per series (statsmodels ``acf``,
    unadjusted): sum_t (x_t - m)(x_{t-k} - m) / sum_t (x_t - m)^2."""
    keys = require_keys(keys)
    mean = df.groupBy(*keys).agg(F.avg(col).alias("_m"))
    d = df.join(mean, keys).withColumn("_dx", F.col(col) - F.col("_m"))
    lags = list(range(1, max_lag + 1))
    d = seq.bounded(d, keys, ts, lambda x, w: x.withColumns(
        {f"_l{k}": F.lag("_dx", k).over(w) for k in lags}), before=max_lag, **kw)
    sums = d.groupBy(*keys).agg(F.sum(F.col("_dx") * F.col("_dx")).alias("_den"),
                                *[F.sum(F.col("_dx") * F.col(f"_l{k}")).alias(f"_n{k}") for k in lags])
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_n{k}").alias("_num")) for k in lags]))
    return sums.select(*keys, "_den", stacked.alias("_s")).select(
        *keys, "_s.lag", F.try_divide(F.col("_s._num"), F.col("_den")).alias("acf"))


def fit_scaler(df: DataFrame, keys, ts: str, cols, kind: str = "standard", train_rows: DataFrame | None = None,
               holdout: int = 0, **kw) -> DataFrame:
    """Per-series scaler statistics fitted on a training prefix.

    The prefix is every row except the last ``holdout`` rows of each series
    (source: ``len - L - H``).  Standard: mean and population std (std 0 -> 1);
    min-max: min and range (range 0 -> 1).
    """
    keys = require_keys(keys)
    if kind not in ("standard", "minmax"):
        raise ValueError(f"Unknown scaler '{kind}': use 'standard' or 'minmax'")
    cols = as_list(cols)
    d = df
    if holdout > 0:
        from .indicators import positions
        d = positions(df, keys, ts, **kw).where(F.col("rn_desc") > holdout)
    aggs = []
    for c in cols:
        if kind == "standard":
            sd = F.stddev_pop(c)
            aggs += [F.avg(c).alias(f"{c}__center"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"{c}__scale")]
        else:
            rng = F.max(c) - F.min(c)
            aggs += [F.min(c).alias(f"{c}__center"), F.when(rng == 0, F.lit(1.0)).otherwise(rng).alias(f"{c}__scale")]
    return d.groupBy(*keys).agg(*aggs)


def transform(df: DataFrame, stats: DataFrame, keys, cols, inverse: bool = False) -> DataFrame:
    """scale (or inverse-scale) columns with fitted per-series statistics."""
    keys = require_keys(keys)
    cols = as_list(cols)
    d = df.join(stats, keys)
    if inverse:
        new = {c: F.col(c) * F.col(f"{c}__scale") + F.col(f"{c}__center") for c in cols}
    else:
        new = {c: (F.col(c) - F.col(f"{c}__center")) / F.col(f"{c}__scale") for c in cols}
    return d.withColumns(new).drop(*[f"{c}__center" for c in cols], *[f"{c}__scale" for c in cols])
