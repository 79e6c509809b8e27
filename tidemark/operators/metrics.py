"""Forecast error metrics and comparison tables.

All metrics are grouped aggregates per (keys, model); the ordered ones
(directional accuracy) take their previous values from halo-block windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import as_list, require_keys
from . import sequence as seq


def error_metrics(df: DataFrame, group: Sequence[str], actual: str, pred: str) -> DataFrame:
    """F1 MAE, F2 RMSE, F3 R^2 (NULL when the actuals are constant), per group."""
    a, p = F.col(actual), F.col(pred)
    e = a - p
    sse = F.sum(e * e)
    sst = F.var_pop(a) * F.count(a)
    return df.groupBy(*as_list(group)).agg(
        F.avg(F.abs(e)).alias("MAE"),
        F.sqrt(F.avg(e * e)).alias("RMSE"),
        (F.lit(1.0) - F.try_divide(sse, F.when(sst > 0, sst))).alias("R2"),
        F.count(F.lit(1)).alias("n"),
    )


def _same_sign(x: Column, y: Column) -> Column:
    return F.coalesce(F.signum(x) == F.signum(y), F.lit(False)).cast("double")


def anchored_directional_accuracy(df: DataFrame, group, ts: str, actual: str, pred: str,
                                  horizon: int, tiebreak=(), **kw) -> DataFrame:
    """blocks of ``horizon`` steps after an anchor row.

    Row idx (0-based, ts order) >= 1 belongs to block (idx-1) div h at step
    (idx-1) mod h.  Step 0 compares pred - previous actual with actual -
    previous actual; later steps compare pred - previous pred with actual -
    previous actual.  Only complete blocks (start <= len - h) count; sign 0
    equals sign 0; no points -> NULL.
    """
    group = require_keys(group)
    h = int(horizon)
    sizes = seq.series_sizes(df, group, "_len")

    def compute(d, w):
        from pyspark.sql import functions as G
        pa, pp = G.lag(actual, 1).over(w), G.lag(pred, 1).over(w)
        return d.withColumn("_pa", pa).withColumn("_pp", pp)

    d = seq.bounded(df, group, ts, compute, before=1, keep_rn=True, tiebreak=tiebreak, **kw).join(sizes, group)
    idx = F.col(seq.RN) - 1
    s = (idx - 1) % h
    start = idx - s
    ref = F.when(s == 0, F.col("_pa")).otherwise(F.col("_pp"))
    ok = (idx >= 1) & (start <= F.col("_len") - h)
    hit = _same_sign(F.col(pred) - ref, F.col(actual) - F.col("_pa"))
    return d.where(ok).groupBy(*group).agg(F.avg(hit).alias("directional_accuracy")) \
        .join(sizes.select(*group), group, "right")


def diff_directional_accuracy(df: DataFrame, group, ts: str, actual: str, pred: str, tiebreak=(),
                              **kw) -> DataFrame:
    """share of equal signs of successive differences; NULL with < 2 points."""
    group = require_keys(group)
    d = seq.bounded(df, group, ts, lambda x, w: x.withColumn("_da", F.col(actual) - F.lag(actual, 1).over(w))
                    .withColumn("_dp", F.col(pred) - F.lag(pred, 1).over(w)), before=1, tiebreak=tiebreak, **kw)
    return d.groupBy(*group).agg(F.avg(F.when(F.col("_da").isNotNull(), _same_sign(F.col("_da"), F.col("_dp"))))
                                 .alias("diff_directional_accuracy"))


def sign_accuracy(df: DataFrame, group, actual: str, pred: str) -> DataFrame:
    """share of equal signs of actual and predicted returns."""
    return df.groupBy(*as_list(group)).agg(F.avg(_same_sign(F.col(actual), F.col(pred))).alias("sign_accuracy"))


def directional_loss(df: DataFrame, group, step: str, actual: str, pred: str) -> DataFrame:
    """F7 (as a metric): 1 - share of equal step signs inside each window; horizon < 2 -> 0.

    ``df`` is long: one row per (window, step); ``group`` identifies the window
    set to score (e.g. model), windows by ``window`` column inside it.
    """
    group = as_list(group)
    from pyspark.sql import Window
    w = Window.partitionBy(*group, "window").orderBy(step)  # window = one horizon (bounded)
    d = df.withColumn("_da", F.col(actual) - F.lag(actual, 1).over(w)) \
          .withColumn("_dp", F.col(pred) - F.lag(pred, 1).over(w))
    return d.groupBy(*group).agg(F.coalesce(F.lit(1.0) - F.avg(F.when(F.col("_da").isNotNull(),
                                                                     _same_sign(F.col("_da"), F.col("_dp")))),
                                            F.lit(0.0)).alias("directional_loss"))


def combined_loss(df: DataFrame, group, step: str, actual: str, pred: str,
                  alpha: float = 1.0, beta: float = 0.1, delta: float = 1.0) -> DataFrame:
    """F8: alpha * Huber(delta) + beta * F7."""
    group = as_list(group)
    e = F.abs(F.col(actual) - F.col(pred))
    hub = df.groupBy(*group).agg(F.avg(F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta)))
                                 .alias("huber"))
    dl = directional_loss(df, group, step, actual, pred)
    return hub.join(dl, group).withColumn("loss", alpha * F.col("huber") + beta * F.col("directional_loss"))


def _ordered_sum(arr: str) -> Column:
    return F.aggregate(F.col(arr), F.lit(0.0), lambda acc, v: acc + v)


def model_comparison(final: DataFrame, keys, ts: str, actual: str, preds: dict[str, str], n_tests: int,
                     horizon: int, tiebreak=(), **kw) -> DataFrame:
    """one row per (keys, model): MAE and RMSE over the last ``n_tests`` joined
    rows, directional accuracy (F4) over all joined rows (anchor included)."""
    keys = require_keys(keys)
    tb = list(tiebreak)
    longs = [final.select(*keys, ts, *tb, F.col(actual).alias("_a"), F.col(c).alias("_p"), F.lit(m).alias("Model"))
             for m, c in preds.items()]
    long = longs[0]
    for x in longs[1:]:
        long = long.unionByName(x)
    g = [*keys, "Model"]
    pos = seq.index_rows(long, g, ts, tiebreak=tb)
    sizes = seq.series_sizes(long, g, "_len")
    tail = pos.join(sizes, g).where(F.col(seq.RN) > F.col("_len") - n_tests)
    # the tail holds at most n_tests rows per group, so the errors can be summed in
    # a fixed (sorted) order: results do not depend on how partial sums are merged
    e = F.abs(F.col("_a") - F.col("_p"))
    err = tail.groupBy(*g).agg(F.array_sort(F.collect_list(e)).alias("_e"),
                               F.array_sort(F.collect_list(e * e)).alias("_e2"))
    err = err.select(*g, (_ordered_sum("_e") / F.size("_e")).alias("MAE"),
                     F.sqrt(_ordered_sum("_e2") / F.size("_e2")).alias("RMSE"))
    da = anchored_directional_accuracy(long, g, ts, "_a", "_p", horizon, tiebreak=tb, **kw)
    return err.join(da, g).withColumnRenamed("directional_accuracy", "Directional Accuracy")


def comparison_table(df: DataFrame, ts: str, actual: str, pred: str, keys=(),
                     names: tuple[str, str, str] = ("Date", "Actual", "Predicted")) -> DataFrame:
    """F16: actual-vs-predicted (or predicted-change) table with fixed column names."""
    d, a, p = names
    return df.select(*as_list(keys), F.col(ts).alias(d), F.col(actual).alias(a), F.col(pred).alias(p))
