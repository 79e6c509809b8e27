"""Registered backtest and metric queries (G16-G18, G21, G23, F1-F8, F15) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import metrics as mt
from ..sources import testdata as td
from .registry import register

KEYS = ["series_id"]
CFG = bt.ForecastConfig(n_tests=20, n_forecasts=2, seasonal_periods=261, n_lags=5, epochs=50)
NT, H = CFG.n_tests, CFG.n_forecasts


def _artifacts(spark, sf, model="drift", baseline="naive"):
    return bt.run_backtest(td.daily(spark, sf), KEYS, "ts", "value", CFG, model=model, baseline=baseline,
                           block_rows=256)


def bt_ctes(NT: int, H: int) -> str:
    n_folds = NT // H
    return f"""pos AS (SELECT series_id, ts, value,
    row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn,
    row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rd FROM daily),
fst AS (SELECT series_id, value AS y1 FROM pos WHERE rn = 1),
orig AS (SELECT p.series_id, p.ts AS ots, p.value AS yo, p.rn AS o, (p.rd - 1) // {H} - 1 AS fold, f.y1
         FROM pos p JOIN fst f USING (series_id) WHERE (p.rd - 1) % {H} = 0 AND p.rd <= {n_folds * H} + 1),
steps AS (SELECT *, unnest(range(1, {H} + 1)) AS step FROM orig),
anchor AS (SELECT series_id, ts, value AS yhat, 0 AS model_fold FROM pos WHERE rd = {NT} + 1),
base AS (SELECT s.series_id, p.ts, s.yo AS yhat FROM steps s JOIN pos p ON p.series_id = s.series_id AND p.rn = s.o + s.step
         WHERE s.fold >= 0 UNION ALL SELECT series_id, ts, yhat FROM anchor),
own AS (SELECT series_id, fold, d, row_number() OVER (PARTITION BY series_id, fold ORDER BY d) AS step FROM (
          SELECT series_id, fold, CAST(unnest(generate_series(ots + INTERVAL 1 DAY, ots + INTERVAL {2 * H + 3} DAY,
                 INTERVAL 1 DAY)) AS DATE) AS d FROM orig) x WHERE isodow(d) <= 5),
mall AS (SELECT s.series_id, s.fold, s.step, od.d AS ts, s.yo + s.step * (s.yo - s.y1) / NULLIF(s.o - 1, 0) AS yhat
         FROM steps s JOIN own od ON od.series_id = s.series_id AND od.fold = s.fold AND od.step = s.step),
model AS (SELECT series_id, ts, yhat, fold + 1 AS model_fold FROM mall WHERE fold >= 0 UNION ALL SELECT * FROM anchor),
actual AS (SELECT series_id, ts, value AS actual FROM pos WHERE rd <= {NT} + 1),
final AS (SELECT a.series_id, a.ts, a.actual, b.yhat AS baseline, m.yhat AS predicted, m.model_fold
          FROM actual a JOIN base b USING (series_id, ts) JOIN model m USING (series_id, ts))"""


_BT_CTES = bt_ctes(NT, H)


def _bt_sql(tail: str, ctes: str = _BT_CTES) -> str:
    return td.with_views(ctes + ",\n" + tail, "daily").replace(
        "GROUP BY 1, 2)\npos AS", "GROUP BY 1, 2),\npos AS", 1)


@register("g18_backtest_native", "series_id:s ts:t actual:d baseline:d predicted:d model_fold:i",
          _bt_sql(f"""x AS (SELECT 1) SELECT * FROM final
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, model_fold DESC) <= {NT}"""))
def q_backtest(spark, sf):
    """G18 rolling-origin backtest (naive baseline on true dates, drift model on own business dates)."""
    return _artifacts(spark, sf).final


# the same over every business day from the first to the last, gaps carried forward: all n_tests + 1 rows join
DENSE_SQL = """(WITH d0 AS ({daily}), s AS (SELECT series_id, min(ts) AS a, max(ts) AS b FROM d0 GROUP BY 1),
  days AS (SELECT series_id, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ts FROM s)
  SELECT series_id, ts, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts),
    first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
  FROM days LEFT JOIN d0 USING (series_id, ts) WHERE isodow(ts) <= 5)"""


def dense_sql(ctes_and_tail: str) -> str:
    """SQL over the dense business-day series under the name ``daily``."""
    return "WITH daily AS " + DENSE_SQL.format(daily=td.VIEW_SQL["daily"]) + ",\n" + ctes_and_tail


def dense_daily(spark, sf):
    from ..operators import impute as im
    return im.ffill_bfill(im.densify_business_days(td.daily(spark, sf), KEYS, "ts"), KEYS, "ts", ["value"])


@register("g18_backtest_dense", "series_id:s ts:t actual:d baseline:d predicted:d model_fold:i",
          dense_sql(_BT_CTES + f""" SELECT * FROM final
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, model_fold DESC) <= {NT}"""))
def q_backtest_dense(spark, sf):
    """G18 on gap-free series: exactly n_tests rows a series."""
    return bt.run_backtest(dense_daily(spark, sf), KEYS, "ts", "value", CFG, block_rows=256).final


@register("u4_run_all_learned", "run_model:s series_id:s Model:s MAE:d RMSE:d Directional Accuracy:d")
def q_learned(spark, sf):
    """The learned models (ridge, change, lag-trend-season) backtested against Holt-Winters."""
    art = bt.run_all(dense_daily(spark, sf), KEYS, "ts", "value", ["ridge", "change_ridge", "ar_trend"], CFG,
                     baseline="holt_winters", block_rows=256)
    return art.metrics.select("run_model", "series_id", "Model", "MAE", "RMSE", "Directional Accuracy")


@register("g18_forecast", "series_id:s step:i ts:t Future Predictions:d",
          _bt_sql("x AS (SELECT 1) SELECT series_id, step, ts, yhat AS \"Future Predictions\" FROM mall WHERE fold = -1"))
def q_forecast(spark, sf):
    """G18 final forecast of the model from all rows, on its own business dates."""
    art = bt.run_backtest(td.daily(spark, sf), KEYS, "ts", "value", CFG, materialize=False, block_rows=256)  # only this table is read
    return art.forecast


def da_sql(NT: int, H: int) -> str:
    return f"""da AS (
  SELECT series_id, "Model", avg(CASE WHEN coalesce(sign(p - ref) = sign(a - pa), false) THEN 1.0 ELSE 0.0 END)
           AS "Directional Accuracy"
  FROM (SELECT *, CASE WHEN (idx - 1) % {H} = 0 THEN pa ELSE pp END AS ref, idx - ((idx - 1) % {H}) AS st FROM (
          SELECT series_id, "Model", a, p, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY series_id, "Model") AS len,
                 lag(a) OVER w AS pa, lag(p) OVER w AS pp
          FROM lng WINDOW w AS (PARTITION BY series_id, "Model" ORDER BY ts, model_fold)) y) z
  WHERE idx >= 1 AND st <= len - {H} GROUP BY 1, 2),
err AS (SELECT series_id, "Model",
          list_reduce(list_sort(list(abs(a - p))), lambda x, y: x + y) / count(*) AS "MAE",
          sqrt(list_reduce(list_sort(list(abs(a - p) * abs(a - p))), lambda x, y: x + y) / count(*)) AS "RMSE" FROM (
          SELECT *, row_number() OVER (PARTITION BY series_id, "Model" ORDER BY ts DESC, model_fold DESC) AS r FROM lng) t
        WHERE r <= {NT} GROUP BY 1, 2)"""


_DA_SQL = da_sql(NT, H)


def comparison_sql(nt: int, h: int) -> str:
    return _bt_sql(_LNG + ",\n" + da_sql(nt, h) + "\nSELECT * FROM err LEFT JOIN da USING (series_id, \"Model\")",
                   bt_ctes(nt, h))

_LNG = """lng AS (SELECT series_id, ts, model_fold, actual AS a, baseline AS p, 'naive' AS "Model" FROM final
        UNION ALL SELECT series_id, ts, model_fold, actual, predicted, 'drift' FROM final)"""


@register("f15_model_comparison", "series_id:s Model:s MAE:d RMSE:d Directional Accuracy:d",
          _bt_sql(_LNG + ",\n" + _DA_SQL + "\nSELECT * FROM err LEFT JOIN da USING (series_id, \"Model\")"))
def q_comparison(spark, sf):
    """F15 per model: MAE/RMSE over the last n_tests joined rows, F4 anchored directional accuracy."""
    return _artifacts(spark, sf).metrics


@register("f1_f3_f5_f6_error_metrics", "series_id:s MAE:d RMSE:d R2:d n:i diff_directional_accuracy:d sign_accuracy:d",
          _bt_sql("""m AS (SELECT series_id, avg(abs(actual - predicted)) AS "MAE",
      sqrt(avg((actual - predicted) * (actual - predicted))) AS "RMSE",
      1.0 - sum((actual - predicted) * (actual - predicted)) / NULLIF(var_pop(actual) * count(actual), 0) AS "R2",
      count(*) AS n,
      avg(CASE WHEN coalesce(sign(actual - level) = sign(predicted - level), false) THEN 1.0 ELSE 0.0 END)
        AS sign_accuracy FROM (SELECT *, median(actual) OVER (PARTITION BY series_id) AS level FROM final) f GROUP BY 1),
d AS (SELECT series_id, avg(CASE WHEN da IS NULL THEN NULL WHEN coalesce(sign(da) = sign(dp), false) THEN 1.0 ELSE 0.0 END)
        AS diff_directional_accuracy FROM (
      SELECT series_id, actual - lag(actual) OVER w AS da, predicted - lag(predicted) OVER w AS dp
      FROM final WINDOW w AS (PARTITION BY series_id ORDER BY ts, model_fold)) q GROUP BY 1)
SELECT * FROM m JOIN d USING (series_id)"""))
def q_errors(spark, sf):
    """F1 MAE, F2 RMSE, F3 R^2, F5 difference-sign accuracy, F6 sign accuracy (vs the series' median)."""
    fin = _artifacts(spark, sf).final
    e = mt.error_metrics(fin, KEYS, "actual", "predicted")
    d = mt.diff_directional_accuracy(fin, KEYS, "ts", "actual", "predicted", tiebreak=["model_fold"], block_rows=256)
    level = fin.join(fin.groupBy(*KEYS).agg(F.median("actual").alias("_level")), KEYS)  # n_tests rows a series
    s = mt.sign_accuracy(level.withColumn("a", F.col("actual") - F.col("_level")).withColumn("p", F.col("predicted") - F.col("_level")),
                         KEYS, "a", "p")
    return e.join(d, KEYS).join(s, KEYS)


_WIN_SQL = td.with_views("""w AS (SELECT series_id, ts AS origin, k AS step, v, p FROM (
    SELECT series_id, ts, value AS v0, lead(value, 1) OVER w AS v1, lead(value, 2) OVER w AS v2,
           lead(value, 3) OVER w AS v3, lag(value, 1) OVER w AS p0,
           count(*) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n
    FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY ts)) a,
  LATERAL (SELECT unnest([1, 2, 3]) AS k, unnest([v1, v2, v3]) AS v, unnest([v0, v0, v0]) AS p) u
  WHERE n = 4)
SELECT series_id, avg(CASE WHEN abs(v - p) / 1e5 <= 1 THEN 0.5 * ((v - p) / 1e5) * ((v - p) / 1e5)
                      ELSE abs(v - p) / 1e5 - 0.5 END) AS huber,
  coalesce(1.0 - avg(CASE WHEN dv IS NULL THEN NULL WHEN coalesce(sign(dv) = sign(dp), false) THEN 1.0 ELSE 0.0 END), 0.0)
    AS directional_loss
FROM (SELECT *, v - lag(v) OVER x AS dv, p - lag(p) OVER x AS dp FROM w
      WINDOW x AS (PARTITION BY series_id, origin ORDER BY step)) z GROUP BY 1""", "daily").replace(
    "GROUP BY 1, 2)\nw AS", "GROUP BY 1, 2),\nw AS", 1)


@register("f7_f8_window_losses", "series_id:s huber:d directional_loss:d loss:d",
          "SELECT *, huber + 0.1 * directional_loss AS loss FROM (" + _WIN_SQL + ") q")
def q_losses(spark, sf):
    """F7 directional loss and F8 Huber + 0.1 x directional loss of a naive 3-step window forecast
    (values in units of 1e5)."""
    from ..operators import indicators as ind
    w = ind.sliding_windows(td.daily(spark, sf), KEYS, "ts", "value", 1, 3, block_rows=256)
    long = w.select("series_id", F.col("origin").alias("window"), F.col("x")[0].alias("p"),
                    F.posexplode("y").alias("pos", "v"))
    long = long.select("series_id", "window", (F.col("pos") + 1).alias("step"),
                       (F.col("v") / 1e5).alias("v"), (F.col("p") / 1e5).alias("p"))
    return mt.combined_loss(long, KEYS, "step", "v", "p").select("series_id", "huber", "directional_loss", "loss")


@register("g25_test_predict", "series_id:s Model:s MAE:d RMSE:d Directional Accuracy:d", comparison_sql(10, 5))
def q_short_cut(spark, sf):
    """G25 short-cut: the metrics of a ten-row backtest with a horizon of five."""
    from . import jobs
    return jobs.test_predict(td.daily(spark, sf), KEYS, "ts", "value", n_tests=10, n_forecasts=5, block_rows=256)[1]


@register("f16_comparison_table", "series_id:s Date:t Actual:d Predicted:d", _bt_sql(f"""x AS (SELECT 1) SELECT series_id, ts AS "Date", actual AS "Actual",
  predicted AS "Predicted" FROM final QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, model_fold DESC) <= {NT}"""))
def q_table(spark, sf):
    """F16 actual against predicted with fixed names."""
    return mt.comparison_table(_artifacts(spark, sf).final, "ts", "actual", "predicted", KEYS)
