"""Registered feature, decomposition and smoothing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import decompose as dc
from ..operators import features as fe
from ..operators import indicators as ind
from ..operators import smoothing as sm  # noqa: F401  (registers holt / holt_winters)
from ..sources import testdata as td
from .q_windows import _E8_COLS, _E8_SQL
from .registry import register

KEYS = ["series_id"]

# F9 ------------------------------------------------------------------------------
_CORR_SQL = "SELECT series_id, feature, corr FROM (SELECT series_id, " + ", ".join(
    f"covar_samp({c}, value) / NULLIF(stddev_samp({c}) * stddev_samp(value), 0) AS \"{c}\"" for c in _E8_COLS
) + " FROM (" + _E8_SQL + ") e GROUP BY 1) w UNPIVOT (corr FOR feature IN (" + ", ".join(
    f'"{c}"' for c in _E8_COLS) + "))"


@register("f9_top_correlated", "series_id:s feature:s corr:d rank:i",
          f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(corr) DESC NULLS LAST, feature)
  AS rank FROM ({_CORR_SQL}) c) r WHERE rank <= 10""")
def q_top_corr(spark, sf):
    """F9 top-10 features by |correlation| with the value, per series, over the E8 bundle."""
    feats = ind.feature_bundle(td.daily(spark, sf), KEYS, "ts", ["value"], block_rows=256)
    return fe.top_correlated(feats, KEYS, "value", 10)


# F11 -----------------------------------------------------------------------------
@register("f11_acf", "series_id:s lag:i acf:d",
          td.with_views("""SELECT a.series_id, k AS lag, sum(a.dx * b.dx) / max(den) AS acf FROM
  (SELECT series_id, rn, dx, sum(dx * dx) OVER (PARTITION BY series_id) AS den FROM (
     SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn,
            value - avg(value) OVER (PARTITION BY series_id) AS dx FROM daily) x) a,
  (SELECT unnest(range(1, 61)) AS k) ks,
  (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn,
          value - avg(value) OVER (PARTITION BY series_id) AS dx FROM daily) b
WHERE a.series_id = b.series_id AND b.rn = a.rn - k GROUP BY 1, 2""", "daily"))
def q_acf(spark, sf):
    """F11 autocorrelation of the daily value for lags 1..60 per series."""
    return fe.acf(td.daily(spark, sf), KEYS, "ts", "value", 60, block_rows=256)


# F12 / F13 / F14 -----------------------------------------------------------------
@register("f12_f14_scalers", "series_id:s ts:t z:d mm:d back:d",
          td.with_views("""SELECT d.series_id, d.ts, (d.value - s.mu) / s.sd AS z, (d.value - s.lo) / s.rng AS mm,
  ((d.value - s.mu) / s.sd) * s.sd + s.mu AS back
FROM daily d JOIN (
  SELECT series_id, avg(value) AS mu, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS sd,
         min(value) AS lo, CASE WHEN max(value) = min(value) THEN 1.0 ELSE max(value) - min(value) END AS rng
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rd FROM daily) t
  WHERE rd > 65 GROUP BY 1) s USING (series_id)""", "daily"))
def q_scalers(spark, sf):
    """F12 standard and F14 min-max scalers fitted on all but the last L+H=65 rows; F13 inverse."""
    d = td.daily(spark, sf)
    st = fe.fit_scaler(d, KEYS, "ts", ["value"], "standard", holdout=65)
    mm = fe.fit_scaler(d, KEYS, "ts", ["value"], "minmax", holdout=65)
    z = fe.transform(d, st, KEYS, ["value"]).withColumnRenamed("value", "z")
    m = fe.transform(d, mm, KEYS, ["value"]).withColumnRenamed("value", "mm")
    back = fe.transform(z.withColumnRenamed("z", "value"), st, KEYS, ["value"], inverse=True) \
        .withColumnRenamed("value", "back")
    return z.join(m, [*KEYS, "ts"]).join(back.select(*KEYS, "ts", "back"), [*KEYS, "ts"])


# G3 / F10 ----------------------------------------------------------------------
_G3_SQL = td.with_views("""b AS (SELECT series_id, ts, value, row_number() OVER w AS rn,
    CASE WHEN count(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7
         THEN avg(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS trend
  FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
p AS (SELECT series_id, (rn - 1) % 7 AS ph, avg(value - trend) AS pm FROM b GROUP BY 1, 2),
s AS (SELECT series_id, ph, pm - avg(pm) OVER (PARTITION BY series_id) AS seasonal FROM p)
SELECT b.series_id, b.ts, b.value, b.trend, s.seasonal, b.value - b.trend - s.seasonal AS residual
FROM b JOIN s ON b.series_id = s.series_id AND (b.rn - 1) % 7 = s.ph""", "daily").replace(
    "GROUP BY 1, 2)\nb AS", "GROUP BY 1, 2),\nb AS", 1)


@register("g3_classical_decompose", "series_id:s ts:t value:d trend:d seasonal:d residual:d", _G3_SQL)
def q_classical(spark, sf):
    """G3 classical additive decomposition with period 7 (rows)."""
    return dc.classical(td.daily(spark, sf), KEYS, "ts", "value", 7, block_rows=256)


@register("f10_seasonality_strength", "series_id:s seasonality_strength:d",
          "SELECT series_id, 1.0 - var_samp(residual) / (var_samp(residual) + var_samp(seasonal)) AS seasonality_strength "
          "FROM (" + _G3_SQL + ") g GROUP BY 1")
def q_strength(spark, sf):
    """F10 seasonality strength of the G3 decomposition."""
    return fe.seasonality_strength(q_classical(spark, sf), KEYS)


# G5 / G4 / G1 (no SQL twin: least squares / banded solve) --------------------------
@register("g5_fourier_decompose", "series_id:s ts:t value:d trend:d seasonal:d residual:d")
def q_fourier(spark, sf):
    """G5 Fourier regression decomposition on the business-day densified, filled daily series."""
    from ..operators import impute as im
    dense = im.ffill_bfill(im.densify_business_days(td.daily(spark, sf), KEYS, "ts"), KEYS, "ts", ["value"])
    return dc.fourier(dense, KEYS, "ts", "value").select("series_id", "ts", "value", "trend", "seasonal", "residual")


@register("g2_stl_decompose", "series_id:s ts:t value:d trend:d seasonal:d residual:d")
def q_stl(spark, sf):
    """G2/G1 robust STL with period 7 per series, plus calendar encodings dropped for the check."""
    return dc.decompose(td.daily(spark, sf), KEYS, "ts", "value", 7, method="stl").select(
        "series_id", "ts", "value", "trend", "seasonal", "residual")


@register("g2_stl_blocks", "series_id:s ts:t value:d trend:d seasonal:d residual:d robust_weight:d")
def q_stl_blocks(spark, sf):
    """G2 robust STL with period 7 over several blocks a series: Spark passes with exact medians of |residual|."""
    from ..operators.stl import stl_decompose
    return stl_decompose(td.daily(spark, sf), KEYS, "ts", "value", 7, block_rows=512, outer=2)


@register("g4_hp_normal_equations", "series_id:s ts:t value:d trend_known:i equation:d", td.with_views("""p AS (SELECT series_id, ts,
    value / 1e6 AS value, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn FROM daily)
SELECT series_id, ts, CASE WHEN rn % 10 <> 3 THEN value END AS value, 1 AS trend_known, 0.0 AS equation FROM p""", "daily").replace("GROUP BY 1, 2)\np AS", "GROUP BY 1, 2),\np AS", 1))
def q_hp_equations(spark, sf):
    """G4 with every tenth value missing, over several blocks a series: each row of (W + lambda D'D) trend = W value
    holds (values in millions), so ``equation``, the difference of its sides, is 0."""
    from ..operators import sequence as seq
    d = seq.index_rows(td.daily(spark, sf), KEYS, "ts")
    d = d.withColumn("value", F.when(F.col(seq.RN) % 10 != 3, F.col("value") / 1e6)).drop(seq.RN)
    hp = dc.hp_filter(d, KEYS, "ts", "value", block_rows=512)

    def bends(x, w):
        return x.withColumn("_d", F.lag("trend", 2).over(w) - 2 * F.lag("trend").over(w) + F.col("trend"))

    def equation(x, w):
        bend = lambda k: F.coalesce(F.lead("_d", k).over(w) if k else F.col("_d"), F.lit(0.0))
        return x.withColumn("equation", F.coalesce(F.col("trend") - F.col("value"), F.lit(0.0)) + 129600.0 * (bend(0) - 2 * bend(1) + bend(2)))

    out = seq.bounded(seq.bounded(hp, KEYS, "ts", bends, before=2, block_rows=256), KEYS, "ts", equation, after=2, block_rows=256)
    return out.withColumn("trend_known", F.col("trend").isNotNull().cast("int"))


@register("g4_hp_filter", "series_id:s ts:t value:d trend:d residual:d")
def q_hp(spark, sf):
    """G4 Hodrick-Prescott trend (lambda 129600) per series."""
    return dc.hp_filter(td.daily(spark, sf), KEYS, "ts", "value").select("series_id", "ts", "value", "trend",
                                                                         "residual")


# G8 / G9 / G21 (grouped forecasters; no SQL twin) ----------------------------------
HW_CFG = bt.ForecastConfig(n_tests=20, n_forecasts=2, seasonal_periods=261, n_lags=5, epochs=50)


@register("g8_backtest_holt_winters", "series_id:s Model:s MAE:d RMSE:d Directional Accuracy:d")
def q_hw(spark, sf):
    """G8/G18/G21 backtest: Holt-Winters (m=261) baseline vs Holt model, metrics per series."""
    art = bt.run_backtest(td.daily(spark, sf), KEYS, "ts", "value", HW_CFG, model="holt", baseline="holt_winters",
                          block_rows=256)
    return art.metrics


@register("g9_fitted_components", "series_id:s ts:t value:d fitted:d alpha:d beta:d gamma:d")
def q_fitted(spark, sf):
    """G9 Holt-Winters fitted values with the grid-searched parameters (season 7)."""
    from ..operators import smoothing as smo
    return smo.fitted_components(td.daily(spark, sf), KEYS, "ts", "value", 7)


@register("g8_g9_optimised", "series_id:s ts:t value:d fitted:d alpha:d beta:d gamma:d")
def q_optimised(spark, sf):
    """G8/G9 Holt-Winters fitted values (season 7): the grid's best cell improved by a pattern search with an
    estimated initial state, over several blocks a series."""
    from ..operators import smoothing as smo
    return smo.fitted_components(td.daily(spark, sf), KEYS, "ts", "value", 7, rounds=3, block_rows=512)


# G11-G15 / G24 (least squares; no SQL twin) ------------------------------------------
@register("g11_g24_direct_ridge", "series_id:s split:s origin:t step:i target_ts:t yhat:d actual:d alpha:d")
def q_direct(spark, sf):
    """G11/G12/G24 per-series direct ridge on 5 lags, horizon 2; penalty picked on the validation origin."""
    from ..operators import regress as rg
    return rg.direct_forecast(td.daily(spark, sf), KEYS, "ts", "value", lags=5, horizon=2, block_rows=256)


@register("g13_g14_change_model", "series_id:s split:s origin:t step:i yhat:d actual:d price:d")
def q_change(spark, sf):
    """G13/G14 the same model on percent changes, compounded into prices from the origin value."""
    from ..operators import regress as rg
    return rg.change_forecast(td.daily(spark, sf), KEYS, "ts", "value", lags=5, horizon=2, block_rows=256) \
        .select("series_id", "split", "origin", "step", "yhat", "actual", "price")


@register("g15_ar_trend_season", "series_id:s split:s origin:t step:i target_ts:t yhat:d actual:d alpha:d")
def q_ar_trend(spark, sf):
    """G15 AR lags + piecewise trend (10 changepoints) + yearly/weekly Fourier, direct 2-step ridge."""
    from ..operators import regress as rg
    return rg.ar_trend_forecast(td.daily(spark, sf), KEYS, "ts", "value", lags=5, horizon=2, block_rows=256)


@register("g24_pooled_mllib", "series_id:i origin:t step:i yhat:d actual:d split:s")
def q_pooled(spark, sf):
    """G11/G24 MLlib LinearRegression per step pooled over suppliers, chosen on the validation origins."""
    from ..operators import regress as rg
    return rg.pooled_linear(td.supplier_daily(spark, sf), KEYS, "ts", "value", lags=5, horizon=2, block_rows=256)


@register("g6_g10_fourier_forecast", "series_id:s step:i ts:t trend:d seasonal:d residual:d forecast:d")
def q_fourier_fc(spark, sf):
    """G6/G10 2-step forecast: Fourier trend + season on the next business days + AR(5) residual."""
    from ..operators import impute as im
    dense = im.ffill_bfill(im.densify_business_days(td.daily(spark, sf), KEYS, "ts"), KEYS, "ts", ["value"])
    return dc.fourier_forecast(dense, KEYS, "ts", "value", n_steps=2, ar_order=5, block_rows=256)


@register("g6_ar_likelihood", "series_id:s loglik:d", td.with_views("""p AS (SELECT series_id, value / 1e6 AS y, row_number() OVER w AS rn,
    lag(value / 1e6, 1) OVER w AS y1, lag(value / 1e6, 2) OVER w AS y2 FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
e AS (SELECT series_id, CASE rn WHEN 1 THEN y - 1.5 WHEN 2 THEN y - 1.5 - 0.625 * (y1 - 1.5) ELSE y - 1.5 - 0.5 * (y1 - 1.5) - 0.2 * (y2 - 1.5) END AS e,
  0.04 * CASE rn WHEN 1 THEN 1 / ((1 - 0.625 * 0.625) * (1 - 0.2 * 0.2)) WHEN 2 THEN 1 / (1 - 0.2 * 0.2) ELSE 1 END AS v FROM p)
SELECT series_id, sum(-0.5 * (ln(2 * pi() * v) + e * e / v)) AS loglik FROM e GROUP BY 1""", "daily").replace("GROUP BY 1, 2)\np AS", "GROUP BY 1, 2),\np AS", 1))
def q_ar_likelihood(spark, sf):
    """G6 exact likelihood of an AR(2) with given parameters, from sums of products (values in millions)."""
    from ..operators import arima
    d = td.daily(spark, sf).withColumn("value", F.col("value") / 1e6)
    return arima.ar_log_likelihood(d, KEYS, "ts", "value", [0.5, 0.2], 1.5, 0.04, block_rows=256)


@register("g6_exact_ar", "series_id:s mean:d sigma2:d loglik:d")
def q_exact_ar(spark, sf):
    """G6 residual model: AR(5) of greatest exact likelihood on the daily values (in millions)."""
    from ..operators import arima
    d = td.daily(spark, sf).withColumn("value", F.col("value") / 1e6)
    return arima.exact_ar(d, KEYS, "ts", "value", 5, block_rows=256)


@register("g24_trial_search", "series_id:s trial:i penalty:s lags:i alpha:d origins:i mae:d best:i")
def q_trials(spark, sf):
    """G24 ten seeded trials of a windowed regression with successive halving, all trials of all series in one job."""
    from ..operators import trials
    grid = [{"penalty": "ridge", "lags": 5, "alpha": a} for a in (0.1, 1.0, 10.0)]
    return trials.search(td.daily(spark, sf), KEYS, "ts", "value", horizon=2, n_trials=10, seed=7, first=grid, block_rows=256) \
        .withColumn("best", F.col("best").cast("int"))


# Closed forms: one or two lags, one step, no penalty ------------------------------------------
def _lag_sql(values: str, tail: str) -> str:
    """Origins with the value, one value back (b) and the next (y); ``tr``: targets before the validation target."""
    return td.with_views(f"""v AS ({values}),
p AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY series_id) AS n, lag(x) OVER w AS b, lead(x) OVER w AS y
  FROM v WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
tr AS (SELECT * FROM p WHERE rn + 1 <= n - 2),
o AS (SELECT *, CASE n - rn WHEN 0 THEN 'future' WHEN 1 THEN 'test' ELSE 'val' END AS split FROM p WHERE n - rn <= 2),
{tail}""", "daily").replace("GROUP BY 1, 2)\nv AS", "GROUP BY 1, 2),\nv AS", 1)


@register("g11_one_lag_ols", "series_id:s split:s origin:t yhat:d actual:d", _lag_sql(
    "SELECT series_id, ts, value / 1e6 AS x FROM daily",
    """f AS (SELECT series_id, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM tr GROUP BY 1)
SELECT o.series_id, split, ts AS origin, i + s * x AS yhat, y AS actual FROM o JOIN f USING (series_id)"""))
def q_one_lag(spark, sf):
    """G11 with one lag, one step, no penalty: simple regression (values in millions)."""
    from ..operators import regress as rg
    out = rg.direct_forecast(td.daily(spark, sf), KEYS, "ts", "value", 1, 1, alphas=[0.0], block_rows=256)
    return out.withColumns({c: F.col(c) / 1e6 for c in ("yhat", "actual")})


@register("g11_two_lag_ols", "series_id:s split:s origin:t yhat:d actual:d", _lag_sql(
    "SELECT series_id, ts, value / 1e6 AS x FROM daily",
    """c AS (SELECT series_id, avg(x) AS mx, avg(b) AS mb, avg(y) AS my, var_pop(x) AS vx, var_pop(b) AS vb, covar_pop(x, b) AS xb,
    covar_pop(y, x) AS yx, covar_pop(y, b) AS yb FROM tr WHERE b IS NOT NULL GROUP BY 1),
f AS (SELECT *, (yx * vb - yb * xb) / (vx * vb - xb * xb) AS s, (yb * vx - yx * xb) / (vx * vb - xb * xb) AS t FROM c)
SELECT o.series_id, split, ts AS origin, my + s * (x - mx) + t * (b - mb) AS yhat, y AS actual FROM o JOIN f USING (series_id)"""))
def q_two_lag(spark, sf):
    """G11 with two lags: the two-regressor closed form (values in millions)."""
    from ..operators import regress as rg
    out = rg.direct_forecast(td.daily(spark, sf), KEYS, "ts", "value", 2, 1, alphas=[0.0], block_rows=256)
    return out.withColumns({c: F.col(c) / 1e6 for c in ("yhat", "actual")})


@register("g13_one_lag_change", "series_id:s split:s origin:t yhat:d price:d", _lag_sql(
    "SELECT * FROM (SELECT series_id, ts, value, value / lag(value) OVER (PARTITION BY series_id ORDER BY ts) - 1 AS x FROM daily) q WHERE x IS NOT NULL",
    """f AS (SELECT series_id, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM tr GROUP BY 1)
SELECT o.series_id, split, ts AS origin, i + s * x AS yhat, value * (1 + i + s * x) / 1e6 AS price FROM o JOIN f USING (series_id)"""))
def q_one_lag_change(spark, sf):
    """G13/G14 with one lag, one step, no penalty: simple regression of changes, compounded (price in millions)."""
    from ..operators import regress as rg
    out = rg.change_forecast(td.daily(spark, sf), KEYS, "ts", "value", 1, 1, alphas=[0.0], block_rows=256)
    return out.withColumn("price", F.col("price") / 1e6)


# Recursions with given parameters --------------------------------------------------------------
@register("g7_holt_fixed", "series_id:s ts:t fitted:d level:d trend:d", td.with_views("""RECURSIVE p AS (SELECT series_id, ts, value / 1e6 AS y,
    row_number() OVER w AS rn, lead(value / 1e6) OVER w AS y2 FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
r AS (SELECT series_id, rn, ts, y AS fitted, y AS level, y2 - y AS trend FROM p WHERE rn = 1
  UNION ALL SELECT series_id, rn, ts, f, l, 0.1 * (l - level) + 0.9 * trend FROM (
    SELECT r.series_id, p.rn, p.ts, r.level, r.trend, r.level + r.trend AS f, 0.3 * p.y + 0.7 * (r.level + r.trend) AS l
    FROM r JOIN p ON p.series_id = r.series_id AND p.rn = r.rn + 1) q)
SELECT series_id, ts, fitted, level, trend FROM r""", "daily").replace("WITH daily", "WITH RECURSIVE daily").replace("GROUP BY 1, 2)\nRECURSIVE p", "GROUP BY 1, 2),\np", 1))
def q_holt_fixed(spark, sf):
    """G7 Holt's linear trend with alpha 0.3, beta 0.1 (values in millions)."""
    from ..operators import smoothing as smo
    d = td.daily(spark, sf).withColumn("value", F.col("value") / 1e6)
    return smo.smooth_fixed(d, KEYS, "ts", "value", 1, 0.3, 0.1, 0.0, block_rows=256)


@register("g8_holt_winters_fixed", "series_id:s ts:t fitted:d level:d trend:d season:d", td.with_views("""RECURSIVE p AS (SELECT series_id, ts,
    value / 1e6 AS y, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn FROM daily),
i AS (SELECT series_id, avg(y) FILTER (rn <= 3) AS l, (avg(y) FILTER (rn > 3) - avg(y) FILTER (rn <= 3)) / 3 AS t,
  max(y) FILTER (rn = 1) AS y1, max(y) FILTER (rn = 2) AS y2, max(y) FILTER (rn = 3) AS y3 FROM p WHERE rn <= 6 GROUP BY 1),
r AS (SELECT series_id, 0::BIGINT AS rn, NULL::DATE AS ts, 0.0::DOUBLE AS fitted, l AS level, t AS trend, 0.0::DOUBLE AS season,
    y1 - l AS s1, y2 - l AS s2, y3 - l AS s3 FROM i
  UNION ALL SELECT series_id, rn, ts, f, l, 0.1 * (l - level) + 0.9 * trend, 0.2 * (y - l) + 0.8 * s1, s2, s3, 0.2 * (y - l) + 0.8 * s1 FROM (
    SELECT r.series_id, p.rn, p.ts, p.y, r.level, r.trend, r.s1, r.s2, r.s3, r.level + r.trend + r.s1 AS f,
      0.3 * (p.y - r.s1) + 0.7 * (r.level + r.trend) AS l FROM r JOIN p ON p.series_id = r.series_id AND p.rn = r.rn + 1) q)
SELECT series_id, ts, fitted, level, trend, season FROM r WHERE rn > 0""", "daily").replace("WITH daily", "WITH RECURSIVE daily").replace("GROUP BY 1, 2)\nRECURSIVE p", "GROUP BY 1, 2),\np", 1))
def q_hw_fixed(spark, sf):
    """G8/G9 additive Holt-Winters with a season of 3, alpha 0.3, beta 0.1, gamma 0.2 (values in millions)."""
    from ..operators import smoothing as smo
    d = td.daily(spark, sf).withColumn("value", F.col("value") / 1e6)
    return smo.smooth_fixed(d, KEYS, "ts", "value", 3, 0.3, 0.1, 0.2, block_rows=256)


# G12 / G10 ---------------------------------------------------------------------------------------
_G12_BETAS = [[0.01, 0.5, 0.02, 0.1, 0.03], [0.02, 0.25, 0.01, 0.2, 0.04]]
_G12_SQL = _G3_SQL.replace("FROM daily WINDOW w", "FROM (SELECT series_id, ts, value / 1e6 AS value FROM daily) WINDOW w")


@register("g12_price_composition", "series_id:s step:i ts:t residual:d trend:d seasonal:d forecast:d", f"""
WITH RECURSIVE g AS MATERIALIZED (SELECT * FROM ({_G12_SQL}) q WHERE trend IS NOT NULL),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY series_id) AS n,
  lead(trend) OVER (PARTITION BY series_id ORDER BY ts) AS next FROM g),
h AS (SELECT series_id, rn, trend AS l, next - trend AS b FROM p WHERE rn = 1
  UNION ALL SELECT series_id, rn, nl, 0.1 * (nl - l) + 0.9 * b FROM (SELECT p.series_id, p.rn, h.l, h.b, 0.3 * p.trend + 0.7 * (h.l + h.b) AS nl
    FROM h JOIN p ON p.series_id = h.series_id AND p.rn = h.rn + 1) q),
e AS (SELECT p.*, h.l, h.b FROM p JOIN h USING (series_id, rn) WHERE rn = n),
s AS (SELECT series_id, k AS step, e.ts AS ots, CASE k WHEN 1 THEN 0.01 + 0.5 * residual + 0.02 * trend + 0.1 * seasonal + 0.03 * sin(2 * pi() * (isodow(ts) - 1) / 7)
    ELSE 0.02 + 0.25 * residual + 0.01 * trend + 0.2 * seasonal + 0.04 * sin(2 * pi() * (isodow(ts) - 1) / 7) END AS residual, l + k * b AS trend, n
  FROM e, (SELECT unnest([1, 2]) AS k)),
m AS (SELECT s.series_id, s.step, avg(p.seasonal) AS seasonal FROM (SELECT *, unnest(range(-3, 4)) AS o FROM s) s JOIN p ON p.series_id = s.series_id
  AND p.rn = CASE WHEN s.step + o > 2 THEN s.n + 3 - s.step - o ELSE s.n - 2 + s.step + o END GROUP BY 1, 2),
d AS (SELECT series_id, d, row_number() OVER (PARTITION BY series_id ORDER BY d) AS step FROM (SELECT DISTINCT series_id,
  CAST(unnest(generate_series(ots + INTERVAL 1 DAY, ots + INTERVAL 9 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM s) q WHERE isodow(d) <= 5)
SELECT s.series_id, s.step, d.d AS ts, residual, trend, seasonal, residual + trend + seasonal AS forecast
FROM s JOIN m USING (series_id, step) JOIN d USING (series_id, step)""")
def q_composition(spark, sf):
    """G12/G10/G11 with fixed models: windows over the seven features, Holt trend, last smoothed season (millions)."""
    from ..operators import regress as rg
    d = td.daily(spark, sf).withColumn("value", F.col("value") / 1e6)
    return rg.price_composition(d, KEYS, "ts", "value", 7, lags=5, horizon=2, method="classical", betas=_G12_BETAS,
                                trend_params=(0.3, 0.1), block_rows=256)


_COMP_CFG = bt.ForecastConfig(n_tests=20, n_forecasts=2, seasonal_periods=7, n_lags=5)


@register("g12_backtest_composition", "series_id:s fold:i step:i origin:t residual:d trend:d seasonal:d yhat:d", td.with_views("""b AS MATERIALIZED (SELECT series_id,
    ts, value / 1e6 AS y, row_number() OVER w AS rn, count(*) OVER (PARTITION BY series_id) AS n,
    CASE WHEN count(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7 THEN avg(value / 1e6) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS trend
  FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
f AS (SELECT unnest(range(-1, 10)) AS fold),
t AS (SELECT b.*, fold FROM b, f WHERE trend IS NOT NULL AND rn + 3 <= n - 2 * (fold + 1)),
p AS (SELECT series_id, fold, (rn - 1) % 7 AS ph, avg(y - trend) AS pm FROM t GROUP BY ALL),
s AS MATERIALIZED (SELECT series_id, fold, ph, pm - avg(pm) OVER (PARTITION BY series_id, fold) AS s FROM p),
h AS (SELECT b.series_id, b.rn, b.trend AS l, c.trend - b.trend AS g FROM b JOIN b c ON c.series_id = b.series_id AND b.rn = 4 AND c.rn = 5
  UNION ALL SELECT series_id, rn, nl, 0.1 * (nl - l) + 0.9 * g FROM (SELECT b.series_id, b.rn, h.l, h.g, 0.3 * b.trend + 0.7 * (h.l + h.g) AS nl
    FROM h JOIN b ON b.series_id = h.series_id AND b.rn = h.rn + 1 AND b.trend IS NOT NULL) q),
e AS (SELECT t.*, h.l, h.g, s.s FROM t JOIN h USING (series_id, rn) JOIN s ON s.series_id = t.series_id AND s.fold = t.fold AND s.ph = (t.rn - 1) % 7
  WHERE t.rn + 3 = n - 2 * (t.fold + 1)),
k AS (SELECT e.*, unnest([1, 2]) AS step FROM e),
m AS (SELECT k.series_id, k.fold, k.step, avg(s.s) AS seasonal FROM (SELECT *, unnest(range(-3, 4)) AS o FROM k) k JOIN s ON s.series_id = k.series_id AND s.fold = k.fold
  AND s.ph = (CASE WHEN k.step - 2 + o > 0 THEN k.rn + 3 - k.step - o ELSE k.rn - 2 + k.step + o END - 1) % 7 GROUP BY ALL),
r AS (SELECT series_id, fold, step, CASE step WHEN 1 THEN 0.01 + 0.5 * (y - trend - s) + 0.02 * trend + 0.1 * s + 0.03 * sin(2 * pi() * (isodow(ts) - 1) / 7)
    ELSE 0.02 + 0.25 * (y - trend - s) + 0.01 * trend + 0.2 * s + 0.04 * sin(2 * pi() * (isodow(ts) - 1) / 7) END AS residual, l + (3 + step) * g AS trend, n FROM k)
SELECT series_id, fold, step, b.ts AS origin, residual, r.trend, seasonal, residual + r.trend + seasonal AS yhat
FROM r JOIN m USING (series_id, fold, step) JOIN b USING (series_id) WHERE b.rn = r.n - 2 * (fold + 1)""", "daily").replace("WITH daily", "WITH RECURSIVE daily").replace(
    "GROUP BY 1, 2)\nb AS", "GROUP BY 1, 2),\nb AS", 1))
def q_backtest_composition(spark, sf):
    """G12 in G18 with fixed models: every fold's decomposition, windows, Holt trend and season from its training rows
    (values in millions)."""
    from ..operators import composition as cp
    from ..operators.indicators import positions
    d = td.daily(spark, sf).withColumn("value", F.col("value") / 1e6)
    out = cp.fold_composition(positions(d, KEYS, "ts"), KEYS, "value", _COMP_CFG, betas=_G12_BETAS, trend_params=(0.3, 0.1), block_rows=256)
    return out.withColumnRenamed("ots", "origin")


@register("g21_run_all_composition", "series_id:s run_model:s Model:s MAE:d RMSE:d Directional Accuracy:d")
def q_run_all_composition(spark, sf):
    """G21 over the fitted composition and a native model, with seasonal naive as the baseline."""
    return bt.run_all(td.daily(spark, sf), KEYS, "ts", "value", ["price_composition", "drift"], _COMP_CFG, baseline="seasonal_naive", block_rows=256).metrics


@register("g12_price_forecast", "series_id:s step:i ts:t residual:d trend:d seasonal:d forecast:d")
def q_price_forecast(spark, sf):
    """G12 with fitted models: STL, ridge on the feature windows, Holt by grid search."""
    from ..operators import regress as rg
    return rg.price_composition(td.daily(spark, sf), KEYS, "ts", "value", 7, lags=5, horizon=2)
