"""Registered window/indicator queries (E1-E17) with DuckDB oracles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..sources import testdata as td
from .registry import register

# Registered queries use small row blocks so the halo / carry paths are
# exercised on the test tables (series of ~1,700 rows span several blocks).
BLOCK = 256
KEYS = ["series_id"]


def ema_sql(view: str, spans: list[int], col: str = "value") -> str:
    """Recursive CTE computing adjust=False EMAs per series (one step per row)."""
    alphas = {s: repr(2.0 / (s + 1.0)) for s in spans}
    seed = ", ".join(f"{col} AS e{s}" for s in spans)
    step = ", ".join(f"(1.0::DOUBLE - {alphas[s]}::DOUBLE) * e.e{s} + {alphas[s]}::DOUBLE * b.{col}"
                     for s in spans)
    return (f"b AS (SELECT series_id, ts, {col}, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn "
            f"FROM {view}),\n"
            f"e AS (SELECT series_id, rn, {seed} FROM b WHERE rn = 1 UNION ALL "
            f"SELECT b.series_id, b.rn, {step} FROM e JOIN b ON b.series_id = e.series_id AND b.rn = e.rn + 1)")


def recursive(sql: str, *views: str) -> str:
    ctes = ",\n".join(f"{n} AS ({td.VIEW_SQL[n]})" for n in views)
    return f"WITH RECURSIVE {ctes},\n{sql}"


def _rolling_sql(expr: str, n: int, agg: str) -> str:
    fr = f"(PARTITION BY series_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({expr}) OVER {fr} = {n} THEN {agg}({expr}) OVER {fr} END"


# ---------------------------------------------------------------- E1
@register("e1_lags", "series_id:s ts:t value:d value_Lag1:d value_Lag2:d value_Lag3:d value_Lag5:d value_Lag10:d",
          td.with_views("SELECT series_id, ts, value, "
                        + ", ".join(f"lag(value, {n}) OVER (PARTITION BY series_id ORDER BY ts) AS value_Lag{n}"
                                    for n in ind.LAGS) + " FROM daily", "daily"))
def q_lags(spark, sf):
    """E1 lags 1,2,3,5,10 by row per series."""
    return ind.lags(td.daily(spark, sf), KEYS, "ts", ["value"], block_rows=BLOCK)


@register("e1_hourly_lags", "series_id:s ts:t value:d value_Lag1:d value_Lag2:d value_Lag3:d value_Lag5:d value_Lag10:d",
          td.with_views("SELECT series_id, ts, value, "
                        + ", ".join(f"lag(value, {n}) OVER (PARTITION BY series_id ORDER BY ts) AS value_Lag{n}"
                                    for n in ind.LAGS) + " FROM hourly", "hourly"))
def q_hourly_lags(spark, sf):
    """E1 lags on the hourly TIMESTAMP series: day buckets, 64-row blocks (halos cross days)."""
    return ind.lags(td.hourly(spark, sf), KEYS, "ts", ["value"], block_rows=64, bucket="day")


# ---------------------------------------------------------------- E2 / E6
@register("e2_sma_e6_std", "series_id:s ts:t value_SMA_10:d value_SMA_20:d value_RollingStd_10:d",
          td.with_views("SELECT series_id, ts, "
                        f"{_rolling_sql('value', 10, 'avg')} AS value_SMA_10, "
                        f"{_rolling_sql('value', 20, 'avg')} AS value_SMA_20, "
                        f"{_rolling_sql('value', 10, 'stddev_samp')} AS value_RollingStd_10 FROM daily", "daily"))
def q_sma(spark, sf):
    """E2 simple moving averages 10/20 and E6 rolling sample std 10, NULL until full."""
    d = ind.sma(td.daily(spark, sf), KEYS, "ts", ["value"], block_rows=BLOCK)
    return ind.rolling_std(d, KEYS, "ts", ["value"], block_rows=BLOCK)


# ---------------------------------------------------------------- E4
_RSI_SQL = td.with_views("""
SELECT series_id, ts,
  CASE WHEN al > 0 THEN 100.0 - 100.0 / (1.0 + ag / al) WHEN al = 0 AND ag > 0 THEN 100.0 END AS value_RSI_14
FROM (
  SELECT series_id, ts,
    CASE WHEN count(*) OVER w = 14 THEN avg(g) OVER w END AS ag,
    CASE WHEN count(*) OVER w = 14 THEN avg(l) OVER w END AS al
  FROM (
    SELECT series_id, ts,
      CASE WHEN d > 0 THEN d ELSE 0.0 END AS g, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS l
    FROM (SELECT series_id, ts, value - lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS d FROM daily) x
  ) y
  WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)
) z""", "daily")


@register("e4_rsi", "series_id:s ts:t value_RSI_14:d", _RSI_SQL)
def q_rsi(spark, sf):
    """E4 RSI(14), simple-mean form."""
    return ind.rsi(td.daily(spark, sf), KEYS, "ts", ["value"], block_rows=BLOCK).select(
        "series_id", "ts", "value_RSI_14")


# ---------------------------------------------------------------- E3 / E5 / E7
_EMA_SQL = recursive(ema_sql("daily", [10, 20, 12, 26]) + """
SELECT b.series_id, b.ts, e.e10 AS value_EMA_10, e.e20 AS value_EMA_20, e.e12 AS value_EMA_12,
       e.e26 AS value_EMA_26, e.e12 - e.e26 AS value_MACD, e.e10 / NULLIF(e.e20, 0) AS value_EMA_Ratio
FROM b JOIN e ON b.series_id = e.series_id AND b.rn = e.rn""", "daily")


@register("e3_ema_e5_macd_e7_ratio",
          "series_id:s ts:t value_EMA_10:d value_EMA_20:d value_EMA_12:d value_EMA_26:d value_MACD:d value_EMA_Ratio:d",
          _EMA_SQL)
def q_ema(spark, sf):
    """E3 EMA spans 10/20/12/26 (adjust=False), E5 MACD, E7 EMA10/EMA20."""
    d = ind.ema(td.daily(spark, sf), KEYS, "ts", ["value"], spans=(10, 20, 12, 26))
    d = d.withColumn("value_MACD", F.col("value_EMA_12") - F.col("value_EMA_26"))
    return ind.ema_ratio(d, KEYS, "ts", ["value"])


# ---------------------------------------------------------------- E8
_E8_COLS = (["value_Lag1", "value_Lag2", "value_Lag3", "value_Lag5", "value_Lag10", "value_SMA_10", "value_SMA_20",
             "value_EMA_10", "value_EMA_20", "value_RSI_14", "value_EMA_12", "value_EMA_26", "value_MACD",
             "value_RollingStd_10", "value_EMA_Ratio"])

def e8_sql(view: str) -> str:
    return recursive(ema_sql(view, [10, 20, 12, 26]) + """,
r AS (
  SELECT series_id, ts,
    CASE WHEN al > 0 THEN 100.0 - 100.0 / (1.0 + ag / al) WHEN al = 0 AND ag > 0 THEN 100.0 END AS value_RSI_14
  FROM (
    SELECT series_id, ts,
      CASE WHEN count(*) OVER w = 14 THEN avg(g) OVER w END AS ag,
      CASE WHEN count(*) OVER w = 14 THEN avg(l) OVER w END AS al
    FROM (
      SELECT series_id, ts, CASE WHEN d > 0 THEN d ELSE 0.0 END AS g, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS l
      FROM (SELECT series_id, ts, value - lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS d FROM """ + view + """) x
    ) y
    WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)
  ) z),
f AS (
  SELECT b.series_id, b.ts, b.value,
    """ + ", ".join(f"lag(b.value, {n}) OVER (PARTITION BY b.series_id ORDER BY b.ts) AS value_Lag{n}"
                    for n in ind.LAGS) + f""",
    {_rolling_sql('b.value', 10, 'avg').replace('series_id', 'b.series_id').replace('ORDER BY ts', 'ORDER BY b.ts')} AS value_SMA_10,
    {_rolling_sql('b.value', 20, 'avg').replace('series_id', 'b.series_id').replace('ORDER BY ts', 'ORDER BY b.ts')} AS value_SMA_20,
    e.e10 AS value_EMA_10, e.e20 AS value_EMA_20, r.value_RSI_14, e.e12 AS value_EMA_12, e.e26 AS value_EMA_26,
    e.e12 - e.e26 AS value_MACD,
    {_rolling_sql('b.value', 10, 'stddev_samp').replace('series_id', 'b.series_id').replace('ORDER BY ts', 'ORDER BY b.ts')} AS value_RollingStd_10,
    e.e10 / NULLIF(e.e20, 0) AS value_EMA_Ratio
  FROM b JOIN e ON b.series_id = e.series_id AND b.rn = e.rn
         JOIN r ON b.series_id = r.series_id AND b.ts = r.ts)
SELECT * FROM f WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in _E8_COLS), view)


_E8_SQL = e8_sql("daily")

E8_COLS_SPEC = "series_id:s ts:t value:d " + " ".join(f"{c}:d" for c in _E8_COLS)


@register("e8_feature_bundle", E8_COLS_SPEC, _E8_SQL)
def q_e8(spark, sf):
    """E8 lag/indicator bundle on the daily series, warm-up rows dropped."""
    return ind.feature_bundle(td.daily(spark, sf), KEYS, "ts", ["value"], block_rows=BLOCK)


@register("e8_supplier_features", E8_COLS_SPEC.replace("series_id:s", "series_id:i"), e8_sql("supplier_daily"))
def q_e8_supplier(spark, sf):
    """E8 bundle over one series per supplier (the series count grows with the data)."""
    return ind.feature_bundle(td.supplier_daily(spark, sf), KEYS, "ts", ["value"], block_rows=BLOCK)


# ---------------------------------------------------------------- E9
_TWO_PI = repr(2.0 * math.pi)


@register("e9_calendar", "series_id:s ts:t dow_sin:d dow_cos:d month_sin:d month_cos:d",
          td.with_views(f"""SELECT series_id, ts,
  sin({_TWO_PI} * (isodow(ts) - 1) / 7.0) AS dow_sin, cos({_TWO_PI} * (isodow(ts) - 1) / 7.0) AS dow_cos,
  sin({_TWO_PI} * (month(ts) - 1) / 12.0) AS month_sin, cos({_TWO_PI} * (month(ts) - 1) / 12.0) AS month_cos
FROM daily""", "daily"))
def q_calendar(spark, sf):
    """E9 weekday / month sin-cos encodings."""
    return ind.calendar_encoding(td.daily(spark, sf), "ts")


# ---------------------------------------------------------------- E10 / E17
@register("e10_pct_change_e17_diff", "series_id:s ts:t value_pct_change:d value_diff:d value_diff_sign:d",
          td.with_views("""SELECT series_id, ts,
  value / NULLIF(lag(value) OVER w, 0) - 1 AS value_pct_change,
  value - lag(value) OVER w AS value_diff, sign(value - lag(value) OVER w) AS value_diff_sign
FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY ts)""", "daily"))
def q_pct(spark, sf):
    """E10 percent change vs previous row (forward-filled), E17 first difference and sign."""
    d = ind.pct_change(td.daily(spark, sf), KEYS, "ts", "value")
    return ind.diff_sign(d, KEYS, "ts", "value", block_rows=BLOCK)


# ---------------------------------------------------------------- E11
@register("e11_sliding_windows", "series_id:s origin:t part:s step:i v:d",
          td.with_views("""SELECT series_id, origin, part, step, v FROM (
  SELECT series_id, ts AS origin, n, unnest(['x','x','x','x','x','y','y']) AS part,
         unnest([1,2,3,4,5,1,2]) AS step, unnest([v0, v1, v2, v3, v4, v5, v6]) AS v
  FROM (SELECT series_id, ts, value AS v0,
          lead(value, 1) OVER w AS v1, lead(value, 2) OVER w AS v2, lead(value, 3) OVER w AS v3,
          lead(value, 4) OVER w AS v4, lead(value, 5) OVER w AS v5, lead(value, 6) OVER w AS v6,
          count(*) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS n
        FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY ts)) a) b
WHERE n = 7""", "daily"))
def q_windows(spark, sf):
    """E11 sliding windows L=5, H=2, flattened to (origin, part, step, value)."""
    w = ind.sliding_windows(td.daily(spark, sf), KEYS, "ts", "value", 5, 2, block_rows=BLOCK)
    xs = w.select("series_id", "origin", F.lit("x").alias("part"), F.posexplode("x").alias("p", "v"))
    ys = w.select("series_id", "origin", F.lit("y").alias("part"), F.posexplode("y").alias("p", "v"))
    return xs.unionByName(ys).withColumn("step", F.col("p") + 1).drop("p")


# ---------------------------------------------------------------- E12
def _reflect_sql() -> str:
    terms = []
    for k in range(-3, 4):
        q = f"(p + ({k}))"
        qr = f"(CASE WHEN {q} < 0 THEN -{q} - 1 WHEN {q} >= n THEN 2 * n - 1 - {q} ELSE {q} END)"
        terms.append(f"nb[{qr} - p + 4]")
    return " + ".join(terms)


@register("e12_centred_reflect", "series_id:s ts:t value_smooth:d",
          td.with_views(f"""SELECT series_id, ts, ({_reflect_sql()}) / 7.0 AS value_smooth FROM (
  SELECT series_id, ts, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY series_id) AS n,
    [lag(value, 3) OVER w, lag(value, 2) OVER w, lag(value, 1) OVER w, value,
     lead(value, 1) OVER w, lead(value, 2) OVER w, lead(value, 3) OVER w] AS nb
  FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY ts)) a""", "daily"))
def q_reflect(spark, sf):
    """E12 centred moving average width 7 with reflected edges."""
    return ind.centred_mean_reflect(td.daily(spark, sf), KEYS, "ts", "value", block_rows=BLOCK)


# ---------------------------------------------------------------- E13
@register("e13_step_direction", "series_id:s ts:t direction:i",
          td.with_views("""SELECT series_id, ts,
  sign(value - coalesce(lag(value) OVER (PARTITION BY series_id ORDER BY ts), 1000000.0)) AS direction
FROM daily""", "daily"))
def q_direction(spark, sf):
    """E13 up/down/same vs previous value; first row vs a base of 1e6."""
    return ind.step_direction(td.daily(spark, sf), KEYS, "ts", "value", base=1_000_000.0, block_rows=BLOCK)


# ---------------------------------------------------------------- E14
@register("e14_compound", "series_id:s ts:t price:d",
          td.with_views("""SELECT series_id, ts,
  100.0 * product(1.0 + r) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS price
FROM (SELECT series_id, ts, coalesce(value / lag(value) OVER (PARTITION BY series_id ORDER BY ts) - 1.0, 0.0) AS r FROM daily) a""", "daily"))
def q_compound(spark, sf):
    """E14 compound the daily changes (E10) into a price path from base 100."""
    d = ind.pct_change(td.daily(spark, sf), KEYS, "ts", "value", "_chg")
    d = d.withColumn("r", F.coalesce("_chg", F.lit(0.0))).withColumn("base", F.lit(100.0))
    return ind.compound(d, KEYS, "ts", "r", "base")


# ---------------------------------------------------------------- E15
@register("e15_next_business_days", "series_id:s step:i ts:t",
          td.with_views("""SELECT series_id, step, ts FROM (
  SELECT series_id, d AS ts, row_number() OVER (PARTITION BY series_id ORDER BY d) AS step FROM (
    SELECT series_id, CAST(unnest(generate_series(last + INTERVAL 1 DAY, last + INTERVAL 23 DAY, INTERVAL 1 DAY)) AS DATE) AS d
    FROM (SELECT series_id, max(ts) AS last FROM daily GROUP BY 1) l) x
  WHERE isodow(d) <= 5) y WHERE step <= 10""", "daily"))
def q_next_days(spark, sf):
    """E15 next 10 Mon-Fri dates after each series' last date."""
    return ind.next_business_days(td.daily(spark, sf), KEYS, "ts", 10)


# ---------------------------------------------------------------- E16
@register("e16_positional_split", "series_id:s ts:t rn:i rn_desc:i split:s",
          td.with_views("""SELECT series_id, ts, rn, rn_desc,
  CASE WHEN rn_desc <= 20 THEN 'test' WHEN rn_desc <= 40 THEN 'val' ELSE 'train' END AS split
FROM (SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn,
             row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn_desc FROM daily) a""", "daily"))
def q_split(spark, sf):
    """E16 positional numbering from both ends and ordered train/val/test split."""
    return ind.split_tail(td.daily(spark, sf), KEYS, "ts", test=20, val=20)
