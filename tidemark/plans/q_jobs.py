"""Registered job compositions and remaining inventory rows (B9, B21-B24, D5, D8, G16, G17, G23,
G26, G27, G29) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import clean as cl
from ..operators import impute as im
from ..operators import indicators as ind
from ..sources import testdata as td
from . import jobs
from .q_align import F_SQL, O_SQL, by_status
from .q_backtest import comparison_sql
from .q_clean import RAW_QUOTES_SQL, raw_quotes
from .q_windows import _E8_COLS, _E8_SQL
from .registry import register

KEYS = ["series_id"]


# B9 keep last ----------------------------------------------------------------------
@register("b9_dedupe_keep_last", "symbol:s Date:s Price:s _seq:i",
          f"""SELECT symbol, "Date", arg_max("Price", _seq) AS "Price", max(_seq) AS _seq
FROM ({RAW_QUOTES_SQL}) r GROUP BY 1, 2""")
def q_keep_last(spark, sf):
    """B9 one row per (symbol, Date) keeping the last by ingest ordinal."""
    return cl.dedupe(raw_quotes(spark, sf).select("symbol", "Date", "Price", "_seq"), ["symbol", "Date"],
                     keep="last")


# B21 / B23 / B24 --------------------------------------------------------------------
@register("b21_b23_b24_fill_drop", "series_id:s ts:t value_f:d value_o:d",
          f"""SELECT series_id, ts, coalesce(value_f, 0.0) AS value_f, coalesce(value_o, 0.0) AS value_o
FROM ({F_SQL}) f FULL OUTER JOIN ({O_SQL}) o USING (series_id, ts)""")
def q_fill_drop(spark, sf):
    """B21 zero fill of numeric NULLs, B24 drop of all-zero columns (a zeroed copy is dropped),
    B23 drop of an absent column is a no-op."""
    d = by_status(spark, sf, "F").join(by_status(spark, sf, "O"), ["series_id", "ts"], "full")
    d = cl.fill_zero(d).withColumn("zeroed", F.col("value_f") * 0.0)
    d = cl.drop_all_zero_columns(d)
    return cl.drop_if_present(d, "Index")


# D5 / D8 --------------------------------------------------------------------------
@register("d5_drop_trailing_regressors", "series_id:s ts:t value:d value_o:d value_f:d",
          td.with_views(f"""SELECT m.* FROM (SELECT d.series_id, d.ts, d.value, o.value_o, f.value_f FROM daily d
    LEFT JOIN ({O_SQL}) o USING (series_id, ts) LEFT JOIN ({F_SQL}) f USING (series_id, ts)) m
JOIN (SELECT d.series_id, max(CASE WHEN coalesce(o.value_o, f.value_f) IS NOT NULL THEN d.ts END) AS lv FROM daily d
    LEFT JOIN ({O_SQL}) o USING (series_id, ts) LEFT JOIN ({F_SQL}) f USING (series_id, ts) GROUP BY 1) l
  USING (series_id)
WHERE m.ts <= l.lv""", "daily"))
def q_trailing_regs(spark, sf):
    """D5 drop trailing rows where every future regressor (open / filled order value) is NULL."""
    m = (td.daily(spark, sf).join(by_status(spark, sf, "O"), ["series_id", "ts"], "left")
         .join(by_status(spark, sf, "F"), ["series_id", "ts"], "left"))
    return im.drop_trailing_nulls(m, KEYS, "ts", ["value_o", "value_f"])


@register("d8_append_future_ffill", "series_id:s ts:t value:d value_o:d",
          td.with_views(f"""SELECT series_id, ts, value,
  last_value(value_o IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value_o FROM (
  SELECT d.series_id, d.ts, d.value, o.value_o FROM daily d LEFT JOIN ({O_SQL}) o USING (series_id, ts)
  UNION ALL
  SELECT series_id, ts, NULL, NULL FROM (
    SELECT series_id, d AS ts, row_number() OVER (PARTITION BY series_id ORDER BY d) AS step FROM (
      SELECT series_id, CAST(unnest(generate_series(last + INTERVAL 1 DAY, last + INTERVAL 7 DAY, INTERVAL 1 DAY))
             AS DATE) AS d FROM (SELECT series_id, max(ts) AS last FROM daily GROUP BY 1) l) x
    WHERE isodow(d) <= 5) y WHERE step <= 2) u""", "daily"))
def q_append_future(spark, sf):
    """D8 re-append the next 2 business days as future rows, forward fill the condition column."""
    hist = td.daily(spark, sf).join(by_status(spark, sf, "O"), ["series_id", "ts"], "left")
    fut = ind.next_business_days(td.daily(spark, sf), KEYS, "ts", 2).drop("step")
    return im.append_future(hist, fut, KEYS, "ts", ["value_o"])


# G16 / G17 ------------------------------------------------------------------------
_WIDE_SQL = td.with_views("""f AS (SELECT series_id, d AS ts, row_number() OVER (PARTITION BY series_id ORDER BY d) AS step
  FROM (SELECT series_id, CAST(unnest(generate_series(last + INTERVAL 1 DAY, last + INTERVAL 7 DAY, INTERVAL 1 DAY))
        AS DATE) AS d FROM (SELECT series_id, max(ts) AS last FROM daily GROUP BY 1) l) x WHERE isodow(d) <= 5),
lastv AS (SELECT series_id, arg_max(value, ts) AS lv FROM daily GROUP BY 1)
SELECT f.series_id, f.ts, lastv.lv + 1.0 * f.step AS yhat FROM f JOIN lastv USING (series_id) WHERE f.step <= 2""",
                          "daily").replace("GROUP BY 1, 2)\nf AS", "GROUP BY 1, 2),\nf AS", 1)


@register("g16_diagonal_pick", "series_id:s ts:t yhat:d", _WIDE_SQL)
def q_diagonal(spark, sf):
    """G16 from a wide yhat1/yhat2 future block (yhat_k = last value + k, present only on
    row k), each row takes the prediction made k steps ahead."""
    d = td.daily(spark, sf)
    fut = ind.next_business_days(d, KEYS, "ts", 2)
    last = d.groupBy(*KEYS).agg(F.max_by("value", "ts").alias("lv"))
    wide = fut.join(last, KEYS).select(
        *KEYS, "ts", *[F.when(F.col("step") == k, F.col("lv") + 1.0 * k).alias(f"yhat{k}") for k in (1, 2)])
    return bt.diagonal_pick(wide, KEYS, "ts", "yhat", 2)


@register("g17_normalize_predictions", "series_id:s ts:t value:d",
          td.with_views("""SELECT series_id, ts, value FROM (SELECT *, row_number() OVER
  (PARTITION BY series_id ORDER BY ts DESC) AS rd FROM daily) x WHERE rd <= 2""", "daily"))
def q_normalize(spark, sf):
    """G17 normalise a model output: required columns, coerced types, last H=2 rows per series."""
    d = td.daily(spark, sf).withColumn("value", F.col("value").cast("string"))
    return bt.normalize_predictions(d, KEYS, "ts", "value", 2, "daily")


# G23 --------------------------------------------------------------------------------
@register("g23_horizon_sweep", "series_id:s Model:s MAE:d RMSE:d Directional Accuracy:d horizon:i",
          "SELECT *, 1 AS horizon FROM (" + comparison_sql(5, 1) + ") a UNION ALL "
          "SELECT *, 2 AS horizon FROM (" + comparison_sql(10, 2) + ") b")
def q_sweep(spark, sf):
    """G23 evaluation sweep: horizons {1, 2} x 5 rolling origins, naive vs drift."""
    return jobs.horizon_sweep(td.daily(spark, sf), KEYS, "ts", "value", (1, 2), 5, block_rows=256)


# G26 / G27 --------------------------------------------------------------------------
_CHANGE_SQL = td.with_views("""SELECT series_id, ts, value / NULLIF(lag(value) OVER (PARTITION BY series_id ORDER BY ts), 0) - 1
  AS "Change" FROM daily""", "daily")


@register("g26_change_table", "series_id:s ts:t Change:d", _CHANGE_SQL)
def q_change_table(spark, sf):
    """G26 (Date, Change) table; the change is computed because the column is absent."""
    return jobs.change_table(td.daily(spark, sf), KEYS, "ts", "value")


@register("g27_change_with_features", "series_id:s ts:t Change:d value:d " + " ".join(f"{c}:d" for c in _E8_COLS),
          "SELECT * FROM (" + _CHANGE_SQL + ") c JOIN (" + _E8_SQL + ") e USING (series_id, ts)")
def q_change_feat(spark, sf):
    """G27 change table JOIN the E8 feature table on (series, date)."""
    d = td.daily(spark, sf)
    return jobs.change_with_features(jobs.change_table(d, KEYS, "ts", "value"),
                                     ind.feature_bundle(d, KEYS, "ts", ["value"], block_rows=256), KEYS, "ts")


# G29 ----------------------------------------------------------------------------------
_G29_SQL = td.with_views("""sh AS (SELECT series_id AS symbol, ts, value FROM ship),
dates AS (SELECT s.series_id, c.ts FROM (SELECT DISTINCT series_id FROM daily) s, (SELECT DISTINCT ts FROM sh) c UNION SELECT series_id, ts FROM daily),
lng AS (SELECT d.series_id, d.ts, y.symbol, t.value AS target, sh.value FROM dates d, (SELECT DISTINCT symbol FROM sh) y
  LEFT JOIN sh ON sh.symbol = y.symbol AND sh.ts = d.ts LEFT JOIN daily t ON t.series_id = d.series_id AND t.ts = d.ts),
m AS (SELECT *, sum(CASE WHEN target IS NULL OR target = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, symbol ORDER BY ts
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cb FROM lng),
n AS (SELECT *, first_value(CASE WHEN value IS NOT NULL THEN {'c': value, 't': target, 'b': cb} END IGNORE NULLS)
        OVER (PARTITION BY series_id, symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM m)
SELECT series_id, ts, symbol, target, CASE WHEN value IS NULL AND nx IS NOT NULL AND target IS NOT NULL AND nx.b = cb
  THEN nx.c * target / nx.t ELSE value END AS value FROM n""", "daily", "ship").replace("GROUP BY 1, 2)\nsh AS", "GROUP BY 1, 2),\nsh AS", 1)


def _instruments(spark, sf):
    return td.ship(spark, sf).withColumnRenamed("series_id", "symbol")


@register("g29_merge_instruments", "series_id:s ts:t symbol:s target:d value:d", _G29_SQL)
def q_merge(spark, sf):
    """G29 merge job: all ship-value instruments outer-merged onto every daily series, backcast proportionally to it,
    all-zero instruments left out; long form, symbols read from the data."""
    return jobs.merge_instruments_long(td.daily(spark, sf), _instruments(spark, sf), KEYS, "symbol", "ts", "value")


# G28 jobs over raw-text views of the given tables --------------------------------------------
MAX_CHANGE = 0.5
LIST_ROWS = 1500


def _raw_prices(spark, sf, date_format: str):
    """Daily values as text files have them; every Sunday's price is missing, and every row is there twice."""
    d = td.daily(spark, sf)
    one = d.select("series_id", F.date_format("ts", date_format).alias("Date"),
                   F.when(F.dayofweek("ts") == 1, None).otherwise(F.format_number("value", 2)).alias("Price"))
    return one.unionByName(one)


_PRICES_SQL = f"""t0 AS (SELECT series_id, ts, round(value, 2) AS close FROM daily WHERE isodow(ts) <> 7),
t AS (SELECT series_id, ts, close FROM (SELECT *, lag(close) OVER (PARTITION BY series_id ORDER BY ts) AS p FROM t0) q
  WHERE p IS NULL OR abs(close / p - 1) <= {MAX_CHANGE})"""


@register("g28_clean_ohlc", "series_id:s ts:t close:d", td.with_views(_PRICES_SQL + ",\n" + """p AS (SELECT series_id, ts, value / 2 AS close FROM daily)
SELECT series_id, ts, close FROM t UNION ALL SELECT series_id, ts, close FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY series_id) AS np FROM p) x
JOIN (SELECT series_id, count(*) AS nt FROM t GROUP BY 1) c USING (series_id) WHERE rn <= np - nt""", "daily").replace("GROUP BY 1, 2)\nt0", "GROUP BY 1, 2),\nt0", 1))
def q_ohlc(spark, sf):
    """G28 index file: day/month/year dates, separators, repeats, outliers, older history of a proxy."""
    proxy = td.daily(spark, sf).select("series_id", "ts", (F.col("value") / 2).alias("close"))
    return jobs.clean_ohlc(_raw_prices(spark, sf, "d/M/yyyy"), ["series_id"], proxy, max_change=MAX_CHANGE)


@register("g28_clean_futures", "series_id:s ts:t close:d",
          td.with_views(_PRICES_SQL + "\nSELECT series_id, ts, close FROM t", "daily").replace("GROUP BY 1, 2)\nt0", "GROUP BY 1, 2),\nt0", 1))
def q_futures(spark, sf):
    """G28 futures file: day-month-short-year dates."""
    return jobs.clean_ohlc(_raw_prices(spark, sf, "d-M-yy"), ["series_id"], date_format="d-M-yy", max_change=MAX_CHANGE)


@register("g28_clean_list", "series_id:s ts:t close:d", td.with_views(f"""SELECT series_id, ts, value AS close FROM ship
WHERE series_id IN (SELECT series_id FROM ship GROUP BY 1 HAVING count(*) >= {LIST_ROWS})""", "ship"))
def q_list(spark, sf):
    """G28 stock list: one text file a symbol, symbols with a short history left out."""
    s = td.ship(spark, sf)
    raw = s.select("series_id", F.date_format("ts", "M/d/yyyy").alias("Date"), F.col("value").cast("string").alias("Close (thousands)"))
    return jobs.clean_list(raw, "series_id", LIST_ROWS)


@register("g28_clean_external", "series_id:s ts:t close:d", td.with_views(f"""e AS (SELECT series_id, CAST(ts + INTERVAL 5 HOUR AS DATE) AS d, ts, value FROM hourly),
f AS (SELECT series_id, d AS ts, arg_min(value, ts) AS close FROM e GROUP BY 1, 2)
SELECT * FROM f WHERE series_id IN (SELECT series_id FROM f GROUP BY 1 HAVING count(*) >= 5)""", "hourly").replace("GROUP BY 1, 2)\ne AS", "GROUP BY 1, 2),\ne AS", 1))
def q_external(spark, sf):
    """G28 external instruments: instants with an offset as UTC dates, the first row of a date."""
    h = td.hourly(spark, sf)
    raw = h.select("series_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("-05:00")).alias("date"),
                   F.col("value").cast("string").alias("close"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("_seq"))
    return jobs.clean_external(raw, "series_id", 5)


@register("g29_merge_on_dates", "series_id:s ts:t symbol:s target:d value:d", td.with_views("""o AS (SELECT series_id AS symbol, ts, value FROM ship
  UNION ALL SELECT 'x', CAST(o_orderdate AS DATE), sum(o_totalprice) FROM orders GROUP BY 2),
c AS (SELECT ts FROM o GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM o))
SELECT d.series_id, d.ts, o.symbol, d.value AS target, o.value FROM daily d JOIN c USING (ts) JOIN o USING (ts)""", "daily", "ship").replace(
    "GROUP BY 1, 2)\no AS", "GROUP BY 1, 2),\no AS", 1))
def q_merge_on_dates(spark, sf):
    """G29 index merge for every daily series: instruments and an external total on the dates all have; one that is
    zero throughout is dropped."""
    orders = td.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("ts"))
    external = orders.agg(F.sum("o_totalprice").alias("value")).withColumn("symbol", F.lit("x"))
    zero = orders.agg(F.sum(F.col("o_totalprice") * 0).alias("value")).withColumn("symbol", F.lit("zero"))
    others = _instruments(spark, sf).unionByName(external).unionByName(zero)
    return jobs.merge_on_dates_long(td.daily(spark, sf), others, KEYS, "symbol", "ts", "value")
