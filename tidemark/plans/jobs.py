"""Composed jobs (G22, G23, G25-G29): the reference's scripts as keyed Spark jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align as al
from ..operators import backtest as bt
from ..operators import clean as cl
from ..operators import impute as im
from ..functions import text as tx
from ..operators import indicators as ind
from ..schema import require_keys


def run_models_isolated(df: DataFrame, keys, ts: str, value: str, models: Sequence[str],
                        write: Callable[[str, bt.Artifacts], None], cfg: bt.ForecastConfig = bt.ForecastConfig(),
                        baseline: str = "naive", **kw) -> dict[str, str]:
    """Run every model; a failing model is recorded and the others go on.

    ``write(model, artifacts)`` is the action (e.g. ``sources.files.write_artifacts``).
    Raises at the end listing the failed models; returns {model: 'ok'} otherwise.
    """
    status: dict[str, str] = {}
    for m in models:
        try:
            write(m, bt.run_backtest(df, keys, ts, value, cfg, model=m, baseline=baseline, **kw))
            status[m] = "ok"
        except Exception as e:  # noqa: BLE001 - isolation is the point
            status[m] = f"failed: {type(e).__name__}: {e}"
    failed = {m: s for m, s in status.items() if s != "ok"}
    if failed:
        raise RuntimeError("Forecast run failed for: " + "; ".join(f"{m} ({s})" for m, s in failed.items()))
    return status


def horizon_sweep(df: DataFrame, keys, ts: str, value: str, horizons: Sequence[int] = (1, 2), origins: int = 5,
                  model: str = "drift", baseline: str = "naive", **kw) -> DataFrame:
    """Metrics for every horizon with ``origins`` rolling origins each (n_tests = h * origins).

    The grid is a handful of parameter cells; each cell is one backtest plan and
    the results are unioned (no cross join of data with the grid).
    """
    out = None
    for h in horizons:
        cfg = bt.ForecastConfig(n_tests=h * origins, n_forecasts=h)
        m = bt.run_backtest(df, keys, ts, value, cfg, model=model, baseline=baseline, **kw).metrics
        m = m.withColumn("horizon", F.lit(int(h)))
        out = m if out is None else out.unionByName(m)
    return out


def test_predict(df: DataFrame, keys, ts: str, value: str, n_tests: int = 20, n_forecasts: int = 2,
                 seasonal_periods: int = 261, n_lags: int = 5, model: str = "drift", baseline: str = "naive",
                 **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Short-cut returning (final, metrics, forecast)."""
    cfg = bt.ForecastConfig(n_tests=n_tests, n_forecasts=n_forecasts, seasonal_periods=seasonal_periods,
                            n_lags=n_lags)
    a = bt.run_backtest(df, keys, ts, value, cfg, model=model, baseline=baseline, **kw)
    return a.final, a.metrics, a.forecast


def change_table(df: DataFrame, keys, ts: str, value: str, change: str = "Change", **kw) -> DataFrame:
    """(keys, ts, Change); the change is computed (E10) only when the column is absent."""
    keys = require_keys(keys)
    if change in df.columns:
        return df.select(*keys, ts, change)
    return ind.pct_change(df, keys, ts, value, change, **kw).select(*keys, ts, change)


def change_with_features(changes: DataFrame, features: DataFrame, keys, ts: str) -> DataFrame:
    """Change table JOIN merged feature table on (keys, ts)."""
    return al.inner_on(changes, features, [*require_keys(keys), ts])


def merge_instruments(target: DataFrame, others: DataFrame, symbol: str, ts: str, value: str,
                      symbols: Sequence[str], target_col: str = "target", **kw) -> DataFrame:
    """Outer-merge instruments onto the target's dates, proportional backcast
    of each instrument from the target, drop all-zero columns (B24), one pivot at the end.

    The backcast runs in long form keyed by symbol: (symbol, ts) rows carry the
    target value of the same date, so no window spans the whole table.
    """
    vals = list(symbols)
    t = target.select(ts, F.col(value).alias(target_col))
    grid = (others.where(F.col(symbol).isin(vals)).groupBy(ts).pivot(symbol, vals).agg(F.first(value))
            .join(t, ts, "full"))
    long = grid.unpivot([ts, target_col], [F.col(f"`{v}`") for v in vals], symbol, value)
    filled = im.proportional_backcast(long, [symbol], ts, [value], target_col, **kw)
    wide = filled.groupBy(ts).pivot(symbol, vals).agg(F.first(value)).join(t, ts, "full")
    return cl.drop_all_zero_columns(wide)


def merge_on_dates(target: DataFrame, tables: Sequence[DataFrame], ts: str, value: str, **kw) -> DataFrame:
    """G29, inner form: the target and the wide tables on the dates all have, all-zero columns dropped (B24),
    then the other columns backcast proportionally to the target (D2)."""
    out = target
    for t in tables:
        out = al.inner_on(out, t, [ts])
    out = cl.drop_all_zero_columns(out)
    names = al.other_columns(out, target)
    long = out.unpivot([ts, value], [F.col(f"`{c}`") for c in names], "_symbol", "_v")
    filled = im.proportional_backcast(long, ["_symbol"], ts, ["_v"], value, **kw)
    wide = filled.groupBy(ts).pivot("_symbol", names).agg(F.first("_v"))
    return out.select(*target.columns).join(wide, ts)


def merge_instruments_long(target: DataFrame, others: DataFrame, keys, symbol: str, ts: str, value: str,
                           target_col: str = "target", tolerance: float = 1e-8, **kw) -> DataFrame:
    """G29 for every target series and any number of instruments: (keys, ts, symbol, target, value).

    Each series is merged with all instruments on the union of its dates and theirs, missing instrument values are
    backcast proportionally to the series (D2), and an instrument that is zero throughout is left out of the
    series (B24).  Everything is keyed by series and symbol; symbols are read from the data and nothing is
    computed before the result is asked for.
    """
    keys = require_keys(keys)
    series = target.select(*keys, ts, F.col(value).alias(target_col))
    dates = al.every_date(target.select(*keys).distinct(), others.select(ts).distinct(), ts).unionByName(target.select(*keys, ts)).distinct()
    symbols = others.agg(F.collect_set(symbol).alias("_s"))  # one row: the names of the instruments
    grid = dates.join(symbols, F.col("_s").isNotNull()).select(*keys, ts, F.explode("_s").alias(symbol))
    long = grid.join(others.select(symbol, ts, value), [symbol, ts], "left").join(series, [*keys, ts], "left")
    filled = im.proportional_backcast(long, [*keys, symbol], ts, [value], target_col, **kw).select(*keys, ts, symbol, target_col, value)
    return filled.join(zero_throughout(filled, [*keys, symbol], value, tolerance), [*keys, symbol], "left_anti")


def zero_throughout(long: DataFrame, keys, value: str, tolerance: float = 1e-8) -> DataFrame:
    """B24 in long form: the keys whose every value is within ``tolerance`` of 0; one with a NULL is not among them."""
    keys = require_keys(keys)
    got = long.groupBy(*keys).agg(F.max(F.abs(F.col(value))).alias("_m"), F.count_if(F.col(value).isNull()).alias("_k"))
    return got.where((F.col("_k") == 0) & (F.col("_m") <= tolerance)).select(*keys)


def merge_on_dates_long(target: DataFrame, others: DataFrame, keys, symbol: str, ts: str, value: str, target_col: str = "target",
                        tolerance: float = 1e-8, **kw) -> DataFrame:
    """G29, inner form, for every target series: (keys, ts, symbol, target, value) on the dates that the series and
    every instrument have; instruments that are zero throughout go (B24), the others are backcast (D2)."""
    keys = require_keys(keys)
    common = al.align_inner_long(others, symbol, ts, value)
    out = common.join(target.select(*keys, ts, F.col(value).alias(target_col)), [ts])
    out = out.join(zero_throughout(out, [*keys, symbol], value, tolerance), [*keys, symbol], "left_anti")
    return im.proportional_backcast(out, [*keys, symbol], ts, [value], target_col, **kw).select(*keys, ts, symbol, target_col, value)


# G28 cleaning jobs ---------------------------------------------------------------
def clean_ohlc(raw: DataFrame, keys, proxy: DataFrame | None = None, date_format: str = "d/M/yyyy", price: str = "Price",
               out: str = "close", max_change: float = 0.03, **kw) -> DataFrame:
    """Index and futures files: (keys, ts, close) from text dates and prices with thousands separators.

    Incomplete rows and repeated rows go, then rows whose change from the row before is over ``max_change``
    (B22); with ``proxy`` (keys, ts, close) its older history is put in front (C8).
    """
    keys = require_keys(keys)
    d = raw.select(*keys, tx.parse_date(F.col("Date"), date_format).alias("ts"), tx.thousands_number(F.col(f"`{price}`")).alias(out))
    d = cl.distinct_rows(cl.drop_null_rows(d))
    d = cl.remove_outliers(d, keys, "ts", out, max_change)
    return d if proxy is None else al.splice_history(d, proxy.select(*keys, "ts", out), keys, "ts", **kw)


def clean_list(raw: DataFrame, symbol: str, min_rows: int = 4000, date_format: str = "M/d/yyyy") -> DataFrame:
    """Stock list files: (symbol, ts, close) of the symbols with at least ``min_rows`` rows; headers are cleaned."""
    d = cl.clean_headers(cl.min_history(raw, [symbol], min_rows))
    return d.select(symbol, tx.parse_date(F.col("Date"), date_format).alias("ts"), F.col("Close").try_cast("double").alias("close"))


def clean_external(raw: DataFrame, symbol: str, min_rows: int = 4500) -> DataFrame:
    """External instruments: mixed date texts as UTC dates, the first row of a date (by ``_seq``), symbols with
    at least ``min_rows`` dates."""
    d = raw.withColumnsRenamed({c: c.title() for c in ("close", "date") if c in raw.columns and c.title() not in raw.columns})
    d = d.select("_seq", symbol, tx.parse_instant_utc_date("Date").alias("ts"), F.col("Close").try_cast("double").alias("close"))
    return cl.min_history(cl.dedupe(d, [symbol, "ts"], keep="first").drop("_seq"), [symbol], min_rows)
