"""Rolling-origin backtest, forecaster registry and model comparison.

Fold i trains on all rows but the last ``H*(i+1)`` and predicts the next H;
``n_tests // H`` folds; the anchor row is the actual at position
``-(n_tests+1)``.  The baseline is placed on the true dates of the predicted
rows, the model on its own business-day calendar (dates on holidays then find
no actual and drop out of the inner join).

Native forecasters are expressions of a few per-origin statistics, so all
folds of all series are computed at once with joins on (series, position):
no loop over folds and no copy of the history per fold.  Scan forecasters
(smoothing, regressions) get the positioned rows of all series and return the
predictions of every fold from one pass.  Grouped forecasters, for models of
the user's own, receive per (series, fold) the training rows, produced by
exploding each row into the folds whose origin it precedes (a fan-out of
``n_tests // H``); such a function sees one series at a time by its nature.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import require_keys
from ..session import cut_lineage
from . import metrics as mt
from . import sequence as seq
from .indicators import positions


@dataclass(frozen=True)
class ForecastConfig:
    """Forecast configuration; all five values must be positive integers."""
    n_tests: int = 20
    n_forecasts: int = 2
    seasonal_periods: int = 261
    n_lags: int = 5
    epochs: int = 50

    def __post_init__(self):
        for name in ("n_tests", "n_forecasts", "seasonal_periods", "n_lags", "epochs"):
            v = getattr(self, name)
            if not isinstance(v, int) or isinstance(v, bool) or v <= 0:
                raise ValueError(f"{name} must be a positive integer")

    @property
    def n_folds(self) -> int:
        return self.n_tests // self.n_forecasts

    @property
    def min_rows(self) -> int:
        return max(self.n_tests + 1, self.n_tests + self.n_lags + self.n_forecasts)


# ---------------------------------------------------------------- registry
# A native forecaster maps origin statistics to a prediction column.
# Columns available: yo (value at origin), y1 (first value), o (origin position),
# step (1..H), mean_o (mean of values 1..o), ys (value one season back, see below).
NativeForecaster = Callable[[], Column]

NATIVE: dict[str, Callable[[], Column]] = {
    "naive": lambda: F.col("yo"),
    "drift": lambda: F.col("yo") + F.col("step") * F.try_divide(F.col("yo") - F.col("y1"), F.col("o") - 1),
    "mean": lambda: F.col("mean_o"),
    "seasonal_naive": lambda: F.col("ys"),
}

GROUPED: dict[str, Callable[[pd.DataFrame, ForecastConfig], list[float]]] = {}

#: name -> (forecaster over (pos, keys, value, cfg), rows a series must have)
SCANS: dict[str, tuple[Callable[[DataFrame, list[str], str, ForecastConfig], DataFrame], Callable[[ForecastConfig], int]]] = {}


def register_scan(name: str, need_rows: Callable[[ForecastConfig], int] = lambda cfg: cfg.min_rows):
    """Register ``fn(pos, keys, value, cfg) -> (keys, fold, step, o, ots, yhat)`` for all folds at once."""
    def deco(fn):
        SCANS[name] = (fn, need_rows)
        return fn
    return deco


def register_grouped(name: str):
    """Register ``fn(history_pdf, config) -> list of H predictions``."""
    def deco(fn):
        GROUPED[name] = fn
        return fn
    return deco


def resolve(name: str) -> str:
    from . import composition, regress, smoothing  # noqa: F401  their forecasters register themselves
    if name in NATIVE or name in GROUPED or name in SCANS:
        return name
    supported = ", ".join(sorted([*NATIVE, *GROUPED, *SCANS]))
    raise ValueError(f"Unsupported model '{name}'. Supported models: {supported}")


def rows_needed(name: str, cfg: ForecastConfig) -> int:
    """Rows that a series must have for a model's backtest."""
    if name in SCANS:
        return max(cfg.min_rows, SCANS[name][1](cfg))
    if name == "seasonal_naive":
        return max(cfg.min_rows, cfg.n_folds * cfg.n_forecasts + cfg.seasonal_periods)
    return cfg.min_rows


# ---------------------------------------------------------------- building blocks
def _or_raise(c: Column, kind: str, message: str) -> Column:
    return F.coalesce(c.try_cast(kind), F.raise_error(F.lit(message)).cast(kind))


def prepare(df: DataFrame, keys, ts: str, value: str, what: str = "input") -> DataFrame:
    """(keys, ts, y) with dates and numbers checked and one row per (keys, ts), the last by ``_seq``.

    An invalid or NULL date or number fails the job that reads it, with its own message.  Without an ingest
    ordinal a second row for a date is an error of the same kind.
    """
    from .clean import dedupe
    keys = require_keys(keys)
    missing = [c for c in [*keys, ts, value] if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns in {what}: {', '.join(missing)}")
    kind = df.schema[ts].dataType.simpleString()
    as_ts = F.col(ts) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(ts).try_cast("date")
    kind = kind if kind in ("date", "timestamp", "timestamp_ntz") else "date"
    d = df.select(*keys, _or_raise(as_ts, kind, f"{what} contains invalid dates in {ts}").alias("ts"),
                  _or_raise(F.col(value), "double", f"{what} contains invalid numbers in {value}").alias("y"),
                  *([F.col("_seq")] if "_seq" in df.columns else []))
    return dedupe(d, [*keys, "ts"], keep="last").drop("_seq") if "_seq" in df.columns else d


def origins(pos: DataFrame, keys: list[str], value: str, cfg: ForecastConfig) -> DataFrame:
    """One row per (keys, fold): fold -1 is the final forecast from the last row."""
    h = cfg.n_forecasts
    rd = F.col("rn_desc")
    o = pos.where(((rd - 1) % h == 0) & (rd <= cfg.n_folds * h + 1))
    return o.select(*keys, (F.floor((rd - 1) / h) - 1).cast("int").alias("fold"),
                    F.col("rn").alias("o"), F.col("ts").alias("ots"), F.col(value).alias("yo"))


def own_dates(orig: DataFrame, keys: list[str], h: int) -> DataFrame:
    """(keys, fold, step, ts): the next h Mon-Fri dates after each origin date."""
    d = orig.select(*keys, "fold", F.explode(F.sequence(F.date_add("ots", 1), F.date_add("ots", 2 * h + 3)))
                    .alias("ts")).where(F.weekday("ts") < 5)
    from pyspark.sql import Window
    w = Window.partitionBy(*keys, "fold").orderBy("ts")  # 2h+3 rows per group, bounded
    return d.withColumn("step", F.row_number().over(w)).where(F.col("step") <= h)


def native_predictions(pos: DataFrame, keys: list[str], value: str, cfg: ForecastConfig, name: str,
                       first: DataFrame | None = None, **kw) -> DataFrame:
    """(keys, fold, step, o, ots, yhat) for every fold origin, all folds at once."""
    fn = NATIVE[name]
    orig = origins(pos, keys, value, cfg)
    if first is None:
        first = pos.where(F.col("rn") == 1).select(*keys, F.col(value).alias("y1"))
    st = orig.join(first, keys).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(cfg.n_forecasts))))
    if name == "mean":
        cum = seq.scan_sum(pos.select(*keys, "ts", "rn", value), keys, "ts", value, "_cum",
                           bucket=kw.get("bucket", seq.DEFAULT_BUCKET))
        st = st.join(cum.select(*keys, F.col("rn").alias("o"), (F.col("_cum") / F.col("rn")).alias("mean_o")),
                     [*keys, "o"])
    if name == "seasonal_naive":
        m = cfg.seasonal_periods
        st = st.withColumn("_src", F.col("o") - m + ((F.col("step") - 1) % m) + 1)
        st = st.join(pos.select(*keys, F.col("rn").alias("_src"), F.col(value).alias("ys")), [*keys, "_src"], "left")
    return st.withColumn("yhat", fn())


def grouped_predictions(pos: DataFrame, keys: list[str], value: str, cfg: ForecastConfig, name: str) -> DataFrame:
    """(keys, fold, step, o, ots, yhat) from a grouped forecaster, one Arrow group per (series, fold)."""
    fn = GROUPED[name]
    orig = origins(pos, keys, value, cfg)
    folds = orig.select(*keys, "fold", "o")
    # each row joins the folds whose origin it does not exceed (<= n_folds + 1 per row)
    train = pos.join(folds, keys).where(F.col("rn") <= F.col("o"))
    h = cfg.n_forecasts
    key_types = ", ".join(f"`{k}` {pos.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{key_types}, fold int, step int, yhat double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        preds = list(fn(pdf[[*keys, "ts", value]].rename(columns={value: "y"}), cfg))
        if len(preds) != h:
            raise ValueError(f"Model '{name}' returned {len(preds)} values, expected {h}")
        base = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame({**{k: [v] * h for k, v in base.items()}, "fold": [int(pdf["fold"].iloc[0])] * h,
                             "step": list(range(1, h + 1)), "yhat": [float(x) for x in preds]})

    preds = train.groupBy(*keys, "fold").applyInPandas(run, schema)
    return preds.join(orig, [*keys, "fold"])


def predictions(pos, keys, value, cfg, name, **kw) -> DataFrame:
    name = resolve(name)
    if name in NATIVE:
        return native_predictions(pos, keys, value, cfg, name, **kw)
    if name in SCANS:
        return SCANS[name][0](pos, keys, value, cfg)
    return grouped_predictions(pos, keys, value, cfg, name)


@dataclass
class Artifacts:
    """``rejected``: (keys, rows, needed) of series too short for the run; they are in no other table."""
    final: DataFrame
    metrics: DataFrame
    forecast: DataFrame
    rejected: DataFrame


def _checked(preds: DataFrame, name: str) -> DataFrame:
    """A model's predictions must be numbers."""
    bad = F.col("yhat").isNull() | F.isnan("yhat")
    return preds.withColumn("yhat", F.when(bad, F.raise_error(F.lit(f"{name} returned invalid predictions")).cast("double")).otherwise(F.col("yhat")))


def run_backtest(df: DataFrame, keys, ts: str, value: str, cfg: ForecastConfig = ForecastConfig(),
                 model: str = "drift", baseline: str = "naive", materialize: bool = True, strict: bool = False,
                 shared: dict | None = None, **kw) -> Artifacts:
    """Rolling-origin backtest -> (final, metrics, forecast, rejected) tables for all series.

    Input is checked first (G19) and predictions before they are used (G17).  A series with fewer rows than
    the run and its models need goes to ``rejected``; with ``strict`` it raises instead.  ``final`` holds the
    last ``n_tests`` joined rows of a series; metrics are taken before that cut, over the anchor row too.

    Everything after the positions pass works on the tail of each series (``n_tests + 1`` rows and the fold
    origins), which is small; with ``materialize`` that tail, and the predictions of fitted models (n_tests +
    H rows a series), are checkpointed to the shared checkpoint folder so that the artifacts reuse them.
    ``shared`` (see ``run_all``) carries the positioned rows and predictions from run to run.
    """
    keys = require_keys(keys)
    shared = {} if shared is None else shared
    need = max(rows_needed(resolve(m), cfg) for m in (model, baseline, *shared.get("models", ())))
    every = shared.get("every")
    if every is None:
        every = positions(prepare(df, keys, ts, value), keys, "ts", bucket=kw.get("bucket", seq.DEFAULT_BUCKET))
        if "models" in shared:
            shared["every"] = every = cut_lineage(every)
    rows = F.col("rn") + F.col("rn_desc") - 1
    rejected = every.where((F.col("rn") == 1) & (rows < need)).select(*keys, rows.alias("rows"), F.lit(need).alias("needed"))
    if strict and (short := rejected.take(1)):
        raise ValueError(f"Insufficient rows for series {tuple(short[0])[:len(keys)]}: need at least {need}, got {short[0]['rows']}")
    pos = every.where(rows >= need)
    nt = cfg.n_tests
    depth = max(nt + 1, cfg.n_folds * cfg.n_forecasts + 1)
    first = pos.where(F.col("rn") == 1).select(*keys, F.col("y").alias("y1"))
    tail = pos.where(F.col("rn_desc") <= depth).join(first, keys)
    if materialize:
        tail = cut_lineage(tail)
    first = tail.where(F.col("rn_desc") == 1).select(*keys, "y1")
    tail = tail.drop("y1")
    anchor = tail.where(F.col("rn_desc") == nt + 1).select(*keys, "ts", F.col("y").alias("yhat"),
                                                           F.lit(0).alias("model_fold"))

    def preds(name):
        if name in NATIVE and name not in ("mean", "seasonal_naive"):
            return _checked(native_predictions(tail, keys, "y", cfg, name, first=first, **kw), name)
        if name not in shared:
            p = _checked(predictions(pos, keys, "y", cfg, name, **kw), name)
            shared[name] = cut_lineage(p) if materialize and name not in NATIVE else p
        return shared[name]

    b = preds(baseline).where(F.col("fold") >= 0)
    b = b.withColumn("rn", F.col("o") + F.col("step")).join(tail.select(*keys, "rn", "ts"), [*keys, "rn"])
    base = b.select(*keys, "ts", "yhat").unionByName(anchor.drop("model_fold"))

    m_all = preds(model)
    dates = own_dates(origins(tail, keys, "y", cfg), keys, cfg.n_forecasts)
    m_all = m_all.join(dates, [*keys, "fold", "step"])
    # folds can put two predictions on one date; model_fold (1 = newest fold) orders them
    mod = m_all.where(F.col("fold") >= 0).select(*keys, "ts", "yhat", (F.col("fold") + 1).alias("model_fold")) \
        .unionByName(anchor)

    actual = tail.where(F.col("rn_desc") <= nt + 1).select(*keys, "ts", F.col("y").alias("actual"))
    joined = actual.join(base.withColumnRenamed("yhat", "baseline")
                         .join(mod.withColumnRenamed("yhat", "predicted"), [*keys, "ts"]), [*keys, "ts"])
    if materialize:  # n_tests + 1 rows a series, read by the final table and several metrics
        joined = cut_lineage(joined)
    forecast = m_all.where(F.col("fold") == -1).select(*keys, "step", "ts",
                                                        F.col("yhat").alias("Future Predictions"))
    metrics = mt.model_comparison(joined, keys, "ts", "actual", {baseline: "baseline", model: "predicted"},
                                  nt, cfg.n_forecasts, block_rows=kw.get("block_rows", seq.DEFAULT_BLOCK_ROWS),
                                  tiebreak=["model_fold"])
    from pyspark.sql import Window
    newest = Window.partitionBy(*keys).orderBy(F.col("ts").desc(), F.col("model_fold").desc())  # about n_tests rows
    final = joined.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= nt).drop("_r")
    return Artifacts(final, metrics, forecast, rejected)


def run_all(df: DataFrame, keys, ts: str, value: str, models, cfg: ForecastConfig = ForecastConfig(),
            baseline: str = "naive", **kw) -> Artifacts:
    """Every configured model; the model name becomes another key of the outputs."""
    shared = {"models": (baseline, *models)}  # positions and predictions are made once; all models run on the same series
    outs = [run_backtest(df, keys, ts, value, cfg, model=m, baseline=baseline, shared=shared, **kw) for m in models]
    tag = [(o, m) for o, m in zip(outs, models)]
    final = tag[0][0].final.withColumn("model", F.lit(tag[0][1]))
    metrics = tag[0][0].metrics.withColumn("run_model", F.lit(tag[0][1]))
    fc = tag[0][0].forecast.withColumn("model", F.lit(tag[0][1]))
    out = tag[0][0].rejected.withColumn("model", F.lit(tag[0][1]))
    for o, m in tag[1:]:
        final = final.unionByName(o.final.withColumn("model", F.lit(m)))
        metrics = metrics.unionByName(o.metrics.withColumn("run_model", F.lit(m)))
        fc = fc.unionByName(o.forecast.withColumn("model", F.lit(m)))
        out = out.unionByName(o.rejected.withColumn("model", F.lit(m)))
    return Artifacts(final, metrics, fc, out)


def diagonal_pick(wide: DataFrame, keys, ts: str, prefix: str = "yhat", horizon: int = 2,
                  **kw) -> DataFrame:
    """From wide ``yhat1..yhatN`` rows, the row k steps into the future block takes ``yhat{k}``.

    Rows of the future block are those where any ``yhat`` is present; position
    within the block is the row number among them.
    """
    keys = require_keys(keys)
    cols = [f"{prefix}{k}" for k in range(1, horizon + 1)]
    fut = wide.where(F.coalesce(*[F.col(c) for c in cols]).isNotNull())
    pos = seq.index_rows(fut, keys, ts, **kw)
    long = pos.unpivot([*keys, ts, seq.RN], cols, "_which", "_v")
    return (long.where(F.col("_which") == F.concat(F.lit(prefix), F.col(seq.RN).cast("string")))
            .select(*keys, ts, F.col("_v").alias("yhat")))


def normalize_predictions(pred: DataFrame, keys, ts: str, value: str, horizon: int, model: str) -> DataFrame:
    """The last ``horizon`` rows per keys, with dates and numbers checked.

    Missing columns raise at once; a block of fewer than ``horizon`` rows, an invalid date or an invalid
    number fails the job that reads it, naming the model.
    """
    keys = require_keys(keys)
    missing = [c for c in [ts, value] if c not in pred.columns]
    if missing:
        raise ValueError(f"{model} forecast is missing required columns: {', '.join(missing)}")
    d = pred.withColumns({ts: _or_raise(F.col(ts), "date", f"{model} returned invalid prediction dates"),
                          value: _or_raise(F.col(value), "double", f"{model} returned invalid predictions")})
    pos = positions(d, keys, ts)
    short = F.col("rn") + F.col("rn_desc") - 1 < horizon
    told = F.when(short, F.raise_error(F.concat(F.lit(f"{model} returned "), (F.col("rn") + F.col("rn_desc") - 1).cast("string"),
                                                F.lit(f" predictions; expected at least {horizon}"))).cast("double")).otherwise(F.col(value))
    return pos.where(F.col("rn_desc") <= horizon).withColumn(value, told).drop("rn", "rn_desc")
