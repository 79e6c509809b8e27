"""Row-window indicators.

Every operator takes ``keys`` and an order column ``ts`` and runs through the
halo-block or bucket-scan machinery in ``sequence``; no window is ever keyed
by the series alone.  pandas ``rolling(n)`` is NULL until n values exist, so
rolling results are guarded by a count over the same frame.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import as_list, require_keys
from . import sequence as seq

LAGS = (1, 2, 3, 5, 10)
SMA_WINDOWS = (10, 20)
EMA_SPANS = (10, 20, 12, 26)


def _rolling(c: str, n: int, w, fn) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(F.col(c)).over(frame) == n, fn(F.col(c)).over(frame))


# E1 ------------------------------------------------------------------------
def lags(df: DataFrame, keys, ts: str, cols, lags: Sequence[int] = LAGS, **kw) -> DataFrame:
    cols, lags = as_list(cols), list(lags)
    return seq.bounded(df, keys, ts, lambda d, w: d.withColumns(
        {f"{c}_Lag{n}": F.lag(c, n).over(w) for c in cols for n in lags}),
        before=max(lags), **kw)


# E2 ------------------------------------------------------------------------
def sma(df: DataFrame, keys, ts: str, cols, windows: Sequence[int] = SMA_WINDOWS, **kw) -> DataFrame:
    cols, windows = as_list(cols), list(windows)
    return seq.bounded(df, keys, ts, lambda d, w: d.withColumns(
        {f"{c}_SMA_{n}": _rolling(c, n, w, F.avg) for c in cols for n in windows}),
        before=max(windows) - 1, **kw)


# E3 / E5 / E7 --------------------------------------------------------------
def ema(df: DataFrame, keys, ts: str, cols, spans: Sequence[int] = (10, 20), **kw) -> DataFrame:
    return seq.ema(df, keys, ts, as_list(cols), spans, bucket=kw.get("bucket", seq.DEFAULT_BUCKET))


def macd(df: DataFrame, keys, ts: str, cols, fast: int = 12, slow: int = 26, **kw) -> DataFrame:
    cols = as_list(cols)
    d = ema(df, keys, ts, cols, (fast, slow), **kw)
    return d.withColumns({f"{c}_MACD": F.col(f"{c}_EMA_{fast}") - F.col(f"{c}_EMA_{slow}") for c in cols})


def ema_ratio(df: DataFrame, keys, ts: str, cols, short: int = 10, long: int = 20) -> DataFrame:
    """Needs the two EMA columns already present; zero denominator -> NULL."""
    return df.withColumns({f"{c}_EMA_Ratio": F.try_divide(F.col(f"{c}_EMA_{short}"), F.col(f"{c}_EMA_{long}"))
                           for c in as_list(cols)})


# E4 ------------------------------------------------------------------------
def rsi_expr(d: DataFrame, c: str, n: int, w, name: str) -> DataFrame:
    """RSI(n), simple-mean version: first value at row n; loss 0 & gain > 0 -> 100; both 0 -> NULL."""
    delta = F.col(c) - F.lag(c, 1).over(w)
    d = d.withColumn(f"_g_{c}", F.when(delta > 0, delta).otherwise(F.lit(0.0))) \
         .withColumn(f"_l_{c}", F.when(delta < 0, -delta).otherwise(F.lit(0.0)))
    frame = w.rowsBetween(-(n - 1), 0)
    full = F.count(F.lit(1)).over(frame) == n
    g = F.when(full, F.avg(f"_g_{c}").over(frame))
    l_ = F.when(full, F.avg(f"_l_{c}").over(frame))
    d = d.withColumn(f"_ag_{c}", g).withColumn(f"_al_{c}", l_)
    ag, al = F.col(f"_ag_{c}"), F.col(f"_al_{c}")
    val = (F.when(al > 0, F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + ag / al))
           .when((al == 0) & (ag > 0), F.lit(100.0)))
    return d.withColumn(name, val).drop(f"_g_{c}", f"_l_{c}", f"_ag_{c}", f"_al_{c}")


def rsi(df: DataFrame, keys, ts: str, cols, window: int = 14, **kw) -> DataFrame:
    cols = as_list(cols)

    def compute(d, w):
        for c in cols:
            d = rsi_expr(d, c, window, w, f"{c}_RSI_{window}")
        return d
    return seq.bounded(df, keys, ts, compute, before=window, **kw)


# E6 ------------------------------------------------------------------------
def rolling_std(df: DataFrame, keys, ts: str, cols, window: int = 10, **kw) -> DataFrame:
    cols = as_list(cols)
    return seq.bounded(df, keys, ts, lambda d, w: d.withColumns(
        {f"{c}_RollingStd_{window}": _rolling(c, window, w, F.stddev_samp) for c in cols}),
        before=window - 1, **kw)


# E8 ------------------------------------------------------------------------
def feature_bundle(df: DataFrame, keys, ts: str, cols, *, dropna: bool = True,
                   block_rows: int = seq.DEFAULT_BLOCK_ROWS, bucket: str = seq.DEFAULT_BUCKET) -> DataFrame:
    """Lags 1,2,3,5,10; SMA 10/20; EMA 10/20; RSI 14; EMA 12/26 + MACD; std 10; EMA ratio.

    All bounded windows share one halo-block window spec (one exchange, one
    sort); the four EMAs share one bucket scan, run before the windows so
    neither pipeline is computed twice.  Rows with any NULL are
    dropped at the end (the 19 warm-up rows of SMA_20).
    """
    keys = require_keys(keys)
    cols = as_list(cols)

    def compute(d, w):
        new = {}
        for c in cols:
            for n in LAGS:
                new[f"{c}_Lag{n}"] = F.lag(c, n).over(w)
            for n in SMA_WINDOWS:
                new[f"{c}_SMA_{n}"] = _rolling(c, n, w, F.avg)
            new[f"{c}_RollingStd_10"] = _rolling(c, 10, w, F.stddev_samp)
        d = d.withColumns(new)
        for c in cols:
            d = rsi_expr(d, c, 14, w, f"{c}_RSI_14")
        return d

    # EMAs first on the base rows (one Python pass), which also gives the positions
    # from the counts of its own bucket summary; the halo windows then run on its output
    e = seq.ema(df, keys, ts, cols, EMA_SPANS, bucket=bucket, emit_rn=seq.RN)
    d = seq.bounded(e, keys, ts, compute, before=20, block_rows=block_rows)
    d = d.withColumns({f"{c}_MACD": F.col(f"{c}_EMA_12") - F.col(f"{c}_EMA_26") for c in cols})
    d = ema_ratio(d, keys, ts, cols)
    ordered = list(df.columns)
    for c in cols:
        ordered += [f"{c}_Lag{n}" for n in LAGS]
        ordered += [f"{c}_SMA_10", f"{c}_SMA_20", f"{c}_EMA_10", f"{c}_EMA_20", f"{c}_RSI_14",
                    f"{c}_EMA_12", f"{c}_EMA_26", f"{c}_MACD", f"{c}_RollingStd_10", f"{c}_EMA_Ratio"]
    d = d.select(*ordered)
    return d.na.drop("any") if dropna else d


# E9 ------------------------------------------------------------------------
def calendar_encoding(df: DataFrame, ts: str) -> DataFrame:
    """dow (Mon=0)/7 and month (Jan=0)/12 as sin/cos."""
    two_pi = 2.0 * math.pi
    dow = F.weekday(F.col(ts)).cast("double")
    mth = (F.month(F.col(ts)) - 1).cast("double")
    return df.withColumns({
        "dow_sin": F.sin(F.lit(two_pi) * dow / 7.0), "dow_cos": F.cos(F.lit(two_pi) * dow / 7.0),
        "month_sin": F.sin(F.lit(two_pi) * mth / 12.0), "month_cos": F.cos(F.lit(two_pi) * mth / 12.0)})


# E10 -----------------------------------------------------------------------
def pct_change(df: DataFrame, keys, ts: str, col: str, out: str | None = None, *,
               bucket: str = seq.DEFAULT_BUCKET) -> DataFrame:
    """(c / previous c) - 1 after a forward fill; previous 0 -> NULL; first row NULL.

    One bucket scan: the previous filled value is the local lag, or, on a
    bucket's first row, the last value carried in from earlier buckets.
    """
    keys = require_keys(keys)
    out = out or f"{col}_pct_change"
    d = df.withColumn(seq.TB, F.date_trunc(bucket, F.col(ts)))
    w = Window.partitionBy(*keys, seq.TB).orderBy(ts)
    summary = d.groupBy(*keys, seq.TB).agg(
        F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(ts))).alias("_s"))
    prior = Window.partitionBy(*keys).orderBy(seq.TB).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, seq.TB, F.last("_s", True).over(prior).alias("_carry"))
    d = d.join(carry, [*keys, seq.TB], "left")
    d = d.withColumn("_ff", F.coalesce(F.last(col, True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                                       F.col("_carry")))
    d = d.withColumn("_prev", F.coalesce(F.lag("_ff", 1).over(w), F.col("_carry")))
    return d.withColumn(out, F.try_divide(F.col("_ff"), F.col("_prev")) - 1).drop(
        "_ff", "_prev", "_carry", seq.TB)


# E11 -----------------------------------------------------------------------
def sliding_windows(df: DataFrame, keys, ts: str, col: str, input_len: int, horizon: int,
                    **kw) -> DataFrame:
    """One row per complete window: x = ``input_len`` values, y = next ``horizon`` values."""
    keys = require_keys(keys)
    L, H = int(input_len), int(horizon)

    def compute(d, w):
        one = F.struct(F.col(col).alias("v"), F.col(ts).alias("t"))  # a struct is collected also when its value is NULL
        d = d.withColumns({"_x": F.collect_list(one).over(w.rowsBetween(0, L - 1)), "_y": F.collect_list(one).over(w.rowsBetween(L, L + H - 1))})
        return d.withColumns({"x": F.transform("_x", lambda e: e["v"]), "y": F.transform("_y", lambda e: e["v"]),
                              "y_dates": F.transform("_y", lambda e: e["t"])}).drop("_x", "_y")

    d = seq.bounded(df, keys, ts, compute, after=L + H - 1, **kw)
    return (d.where((F.size("x") == L) & (F.size("y") == H))
            .select(*keys, F.col(ts).alias("origin"), "x", "y", "y_dates"))


# E12 -----------------------------------------------------------------------
def centred_mean_reflect(df: DataFrame, keys, ts: str, col: str, width: int = 7,
                         out: str | None = None, **kw) -> DataFrame:
    """Mean over ``width`` rows around each row, edges mirrored as often as needed (d c b a | a b c d).

    An even window reaches one row further back than ahead.
    """
    keys = require_keys(keys)
    h = width // 2
    out = out or f"{col}_smooth"
    sizes = seq.series_sizes(df, keys)

    def compute(d, w):
        offs = list(range(-h, h + 1))  # mirrored rows are never further away than h
        nb = {o: (F.col(col) if o == 0 else (F.lead(col, o) if o > 0 else F.lag(col, -o))).over(w)
              if o != 0 else F.col(col) for o in offs}
        d = d.withColumn("_nb", F.array(*[nb[o] for o in offs]))
        p = F.col(seq.RN) - 1
        n = F.col("_n")
        terms = []
        for k in range(-h, width - h):
            q = F.pmod(p + k, 2 * n)
            qr = F.when(q >= n, 2 * n - 1 - q).otherwise(q)
            idx = (qr - p + h + 1).cast("int")
            terms.append(F.element_at(F.col("_nb"), idx))
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return d.withColumn(out, total / float(width)).drop("_nb")

    d = seq.index_rows(df, keys, ts, bucket=kw.get("bucket", seq.DEFAULT_BUCKET)).join(sizes, keys)
    return seq.bounded(d, keys, ts, compute, before=h, after=h,
                       block_rows=kw.get("block_rows", seq.DEFAULT_BLOCK_ROWS)).drop("_n")


# E13 / E17 -----------------------------------------------------------------
def step_direction(df: DataFrame, keys, ts: str, col: str, base: float | str | None = None,
                   out: str = "direction", **kw) -> DataFrame:
    """+1 up / -1 down / 0 same vs the previous value; the first row vs ``base``."""
    base_col = F.col(base) if isinstance(base, str) else F.lit(base).cast("double")
    return seq.bounded(df, keys, ts, lambda d, w: d.withColumn(
        out, F.signum(F.col(col) - F.coalesce(F.lag(col, 1).over(w), base_col)).cast("int")),
        before=1, **kw)


def diff_sign(df: DataFrame, keys, ts: str, col: str, **kw) -> DataFrame:
    return seq.bounded(df, keys, ts, lambda d, w: d.withColumn(
        f"{col}_diff", F.col(col) - F.lag(col, 1).over(w)).withColumn(
        f"{col}_diff_sign", F.signum(F.col(f"{col}_diff")).cast("int")), before=1, **kw)


# E14 -----------------------------------------------------------------------
def compound(df: DataFrame, keys, ts: str, pct: str, base: str, out: str = "price", **kw) -> DataFrame:
    """price_t = base * prod_{s<=t} (1 + pct_s); ``base`` is a per-series column."""
    d = df.withColumn("_g", F.lit(1.0) + F.col(pct))
    d = seq.scan_product(d, keys, ts, "_g", "_cum", bucket=kw.get("bucket", seq.DEFAULT_BUCKET))
    return d.withColumn(out, F.col(base) * F.col("_cum")).drop("_g", "_cum")


# E15 -----------------------------------------------------------------------
def next_business_days(df: DataFrame, keys, ts: str, n: int, out: str = "ts") -> DataFrame:
    """(keys, step, ts): the next ``n`` Mon-Fri dates after each series' last date (no holidays)."""
    keys = require_keys(keys)
    last = df.groupBy(*keys).agg(F.max(F.to_date(F.col(ts))).alias("_last"))
    span = 2 * n + 3
    d = last.select(*keys, F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", span))).alias("_d"))
    d = d.where(F.weekday("_d") < 5)
    w = Window.partitionBy(*keys).orderBy("_d")  # each series has 2n+3 rows here, bounded
    return (d.withColumn("step", F.row_number().over(w)).where(F.col("step") <= n)
            .select(*keys, "step", F.col("_d").alias(out)))


# E16 -----------------------------------------------------------------------
def positions(df: DataFrame, keys, ts: str, *, bucket: str = seq.DEFAULT_BUCKET) -> DataFrame:
    """Adds ``rn`` (1 = oldest) and ``rn_desc`` (1 = newest) per series."""
    keys = require_keys(keys)
    d = seq.index_rows(df, keys, ts, bucket=bucket)
    sizes = seq.series_sizes(df, keys)
    return (d.join(sizes, keys).withColumn("rn_desc", F.col("_n") - F.col(seq.RN) + 1)
            .withColumnRenamed(seq.RN, "rn").drop("_n"))


def split_tail(df: DataFrame, keys, ts: str, test: int, val: int = 0, **kw) -> DataFrame:
    """Ordered split: last ``test`` rows 'test', the ``val`` before them 'val', rest 'train'."""
    d = positions(df, keys, ts, **kw)
    return d.withColumn("split", F.when(F.col("rn_desc") <= test, "test")
                        .when(F.col("rn_desc") <= test + val, "val").otherwise("train"))
