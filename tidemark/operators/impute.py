"""Missing data and calendar operators.

Fills are unbounded scans, so they run as bucket-local scans plus a carry
over the small per-bucket table (see ``sequence``), never as one window over
a whole series.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import as_list, require_keys
from . import sequence as seq


# D1 / D7 / D8 ----------------------------------------------------------------
def ffill(df: DataFrame, keys, ts: str, cols, **kw) -> DataFrame:
    return seq.scan_last(df, keys, ts, as_list(cols), **kw)


def bfill(df: DataFrame, keys, ts: str, cols, **kw) -> DataFrame:
    return seq.scan_first(df, keys, ts, as_list(cols), **kw)


def ffill_bfill(df: DataFrame, keys, ts: str, cols, **kw) -> DataFrame:
    """Forward fill, then backward fill the leading gap.

    After a forward fill only the leading gap is empty, and its backward fill
    is the first known value; so the result is coalesce(ffill, bfill) of the
    original column, both taken in one pass.
    """
    cols = as_list(cols)
    d = seq.scan_both(df, keys, ts, cols, prev=lambda c: f"_ff_{c}", nxt=lambda c: f"_bf_{c}", **kw)
    d = d.withColumns({c: F.coalesce(F.col(f"_ff_{c}"), F.col(f"_bf_{c}")) for c in cols})
    return d.drop(*[f"_ff_{c}" for c in cols], *[f"_bf_{c}" for c in cols])


def zero_fill(df: DataFrame, cols) -> DataFrame:
    """Event columns NULL -> 0."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in as_list(cols)})


def append_future(history: DataFrame, future: DataFrame, keys, ts: str, condition_cols, **kw) -> DataFrame:
    """Re-append held-back future rows and forward fill condition columns."""
    return ffill(history.unionByName(future, allowMissingColumns=True), keys, ts, condition_cols, **kw)


# D2 --------------------------------------------------------------------------
def proportional_backcast(df: DataFrame, keys, ts: str, cols, target: str, *,
                          bucket: str = seq.DEFAULT_BUCKET) -> DataFrame:
    """Walking backwards, a NULL ``c[i]`` next to a known ``c[i+1]`` becomes
    ``c[i+1] * t[i] / t[i+1]``, repeatedly.

    The recursion telescopes to ``c[i] = c[j] * t[i] / t[j]`` with ``j`` the next
    row whose ``c`` is known, provided no ``t`` in ``(i, j]`` is NULL or 0 and
    ``t[i]`` is not NULL (otherwise the chain breaks and the row stays NULL).
    Trailing NULLs (no known value after) stay NULL.

    One (series, bucket) pass: inside a bucket the next known value and the
    running count of broken targets come from windows; across buckets a summary
    per bucket (total broken count, first known value with its in-bucket broken
    prefix) is scanned on the small bucket table.
    """
    keys = require_keys(keys)
    cols = as_list(cols)
    t = F.col(target)
    tb = seq.TB
    d = df.withColumn(tb, F.date_trunc(bucket, F.col(ts))).withColumn(
        "_bad", (t.isNull() | (t == 0)).cast("long"))
    w = Window.partitionBy(*keys, tb).orderBy(ts)
    d = d.withColumn("_lcb", F.sum("_bad").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    after = w.rowsBetween(0, Window.unboundedFollowing)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("c"), t.alias("t"), F.col("_lcb").alias("b")))
             for c in cols}
    d = d.withColumns({f"_ln_{c}": F.first(known[c], True).over(after) for c in cols})
    summary = d.groupBy(*keys, tb).agg(
        F.sum("_bad").alias("_tot"),
        *[F.min_by(known[c], F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_fk_{c}") for c in cols])
    wb = Window.partitionBy(*keys).orderBy(tb)
    summary = summary.withColumn("_before", F.coalesce(
        F.sum("_tot").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # first known value in a later bucket, with the broken count from the series start up to it
    later = wb.rowsBetween(1, Window.unboundedFollowing)
    carry = summary.select(*keys, tb, "_tot", "_before", *[
        F.first(F.when(F.col(f"_fk_{c}").isNotNull(),
                       F.struct(F.col(f"_fk_{c}.c").alias("c"), F.col(f"_fk_{c}.t").alias("t"),
                                (F.col("_before") + F.col(f"_fk_{c}.b")).alias("g"))), True)
        .over(later).alias(f"_cn_{c}") for c in cols])
    d = d.join(carry, [*keys, tb], "left")
    fills = {}
    for c in cols:
        ln, cn = F.col(f"_ln_{c}"), F.col(f"_cn_{c}")
        # broken targets in (i, j]: same bucket from the local prefixes, else via global prefixes
        broken = F.when(ln.isNotNull(), ln["b"] - F.col("_lcb")) \
            .otherwise(cn["g"] - (F.col("_before") + F.col("_lcb")))
        nv = F.when(ln.isNotNull(), ln["c"]).otherwise(cn["c"])
        nt = F.when(ln.isNotNull(), ln["t"]).otherwise(cn["t"])
        ok = F.col(c).isNull() & nv.isNotNull() & t.isNotNull() & (broken == 0)
        fills[c] = F.when(ok, nv * t / nt).otherwise(F.col(c))
    d = d.withColumns(fills)
    return d.drop(tb, "_bad", "_lcb", "_tot", "_before", *[f"_ln_{c}" for c in cols],
                  *[f"_cn_{c}" for c in cols])


# D3 --------------------------------------------------------------------------
def densify_business_days(df: DataFrame, keys, ts: str) -> DataFrame:
    """D3: per series, every Mon-Fri date between its first and last date; new rows NULL.

    Like ``asfreq('B')``, rows on weekends drop out.  The calendar is exploded
    from each series' (min, max) pair; the join is on (keys, ts), so a long
    series spreads over many partitions.
    """
    keys = require_keys(keys)
    span = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    cal = (span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias(ts))
           .where(F.weekday(ts) < 5))
    return cal.join(df, [*keys, ts], "left")


# D4 / D5 / D10 -----------------------------------------------------------------
def drop_trailing_nulls(df: DataFrame, keys, ts: str, cols, how: str = "any_null") -> DataFrame:
    """D4 (one target column) / D5 (all regressors NULL): drop trailing rows per series.

    A row is kept when its ``ts`` is at or before the last row where the
    target is present (D4) or where any of the columns is present (D5).
    """
    keys = require_keys(keys)
    cols = as_list(cols)
    present = F.coalesce(*[F.col(c) for c in cols]).isNotNull() if len(cols) > 1 else F.col(cols[0]).isNotNull()
    last = df.groupBy(*keys).agg(F.max(F.when(present, F.col(ts))).alias("_last_valid"))
    return df.join(last, keys).where(F.col(ts) <= F.col("_last_valid")).drop("_last_valid")


def trailing_rows(df: DataFrame, keys, ts: str, cols) -> DataFrame:
    """D4 companion: the rows that were held aside."""
    keys = require_keys(keys)
    cols = as_list(cols)
    present = F.coalesce(*[F.col(c) for c in cols]).isNotNull()
    last = df.groupBy(*keys).agg(F.max(F.when(present, F.col(ts))).alias("_last_valid"))
    return df.join(last, keys).where((F.col(ts) > F.col("_last_valid")) | F.col("_last_valid").isNull()) \
        .drop("_last_valid")


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """Drop rows with NULL target (used when no lags are used)."""
    return df.where(F.col(target).isNotNull())


# D6 --------------------------------------------------------------------------
def interpolate_then_rolling(df: DataFrame, keys, ts: str, col: str, limit_linear: int = 5,
                             rolling: int = 20, out: str | None = None, **kw) -> DataFrame:
    """Linear interpolation by row position for gaps within ``limit_linear`` rows
    of a known value on either side (edges take the nearest known value within the
    limit), then remaining NULLs take the mean of the step-1 values in a centred
    window of ``rolling`` rows (NULL if none).
    """
    keys = require_keys(keys)
    out = out or col
    d = seq.index_rows(df, keys, ts, bucket=kw.get("bucket", seq.DEFAULT_BUCKET))
    d = d.withColumn("_kv", F.when(F.col(col).isNotNull(), F.struct(F.col(col).alias("v"), F.col(seq.RN).alias("p"))))
    d = seq.scan_both(d, keys, ts, ["_kv"], prev=lambda c: "_prev", nxt=lambda c: "_next",
                      bucket=kw.get("bucket", seq.DEFAULT_BUCKET))
    p = F.col(seq.RN)
    pv, pp, nv, np_ = F.col("_prev.v"), F.col("_prev.p"), F.col("_next.v"), F.col("_next.p")
    near_prev = F.col("_prev").isNotNull() & (p - pp <= limit_linear)
    near_next = F.col("_next").isNotNull() & (np_ - p <= limit_linear)
    both = F.col("_prev").isNotNull() & F.col("_next").isNotNull()
    lin = pv + (nv - pv) * (p - pp).cast("double") / (np_ - pp).cast("double")
    step1 = (F.when(F.col(col).isNotNull(), F.col(col))
             .when(both & (near_prev | near_next), lin)
             .when(near_prev & F.col("_next").isNull(), pv)
             .when(near_next & F.col("_prev").isNull(), nv))
    d = d.withColumn("_s1", step1).drop("_kv", "_prev", "_next")
    # centred like pandas: an even window leans back, [i - R//2, i + (R-1)//2]
    lo, hi = -(rolling // 2), (rolling - 1) // 2

    def compute(x, w):
        return x.withColumn(out, F.coalesce(F.col("_s1"), F.avg("_s1").over(w.rowsBetween(lo, hi))))

    res = seq.bounded(d, keys, ts, compute, before=-lo, after=hi,
                      block_rows=kw.get("block_rows", seq.DEFAULT_BLOCK_ROWS))
    return res.drop("_s1")


# D9 --------------------------------------------------------------------------
def gap_distribution(df: DataFrame, keys, ts: str, **kw) -> DataFrame:
    """(keys, gap_seconds, n) histogram of gaps between consecutive timestamps."""
    keys = require_keys(keys)
    # timestamp_diff counts wall-clock seconds for TIMESTAMP_NTZ and elapsed seconds
    # for TIMESTAMP, so the result does not depend on the session time zone
    d = seq.bounded(df.select(*keys, ts), keys, ts,
                    lambda x, w: x.withColumn("gap_seconds", F.timestamp_diff(
                        "SECOND", F.lag(ts, 1).over(w), F.col(ts))), before=1, **kw)
    return d.where(F.col("gap_seconds").isNotNull()).groupBy(*keys, "gap_seconds").agg(F.count(F.lit(1)).alias("n"))
