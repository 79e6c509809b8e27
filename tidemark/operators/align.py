"""Joins, alignment and set operations.

Many-instrument alignment stays in long form ``(symbol, ts, value)``; going
wide is one ``pivot`` with an explicit value list (no extra job to discover
the values), instead of N chained joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import as_list, require_keys
from ..session import cut_lineage
from . import sequence as seq
from .impute import ffill_bfill


# C1 / C2 / C3 / C7 -------------------------------------------------------------
def inner_on(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner equi-join on (keys, ts)."""
    return a.join(b, as_list(on), "inner")


def outer_on(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer equi-join; USING semantics coalesce the join columns."""
    return a.join(b, as_list(on), "full")


def three_way(actual: DataFrame, baseline: DataFrame, model: DataFrame, on: Sequence[str]) -> DataFrame:
    """Actual JOIN (baseline JOIN model), all inner."""
    return actual.join(baseline.join(model, as_list(on), "inner"), as_list(on), "inner")


def union_all(*frames: DataFrame) -> DataFrame:
    """Concat by column name, missing columns NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# C4 / C5 -----------------------------------------------------------------------
def _check_values(values: Sequence[str]) -> list[str]:
    vals = list(values)
    if not vals:
        raise ValueError("pivot needs an explicit, non-empty list of symbols")
    return vals


def align_inner(long: DataFrame, symbol: str, ts: str, value: str, symbols: Sequence[str]) -> DataFrame:
    """C4: one row per ``ts`` that every listed symbol has; one column per symbol.

    A column per symbol is a form for the edge; ``align_inner_long`` is the same set of rows in long form.
    """
    vals = _check_values(symbols)
    wide = (long.where(F.col(symbol).isin(vals))
            .groupBy(ts).pivot(symbol, vals).agg(F.first(value)))
    return wide.where(F.size(F.array_compact(F.array(*[F.col(f"`{v}`") for v in vals]))) == len(vals))


def align_inner_long(long: DataFrame, symbol: str, ts: str, value: str, n_symbols: int | None = None) -> DataFrame:
    """C4 in long form, for any number of symbols: the rows of each ``ts`` at which ``n_symbols`` have a value
    (by default as many as the data hold)."""
    known = long.where(F.col(value).isNotNull())
    full = known.groupBy(ts).agg(F.count_distinct(symbol).alias("_k"))
    if n_symbols is None:  # one row, joined as such
        full = full.join(known.agg(F.count_distinct(symbol).alias("_all")), F.col("_k") == F.col("_all"))
    else:
        full = full.where(F.col("_k") == n_symbols)
    return known.join(full.select(ts), [ts], "left_semi")


def every_date(items: DataFrame, dates: DataFrame, ts: str) -> DataFrame:
    """Every row of ``items`` at every date of ``dates`` (both distinct), spread by month.

    The months between the first and the last date come with each item; dates join by month, so neither list is
    gathered and no join is without a key.
    """
    span = dates.agg(F.date_trunc("month", F.min(ts)).alias("_m0"), F.date_trunc("month", F.max(ts)).alias("_m1"))  # one row
    month = F.explode(F.sequence("_m0", "_m1", F.expr("interval 1 month"))).alias("_m")
    spread = items.join(span, F.col("_m0").isNotNull()).select(*items.columns, month)
    return spread.join(dates.select(ts, F.date_trunc("month", F.col(ts)).alias("_m")), "_m").drop("_m")


#: Distinct dates up to which their places go with every task; more are joined by a shuffle.
FEW_DATES = 1_000_000
#: Dates that one step of the spreading makes of a row.
STRETCH = 4096


def align_outer_long(long: DataFrame, symbol: str, ts: str, value: str, **kw) -> DataFrame:
    """C5 in long form, for any number of symbols: every symbol at every ``ts`` that any symbol has, gaps forward-
    then backward-filled per symbol.  Symbols and dates are read from the data; nothing is pivoted.

    The fill runs over the given rows alone.  A filled row then stands for the dates from its own up to the symbol's
    next row (the first row also for those before), so the grid is made at the end and is never shuffled or sorted.
    """
    long = long.select(symbol, ts, value)
    dates = cut_lineage(long.where(F.col(ts).isNotNull()).select(ts).distinct())  # one column of the result
    place = seq.index_rows(dates.withColumn("_of", F.lit(1)), ["_of"], ts).drop("_of")
    near = F.broadcast if dates.count() <= FEW_DATES else (lambda d: d)
    ends = place.agg(F.coalesce(F.max(seq.RN), F.lit(0)).alias("_n"))  # one row

    known = long.where(F.col(symbol).isNotNull() & F.col(ts).isNotNull()).join(near(place), ts).withColumnRenamed(seq.RN, "_a")
    filled = ffill_bfill(known, [symbol], ts, [value], **kw)
    row = seq.next_row(filled, [symbol], ts, "_a", "_b", "_first", bucket=kw.get("bucket", seq.DEFAULT_BUCKET))
    # a symbol without a row that has a place in a series: no value at any date
    bare = long.groupBy(symbol).agg(F.count(ts).alias("_k")).where(F.col(symbol).isNull() | (F.col("_k") == 0))
    bare = bare.select(symbol, F.lit(None).cast(long.schema[value].dataType).alias(value), F.lit(1).cast("long").alias("_a"),
                       F.lit(None).cast("long").alias("_b"), F.lit(True).alias("_first"))
    stretch = row.select(symbol, value, "_a", "_b", "_first").unionByName(bare).join(F.broadcast(ends), F.col("_n") > 0)
    start = F.when(F.col("_first"), F.lit(1).cast("long")).otherwise(F.col("_a"))
    # rows that repeat a date are kept, each at its own place
    stretch = stretch.select(symbol, value, start.alias("_a"), F.greatest(F.coalesce(F.col("_b") - 1, F.col("_n")), F.col("_a")).alias("_z"))
    part = F.explode(F.sequence(F.floor(F.col("_a") / STRETCH), F.floor(F.col("_z") / STRETCH)))
    stretch = stretch.withColumn("_c", part)
    each = F.sequence(F.greatest(F.col("_a"), F.col("_c") * STRETCH), F.least(F.col("_z"), (F.col("_c") + 1) * STRETCH - 1))
    grid = stretch.select(symbol, value, F.explode(each).alias(seq.RN))
    return grid.join(near(place), seq.RN).select(symbol, ts, value)


def align_outer_filled(long: DataFrame, symbol: str, ts: str, value: str, symbols: Sequence[str],
                       **kw) -> DataFrame:
    """Every ``ts`` any symbol has; gaps forward- then backward-filled per symbol.

    The dense (ts x symbol) grid comes from pivot -> unpivot (no cross join);
    the fill runs keyed by symbol in long form; then one final pivot.
    """
    vals = _check_values(symbols)
    wide = long.where(F.col(symbol).isin(vals)).groupBy(ts).pivot(symbol, vals).agg(F.first(value))
    grid = wide.unpivot(ts, [F.col(f"`{v}`") for v in vals], symbol, value)
    filled = ffill_bfill(grid, [symbol], ts, [value], **kw)
    return filled.groupBy(ts).pivot(symbol, vals).agg(F.first(value))


# C6 ----------------------------------------------------------------------------
def asof_backward(probe: DataFrame, ref: DataFrame, keys, ts: str, value: str, out: str | None = None,
                  **kw) -> DataFrame:
    """For each probe row, the reference value at the same ``ts`` or the last earlier one.

    Written as union + forward fill keyed by series (reference rows sort before
    probe rows at equal ``ts``), so the lookup is one bucket scan, not a
    per-row range join.
    """
    keys = require_keys(keys)
    out = out or value
    p = probe.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast("double"))
    r = ref.select(*keys, ts, F.col(value).cast("double").alias("_v")).withColumn("_side", F.lit(0))
    u = p.unionByName(r, allowMissingColumns=True)
    f = seq.scan_last(u, keys, ts, ["_v"], tiebreak=["_side"], **kw)
    return f.where(F.col("_side") == 1).withColumnRenamed("_v", out).drop("_side")


# C8 ----------------------------------------------------------------------------
def splice_history(target: DataFrame, proxy: DataFrame, keys, ts: str, mode: str = "count", **kw) -> DataFrame:
    """Prepend a proxy's older history to a target series.

    ``mode="count"`` reproduces concat-then-drop-last-len(target): proxy rows
    with ascending position <= count(proxy) - count(target), then the target.
    ``mode="by_date"`` takes proxy rows strictly before the target's first date.
    """
    keys = require_keys(keys)
    cols = target.columns
    if mode == "by_date":
        first = target.groupBy(*keys).agg(F.min(ts).alias("_first"))
        older = proxy.join(first, keys).where(F.col(ts) < F.col("_first")).drop("_first")
        return older.select(*cols).unionByName(target)
    if mode != "count":
        raise ValueError("mode must be 'count' or 'by_date'")
    n_t = seq.series_sizes(target, keys, "_nt")
    n_p = seq.series_sizes(proxy, keys, "_np")
    pos = seq.index_rows(proxy, keys, ts, **kw)
    older = (pos.join(n_p, keys).join(n_t, keys)
             .where(F.col(seq.RN) <= F.col("_np") - F.col("_nt"))
             .drop(seq.RN, "_np", "_nt"))
    return older.select(*cols).unionByName(target)


# C9 ----------------------------------------------------------------------------
def upsert_latest(history: DataFrame, batch: DataFrame, keys, ts: str, drop: Sequence[str] = ("Index",)) -> DataFrame:
    """Keyed upsert of a fresh batch over history, newest batch wins.

    Union with a batch rank and keep the highest rank per (keys, ts) as an
    aggregate (map-side combined, safe for hot keys).  Inside one side the last
    row by the ingest ordinal ``_seq`` wins (without one, the largest row, so the
    result never depends on task order).  Columns that only the batch has are kept.
    """
    keys = require_keys(keys)
    h = history.drop(*[c for c in drop if c in history.columns])
    b = batch.drop(*[c for c in drop if c in batch.columns])
    cols = h.columns + [c for c in b.columns if c not in h.columns]
    u = h.withColumn("_rank", F.lit(0)).unionByName(b.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    others = [c for c in cols if c not in (*keys, ts)]
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    rank = F.struct("_rank", F.col("_seq") if "_seq" in cols else F.lit(0), row)
    out = u.groupBy(*keys, ts).agg(F.max_by(row, rank).alias("_r"))
    return out.select(*keys, ts, "_r.*").select(*cols)


# C10 ---------------------------------------------------------------------------
def other_columns(merged: DataFrame, base: DataFrame) -> list[str]:
    """Columns of ``merged`` not in ``base``, in ``merged`` order (metadata only)."""
    have = set(base.columns)
    return [c for c in merged.columns if c not in have]

