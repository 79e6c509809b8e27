"""Projection, cleaning and de-duplication operators.

De-duplication is written as aggregation (``min_by`` / ``max_by`` over the
ingest ordinal) instead of ``row_number`` windows: aggregation combines
map-side, so a group of copies holding a third of the table is reduced
before the shuffle instead of landing whole in one task.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..schema import SEQ, as_list, require_columns, require_keys

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FIXED_WIDTH = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType,
               T.DateType, T.TimestampType, T.TimestampNTZType)


# B1 / B2 / B3 / B4 / B5 / B23 ----------------------------------------------
def select_required(df: DataFrame, cols: Sequence[str], what: str = "input") -> DataFrame:
    """B1 + B2: fail on missing columns, then keep only those (before any null drop)."""
    require_columns(df, cols, what)
    return df.select(*[F.col(f"`{c}`") for c in cols])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns present in ``mapping``; unknown names are kept."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def translate_headers(df: DataFrame, mapping: Mapping[str, str] = tx.HEADER_TRANSLATIONS) -> DataFrame:
    """Header translation by dictionary."""
    return rename(df, mapping)


def clean_headers(df: DataFrame) -> DataFrame:
    """Cut from the first '(' to the last ')', trim, then one '_' for each blank (metadata only)."""
    names = [re.sub(r"\s", "_", re.sub(r"\(.*\)", "", c).strip()) for c in df.columns]
    return df.toDF(*names)


def drop_if_present(df: DataFrame, *cols: str) -> DataFrame:
    """B23."""
    return df.drop(*[c for c in cols if c in df.columns])


# B6 / B7 / B21 ---------------------------------------------------------------
def blanks_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """B6 over the string columns (or the given ones)."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: tx.blank_to_null(F.col(f"`{c}`")) for c in cols})


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows NULL in any column of ``subset`` (all columns when None)."""
    return df.na.drop("any", subset=list(subset) if subset else None)


def fill_zero(df: DataFrame) -> DataFrame:
    """NULL -> 0 in every numeric column."""
    return df.na.fill(0)


# B8 / B9 ---------------------------------------------------------------------
def distinct_rows(df: DataFrame, seq: str = SEQ) -> DataFrame:
    """Whole-row distinct ignoring the ingest ordinal; the first ordinal is kept."""
    if seq not in df.columns:
        return df.distinct()
    others = [c for c in df.columns if c != seq]
    return df.groupBy(*[F.col(f"`{c}`") for c in others]).agg(F.min(seq).alias(seq)).select(*df.columns)


def dedupe(df: DataFrame, subset: Sequence[str], keep: str = "first", seq: str = SEQ,
           valid: Column | None = None) -> DataFrame:
    """One row per ``subset`` value; ``first``/``last`` by ingest ordinal ``seq``.

    Written as an aggregate so hot duplicate groups combine map-side.  With
    ``valid``, only rows where it holds compete (``min_by`` skips rows whose
    ordering is NULL) and groups without a valid row disappear: the same as
    filtering first, but the filter sits above the aggregate instead of being
    inlined into the scan.
    """
    subset = as_list(subset)
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    others = [c for c in df.columns if c not in subset]
    pick = F.min_by if keep == "first" else F.max_by
    order = F.col(seq) if valid is None else F.when(valid, F.col(seq))
    group = [F.col(f"`{c}`") for c in subset]
    if all(isinstance(df.schema[c].dataType, FIXED_WIDTH) for c in others):
        # fixed-width payload: one min_by/max_by per column (same unique ordering, so
        # the same row) keeps a fixed-width buffer and the faster hash aggregate
        out = df.groupBy(*group).agg(*[pick(F.col(f"`{c}`"), order).alias(c) for c in others])
        if valid is not None:
            out = out.where(F.col(f"`{seq}`").isNotNull())
        return out.select(*df.columns)
    payload = F.struct(*[F.col(f"`{c}`") for c in others])
    out = df.groupBy(*group).agg(pick(payload, order).alias("_row"))
    if valid is not None:
        out = out.where(F.col("_row").isNotNull())
    return out.select(*[F.col(f"`{c}`") for c in subset], "_row.*").select(*df.columns)


# B16 / B17 / B20 -------------------------------------------------------------
def normalize_scraped(df: DataFrame, date_col: str = "Date", index_col: str = "Price") -> DataFrame:
    """Apply B12-B15 to whichever of the known columns exist (one projection)."""
    exprs = {}
    if date_col in df.columns:
        exprs[date_col] = tx.vi_date_to_us(F.col(f"`{date_col}`"))
    for c in (index_col, "Change"):
        if c in df.columns:
            exprs[c] = tx.vi_decimal(F.col(f"`{c}`"))
    for c in tx.VOLUME_COLUMNS:
        if c in df.columns:
            exprs[c] = tx.vi_integer(F.col(f"`{c}`"))
    money = [c for c in tx.VALUE_COLUMNS if c in df.columns]
    d = df.withColumns(exprs)
    if not money:
        return d
    # B15 in stages: each projection references the previous one's columns, so
    # Catalyst keeps them apart and the regex work is done once per row
    d = d.withColumns({f"_mt{i}": F.trim(F.col(f"`{c}`")) for i, c in enumerate(money)})
    d = d.withColumns({**{f"_mu{i}": tx.money_unit(F.col(f"_mt{i}")) for i in range(len(money))},
                       **{f"_ms{i}": tx.money_strip(F.col(f"_mt{i}")) for i in range(len(money))}})
    d = d.withColumns({f"_mn{i}": tx.vi_decimal(F.col(f"_ms{i}")).try_cast("double") for i in range(len(money))})
    d = d.withColumns({c: F.coalesce(F.concat(F.format_number(F.col(f"_mn{i}"), 2), F.lit(" "), F.col(f"_mu{i}")),
                                     F.col(f"`{c}`")) for i, c in enumerate(money)})
    return d.drop(*[f"_m{k}{i}" for k in "tusn" for i in range(len(money))])


def assert_parsed(df: DataFrame, pairs: Mapping[str, str], what: str = "input") -> None:
    """After coercion, raise if any raw non-null value failed to parse (one aggregate)."""
    aggs = [F.count_if(F.col(f"`{raw}`").isNotNull() & F.col(f"`{parsed}`").isNull()).alias(parsed)
            for raw, parsed in pairs.items()]
    row = df.agg(*aggs).first()
    bad = {k: v for k, v in row.asDict().items() if v}
    if bad:
        raise ValueError(f"Invalid {what} values: " + ", ".join(f"{k}={v}" for k, v in bad.items()))


# B22 -------------------------------------------------------------------------
def remove_outliers(df: DataFrame, keys, ts: str, col: str, threshold: float = 0.03) -> DataFrame:
    """Keep rows whose change vs the unfiltered previous row is within +-threshold.

    The first row (change NULL -> 0) stays; previous 0 and current 0 is change
    0 (kept); previous 0 and current non-zero is an infinite change (dropped).
    """
    from . import indicators as ind
    keys = require_keys(keys)
    d = ind.pct_change(df, keys, ts, col, "_chg")
    d = prev_value(d, keys, ts, col, "_prev")
    inf_change = F.coalesce((F.col("_prev") == 0) & (F.col(col) != 0), F.lit(False))
    return d.where(~inf_change & (F.abs(F.coalesce(F.col("_chg"), F.lit(0.0))) <= threshold)).drop("_chg", "_prev")


def prev_value(df: DataFrame, keys, ts: str, col: str, out: str) -> DataFrame:
    from . import sequence as seq
    return seq.bounded(df, keys, ts, lambda d, w: d.withColumn(out, F.lag(col, 1).over(w)), before=1)


# B24 -------------------------------------------------------------------------
def all_zero_columns(df: DataFrame, tolerance: float = 1e-8) -> list[str]:
    """B24 plan step: numeric columns whose every value is within ``tolerance`` of 0.

    One aggregate pass; a column with any NULL is kept (as in the source rule).
    """
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    if not num:
        return []
    aggs = []
    for c in num:
        aggs.append(F.max(F.abs(F.col(f"`{c}`"))).alias(f"m{len(aggs)}"))
        aggs.append(F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{len(aggs)}"))
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(num):
        mx, nulls = row[2 * i], row[2 * i + 1]
        if mx is not None and nulls == 0 and mx <= tolerance:
            out.append(c)
    return out


def drop_all_zero_columns(df: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """B24 apply step."""
    return df.drop(*all_zero_columns(df, tolerance))


# B25 / B26 -------------------------------------------------------------------
def min_history(df: DataFrame, keys, min_rows: int) -> DataFrame:
    """Keep only series with at least ``min_rows`` rows (count + semi join)."""
    keys = require_keys(keys)
    big = df.groupBy(*keys).count().where(F.col("count") >= min_rows).drop("count")
    return df.join(big, keys, "left_semi")


def required_rows(n_tests: int, n_lags: int, n_forecasts: int) -> int:
    """B25 run check: minimum rows for a backtest run."""
    return max(n_tests + 1, n_tests + n_lags + n_forecasts)


def sort_for_sink(df: DataFrame, keys, ts: str) -> DataFrame:
    """Ordering is applied only at the sink."""
    return df.orderBy(*as_list(keys), ts)
