"""Table contract: key columns, required columns, null rules, ingest ordinal.

Contract used by every operator: a long table ``(keys..., ts, value, ...)``
with one row per (keys, ts) and non-NULL key columns.  Operators never run an
un-keyed window, so an empty key list is rejected up front.  Internal joins
are plain equi-joins on the key attributes (so existing hash partitioning is
reused); a row with a NULL key belongs to no series -- check inputs with
``require_non_null_keys``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQ = "_seq"


def as_list(cols: str | Iterable[str] | None) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def require_keys(keys: str | Sequence[str] | None) -> list[str]:
    ks = as_list(keys)
    if not ks:
        raise ValueError("at least one key column is required; un-keyed windows are refused")
    return ks


def require_non_null_keys(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise if any key column holds NULL (one aggregate pass)."""
    ks = require_keys(keys)
    row = df.agg(*[F.count_if(F.col(f"`{k}`").isNull()).alias(k) for k in ks]).first()
    bad = {k: v for k, v in row.asDict().items() if v}
    if bad:
        raise ValueError("NULL series keys: " + ", ".join(f"{k}={v}" for k, v in bad.items()))


def require_columns(df: DataFrame, required: Sequence[str], what: str = "input") -> None:
    """B1: fail before any action, listing missing names in the given order."""
    have = set(df.columns)
    missing = [c for c in required if c not in have]
    if missing:
        raise ValueError(f"Missing required {what} columns: {', '.join(missing)}")


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null rule 1: NaN becomes NULL once at ingest; afterwards only NULL exists."""
    targets = cols or [f.name for f in df.schema.fields
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in targets})


def with_ingest_ordinal(df: DataFrame, name: str = SEQ) -> DataFrame:
    """Attach an ingest ordinal that follows file order (keep-first / keep-last).

    The ordinal of a file scan is a struct that sorts by file path, then by the place of the row's split in the file,
    then by the row's place in the split (``monotonically_increasing_id`` grows along a split, whatever the task that
    reads it), so it does not depend on how files are split or packed into tasks.  Call it directly after the read,
    before any column is cut.  Data that do not come from files get the id alone.
    """
    row = F.monotonically_increasing_id()
    try:
        return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), row.alias("row")))
    except AnalysisException:
        return df.withColumn(name, row)
