"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a lookup table up to which it is broadcast; beyond, the join is left to Spark's shuffle joins.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder."""
    return cut_lineage(df)


def n_words(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed_row(df: DataFrame) -> Column:
    """All columns as one struct, so that helper columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")


def lookup_join(df: DataFrame, small: DataFrame, on: Column | list[str], how: str = "left",
                max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a materialised lookup table: broadcast only after its rows were counted to be few.

    ``small`` must be cheap to count (checkpointed, or a tiny aggregate); a larger one takes an
    ordinary shuffle join, whose hot keys adaptive execution splits.
    """
    return df.join(F.broadcast(small) if small.count() <= max_rows else small, on, how)
