"""Exact medians of keyed rows, without bringing a key's rows together.

A mergeable sketch brackets the median between two values of the key; one more aggregate counts the rows under and at
the bracket's ends and gathers only the few values strictly inside it.  Both combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import require_keys

#: The sketch's rank error is 1 / ACCURACY of a key's rows; the bracket leaves three times that on either side.
ACCURACY = 10_000


def exact_median(df: DataFrame, keys: Sequence[str] | str, value: str, name: str = "median", accuracy: int = ACCURACY) -> DataFrame:
    """(keys, median): the middle value, or the mean of the two middle ones.  NULLs do not count; a key without
    values gives no row.  About 8 / ``accuracy`` of a key's rows meet in its aggregate."""
    keys = require_keys(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    off = 3.0 / accuracy
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", [0.5 - off, 0.5 + off], accuracy).alias("_e"))
    ends = ends.select(*keys, "_n", F.col("_e")[0].alias("_lo"), F.col("_e")[1].alias("_hi"))
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    got = rows.join(ends, keys).groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.count_if(v < lo).alias("_under"),
        F.count_if(v == lo).alias("_at"), F.count_if((v == hi) & (hi > lo)).alias("_top"), F.sort_array(F.collect_list(F.when((v > lo) & (v < hi), v))).alias("_in"))

    def ranked(k: Column) -> Column:
        at = k - F.col("_under") - F.col("_at")
        inside = F.size("_in")
        return F.when((k > F.col("_under")) & (at <= 0), lo).when((at > 0) & (at <= inside), F.get("_in", (at - 1).cast("int"))) \
            .when((at > inside) & (at <= inside + F.col("_top")), hi).otherwise(F.raise_error(F.lit("median outside the sketch's bracket")).cast("double"))

    return got.select(*keys, ((ranked(F.expr("(_n + 1) div 2")) + ranked(F.expr("_n div 2 + 1"))) / 2).alias(name))
