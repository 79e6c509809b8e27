"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint); component is the smallest node reached.

    Each round keeps at most as many edges as there were, joins on the node with its smallest neighbour
    (an aggregate that combines before the shuffle) and is checkpointed, so lineage stays short and a lost
    executor costs one round at most.  Hot nodes sit on one side of an equi-join, which adaptive execution
    splits.  An empty edge table gives no rows.
    """
    e = checkpoint(_down(edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))))
    before = _print(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _down(large)
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        x = large.join(low, F.col("u") == F.col("k"))
        e = checkpoint(_down(x.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                        F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                             .select("e.u", "e.v")))
        after = _print(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))


def _down(e: DataFrame) -> DataFrame:
    """Each edge once, from the greater to the smaller node."""
    return (e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .groupBy("u", "v").agg(F.lit(1).alias("__one")).select("u", "v"))


def _print(e: DataFrame) -> tuple:
    """Fingerprint of an edge set."""
    h = F.xxhash64("u", "v")
    r = e.agg(F.count(F.lit(1)), F.sum(F.pmod(h, F.lit(1 << 31))), F.bit_xor(h)).first()
    return tuple(r)
