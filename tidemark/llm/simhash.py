"""SimHash near-duplicates by pigeonhole blocks.

A text is lower-cased (A-Z), cut into words, and its ``k``-word shingles (repeats included) are hashed with
XXH64; a fingerprint bit is set when more than half of the hashes have it.  Two fingerprints that differ in
at most ``d`` bits agree in at least three of ``d + 3`` blocks, so every choice of three blocks is a join
key and no close pair is missed.  Equal fingerprints are merged first, so copies cost nothing further.
Rows of a key are sorted together and streamed: small key groups compare all their members, larger ones grow
breadth-first (each step compares one fingerprint with those not reached yet) and emit a spanning forest, so
the rows made stay in proportion to the fingerprints, however many copies a group has.  Every link is
verified by its Hamming distance.  Links make groups by connected components.

Edge cases: null, empty or blank texts have fingerprint 0 and link like any other; fewer than ``k`` words
are one shingle; whole texts are hashed whatever their length; a null doc_id never is a component's id unless
all of a component's ids are null; repeated rows share a fingerprint; an empty table gives no rows; other
columns are kept by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, packed_row, table
from .components import connected_components

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
#: Key groups up to this size compare all members at once; larger ones breadth-first.
SMALL_GROUP = 48


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint of one text, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - k + 1)
    lo, hi = starts[:n].tolist(), ends[min(k, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(lo[at:at + 65536], hi[at:at + 65536])], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", k: int = SHINGLE_WORDS, out: str = "__fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed bigint."""

    @F.pandas_udf("long")
    def fp(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(np.array([fingerprint(t, k) for t in s], dtype=np.uint64).view(np.int64), index=s.index)

    return docs.withColumn(out, fp(F.col(text_col).cast("string")))


def block_masks(d: int) -> list[int]:
    """Masks of every three of d + 3 blocks of the 64 bits (signed)."""
    cuts = [round(i * 64 / (d + 3)) for i in range(d + 4)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    return [signed(a | b | c) for a, b, c in combinations(blocks, 3)]


def _forest(fp: np.ndarray, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of one key group."""
    left = fp
    while left.size:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= d
            if near.any():
                found = left[near]
                left = left[~near]
                todo.extend(found)
                yield np.full(found.size, x), found


def _links(key: np.ndarray, fp: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of whole key groups; rows are sorted by key."""
    a, b = [], []
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, key.size))
    for s, n in zip(first[size > SMALL_GROUP], size[size > SMALL_GROUP]):
        for x, y in _forest(fp[s:s + n], d):
            a.append(x)
            b.append(y)
    small = np.repeat(size <= SMALL_GROUP, size)
    key, fp = key[small], fp[small]
    at = np.arange(key.size)
    for step in range(1, SMALL_GROUP):
        at = at[at + step < key.size]
        at = at[key[at] == key[at + step]]
        if not at.size:
            break
        x, y = fp[at], fp[at + step]
        near = np.bitwise_count(x ^ y) <= d
        a.append(x[near])
        b.append(y[near])
    return np.concatenate(a or [fp[:0]]), np.concatenate(b or [fp[:0]])


def close_links(prints: DataFrame, d: int = MAX_DISTANCE) -> DataFrame:
    """(a, b) links between distinct fingerprints of ``prints`` (column fp), enough to connect what is close."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(block_masks(d))])
    x = prints.select("fp", F.explode(keys).alias("key")).repartition("key").sortWithinPartitions("key", "fp")

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for p in parts:  # a group may go on in the next batch
            k, f = np.concatenate((key, p["key"].to_numpy())), np.concatenate((fp, p["fp"].to_numpy().view(np.uint64)))
            cut = np.searchsorted(k, k[-1]) if k.size else 0
            key, fp = k[cut:], f[cut:]
            if cut:
                yield _frame(*_links(k[:cut], f[:cut], d))
        if key.size:
            yield _frame(*_links(key, fp, d))

    def _frame(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0].view(np.int64) if pairs.size else np.empty(0, np.int64),
                             "b": np.ascontiguousarray(pairs[:, 1]).view(np.int64) if pairs.size else np.empty(0, np.int64)})

    return x.mapInPandas(verify, "a long, b long").distinct()


def groups(prints: DataFrame, id_col: str = "doc_id", d: int = MAX_DISTANCE) -> DataFrame:
    """(fp, component_id, keeper): the group of every distinct fingerprint of a materialised (id, __fp) table."""
    each = prints.groupBy(F.col("__fp").alias("fp")).agg(
        F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.col("__fp").alias("fp"))).alias("first"))
    each = checkpoint(each)
    comp = checkpoint(connected_components(close_links(each.select("fp"), d)))
    x = each.join(comp, each["fp"] == comp["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    best = x.groupBy("c").agg(F.min("first").alias("keeper"))
    return x.select("fp", "c").join(best, "c").select("fp", F.col("keeper.id").alias("component_id"), "keeper")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
                    d: int = MAX_DISTANCE) -> DataFrame:
    """(id, fingerprint, component_id) of every document."""
    prints = checkpoint(with_fingerprint(docs.select(id_col, text_col), text_col, k).select(id_col, "__fp"))
    g = groups(prints, id_col, d)
    hexed = F.lower(F.lpad(F.hex("__fp"), 16, "0"))
    return prints.join(g, F.col("__fp") == F.col("fp")).select(id_col, hexed.alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
          d: int = MAX_DISTANCE) -> DataFrame:
    """One document of each group: the one with the smallest id (ties: smallest fingerprint, then any equal row)."""
    prints = checkpoint(with_fingerprint(docs.select(id_col, text_col), text_col, k).select(id_col, "__fp"))
    keep = checkpoint(groups(prints, id_col, d).select("keeper.id", "keeper.fp").distinct())
    base = docs.select(packed_row(docs), F.col(id_col).alias("__id"))
    x = base.join(keep, F.col("__id").eqNullSafe(F.col("id")))
    twice = prints.groupBy(id_col).count().where("count > 1")
    if twice.isEmpty():  # ids are unique: the id alone names the row
        return x.select("__row.*")
    x = with_fingerprint(x.withColumn("__t", F.col(f"__row.{text_col}")), "__t", k).where("__fp = fp")
    nth = F.row_number().over(Window.partitionBy("__id", "__fp").orderBy(F.xxhash64("__t")))
    return x.withColumn("__n", nth).where("__n = 1").select("__row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
