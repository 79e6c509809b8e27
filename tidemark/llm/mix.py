"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

1. A document's size is its number of words.  Sources, in code point order with null last, get the
   weights in turn; together they share ``share`` of all words.  A target stops at ``max_copies`` times
   its source's size and the excess is shared again by weight (water filling in closed form: sources
   ordered by cap / weight, running sums).
2. Inside a source, expected copies are ``min(max_copies, a * measure)`` with ``a`` chosen so that the
   expected words equal the target.  The measure is the number of decimal digits of the size, so a
   longer document has the higher inclusion odds.
3. The whole part of the expected copies is certain.  For the rest, p, documents are ranked by Pareto's
   key: random odds u / (1 - u) over inclusion odds p / (1 - p).  The smallest keys are taken until the
   words of the sample come nearest to what the target leaves, so the sample's size in words is fixed.

Nothing sorts a whole source: keys are counted in ``BUCKETS`` equal steps of key / (1 + key), and only the
one step in which a source's words run out is ordered, so a source with a third of all rows is no hot task.
u comes from an MD5 of the seed and the id (of the text where the id is null): reruns agree.

Edge cases: null source is a source of its own; null or empty text has size 0 and takes 0 words; an empty
table gives no rows; rows that agree in id and size are one sampling unit and are taken together; columns
of the input other than the three named are kept untouched by ``mix`` (one named ``copies`` is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, lookup_join, n_words, packed_row, table

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = 42
BUCKETS = 4096


def _unit(id_col: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1), the same in every run."""
    name = F.coalesce(id_col.cast("string"), F.md5(text.cast("string")), F.lit(""))
    head = F.substring(F.md5(F.concat(name, F.lit(f":{seed}"))), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / float(2 ** 52)


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> list[Column]:
    size = n_words(F.col(text_col))
    return [F.col(source_col).alias("__src"), size.alias("__size"),
            F.length(size.cast("string")).cast("long").alias("__m"),
            _unit(F.col(id_col), F.col(text_col), seed).alias("__u")]


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, share: float = 1.0) -> DataFrame:
    """(__src, source_size, target) from (__src, source_size): one row a source."""
    everything = Window.orderBy(F.col("__src").asc_nulls_last())
    by_ratio = Window.orderBy("__ratio", F.col("__src").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nth = (F.row_number().over(everything) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (nth + 1).cast("int"))
    zero = F.lit(0).cast("long")
    level = F.try_divide(F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(before), zero),
                         (F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), zero)).cast("double"))
    s = (sizes.withColumn("__w", weight.cast("long")).withColumn("__cap", F.col("source_size") * int(max_copies))
         .withColumn("__ratio", F.col("__cap").cast("double") / F.col("__w")).withColumn("__level", level))
    free = F.first(F.when(F.col("__ratio") > F.col("__level"), F.col("__level")), ignorenulls=True).over(whole)
    target = F.when(F.col("__ratio") > free, F.col("__w") * free).otherwise(F.col("__cap").cast("double"))
    return s.select("__src", "source_size", target.alias("target"))


def _expected(levels: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """(__src, __m, source_size, target, __whole, __p, __rest): copies by source and measure."""
    w = Window.partitionBy("__src").orderBy(F.col("__m").desc())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    on_from = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k = float(max_copies)
    zero = F.lit(0).cast("long")
    x = levels.join(targets.withColumnRenamed("__src", "__src2"), F.col("__src").eqNullSafe(F.col("__src2"))).drop("__src2")
    x = x.withColumn("__a", F.try_divide(F.col("target") - k * F.coalesce(F.sum("__lsize").over(before), zero),
                                         F.sum(F.col("__m") * F.col("__lsize")).over(on_from).cast("double")))
    free = F.first(F.when(F.lit(k) / F.col("__m") > F.col("__a"), F.col("__a")), ignorenulls=True).over(whole)
    x = x.withColumn("__a", free)
    copies = (F.when(F.col("source_size") == 0, 0.0)
              .when(F.lit(k) / F.col("__m") > F.col("__a"), F.col("__a") * F.col("__m")).otherwise(k))
    x = x.withColumn("__e", copies).withColumn("__whole", F.floor("__e").cast("long"))
    x = x.withColumn("__p", F.col("__e") - F.col("__whole"))
    return x.withColumn("__rest", F.col("target") - F.sum(F.col("__whole") * F.col("__lsize")).over(whole))


def _keyed(df: DataFrame, buckets: int) -> DataFrame:
    """Pareto's key as key / (1 + key), and its bucket; null where nothing is left to chance."""
    odds = (F.col("__u") / (1.0 - F.col("__u"))) / (F.col("__p") / (1.0 - F.col("__p")))
    return (df.withColumn("__q", F.when(F.col("__p") > 0, odds / (1.0 + odds)))
            .withColumn("__b", F.floor(F.col("__q") * float(buckets)).cast("long")))


def mix_decisions(sized: DataFrame, id_col: str, weights=WEIGHTS, max_copies: int = MAX_COPIES, share: float = 1.0,
                  buckets: int = BUCKETS) -> DataFrame:
    """One row a source and measure: certain copies, inclusion probability, and where the sample ends.

    ``sized`` has the id and the columns of ``_sized``; it is read several times and must be materialised.
    """
    levels = checkpoint(sized.groupBy("__src", "__m").agg(F.sum("__size").alias("__lsize")))
    targets = source_targets(levels.groupBy("__src").agg(F.sum("__lsize").alias("source_size")), weights, max_copies, share)
    plan = checkpoint(_expected(levels, targets, max_copies))
    cand = _keyed(_with_plan(sized, plan), buckets).where(F.col("__q").isNotNull())
    w = Window.partitionBy("__src").orderBy("__b")
    steps = (cand.groupBy("__src", "__b").agg(F.sum("__size").alias("__bs"), F.first("__rest").alias("__rest"))
             .withColumn("__before", F.sum("__bs").over(w) - F.col("__bs")))
    last = checkpoint(steps.where((F.col("__before") <= F.col("__rest")) & (F.col("__before") + F.col("__bs") > F.col("__rest")))
                      .select(F.col("__src").alias("__src3"), F.col("__b").alias("__last"), "__before"))
    ordered = Window.partitionBy("__src").orderBy("__q", F.col("__id").asc_nulls_last())
    edge = (lookup_join(cand.withColumn("__id", F.col(id_col)), last,
                        F.col("__src").eqNullSafe(F.col("__src3")) & (F.col("__b") == F.col("__last")), "inner")
            .groupBy("__src", "__q", "__id").agg(F.sum("__size").alias("__s"), F.first("__before").alias("__before"),
                                                 F.first("__rest").alias("__rest"))
            .withColumn("__run", F.col("__before") + F.sum("__s").over(ordered) - F.col("__s"))
            .where(F.col("__run") + F.col("__s") / 2.0 <= F.col("__rest"))
            .groupBy(F.col("__src").alias("__src4")).agg(F.max(F.struct("__q", "__id")).alias("__upto")))
    out = plan.join(last, F.col("__src").eqNullSafe(F.col("__src3")), "left").join(
        edge, F.col("__src").eqNullSafe(F.col("__src4")), "left")
    return checkpoint(out.select("__src", "__m", "source_size", "target", "__whole", "__p", "__rest", "__last", "__upto"))


def _with_plan(sized: DataFrame, plan: DataFrame) -> DataFrame:
    p = plan.withColumnRenamed("__src", "__psrc").withColumnRenamed("__m", "__pm")
    return lookup_join(sized, p, F.col("__src").eqNullSafe(F.col("__psrc")) & (F.col("__m") == F.col("__pm"))).drop("__psrc", "__pm")


def _copies(sized: DataFrame, decisions: DataFrame, id_col: str, buckets: int) -> DataFrame:
    x = _keyed(_with_plan(sized, decisions), buckets)
    at = F.struct(F.col("__q"), F.col(id_col).alias("__id"))
    extra = F.col("__q").isNotNull() & (F.col("__last").isNull() | (F.col("__b") < F.col("__last"))
                                        | ((F.col("__b") == F.col("__last")) & F.coalesce(at <= F.col("__upto"), F.lit(False))))
    return x.withColumn("copies", F.col("__whole") + extra.cast("long"))


def mix_table(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
              weights=WEIGHTS, max_copies: int = MAX_COPIES, share: float = 1.0, seed: int = SEED,
              buckets: int = BUCKETS) -> DataFrame:
    """Per document: id, size, source_size, target, copies and taken (= copies * size)."""
    sized = checkpoint(docs.select(F.col(id_col).alias("__doc"), *_sized(docs, id_col, source_col, text_col, seed)))
    x = _copies(sized, mix_decisions(sized, "__doc", weights, max_copies, share, buckets), "__doc", buckets)
    return x.select(F.col("__doc").alias(id_col), F.col("__size").alias("size"), "source_size", "target", "copies",
                    (F.col("copies") * F.col("__size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights=WEIGHTS, max_copies: int = MAX_COPIES, share: float = 1.0, seed: int = SEED,
        buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with the number of copies the mix takes of each (0: left out) in ``copies``.

    Texts are read once for the decisions and once for the result; they are never shuffled while the
    table of decisions (sources x digits of the size) is small enough to broadcast.
    """
    base = docs.select(packed_row(docs), F.col(id_col).alias("__doc"), *_sized(docs, id_col, source_col, text_col, seed))
    sized = checkpoint(base.select("__doc", "__src", "__size", "__m", "__u"))
    decisions = mix_decisions(sized, "__doc", weights, max_copies, share, buckets)
    x = _copies(base, decisions, "__doc", buckets)
    return x.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c != "copies"], "copies")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture of all documents: sources at weights 5, 2, 1, three copies at most."""
    return mix_table(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH sized AS (SELECT doc_id, source AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(text), '') || ':42'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
d AS (SELECT *, length(size::VARCHAR)::BIGINT AS m FROM sized),
levels AS (SELECT src, m, sum(size)::BIGINT AS lsize FROM d GROUP BY ALL),
s0 AS (SELECT src, sum(lsize)::BIGINT AS source_size FROM levels GROUP BY ALL),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY src NULLS LAST)) - 1) % 3 + 1]::BIGINT AS w, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, cap::DOUBLE / w AS ratio FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER pre, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER pre, 0))::DOUBLE AS lvl
  FROM s2 WINDOW pre AS (ORDER BY ratio, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT arg_min(lvl, row(ratio, src)) AS f FROM s3 WHERE ratio > lvl),
tg AS (SELECT src, source_size, CASE WHEN ratio > f THEN w * f ELSE cap::DOUBLE END AS target FROM s3, free),
l1 AS (SELECT l.*, source_size, target FROM levels l JOIN tg ON l.src IS NOT DISTINCT FROM tg.src),
l2 AS (SELECT *, CASE WHEN sum(m * lsize) OVER post = 0 THEN NULL ELSE
    (target - 3.0::DOUBLE * coalesce(sum(lsize) OVER pre, 0)::DOUBLE) / (sum(m * lsize) OVER post)::DOUBLE END AS a
  FROM l1 WINDOW pre AS (PARTITION BY src ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    post AS (PARTITION BY src ORDER BY m DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l3 AS (SELECT src, arg_max(a, m) AS af FROM l2 WHERE 3.0::DOUBLE / m > a GROUP BY ALL),
l4 AS (SELECT l2.*, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN 3.0::DOUBLE / m > af THEN af * m ELSE 3.0::DOUBLE END AS e
  FROM l2 LEFT JOIN l3 ON l2.src IS NOT DISTINCT FROM l3.src),
l5 AS (SELECT *, floor(e)::BIGINT AS whole, e - floor(e) AS p,
  target - (sum(floor(e)::BIGINT * lsize) OVER (PARTITION BY src))::DOUBLE AS rest FROM l4),
c0 AS (SELECT d.*, source_size, target, whole, rest, CASE WHEN p > 0 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS o
  FROM d JOIN l5 ON d.src IS NOT DISTINCT FROM l5.src AND d.m = l5.m),
c1 AS (SELECT *, o / (1.0::DOUBLE + o) AS q FROM c0),
c2 AS (SELECT *, sum(size) OVER (PARTITION BY src, q IS NULL ORDER BY q, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) - size AS run FROM c1)
SELECT doc_id, size, source_size, target,
  whole + CASE WHEN q IS NOT NULL AND run + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS copies,
  (whole + CASE WHEN q IS NOT NULL AND run + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size AS taken FROM c2
"""
