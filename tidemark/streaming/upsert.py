"""Incremental keyed upsert and streaming clean (H1, H2).

``start_clean_stream`` is the stateful form of H2: the first row of each (keys, ts) within an event-time watermark
goes out, rows that come later than the watermark are dropped, and the state holds only what the watermark spans.

New files arriving in a folder are read with ``readStream`` and applied with
``foreachBatch``: each micro-batch is upserted into the table (newest batch
wins per (keys, ts)).  The table is partitioned by year-month of ``ts``; a
batch reads only the partitions it touches (partition pruning on the batch's
months, a short list) and replaces only those with a dynamic partition
overwrite, committed in one job, so the cost of a batch follows the batch, not
the table.  The ids of the stream and the batch are stored in the rows: a
replayed batch (after a failure between the write and the stream's commit)
finds its ids already applied to those partitions and is skipped, leaving the
table unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.align import upsert_latest
from ..schema import require_keys
from ..session import cut_lineage, ensure_checkpoint_dir

BATCH_COL = "_batch_id"
STREAM_COL = "_stream_id"
PART_COL = "_ym"


def _table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def upsert_batch(batch: DataFrame, batch_id: int, table_path: str, keys: Sequence[str], ts: str,
                 transform: Callable[[DataFrame], DataFrame] | None = None, stream_id: str | None = None) -> None:
    """H1 body: C9 upsert of one micro-batch into the partitions it touches (idempotent).

    Every batch, the first too, is reduced to one row per (keys, ts).  A replay is known by its stream and
    batch id, so a new stream, or one that lost its checkpoint, starts at batch 0 without being skipped.
    """
    spark = batch.sparkSession
    keys = require_keys(keys)
    # the query's id stays the same while its checkpoint is kept
    stream = stream_id or spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
    b = transform(batch) if transform else batch
    b = b.withColumn(PART_COL, (F.year(ts) * 100 + F.month(ts)).cast("int"))
    # the months present in one batch: a short list, used for partition pruning
    parts = [r[0] for r in b.select(PART_COL).distinct().collect()]
    if not parts:
        return
    if _table_exists(spark, table_path):
        cur = spark.read.option("mergeSchema", True).parquet(table_path).where(F.col(PART_COL).isin(parts))
        done = cur.where(F.col(STREAM_COL) == stream).agg(F.max(BATCH_COL)).first()[0]
        if done is not None and batch_id <= done:
            return  # replay of an applied batch
        hist = cur.drop(BATCH_COL, STREAM_COL)
    else:
        hist = b.where(F.lit(False))
    merged = upsert_latest(hist, b, keys, ts, drop=())
    out = merged.withColumns({BATCH_COL: F.lit(int(batch_id)).cast("long"), STREAM_COL: F.lit(stream)})
    # the result reads the partitions it replaces: cut lineage in the shared checkpoint folder first
    out = cut_lineage(out)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART_COL).parquet(table_path)


def start_upsert_stream(spark: SparkSession, source_dir: str, schema: T.StructType | str, table_path: str,
                        keys: Sequence[str], ts: str, fmt: str = "parquet", checkpoint: str | None = None,
                        transform: Callable[[DataFrame], DataFrame] | None = None):
    """H1/H2: start an AvailableNow stream over ``source_dir`` applying ``upsert_batch``.

    ``transform`` carries the stateless cleaning (H2) applied to each batch
    before the upsert.  The streaming checkpoint lives under the session's
    shared checkpoint folder unless given.
    """
    ck = checkpoint or ensure_checkpoint_dir(spark).rstrip("/") + "/stream-" + table_path.strip("/").replace("/", "_")
    src = spark.readStream.schema(schema).format(fmt).option("header", True).load(source_dir)
    return (src.writeStream.trigger(availableNow=True).option("checkpointLocation", ck)
            .foreachBatch(lambda df, bid: upsert_batch(df, bid, table_path, keys, ts, transform)).start())


def first_within_watermark(rows: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """The first row of each (keys, ts) that arrives within ``delay`` of event time; later rows are dropped."""
    keys = require_keys(keys)
    timed = rows.withColumn("_event", F.col(ts).cast("timestamp")).withWatermark("_event", delay)
    return timed.dropDuplicatesWithinWatermark([*keys, ts]).drop("_event")


def start_clean_stream(spark: SparkSession, source_dir: str, schema: T.StructType | str, out_path: str, keys: Sequence[str], ts: str,
                       delay: str = "7 days", transform: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "parquet",
                       checkpoint: str | None = None, files_per_batch: int | None = None):
    """H2: clean new files row by row (``transform``: stateless), keep the first row of each (keys, ts) within the
    watermark, and append to ``out_path``."""
    ck = checkpoint or ensure_checkpoint_dir(spark).rstrip("/") + "/clean-" + out_path.strip("/").replace("/", "_")
    src = spark.readStream.schema(schema).format(fmt).option("header", True)
    if files_per_batch:
        src = src.option("maxFilesPerTrigger", files_per_batch)
    rows = src.load(source_dir)
    rows = first_within_watermark(transform(rows) if transform else rows, keys, ts, delay)
    return rows.writeStream.trigger(availableNow=True).option("checkpointLocation", ck).format("parquet").option("path", out_path).start()
