"""CSV/parquet scans and guarded sinks.

Reads never infer schemas: without an explicit schema every CSV column is a
string and the cleaning operators type it.  Writes go to a staging folder
first and replace the target only when the result is non-empty, so a failed
or empty run never destroys the previous output.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SEQ, with_ingest_ordinal

FILE_SUFFIX = "_historical_data.csv"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             columns: Sequence[str] | None = None, ordinal: bool = True) -> DataFrame:
    """A1/A2/A5: header CSV from a local or object-store URI; all strings unless a schema is given.

    ``columns`` prunes the scan; ``ordinal`` adds the ingest ordinal ``_seq``
    (file order) used by keep-first / keep-last de-duplication.
    """
    r = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        r = r.schema(schema)
    df = r.csv(path)
    if ordinal:
        df = with_ingest_ordinal(df)
    return df.select(*[F.col(f"`{c}`") for c in columns], *([SEQ] if ordinal else [])) if columns else df


def read_instrument_dir(spark: SparkSession, directory: str, suffix: str = FILE_SUFFIX,
                        columns: Sequence[str] | None = None) -> DataFrame:
    """A4: one scan of every ``{symbol}{suffix}`` file; ``symbol`` from the file name."""
    df = spark.read.option("header", True).option("pathGlobFilter", f"*{suffix}").csv(directory)
    symbol = F.regexp_replace(F.col("_metadata.file_name"), f"{suffix.replace('.', '[.]')}$", "")
    df = with_ingest_ordinal(df.select(*(F.col(f"`{c}`") for c in columns or df.columns), symbol.alias("symbol"), "_metadata"))
    return df.drop("_metadata")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def write_guarded(df: DataFrame, path: str, fmt: str = "csv", what: str = "rows",
                  partition_by: Sequence[str] = ()) -> None:
    """Write once to ``path.staging``, refuse an empty result, then put it in place.

    A plain target is renamed to ``path.previous``, the staged folder takes its name, and only then is the
    previous one removed; a crash in between leaves one of the two complete, and a failed rename is undone.
    With ``partition_by`` the staged rows replace only the partitions they have (A9), by the writer's own
    dynamic overwrite, whose job commits at its end.
    """
    spark = df.sparkSession
    staging, previous = path.rstrip("/") + ".staging", path.rstrip("/") + ".previous"
    plain = "parquet" if partition_by else fmt
    df.write.mode("overwrite").options(**({"header": "true"} if plain == "csv" else {})).format(plain).save(staging)
    fs, target, jvm = _fs(spark, path)
    src, old = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(previous)
    read = spark.read.schema(df.schema) if plain == "parquet" else spark.read.option("header", True)
    staged = read.format(plain).load(staging)
    if staged.isEmpty():
        fs.delete(src, True)
        raise ValueError(f"No valid {what} remain after preprocessing; refusing to overwrite {path}")
    if partition_by:
        (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**({"header": "true"} if fmt == "csv" else {}))
         .partitionBy(*partition_by).format(fmt).save(path))
        fs.delete(src, True)
        return
    if fs.exists(target):
        if fs.exists(old):
            fs.delete(old, True)  # left by a run that ended after its rename
        if not fs.rename(target, old):
            raise OSError(f"could not set {path} aside")
    if not fs.rename(src, target):
        if fs.exists(old):
            fs.rename(old, target)
        raise OSError(f"could not move {staging} to {path}")
    if fs.exists(old):
        fs.delete(old, True)


ARTIFACTS = ("final", "metrics", "forecast")


def _manifests(spark: SparkSession, root: str) -> list[str]:
    fs, p, _ = _fs(spark, f"{root.rstrip('/')}/_manifests")
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().endswith(".json")) if fs.exists(p) else []


def artifact_versions(spark: SparkSession, root: str) -> dict[str, str]:
    """{model: version} of the newest manifest; empty before the first complete write."""
    names = _manifests(spark, root)
    if not names:
        return {}
    return json.loads(spark.read.text(f"{root.rstrip('/')}/_manifests/{names[-1]}", wholetext=True).first()[0])


def write_artifacts(final: DataFrame, metrics: DataFrame, forecast: DataFrame, root: str,
                    model_col: str = "run_model") -> None:
    """The three artifact tables of some models, visible together or not at all.

    Each table's rows go to a folder of their own version, ``root/name/version=.../model_col=...``; then one manifest
    that names the version of every model is put in place by a rename to a new name.  Readers (``read_artifacts``)
    resolve through the newest manifest, so a run that ends between any two writes leaves the triple as it was.
    An empty table is refused (A8).  The default column name differs from the comparison table's ``Model`` column
    (Spark resolves column names case-insensitively).
    """
    spark, root, version = final.sparkSession, root.rstrip("/"), uuid.uuid4().hex
    models: set[str] = set()
    for name, df in zip(ARTIFACTS, (final, metrics, forecast)):
        path = f"{root}/{name}/version={version}"
        df.write.partitionBy(model_col).parquet(path)
        found = {r[0] for r in spark.read.schema(df.schema).parquet(path).select(model_col).distinct().collect()}  # a few models
        if not found:
            raise ValueError(f"No valid {name} rows remain after preprocessing; refusing to overwrite {root}")
        models |= found
    names = _manifests(spark, root)
    number = int(names[-1].split(".")[0]) + 1 if names else 0
    content = json.dumps(artifact_versions(spark, root) | dict.fromkeys(models, version), sort_keys=True)
    fs, folder, jvm = _fs(spark, f"{root}/_manifests")
    fs.mkdirs(folder)
    staged, target = jvm.org.apache.hadoop.fs.Path(folder, f"{version}.staging"), jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}.json")
    out = fs.create(staged, True)
    out.write(bytearray(content, "utf-8"))
    out.close()
    if fs.exists(target) or not fs.rename(staged, target):
        raise OSError(f"another run wrote artifacts to {root} meanwhile; nothing was replaced")


def read_artifacts(spark: SparkSession, root: str, model_col: str = "run_model") -> dict[str, DataFrame]:
    """{name: rows of every model} as the newest manifest has them; raises ValueError where there is none."""
    versions = artifact_versions(spark, root)
    if not versions:
        raise ValueError(f"no artifacts at {root}")
    named = F.concat("version", F.lit("/"), F.col(model_col).cast("string")).isin([f"{v}/{m}" for m, v in versions.items()])
    return {n: spark.read.parquet(f"{root.rstrip('/')}/{n}").where(F.col("version").isin(sorted(set(versions.values()))) & named).drop("version") for n in ARTIFACTS}


def vacuum_artifacts(spark: SparkSession, root: str) -> int:
    """Remove the versions that the newest manifest does not name; returns how many folders went.  Not beside a writer."""
    kept, gone = set(artifact_versions(spark, root).values()), 0
    for name in ARTIFACTS:
        fs, p, _ = _fs(spark, f"{root.rstrip('/')}/{name}")
        for f in fs.listStatus(p) if fs.exists(p) else []:
            at = f.getPath().getName()
            if at.startswith("version=") and at.removeprefix("version=") not in kept:
                gone += bool(fs.delete(f.getPath(), True))
    return gone


def read_artifact(spark: SparkSession, path: str, date_col: str = "Date", fmt: str = "csv",
                  date_format: str = "yyyy-MM-dd") -> DataFrame:
    """A10: read an artifact, coerce dates, drop rows whose date does not parse, order by date."""
    df = spark.read.option("header", True).format(fmt).load(path)
    if df.isEmpty():
        raise ValueError(f"artifact {path} is empty")
    d = df.withColumn(date_col, F.try_to_date(F.col(date_col).cast("string"), date_format))
    return d.where(F.col(date_col).isNotNull()).orderBy(date_col)
