"""Registry of checkable queries: a Spark builder plus its DuckDB oracle SQL.

Outputs are canonicalised identically on both sides so an order-insensitive
value hash can compare them: DATE/TIMESTAMP -> ISO text, DOUBLE -> round(x * 1e4) / 1e4 (same IEEE steps in both engines),
integers -> BIGINT.  ``cols`` lists the output columns as ``name:kind`` with
kind ``s`` (string), ``t`` (date/timestamp as text), ``d`` (double),
``i`` (bigint).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    cols: str
    doc: str = ""

    def kinds(self) -> list[tuple[str, str]]:
        return re.findall(r"(\S.*?):([stdi])(?=\s|$)", self.cols)


REGISTRY: dict[str, Query] = {}


def register(name: str, cols: str, sql: str | None = None, doc: str = ""):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, cols, doc or (fn.__doc__ or "").strip())
        return fn
    return deco


def canon_spark(df: DataFrame, q: Query) -> DataFrame:
    out = []
    for name, kind in q.kinds():
        c = F.col(f"`{name}`")
        if kind == "d":
            out.append((F.round(c.cast("double") * F.lit(10000.0)) / F.lit(10000.0)).alias(name))
        elif kind == "t":
            out.append(c.cast("string").alias(name))
        elif kind == "i":
            out.append(c.cast("long").alias(name))
        else:
            out.append(c.cast("string").alias(name))
    return df.select(*out)


def canon_sql(sql: str, q: Query) -> str:
    out = []
    for name, kind in q.kinds():
        c = f'"{name}"'
        if kind == "d":
            out.append(f"(round(CAST({c} AS DOUBLE) * 10000.0) / 10000.0 + 0.0) AS {c}")
        elif kind == "t":
            out.append(f"CAST({c} AS VARCHAR) AS {c}")
        elif kind == "i":
            out.append(f"CAST({c} AS BIGINT) AS {c}")
        else:
            out.append(f"CAST({c} AS VARCHAR) AS {c}")
    return f"SELECT {', '.join(out)} FROM (\n{sql}\n) AS q"


def spark_queries() -> dict[str, Builder]:
    def wrap(q: Query) -> Builder:
        return lambda spark, sf_dir: canon_spark(q.build(spark, sf_dir), q)
    return {n: wrap(q) for n, q in REGISTRY.items()}


def oracle_queries() -> dict[str, str]:
    return {n: canon_sql(q.sql, q) for n, q in REGISTRY.items() if q.sql}



