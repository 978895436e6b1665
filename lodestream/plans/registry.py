"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its doubles are rounded to six places, timestamps become seconds since 1970."""

    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def tidy(df: DataFrame) -> DataFrame:
    cols = []
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            cols.append((F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c))
        elif kind.startswith("timestamp"):
            cols.append(F.unix_seconds(F.col(c).cast("timestamp")).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)
