"""Exact quantiles of large groups: values are counted by partial sums, and counts run in two levels, so no task holds a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.functions.numbers import times_and_plus
from lodestream.session import settle


def running_counts(rows: DataFrame, by: Sequence[str], c: str) -> DataFrame:
    """by, c, _upto (rows of the group with at most this value) and _all (rows of the group); NULL values are left out.

    One sum a range of sorted values, then inside the range. What is brought together is one row a group and range.
    """
    # settled, as the ranges have to be the same in both reads
    counts = rows.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count(F.lit(1)).alias("_n"))
    x = settle(counts.repartitionByRange(*by, c).withColumn("_r", F.spark_partition_id()), "ranks")
    sums = x.groupBy(*by, "_r").agg(F.sum("_n").alias("_s"))
    all_ = Window.partitionBy(*by)
    sums = sums.select(*by, "_r", F.sum("_s").over(all_).alias("_all"), (F.sum("_s").over(all_.orderBy("_r")) - F.col("_s")).alias("_before"))
    inside = Window.partitionBy(*by, "_r").orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(b).eqNullSafe(F.col(f"_s_{b}")) for b in by]
    sums = sums.select(*[F.col(b).alias(f"_s_{b}") for b in by], F.col("_r").alias("_sr"), "_all", "_before")
    x = x.withColumn("_in", F.sum("_n").over(inside)).join(sums, [F.col("_r") == F.col("_sr"), *same])
    return x.select(*by, c, (F.col("_in") + F.col("_before")).alias("_upto"), "_all")


def quantiles(rows: DataFrame, by: Sequence[str], c: str, shares: Mapping[str, float]) -> DataFrame:
    """by, n and, for each name: share, the value at share * (n - 1) of the group's sorted values, interpolated."""

    def value(q: float) -> Column:
        at = q * (F.col("_all") - 1)
        element = lambda k: F.min(F.when(F.col("_upto") >= k + 1, F.col(c)))
        low, high, place = element(F.floor(at)), element(F.ceil(at)), F.max(at)
        part = place - F.floor(place)
        return F.when(low == high, low).otherwise(times_and_plus(low, 1 - part, part * high))

    x = running_counts(rows.withColumn(c, F.col(c).cast("double")), by, c)
    return x.groupBy(*by).agg(F.max("_all").alias("n"), *[value(q).alias(k) for k, q in shares.items()])


def quantile_bins(rows: DataFrame, c: str, q: int, by: Sequence[str] = (), name: str = "bin") -> DataFrame:
    """Adds the right-closed quantile bin from 0 to q - 1; edges are exact and interpolated, equal edges are one.

    One row of edges a group is joined back; rows are not sorted as a whole.
    """
    found = quantiles(rows.select(*by, c), by, c, {f"_q{k}": k / q for k in range(q + 1)})
    edges = found.select(*[F.col(b).alias(f"_e_{b}") for b in by], F.array_distinct(F.array(*[f"_q{k}" for k in range(q + 1)])).alias("_e"))
    inner = F.slice("_e", 2, F.greatest(F.size("_e") - 2, F.lit(0)))
    x = rows.join(edges, [F.col(b).eqNullSafe(F.col(f"_e_{b}")) for b in by], "left") if by else rows.join(F.broadcast(edges), how="left")  # one row without a group
    return x.withColumn(name, F.when(F.col(c).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(c))))).drop("_e", *[f"_e_{b}" for b in by])
