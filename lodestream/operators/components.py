"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import drop_since, mark, settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Edges (u, v); of each centre u, neighbours are linked to its smallest neighbour instead.

    The smallest neighbour is a partial aggregate, and the join back is one that Spark can split where a centre is hot.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component) of every id on an edge; the component is its smallest id.

    Null ends and loops are left out. Rounds grow with the logarithm of the number of ids; each is written to the shared
    folder, and only a count and a checksum reach the driver.
    """
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    spark, point = edges.sparkSession, mark(edges.sparkSession)
    now = settle(now, "edges")
    last = None
    while True:
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == last or not seen[0]:
            break
        last = seen
        now = settle(_stars(_stars(now, True), False), "edges")
        drop_since(spark, point, keep=1)
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
