"""Labels and weights of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.operators.features import series


def triple_barrier(bars: DataFrame, target: str, up: float, down: float, horizon: int, by: str = "symbol", side: str | None = None) -> DataFrame:
    """Adds t1, label and path_ret: the first of the profit barrier (1), the loss barrier (-1) or the end of the horizon (0).

    Barriers stand up (profit) and down (loss) times target away from the close, for a side of -1 (column side) the other way
    round, so that a fall is the profit. The path starts with the next bar and reads highs and lows; if both are touched in one
    bar the loss counts. path_ret is the position's return. The next bars come as one framed list of at most horizon structs.
    """
    w = series(by).rowsBetween(1, horizon)
    x = bars.withColumn("_f", F.collect_list(F.struct("ts", "high", "low", "close")).over(w))
    s = F.col(side).cast("double") if side else F.lit(1.0)
    gain, loss = F.col("close") * (1 + s * up * F.col(target)), F.col("close") * (1 - s * down * F.col(target))
    won = lambda b: F.when(s > 0, b["high"] >= gain).otherwise(b["low"] <= gain)
    lost = lambda b: F.when(s > 0, b["low"] <= loss).otherwise(b["high"] >= loss)
    x = x.withColumn("_t", F.get(F.filter("_f", lambda b: won(b) | lost(b)), F.lit(0))).withColumn("_e", F.get("_f", F.size("_f") - 1))
    x = x.withColumn("label", F.when(F.col("_t").isNull(), 0).when(lost(F.col("_t")), -1).otherwise(1)).withColumn("t1", F.coalesce(F.col("_t.ts"), F.col("_e.ts")))
    end = F.when(F.col("label") == 1, gain).when(F.col("label") == -1, loss).otherwise(F.col("_e.close"))
    return x.withColumn("path_ret", s * (end / F.col("close") - 1)).where("t1 is not null").drop("_f", "_t", "_e")


def horizon_label(bars: DataFrame, h: int, noise: float, by: str = "symbol") -> DataFrame:
    """Adds label: sign of the return over h bars, 0 within the noise, NULL at the end."""
    r = F.lead("close", h).over(series(by)) / F.col("close") - 1
    return bars.withColumn("fwd", r).withColumn("label", F.when(F.col("fwd").isNull(), None).when(F.abs("fwd") <= noise, 0).otherwise(F.signum("fwd").cast("int")))


def concurrency(events: DataFrame, bars: DataFrame, by: str = "symbol") -> DataFrame:
    """Number of events [ts, t1] open at each bar: one running sum over starts and ends, no range join."""
    marks = events.select(by, "ts", F.lit(1).alias("d"), F.lit(0).alias("o")).unionByName(events.select(by, F.col("t1").alias("ts"), F.lit(-1).alias("d"), F.lit(2).alias("o")))
    marks = marks.groupBy(by, "ts", "o").agg(F.sum("d").alias("d"))
    x = marks.unionByName(bars.select(by, "ts", F.lit(1).alias("o"), F.lit(0).cast("bigint").alias("d")))
    w = Window.partitionBy(by).orderBy("ts", "o").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("open", F.sum("d").over(w)).where("o = 1").select(by, "ts", "open")


def uniqueness(events: DataFrame, bars: DataFrame, by: str = "symbol") -> DataFrame:
    """Mean of 1 / open events over each event's bars: difference of running sums at its ends."""
    w = series(by).rowsBetween(Window.unboundedPreceding, 0)
    c = concurrency(events, bars, by).withColumn("_i", F.row_number().over(series(by))).withColumn("_s", F.sum(F.when(F.col("open") > 0, 1 / F.col("open")).otherwise(0.0)).over(w)).withColumn("_v", F.when(F.col("open") > 0, 1 / F.col("open")).otherwise(0.0))
    a = c.select(by, "ts", F.col("_s").alias("sa"), F.col("_v").alias("va"), F.col("_i").alias("ia"))
    z = c.select(by, F.col("ts").alias("t1"), F.col("_s").alias("sz"), F.col("_i").alias("iz"))
    x = events.join(a, [by, "ts"]).join(z, [by, "t1"])
    return x.withColumn("uniqueness", (F.col("sz") - F.col("sa") + F.col("va")) / (F.col("iz") - F.col("ia") + 1)).drop("sa", "va", "ia", "sz", "iz")
