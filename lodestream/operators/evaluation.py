"""Evaluation tables over runs: capacity, stress, regime maps, limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.functions.numbers import share_of


def sharpe(c: str) -> Column:
    return F.avg(c) / F.nullif(F.stddev_pop(c), F.lit(0.0)) * F.sqrt(F.count(F.lit(1)))


def capacity_curve(rows: DataFrame, scales: Sequence[float], k: float, by: str = "symbol") -> DataFrame:
    """Sharpe at each scale, with square-root impact of turnover * scale in volume; columns ret, turnover, volume."""
    x = rows.withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))
    x = x.withColumn("_r", F.col("ret") - k * F.col("turnover") * F.sqrt(F.col("turnover") * F.col("scale") / F.nullif("volume", F.lit(0.0))))
    return x.groupBy(by, "scale").agg(F.avg("_r").alias("mean"), sharpe("_r").alias("sharpe"))


def stress(rows: DataFrame, n: int, factor: float, extra: float, by: str = "symbol") -> DataFrame:
    """Total result of scenarios: base, the worst n rows in a row times factor, extra cost on each change of position."""
    w = Window.partitionBy(by).orderBy("ts")
    x = rows.withColumn("_s", F.sum("ret").over(w.rowsBetween(-(n - 1), 0))).withColumn("_i", F.row_number().over(w))
    worst = x.where(F.col("_i") >= n).groupBy(by).agg(F.min_by("_i", F.struct("_s", "_i")).alias("_z"))
    x = x.join(worst, by)
    bad = (F.col("_i") <= F.col("_z")) & (F.col("_i") > F.col("_z") - n)
    return x.groupBy(by).agg(F.sum("ret").alias("base"), F.sum(F.when(bad, F.col("ret") * factor).otherwise(F.col("ret"))).alias("worst_window"), F.sum(F.col("ret") - F.col("turnover") * extra).alias("costs"))


def without_best(trades: DataFrame, n: int, by: Sequence[str], ties: Sequence[str], ret: str = "ret") -> DataFrame:
    """Result without the n best trades of each group: how concentrated it is."""
    w = Window.partitionBy(*by).orderBy(F.desc(ret), *ties)
    return trades.withColumn("_k", F.row_number().over(w)).groupBy(*by).agg(F.sum(ret).alias("total"), F.coalesce(F.sum(F.when(F.col("_k") > n, F.col(ret))), F.lit(0.0)).alias("without_best"))


def regime_map(rows: DataFrame, least: int, label: str = "label", strategy: str = "strategy", ret: str = "ret") -> DataFrame:
    """Sharpe of each (label, strategy) with enough rows, its rank in the label, and weights in proportion to positive Sharpe."""
    x = rows.where(F.col(label).isNotNull()).groupBy(label, strategy).agg(F.count(F.lit(1)).alias("n"), (F.avg(ret) / F.nullif(F.stddev_pop(ret), F.lit(0.0))).alias("sharpe")).where(F.col("n") >= least)
    w = Window.partitionBy(label)
    good = F.greatest("sharpe", F.lit(0.0))
    return x.withColumn("rank", F.row_number().over(w.orderBy(F.desc("sharpe"), strategy))).withColumn("weight", F.coalesce(good / F.nullif(F.sum(good).over(w), F.lit(0.0)), F.lit(0.0)))


def holdout(rows: DataFrame, share: float, by: str = "symbol") -> DataFrame:
    """Adds part: research, or holdout for the last share of a series' rows."""
    w = Window.partitionBy(by)
    i, n = F.row_number().over(w.orderBy("ts")), F.count(F.lit(1)).over(w)
    return rows.withColumn("_i", i).withColumn("_n", n).withColumn("part", F.when(F.col("_i") > F.col("_n") - share_of(F.col("_n"), share), "holdout").otherwise("research")).drop("_i", "_n")


def tracking(a: DataFrame, b: DataFrame, by: str = "symbol", ret: str = "ret") -> DataFrame:
    """Deviation of the difference of two return series on common times, and their correlation."""
    x = a.select(by, "ts", F.col(ret).alias("ra")).join(b.select(by, "ts", F.col(ret).alias("rb")), [by, "ts"])
    return x.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(F.col("ra") - F.col("rb")).alias("tracking_error"), F.corr("ra", "rb").alias("rho"))


def exposure(positions: DataFrame, equity: float, leverage: float, share: float) -> DataFrame:
    """Per time: gross notional over equity, the largest symbol's part, and whether a limit is broken (columns ts, symbol, notional)."""
    x = positions.groupBy("ts").agg(F.sum(F.abs("notional")).alias("gross"), F.max(F.abs("notional")).alias("largest"))
    x = x.withColumn("leverage", F.col("gross") / equity).withColumn("top_share", F.col("largest") / F.nullif("gross", F.lit(0.0)))
    return x.withColumn("broken", (F.col("leverage") > leverage) | (F.coalesce("top_share", F.lit(0.0)) > share)).drop("largest")


def hawkes(events: DataFrame, beta: float, by: str = "symbol", order: Sequence[str] = ("ts",), mark: str | None = None, name: str = "intensity") -> DataFrame:
    """Adds intensity (or name): sum over events so far of exp(-beta * seconds since), times their mark if one is given. Two levels: inside chunks of time, and one decayed value a chunk.

    Inside a chunk times are measured from its start, so that no exponent grows beyond the chunk's length.
    """
    length = max(1.0, 20.0 / beta)
    t = F.unix_micros("ts") / 1e6
    x = events.withColumn("_c", F.floor(t / length)).withColumn("_d", t - F.floor(t / length) * length)
    w = Window.partitionBy(by, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    each = F.exp(beta * F.col("_d")) * (F.col(mark) if mark else F.lit(1.0))
    x = x.withColumn("_in", F.sum(each).over(w))
    ends = x.groupBy(by, "_c").agg((F.sum(each) * F.exp(F.lit(-beta * length))).alias("_e"))
    # two chunks back the weight is below exp(-20)
    one, two = ends.select(by, (F.col("_c") + 1).alias("_c"), F.col("_e").alias("_e1")), ends.select(by, (F.col("_c") + 2).alias("_c"), (F.col("_e") * F.exp(F.lit(-beta * length))).alias("_e2"))
    x = x.join(one, [by, "_c"], "left").join(two, [by, "_c"], "left")
    total = F.col("_in") + F.coalesce("_e1", F.lit(0.0)) + F.coalesce("_e2", F.lit(0.0))
    return x.withColumn(name, total * F.exp(-beta * F.col("_d"))).drop("_c", "_d", "_in", "_e1", "_e2")
