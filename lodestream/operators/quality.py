"""Reports on bars, trades, funding and books: one pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _count(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))


def bar_report(bars: DataFrame, step_seconds: int = 3600, by: Sequence[str] = ("symbol",), now: str | None = None, spike: float = 0.05) -> DataFrame:
    """rows, duplicates, bad_ohlc, missing, gaps, spikes, future, flat_run of each series."""
    w = Window.partitionBy(*by).orderBy("ts")
    x = bars.withColumn("_d", F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(w))).withColumn("_r", F.abs(F.col("close") / F.lag("close").over(w) - 1))
    x = x.withColumn("_same", F.when(F.col("close") == F.lag("close").over(w), 0).otherwise(1)).withColumn("_g", F.sum("_same").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_run", F.count(F.lit(1)).over(Window.partitionBy(*by, "_g")))
    mid = x.groupBy(*by).agg(F.percentile("_r", F.lit(0.5)).alias("_m"))
    x = x.join(mid, list(by))
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")) | (F.col("low") <= 0)
    return x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), _count(F.col("_d") == 0).alias("duplicates"), _count(bad).alias("bad_ohlc"), _count(F.col("open").isNull() | F.col("close").isNull()).alias("missing"), _count(F.col("_d") > 1.5 * step_seconds).alias("gaps"),
        _count(F.col("_r") > F.greatest(F.lit(spike), 20 * F.col("_m"))).alias("spikes"), _count(F.col("ts") > F.lit(now).cast("timestamp") if now else F.lit(False)).alias("future"), F.max("_run").alias("flat_run"),
    )


def is_critical() -> Column:
    return (F.col("duplicates") > 0) | (F.col("bad_ohlc") > 0) | (F.col("missing") > 0) | (F.col("future") > 0)


def trade_report(ticks: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """rows, ids, bad values, missing sides and the share of the id range that is there."""
    return ticks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("trade_id").alias("ids"), _count((F.col("price") <= 0) | (F.col("amount") <= 0)).alias("bad"), _count(~F.coalesce(F.col("side").isin("buy", "sell"), F.lit(False))).alias("no_side"),
        (F.count_distinct("trade_id") / (F.max("trade_id") - F.min("trade_id") + 1)).alias("id_coverage"),
    )


def funding_report(funding: DataFrame, most: float, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """rows, missing rates, rates beyond the limit, median step and steps beyond 1.5 times it."""
    w = Window.partitionBy(*by).orderBy("ts", "seq")
    x = funding.withColumn("_d", F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(w)))
    m = x.groupBy(*by).agg(F.percentile("_d", F.lit(0.5)).alias("step"))
    return x.join(m, list(by)).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), _count(F.col("rate").isNull()).alias("missing"), _count(F.abs("rate") > most).alias("beyond"), F.first("step").alias("step"), _count(F.col("_d") > 1.5 * F.col("step")).alias("gaps"))


def book_report(book: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """rows, crossed and invalid quotes."""
    invalid = (F.col("bid") <= 0) | (F.col("ask") <= 0) | (F.col("bid_qty") < 0) | (F.col("ask_qty") < 0)
    return book.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), _count(F.col("bid") > F.col("ask")).alias("crossed"), _count(invalid).alias("invalid"))


def depth_report(depth: DataFrame, levels: int = 5, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """rows, crossed tops, negative quantities and levels out of order of wide books (bid1.., bid1_qty.., ask1.., ask1_qty..)."""
    bids, asks = [F.col(f"bid{k}") for k in range(1, levels + 1)], [F.col(f"ask{k}") for k in range(1, levels + 1)]
    order = F.lit(False)
    for a, b in zip(bids, bids[1:], strict=False):
        order = order | (b > a)
    for a, b in zip(asks, asks[1:], strict=False):
        order = order | (b < a)
    negative = F.lit(False)
    for k in range(1, levels + 1):
        negative = negative | (F.col(f"bid{k}_qty") < 0) | (F.col(f"ask{k}_qty") < 0)
    return depth.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), _count(bids[0] > asks[0]).alias("crossed"), _count(negative).alias("negative"), _count(order).alias("disorder"))
