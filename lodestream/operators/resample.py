"""Time-bucket and activity bars."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.operators.joins import last_before

_UNITS = {"m": ("minute", 1), "h": ("hour", 60), "d": ("day", 1440), "w": ("week", 10080)}


def interval_minutes(text: str) -> int:
    """Minutes of an interval such as 5m, 1h, 1d or 1w."""
    m = re.fullmatch(r"(\d+)([mhdw])", text.strip().lower())
    if not m or not int(m[1]):
        raise ValueError(f"not an interval: {text!r}")
    return int(m[1]) * _UNITS[m[2]][1]


def check_target(source: str, target: str) -> None:
    """A target interval has to be a whole multiple of the source's."""
    a, b = interval_minutes(source), interval_minutes(target)
    if b < a or b % a:
        raise ValueError(f"{target} is not a whole multiple of {source}")


def bucket(ts: Column, every: str, start: str | None = None) -> Column:
    """Start of the bucket that holds ts; weeks start on Monday."""
    if start is None and re.fullmatch(r"1 weeks?|7 days?", every):
        start = "4 days"
    return F.window(ts, every, startTime=start)["start"] if start else F.window(ts, every)["start"]


def resample(ticks: DataFrame, every: str, price: str = "price", volume: str = "amount", tie: str = "trade_id", by: str = "symbol") -> DataFrame:
    """Bars of ticks: left-closed, labelled by their start, empty ones left out. One shuffle after partial aggregation."""
    order = F.struct("ts", tie)
    return (
        ticks.groupBy(by, F.window("ts", every).alias("w"))
        .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(volume).alias("volume"))
        .select(by, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def coarsen(bars: DataFrame, every: str, by: str = "symbol", start: str | None = None, whole: str | None = None) -> DataFrame:
    """Bars of bars. whole: the source's bar length; the last bar of a series goes if the source does not cover it."""
    if start is None and re.fullmatch(r"1 weeks?|7 days?", every):
        start = "4 days"
    w = F.window("ts", every, startTime=start) if start else F.window("ts", every)
    out = bars.groupBy(by, w.alias("w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.max("ts").alias("last")
    )
    if whole:
        out = out.withColumn("end", F.max("last").over(Window.partitionBy(by)) + F.expr(f"INTERVAL {whole}")).where("w.end <= end")
    return out.select(by, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def book_bars(book: DataFrame, every: str, by: str = "symbol") -> DataFrame:
    """Per bucket: OHLC of the mid price, mean and largest spread in basis points, mean quantities, number of ticks."""
    mid = (F.col("bid") + F.col("ask")) / 2
    x = book.withColumn("mid", mid).withColumn("bps", (F.col("ask") - F.col("bid")) / mid * 1e4)
    order = F.struct("ts", "seq")
    return (
        x.groupBy(by, F.window("ts", every).alias("w"))
        .agg(
            F.min_by("mid", order).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", order).alias("close"),
            F.avg("bps").alias("spread_bps"), F.max("bps").alias("max_spread_bps"), F.avg("bid_qty").alias("bid_qty"), F.avg("ask_qty").alias("ask_qty"), F.count(F.lit(1)).alias("n"),
        )
        .select(by, F.col("w.start").alias("ts"), "open", "high", "low", "close", "spread_bps", "max_spread_bps", "bid_qty", "ask_qty", "n")
    )


def running_sum(rows: DataFrame, value: Column, order: Sequence[str], by: str = "symbol", chunk: str = "1 day", name: str = "cum") -> DataFrame:
    """Running sum along a series in two levels: inside time chunks, plus the sums of earlier chunks.

    One long series is spread over as many tasks as it has chunks; the second level has one row a chunk.
    """
    x = rows.withColumn("_c", F.window("ts", chunk)["start"]).withColumn("_v", value)
    sums = x.groupBy(by, "_c").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0.0))).drop("_s")
    inside = Window.partitionBy(by, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("_in", F.sum("_v").over(inside)).join(sums, [by, "_c"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_c", "_v", "_in", "_before")


def activity_bars(ticks: DataFrame, threshold: float, dollars: bool = False, drop_last: bool = False, by: str = "symbol") -> DataFrame:
    """Bars of equal volume, or equal price * amount: a bar ends where the running sum passes a multiple of threshold."""
    value = F.col("price") * F.col("amount") if dollars else F.col("amount")
    x = running_sum(ticks, value, ["ts", "trade_id"], by).withColumn("bar", F.floor(F.col("cum") / threshold))
    order = F.struct("ts", "trade_id")
    signed = lambda s: F.sum(F.when(F.col("side") == s, F.col("amount")).otherwise(0.0))
    out = x.groupBy(by, "bar").agg(
        F.max("ts").alias("ts"), F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("amount").alias("volume"), F.sum(F.col("price") * F.col("amount")).alias("dollars"), signed("buy").alias("buy"), signed("sell").alias("sell"), F.count(F.lit(1)).alias("n"),
    )
    if drop_last:
        out = out.withColumn("_l", F.max("bar").over(Window.partitionBy(by))).where("bar < _l").drop("_l")
    return out


def bars_from_cuts(ticks: DataFrame, cut: Column, by: str = "symbol") -> DataFrame:
    """Bars that end at each tick where cut is true."""
    order = F.struct("ts", "trade_id")
    x = running_sum(ticks.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("bigint")), F.col("_cut"), ["ts", "trade_id"], by, name="bar")
    x = x.withColumn("bar", (F.col("bar") - F.col("_cut")).cast("bigint"))
    return x.groupBy(by, "bar").agg(
        F.max("ts").alias("ts"), F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("amount").alias("volume"), F.sum(F.col("price") * F.col("amount")).alias("dollars"),
    )


def tick_rule(ticks: DataFrame, by: str = "symbol") -> DataFrame:
    """Adds b: sign of the price change, carried over zeros, +1 at the start."""
    x = last_before(ticks, F.col("price"), "_p", ["ts", "trade_id"], by)
    x = x.withColumn("_s", F.nullif(F.signum(F.col("price") - F.col("_p")), F.lit(0.0)))
    x = last_before(x, F.col("_s"), "_c", ["ts", "trade_id"], by)
    return x.withColumn("b", F.coalesce("_s", "_c", F.lit(1.0))).drop("_p", "_s", "_c")


def volume_delta(ticks: DataFrame, every: str, step: str, momentum: int = 12, by: str = "symbol") -> DataFrame:
    """Per calendar bucket, empty ones as zero: delta, volume, running delta (cvd), its change over momentum buckets, share of buys."""
    signed = F.when(F.col("side") == "buy", F.col("amount")).otherwise(-F.col("amount"))
    have = ticks.groupBy(by, F.window("ts", every)["start"].alias("ts")).agg(F.sum(signed).alias("delta"), F.sum("amount").alias("volume"), F.sum(F.when(F.col("side") == "buy", F.col("amount")).otherwise(0.0)).alias("buys"))
    span = have.groupBy(by).agg(F.min("ts").alias("a"), F.max("ts").alias("z")).select(by, F.explode(F.sequence("a", "z", F.expr(f"INTERVAL {step}"))).alias("ts"))
    w = Window.partitionBy(by).orderBy("ts")
    full = span.join(have, [by, "ts"], "left").fillna(0.0, ["delta", "volume", "buys"])
    full = full.withColumn("cvd", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return full.withColumn("momentum", F.col("cvd") - F.lag("cvd", momentum).over(w)).withColumn("buy_ratio", F.col("buys") / F.nullif("volume", F.lit(0.0))).drop("buys")


def closed(bars: DataFrame, every: str, now: Column) -> DataFrame:
    """Bars that have ended."""
    return bars.where(F.col("ts") + F.expr(f"INTERVAL {every}") <= now)


def resample_series(rows: DataFrame, value: str, every: str, tie: str, by: str = "symbol") -> DataFrame:
    """last, mean and sum of a value per bucket; empty buckets are left out."""
    x = rows.groupBy(by, F.window("ts", every).alias("w")).agg(F.max_by(value, F.struct("ts", tie)).alias("last"), F.avg(value).alias("mean"), F.sum(value).alias("sum"))
    return x.select(by, F.col("w.start").alias("ts"), "last", "mean", "sum")


def hourly_ratios(rows: DataFrame, value: str, tie: str = "trade_id", by: str = "symbol") -> DataFrame:
    """n, Sharpe and Sortino (not annualised) of hourly changes of a value."""
    h = resample_series(rows, value, "1 hour", tie, by)
    r = h.select(by, (F.col("last") / F.lag("last").over(Window.partitionBy(by).orderBy("ts")) - 1).alias("r"))
    down = F.sqrt(F.avg(F.least(F.col("r"), F.lit(0.0)) ** 2))
    # least skips NULL: the first hour has no change
    return r.where("r is not null").groupBy(by).agg(F.count("r").alias("n"), (F.avg("r") / F.nullif(F.stddev_pop("r"), F.lit(0.0))).alias("sharpe_hourly"), (F.avg("r") / F.nullif(down, F.lit(0.0))).alias("sortino_hourly"))
