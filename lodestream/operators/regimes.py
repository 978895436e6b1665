"""Market states and the gates that use them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators import features as ft
from lodestream.operators.scan import ema

TREND_THRESHOLD = 0.35


def trend_strength(bars: DataFrame, fast: int = 9, slow: int = 50) -> DataFrame:
    """Adds ema_<fast>, ema_<slow> and strength: their distance over the deviation of the last slow closes, at most 1."""
    missing = [n for n in (fast, slow) if f"ema_{n}" not in bars.columns]
    x = ema(bars, "close", *missing) if missing else bars
    dev = ft.full(F.stddev_samp("close").over(ft.last_n(slow)), slow)
    gap = F.abs(F.col(f"ema_{fast}") - F.col(f"ema_{slow}"))
    return x.withColumn("strength", F.least(F.lit(1.0), F.coalesce(gap / F.nullif(dev, F.lit(0.0)), F.lit(0.0))))


def market_structure(bars: DataFrame, fast: int = 9, slow: int = 50, threshold: float = TREND_THRESHOLD) -> DataFrame:
    """Adds structure: range below the threshold of strength, else trend_up or trend_down."""
    x = trend_strength(bars, fast, slow)
    up = F.col(f"ema_{fast}") > F.col(f"ema_{slow}")
    return x.withColumn("structure", F.when(F.col("strength") < threshold, "range").when(up, "trend_up").otherwise("trend_down"))


def market_state(bars: DataFrame, **more) -> DataFrame:
    """Adds structure, vol and label (structure|vol)."""
    x = ft.volatility_regime(market_structure(bars, **more)).withColumnRenamed("vol_regime", "vol")
    return x.withColumn("label", F.concat_ws("|", "structure", "vol"))


def funding_skew(rates: DataFrame, n: int = 720, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Adds skew: z of the rate among the last n, half of them at least, within -3 and 3; 0 for series shorter than n."""
    w = ft.series("symbol", order).rowsBetween(-(n - 1), 0)
    z = (F.col("rate") - F.avg("rate").over(w)) / F.nullif(F.stddev_samp("rate").over(w), F.lit(0.0))
    # the whole series' length is a partial aggregate, joined back
    long = rates.groupBy("symbol").count().where(F.col("count") >= max(n, 20)).select("symbol", F.lit(True).alias("_long"))
    x = rates.withColumn("_z", F.when(F.count("rate").over(w) >= n // 2, F.least(F.lit(3.0), F.greatest(F.lit(-3.0), z)))).join(long, "symbol", "left")
    return x.withColumn("skew", F.when(F.col("_long"), F.coalesce("_z", F.lit(0.0))).otherwise(0.0)).drop("_z", "_long")


def liquidity_label(bars: DataFrame, n: int = 120) -> DataFrame:
    """Adds liquidity: low where illiquidity (size of the return over money traded) is above its rolling median by 1.5 interquartile ranges, high where below by half of one, else normal."""
    ill = F.abs(F.coalesce(ft.ret("close"), F.lit(0.0))) / F.greatest(F.col("close") * F.col("volume"), F.lit(1e-12))
    x = bars.withColumn("_ill", ill)
    w = ft.last_n(n)
    at = lambda p: F.percentile("_ill", F.lit(p)).over(w)
    x = x.withColumns({"_m": at(0.5), "_q": F.greatest(at(0.75) - at(0.25), F.lit(1e-15)), "_c": F.count("_ill").over(w)})
    label = F.when(F.col("_c") < n // 2, "normal").when(F.col("_ill") < F.greatest(F.col("_m") - 0.5 * F.col("_q"), F.lit(0.0)), "high").when(F.col("_ill") > F.col("_m") + 1.5 * F.col("_q"), "low")
    return x.withColumn("liquidity", label.otherwise("normal")).drop("_ill", "_m", "_q", "_c")


def regime_gates(sig: Column, vol: Column, structure: Column, high_vol_veto: bool = True, trend_direction: bool = True) -> Column:
    """The signal, 0 in high volatility, for shorts in an upward and for longs in a downward trend."""
    out = sig
    if high_vol_veto:
        out = F.when(F.coalesce(vol, F.lit("normal")) == "high", 0.0).otherwise(out)
    if trend_direction:
        trend = F.coalesce(structure, F.lit("range"))
        out = F.when(((trend == "trend_up") & (out < 0)) | ((trend == "trend_down") & (out > 0)), 0.0).otherwise(out)
    return out


def preferred_only(signals: DataFrame, preferred: Mapping[str, Sequence[str]]) -> DataFrame:
    """Signals (strategy, label, sig): 0 where the label's structure or the label itself is none that the strategy prefers; strategies without an entry stay."""
    want = F.create_map(*[x for k, v in preferred.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    mine = F.element_at(want, F.col("strategy"))
    fits = mine.isNull() | F.array_contains(mine, F.col("label")) | F.array_contains(mine, F.substring_index("label", "|", 1))
    return signals.withColumn("sig", F.when(fits, F.col("sig")).otherwise(0.0))


def breakeven_gate(sig: Column, move: Column, close: Column, round_trip: float) -> Column:
    """0 where the expected move is a smaller share of the price than a round trip costs."""
    return F.when(move / F.nullif(close, F.lit(0.0)) >= round_trip, sig).otherwise(0.0)
