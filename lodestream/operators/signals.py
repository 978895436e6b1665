"""Signal tables: rules as column logic over feature tables. All signals lie in [-1, 1] on the bar they are known at."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.operators import features as ft
from lodestream.operators import regimes as rg
from lodestream.operators.scan import ema

#: Rule name -> function of bars that adds the column sig; users add their own.
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {}
#: Columns that a rule needs beyond bars, checked before it runs.
NEEDS: dict[str, tuple[str, ...]] = {}


def strategy(name: str, needs: Sequence[str] = ()) -> Callable:
    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        STRATEGIES[name], NEEDS[name] = f, tuple(needs)
        return f

    return add


def signals(name: str, bars: DataFrame) -> DataFrame:
    missing = set(NEEDS[name]) - set(bars.columns)
    if missing:
        raise ValueError(f"{name} needs {sorted(missing)}")
    return STRATEGIES[name](bars)


def listing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, list(NEEDS[k])) for k in sorted(STRATEGIES)], "strategy string, needs array<string>")


@strategy("mean_reversion")
def mean_reversion(
    bars: DataFrame, oversold: float = 30.0, overbought: float = 70.0, n: int = 20, min_atr: float = 0.001, stop_atr: float = 2.0, max_trend: float = 0.6, skip_high_vol: bool = True, traced: bool = False
) -> DataFrame:
    """Long when RSI is oversold below the lower band, short in the mirror case; only with enough range, a weak trend and no high volatility.

    Out at the middle of the bands, or beyond it by stop_atr ranges on the losing side. traced adds raw (the entry before
    filters) and blocked_by.
    """
    x = rg.trend_strength(ft.rsi_atr(bars, emas=(9, 50)))
    x = ft.volatility_regime(x)
    lo, mid, hi = (ft.full(c, n) for c in ft.bollinger("close", n, 2.0))
    x = x.withColumns({"_lo": lo, "mid": mid, "_hi": hi})
    raw = F.when((F.col("rsi") < oversold) & (F.col("close") < F.col("_lo")), 1.0).when((F.col("rsi") > overbought) & (F.col("close") > F.col("_hi")), -1.0)
    blocks = {"range": F.col("atr") / F.nullif("close", F.lit(0.0)) < min_atr, "trend": F.col("strength") >= max_trend}
    if skip_high_vol:
        blocks["volatility"] = F.col("vol_regime") == "high"
    why = F.array_compact(F.array(*[F.when(raw.isNotNull() & F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in blocks.items()]))
    x = x.withColumns({"raw": F.coalesce(raw, F.lit(0.0)), "blocked_by": why})
    x = x.withColumn("_raw", F.when((F.col("raw") != 0) & (F.size("blocked_by") == 0), F.col("raw")))
    stop = F.col("atr") * stop_atr
    leave = ((F.col("held") == 1) & ((F.col("close") >= F.col("mid")) | (F.col("close") < F.col("mid") - stop))) | ((F.col("held") == -1) & ((F.col("close") <= F.col("mid")) | (F.col("close") > F.col("mid") + stop)))
    x = ft.hold(x, "_raw", leave, exit_first=True).drop("_raw", "_lo", "_hi")
    return x if traced else x.drop("raw", "blocked_by")


@strategy("zscore_reversion")
def zscore_reversion(bars: DataFrame, n: int = 24, enter: float = 1.5, leave: float = 0.25) -> DataFrame:
    """Short above a rolling z of enter, long below minus enter, out when |z| is within leave."""
    x = bars.withColumn("z", ft.full(ft.zscore("close", n), n))
    x = x.withColumn("_raw", F.when(F.col("z") >= enter, -1.0).when(F.col("z") <= -enter, 1.0))
    return ft.hold(x, "_raw", F.abs("z") <= leave).drop("_raw")


@strategy("momentum")
def momentum(bars: DataFrame, n: int = 24, look: int = 96, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Long above the rolling high quantile of the n-bar return, short below the low one."""
    x = bars.withColumn("_m", ft.ret("close", n))
    w = ft.last_n(look)
    x = x.withColumn("_lo", F.percentile("_m", F.lit(low)).over(w)).withColumn("_hi", F.percentile("_m", F.lit(high)).over(w)).withColumn("_c", F.count("_m").over(w))
    return x.withColumn("sig", F.when((F.col("_c") < n) | F.col("_m").isNull(), 0.0).when(F.col("_m") > F.col("_hi"), 1.0).when(F.col("_m") < F.col("_lo"), -1.0).otherwise(0.0)).drop("_m", "_lo", "_hi", "_c")


@strategy("cross_momentum")
def cross_momentum(bars: DataFrame, n: int = 24, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Long the symbols with the highest n-bar returns of a time, short the lowest."""
    x = bars.withColumn("_m", ft.ret("close", n)).where("_m is not null")
    x = ft.cross_section(x, "_m")
    return x.withColumn("sig", F.when(F.col("pct_rank") >= high, 1.0).when(F.col("pct_rank") <= low, -1.0).otherwise(0.0)).drop("_m", "cs_z")


@strategy("volume_delta", ["delta"])
def volume_delta(bars: DataFrame, n: int = 24, enter: float = 1.0) -> DataFrame:
    """With the rolling z of signed volume; out when it changes sign."""
    x = bars.withColumn("z", ft.zscore("delta", n))
    x = x.withColumn("_raw", F.when(F.col("z") >= enter, 1.0).when(F.col("z") <= -enter, -1.0))
    return ft.hold(x, "_raw", F.col("z") * F.col("held") < 0).drop("_raw")


def funding_carry(rates: DataFrame, enter: float, by: str = "symbol") -> DataFrame:
    """Signal rows at funding times from the rate before: against a rate beyond enter. Align to bars with asof_join."""
    prev = F.lag("rate").over(Window.partitionBy(by).orderBy("ts", "seq"))
    return rates.withColumn("sig", F.when(prev > enter, -1.0).when(prev < -enter, 1.0).otherwise(0.0))


def pair_spread(legs: DataFrame, n: int = 48, enter: float = 1.5, leave: float = 0.3) -> DataFrame:
    """Log ratio of two legs (c1, c2) with its rolling z and a held position."""
    x = legs.withColumn("symbol", F.lit("pair")).withColumn("spread", F.ln(F.col("c1") / F.col("c2")))
    x = x.withColumn("z", ft.full(ft.zscore("spread", n), n))
    x = x.withColumn("_raw", F.when(F.col("z") >= enter, -1.0).when(F.col("z") <= -enter, 1.0))
    return ft.hold(x, "_raw", F.abs("z") <= leave).drop("_raw")


def trace(rows: DataFrame, filters: dict[str, Column], raw: str = "raw") -> DataFrame:
    """Adds blocked_by (names of the filters that object) and sig (raw where none does)."""
    x = rows.withColumn("blocked_by", F.array_compact(F.array(*[F.when((F.col(raw) != 0) & F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in filters.items()])))
    return x.withColumn("sig", F.when(F.size("blocked_by") == 0, F.col(raw)).otherwise(0.0))


def ensemble(signals_: DataFrame, mode: str = "mean", by: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Long table of signals (column sig, weight for weighted) to one: mean, vote (only where all agree) or weighted (sum / n)."""
    s = F.col("sig")
    value = {"mean": F.avg(s), "vote": F.when(F.min(s) > 0, 1.0).when(F.max(s) < 0, -1.0).otherwise(0.0)}
    out = value[mode] if mode in value else F.sum(s * F.col("weight")) / F.count(F.lit(1))
    return signals_.groupBy(*by).agg(out.alias("sig"))


def hedge_weights(losses: DataFrame, eta: float, by: str = "symbol") -> DataFrame:
    """Weights of experts from their losses before each time: exp(-eta * sum), normalised over experts."""
    before = Window.partitionBy(by, "expert").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    x = losses.withColumn("_c", F.coalesce(F.sum("loss").over(before), F.lit(0.0)))
    g = Window.partitionBy(by, "ts")
    x = x.withColumn("_e", F.exp(-eta * (F.col("_c") - F.min("_c").over(g))))
    return x.withColumn("weight", F.col("_e") / F.sum("_e").over(g)).drop("_c", "_e")


@strategy("cvd_momentum", ["delta"])
def cvd_momentum(bars: DataFrame, n: int = 12, threshold: float = 0.0, least_volume: float = 1.0) -> DataFrame:
    """With price above (below) its fast mean and the running delta's change over n bars, a share of 20 bars' volume, on the same side; out when either turns."""
    w = ft.series()
    x = ema(bars, "close", 9)
    x = x.withColumn("_cvd", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v20 = F.when(F.count(F.lit(1)).over(ft.last_n(20)) >= 5, F.sum("volume").over(ft.last_n(20)))
    x = x.withColumns({"mom": F.coalesce((F.col("_cvd") - F.lag("_cvd", n).over(w)) / F.nullif(v20, F.lit(0.0)), F.lit(0.0)), "_ratio": F.col("volume") / F.nullif(ft.sma("volume", 20), F.lit(0.0))})
    above, below, buy, sell = F.col("close") > F.col("ema_9"), F.col("close") < F.col("ema_9"), F.col("mom") > threshold, F.col("mom") < -threshold
    enough = F.col("_ratio") >= least_volume
    x = x.withColumn("_raw", F.when(below & sell & enough, -1.0).when(above & buy & enough, 1.0))
    leave = ((F.col("held") == 1) & (below | sell)) | ((F.col("held") == -1) & (above | buy))
    return ft.hold(x, "_raw", leave, exit_first=True).drop("_raw", "_cvd", "_ratio")


def book_imbalance(bars: DataFrame, n: int = 48, enter: float = 1.5) -> DataFrame:
    """With the rolling z of the book's imbalance (column imb); out when it changes sign."""
    x = bars.withColumn("z", F.coalesce(ft.full(ft.zscore("imb", n), n), F.lit(0.0)))
    x = x.withColumn("_raw", F.when(F.col("z") > enter, 1.0).when(F.col("z") < -enter, -1.0))
    return ft.hold(x, "_raw", F.col("z") * F.col("held") < 0, exit_first=True).drop("_raw")


def funding_arbitrage(rates: DataFrame, enter: float, leave: float, by: str = "symbol") -> DataFrame:
    """Carry at funding times from the rate before: 1 (short the perpetual) above enter, -1 below minus enter, else 0; 0 within leave."""
    prev = F.coalesce(F.lag("rate").over(Window.partitionBy(by).orderBy("ts", "seq")), F.lit(0.0))
    return rates.withColumn("sig", F.when(F.abs(prev) < leave, 0.0).when(prev > enter, 1.0).when(prev < -enter, -1.0).otherwise(0.0))


def basis_reversion(legs: DataFrame, n: int = 240, enter: float = 2.0, leave: float = 0.5, leave_bps: float = 2.0) -> DataFrame:
    """On the rolling z of c1 / c2 - 1, half a window at least; out when it or the basis itself is small."""
    x = legs.withColumn("symbol", F.lit("pair")).withColumn("basis", F.col("c1") / F.col("c2") - 1)
    x = x.withColumn("z", F.when(F.count("basis").over(ft.last_n(n)) >= n // 2, ft.zscore("basis", n)).otherwise(0.0))
    x = x.withColumn("_raw", F.when(F.col("z") > enter, 1.0).when(F.col("z") < -enter, -1.0))
    return ft.hold(x, "_raw", (F.abs("basis") < leave_bps / 1e4) | (F.abs("z") < leave), exit_first=True).drop("_raw")


def stoch_rsi(bars: DataFrame, n: int = 14, k: int = 3, d: int = 3, low: float = 20.0, high: float = 80.0) -> DataFrame:
    """Adds k and d (smoothed place of RSI in its range over n bars, 0 to 100) and cross_side: k crosses d upwards below low (1), downwards above high (-1)."""
    x = ft.rsi_atr(bars)
    w, low_n = ft.series(), ft.last_n(n)
    place = (F.col("rsi") - F.min("rsi").over(low_n)) / F.nullif(F.max("rsi").over(low_n) - F.min("rsi").over(low_n), F.lit(0.0)) * 100
    x = x.withColumn("_p", ft.full(place, n))
    mean = lambda c, m: F.when(F.count(c).over(ft.last_n(m)) >= m, F.avg(c).over(ft.last_n(m)))
    x = x.withColumn("k", mean("_p", k)).withColumn("d", mean("k", d))
    x = x.withColumns({"_k1": F.lag("k").over(w), "_d1": F.lag("d").over(w)})
    up = (F.col("_k1") <= F.col("_d1")) & (F.col("k") > F.col("d")) & (F.col("k") < low)
    down = (F.col("_k1") >= F.col("_d1")) & (F.col("k") < F.col("d")) & (F.col("k") > high)
    return x.withColumn("cross_side", F.when(up, 1).when(down, -1).otherwise(0)).drop("_p", "_k1", "_d1")


def opposites(rows: DataFrame) -> DataFrame:
    """Long table (symbol, ts, label, strategy, sig, ret) of a rule and its opposite."""
    both = F.array(F.struct(F.lit("follow").alias("strategy"), F.col("sig").alias("sig"), F.col("ret").alias("ret")), F.struct(F.lit("revert").alias("strategy"), (-F.col("sig")).alias("sig"), (-F.col("ret")).alias("ret")))
    return rows.select("symbol", "ts", "label", F.explode(both).alias("_x")).select("symbol", "ts", "label", "_x.*")


def regime_blend(long: DataFrame) -> DataFrame:
    """Signals weighted by what their strategy earned on average in the label, equal where none earned."""
    g = Window.partitionBy("label")
    mean = long.groupBy("label", "strategy").agg(F.greatest(F.avg("ret"), F.lit(0.0)).alias("_m"))
    weight = F.when(F.sum("_m").over(g) > 0, F.col("_m") / F.sum("_m").over(g)).otherwise(1 / F.count(F.lit(1)).over(g))
    mean = mean.withColumn("_w", weight)
    return long.join(mean, ["label", "strategy"]).groupBy("symbol", "ts").agg(F.sum(F.col("sig") * F.col("_w")).alias("sig"))


def best_prior(long: DataFrame) -> DataFrame:
    """The signal of the strategy that earned most on average in the label; by name where equal."""
    mean = long.groupBy("label", "strategy").agg(F.avg("ret").alias("_m"))
    best = mean.withColumn("_k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("_m"), "strategy"))).where("_k = 1")
    return long.join(best.select("label", "strategy"), ["label", "strategy"]).select("symbol", "ts", "sig")


def regime_capital(structures: Sequence[str], vols: Sequence[str], otherwise: float) -> Column:
    """Share of capital by how the state (structure, vol) suits: each part that does not costs the factor otherwise."""
    return F.when(F.col("structure").isin(list(structures)), 1.0).otherwise(otherwise) * F.when(F.col("vol").isin(list(vols)), 1.0).otherwise(otherwise)


def contextual_hedge(losses: DataFrame, eta: float, least: int, by: str = "symbol") -> DataFrame:
    """Hedge weights from the losses before in the same label, or in all where the label has been seen fewer than least times."""
    upto = (Window.unboundedPreceding, -1)
    own = Window.partitionBy(by, "label", "expert").orderBy("ts").rowsBetween(*upto)
    every = Window.partitionBy(by, "expert").orderBy("ts").rowsBetween(*upto)
    x = losses.withColumns({"_n": F.count(F.lit(1)).over(own), "_own": F.coalesce(F.sum("loss").over(own), F.lit(0.0)), "_all": F.coalesce(F.sum("loss").over(every), F.lit(0.0))})
    x = x.withColumn("_c", F.when(F.col("_n") >= least, F.col("_own")).otherwise(F.col("_all")))
    g = Window.partitionBy(by, "ts")
    x = x.withColumn("_e", F.exp(-eta * (F.col("_c") - F.min("_c").over(g))))
    return x.withColumn("weight", F.col("_e") / F.sum("_e").over(g)).drop("_n", "_own", "_all", "_c", "_e")


def time_stop(rows: DataFrame, spread: str, factor: float, n: int, by: str = "symbol") -> DataFrame:
    """Signals set to 0 once held longer than factor half-lives of the spread, estimated on the n rows before."""
    w = ft.series(by)
    x = rows.withColumn("_s1", F.lag(spread).over(w)).withColumn("_ds", F.col(spread) - F.col("_s1"))
    before = w.rowsBetween(-n, -1)
    cov, var = F.covar_pop("_ds", "_s1").over(before), F.var_pop("_s1").over(before)
    x = x.withColumn("_hl", F.when((F.count("_ds").over(before) >= n // 2) & (cov < 0), -F.ln(F.lit(2.0)) * var / cov))
    x = x.withColumn("_run", F.sum(F.when(F.col("sig") == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.sum(F.when(F.col("sig") != 0, 1).otherwise(0)).over(Window.partitionBy(by, "_run").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_held", held)
    return x.withColumn("sig", F.when(F.col("_held") > factor * F.col("_hl"), 0.0).otherwise(F.col("sig"))).drop("_s1", "_ds", "_hl", "_run", "_held")
