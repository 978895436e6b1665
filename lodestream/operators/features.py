"""Indicator and microstructure columns over bars: ROWS windows that share one sort by (symbol, ts)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from lodestream.operators.scan import ema_spec, wilders
from lodestream.operators.windows import rolling_rank


def series(by: str = "symbol", order: Sequence[str] = ("ts",)) -> WindowSpec:
    return Window.partitionBy(by).orderBy(*order)


def last_n(n: int, by: str = "symbol") -> WindowSpec:
    return series(by).rowsBetween(-(n - 1), 0)


def full(value: Column, n: int, by: str = "symbol") -> Column:
    """value only where the window holds n rows."""
    return F.when(F.count(F.lit(1)).over(last_n(n, by)) >= n, value)


def sma(c: str | Column, n: int) -> Column:
    return F.avg(c).over(last_n(n))


def ret(c: str | Column, n: int = 1) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return x / F.lag(x, n).over(series()) - 1


def log_ret(c: str) -> Column:
    return F.ln(F.col(c) / F.lag(c).over(series()))


def zscore(c: str | Column, n: int) -> Column:
    """Rolling z with population deviation; 0 where that is 0."""
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce((x - F.avg(x).over(last_n(n))) / F.nullif(F.stddev_pop(x).over(last_n(n)), F.lit(0.0)), F.lit(0.0))


def bollinger(c: str, n: int, k: float) -> tuple[Column, Column, Column]:
    mid, dev = sma(c, n), F.stddev_pop(c).over(last_n(n))
    return mid - k * dev, mid, mid + k * dev


def vwap(n: int) -> Column:
    return F.sum(F.col("close") * F.col("volume")).over(last_n(n)) / F.nullif(F.sum("volume").over(last_n(n)), F.lit(0.0))


def realised_vol(n: int, bars_a_year: float, r: str = "lr") -> Column:
    """Needs the column of log returns: a window does not nest in a window."""
    return F.stddev_samp(r).over(last_n(n)) * math.sqrt(bars_a_year)


def true_range() -> Column:
    c = F.lag("close").over(series())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c), F.abs(F.col("low") - c))


def rsi(bars: DataFrame, n: int = 14, name: str = "rsi") -> DataFrame:
    """RSI from Wilder means of gains and losses; 50 where there is no movement."""
    x = bars.withColumn("_d", F.col("close") - F.lag("close").over(series()))
    # NULL on the first row: greatest would make it 0
    side = lambda c: F.when(F.col("_d").isNotNull(), F.greatest(c, F.lit(0.0)))
    x = wilders(x, {"_g": side(F.col("_d")), "_l": side(-F.col("_d"))}, n)
    value = 100 - 100 / (1 + F.col("_g") / F.nullif("_l", F.lit(0.0)))
    return x.withColumn(name, F.when((F.col("_l") == 0) & (F.col("_g") > 0), 100.0).otherwise(F.coalesce(value, F.lit(50.0)))).drop("_d", "_g", "_l")


def rsi_atr(bars: DataFrame, n: int = 14, emas: Sequence[int] = ()) -> DataFrame:
    """Adds rsi and atr of one length, and ema_<span> of the closes, from one scan."""
    d = F.col("close") - F.lag("close").over(series())
    x = bars.withColumns({"_d": d, "_tr": true_range()})
    side = lambda c: F.when(F.col("_d").isNotNull(), F.greatest(c, F.lit(0.0)))
    x = wilders(x, {"_g": side(F.col("_d")), "_l": side(-F.col("_d")), "atr": F.col("_tr")}, n, more={f"ema_{k}": ema_spec("close", k) for k in emas})
    value = 100 - 100 / (1 + F.col("_g") / F.nullif("_l", F.lit(0.0)))
    return x.withColumn("rsi", F.when((F.col("_l") == 0) & (F.col("_g") > 0), 100.0).otherwise(F.coalesce(value, F.lit(50.0)))).drop("_d", "_g", "_l", "_tr")


def atr(bars: DataFrame, n: int = 14, name: str = "atr") -> DataFrame:
    return wilders(bars.withColumn("_tr", true_range()), {name: F.col("_tr")}, n).drop("_tr")


def feature_table(bars: DataFrame, bars_a_year: float = 24 * 365) -> DataFrame:
    """rsi, ema_9/21/50, atr, Bollinger bands and width, vwap, vol, ret_1, ret_5, vol_ratio of every bar."""
    x = rsi_atr(bars, emas=(9, 21, 50))
    lo, mid, hi = bollinger("close", 20, 2.0)
    x = x.withColumn("lr", log_ret("close")).withColumns({"bb_low": lo, "bb_mid": mid, "bb_high": hi, "vwap": vwap(20), "vol": realised_vol(20, bars_a_year), "ret_1": ret("close"), "ret_5": ret("close", 5)})
    return x.withColumn("bb_width", (F.col("bb_high") - F.col("bb_low")) / F.nullif("bb_mid", F.lit(0.0))).withColumn("vol_ratio", F.col("volume") / F.nullif(sma("volume", 20), F.lit(0.0))).drop("lr")


def rolling_cov(a: str, b: str, n: int) -> Column:
    return F.covar_samp(a, b).over(last_n(n))


def roll_spread(n: int, d: str = "dp", d1: str = "dp1") -> Column:
    """2 * sqrt(-cov) of price changes and the changes before; 0 where the covariance is not negative."""
    return 2 * F.sqrt(F.greatest(-rolling_cov(d, d1, n), F.lit(0.0)))


def amihud(n: int, r: str = "ret_1") -> Column:
    return F.avg(F.abs(F.col(r)) / F.nullif(F.col("close") * F.col("volume"), F.lit(0.0))).over(last_n(n))


def parkinson(n: int) -> Column:
    return F.sqrt(F.avg(F.ln(F.col("high") / F.col("low")) ** 2).over(last_n(n)) / (4 * math.log(2)))


def corwin_schultz() -> Column:
    """Spread from the high and low of two neighbouring bars; negative values are set to 0."""
    w2 = last_n(2)
    beta = F.sum(F.ln(F.col("high") / F.col("low")) ** 2).over(w2)
    gamma = F.ln(F.max("high").over(w2) / F.min("low").over(w2)) ** 2
    k = 3 - 2 * math.sqrt(2)
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k)
    return F.greatest(F.lit(0.0), 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha)))


def kyle_rolling(n: int, x: str = "sv", y: str = "dp") -> tuple[Column, Column]:
    """Slope without intercept of price change on signed volume over n rows, and its t."""
    w = last_n(n)
    xx, xy, yy, m = F.sum(F.col(x) ** 2).over(w), F.sum(F.col(x) * F.col(y)).over(w), F.sum(F.col(y) ** 2).over(w), F.count(y).over(w)
    lam = xy / F.nullif(xx, F.lit(0.0))
    rss = F.greatest(yy - lam * xy, F.lit(0.0))
    return lam, lam / F.nullif(F.sqrt(rss / F.nullif(m - 1, F.lit(0)) / F.nullif(xx, F.lit(0.0))), F.lit(0.0))


def volatility_regime(bars: DataFrame, n: int = 60, look: int = 500, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Adds vol_rank and vol_regime (low, normal, high): where the deviation of the last n log returns ranks among the last look ones.

    Half of each window has to be there; without a rank the regime is normal, without a deviation the rank is 0.
    """
    x = bars.withColumn("lr", log_ret("close"))
    x = x.withColumn("rv", F.when(F.count("lr").over(last_n(n)) >= n // 2, F.stddev_samp("lr").over(last_n(n))))
    x = rolling_rank(x, "rv", look, "vol_rank", look // 2)
    return x.withColumn("vol_regime", F.when(F.col("vol_rank") > high, "high").when(F.col("vol_rank") < low, "low").otherwise("normal")).drop("lr")


def average_rank(c: str, part: Sequence[str]) -> Column:
    """Rank from 1 with ties at their mean."""
    w = Window.partitionBy(*part)
    return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*part, c)) - 1) / 2


def cross_section(panel: DataFrame, c: str, part: str = "ts") -> DataFrame:
    """Adds pct_rank and cs_z of a column among all symbols of a time."""
    w = Window.partitionBy(part)
    return panel.withColumn("pct_rank", average_rank(c, [part]) / F.count(c).over(w)).withColumn("cs_z", (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_samp(c).over(w), F.lit(0.0)))


def fair_value_gaps(bars: DataFrame) -> DataFrame:
    """Adds bull_gap and bear_gap: sizes of the gap between the bar and the one two before."""
    h2, l2 = F.lag("high", 2).over(series()), F.lag("low", 2).over(series())
    return bars.withColumn("bull_gap", F.when(F.col("low") > h2, F.col("low") - h2)).withColumn("bear_gap", F.when(F.col("high") < l2, l2 - F.col("high")))


def ffd_weights(d: float, n: int) -> list[float]:
    """First n weights of fractional differencing of order d."""
    out = [1.0]
    for k in range(1, n):
        out.append(-out[-1] * (d - k + 1) / k)
    return out


def frac_diff(c: str, d: float, n: int) -> Column:
    """Fractional difference with n weights; NULL until n rows are there."""
    out = F.lit(0.0)
    for k, w in enumerate(ffd_weights(d, n)):
        out = out + w * F.lag(c, k).over(series())
    return out


def drawdown(equity: str, by: str = "symbol") -> Column:
    return F.col(equity) / F.max(equity).over(series(by).rowsBetween(Window.unboundedPreceding, 0)) - 1


def cumulative_equity(r: str, by: str = "symbol") -> Column:
    """Running product of 1 + r; 0 from the first r <= -1 on."""
    w = series(by).rowsBetween(Window.unboundedPreceding, 0)
    ruined = F.max(F.when(F.col(r) <= -1, 1).otherwise(0)).over(w)
    return F.when(ruined == 1, 0.0).otherwise(F.exp(F.sum(F.log1p(F.when(F.col(r) > -1, F.col(r)).otherwise(0.0))).over(w)))


def runs(rows: DataFrame, value: str, by: str = "symbol", name: str = "run") -> DataFrame:
    """Adds a number for each stretch of rows with one value."""
    w = series(by)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_ch", change).withColumn(name, F.sum("_ch").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_ch")


def gaps(rows: DataFrame, step_seconds: int, by: str = "symbol", factor: float = 1.5) -> DataFrame:
    """Missing windows of a series: (by, start, end, missing) where rows are further apart than factor steps."""
    x = rows.select(by, "ts", F.lead("ts").over(series(by)).alias("nxt"))
    d = F.unix_seconds("nxt") - F.unix_seconds("ts")
    return x.where(d > factor * step_seconds).select(by, F.timestamp_seconds(F.unix_seconds("ts") + step_seconds).alias("start"), F.col("nxt").alias("end"), (F.floor(d / step_seconds) - 1).alias("missing"))


def merge_intervals(spans: DataFrame, by: str, start: str = "start", end: str = "end") -> DataFrame:
    """Union of overlapping or touching spans."""
    w = Window.partitionBy(by).orderBy(start, end)
    x = spans.withColumn("_m", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("_g", F.sum(F.when(F.col("_m").isNull() | (F.col(start) > F.col("_m")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(by, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def hold(signal: DataFrame, raw: str, exit_: Column, by: str = "symbol", name: str = "sig", exit_first: bool = False) -> DataFrame:
    """Entry and exit with a held position: entries set it, an exit sets 0, else it stays.

    An exit is only looked at where the held side before it is open, as the exit column may need that side (column held): the
    last entry's, whether or not it has been left since. exit_first lets an exit overrule an entry of the same row.
    """
    w = series(by)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = signal.withColumn("_carried", F.last(F.col(raw), ignorenulls=True).over(upto)).withColumn("held", F.coalesce(F.lag("_carried").over(w), F.lit(0.0)))
    out = F.coalesce(exit_, F.lit(False)) & (F.col("held") != 0)
    x = x.withColumn("_set", F.when(out, 0.0).when(F.col(raw).isNotNull(), F.col(raw)) if exit_first else F.when(F.col(raw).isNotNull(), F.col(raw)).when(out, 0.0))
    return x.withColumn(name, F.coalesce(F.last("_set", ignorenulls=True).over(upto), F.lit(0.0))).drop("_carried", "_set", "held")


def vpin(volume_bars: DataFrame, size: float, n: int = 50) -> DataFrame:
    """Adds vpin: size of buys less sells over the last n volume bars, a share of n * size; needs half of them, 10 at least."""
    w = Window.partitionBy("symbol").orderBy("bar").rowsBetween(-(n - 1), 0)
    flow = F.sum(F.abs(F.col("buy") - F.col("sell"))).over(w) / (n * size)
    return volume_bars.withColumn("vpin", F.when(F.count(F.lit(1)).over(w) >= max(10, n // 2), flow))


def kyle_whole(rows: DataFrame, x: str = "sv", y: str = "dp", by: str = "symbol") -> DataFrame:
    """n, lambda (slope of the price change on signed volume, no intercept) and its t, of each whole series."""
    g = rows.where(F.col(y).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(x) * F.col(y)).alias("_xy"), F.sum(F.col(x) ** 2).alias("_xx"), F.sum(F.col(y) ** 2).alias("_yy"))
    lam = F.col("_xy") / F.nullif("_xx", F.lit(0.0))
    rss = F.greatest(F.col("_yy") - lam * F.col("_xy"), F.lit(0.0))
    return g.select(by, "n", lam.alias("lambda"), (lam / F.nullif(F.sqrt(rss / F.nullif(F.col("n") - 1, F.lit(0)) / F.nullif("_xx", F.lit(0.0))), F.lit(0.0))).alias("t"))


def flow_autocorrelation(flow: DataFrame, n: int = 120, lag: int = 1, x: str = "delta") -> DataFrame:
    """Adds autocorr: correlation of signed flow with itself lag rows before, over n rows, half of them at least."""
    y = flow.withColumn("_y", F.lag(x, lag).over(series()))
    return y.withColumn("autocorr", F.when(F.count("_y").over(last_n(n)) >= max(10, n // 2), F.corr(x, "_y").over(last_n(n)))).drop("_y")


def coverage(rows: DataFrame, start: str, end: str, least: float, by: str = "symbol") -> DataFrame:
    """share of the period between a series' first and last row, and whether that is enough."""
    a, z = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    span = F.unix_micros(F.least(F.max("ts"), z)) - F.unix_micros(F.greatest(F.min("ts"), a))
    x = rows.groupBy(by).agg((F.greatest(F.lit(0), span) / (F.unix_micros(z) - F.unix_micros(a))).alias("share"))
    return x.withColumn("covered", F.col("share") >= least)


def missing_windows(rows: DataFrame, start: str, end: str, step_seconds: int, by: str = "symbol") -> DataFrame:
    """(by, start, end) of what a series lacks in the period [start, end), its edges included."""
    a, z = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    edges = rows.select(by).distinct().select(by, F.explode(F.array(F.timestamp_seconds(F.unix_seconds(a) - step_seconds), z)).alias("ts"))
    return gaps(rows.where((F.col("ts") >= a) & (F.col("ts") < z)).select(by, "ts").unionByName(edges), step_seconds, by, 1.0).drop("missing")


def snapshot_quality(book: DataFrame, by: str = "symbol") -> DataFrame:
    """rows, span in seconds, rows an hour, largest gap and number of repeated times of each series."""
    from lodestream.operators.joins import last_before

    x = last_before(book, F.unix_micros("ts"), "_p", ["ts", "seq"], by).withColumn("_g", (F.unix_micros("ts") - F.col("_p")) / 1e6)
    span = (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6
    return x.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), span.alias("span"), (F.count(F.lit(1)) / F.nullif(span, F.lit(0.0)) * 3600).alias("per_hour"), F.max("_g").alias("max_gap"), F.count_if(F.col("_g") == 0).alias("duplicates"))


def depth_imbalance(bids: str, asks: str, levels: int = 5, scheme: str = "linear") -> Column:
    """Weighted bid less ask quantity over their sum, from arrays of level quantities; deeper levels weigh less but for uniform."""
    weight = {"uniform": lambda i: 1.0, "linear": lambda i: float(levels - i), "sqrt": lambda i: 1 / math.sqrt(i + 1), "harmonic": lambda i: 1 / (i + 1)}[scheme]
    side = lambda c: sum((F.coalesce(F.get(F.col(c), F.lit(i)), F.lit(0.0)) * weight(i) for i in range(levels)), F.lit(0.0))
    b, a = side(bids), side(asks)
    return F.coalesce((b - a) / F.nullif(b + a, F.lit(0.0)), F.lit(0.0))


def rolling_beta(rows: DataFrame, n: int, y: str = "y", x: str = "x") -> DataFrame:
    """Adds beta: slope of y on x over n rows; where x does not vary, the last one known."""
    w = last_n(n)
    slope = F.covar_pop(y, x).over(w) / F.nullif(F.var_pop(x).over(w), F.lit(0.0))
    out = rows.withColumn("_b", full(slope, n))
    return out.withColumn("beta", F.last("_b", ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def side_intensity(ticks: DataFrame, beta: float) -> DataFrame:
    """Adds imbalance of buying and selling intensity, each a sum of exp(-beta * age in seconds) over the ticks so far."""
    from lodestream.operators.evaluation import hawkes

    both = hawkes(ticks.withColumn("_mark", F.when(F.col("side") == "buy", 1.0).otherwise(0.0)), beta, mark="_mark", name="_buy", order=("ts", "trade_id"))
    both = hawkes(both, beta, name="_all", order=("ts", "trade_id"))
    return both.withColumn("imbalance", (2 * F.col("_buy") - F.col("_all")) / F.nullif("_all", F.lit(0.0))).drop("_mark", "_buy", "_all")


def markout(book: DataFrame) -> DataFrame:
    """Adds markout_bps: move of the mid price to the next quote on the side of the larger quantity."""
    mid = (F.col("bid") + F.col("ask")) / 2
    nxt = F.lead(mid).over(Window.partitionBy("symbol").orderBy("ts", "seq"))
    return book.withColumn("markout_bps", F.when(F.col("bid_qty") > F.col("ask_qty"), 1).otherwise(-1) * (nxt / mid - 1) * 1e4)


def var_halt(rows: DataFrame, ret: str, n: int, q: float, limit: float) -> DataFrame:
    """Adds var_<q in percent> of the last n returns (half of them at least) and halt: whether it is worse than the limit."""
    name = f"var_{round(q * 100)}"
    x = rows.withColumn(name, F.when(F.count(ret).over(last_n(n)) >= n // 2, F.percentile(ret, F.lit(q)).over(last_n(n))))
    return x.withColumn("halt", F.coalesce(F.col(name) < -limit, F.lit(False)))
