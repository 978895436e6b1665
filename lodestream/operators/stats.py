"""Statistical aggregates: bins, lift, factor tearsheet, survival, tails, unit roots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.operators.quantiles import quantile_bins


def lift(rows: DataFrame, feature: str, ret: str, q: int = 10, by: list[str] | None = None) -> DataFrame:
    """Per quantile bin: n, mean result, lift over the overall mean, share of the total up to the bin."""
    by = by or []
    x = quantile_bins(rows.where(F.col(feature).isNotNull()), feature, q, by).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean"), F.sum(ret).alias("_s"))
    all_ = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = all_.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    overall = F.sum("_s").over(all_) / F.sum("n").over(all_)
    return x.withColumn("lift", F.col("mean") - overall).withColumn("cum_share", F.sum("_s").over(upto) / F.nullif(F.sum("_s").over(all_), F.lit(0.0))).drop("_s")


def value_study(rows: DataFrame, signal: str, ret: str, least: int = 20) -> DataFrame:
    """Mean, variance and number of results of each signal value with enough rows."""
    return rows.groupBy(signal).agg(F.count(ret).alias("n"), F.avg(ret).alias("mean"), F.var_samp(ret).alias("var")).where(F.col("n") >= least)


def information_coefficients(panel: DataFrame, factor: str, horizons: Sequence[int], price: str = "close", by: str = "symbol") -> DataFrame:
    """Pearson and rank correlation of a factor with forward returns, and its t, for each horizon."""
    w = Window.partitionBy(by).orderBy("ts")
    wide = panel.select(F.col(factor).alias("f"), *[(F.lead(price, h).over(w) / F.col(price) - 1).alias(f"_r{h}") for h in horizons])
    long = wide.select("f", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"_r{h}").alias("r")) for h in horizons])).alias("s"))
    x = long.select("f", "s.h", "s.r").where("f is not null and r is not null")
    rank = lambda c: F.rank().over(Window.partitionBy("h").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("h", c)) - 1) / 2
    x = x.withColumn("rf", rank("f")).withColumn("rr", rank("r")).groupBy(F.col("h").alias("horizon")).agg(F.count(F.lit(1)).alias("n"), F.corr("f", "r").alias("ic"), F.corr("rf", "rr").alias("rank_ic"))
    return x.withColumn("t", F.col("ic") * F.sqrt((F.col("n") - 2) / (1 - F.col("ic") ** 2)))


def kaplan_meier(rows: DataFrame, duration: str, event: Column, by: Sequence[str] = ()) -> DataFrame:
    """t, at_risk, events, survival: product over times of 1 - events / at risk; 0 once all at risk have the event."""
    x = rows.groupBy(*by, F.col(duration).alias("t")).agg(F.count(F.lit(1)).alias("_n"), F.sum(event.cast("int")).alias("events"))
    base = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    x = x.withColumn("at_risk", F.sum("_n").over(base.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)))
    upto = base.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.max(F.when(F.col("events") == F.col("at_risk"), 1).otherwise(0)).over(upto)
    s = F.exp(F.sum(F.when(F.col("events") < F.col("at_risk"), F.ln(1 - F.col("events") / F.col("at_risk"))).otherwise(0.0)).over(upto))
    return x.withColumn("survival", F.when(gone == 1, 0.0).otherwise(s)).drop("_n")


def tail_dependence(panel: DataFrame, value: str, q: float = 0.05, by: str = "symbol") -> DataFrame:
    """Share of q with which two series are both in their lower tail at one time; pairs a < b on common times."""
    part = Window.partitionBy(by)
    rank = F.rank().over(part.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(by, value)) - 1) / 2
    u = panel.where(F.col(value).isNotNull()).withColumn("_u", rank / (F.count(F.lit(1)).over(part) + 1)).select("ts", by, "_u")
    other = u.select("ts", F.col(by).alias("b"), F.col("_u").alias("_v"))
    x = u.join(other, "ts").where(F.col(by) < F.col("b")).groupBy(F.col(by).alias("a"), "b").agg(F.count(F.lit(1)).alias("n"), F.sum(((F.col("_u") <= q) & (F.col("_v") <= q)).cast("int")).alias("both"))
    return x.withColumn("lambda", F.col("both") / (q * F.col("n")))


def var_cvar(rows: DataFrame, ret: str, alpha: float, by: Sequence[str]) -> DataFrame:
    """Historical value at risk (interpolated quantile) and the mean of what lies at or below it."""
    v = rows.groupBy(*by).agg(F.percentile(ret, F.lit(alpha)).alias("var"))
    return rows.join(v, list(by)).where(F.col(ret) <= F.col("var")).groupBy(*by).agg(F.first("var").alias("var"), F.avg(ret).alias("cvar"))


def newey_west_t(rows: DataFrame, ret: str, lags: int, by: str = "symbol") -> DataFrame:
    """t of the mean with Bartlett weights over lags."""
    w = Window.partitionBy(by).orderBy("ts")
    x = rows.where(F.col(ret).isNotNull()).withColumn("_d", F.col(ret) - F.avg(ret).over(Window.partitionBy(by)))
    x = x.withColumns({f"_p{k}": F.col("_d") * F.lag("_d", k).over(w) for k in range(1, lags + 1)})
    n = F.count(F.lit(1))
    long_run = F.sum(F.col("_d") ** 2) / n
    for k in range(1, lags + 1):
        long_run = long_run + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)) / n
    return x.groupBy(by).agg(n.alias("n"), F.avg(ret).alias("mean"), (F.avg(ret) / F.sqrt(long_run / n)).alias("t"))


def adf(rows: DataFrame, value: str, by: str = "symbol") -> DataFrame:
    """Dickey-Fuller t of the level in a regression of changes on level, one lagged change and a constant.

    One aggregate of cross-moments a series; the 2 x 2 system of centred moments is solved in closed form.
    """
    w = Window.partitionBy(by).orderBy("ts")
    x = rows.withColumn("_l", F.lag(value).over(w)).withColumn("_d", F.col(value) - F.col("_l"))
    x = x.withColumn("_k", F.lag("_d").over(w)).where("_k is not null")
    m = x.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), *[F.covar_pop(a, b).alias(f"s{i}") for i, (a, b) in enumerate((("_l", "_l"), ("_l", "_k"), ("_k", "_k"), ("_l", "_d"), ("_k", "_d"), ("_d", "_d")))]
    )
    det = F.col("s0") * F.col("s2") - F.col("s1") ** 2
    b = (F.col("s3") * F.col("s2") - F.col("s4") * F.col("s1")) / det
    g = (F.col("s0") * F.col("s4") - F.col("s1") * F.col("s3")) / det
    rss = F.col("n") * (F.col("s5") - b * F.col("s3") - g * F.col("s4"))
    return m.select(by, "n", b.alias("level"), (b / F.sqrt(rss / (F.col("n") - 3) * F.col("s2") / det / F.col("n"))).alias("t"))


def corrected_moments(c: str) -> tuple[Column, Column]:
    """Skewness and excess kurtosis with small-sample corrections."""
    n = F.count(c)
    skew = F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return skew, kurt


def rank_correlation(rows: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Spearman correlation: average ranks inside each group, then the plain correlation."""
    x = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2
    return x.withColumn("_a", rank(a)).withColumn("_b", rank(b)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_a", "_b").alias("rho"))


def bootstrap_sharpe(rows: DataFrame, ret: str, draws: int, block: int, seed: int = 1, by: str = "symbol") -> DataFrame:
    """Interval of the Sharpe ratio from a stationary bootstrap: 5 %, 50 % and 95 % of the replicates.

    A replicate walks over the series and jumps to a random row with probability 1 / block; jumps and rows come from a hash of
    (seed, replicate, place), so reruns agree. Replicates are rows of one join on (series, row number), spread over all tasks.
    """
    x = rows.where(F.col(ret).isNotNull()).withColumn("_i", (F.row_number().over(Window.partitionBy(by).orderBy("ts")) - 1).cast("bigint")).select(by, "_i", F.col(ret).alias("_r"))
    n = x.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    walk = n.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    unit = F.pmod(F.xxhash64(F.lit(seed), "_b", "_k"), F.lit(1_000_003)) / 1_000_003
    w = Window.partitionBy(by, "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    walk = walk.withColumn("_s", F.max(F.when((F.col("_k") == 0) | (unit < 1 / block), F.col("_k"))).over(w))
    walk = walk.withColumn("_i", F.pmod(F.pmod(F.xxhash64(F.lit(seed), "_b", "_s", F.lit("row")), F.col("_n")) + F.col("_k") - F.col("_s"), F.col("_n")))
    each = walk.join(x, [by, "_i"]).groupBy(by, "_b").agg((F.avg("_r") / F.nullif(F.stddev_pop("_r"), F.lit(0.0))).alias("_sr"))
    return each.groupBy(by).agg(F.percentile("_sr", F.lit(0.05)).alias("low"), F.percentile("_sr", F.lit(0.5)).alias("mid"), F.percentile("_sr", F.lit(0.95)).alias("high"))


def quantiles_mad(rows: DataFrame, c: str, by: Sequence[str]) -> DataFrame:
    """median, p10, p90 and median absolute deviation of each group."""
    g = rows.groupBy(*by).agg(F.percentile(c, 0.5).alias("median"), F.percentile(c, 0.1).alias("p10"), F.percentile(c, 0.9).alias("p90"))
    return rows.join(g, list(by)).groupBy(*by, "median", "p10", "p90").agg(F.percentile(F.abs(F.col(c) - F.col("median")), 0.5).alias("mad"))
