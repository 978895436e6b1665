"""Regressions from cross-moments, and tables around models: datasets, weights, folds, scores."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.functions.numbers import share_of
from lodestream.operators import features as ft
from lodestream.operators.scan import scans


def _det(m: Sequence[Sequence[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    out = F.lit(0.0)
    for j, x in enumerate(m[0]):
        minor = [[*row[:j], *row[j + 1 :]] for row in m[1:]]
        out = out + (-1) ** j * x * _det(minor)
    return out


def solve(a: Sequence[Sequence[Column]], b: Sequence[Column]) -> list[Column]:
    """Solution of a small linear system by determinants; NULL where it has none. For up to four unknowns."""
    d = F.nullif(_det(a), F.lit(0.0))
    return [_det([[*row[:j], y, *row[j + 1 :]] for row, y in zip(a, b, strict=True)]) / d for j in range(len(b))]


def har_forecast(rows: DataFrame, rv: str, lags: tuple[int, int, int] = (1, 5, 22), least: int = 100, by: str = "symbol") -> DataFrame:
    """Adds forecast of the next volatility: least squares on means over 1, 5 and 22 rows, fitted on all rows so far.

    The fit needs only running means and covariances of the four series, so nothing is refitted.
    """
    w = ft.series(by)
    mean = lambda n: F.avg(rv).over(w.rowsBetween(-(n - 1), 0))
    x = rows.withColumns({f"_x{k}": mean(n) for k, n in enumerate(lags)})
    x = x.withColumns({f"_p{k}": F.lag(f"_x{k}").over(w) for k in range(3)}).withColumn("_y", F.when(F.col("_p0").isNotNull(), F.col(rv)))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    cov = {f"_c{i}{j}": F.covar_pop(f"_p{i}", f"_p{j}").over(run) for i in range(3) for j in range(i, 3)}
    cov |= {f"_d{i}": F.covar_pop(f"_p{i}", "_y").over(run) for i in range(3)} | {f"_m{i}": F.avg(f"_p{i}").over(run) for i in range(3)}
    x = x.withColumns(cov | {"_my": F.avg("_y").over(run), "_n": F.count("_y").over(run)})
    c = lambda i, j: F.col(f"_c{min(i, j)}{max(i, j)}")
    beta = solve([[c(i, j) for j in range(3)] for i in range(3)], [F.col(f"_d{i}") for i in range(3)])
    y = F.col("_my")
    for i, b in enumerate(beta):
        y = y + b * (F.col(f"_x{i}") - F.col(f"_m{i}"))
    return rows_of(x.withColumn("forecast", F.when(F.col("_n") >= least, F.greatest(y, F.lit(1e-12)))))


def rows_of(x: DataFrame) -> DataFrame:
    """Without helper columns."""
    return x.drop(*[c for c in x.columns if c.startswith("_")])


def arch_lm(rows: DataFrame, ret: str, by: str = "symbol") -> DataFrame:
    """n and statistic of the test for clustered volatility with two lags: n times R^2 of squares on the two squares before."""
    w = ft.series(by)
    x = rows.where(F.col(ret).isNotNull()).withColumn("_y", F.col(ret) ** 2).withColumns({"_a": F.lag("_y", 1).over(w), "_b": F.lag("_y", 2).over(w)}).where("_b is not null")
    cov = lambda a, b: F.covar_pop(a, b)
    g = x.groupBy(by).agg(F.count(F.lit(1)).alias("n"), cov("_a", "_a").alias("aa"), cov("_a", "_b").alias("ab"), cov("_b", "_b").alias("bb"), cov("_a", "_y").alias("ay"), cov("_b", "_y").alias("by_"), F.var_pop("_y").alias("yy"))
    b1, b2 = solve([[F.col("aa"), F.col("ab")], [F.col("ab"), F.col("bb")]], [F.col("ay"), F.col("by_")])
    return g.select(by, "n", (F.col("n") * (b1 * F.col("ay") + b2 * F.col("by_")) / F.nullif("yy", F.lit(0.0))).alias("lm"))


def ewm_volatility(rows: DataFrame, ret: str, span: int = 100, by: str = "symbol") -> DataFrame:
    """Adds target: exponentially weighted sample deviation of returns so far, from span / 2 returns on."""
    keep = 1 - 2 / (span + 1)
    r = F.coalesce(F.col(ret), F.lit(0.0))
    has = F.when(F.col(ret).isNotNull(), 1.0).otherwise(0.0)
    x = scans(rows, {"_s1": (keep, r, None), "_s2": (keep, r * r, None), "_w1": (keep, has, None), "_w2": (keep**2, has, None)}, ("ts",), by)
    n = F.count(ret).over(ft.series(by).rowsBetween(Window.unboundedPreceding, 0))
    mean = F.col("_s1") / F.col("_w1")
    var = (F.col("_s2") / F.col("_w1") - mean * mean) * F.col("_w1") ** 2 / F.nullif(F.col("_w1") ** 2 - F.col("_w2"), F.lit(0.0))
    return rows_of(x.withColumn("target", F.when(n >= span // 2, F.sqrt(F.greatest(var, F.lit(0.0))))))


def labelled_dataset(bars: DataFrame, horizon: int, noise: float) -> DataFrame:
    """Feature rows with their label: sign of the return over the horizon, 0 within the noise; rows without all features or a label are left out."""
    w = ft.series()
    x = ft.feature_table(bars).withColumn("fwd", F.lead("close", horizon).over(w) / F.col("close") - 1)
    x = x.withColumn("label", F.when(F.abs("fwd") <= noise, 0).otherwise(F.signum("fwd").cast("int")))
    return x.dropna(subset=["fwd", "rsi", "atr", "ema_9", "ema_50", "bb_width", "vol", "ret_1", "ret_5", "vol_ratio"])


def time_decay(rows: DataFrame, weight: str, decay: float, by: str = "symbol") -> DataFrame:
    """Adds decayed: weights that fall linearly from 1 for the newest to decay for the oldest share of all weight, summing to 1."""
    run = F.sum(weight).over(ft.series(by).rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy(by)
    x = rows.withColumn("_c", run).withColumn("_t", F.sum(weight).over(whole))
    x = x.withColumn("_w", F.greatest(F.lit(0.0), 1 - (1 - decay) / F.col("_t") * (F.col("_t") - F.col("_c"))))
    return rows_of(x.withColumn("decayed", F.col("_w") / F.sum("_w").over(whole)))


def purged_by_end(events: DataFrame, k: int, embargo: float, by: str = "symbol") -> DataFrame:
    """Rows for each fold with a role: test; purged if the label ends inside the test part or the row follows it within the embargo; else train."""
    w = Window.partitionBy(by)
    x = events.withColumn("_i", F.row_number().over(w.orderBy("ts")) - 1).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    size = F.floor(F.col("_n") / k)
    a, z = F.col("fold") * size, F.col("fold") * size + size
    x = x.withColumns({"_a": a, "_z": z, "_e": z + share_of(F.col("_n"), embargo)})
    start = F.max(F.when(F.col("_i") == F.col("_a"), F.col("ts"))).over(Window.partitionBy(by, "fold"))
    x = x.withColumn("_start", start)
    inside = (F.col("_i") >= F.col("_a")) & (F.col("_i") < F.col("_z"))
    late = (F.col("_i") < F.col("_a")) & (F.coalesce("t1", "ts") > F.col("_start"))
    after = (F.col("_i") >= F.col("_z")) & (F.col("_i") < F.col("_e"))
    return rows_of(x.withColumn("role", F.when(inside, "test").when(late | after, "purged").otherwise("train")))


def prediction_scores(rows: DataFrame, p: str, up: str, cost: float, by: str = "symbol") -> DataFrame:
    """n, log-loss of a probability of `up` (0 or 1), and the Sharpe (times root n) of trading its side from the next bar, net of cost."""
    w = ft.series(by)
    pos = F.coalesce(F.lag(F.signum(F.col(p) - 0.5)).over(w), F.lit(0.0))
    x = rows.withColumn("_pos", pos)
    turnover = F.abs(F.col("_pos") - F.coalesce(F.lag("_pos").over(w), F.lit(0.0)))
    x = x.withColumn("_r", F.col("_pos") * F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)) - turnover * cost)
    hit = F.when(F.col(up) == 1, F.col(p)).otherwise(1 - F.col(p))
    loss = -F.avg(F.ln(F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), hit))))
    return x.groupBy(by).agg(F.count(F.lit(1)).alias("n"), loss.alias("logloss"), (F.avg("_r") / F.nullif(F.stddev_pop("_r"), F.lit(0.0)) * F.sqrt(F.count(F.lit(1)))).alias("sharpe"))


def stacked(rows: DataFrame, features: tuple[str, str], label: str, folds: int, embargo: int, by: str = "symbol", lam: float = 1.0) -> DataFrame:
    """Adds fold and signal out of sample: ridge on the rows before each fold less the embargo; the first fold has signal 0.

    Every row goes to all later folds' training sums; a fold's solution is one row, joined back.
    """
    w = Window.partitionBy(by)
    x = rows.withColumn("_i", F.row_number().over(w.orderBy("ts")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    x = x.withColumn("_size", F.floor(F.col("_n") / folds)).withColumn("fold", F.least(F.floor(F.col("_i") / F.col("_size")), F.lit(folds - 1)).cast("int"))
    a, b = features
    to = F.sequence(F.col("fold"), F.lit(folds - 1))
    train = x.withColumn("_f", F.explode(to)).where((F.col("_f") > 0) & (F.col("_i") < F.col("_f") * F.col("_size") - embargo))
    s = lambda u, v: F.sum(F.col(u) * F.col(v))
    g = train.groupBy(by, F.col("_f").alias("fold")).agg((s(a, a) + lam).alias("_aa"), s(a, b).alias("_ab"), (s(b, b) + lam).alias("_bb"), s(a, label).alias("_ay"), s(b, label).alias("_by"), F.stddev_pop(label).alias("_sd"))
    b1, b2 = solve([[F.col("_aa"), F.col("_ab")], [F.col("_ab"), F.col("_bb")]], [F.col("_ay"), F.col("_by")])
    g = g.select(by, "fold", b1.alias("_b1"), b2.alias("_b2"), F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0).alias("_sd"))
    pred = F.col("_b1") * F.col(a) + F.col("_b2") * F.col(b)
    out = x.join(g, [by, "fold"], "left").withColumn("signal", F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), pred / F.col("_sd"))), F.lit(0.0)))
    return rows_of(out)


def dissimilarity(rows: DataFrame, train: DataFrame, columns: Sequence[str], limit: float, by: str = "symbol") -> DataFrame:
    """Adds di (root mean square of the features' standardised distances from the training rows) and familiar: di within the limit."""
    stats = train.groupBy(by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    z = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-12, 1.0).otherwise(F.col(f"_s_{c}"))
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(z(c) ** 2, F.lit(0.0))
    x = rows.join(stats, by).withColumn("di", F.sqrt(total / len(columns)))
    return rows_of(x.withColumn("familiar", F.col("di") <= limit))


def least_difference(rows: DataFrame, value: str, ds: Sequence[float], width: int, critical: float, by: str = "symbol") -> DataFrame:
    """The smallest order of fractional differencing whose series passes the unit root test: all orders of the grid in one job."""
    from lodestream.operators.stats import adf

    each = [rows.select(F.concat_ws("@", by, F.lit(str(d))).alias("run"), "ts", ft.frac_diff(value, d, width).alias("x")) for d in ds]
    out = each[0]
    for df in each[1:]:
        out = out.unionByName(df)
    tests = adf(out.where("x is not null"), "x", "run").select(F.substring_index("run", "@", 1).alias(by), F.substring_index("run", "@", -1).cast("double").alias("d"), "t")
    return tests.groupBy(by).agg(F.min(F.when(F.col("t") < critical, F.col("d"))).alias("least_d"), F.min("t").alias("best_t"))


def survival_median(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First time at which survival is a half or less."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median"))


def kendall(rows: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """n and Kendall's tau (a) within each group; groups have to be small (such as a day of bars), as all their pairs are looked at."""
    x = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).alias("_a"), F.col(b).alias("_b"), F.row_number().over(Window.partitionBy(*by).orderBy("ts")).alias("_k"))
    y = x.select(*by, F.col("_a").alias("_a2"), F.col("_b").alias("_b2"), F.col("_k").alias("_k2"))
    s = F.signum(F.col("_a") - F.col("_a2")) * F.signum(F.col("_b") - F.col("_b2"))
    return x.join(y, list(by)).where("_k < _k2").groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.avg(s).alias("tau"))


def lift_report(rows: DataFrame, features: Sequence[str], ret: str, q: int = 10) -> DataFrame:
    """Mean result of each quantile bin of each feature against all: one long table, one edge row a feature."""
    from lodestream.operators.quantiles import quantile_bins

    long = rows.select(ret, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])).alias("_x")).select(ret, "_x.*").where(F.col("value").isNotNull() & F.col(ret).isNotNull())
    g = quantile_bins(long, "value", q, ["feature"]).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean"), F.sum(ret).alias("_s"))
    w = Window.partitionBy("feature")
    return rows_of(g.withColumn("lift", F.col("mean") - F.sum("_s").over(w) / F.sum("n").over(w)))


def lift_summary(report: DataFrame) -> DataFrame:
    """Per feature: largest lift in size, and slope of the mean over bins."""
    return report.groupBy("feature").agg(F.max(F.abs("lift")).alias("max_lift"), F.regr_slope("mean", "bin").alias("slope"))


def quintiles(rows: DataFrame, z: str, fwd: str, q: int = 5) -> DataFrame:
    """One row: means of the forward return by quantile bin of z, their rank correlation with the bin, and whether they run one way."""
    from lodestream.operators.quantiles import quantile_bins

    x = rows.where(F.col(z).isNotNull() & F.col(fwd).isNotNull()).select(z, fwd)
    g = quantile_bins(x, z, q).groupBy("bin").agg(F.avg(fwd).alias("mean"))
    w = Window.orderBy("bin")  # a row a bin
    g = g.withColumns({"_d": F.col("mean") - F.lag("mean").over(w), "_r": F.rank().over(Window.orderBy("mean"))})
    one_way = (F.min("_d") >= -1e-12) | (F.max("_d") <= 1e-12)
    return g.agg(F.count(F.lit(1)).alias("bins"), F.min("mean").alias("lowest"), F.max("mean").alias("highest"), F.corr("bin", "_r").alias("spearman"), one_way.alias("monotonic"))


def impact_constant(bars: DataFrame, by: str = "symbol") -> DataFrame:
    """Median of |return| over deviation times the root of the bar's share of mean volume."""
    w = lambda n: ft.last_n(n, by)
    span = F.ln(F.col("high") / F.col("low"))
    x = bars.withColumn("_hl", span)
    sigma = F.when(F.count("_hl").over(w(20)) >= 10, F.sqrt(F.avg("_hl").over(w(20)) / (4 * math.log(2)))).otherwise(0.0)
    adv = F.when(F.count("volume").over(w(100)) >= 50, F.avg("volume").over(w(100)))
    x = x.withColumns({"_sg": sigma, "_sh": F.least(F.lit(1.0), F.coalesce(F.col("volume") / F.nullif(adv, F.lit(0.0)), F.lit(0.0))), "_r": F.abs(ft.ret("close"))})
    k = F.col("_r") / F.nullif(F.col("_sg") * F.sqrt("_sh"), F.lit(0.0))
    return x.withColumn("_k", k).where("_k is not null").groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.percentile("_k", 0.5).alias("k"))


def alpha_half_life(reports: DataFrame, least: float = 0.005) -> DataFrame:
    """Bars until the size of the rank correlation has halved, from a line through its logarithm over horizons; NULL with fewer than three."""
    x = reports.where(F.abs("rank_ic") > least)
    g = x.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(F.ln(F.abs("rank_ic")), F.col("horizon").cast("double")).alias("slope"))
    return g.withColumn("half_life", F.when((F.col("n") >= 3) & (-F.col("slope") > 1e-4), math.log(2) / -F.col("slope")))


def correlation_distance(panel: DataFrame, value: str, by: str = "symbol") -> DataFrame:
    """n, correlation and distance sqrt((1 - rho) / 2) of each pair of series on common times."""
    x = panel.where(F.col(value).isNotNull()).select("ts", F.col(by).alias("a"), F.col(value).alias("_x"))
    y = x.select("ts", F.col("a").alias("b"), F.col("_x").alias("_y"))
    g = x.join(y, "ts").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("rho"))
    return g.withColumn("distance", F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("rho")) / 2)))


def grid(rows: DataFrame, params: Mapping[str, Sequence[float]]) -> DataFrame:
    """Rows repeated for each combination of parameters, as columns."""
    x = rows
    for name, values in params.items():
        x = x.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return x


def sensitivity(grid_metrics: DataFrame, param: str, metric: str = "metric", by: Sequence[str] = ()) -> DataFrame:
    """The best value and the smoothness of a metric along a parameter: 1 less mean step over deviation, 0 at least."""
    w = Window.partitionBy(*by).orderBy(param)
    x = grid_metrics.withColumn("_d", F.abs(F.col(metric) - F.lag(metric).over(w)))
    sd = F.stddev_pop(metric)
    smooth = F.when((F.count(metric) > 2) & (sd > 0), 1 - F.least(F.lit(1.0), F.avg("_d") / F.greatest(sd, F.lit(1e-9)))).otherwise(1.0)
    return x.groupBy(*by).agg(F.max_by(param, metric).alias("best"), F.max(metric).alias("best_metric"), smooth.alias("smoothness"))
