"""Positions, costs, equity, metrics and overfitting tests, over long tables keyed by run."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.functions.numbers import norm_cdf, norm_ppf
from lodestream.operators.features import cumulative_equity, runs, series


def positions(signals: DataFrame, size: float = 1.0, delay: int = 1, by: str = "symbol", sig: str = "sig") -> DataFrame:
    """Adds pos: the signal of delay rows before, within [-1, 1], times size. A signal is never traded on its own bar."""
    return signals.withColumn("pos", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.lag(sig, delay).over(series(by)), F.lit(0.0)))) * size)


def returns(rows: DataFrame, fee: float, slippage: float, by: str = "symbol", pos: str = "pos") -> DataFrame:
    """Adds turnover, cost, ret and equity: pos times the bar's return, less cost of changes of pos."""
    w = series(by)
    x = rows.withColumn("turnover", F.abs(F.col(pos) - F.coalesce(F.lag(pos).over(w), F.lit(0.0)))).withColumn("cost", F.col("turnover") * (fee + slippage))
    x = x.withColumn("bar_ret", F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)))
    return x.withColumn("ret", F.col(pos) * F.col("bar_ret") - F.col("cost")).withColumn("equity", cumulative_equity("ret", by))


def run_trades(rows: DataFrame, by: str = "symbol") -> DataFrame:
    """Closed trades of a position series: a stretch of one side each, with its result, times and prices."""
    x = runs(rows.withColumn("_side", F.signum("pos")), "_side", by, "run")
    return x.where("_side <> 0").groupBy(by, "run").agg(
        F.first("_side").cast("int").alias("side"), F.min("ts").alias("entry_ts"), F.max("ts").alias("exit_ts"), F.sum("ret").alias("ret"),
        F.min_by("close", "ts").alias("entry_price"), F.max_by("close", "ts").alias("exit_price"), F.count(F.lit(1)).alias("bars"),
    )


def metrics(rows: DataFrame, bars_a_year: float, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """total, vol, sharpe, sortino, max_drawdown, exposure, turnover of each run; ratios with a zero denominator are NULL."""
    w = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("_dd", F.col("equity") / F.nullif(F.greatest(F.max("equity").over(w), F.lit(1.0)), F.lit(0.0)) - 1)
    k = math.sqrt(bars_a_year)
    down = F.sqrt(F.avg(F.least(F.col("ret"), F.lit(0.0)) ** 2))
    return x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.max_by("equity", "ts") - 1).alias("total"), (F.stddev_pop("ret") * k).alias("vol"), (F.avg("ret") / F.nullif(F.stddev_pop("ret"), F.lit(0.0)) * k).alias("sharpe"),
        (F.avg("ret") / F.nullif(down, F.lit(0.0)) * k).alias("sortino"), F.min("_dd").alias("max_drawdown"), F.avg((F.col("pos") != 0).cast("double")).alias("exposure"), F.sum("turnover").alias("turnover"),
    )


def walk_forward_windows(n: int, train: int, test: int, step: int | None = None, purge: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(window, train from, train to, test from, test to), ends not included, by row number."""
    out, k = [], 0
    at = 0
    while at + train + test <= n:
        out.append((k, at, at + train - purge, at + train, at + train + test))
        at, k = at + (step or test), k + 1
    return out


def walk_forward(rows: DataFrame, train: int, test: int, purge: int = 0, by: str = "symbol", ret: str = "ret") -> DataFrame:
    """Per window and role: n, mean and Sharpe (mean / deviation * sqrt n). A row goes to all windows that hold it, by arithmetic."""
    w = Window.partitionBy(by)
    x = rows.withColumn("_i", F.row_number().over(w.orderBy("ts")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    last = F.floor((F.col("_n") - train - test) / test)
    k_test = F.floor((F.col("_i") - train) / test)
    x = x.where(last >= 0)
    trained = x.withColumn("window", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("_i") - train) / test) + 1), F.floor(F.col("_i") / test)))).where((F.col("window") <= last) & (F.col("_i") - F.col("window") * test < train - purge)).withColumn("role", F.lit("train"))
    tested = x.where((F.col("_i") >= train) & (k_test <= last)).withColumn("window", k_test).withColumn("role", F.lit("test"))
    both = trained.unionByName(tested)
    return both.groupBy(by, "window", "role").agg(F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean"), (F.avg(ret) / F.nullif(F.stddev_pop(ret), F.lit(0.0)) * F.sqrt(F.count(F.lit(1)))).alias("sharpe"))


def purged_folds(rows: DataFrame, k: int, embargo: int = 0, by: str = "symbol") -> DataFrame:
    """Rows repeated for each fold with a role: test, train, or left out when within embargo rows of the test part."""
    w = Window.partitionBy(by)
    x = rows.withColumn("_i", F.row_number().over(w.orderBy("ts")) - 1).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    a, z = F.floor(F.col("_n") * F.col("fold") / k), F.floor(F.col("_n") * (F.col("fold") + 1) / k)
    role = F.when((F.col("_i") >= a) & (F.col("_i") < z), "test").when((F.col("_i") >= a - embargo) & (F.col("_i") < z + embargo), "left out").otherwise("train")
    return x.withColumn("role", role).drop("_i", "_n")


def expected_max_sharpe(variance: Column, trials: Column) -> Column:
    """Expected best Sharpe of so many trials without skill."""
    gamma = 0.5772156649015329
    return F.sqrt(variance) * ((1 - gamma) * norm_ppf(1 - 1 / trials) + gamma * norm_ppf(1 - 1 / (trials * math.e)))


def deflated_sharpe(returns_: DataFrame, trials: int, by: str = "symbol", ret: str = "ret") -> DataFrame:
    """sr, deflated Sharpe of each run against the best of so many trials with the variance seen among runs."""
    m = returns_.groupBy(by).agg(F.count(ret).alias("n"), (F.avg(ret) / F.nullif(F.stddev_samp(ret), F.lit(0.0))).alias("sr"), F.skewness(ret).alias("skew"), (F.kurtosis(ret) + 3).alias("kurt"))
    variance = m.agg(F.var_samp("sr").alias("v"))
    x = m.crossJoin(F.broadcast(variance))  # one row
    x = x.withColumn("bar", expected_max_sharpe(F.col("v"), F.lit(float(trials))))
    z = (F.col("sr") - F.col("bar")) * F.sqrt(F.col("n") - 1) / F.sqrt(F.greatest(1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") ** 2, F.lit(1e-12)))
    return x.withColumn("z", z).select(by, "n", "sr", "bar", "z", norm_cdf(F.col("z")).alias("dsr"))


def cscv(returns_: DataFrame, blocks: int = 8, variant: str = "variant", ret: str = "ret") -> DataFrame:
    """Combinatorial cross-validation: for each half of the blocks the best variant inside it and its rank outside.

    Rows are reduced to sums per variant and block first; combinations then join that small table only.
    """
    from itertools import combinations

    spark = returns_.sparkSession
    w = Window.partitionBy(variant)
    x = returns_.withColumn("_b", F.floor((F.row_number().over(w.orderBy("ts")) - 1) * blocks / F.count(F.lit(1)).over(w)))
    sums = x.groupBy(variant, "_b").agg(F.sum(ret).alias("s"), F.sum(F.col(ret) ** 2).alias("q"), F.count(ret).alias("n"))
    combos = spark.createDataFrame([(k, b, b in c) for k, c in enumerate(combinations(range(blocks), blocks // 2)) for b in range(blocks)], "combo int, _b bigint, inside boolean")
    part = sums.join(F.broadcast(combos), "_b").groupBy("combo", "inside", variant).agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    mean = F.col("s") / F.col("n")
    part = part.withColumn("sr", F.coalesce(mean / F.nullif(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))), F.lit(0.0)), F.lit(0.0)))
    best = part.where("inside").groupBy("combo").agg(F.max_by(variant, F.struct("sr", variant)).alias(variant))
    out = part.where("not inside")
    g = Window.partitionBy("combo")
    rank = F.rank().over(g.orderBy("sr")) + (F.count(F.lit(1)).over(Window.partitionBy("combo", "sr")) - 1) / 2
    out = out.withColumn("_w", rank / (F.count(F.lit(1)).over(g) + 1))
    return best.join(out, ["combo", variant]).select("combo", F.col(variant).alias("best"), F.col("_w").alias("rank"), F.ln(F.col("_w") / (1 - F.col("_w"))).alias("logit"))


def pbo(tests: DataFrame) -> DataFrame:
    """Share of combinations whose best variant ends in the lower half outside."""
    return tests.agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("combos"))


def risk_contributions(panel: DataFrame, weights: DataFrame, by: str = "symbol", ret: str = "ret") -> DataFrame:
    """w_i * sum_j w_j cov(i, j) of each asset, over common times."""
    a = panel.select("ts", F.col(by).alias("i"), F.col(ret).alias("ri"))
    b = panel.select("ts", F.col(by).alias("j"), F.col(ret).alias("rj"))
    cov = a.join(b, "ts").groupBy("i", "j").agg(F.covar_samp("ri", "rj").alias("cov"))
    wi, wj = weights.select(F.col(by).alias("i"), F.col("weight").alias("wi")), weights.select(F.col(by).alias("j"), F.col("weight").alias("wj"))
    x = cov.join(wi, "i").join(wj, "j").groupBy("i").agg(F.sum(F.col("wi") * F.col("wj") * F.col("cov")).alias("contribution"))
    return x.select(F.col("i").alias(by), "contribution")


def funded_returns(rows: DataFrame, fee: float, slippage: float, by: str = "symbol") -> DataFrame:
    """Adds ret: position times return, less cost that grows with the bar's range, less funding paid on the position (column rate, NULL for none)."""
    w = series(by)
    turnover = F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0.0)))
    move = F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0))
    cost = turnover * (fee + slippage * F.greatest(F.lit(1.0), (F.col("high") - F.col("low")) / F.col("close")))
    return rows.withColumn("ret", F.col("pos") * move - cost - F.col("pos") * F.coalesce("rate", F.lit(0.0)))


def stop_exits(rows: DataFrame, stop: float, target: float, by: str = "symbol") -> DataFrame:
    """Positions closed at the first touch of a stop or target price, both shares of the close the run was decided at; a tie is the stop.

    Adds exit_ret, the return to the exit price, on that bar; pos is 0 after it until the run ends.
    """
    w = series(by)
    x = runs(rows, "pos", by, "_run").withColumn("_pc", F.lag("close").over(w))
    run = Window.partitionBy(by, "_run")
    x = x.withColumn("_entry", F.first("_pc").over(run.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))
    long = F.col("pos") > 0
    level = lambda share: F.col("_entry") * F.when(long, 1 + share).otherwise(1 - share)
    st, tp = level(-stop), level(target)
    hit_st = F.when(long, F.col("low") <= st).otherwise(F.col("high") >= st)
    hit_tp = F.when(long, F.col("high") >= tp).otherwise(F.col("low") <= tp)
    x = x.withColumns({"_st": F.coalesce(hit_st & (F.col("pos") != 0), F.lit(False)), "_tp": F.coalesce(hit_tp & (F.col("pos") != 0), F.lit(False))})
    x = x.withColumn("_hit", F.min(F.when(F.col("_st") | F.col("_tp"), F.col("ts"))).over(run))
    price = F.when(F.col("_st"), st).otherwise(tp)
    x = x.withColumn("exit_ret", F.when(F.col("ts") == F.col("_hit"), F.signum("pos") * (price / F.col("_pc") - 1)))
    return x.withColumn("pos", F.when(F.col("ts") > F.col("_hit"), 0.0).otherwise(F.col("pos"))).drop("_run", "_pc", "_entry", "_st", "_tp", "_hit")


def delta_neutral(rows: DataFrame, fee: float, by: str = "symbol") -> DataFrame:
    """Adds ret of a basis position (column basis): its fall, plus funding received, less cost of two legs."""
    w = series(by)
    move = F.coalesce(F.col("basis") - F.lag("basis").over(w), F.lit(0.0))
    turnover = F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0.0)))
    return rows.withColumn("ret", -F.col("pos") * move + F.col("pos") * F.coalesce("rate", F.lit(0.0)) - turnover * 2 * fee)


def portfolio(rows: DataFrame, weights: DataFrame, by: str, ret: str) -> DataFrame:
    """Return of each time: weighted sum over the series that have one; a missing series adds nothing."""
    return rows.join(weights, by).groupBy("ts").agg(F.count(ret).alias("n"), F.sum(F.coalesce(ret, F.lit(0.0)) * F.col("weight")).alias("ret"))


def buy_and_hold(bars: DataFrame, bars_a_year: float, by: str = "symbol") -> DataFrame:
    """n and Sharpe of holding one unit, entered a bar late."""
    w = series(by)
    x = bars.withColumn("_r", F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0))).withColumn("_l", F.coalesce(F.lag("_r").over(w), F.lit(0.0)))
    return x.groupBy(by).agg(F.count(F.lit(1)).alias("n"), (F.avg("_l") / F.nullif(F.stddev_pop("_l"), F.lit(0.0)) * math.sqrt(bars_a_year)).alias("sharpe"))


def cost_concentration(rows: DataFrame, cost: float, best: int, by: str = "symbol") -> DataFrame:
    """Total result as it is, with costs doubled, and of the trades without the best ones."""
    base = rows.groupBy(by).agg(F.sum("ret").alias("total"), F.count(F.lit(1)).alias("n"), F.sum("turnover").alias("_t"))
    trades = run_trades(rows, by).withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ret"), "run"))).where(F.col("_k") > best)
    left = trades.groupBy(by).agg(F.sum("ret").alias("total"), F.count(F.lit(1)).alias("n"))
    row = lambda df, name, total: df.select(by, F.lit(name).alias("scenario"), total.alias("total"), "n")
    return row(base, "baseline", F.col("total")).unionByName(row(base, "costs doubled", F.col("total") - F.col("_t") * cost)).unionByName(row(left, "without best", F.col("total")))


def simple_pbo(sharpes: DataFrame, c: str, threshold: float, by: str = "symbol") -> DataFrame:
    """Chance that the best of as many draws as there are Sharpes lies below the threshold, scaled by the number of trials; the closed form of a bootstrap."""
    x = sharpes.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(c) < threshold).cast("double")).alias("_s"))
    return x.select(by, "n", F.least(F.lit(1.0), F.pow("_s", F.col("n")) * F.log2(F.greatest(F.col("n"), F.lit(2))) / 5).alias("pbo"))
