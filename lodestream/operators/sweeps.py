"""Tables of sweep cells: coercion, gates, verdicts, winners, leaderboard.

A cell is one run of (strategy, symbol, interval, mode, days) with its metrics. Gates list their reasons; an empty list passes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.operators.accounting import expected_max_sharpe

#: Bounds of the gates (fixed values).
OOS_SHARPE, OOS_SHARE, DSR, SMOOTHNESS, PBO, SHARPE_LIMIT = 0.3, 0.5, 0.95, 0.3, 0.5, 20.0
#: Maker and taker fee by exchange and tier, shares of notional (fixed values).
FEES = {
    "binance": {"vip0": (0.0002, 0.0005), "vip1": (0.00016, 0.0004), "vip2": (0.00014, 0.00035), "vip3": (0.00012, 0.00032), "vip4": (0.0001, 0.0003), "vip5": (0.00008, 0.00027), "vip6": (0.00006, 0.00024), "vip7": (0.00004, 0.0002), "vip8": (0.00002, 0.00018), "vip9": (0.0, 0.00017)},
    "bybit": {"vip0": (0.0002, 0.00055), "vip1": (0.00016, 0.0005), "vip2": (0.00014, 0.00045), "vip3": (0.00012, 0.0004), "vip4": (0.0001, 0.00035), "vip5": (0.00008, 0.0003), "supreme": (0.0, 0.0003)},
}
DISCOUNT = 0.25


def reasons(*gates: Column) -> Column:
    """The texts that are not NULL, joined."""
    return F.array_join(F.array_compact(F.array(*gates)), "; ")


def coerce(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns to doubles; what is no number becomes NULL."""
    return cells.withColumns({c: F.expr(f"try_cast({c} AS double)") for c in columns})


def least_trades(least: Mapping[str, int], otherwise: int) -> Column:
    """The number of trades that a cell of the interval needs."""
    return F.coalesce(F.element_at(F.create_map(*[x for k, n in least.items() for x in (F.lit(k), F.lit(n))]), F.col("interval")), F.lit(otherwise))


def candidates(cells: DataFrame, least: Mapping[str, int], otherwise: int = 40) -> DataFrame:
    """Adds candidate: out-of-sample Sharpe and share of positive windows above the bounds, and enough trades; NULLs fail."""
    ok = (F.col("avg_oos_sharpe") > OOS_SHARPE) & (F.col("oos_positive_frac") >= OOS_SHARE) & (F.coalesce("n_trades", F.lit(0)) >= least_trades(least, otherwise))
    return cells.withColumn("candidate", F.coalesce(ok, F.lit(False)))


def degenerate(cells: DataFrame, least: Mapping[str, int], otherwise: int = 40, days: int = 30) -> DataFrame:
    """Adds error and status: cells whose numbers are no result of trading, of runs of at least so many days that were ok."""
    full = F.col("mode") == "backtest"
    need = least_trades(least, otherwise)
    why = reasons(
        F.when(F.col("n_trades") <= 0, "no trades").when(F.col("n_trades") < need, "too few trades"),
        F.when(full & (F.col("total_return") <= -1), "capital lost"),
        F.when(full & (F.col("profit_factor").isNull() | F.isnan("profit_factor") | (F.col("profit_factor") == float("inf"))), "profit factor undefined"),
        F.when(full & (F.abs("sharpe") > SHARPE_LIMIT), "Sharpe implausible"),
    )
    x = cells.withColumn("error", F.when((F.col("status") == "ok") & (F.col("days") >= days), why).otherwise(""))
    return x.withColumn("status", F.when(F.col("error") != "", "degenerate").otherwise(F.col("status")))


def cell_verdict(cells: DataFrame, least: Mapping[str, int], otherwise: int = 40, final: bool = False) -> DataFrame:
    """Adds reasons and verdict of twelve gates: PASS (final) or EXPLORATORY_PASS without a reason, else FAIL."""
    c = F.col
    why = reasons(
        F.when(~F.coalesce(c("avg_oos_sharpe") > OOS_SHARPE, F.lit(False)), "avg_oos_sharpe"),
        F.when(~F.coalesce(c("oos_positive_frac") >= OOS_SHARE, F.lit(False)), "oos_pos_frac"),
        F.when(~F.coalesce(c("dsr") > DSR, F.lit(False)), "DSR"),
        F.when(~F.coalesce(c("smoothness") > SMOOTHNESS, F.lit(False)), "smoothness"),
        F.when(~F.coalesce(c("n_trades_oos") >= least_trades(least, otherwise), F.lit(False)), "n_trades_oos"),
        F.when(c("pbo") > PBO, "PBO"),
        F.when(~c("quintile_pass"), "quintile"),
        F.when(~c("time_decay_pass"), "time_decay"),
        F.when(~c("stress_pass"), "stress"),
        F.when(c("sharpe") <= c("benchmark_sharpe"), "benchmark"),
        *([F.when(c("holdout_sharpe").isNull(), "holdout missing").when(c("holdout_sharpe") <= 0, "holdout")] if final else []),
    )
    x = cells.withColumn("reasons", F.when(c("status") != "ok", F.concat(F.lit("audit: "), F.coalesce("error", F.lit("unknown")))).otherwise(why))
    return x.withColumn("verdict", F.when(c("reasons") != "", "FAIL").otherwise("PASS" if final else "EXPLORATORY_PASS"))


def pair_gate(share: Column, windows: Column, least: float = 0.5, crash: Column | None = None, liquidity: Column | None = None, base: Column | None = None) -> Column:
    """Reasons against a pair: no windows, too few positive ones, drawdown under stress beyond 2.5 or 4 times the base's."""
    gates = [F.when(windows == 0, "no windows").when(share < least, "positive windows")]
    if base is not None:
        gates += [F.when((base > 0) & (crash > base * 2.5), "crash"), F.when((base > 0) & (liquidity > base * 4.0), "liquidity")]
    return reasons(*gates)


def paper_gate(tracking: Column, fill_rate: Column, paper_dd: Column, base_dd: Column, cost_bps: Column) -> Column:
    """Reasons against going live from paper trading."""
    return reasons(F.when(tracking > 0.03, "tracking error"), F.when(fill_rate < 0.7, "fill rate"), F.when(paper_dd > base_dd * 1.5, "drawdown"), F.when(cost_bps > 3.0, "cost"))


def dsr_label(dsr: Column) -> Column:
    return F.when(dsr > 0.95, "significant").when(dsr > 0.5, "weak").otherwise("none")


def hurdle_label(mean_net: Column, round_trip: float, legs: int = 1) -> Column:
    """How an average trade after cost stands to a round trip's cost."""
    return F.when(mean_net > 0, "covers").when(mean_net > -round_trip * legs, "near zero").otherwise("drag")


def against_baseline(cells: DataFrame, baseline: DataFrame, keys: Sequence[str], delta: float = 0.0, trades: int = 30) -> DataFrame:
    """Adds verdict (IMPROVED, REGRESSED, SKIPPED) against the baseline's sharpe and total_return, and oos: improved with enough trades."""
    base = baseline.select(*keys, F.col("sharpe").alias("_s"), F.col("total_return").alias("_r"))
    better = (F.col("sharpe") > F.col("_s") + delta) & (F.col("total_return") >= F.col("_r"))
    worse = (F.col("sharpe") < F.col("_s")) | (F.col("total_return") < F.col("_r"))
    x = cells.join(base, list(keys)).withColumn("verdict", F.when(better, "IMPROVED").when(worse, "REGRESSED").otherwise("SKIPPED"))
    return x.withColumn("oos", (F.col("verdict") == "IMPROVED") & (F.col("n_trades") >= trades)).drop("_s", "_r")


def normal_symbol(symbol: Column) -> Column:
    """LINKUSDT/BTCUSDT to LINK-BTC; names of portfolios stay."""
    up = F.upper(symbol)
    return F.when(up.startswith("PORTFOLIO"), up).otherwise(F.translate(F.replace(up, F.lit("USDT"), F.lit("")), "/_", "--"))


def fees(rows: DataFrame, exchange: str = "exchange", tier: str = "tier", discount: str | None = None) -> DataFrame:
    """Adds maker and taker of (exchange, tier), case ignored; the discount column lowers those of the exchange that grants it. The table has 17 rows."""
    table = rows.sparkSession.createDataFrame([(e, t, *f) for e, ts in FEES.items() for t, f in ts.items()], "_e string, _t string, maker double, taker double")
    on = (F.lower(F.trim(exchange)) == F.col("_e")) & (F.lower(F.trim(tier)) == F.col("_t"))
    x = rows.join(F.broadcast(table), on, "left")
    if discount:
        less = F.when(F.col(discount) & (F.col("_e") == "binance"), 1 - DISCOUNT).otherwise(1.0)
        x = x.withColumns({"maker": F.col("maker") * less, "taker": F.col("taker") * less})
    return x.drop("_e", "_t")


def summary(cells: DataFrame) -> DataFrame:
    """Per strategy: mean and best Sharpe, cells, mean trades, of cells that are ok."""
    return cells.where("status = 'ok'").groupBy("strategy").agg(F.avg("sharpe").alias("mean_sharpe"), F.max("sharpe").alias("max_sharpe"), F.count(F.lit(1)).alias("n"), F.avg("n_trades").alias("mean_trades"))


def winners(cells: DataFrame, by: Sequence[str] = ("mode", "interval")) -> DataFrame:
    """Best cell of each group by out-of-sample Sharpe (in-sample where fewer than two have one), less what the best of so many would have without skill."""
    ok = cells.where("status = 'ok'")
    have = ok.groupBy(*by).agg((F.count("avg_oos_sharpe") >= 2).alias("_oos"))
    x = ok.join(have, list(by)).withColumn("metric", F.when(F.col("_oos"), "avg_oos_sharpe").otherwise("sharpe")).withColumn("_v", F.when(F.col("_oos"), F.col("avg_oos_sharpe")).otherwise(F.col("sharpe"))).where("_v is not null")
    best = F.max_by(F.struct("strategy", "symbol", "_v", "metric"), F.struct("_v", "strategy", "symbol"))
    g = x.groupBy(*by).agg(best.alias("_b"), F.count(F.lit(1)).alias("n"), F.var_samp("_v").alias("_var"))
    sr0 = F.when(F.col("n") > 1, expected_max_sharpe(F.col("_var"), F.col("n").cast("double"))).otherwise(0.0)
    g = g.withColumn("selection_sr0", F.coalesce(sr0, F.lit(0.0)))
    return g.select(*by, "_b.metric", F.col("_b.strategy").alias("winner"), F.col("_b.symbol").alias("symbol"), F.col("_b._v").alias("value"), "selection_sr0", (F.col("_b._v") - F.col("selection_sr0")).alias("deflated"), "n")


def unique_winners(cells: DataFrame, size: int, score: str = "sharpe") -> DataFrame:
    """The best cell of each (strategy, symbol), the best `size` of them; a top-k report."""
    w = Window.partitionBy("strategy", "symbol").orderBy(F.desc(score), "interval", "mode", "days")
    best = cells.where(F.col(score).isNotNull()).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return best.orderBy(F.desc(score), "strategy", "symbol").limit(size)


def leaderboard(rows: DataFrame) -> DataFrame:
    """Best row of each (strategy, symbol, interval) by score, with its tier.

    rows: audits and portfolio rows in one table (strategy, symbol, interval, avg_oos_sharpe, oos_pos_frac, dsr, pbo, port_sharpe,
    t_nw, verdict). The tier is by portfolio evidence, else by verdict; a pair rule on one symbol is rejected.
    """
    key = normal_symbol(F.col("symbol"))
    lone = F.lower("strategy").contains("pairs_arb") & (F.size(F.filter(F.split(key, "-"), lambda p: p != "")) < 2)
    strong = F.col("port_sharpe") >= 0.5
    tier = (
        F.when(lone, "rejected").when(strong & (F.col("t_nw") >= 2.0), "monitoring").when(strong & (F.col("t_nw") >= 1.5), "candidate").when(F.col("verdict") == "PASS", "paper")
        .when((F.col("avg_oos_sharpe") >= 0.15) & F.col("verdict").isin("EXPLORATORY_PASS", "FAIL"), "candidate").otherwise("rejected")
    )
    part = lambda c, k: F.coalesce(F.col(c) * k, F.lit(0.0))
    bonus = F.when(F.col("tier") == "paper", 4.0).when(F.col("tier") == "monitoring", 3.0).when(F.col("tier") == "candidate", 1.0).otherwise(0.0)
    score = part("port_sharpe", 2.0) + part("avg_oos_sharpe", 1.0) + part("t_nw", 0.15) + part("oos_pos_frac", 0.2) + part("dsr", 0.1) + F.when(F.col("pbo") < PBO, 0.1).otherwise(0.0) + bonus
    x = rows.withColumn("tier", tier).withColumn("score", score).withColumns({"_s": F.lower("strategy"), "symbol": key, "_i": F.lower("interval")})
    best = x.groupBy("_s", "symbol", "_i").agg(F.max_by(F.struct("tier", "score"), F.struct("score", "tier")).alias("_b"))
    return best.select(F.col("_s").alias("strategy"), "symbol", F.col("_i").alias("interval"), "_b.tier", "_b.score")


def map_attribution(cells: DataFrame, column: str = "blocked") -> DataFrame:
    """Per strategy and filter: how often it blocked, summed over cells whose column holds a JSON map of counts."""
    counts = F.from_json(column, "map<string,int>")
    return cells.select("strategy", F.explode(counts).alias("filter", "n")).groupBy("strategy", "filter").agg(F.sum("n").alias("n"))
