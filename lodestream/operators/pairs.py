"""Pairs of series: all of them at once, with the pair's name as the series key, so that each operator over series applies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.functions.numbers import share_of
from lodestream.functions.unit_roots import root_probability
from lodestream.operators import features as ft
from lodestream.operators.evaluation import hawkes
from lodestream.operators.joins import asof_join
from lodestream.operators.stats import adf
from lodestream.session import settle


def all_pairs(bars: DataFrame, by: str = "symbol") -> DataFrame:
    """symbol (first-second, in order of name), leg (the second), ts, c1, c2, spread (log ratio) on common times."""
    x = bars.select("ts", F.col(by).alias("_a"), F.col("close").alias("c1"))
    y = bars.select("ts", F.col(by).alias("leg"), F.col("close").alias("c2"))
    both = x.join(y, "ts").where("_a < leg")
    return both.select(F.concat_ws("-", "_a", "leg").alias("symbol"), "leg", "ts", "c1", "c2", F.ln(F.col("c1") / F.col("c2")).alias("spread"))


def legs_present(bars: DataFrame, by: str = "symbol") -> DataFrame:
    """Rows of both legs, and of either alone, for every pair of series: what a rule on the pair would miss."""
    n = bars.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    a, b = n.select(F.col(by).alias("a"), F.col("n").alias("_n")), n.select(F.col(by).alias("b"), F.col("n").alias("_m"))
    both = all_pairs(bars, by).groupBy("symbol", "leg").agg(F.count(F.lit(1)).alias("shared"))
    names = both.select(F.expr("substring(symbol, 1, length(symbol) - length(leg) - 1)").alias("a"), F.col("leg").alias("b"), "shared")
    x = names.join(a, "a").join(b, "b")
    return x.select("a", "b", "shared", (F.col("_n") - F.col("shared")).alias("only_a"), (F.col("_m") - F.col("shared")).alias("only_b"))


def placed(rows: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Adds each row's place from 1 in the order: rows are dealt and sorted by range, and counted by partition."""
    x = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed").withColumn("_part", F.shiftright("_at", 33))
    n = x.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    x = x.join(n.select("_part", "_low", before.alias("_before")), "_part")
    return x.withColumn(name, F.col("_before") + F.col("_at") - F.col("_low") + 1).drop("_at", "_part", "_low", "_before")


def rank_pairs(pairs: DataFrame, most: float = 0.05, longest: float = 200.0, least: int = 80) -> DataFrame:
    """Unit root t, its probability p, half-life and tradable (p at most `most`) of each pair's spread, best first: tradable, then the lowest p, then
    the shortest half-life. Places are running counts of a range partition, so no task holds all pairs."""
    w = ft.series()
    x = pairs.withColumn("_l", F.lag("spread").over(w)).withColumn("_d", F.col("spread") - F.col("_l"))
    slope = F.regr_slope("_d", "_l")
    half = x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.when(slope < 0, -F.ln(F.lit(2.0)) / slope).alias("half_life")).where(F.col("n") >= least)
    x = half.join(adf(pairs, "spread").select("symbol", "t"), "symbol").withColumn("p", root_probability(F.col("t")))
    x = x.withColumn("tradable", F.coalesce((F.col("p") <= most) & (F.col("half_life") > 1) & (F.col("half_life") < longest), F.lit(False)))
    return placed(x, [F.desc("tradable"), F.asc_nulls_last("p"), F.asc_nulls_last("half_life"), F.col("symbol")])


def cointegration(pairs: DataFrame, window: int, step: int, most: float = 0.05) -> DataFrame:
    """pair, end, t, p, block (p above most): two-step test on the window rows before every step-th row, and before the last row.

    The first leg's log is regressed on the second's; t is the unit root t of the residuals with one lagged change and no constant. Windows overlap,
    so a row goes to window / step of them; each window is one group of an aggregate.
    """
    w = Window.partitionBy("symbol")
    x = pairs.select("symbol", "ts", F.ln("c1").alias("_y"), F.ln("c2").alias("_x"), (F.row_number().over(w.orderBy("ts")) - 1).cast("bigint").alias("_i"), F.count(F.lit(1)).over(w).alias("_n"))
    first = F.greatest(F.lit(window), (F.floor(F.col("_i") / step) + 1) * step + window % step).cast("bigint")
    first = F.when(first - step > F.col("_i"), F.greatest(F.lit(window), first - step)).otherwise(first)
    last = F.least(F.col("_i") + window, F.col("_n") - 1)
    ends = F.when(first <= last, F.sequence(first, last, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    final = F.when((F.col("_n") - 1 >= window) & (F.col("_i") >= F.col("_n") - 1 - window) & (F.col("_i") < F.col("_n") - 1), F.array(F.col("_n") - 1)).otherwise(F.array().cast("array<bigint>"))
    each = x.withColumn("end", F.explode(F.array_union(ends, final)))
    fit = each.groupBy("symbol", "end").agg(F.regr_slope("_y", "_x").alias("_b"), F.regr_intercept("_y", "_x").alias("_a"))
    g = Window.partitionBy("symbol", "end").orderBy("_i")
    r = each.join(fit, ["symbol", "end"]).withColumn("_e", F.col("_y") - F.col("_a") - F.col("_b") * F.col("_x"))
    r = r.withColumn("_l", F.lag("_e").over(g)).withColumn("_d", F.col("_e") - F.col("_l")).withColumn("_k", F.lag("_d").over(g)).where("_k is not null")
    s = lambda a, b: F.sum(F.col(a) * F.col(b))
    m = r.groupBy("symbol", "end").agg(F.count(F.lit(1)).alias("n"), s("_l", "_l").alias("ll"), s("_l", "_k").alias("lk"), s("_k", "_k").alias("kk"), s("_l", "_d").alias("ld"), s("_k", "_d").alias("kd"), s("_d", "_d").alias("dd"))
    det = F.col("ll") * F.col("kk") - F.col("lk") ** 2
    b = (F.col("ld") * F.col("kk") - F.col("kd") * F.col("lk")) / det
    c = (F.col("ll") * F.col("kd") - F.col("lk") * F.col("ld")) / det
    rss = F.col("dd") - b * F.col("ld") - c * F.col("kd")
    t = b / F.sqrt(rss / (F.col("n") - 2) * F.col("kk") / det)
    x = m.select("symbol", "end", t.alias("t")).withColumn("p", F.coalesce(root_probability(F.col("t"), 2), F.lit(1.0)))
    return x.withColumn("block", F.col("p") > most)


def cointegration_gate(rows: DataFrame, tests: DataFrame, sig: str = "sig") -> DataFrame:
    """Adds gated: 0 from a failed test on until one passes; before the first test nothing is blocked."""
    x = rows.withColumn("_i", (F.row_number().over(ft.series()) - 1).cast("bigint"))
    x = x.join(tests.select("symbol", F.col("end").alias("_i"), F.col("block").alias("_b")), ["symbol", "_i"], "left")
    now = F.coalesce(F.last("_b", ignorenulls=True).over(ft.series().rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    return x.withColumn("gated", F.when(now, 0.0).otherwise(F.col(sig))).drop("_i", "_b")


def band_position(rows: DataFrame, value: str, n: int, least: int, enter: float, leave: float) -> DataFrame:
    """Adds z and sig: 1 above enter and -1 below minus enter on the rolling z of value, held until |z| is below leave."""
    mean, dev = F.avg(value).over(ft.last_n(n)), F.nullif(F.stddev_pop(value).over(ft.last_n(n)), F.lit(0.0))
    z = F.when(F.count(value).over(ft.last_n(n)) >= least, (F.col(value) - mean) / dev)
    x = rows.withColumn("z", F.coalesce(z, F.lit(0.0)))
    x = x.withColumn("_raw", F.when(F.col("z") > enter, 1.0).when(F.col("z") < -enter, -1.0))
    return ft.hold(x, "_raw", F.abs("z") < leave, exit_first=True).drop("_raw")


def block_entries(rows: DataFrame, block: Column, sig: str = "sig", name: str = "gated") -> DataFrame:
    """Adds name: 0 where block holds and the signal of the row before was 0; what is held already stays."""
    held = F.coalesce(F.lag(sig).over(ft.series()), F.lit(0.0)) != 0
    return rows.withColumn("_held", held).withColumn(name, F.when(F.coalesce(block, F.lit(False)) & ~F.col("_held"), 0.0).otherwise(F.col(sig))).drop("_held")


def entry_scale(rows: DataFrame, scale: Column, sig: str = "sig", name: str = "scaled") -> DataFrame:
    """Adds name: the signal times the scale of the row on which it was entered."""
    w = ft.series()
    new = (F.col(sig) != 0) & (F.coalesce(F.lag(sig).over(w), F.lit(0.0)) == 0)
    x = rows.withColumn("_s", F.when(new, scale))
    at = F.coalesce(F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    return x.withColumn(name, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(sig) * at))).drop("_s")


def spread_returns(rows: DataFrame, fee: float, sig: str = "sig", spread: str = "spread") -> DataFrame:
    """Adds pos and ret: against the spread's change while the signal of the row before is 1, less cost of two legs on each change."""
    w = ft.series()
    x = rows.withColumn("pos", F.coalesce(F.lag(sig).over(w), F.lit(0.0)))
    turnover = F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0.0)))
    return x.withColumn("ret", -F.col("pos") * F.coalesce(F.col(spread) - F.lag(spread).over(w), F.lit(0.0)) - turnover * 2 * fee)


def johansen(pairs: DataFrame, share: float = 0.7, least: int = 40) -> DataFrame:
    """symbol, beta: hedge ratio |v_x / v_y| of the first cointegrating vector of both logs, with one lagged change and means taken out.

    Fitted on the first share of a pair's rows, from one aggregate of cross-moments a pair; the eigenvector of the 2 x 2 system is in closed form. Null
    with fewer rows than least, or no such vector.
    """
    w, whole = ft.series(), Window.partitionBy("symbol")
    x = pairs.select("symbol", "ts", F.ln("c1").alias("y"), F.ln("c2").alias("x"), (F.row_number().over(w) - 1).alias("_i"), F.count(F.lit(1)).over(whole).alias("_n"))
    x = x.where(F.col("_i") < share_of(F.col("_n"), share))
    x = x.withColumns({"l1": F.lag("y").over(w), "l2": F.lag("x").over(w)}).withColumns({"d1": F.col("y") - F.col("l1"), "d2": F.col("x") - F.col("l2")})
    x = x.withColumns({"z1": F.lag("d1").over(w), "z2": F.lag("d2").over(w)}).where("z1 is not null")
    names = ("d1", "d2", "l1", "l2", "z1", "z2")
    m = x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(a, b).alias(f"{a}{b}") for i, a in enumerate(names) for b in names[i:]])
    c = lambda a, b: F.col(min(a, b) + max(a, b))
    det = c("z1", "z1") * c("z2", "z2") - c("z1", "z2") ** 2

    def left(a: str, b: str) -> Column:
        """Covariance of what the lagged changes leave of a and b."""
        through = c(a, "z1") * (c("z2", "z2") * c(b, "z1") - c("z1", "z2") * c(b, "z2")) + c(a, "z2") * (c("z1", "z1") * c(b, "z2") - c("z1", "z2") * c(b, "z1"))
        return c(a, b) - through / F.nullif(det, F.lit(0.0))

    m = m.select("symbol", "n", *[left(a, b).alias(f"s_{a}{b}") for i, a in enumerate(names[:4]) for b in names[i:4]])
    s = lambda a, b: F.col("s_" + min(a, b) + max(a, b))
    det0 = F.nullif(s("d1", "d1") * s("d2", "d2") - s("d1", "d2") ** 2, F.lit(0.0))
    # levels on changes: q = S_ld S_dd^-1 S_dl
    q = lambda a, b: (s("d2", "d2") * s("d1", a) * s("d1", b) - s("d1", "d2") * (s("d1", a) * s("d2", b) + s("d2", a) * s("d1", b)) + s("d1", "d1") * s("d2", a) * s("d2", b)) / det0
    m = m.withColumns({"q11": q("l1", "l1"), "q12": q("l1", "l2"), "q22": q("l2", "l2"), "_d": F.nullif(s("l1", "l1") * s("l2", "l2") - s("l1", "l2") ** 2, F.lit(0.0))})
    a, b, d, e = s("l1", "l1"), s("l1", "l2"), s("l2", "l2"), F.col("_d")
    m = m.withColumns({"m11": (d * F.col("q11") - b * F.col("q12")) / e, "m12": (d * F.col("q12") - b * F.col("q22")) / e, "m21": (a * F.col("q12") - b * F.col("q11")) / e, "m22": (a * F.col("q22") - b * F.col("q12")) / e})
    top = (F.col("m11") + F.col("m22")) / 2 + F.sqrt(F.greatest(((F.col("m11") - F.col("m22")) / 2) ** 2 + F.col("m12") * F.col("m21"), F.lit(0.0)))
    return m.select("symbol", F.when(F.col("n") + 2 >= least, F.abs((top - F.col("m11")) / F.nullif("m12", F.lit(0.0)))).alias("beta"))


def compare_hedges(pairs: DataFrame, n: int, share: float = 0.7, enter: float = 2.0, leave: float = 0.3) -> DataFrame:
    """Sharpe (times root n) after the first share of rows of trading the log ratio, the spread by rolling slope, and the spread by the cointegrating
    vector of the rows before; prefer says which is higher (ratio, then ols, where they tie)."""
    last = ft.last_n(n)
    x = pairs.withColumns({"_y": F.ln("c1"), "_x": F.ln("c2")})
    slope = F.covar_pop("_y", "_x").over(last) / F.nullif(F.var_pop("_x").over(last), F.lit(0.0))
    x = x.withColumn("beta", F.when(F.count(F.lit(1)).over(last) >= n, slope)).withColumn("hedged", F.col("_y") - F.col("beta") * F.col("_x"))
    x = x.join(johansen(pairs, share).withColumnRenamed("beta", "_j"), "symbol", "left").withColumn("vector", F.col("_y") - F.col("_j") * F.col("_x"))
    i, count = F.row_number().over(ft.series()) - 1, F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    x = x.withColumn("_oos", i >= share_of(count, share))

    def ratio(value: str, name: str) -> DataFrame:
        r = spread_returns(band_position(x, value, n, n // 2, enter, leave), 0.0, spread=value).where("_oos")
        return r.groupBy("symbol").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.max("_j").alias(f"_j_{name}"), (F.avg("ret") / F.nullif(F.stddev_pop("ret"), F.lit(0.0)) * F.sqrt(F.count(F.lit(1)))).alias(name))

    both = ratio("spread", "ratio").join(ratio("hedged", "ols"), "symbol").join(ratio("vector", "johansen"), "symbol").fillna(0.0, ["ratio", "ols", "johansen"])
    j = F.when(F.col("_j_ratio").isNotNull(), F.col("johansen"))
    prefer = F.when((F.col("ols") > F.col("ratio") + 1e-9) & (j.isNull() | (F.col("ols") >= j)), "ols").when((j > F.col("ratio") + 1e-9) & (j > F.col("ols")), "johansen").otherwise("ratio")
    return both.select("symbol", F.col("n_ratio").alias("n"), F.col("_j_ratio").alias("beta"), "ratio", "ols", j.alias("johansen"), prefer.alias("prefer"))


def toxic_flow(ticks: DataFrame, at: DataFrame, beta: float, by: str = "symbol") -> DataFrame:
    """Rows of `at` with imbalance: (b - s) / (b + s) of the self-exciting intensities of buys and sells at each side's last tick so far; 0 without ticks.

    Each side's intensity is that at its own last tick, as no tick of the other side renews it.
    """
    out = at
    for side, name in (("buy", "_b"), ("sell", "_s")):
        own = hawkes(ticks.where(F.col("side") == side), beta, by, order=("ts", "trade_id"), name=name).select(by, "ts", "trade_id", name)
        out = asof_join(out, own, cols=[name], prefix="", by=[by], tie="trade_id")
    b, s = F.coalesce("_b", F.lit(0.0)), F.coalesce("_s", F.lit(0.0))
    return out.withColumn("imbalance", F.coalesce((b - s) / F.nullif(b + s, F.lit(0.0)), F.lit(0.0))).drop("_b", "_s")
