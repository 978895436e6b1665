"""Whole sweeps, searches and audits as one job: cells, parameters, folds and scenarios are key columns, not loops."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.operators import accounting as ac
from lodestream.operators import features as ft
from lodestream.operators.resample import resample
from lodestream.operators.scan import scans


def _ratio(c: str | Column) -> Column:
    return F.avg(c) / F.nullif(F.stddev_pop(c), F.lit(0.0))


def interval_bars(ticks: DataFrame, intervals: Mapping[str, str]) -> DataFrame:
    """Bars of several intervals in one table; the series key is symbol@interval."""
    out = None
    for name, every in intervals.items():
        x = resample(ticks, every, price="price", volume="amount", tie="trade_id").withColumn("symbol", F.concat_ws("@", "symbol", F.lit(name)))
        out = x if out is None else out.unionByName(x)
    return out


def sweep(bars: DataFrame, rules: Mapping[str, Callable[[DataFrame], DataFrame]], size: float, cost: float) -> DataFrame:
    """strategy, symbol, interval, n, trades, total, sharpe of every rule on every series symbol@interval."""
    out = None
    for name, rule in rules.items():
        x = ac.returns(ac.positions(rule(bars), size), cost, 0.0).withColumn("_in", (F.col("pos") != 0) & (F.coalesce(F.lag("pos").over(ft.series()), F.lit(0.0)) != F.col("pos")))
        x = x.select(F.lit(name).alias("strategy"), "symbol", "ret", "_in")
        out = x if out is None else out.unionByName(x)
    g = out.groupBy("strategy", "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_in").cast("int")).alias("trades"), F.sum("ret").alias("total"), _ratio("ret").alias("sharpe"))
    return g.select("strategy", F.substring_index("symbol", "@", 1).alias("symbol"), F.substring_index("symbol", "@", -1).alias("interval"), "n", "trades", "total", "sharpe")


def parameter_search(bars: DataFrame, lengths: Sequence[int], enters: Sequence[float], folds: int = 4, purge: int = 2, keep: float = 0.8) -> DataFrame:
    """The best (length, enter) of a z-score rule for each series, by mean Sharpe over folds, and its Sharpe on the rows held out.

    Folds are runs of the first share of rows, less purge rows at their begin. Every row meets every parameter, as rows of one aggregate.
    """
    w, whole = ft.series(), Window.partitionBy("symbol")
    x = bars.withColumns({f"_z{n}": ft.full(ft.zscore("close", n), n) for n in lengths} | {"_f": F.lead("close").over(w) / F.col("close") - 1, "_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(whole)})
    m = F.floor(F.col("_n") * F.lit(keep))
    fold = F.floor(F.col("_i") * folds / m)
    x = x.withColumns({"_m": m, "_fold": F.when(F.col("_i") < m, fold)})
    first = F.min("_i").over(Window.partitionBy("symbol", "_fold"))
    x = x.withColumn("_late", F.col("_i") - first >= purge).where("_f is not null and (_fold is null or _late)")
    z = F.array(*[F.struct(F.lit(n).alias("length"), F.col(f"_z{n}").alias("z")) for n in lengths])
    x = x.select("symbol", "_fold", "_f", F.explode(z).alias("_p")).select("symbol", "_fold", "_f", "_p.*").withColumn("enter", F.explode(F.array(*[F.lit(float(e)) for e in enters])))
    r = F.when(F.col("z") >= F.col("enter"), -F.col("_f")).when(F.col("z") <= -F.col("enter"), F.col("_f")).otherwise(0.0)
    each = x.groupBy("symbol", "length", "enter", "_fold").agg(F.coalesce(_ratio(r), F.lit(0.0)).alias("_s"))
    g = each.groupBy("symbol", "length", "enter").agg(F.avg(F.when(F.col("_fold").isNotNull(), F.col("_s"))).alias("objective"), F.max(F.when(F.col("_fold").isNull(), F.col("_s"))).alias("holdout"))
    best = F.max_by(F.struct("length", "enter", "objective", "holdout"), F.struct("objective", "length", "enter"))
    return g.groupBy("symbol").agg(best.alias("_b"), F.count(F.lit(1)).alias("tried")).select("symbol", "tried", "_b.*")


def garch_search(rows: DataFrame, ret: str, alphas: Sequence[float], betas: Sequence[float], refit: int) -> DataFrame:
    """symbol, part, alpha, beta, ll: the likeliest parameters in each run of refit rows; variance is kept at the series' mean square.

    All parameters are scanned at once: recurrences with one beta share a scan.
    """
    w = ft.series()
    x = rows.where(F.col(ret).isNotNull()).select("symbol", "ts", F.col(ret).alias("_r"))
    x = x.withColumns({"_v": F.avg(F.col("_r") ** 2).over(Window.partitionBy("symbol")), "_p": F.coalesce(F.lag("_r").over(w), F.lit(0.0)) ** 2, "part": F.floor((F.row_number().over(w) - 1) / refit)})
    spec = {f"_g{i}_{j}": (b, (1 - a - b) * F.col("_v") + a * F.col("_p"), F.col("_v")) for i, a in enumerate(alphas) for j, b in enumerate(betas)}
    x = scans(x, spec)
    each = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(b)).alias("beta"), F.col(f"_g{i}_{j}").alias("g")) for i, a in enumerate(alphas) for j, b in enumerate(betas)])
    x = x.select("symbol", "part", "_r", F.explode(each).alias("_e")).select("symbol", "part", "_r", "_e.*")
    g = x.groupBy("symbol", "part", "alpha", "beta").agg((-0.5 * F.sum(F.ln("g") + F.col("_r") ** 2 / F.col("g"))).alias("ll"))
    best = F.max_by(F.struct("alpha", "beta", "ll"), F.struct("ll", "alpha", "beta"))
    return g.groupBy("symbol", "part").agg(best.alias("_b")).select("symbol", "part", "_b.*")


def extended_audit(rows: DataFrame, worst: int = 24, factor: float = 2.0, limit: float = 2.5) -> DataFrame:
    """One row a series (columns ts, close, sig): order of results by signal, Welch t, Sharpe by delay, drawdown under stress, and of holding.

    monotonic: means of the next return rise or fall over signals -1, 0, 1. decays: Sharpe falls by half or more from the first delay to
    the second. crash_dd: drawdown with the worst run of rows times factor; stress_pass: at most limit times the drawdown as it is.
    """
    w = ft.series()
    move = F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0))
    x = rows.withColumns({"_m": move, "_f": F.lead("close").over(w) / F.col("close") - 1, "_i": F.row_number().over(w)} | {f"_p{k}": F.coalesce(F.lag("sig", k).over(w), F.lit(0.0)) for k in (1, 2, 3)})
    x = x.withColumns({f"_r{k}": F.col(f"_p{k}") * 0.01 * F.col("_m") for k in (1, 2, 3)})
    x = x.withColumn("_s", F.sum("_r1").over(w.rowsBetween(-(worst - 1), 0)))
    bad = x.where(F.col("_i") >= worst).groupBy("symbol").agg(F.min_by("_i", F.struct("_s", "_i")).alias("_z"))
    x = x.join(bad, "symbol", "left").withColumn("_c", F.when((F.col("_i") <= F.col("_z")) & (F.col("_i") > F.col("_z") - worst), F.col("_r1") * factor).otherwise(F.col("_r1")))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"_q0": F.sum("_r1").over(run), "_q1": F.sum("_c").over(run)})
    x = x.withColumns({f"_d{k}": F.col(f"_q{k}") - F.greatest(F.max(f"_q{k}").over(run), F.lit(0.0)) for k in (0, 1)})
    side = lambda s: F.when(F.col("sig") == s, F.col("_f"))
    mean = {s: F.avg(side(s)) for s in (-1, 0, 1)}
    middle = F.coalesce(mean[0], mean[-1])
    rising, falling = (mean[-1] <= middle) & (middle <= mean[1]), (mean[-1] >= middle) & (middle >= mean[1])
    welch = (mean[1] - mean[-1]) / F.nullif(F.sqrt(F.var_samp(side(1)) / F.count(side(1)) + F.var_samp(side(-1)) / F.count(side(-1))), F.lit(0.0))
    out = x.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(rising | falling, F.lit(False)).alias("monotonic"), welch.alias("welch_t"), *[(_ratio(f"_r{k}") * F.sqrt(F.count(F.lit(1)))).alias(f"sharpe_{k}") for k in (1, 2, 3)],
        (-F.min("_d0")).alias("base_dd"), (-F.min("_d1")).alias("crash_dd"), (_ratio("_m") * F.sqrt(F.count(F.lit(1)))).alias("benchmark_sharpe"),
    )
    decays = F.coalesce((F.col("sharpe_1") > 0) & (F.col("sharpe_2") < 0.5 * F.col("sharpe_1")), F.lit(False))
    return out.withColumns({"decays": decays, "stress_pass": ~((F.col("base_dd") > 0) & (F.col("crash_dd") > limit * F.col("base_dd")))})


def audit_verdict(audit: DataFrame, windows: DataFrame, least_sharpe: float = 0.3, positive: float = 0.5) -> DataFrame:
    """Audit rows with avg_oos_sharpe and oos_positive_frac of their test windows, reasons, and verdict; a series without windows fails."""
    g = windows.where("role = 'test'").groupBy("symbol").agg(F.avg(F.coalesce("sharpe", F.lit(0.0))).alias("avg_oos_sharpe"), F.avg((F.coalesce("sharpe", F.lit(0.0)) > 0).cast("double")).alias("oos_positive_frac"))
    x = audit.join(g, "symbol", "left")
    fails = {
        "avg_oos_sharpe": ~F.coalesce(F.col("avg_oos_sharpe") > least_sharpe, F.lit(False)), "oos_pos_frac": ~F.coalesce(F.col("oos_positive_frac") >= positive, F.lit(False)), "quintile": ~F.col("monotonic"),
        "time_decay": F.col("decays"), "stress": ~F.col("stress_pass"), "benchmark": F.coalesce(F.col("sharpe_1") <= F.col("benchmark_sharpe"), F.lit(False)),
    }
    x = x.withColumn("reasons", F.concat_ws("; ", *[F.when(c, F.lit(k)) for k, c in fails.items()]))
    return x.withColumn("verdict", F.when(F.col("reasons") == "", "PASS").otherwise("FAIL"))


def against_source(cached: DataFrame, other: DataFrame, samples: int, most: float) -> DataFrame:
    """checked, mismatched, max_divergence of each series: closes on evenly spaced inner rows against a second table's closes at that time."""
    w = ft.series()
    x = cached.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    # row i is a sample if it is floor((k + 1) * n / (samples + 1)) for some k
    k = F.ceil(F.col("_i") * (samples + 1) / F.col("_n"))
    x = x.where((k >= 1) & (k <= samples) & (F.floor(k * F.col("_n") / (samples + 1)) == F.col("_i")))
    x = x.select("symbol", "ts", "close").join(other.where("close > 0").select("symbol", "ts", F.col("close").alias("_c")), ["symbol", "ts"])
    gap = F.abs(F.col("close") / F.col("_c") - 1)
    return x.groupBy("symbol").agg(F.count(F.lit(1)).alias("checked"), F.sum((gap > most).cast("int")).alias("mismatched"), F.max(gap).alias("max_divergence"))


def gap_zones(bars: DataFrame, oldest: int = 24) -> DataFrame:
    """Adds bull_top, bull_bottom, bear_top, bear_bottom of the latest gap between a bar and the second before it, and fresh_bull, fresh_bear.

    A zone lives from its bar on until a low falls below it (a high rises above it) or it is older than oldest rows; touches are
    fresh on their first row.
    """
    w = ft.series()
    x = bars.withColumns({"_h2": F.lag("high", 2).over(w), "_l2": F.lag("low", 2).over(w)})
    x = x.withColumns({"_bull": F.coalesce(F.col("low") > F.col("_h2"), F.lit(False)), "_bear": F.coalesce(F.col("high") < F.col("_l2"), F.lit(False))})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    for side, top, bottom in (("bull", "low", "_h2"), ("bear", "_l2", "high")):
        born = F.col(f"_{side}")
        x = x.withColumns({"_run": F.sum(born.cast("int")).over(upto), "_t": F.last(F.when(born, F.col(top)), ignorenulls=True).over(upto), "_b": F.last(F.when(born, F.col(bottom)), ignorenulls=True).over(upto)})
        r = Window.partitionBy("symbol", "_run").orderBy("ts")
        inside = r.rowsBetween(Window.unboundedPreceding, 0)
        broken = F.min("low").over(inside) < F.col("_b") if side == "bull" else F.max("high").over(inside) > F.col("_t")
        x = x.withColumn("_live", (F.col("_run") > 0) & ~F.coalesce(broken, F.lit(False)) & (F.row_number().over(r) - 1 <= oldest))
        x = x.withColumns({f"{side}_top": F.when(F.col("_live"), F.col("_t")), f"{side}_bottom": F.when(F.col("_live"), F.col("_b"))})
        edge = F.col("low") if side == "bull" else F.col("high")
        x = x.withColumn("_touch", F.coalesce((edge <= F.col(f"{side}_top")) & (edge >= F.col(f"{side}_bottom")), F.lit(False)))
        x = x.withColumn(f"fresh_{side}", F.col("_touch") & ~F.lag("_touch", 1, True).over(w))
    return x.drop("_h2", "_l2", "_bull", "_bear", "_run", "_t", "_b", "_live", "_touch")


class GapState:
    def __init__(self) -> None:
        self.side, self.stop, self.target = 0, None, None


def gap_step(stop: float, target: float, shorts: bool) -> Callable:
    """A step of the gap position: in on a fresh touch, out at a stop or target of so many ranges, turned round by the other side's touch."""

    def enter(s: GapState, side: int, close: float, atr: float) -> None:
        s.side, s.stop, s.target = side, close - side * stop * atr, close + side * target * atr

    def step(s: GapState, high: float, low: float, close: float, atr: float, bull: bool, bear: bool) -> tuple[int, float | None, float | None]:
        if s.side == 0:
            if bull:
                enter(s, 1, close, atr)
            elif shorts and bear:
                enter(s, -1, close, atr)
        elif s.side == 1:
            if bear and shorts:
                enter(s, -1, close, atr)
            elif bear or low <= s.stop or high >= s.target:
                s.side = 0
        elif bull:
            enter(s, 1, close, atr)
        elif high >= s.stop or low <= s.target:
            s.side = 0
        return (s.side, s.stop, s.target) if s.side else (0, None, None)

    return step


def importance(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, by: str = "symbol") -> DataFrame:
    """symbol, feature, single, permuted: squared correlation of one feature alone, and what permuting it adds to the mean squared error.

    The model is least squares on all features (two to four), from moments of the training rows; its error is on the test rows, where
    a feature's values are dealt anew inside a series by a fixed map of row numbers.
    """
    from lodestream.operators.models import solve

    cov = {f"_c{i}_{j}": F.covar_pop(a, b) for i, a in enumerate(features) for j, b in enumerate(features) if i <= j} | {f"_d{i}": F.covar_pop(a, label) for i, a in enumerate(features)}
    m = train.groupBy(by).agg(*[c.alias(k) for k, c in cov.items()], F.avg(label).alias("_my"), *[F.avg(a).alias(f"_m{i}") for i, a in enumerate(features)])
    k = range(len(features))
    beta = solve([[F.col(f"_c{min(i, j)}_{max(i, j)}") for j in k] for i in k], [F.col(f"_d{i}") for i in k])
    m = m.select(by, "_my", *[F.col(f"_m{i}") for i in k], *[b.alias(f"_b{i}") for i, b in enumerate(beta)])
    w = Window.partitionBy(by)
    x = test.select(by, "ts", F.col(label).alias("_y"), *[F.col(a).alias(f"_x{i}") for i, a in enumerate(features)]).withColumns({"_i": F.row_number().over(w.orderBy("ts")) - 1, "_n": F.count(F.lit(1)).over(w)})
    other = x.select(by, F.col("_i").alias("_j"), *[F.col(f"_x{i}").alias(f"_o{i}") for i in k])
    x = x.withColumn("_j", ((F.col("_i").cast("bigint") * 7919 + 13) % F.col("_n")).cast("int")).join(other, [by, "_j"]).join(m, by)
    base = F.col("_y") - F.col("_my")
    for i in k:
        base = base - F.col(f"_b{i}") * (F.col(f"_x{i}") - F.col(f"_m{i}"))
    x = x.withColumn("_e", base)
    e = [F.col("_e") - F.col(f"_b{i}") * (F.col(f"_o{i}") - F.col(f"_x{i}")) for i in k]
    each = F.array(*[F.struct(F.lit(a).alias("feature"), (F.covar_pop(f"_x{i}", "_y") ** 2 / F.nullif(F.var_pop(f"_x{i}") * F.var_pop("_y"), F.lit(0.0))).alias("single"), (F.avg(e[i] ** 2) - F.avg(F.col("_e") ** 2)).alias("permuted")) for i, a in enumerate(features)])
    return x.groupBy(by).agg(each.alias("_a")).select(by, F.explode("_a").alias("_a")).select(by, "_a.*")


def combinations(spark, n: int, k: int) -> DataFrame:
    """combo, member: all choices of k of n (up to 30), numbered in lexicographic order, a row a member."""
    masks = spark.range(1 << n).where(F.bit_count("id") == k)
    x = masks.withColumn("combo", F.row_number().over(Window.orderBy(F.desc("id"))) - 1)
    bit = lambda b: F.expr(f"shiftright(id, {n - 1} - {b}) & 1") == 1
    return x.select("combo", F.explode(F.array_compact(F.array(*[F.when(bit(b), F.lit(b)) for b in range(n)]))).alias("member"))


def tensors(rows: DataFrame, levels: Sequence[str], length: int, order: Sequence[str] = ("ts",), by: str = "symbol") -> DataFrame:
    """Adds tensor: the levels of the last length rows, an array of arrays, oldest first; rows without so many before them are left out."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-(length - 1), 0)
    return rows.withColumn("tensor", F.collect_list(F.array(*levels)).over(w)).where(F.size("tensor") == length)


def expanding_frac_diff(c: str, d: float, threshold: float) -> Column:
    """Fractional difference of all rows so far, with weights down to threshold in size; first rows use what is there."""
    weights = [1.0]
    while abs(new := -weights[-1] * (d - len(weights) + 1) / len(weights)) >= threshold:
        weights.append(new)
    out = F.lit(0.0)
    for k, x in enumerate(weights):
        out = out + x * F.coalesce(F.lag(c, k).over(ft.series()), F.lit(0.0))
    return out
