"""Statistics of closed trades, orders and fills."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.operators.quantiles import quantiles, running_counts
from lodestream.session import settle


def trade_metrics(trades: DataFrame, by: Sequence[str], ret: str = "ret") -> DataFrame:
    """n, win_rate, avg, total and median result, profit factor, Sharpe (mean / sample deviation) of each group."""
    r = F.col(ret)
    up, down = F.sum(F.when(r > 0, r).otherwise(0.0)), -F.sum(F.when(r < 0, r).otherwise(0.0))
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("avg_ret"), F.sum(r).alias("total"), F.percentile(r, F.lit(0.5)).alias("median_ret"),
        F.when(down > 0, up / down).alias("profit_factor"), (F.avg(r) / F.nullif(F.stddev_samp(r), F.lit(0.0))).alias("sharpe"),
    )


def duration_bucket(start: Column, end: Column) -> Column:
    d = (F.unix_seconds(end) - F.unix_seconds(start)) / 86400
    return F.when(d <= 7, "week").when(d <= 30, "month").when(d <= 90, "quarter").otherwise("longer")


def loss_segments(trades: DataFrame, dims: Sequence[str], ret: str = "ret") -> DataFrame:
    """Losing trades by each dimension for itself, with the share of all losses: (dim, value, n, loss, share)."""
    lost = trades.where(F.col(ret) < 0)
    long = lost.select(ret, F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])).alias("s"))
    x = long.groupBy("s.dim", "s.value").agg(F.count(F.lit(1)).alias("n"), F.sum(ret).alias("loss"))
    return x.withColumn("share", F.col("loss") / F.sum("loss").over(Window.partitionBy("dim")))


def streaks(trades: DataFrame, by: Sequence[str], order: Sequence[str], ret: str = "ret", span_days: int = 30) -> DataFrame:
    """Longest stretches of losing and of winning trades.

    Stretches are cut at time spans of order's first column, so no task holds a series; what may go on over a cut are the first and
    the last stretch of a span, and these are joined over spans.
    """
    won = F.when(F.col(ret) > 0, 1).when(F.col(ret) < 0, -1).otherwise(0)
    x = trades.select(*by, *order, won.alias("_s"), F.floor(F.unix_seconds(order[0]) / (span_days * 86400)).alias("_t"))
    w = Window.partitionBy(*by, "_t").orderBy(*order)
    turn = F.when(F.col("_s") == F.lag("_s").over(w), 0).otherwise(1)
    x = x.withColumn("_turn", turn).withColumn("_g", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cut = x.groupBy(*by, "_t", "_g").agg(F.first("_s").alias("_s"), F.count(F.lit(1)).alias("n"))
    run = F.struct("_g", "_s", "n")
    longest = lambda s: F.max(F.when(F.col("_s") == s, F.col("n")))
    spans = cut.groupBy(*by, "_t").agg(F.min(run).alias("_first"), F.max(run).alias("_last"), longest(-1).alias("_down"), longest(1).alias("_up"))
    # over spans: two stretches each at most
    ends = F.when(F.col("_first._g") == F.col("_last._g"), F.array("_first")).otherwise(F.array("_first", "_last"))
    over = Window.partitionBy(*by).orderBy("_t", "_r._g")
    e = spans.select(*by, "_t", "_down", "_up", F.explode(ends).alias("_r"))
    goes_on = (F.col("_r._s") == F.lag("_r._s").over(over)) & (F.col("_r._g") == 1)
    e = e.withColumn("_turn", F.when(goes_on, 0).otherwise(1)).withColumn("_h", F.sum("_turn").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    whole = e.groupBy(*by, "_h").agg(F.first("_r._s").alias("_s"), F.sum("_r.n").alias("n"), F.max("_down").alias("_down"), F.max("_up").alias("_up"))
    either = lambda s, own: F.greatest(F.max(F.when(F.col("_s") == s, F.col("n"))), F.max(own), F.lit(0))
    return whole.groupBy(*by).agg(either(-1, "_down").alias("losing"), either(1, "_up").alias("winning"))


def fifo(fills: DataFrame, order: Sequence[str], by: str = "symbol", span: str = "30 days") -> DataFrame:
    """Each sale with the quantity and cost of the lots it takes, first in first out; what no lot covers has no cost.

    Buys and sales are spans of one running quantity. Where sales run ahead of buys, the uncovered part is skipped, so spans of
    later sales start at what was bought. Matching spans is an overlap join on the quantity axis, no loop.
    Running quantities are two-level, inside time spans of order's first column and over spans, so no task holds a series.
    """
    buy = F.col("side") == "buy"
    x = fills.withColumns({"_t": F.window(order[0], span)["start"], "_v": F.when(buy, F.col("qty")).otherwise(0.0), "_u": F.when(buy, 0.0).otherwise(F.col("qty"))})
    # inside a time span: running buys, sales, rows, and how far sales have run ahead
    inside = Window.partitionBy(by, "_t").orderBy(*order)
    upto, earlier = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({"_b": F.sum("_v").over(upto), "_s": F.sum("_u").over(upto), "_n": F.row_number().over(inside)}).withColumn("_d", F.when(~buy, F.col("_b") - F.col("_s")))
    x = x.withColumns({"_m": F.min("_d").over(upto), "_l": F.min("_d").over(earlier)})
    # over spans: one row each
    spans = x.groupBy(by, "_t").agg(F.sum("_v").alias("sb"), F.sum("_u").alias("ss"), F.count(F.lit(1)).alias("sn"), F.min("_d").alias("sm"))
    before = Window.partitionBy(by).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({f"_p{c}": F.coalesce(F.sum(f"s{c}").over(before), F.lit(0)) for c in "bsn"})
    spans = spans.withColumn("_pm", F.min(F.col("sm") + F.col("_pb") - F.col("_ps")).over(before)).select(by, "_t", "_pb", "_ps", "_pn", "_pm")
    x = x.join(spans, [by, "_t"])
    ahead = lambda own: F.least(F.lit(0.0), F.col(own) + F.col("_pb") - F.col("_ps"), F.col("_pm"))  # noqa: E731  NULLs are passed over
    x = x.withColumns({"_n": (F.col("_n") + F.col("_pn")).cast("int"), "_b": F.col("_b") + F.col("_pb"), "_s": F.col("_s") + F.col("_ps"), "_m": ahead("_m"), "_l": ahead("_l")})
    # read four times below: lots, their mean, sales, and sales without lots
    x = settle(x.select(by, "_n", "side", "qty", "price", "_b", "_s", "_m", "_l"), "fifo")
    # cells of the quantity axis are as long as the series' mean lot
    size = x.where(buy & (F.col("qty") > 0)).groupBy(F.col(by).alias("_k_by")).agg(F.avg("qty").alias("_size"))
    lots = x.where(buy).join(size, F.col(by) == F.col("_k_by")).select(by, "_size", F.col("price").alias("lot_price"), (F.col("_b") - F.col("qty")).alias("lo"), F.col("_b").alias("hi"))
    sales = x.where(~buy).select(by, "_n", "qty", "price", (F.col("_s") - F.col("qty") + F.col("_l")).alias("a"), (F.col("_s") + F.col("_m")).alias("z"))
    grid = lambda lo, hi: F.explode(F.sequence(F.floor(lo / F.col("_size")), F.floor(hi / F.col("_size"))))
    s = sales.where("z > a").join(size, F.col(by) == F.col("_k_by")).drop("_k_by").withColumn("_k", grid(F.col("a"), F.col("z")))
    lot = lots.withColumn("_k", grid(F.col("lo"), F.col("hi"))).drop("_size").withColumnRenamed(by, "_by")
    # a pair that shares several cells counts in the cell where its overlap starts
    hit = s.join(lot, (F.col(by) == F.col("_by")) & (s._k == lot._k) & (F.col("lo") < F.col("z")) & (F.col("a") < F.col("hi")) & (s._k == F.floor(F.greatest("lo", "a") / F.col("_size"))))
    part = F.least("hi", "z") - F.greatest("lo", "a")
    cost = hit.groupBy(by, "_n").agg(F.sum(part).alias("matched"), F.sum(part * F.col("lot_price")).alias("cost"))
    out = sales.join(cost, [by, "_n"], "left").fillna(0.0, ["matched", "cost"])
    return out.select(by, F.col("_n").alias("n"), "qty", "matched", "cost", (F.col("qty") * F.col("price") - F.col("cost")).alias("pnl"))


def transitions(labels: DataFrame, label: str, by: str = "symbol") -> DataFrame:
    """Share of each next label after each label: (from_label, to_label, n, share)."""
    x = labels.withColumn("to_label", F.lead(label).over(Window.partitionBy(by).orderBy("ts"))).where(F.col("to_label").isNotNull() & F.col(label).isNotNull())
    x = x.groupBy(F.col(label).alias("from_label"), "to_label").agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from_label")))


def nearest_ranks(rows: DataFrame, by: str, c: str, shares: Mapping[str, float]) -> DataFrame:
    """by and, for each name: share, the element at round(share * (n - 1)) of the group's sorted values of c; NULL values are left out.

    Equal values are counted by partial sums, then counts run in two levels: one sum a range of sorted values, then inside the
    range. No group is ever in one task; what is brought together is one row a group and range.
    """
    x = running_counts(rows, [by], c)
    rank = lambda q: F.round(q * (F.col("_all") - 1)) + 1
    return x.groupBy(by).agg(*[F.min(F.when(F.col("_upto") >= rank(q), F.col(c))).alias(k) for k, q in shares.items()])


def shadow_pnl(traced: DataFrame, horizon: int) -> DataFrame:
    """Per filter that blocked a raw entry: how often, and what the entry would have earned over the next bars."""
    x = traced.withColumn("_s", F.col("raw") * (F.lead("close", horizon).over(Window.partitionBy("symbol").orderBy("ts")) / F.col("close") - 1))
    x = x.where("raw <> 0").select("_s", F.explode("blocked_by").alias("filter"))
    return x.groupBy("filter").agg(F.count(F.lit(1)).alias("n"), F.count("_s").alias("known"), F.avg("_s").alias("mean"), F.avg(F.when(F.col("_s") > 0, 1.0).otherwise(0.0)).alias("positive"), F.sum("_s").alias("total"))


def with_without_filters(traced: DataFrame, horizon: int, size: float) -> DataFrame:
    """Equity of the position as held, and with each blocked entry's return over the horizon added in even parts to its bars."""
    w = Window.partitionBy("symbol").orderBy("ts")
    x = traced.withColumns({"_i": F.row_number().over(w), "_fwd": F.lead("close", horizon).over(w) / F.col("close") - 1})
    x = x.withColumn("_ret", F.coalesce(F.lag("sig").over(w), F.lit(0.0)) * size * F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)))
    lost = x.where((F.col("raw") != 0) & (F.size("blocked_by") > 0) & F.col("_fwd").isNotNull())
    lost = lost.select("symbol", F.explode(F.sequence(F.col("_i") + 1, F.col("_i") + horizon)).alias("_i"), (F.col("raw") * size * F.col("_fwd") / horizon).alias("_e"))
    x = x.join(lost.groupBy("symbol", "_i").agg(F.sum("_e").alias("_e")), ["symbol", "_i"], "left")
    more = F.greatest(F.col("_ret") + F.coalesce("_e", F.lit(0.0)), F.lit(-0.99))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return x.select("symbol", "ts", F.exp(F.sum(F.log1p("_ret")).over(run)).alias("with_filters"), F.exp(F.sum(F.log1p(more)).over(run)).alias("without_filters"))


def normalised(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """Fills with their order's status (unknown without one), filled quantity and reference price."""
    o = orders.select(F.col("order_id").alias("l_orderkey"), "status", F.col("price").alias("_op"))
    x = fills.join(o, "l_orderkey", "left")
    return x.withColumns({"filled": F.when(F.col("status") == "filled", F.col("qty")).otherwise(0.0), "ref_price": F.coalesce("_op", "price"), "status": F.coalesce("status", F.lit("unknown"))}).drop("_op")


def compared(rows: DataFrame, columns: Mapping[str, Column], bars_a_year: float) -> DataFrame:
    """n, mean, Sharpe and win rate of several return columns, one row each."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), c.alias("r")) for k, c in columns.items()])).alias("_x")).select("_x.*")
    return long.groupBy("strategy").agg(F.count("r").alias("n"), (F.avg("r") * 1e4).alias("mean_bps"), (F.avg("r") / F.nullif(F.stddev_pop("r"), F.lit(0.0)) * F.sqrt(F.lit(float(bars_a_year)))).alias("sharpe"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"))


def fill_stats(orders: DataFrame, by: Sequence[str]) -> DataFrame:
    """Orders by status, and the share filled of those that were filled or not."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return orders.groupBy(*by).agg(n("filled").alias("filled"), n("unfilled").alias("unfilled"), n("cancelled").alias("cancelled"), (n("filled") / F.nullif(n("filled", "unfilled"), F.lit(0))).alias("fill_rate"))


def slippage(records: DataFrame, kind: str = "kind", bps: str = "bps") -> DataFrame:
    """n and median of all records and of each kind."""
    every = records.withColumn(kind, F.explode(F.array(F.lit("all"), F.col(kind))))
    n = every.groupBy(F.col(kind).alias("_kind")).agg(F.count(F.lit(1)).alias("n"))
    middle = quantiles(every.select(kind, bps), [kind], bps, {"median_bps": 0.5}).drop("n")
    return n.join(middle, F.col("_kind").eqNullSafe(F.col(kind)), "left").select(F.col("_kind").alias(kind), "n", "median_bps")


def chase_costs(events: DataFrame, budget: float, by: str = "symbol") -> DataFrame:
    """n, upper median of the extra cost and whether it breaks the budget, from counts by value."""
    counts = events.groupBy(by, "extra").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(by)
    upto = F.sum("_c").over(w.orderBy("extra"))
    x = counts.withColumns({"_u": upto, "n": F.sum("_c").over(w)}).where(F.col("_u") >= F.floor(F.col("n") / 2) + 1)
    return x.groupBy(by).agg(F.max("n").alias("n"), F.min("extra").alias("upper_median")).withColumn("breach", F.col("upper_median") > budget)
