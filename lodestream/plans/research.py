"""Queries on trades, statistics, signals, labels, accounting, quality and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream import views as v
from lodestream.functions import numbers as n
from lodestream.operators import accounting as ac
from lodestream.operators import features as ft
from lodestream.operators import labels, quality, signals, states, stats, trades
from lodestream.plans.market import BK, TS, VOLS, B, C, FL, FU, LEGS, O, T, _r, legs
from lodestream.plans.registry import query
from lodestream.session import shared_dir, tune
from lodestream.streaming import streams

METRICS = """count(*) AS n, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(avg(ret), 6) AS avg_ret, round(sum(ret), 6) AS total, round(quantile_cont(ret, 0.5), 6) AS median_ret,
    round(CASE WHEN -sum(CASE WHEN ret < 0 THEN ret ELSE 0 END) > 0 THEN sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / -sum(CASE WHEN ret < 0 THEN ret ELSE 0 END) END, 6) AS profit_factor, round(avg(ret) / nullif(stddev_samp(ret), 0), 6) AS sharpe"""
TIE = "entry_ts, exit_ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
ORDER = TIE.split(", ")


@query("s2_1_filter", f"WITH {O} SELECT order_id, round(price, 6) AS price, status FROM order_log WHERE status IN ('filled', 'unfilled') AND price > 200000 AND contains(lower(priority || ' ' || status), 'high')")
def _(spark, d):
    text = F.lower(F.concat_ws(" ", "priority", "status"))
    return v.order_log(spark, d).where(F.col("status").isin("filled", "unfilled") & (F.col("price") > 200000) & text.contains("high")).select("order_id", "price", "status")


@query("s2_4_session_slice", f"WITH {T} SELECT symbol, count(*) AS n, round(sum(amount), 6) AS amount FROM ticks WHERE (hour(ts) >= 22 OR hour(ts) < 4) AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY 1")
def _(spark, d):
    t = v.ticks(spark, d).where(n.session_hours(F.col("ts"), 22, 4) & F.col("ts").between("2024-01-05", "2024-01-20"))
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query("s2_9_verdicts", f"""WITH {C}, m AS (SELECT l_suppkey AS cell, count(*) AS n, avg(ret) / nullif(stddev_samp(ret), 0) AS sharpe, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS win FROM closed GROUP BY 1),
    r AS (SELECT *, concat_ws('; ', CASE WHEN n < 300 THEN 'too few trades' END, CASE WHEN sharpe < 0.25 THEN 'sharpe' END, CASE WHEN win < 0.55 THEN 'win rate' END) AS reasons FROM m)
    SELECT cell, n, reasons, CASE WHEN reasons = '' THEN 'pass' WHEN n < 300 THEN 'exploratory' ELSE 'fail' END AS verdict FROM r""")
def _(spark, d):
    m = v.closed_trades(spark, d).groupBy(F.col("l_suppkey").alias("cell")).agg(F.count(F.lit(1)).alias("n"), (F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0))).alias("sharpe"), F.avg((F.col("ret") > 0).cast("double")).alias("win"))
    why = F.array_join(F.array_compact(F.array(F.when(F.col("n") < 300, "too few trades"), F.when(F.col("sharpe") < 0.25, "sharpe"), F.when(F.col("win") < 0.55, "win rate"))), "; ")
    return m.select("cell", "n", why.alias("reasons")).withColumn("verdict", F.when(F.col("reasons") == "", "pass").when(F.col("n") < 300, "exploratory").otherwise("fail"))


@query("s2_19_rule_resolution", f"""WITH {O}, r(status, priority, size, rank) AS (VALUES ('filled', '1-URGENT', 1.0, 2), ('filled', NULL, 0.5, 1), (NULL, NULL, 0.1, 0)),
    x AS (SELECT order_id, size, row_number() OVER (PARTITION BY order_id ORDER BY rank DESC) AS k FROM order_log o JOIN r ON (r.status IS NULL OR r.status = o.status) AND (r.priority IS NULL OR r.priority = o.priority))
    SELECT order_id, CAST(size AS DOUBLE) AS size FROM x WHERE k = 1""")
def _(spark, d):
    rules = tune(spark).createDataFrame([("filled", "1-URGENT", 1.0), ("filled", None, 0.5), (None, None, 0.1)], "r_status string, r_priority string, size double")
    ok = (F.col("r_status").isNull() | (F.col("r_status") == F.col("status"))) & (F.col("r_priority").isNull() | (F.col("r_priority") == F.col("priority")))
    x = v.order_log(spark, d).join(F.broadcast(rules), ok)  # three rules
    rank = F.col("r_status").isNotNull().cast("int") + F.col("r_priority").isNotNull().cast("int")
    return x.groupBy("order_id").agg(F.max_by("size", rank).alias("size"))


@query("s5_1_by_hour", f"WITH {T}, x AS (SELECT hour(ts) AS h, price - 20 AS ret FROM ticks) SELECT h AS hour, {METRICS} FROM x GROUP BY h")
def _(spark, d):
    return trades.trade_metrics(v.ticks(spark, d).select(F.hour("ts").cast("bigint").alias("hour"), (F.col("price") - 20).alias("ret")), ["hour"])


@query("s5_2_by_weekday", f"""WITH {C}, w AS (SELECT CAST(isodow(entry_ts) - 1 AS INTEGER) AS weekday, ret FROM closed), d AS (SELECT CAST(unnest(range(7)) AS INTEGER) AS weekday)
    SELECT weekday, count(ret) AS n, round(avg(ret), 6) AS avg_ret FROM d LEFT JOIN w USING (weekday) GROUP BY 1""")
def _(spark, d):
    x = v.closed_trades(spark, d).groupBy(F.weekday("entry_ts").alias("weekday")).agg(F.count("ret").alias("n"), F.avg("ret").alias("avg_ret"))
    return tune(spark).range(7).select(F.col("id").cast("int").alias("weekday")).join(x, "weekday", "left").fillna(0, ["n"])


@query("s5_3_fill_rate", f"WITH {O} SELECT month(ts) AS month, count(*) AS n, round(avg(CASE WHEN status = 'filled' THEN 1.0 ELSE 0 END), 6) AS fill_rate, count(*) FILTER (WHERE status = 'cancelled') AS cancelled FROM order_log GROUP BY 1")
def _(spark, d):
    return v.order_log(spark, d).groupBy(F.month("ts").cast("bigint").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("status") == "filled").cast("double")).alias("fill_rate"), F.count_if(F.col("status") == "cancelled").alias("cancelled"))


@query("s5_4_by_label", f"WITH {C} SELECT symbol, exit_reason, {METRICS} FROM closed GROUP BY 1, 2")
def _(spark, d):
    return trades.trade_metrics(v.closed_trades(spark, d), ["symbol", "exit_reason"])


@query("s5_6_weekday_hour_matrix", f"""WITH {T}, x AS (SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday, hour(ts) AS h, avg(CASE WHEN price > 20 THEN 1.0 ELSE 0 END) AS win, count(*) AS n FROM ticks GROUP BY 1, 2)
    SELECT weekday, {', '.join(f"round(max(CASE WHEN h = {h} AND n >= 3 THEN win END), 6) AS h{h}" for h in range(24))} FROM x GROUP BY 1""")
def _(spark, d):
    x = v.ticks(spark, d).withColumn("h", F.concat(F.lit("h"), F.hour("ts")))
    return x.groupBy(F.weekday("ts").alias("weekday")).pivot("h", [f"h{h}" for h in range(24)]).agg(F.when(F.count(F.lit(1)) >= 3, F.avg((F.col("price") > 20).cast("double"))))


@query("s5_7_cohorts", f"WITH {C} SELECT CAST(epoch(date_trunc('month', entry_ts)) AS BIGINT) AS month, count(*) AS n, round(avg(ret), 6) AS avg_ret, round(sum(ret), 6) AS total, round(avg(ret) / nullif(stddev_pop(ret), 0), 6) AS sharpe FROM closed GROUP BY 1")
def _(spark, d):
    return v.closed_trades(spark, d).groupBy(F.date_trunc("month", "entry_ts").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("avg_ret"), F.sum("ret").alias("total"), (F.avg("ret") / F.nullif(F.stddev_pop("ret"), F.lit(0.0))).alias("sharpe"))


@query("s5_8_cohort_decay", f"""WITH {C}, m AS (SELECT symbol, date_trunc('month', entry_ts) AS m, avg(ret) AS r FROM closed GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY m) AS i FROM m)
    SELECT symbol, round(regr_slope(r, i) * 1000, 6) AS slope, round(corr(r, i), 6) AS r FROM k GROUP BY 1""")
def _(spark, d):
    m = v.closed_trades(spark, d).groupBy("symbol", F.date_trunc("month", "entry_ts").alias("m")).agg(F.avg("ret").alias("r")).withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("m")))
    return m.groupBy("symbol").agg((F.regr_slope("r", "i") * 1000).alias("slope"), F.corr("r", "i").alias("_c")).withColumnRenamed("_c", "r")


DUR = "CASE WHEN (epoch(exit_ts) - epoch(entry_ts)) / 86400 <= 7 THEN 'week' WHEN (epoch(exit_ts) - epoch(entry_ts)) / 86400 <= 30 THEN 'month' WHEN (epoch(exit_ts) - epoch(entry_ts)) / 86400 <= 90 THEN 'quarter' ELSE 'longer' END"


@query("s5_9_loss_forensics", f"""WITH {C}, l AS (SELECT *, {DUR} AS duration FROM closed WHERE ret < 0), u AS (SELECT 'duration' AS dim, duration AS value, ret FROM l UNION ALL SELECT 'exit_reason', exit_reason, ret FROM l UNION ALL SELECT 'symbol', symbol, ret FROM l),
    g AS (SELECT dim, value, count(*) AS n, sum(ret) AS loss FROM u GROUP BY 1, 2) SELECT dim, value, n, round(loss, 6) AS loss, round(loss / sum(loss) OVER (PARTITION BY dim), 6) AS share FROM g""")
def _(spark, d):
    x = v.closed_trades(spark, d).withColumn("duration", trades.duration_bucket(F.col("entry_ts"), F.col("exit_ts")))
    return trades.loss_segments(x, ["duration", "exit_reason", "symbol"])


@query("s5_10_streaks", f"""WITH {C}, x AS (SELECT symbol, CAST(sign(ret) AS INTEGER) AS s, row_number() OVER (PARTITION BY symbol ORDER BY {TIE}) - row_number() OVER (PARTITION BY symbol, CAST(sign(ret) AS INTEGER) ORDER BY {TIE}) AS g FROM closed),
    r AS (SELECT symbol, s, count(*) AS n FROM x GROUP BY symbol, s, g) SELECT symbol, coalesce(max(n) FILTER (WHERE s = -1), 0) AS losing, coalesce(max(n) FILTER (WHERE s = 1), 0) AS winning FROM r GROUP BY 1""")
def _(spark, d):
    return trades.streaks(v.closed_trades(spark, d), ["symbol"], ORDER)


@query("s5_13_filter_attribution", f"""WITH {B}, x AS (SELECT *, close > open AS up FROM bars), b AS (SELECT symbol, unnest([CASE WHEN volume < 60 THEN 'thin' END, CASE WHEN high / low > 20 THEN 'wide' END, CASE WHEN NOT up THEN 'down' END]) AS filter FROM x)
    SELECT symbol, filter, count(*) AS n FROM b WHERE filter IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    x = v.bars(spark, d).withColumn("raw", F.lit(1.0))
    x = signals.trace(x, {"thin": F.col("volume") < 60, "wide": F.col("high") / F.col("low") > 20, "down": ~(F.col("close") > F.col("open"))})
    return x.select("symbol", F.explode("blocked_by").alias("filter")).groupBy("symbol", "filter").agg(F.count(F.lit(1)).alias("n"))


@query("s5_24_transitions", f"""WITH {B}, x AS (SELECT symbol, ts, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'flat' END AS l FROM bars), y AS (SELECT l AS from_label, lead(l) OVER (PARTITION BY symbol ORDER BY ts) AS to_label FROM x),
    g AS (SELECT from_label, to_label, count(*) AS n FROM y WHERE to_label IS NOT NULL GROUP BY 1, 2) SELECT from_label, to_label, n, round(n / sum(n) OVER (PARTITION BY from_label), 6) AS share FROM g""")
def _(spark, d):
    x = v.bars(spark, d).withColumn("l", F.when(F.col("close") > F.col("open"), "up").when(F.col("close") < F.col("open"), "down").otherwise("flat"))
    return trades.transitions(x, "l")


@query("s5_28_latest", f"WITH {O} SELECT account, max(order_id) AS order_id, arg_max(status, order_id) AS status FROM order_log GROUP BY 1")
def _(spark, d):
    return v.order_log(spark, d).groupBy("account").agg(F.max("order_id").alias("order_id"), F.max_by("status", "order_id").alias("status"))


@query("s5_30_shortfall", f"""WITH {FL}, p AS (SELECT p_partkey, p_retailprice AS mid FROM part), x AS (SELECT side, CASE side WHEN 'buy' THEN price - mid ELSE mid - price END / mid * 1e4 AS bps FROM fills JOIN p ON l_partkey = p_partkey),
    s AS (SELECT side, list_sort(list(bps)) AS l, count(*) AS n, avg(bps) AS mean FROM x GROUP BY 1)
    SELECT side, n, round(mean, 4) AS mean_bps, round(l[CAST(round(0.5 * (n - 1)) AS BIGINT) + 1], 4) AS p50, round(l[CAST(round(0.9 * (n - 1)) AS BIGINT) + 1], 4) AS p90 FROM s""")
def _(spark, d):
    from lodestream.session import table

    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("mid"))
    x = v.fills(spark, d).join(p, "l_partkey").withColumn("bps", n.shortfall_bps(F.col("side"), F.col("price"), F.col("mid")))
    ranks = trades.nearest_ranks(x, "side", "bps", {"p50": 0.5, "p90": 0.9})
    return x.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("bps"), 4).alias("mean_bps")).join(ranks, "side", "left").select("side", "n", "mean_bps", F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"))


FT = "ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, qty, l_extendedprice"


@query("s5_34_fifo", f"""WITH {FL}, x AS (SELECT *, row_number() OVER w AS n, sum(CASE side WHEN 'buy' THEN qty ELSE 0 END) OVER w AS b, sum(CASE side WHEN 'buy' THEN 0 ELSE qty END) OVER w AS s FROM fills WINDOW w AS (PARTITION BY symbol ORDER BY {FT} ROWS UNBOUNDED PRECEDING)),
    y AS (SELECT *, s + least(0, coalesce(min(CASE side WHEN 'sell' THEN b - s END) OVER (PARTITION BY symbol ORDER BY n), 0)) AS c FROM x), z AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY symbol ORDER BY n), 0) AS p FROM y),
    m AS (SELECT z.symbol, z.n, sum(least(l.b, z.c) - greatest(l.b - l.qty, z.p)) AS matched, sum((least(l.b, z.c) - greatest(l.b - l.qty, z.p)) * l.price) AS cost FROM z JOIN z l ON l.symbol = z.symbol AND l.side = 'buy' AND l.b - l.qty < z.c AND l.b > z.p WHERE z.side = 'sell' GROUP BY 1, 2)
    SELECT z.symbol, CAST(z.n AS INTEGER) AS n, z.qty, coalesce(matched, 0) AS matched, round(coalesce(cost, 0) + 1e-7, 4) AS cost, round(z.qty * z.price - coalesce(cost, 0) + 1e-7, 4) AS pnl FROM z LEFT JOIN m USING (symbol, n) WHERE z.side = 'sell'""")
def _(spark, d):
    x = trades.fifo(v.fills(spark, d), FT.split(", "))
    return x.withColumn("cost", F.round(F.col("cost") + 1e-7, 4)).withColumn("pnl", F.round(F.col("pnl") + 1e-7, 4))


def _lift_sql(q: int) -> str:
    edges = "[" + ", ".join(f"{i / q}" for i in range(q + 1)) + "]"
    return f"""WITH {B}, x AS (SELECT symbol, ts, volume AS f, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS r FROM bars), y AS (SELECT * FROM x WHERE r IS NOT NULL),
    e AS (SELECT list_distinct(quantile_cont(f, {edges})) AS e0 FROM y), s AS (SELECT list_sort(e0) AS e FROM e), b AS (SELECT r, CAST(len(list_filter(e[2:len(e) - 1], lambda z: z < f)) AS INTEGER) AS bin FROM y, s),
    g AS (SELECT bin, count(*) AS n, avg(r) AS mean, sum(r) AS s FROM b GROUP BY 1)
    SELECT bin, n, round(mean, 6) AS mean, round(mean - sum(s) OVER () / sum(n) OVER (), 6) AS lift, round(sum(s) OVER (ORDER BY bin) / sum(s) OVER (), 6) AS cum_share FROM g"""


@query("s8_3_decile_lift", _lift_sql(10))
def _(spark, d):
    x = v.bars(spark, d).withColumn("r", F.lead("close").over(ft.series()) / F.col("close") - 1).where("r is not null")
    return stats.lift(x, "volume", "r", 10)


@query("s8_2_value_study", f"""WITH {B}, x AS (SELECT CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END AS sig, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS r FROM bars)
    SELECT sig, count(r) AS n, round(avg(r), 6) AS mean, round(var_samp(r), 4) AS var FROM x GROUP BY 1 HAVING count(r) >= 20""")
def _(spark, d):
    x = v.bars(spark, d).select(F.when(F.col("close") > F.col("open"), 1).when(F.col("close") < F.col("open"), -1).otherwise(0).alias("sig"), (F.lead("close").over(ft.series()) / F.col("close") - 1).alias("r"))
    return stats.value_study(x, "sig", "r").withColumn("var", F.round("var", 4))


@query("s8_5_tearsheet", f"""WITH {B}, h AS (SELECT volume AS f, unnest([{{'h': 1, 'r': lead(close, 1) OVER w / close - 1}}, {{'h': 6, 'r': lead(close, 6) OVER w / close - 1}}, {{'h': 24, 'r': lead(close, 24) OVER w / close - 1}}]) AS s FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    x AS (SELECT f, s.h AS horizon, s.r AS r FROM h WHERE s.r IS NOT NULL), k AS (SELECT *, rank() OVER (PARTITION BY horizon ORDER BY f) + (count(*) OVER (PARTITION BY horizon, f) - 1) / 2 AS rf, rank() OVER (PARTITION BY horizon ORDER BY r) + (count(*) OVER (PARTITION BY horizon, r) - 1) / 2 AS rr FROM x)
    SELECT horizon, count(*) AS n, round(corr(f, r), 6) AS ic, round(corr(rf, rr), 6) AS rank_ic, round(corr(f, r) * sqrt((count(*) - 2) / (1 - corr(f, r) ** 2)), 6) AS t FROM k GROUP BY 1""")
def _(spark, d):
    return stats.information_coefficients(v.bars(spark, d), "volume", (1, 6, 24))


@query("s8_9_moments", f"WITH {B}, x AS (SELECT symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM bars) SELECT symbol, round(skewness(r), 6) AS skew, round(kurtosis(r), 6) AS kurt FROM x GROUP BY 1")
def _(spark, d):
    skew, kurt = stats.corrected_moments("r")
    return v.bars(spark, d).withColumn("r", ft.log_ret("close")).groupBy("symbol").agg(skew.alias("skew"), kurt.alias("kurt"))


@query("s8_14_survival", f"""WITH {C}, x AS (SELECT symbol, CAST(date_diff('day', entry_ts, exit_ts) AS INTEGER) AS t, exit_reason = 'F' AS e FROM closed), g AS (SELECT symbol, t, count(*) AS n, sum(CAST(e AS INTEGER)) AS events FROM x GROUP BY 1, 2),
    r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY symbol ORDER BY t DESC) AS BIGINT) AS at_risk FROM g), s AS (SELECT *, CASE WHEN max(CASE WHEN events = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w) END AS survival FROM r WINDOW w AS (PARTITION BY symbol ORDER BY t))
    SELECT symbol, t, CAST(events AS BIGINT) AS events, at_risk, round(survival, 6) AS survival FROM s""")
def _(spark, d):
    x = v.closed_trades(spark, d).withColumn("t", F.date_diff("exit_ts", "entry_ts"))
    return stats.kaplan_meier(x, "t", F.col("exit_reason") == "F", ["symbol"])


@query("s8_18_tail_dependence", f"""WITH {B}, x AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars), y AS (SELECT * FROM x WHERE r IS NOT NULL),
    u AS (SELECT symbol, ts, (rank() OVER (PARTITION BY symbol ORDER BY r) + (count(*) OVER (PARTITION BY symbol, r) - 1) / 2) / (count(*) OVER (PARTITION BY symbol) + 1) AS u FROM y)
    SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, sum(CASE WHEN a.u <= 0.1 AND b.u <= 0.1 THEN 1 ELSE 0 END)::BIGINT AS "both", round(sum(CASE WHEN a.u <= 0.1 AND b.u <= 0.1 THEN 1 ELSE 0 END) / (0.1 * count(*)), 6) AS lambda FROM u a JOIN u b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1, 2""".replace(" AS lambda", ' AS "lambda"'))
def _(spark, d):
    return stats.tail_dependence(v.bars(spark, d).withColumn("r", ft.ret("close")), "r", 0.1)


@query("s8_19_var_cvar", f"""WITH {B}, x AS (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars), q AS (SELECT symbol, quantile_cont(r, 0.05) AS v FROM x GROUP BY 1)
    SELECT symbol, round(v, 6) AS var, round(avg(r), 6) AS cvar FROM x JOIN q USING (symbol) WHERE r <= v GROUP BY symbol, v""")
def _(spark, d):
    return stats.var_cvar(v.bars(spark, d).withColumn("r", ft.ret("close")), "r", 0.05, ["symbol"])


@query("s8_20_adf", f"""WITH {B}, a AS (SELECT symbol, ts, lag(close) OVER w AS l, close - lag(close) OVER w AS d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), b AS (SELECT *, lag(d) OVER (PARTITION BY symbol ORDER BY ts) AS k FROM a),
    m AS (SELECT symbol, count(*) AS n, var_pop(l) AS s0, covar_pop(l, k) AS s1, var_pop(k) AS s2, covar_pop(l, d) AS s3, covar_pop(k, d) AS s4, var_pop(d) AS s5 FROM b WHERE k IS NOT NULL GROUP BY 1),
    c AS (SELECT *, (s3 * s2 - s4 * s1) / (s0 * s2 - s1 * s1) AS bb, (s0 * s4 - s1 * s3) / (s0 * s2 - s1 * s1) AS g FROM m)
    SELECT symbol, n, round(bb, 6) AS level, round(bb / sqrt(n * (s5 - bb * s3 - g * s4) / (n - 3) * s2 / (s0 * s2 - s1 * s1) / n), 6) AS t FROM c""")
def _(spark, d):
    return stats.adf(v.bars(spark, d), "close")


@query("s8_22_newey_west", f"""WITH {B}, x AS (SELECT symbol, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM bars), y AS (SELECT *, r - avg(r) OVER (PARTITION BY symbol) AS d FROM x WHERE r IS NOT NULL),
    z AS (SELECT *, d * lag(d, 1) OVER w AS p1, d * lag(d, 2) OVER w AS p2 FROM y WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, count(*) AS n, round(avg(r), 6) AS mean, round(avg(r) / sqrt((sum(d * d) / count(*) + 2 * (1 - 1 / 3) * sum(p1) / count(*) + 2 * (1 - 2 / 3) * sum(p2) / count(*)) / count(*)), 6) AS t FROM z GROUP BY 1""")
def _(spark, d):
    return stats.newey_west_t(v.bars(spark, d).withColumn("r", ft.log_ret("close")), "r", 2)


HELD = """z AS (SELECT *, CASE WHEN count(*) OVER w >= 24 THEN coalesce((close - avg(close) OVER w) / nullif(stddev_pop(close) OVER w, 0), 0) END AS z FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING)),
    e AS (SELECT *, CASE WHEN z >= 1.5 THEN -1.0 WHEN z <= -1.5 THEN 1.0 END AS raw FROM z), c AS (SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ca FROM e),
    h AS (SELECT *, coalesce(lag(ca) OVER (PARTITION BY symbol ORDER BY ts), 0) AS held FROM c), s AS (SELECT *, CASE WHEN raw IS NOT NULL THEN raw WHEN abs(z) <= 0.25 AND held <> 0 THEN 0 END AS st FROM h),
    sig AS (SELECT *, CAST(coalesce(last_value(st IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS DOUBLE) AS sig FROM s)"""


@query("s11_2_zscore_reversion", f"WITH {B}, {HELD} SELECT symbol, {TS}, round(z, 6) AS z, sig FROM sig")
def _(spark, d):
    return signals.zscore_reversion(v.bars(spark, d)).select("symbol", "ts", "z", "sig")


@query("s11_9_pairs", LEGS + """, z AS (SELECT *, CASE WHEN count(*) OVER w >= 48 THEN coalesce((ln(c1 / c2) - avg(ln(c1 / c2)) OVER w) / nullif(stddev_pop(ln(c1 / c2)) OVER w, 0), 0) END AS z FROM p WINDOW w AS (ORDER BY ts ROWS 47 PRECEDING)),
    e AS (SELECT *, CASE WHEN z >= 1.5 THEN -1.0 WHEN z <= -1.5 THEN 1.0 END AS raw FROM z), c AS (SELECT *, last_value(raw IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ca FROM e),
    h AS (SELECT *, coalesce(lag(ca) OVER (ORDER BY ts), 0) AS held FROM c), s AS (SELECT *, CASE WHEN raw IS NOT NULL THEN raw WHEN abs(z) <= 0.3 AND held <> 0 THEN 0 END AS st FROM h)
    SELECT """ + TS + ", round(z, 6) AS z, CAST(coalesce(last_value(st IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS DOUBLE) AS sig FROM s")
def _(spark, d):
    return signals.pair_spread(legs(spark, d)).select("ts", "z", "sig")


@query("s11_13_cross_momentum", f"""WITH {B}, m AS (SELECT symbol, ts, close / lag(close, 24) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS m FROM bars), r AS (SELECT symbol, ts, (rank() OVER (PARTITION BY ts ORDER BY m) + (count(*) OVER (PARTITION BY ts, m) - 1) / 2) / count(*) OVER (PARTITION BY ts) AS pct_rank FROM m WHERE m IS NOT NULL)
    SELECT symbol, {TS}, CAST(CASE WHEN pct_rank >= 0.75 THEN 1 WHEN pct_rank <= 0.25 THEN -1 ELSE 0 END AS DOUBLE) AS sig FROM r""")
def _(spark, d):
    return signals.cross_momentum(v.bars(spark, d)).select("symbol", "ts", "sig")


@query("s11_6_funding_carry", f"""WITH {B}, {FU}, f AS (SELECT symbol, ts, CAST(CASE WHEN lag(rate) OVER w > 5e-6 THEN -1 WHEN lag(rate) OVER w < -5e-6 THEN 1 ELSE 0 END AS DOUBLE) AS sig FROM funding WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq))
    SELECT b.symbol, CAST(epoch(b.ts) AS BIGINT) AS ts, coalesce(sig, 0) AS sig FROM bars b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.ts >= f.ts""")
def _(spark, d):
    from lodestream.operators.joins import asof_join

    f = signals.funding_carry(v.funding(spark, d), 5e-6)
    return asof_join(v.bars(spark, d).select("symbol", "ts"), f, cols=["sig"], prefix="", tie="seq").fillna(0.0, ["sig"])


@query("s11_20_ensemble", f"""WITH {B}, {HELD}, x AS (SELECT symbol, ts, sig FROM sig UNION ALL SELECT symbol, ts, CAST(CASE WHEN close < open THEN 1 WHEN close > open THEN -1 ELSE 0 END AS DOUBLE) FROM bars)
    SELECT symbol, {TS}, CAST(CASE WHEN min(sig) > 0 THEN 1 WHEN max(sig) < 0 THEN -1 ELSE 0 END AS DOUBLE) AS sig FROM x GROUP BY symbol, ts""")
def _(spark, d):
    b = v.bars(spark, d)
    other = b.select("symbol", "ts", F.when(F.col("close") < F.col("open"), 1.0).when(F.col("close") > F.col("open"), -1.0).otherwise(0.0).alias("sig"))
    return signals.ensemble(signals.zscore_reversion(b).select("symbol", "ts", "sig").unionByName(other), "vote")


@query("s11_23_hedge_weights", f"""WITH {B}, l AS (SELECT symbol, ts, 'up' AS expert, CASE WHEN close > open THEN 0.0 ELSE 1.0 END AS loss FROM bars UNION ALL SELECT symbol, ts, 'down', CASE WHEN close < open THEN 0.0 ELSE 1.0 END FROM bars),
    c AS (SELECT *, coalesce(sum(loss) OVER (PARTITION BY symbol, expert ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM l), e AS (SELECT *, exp(-0.1 * (c - min(c) OVER (PARTITION BY symbol, ts))) AS e FROM c)
    SELECT symbol, {TS}, expert, round(e / sum(e) OVER (PARTITION BY symbol, ts), 6) AS weight FROM e""")
def _(spark, d):
    b = v.bars(spark, d)
    up = b.select("symbol", "ts", F.lit("up").alias("expert"), F.when(F.col("close") > F.col("open"), 0.0).otherwise(1.0).alias("loss"))
    down = b.select("symbol", "ts", F.lit("down").alias("expert"), F.when(F.col("close") < F.col("open"), 0.0).otherwise(1.0).alias("loss"))
    return signals.hedge_weights(up.unionByName(down), 0.1).select("symbol", "ts", "expert", "weight")


BARRIER = f"""WITH {B}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, CASE WHEN close >= open THEN 1 ELSE -1 END AS side FROM bars), p AS (SELECT a.symbol, a.ts, a.close AS c, b.i - a.i AS k, b.ts AS bt, b.close AS bc, CASE WHEN a.side > 0 THEN b.high >= a.close * 1.5 ELSE b.low <= a.close * 0.5 END AS up, CASE WHEN a.side > 0 THEN b.low <= a.close * 0.5 ELSE b.high >= a.close * 1.5 END AS dn, a.side FROM n a JOIN n b ON a.symbol = b.symbol AND b.i > a.i AND b.i <= a.i + 12),
    t AS (SELECT symbol, ts, c, any_value(side) AS side, arg_min(CASE WHEN dn THEN -1 ELSE 1 END, k) FILTER (WHERE up OR dn) AS l, arg_min(bt, k) FILTER (WHERE up OR dn) AS lt, arg_max(bt, k) AS et, arg_max(bc, k) AS ec FROM p GROUP BY 1, 2, 3)"""


def _sided(bars):
    return bars.withColumn("target", F.lit(0.5)).withColumn("side", F.when(F.col("close") >= F.col("open"), 1).otherwise(-1))


@query("s12_1_triple_barrier", BARRIER + f" SELECT symbol, {TS}, CAST(coalesce(l, 0) AS INTEGER) AS label, CAST(epoch(coalesce(lt, et)) AS BIGINT) AS t1, round(side * (CASE WHEN l = side THEN c * 1.5 / c WHEN l = -side THEN c * 0.5 / c ELSE ec / c END - 1), 6) AS path_ret FROM t")
def _(spark, d):
    return labels.triple_barrier(_sided(v.bars(spark, d)), "target", 1.0, 1.0, 12, side="side").select("symbol", "ts", "label", "t1", "path_ret")


@query("s12_5_horizon_label", f"WITH {B}, x AS (SELECT symbol, ts, lead(close, 6) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS fwd FROM bars) SELECT symbol, {TS}, round(fwd, 6) AS fwd, CAST(CASE WHEN fwd IS NULL THEN NULL WHEN abs(fwd) <= 0.1 THEN 0 ELSE sign(fwd) END AS INTEGER) AS label FROM x")
def _(spark, d):
    return labels.horizon_label(v.bars(spark, d), 6, 0.1).select("symbol", "ts", "fwd", "label")


@query("s12_8_uniqueness", BARRIER + f""", s AS (SELECT symbol, ts, coalesce(lt, et) AS t1 FROM t), o AS (SELECT b.symbol, b.ts, count(s.ts) AS open FROM bars b LEFT JOIN s ON s.symbol = b.symbol AND b.ts BETWEEN s.ts AND s.t1 GROUP BY 1, 2)
    SELECT s.symbol, CAST(epoch(s.ts) AS BIGINT) AS ts, round(avg(1 / o.open), 6) AS uniqueness FROM s JOIN o ON o.symbol = s.symbol AND o.ts BETWEEN s.ts AND s.t1 GROUP BY 1, 2""")
def _(spark, d):
    b = v.bars(spark, d)
    e = labels.triple_barrier(_sided(b), "target", 1.0, 1.0, 12, side="side").select("symbol", "ts", "t1")
    return labels.uniqueness(e, b).select("symbol", "ts", "uniqueness")


@query("s12_10_purged_folds", f"""WITH {B}, x AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), f AS (SELECT *, unnest(range(5)) AS fold FROM x),
    r AS (SELECT symbol, fold, CASE WHEN i >= floor(n * fold / 5) AND i < floor(n * (fold + 1) / 5) THEN 'test' WHEN i >= floor(n * fold / 5) - 10 AND i < floor(n * (fold + 1) / 5) + 10 THEN 'left out' ELSE 'train' END AS role FROM f)
    SELECT symbol, CAST(fold AS INTEGER) AS fold, role, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def _(spark, d):
    return ac.purged_folds(v.bars(spark, d), 5, 10).groupBy("symbol", "fold", "role").agg(F.count(F.lit(1)).alias("n"))


PNL = f"""WITH {B}, {HELD}, p AS (SELECT symbol, ts, close, coalesce(lag(sig) OVER (PARTITION BY symbol ORDER BY ts), 0) AS pos, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1, 0) AS br FROM sig),
    q AS (SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY ts), 0)) AS turnover FROM p), r AS (SELECT *, pos * 0.01 * br - turnover * 0.0001 AS ret FROM q),
    eq AS (SELECT *, CASE WHEN max(CASE WHEN ret <= -1 THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(ln(1 + CASE WHEN ret > -1 THEN ret ELSE 0 END)) OVER w) END AS equity FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def _pnl(spark, d):
    """A hundredth of equity a position: the stand-in prices jump by large factors."""
    x = ac.positions(signals.zscore_reversion(v.bars(spark, d)))
    w = ft.series()
    x = x.withColumn("turnover", F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0.0)))).withColumn("br", F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)))
    x = x.withColumn("ret", F.col("pos") * 0.01 * F.col("br") - F.col("turnover") * 0.0001)
    return x.withColumn("equity", ft.cumulative_equity("ret"))


@query("s13_2_pnl", PNL + f" SELECT symbol, {TS}, pos, turnover, round(ret, 6) AS ret, round(equity, 6) AS equity FROM eq")
def _(spark, d):
    return _pnl(spark, d).select("symbol", "ts", "pos", "turnover", "ret", "equity")


@query("s13_3_closed_trades", PNL + f""", g AS (SELECT *, CASE WHEN pos = lag(pos) OVER (PARTITION BY symbol ORDER BY ts) THEN 0 ELSE 1 END AS ch FROM eq), k AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM g)
    SELECT symbol, CAST(run AS BIGINT) AS run, CAST(max(pos) AS INTEGER) AS side, CAST(epoch(min(ts)) AS BIGINT) AS entry_ts, CAST(epoch(max(ts)) AS BIGINT) AS exit_ts, round(sum(ret), 6) AS ret, arg_min(close, ts) AS entry_price, arg_max(close, ts) AS exit_price, count(*) AS bars FROM k WHERE pos <> 0 GROUP BY symbol, run""")
def _(spark, d):
    return ac.run_trades(_pnl(spark, d))


@query("s13_10_metrics", PNL + """, m AS (SELECT *, equity / greatest(max(equity) OVER (PARTITION BY symbol ORDER BY ts), 1) - 1 AS dd FROM eq)
    SELECT symbol, count(*) AS n, round(arg_max(equity, ts) - 1, 6) AS total, round(stddev_pop(ret) * sqrt(8760), 6) AS vol, round(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(8760), 6) AS sharpe, round(avg(ret) / nullif(sqrt(avg(least(ret, 0) ** 2)), 0) * sqrt(8760), 6) AS sortino,
    round(min(dd), 6) AS max_drawdown, round(avg(CASE WHEN pos <> 0 THEN 1.0 ELSE 0 END), 6) AS exposure, sum(turnover) AS turnover FROM m GROUP BY symbol""")
def _(spark, d):
    return ac.metrics(_pnl(spark, d), 8760)


@query("s13_12_walk_forward", PNL + """, i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM eq), w AS (SELECT *, unnest(range(40)) AS win FROM i), k AS (SELECT *, CASE WHEN i >= win * 72 AND i < win * 72 + 195 THEN 'train' WHEN i >= win * 72 + 200 AND i < win * 72 + 272 THEN 'test' END AS role FROM w WHERE win <= floor((n - 272) / 72) AND n >= 272)
    SELECT symbol, CAST(win AS BIGINT) AS "window", role, count(*) AS n, round(avg(ret), 6) AS mean, round(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(count(*)), 6) AS sharpe FROM k WHERE role IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, d):
    return ac.walk_forward(_pnl(spark, d), 200, 72, purge=5)


@query("s13_18_entry_delay", f"""WITH {B}, {HELD}, l AS (SELECT symbol, ts, close, unnest([{{'d': 1, 'p': lag(sig, 1) OVER w}}, {{'d': 2, 'p': lag(sig, 2) OVER w}}, {{'d': 3, 'p': lag(sig, 3) OVER w}}]) AS s, close / lag(close) OVER w - 1 AS br FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, s.d AS delay, round(avg(coalesce(s.p, 0) * 0.01 * coalesce(br, 0)) * 1e4, 6) AS mean_bps FROM l GROUP BY 1, 2""")
def _(spark, d):
    x, w = signals.zscore_reversion(v.bars(spark, d)), ft.series()
    x = x.select("symbol", (F.col("close") / F.lag("close").over(w) - 1).alias("br"), *[F.lag("sig", k).over(w).alias(f"p{k}") for k in (1, 2, 3)])
    x = x.select("symbol", "br", F.explode(F.array(*[F.struct(F.lit(k).alias("d"), F.col(f"p{k}").alias("p")) for k in (1, 2, 3)])).alias("s"))
    return x.groupBy("symbol", F.col("s.d").alias("delay")).agg((F.avg(F.coalesce("s.p", F.lit(0.0)) * 0.01 * F.coalesce("br", F.lit(0.0))) * 1e4).alias("mean_bps"))


@query("s13_21_deflated_sharpe")
def _(spark, d):
    return ac.deflated_sharpe(_pnl(spark, d), 50)


@query("s13_23_cscv")
def _(spark, d):
    x = v.bars(spark, d).withColumn("r", ft.log_ret("close")).where("r is not null").select(F.col("symbol").alias("variant"), "ts", "r")
    return ac.cscv(x, 8, ret="r")


@query("s13_30_risk_contributions", f"""WITH {B}, x AS (SELECT symbol, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM bars), c AS (SELECT a.symbol AS i, b.symbol AS j, covar_samp(a.r, b.r) AS c FROM x a JOIN x b USING (ts) GROUP BY 1, 2)
    SELECT i AS symbol, round(sum(c / 64), 6) AS contribution FROM c GROUP BY 1""")
def _(spark, d):
    x = v.bars(spark, d).withColumn("ret", ft.log_ret("close"))
    return ac.risk_contributions(x, x.select("symbol").distinct().withColumn("weight", F.lit(0.125)))


@query("s14_1_bar_report", f"""WITH {B}, x AS (SELECT *, epoch(ts) - lag(epoch(ts)) OVER w AS d, abs(close / lag(close) OVER w - 1) AS r, CASE WHEN close = lag(close) OVER w THEN 0 ELSE 1 END AS sm FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), g AS (SELECT *, sum(sm) OVER (PARTITION BY symbol ORDER BY ts) AS g FROM x), k AS (SELECT *, count(*) OVER (PARTITION BY symbol, g) AS run FROM g),
    m AS (SELECT symbol, quantile_cont(r, 0.5) AS m FROM x GROUP BY 1) SELECT symbol, count(*) AS rows, count(*) FILTER (WHERE d = 0) AS duplicates, count(*) FILTER (WHERE high < greatest(open, close, low) OR low > least(open, close, high) OR low <= 0) AS bad_ohlc, count(*) FILTER (WHERE open IS NULL OR close IS NULL) AS missing,
    count(*) FILTER (WHERE d > 5400) AS gaps, count(*) FILTER (WHERE r > greatest(0.05, 20 * m)) AS spikes, 0::BIGINT AS future, max(run) AS flat_run FROM k JOIN m USING (symbol) GROUP BY symbol""".replace("AS rows", 'AS "rows"'))
def _(spark, d):
    return quality.bar_report(v.bars(spark, d))


@query("s14_5_trade_report", f"""WITH {T} SELECT symbol, count(*) AS "rows", count(DISTINCT trade_id) AS ids, count(*) FILTER (WHERE price <= 0 OR amount <= 0) AS bad, count(*) FILTER (WHERE side NOT IN ('buy', 'sell')) AS no_side, round(count(DISTINCT trade_id) / (max(trade_id) - min(trade_id) + 1), 6) AS id_coverage FROM ticks GROUP BY 1""")
def _(spark, d):
    return quality.trade_report(v.ticks(spark, d))


@query("s14_7_book_report", f"""WITH {BK} SELECT symbol, count(*) AS "rows", count(*) FILTER (WHERE bid > ask) AS crossed, count(*) FILTER (WHERE bid <= 0 OR ask <= 0 OR bid_qty < 0 OR ask_qty < 0) AS invalid FROM book GROUP BY 1""")
def _(spark, d):
    return quality.book_report(v.book(spark, d))


@query("s14_6_funding_report", f"""WITH {FU}, x AS (SELECT *, floor(epoch(ts)) - lag(floor(epoch(ts))) OVER (PARTITION BY symbol ORDER BY ts, seq) AS d FROM funding), m AS (SELECT symbol, quantile_cont(d, 0.5) AS step FROM x GROUP BY 1)
    SELECT symbol, count(*) AS "rows", count(*) FILTER (WHERE rate IS NULL) AS missing, count(*) FILTER (WHERE abs(rate) > 1e-4) AS beyond, any_value(step) AS step, count(*) FILTER (WHERE d > 1.5 * step) AS gaps FROM x JOIN m USING (symbol) GROUP BY symbol""")
def _(spark, d):
    return quality.funding_report(v.funding(spark, d), 1e-4)


def _cuts_sql(flow: str, have: str, mean: str, length: int) -> str:
    """Adaptive bars tick by tick: flow gives a tick's buys and sells, have and mean compare their sums and means."""
    return f"""WITH RECURSIVE {T}, x AS (SELECT *, nullif(sign(price - lag(price) OVER w), 0) AS s, row_number() OVER w - 1 AS i FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, trade_id)),
    y AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING), 1) AS b FROM x), n AS (SELECT symbol, ts, i, CASE WHEN b > 0 THEN {flow} ELSE 0.0 END AS fb, CASE WHEN b > 0 THEN 0.0 ELSE {flow} END AS fs FROM y),
    r AS (SELECT symbol, ts, i, fb AS mb, fs AS ms, CAST(1 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS tb, CAST(0 AS DOUBLE) AS tt, CAST({length} AS DOUBLE) AS e, CAST(0 AS BIGINT) AS c, 0 AS bar, 0 AS ticks FROM n WHERE i = 0
    UNION ALL SELECT symbol, ts, i, mb, ms, w, CASE WHEN cut THEN 0 ELSE tb END, CASE WHEN cut THEN 0 ELSE tt END, CASE WHEN cut THEN (e * 100 + (i - c)) / 101 ELSE e END, CASE WHEN cut THEN i ELSE c END, CASE WHEN cut THEN bar + 1 ELSE bar END, CASE WHEN cut THEN CAST(i - c AS INTEGER) ELSE 0 END
    FROM (SELECT *, {have} >= e * ({mean}) AS cut FROM (SELECT n.symbol, n.ts, n.i, r.mb * (1 - 2.0::DOUBLE / 101) + n.fb AS mb, r.ms * (1 - 2.0::DOUBLE / 101) + n.fs AS ms, r.w * (1 - 2.0::DOUBLE / 101) + 1 AS w, r.tb + n.fb AS tb, r.tt + n.fs AS tt, r.e, r.c, r.bar FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)))
    SELECT symbol, {TS}, bar - 1 AS bar, ticks FROM r WHERE ticks > 0"""


IMB = ("abs(tb - tt)", "greatest(abs(mb / w - ms / w), {0})")


@query("s4_11_imbalance_bars", _cuts_sql("CAST(1 AS DOUBLE)", IMB[0], IMB[1].format(0), 100))
def _(spark, d):
    return states.imbalance_cuts(v.ticks(spark, d), length=100)


@query("s4_12_dollar_imbalance_bars", _cuts_sql("price * amount", IMB[0], IMB[1].format(1e-6), 50))
def _(spark, d):
    return states.imbalance_cuts(v.ticks(spark, d), dollars=True, length=50)


@query("s4_13_tick_run_bars", _cuts_sql("CAST(1 AS DOUBLE)", "greatest(tb, tt)", "greatest(mb / w, ms / w, 0.5)", 50))
def _(spark, d):
    return states.imbalance_cuts(v.ticks(spark, d), runs=True, length=50)


@query("s4_14_dollar_run_bars", _cuts_sql("price * amount", "greatest(tb, tt)", "greatest(mb / w, ms / w, 1e-6)", 50))
def _(spark, d):
    return states.imbalance_cuts(v.ticks(spark, d), dollars=True, runs=True, length=50)


@query("s6_24_dwell", f"""WITH RECURSIVE {B}, {VOLS.format('bars')}, n AS (SELECT symbol, ts, vol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM vr),
    r AS (SELECT symbol, ts, i, vol AS stable, CAST(NULL AS VARCHAR) AS nxt, 0 AS c FROM n WHERE i = 1
    UNION ALL SELECT symbol, ts, i, CASE WHEN c >= 5 THEN vol ELSE stable END, CASE WHEN c = 0 OR c >= 5 THEN NULL ELSE vol END, CASE WHEN c >= 5 THEN 0 ELSE c END
    FROM (SELECT n.symbol, n.ts, n.i, n.vol, r.stable, CASE WHEN n.vol = r.stable THEN 0 WHEN n.vol = r.nxt THEN r.c + 1 ELSE 1 END AS c FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1))
    SELECT symbol, {TS}, stable FROM r""")
def _(spark, d):
    return states.dwell(ft.volatility_regime(v.bars(spark, d)), "vol_regime", 5)


@query("s6_43_cusum", f"""WITH RECURSIVE {B}, n AS (SELECT symbol, ts, row_number() OVER w AS i, coalesce(ln(close / lag(close) OVER w), 0) AS lr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    r AS (SELECT symbol, ts, i, CAST(0 AS DOUBLE) AS u, CAST(0 AS DOUBLE) AS l, 0 AS side FROM n WHERE i = 1
    UNION ALL SELECT symbol, ts, i, CASE WHEN u > 2 OR l < -2 THEN 0 ELSE u END, CASE WHEN u > 2 OR l < -2 THEN 0 ELSE l END, CASE WHEN u > 2 THEN 1 WHEN l < -2 THEN -1 ELSE 0 END
    FROM (SELECT n.symbol, n.ts, n.i, greatest(0, r.u + n.lr) AS u, least(0, r.l + n.lr) AS l FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1))
    SELECT symbol, {TS}, side FROM r WHERE side <> 0""")
def _(spark, d):
    return states.cusum_events(v.bars(spark, d), "close", 2.0)


@query("s11_15_supertrend", f"""WITH RECURSIVE {B}, n AS (SELECT *, row_number() OVER w AS i, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    r AS (SELECT symbol, ts, i, close, tr AS t, CAST(1 AS DOUBLE) AS tw, (high + low) / 2 + 3 * tr AS up, (high + low) / 2 - 3 * tr AS dn, 1 AS side FROM n WHERE i = 1
    UNION ALL SELECT symbol, ts, i, close, t, tw, up2, dn2, CASE WHEN side > 0 AND close < dn2 THEN -1 WHEN side < 0 AND close > up2 THEN 1 ELSE side END
    FROM (SELECT *, CASE WHEN mid + 3 * t / tw < up OR pc > up THEN mid + 3 * t / tw ELSE up END AS up2, CASE WHEN mid - 3 * t / tw > dn OR pc < dn THEN mid - 3 * t / tw ELSE dn END AS dn2
    FROM (SELECT n.symbol, n.ts, n.i, n.close, r.t * 13 / 14 + n.tr AS t, r.tw * 13 / 14 + 1 AS tw, (n.high + n.low) / 2 AS mid, r.up, r.dn, r.side, r.close AS pc FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)))
    SELECT symbol, {TS}, round(CASE WHEN side > 0 THEN dn ELSE up END, 6) AS line, side FROM r""")
def _(spark, d):
    return states.supertrend(ft.atr(v.bars(spark, d)))


@query("s12_23_kalman_hedge", f"""WITH RECURSIVE {B}, n AS (SELECT a.symbol || '-' || b.symbol AS pair, a.ts, ln(a.close) AS y, ln(b.close) AS x, row_number() OVER (PARTITION BY a.symbol, b.symbol ORDER BY a.ts) AS i FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol),
    r AS (SELECT pair, ts, i, y * x * 1.00001::DOUBLE / (x * x * 1.00001::DOUBLE + 0.01) AS beta, (1 - x * x * 1.00001::DOUBLE / (x * x * 1.00001::DOUBLE + 0.01)) * 1.00001::DOUBLE AS p, y AS error FROM n WHERE i = 1
    UNION ALL SELECT pair, ts, i, b + p * x / (x * x * p + 0.01) * e, (1 - x * x * p / (x * x * p + 0.01)) * p, e
    FROM (SELECT n.pair, n.ts, n.i, n.x, r.beta AS b, r.p + 1e-5::DOUBLE AS p, n.y - r.beta * n.x AS e FROM r JOIN n ON n.pair = r.pair AND n.i = r.i + 1))
    SELECT pair, {TS}, round(beta, 6) AS beta, round(error, 6) AS error FROM r""")
def _(spark, d):
    one = v.bars(spark, d).select("ts", "symbol", "close")
    two = one.select("ts", F.col("symbol").alias("s2"), F.col("close").alias("c2"))
    pairs = one.join(two, "ts").where("symbol < s2")
    return states.kalman_hedge(pairs.select(F.concat_ws("-", "symbol", "s2").alias("pair"), "ts", F.ln("close").alias("y"), F.ln("c2").alias("x")))


@query("s10_6_stream_bars", f"WITH {B}, m AS (SELECT max(ts) AS z FROM ticks) SELECT symbol, {TS}, {_r('open', 'high', 'low', 'close', 'volume')} FROM bars, m WHERE bars.ts + INTERVAL 1 hour <= z - INTERVAL 10 minute")
def _(spark, d):
    tune(spark)
    return streams.run_to_table(streams.tumbling_bars(streams.ticks(spark, d), "1 hour", "10 minutes"), "stream-bars")


@query("s10_9_stream_dedupe", f"WITH {T} SELECT symbol, trade_id, round(price, 6) AS price FROM ticks")
def _(spark, d):
    tune(spark)
    t = streams.ticks(spark, d)
    return streams.run_to_table(streams.deduplicated(t.unionByName(t), "1 hour"), "stream-dedupe").select("symbol", "trade_id", "price")


@query("s10_14_stream_asof", f"WITH {T}, {FU} SELECT t.symbol, t.trade_id, round(f.rate * 1e6, 3) AS rate FROM ticks t ASOF LEFT JOIN funding f ON t.symbol = f.symbol AND t.ts >= f.ts")
def _(spark, d):
    import uuid

    sink = f"{shared_dir(tune(spark))}/enriched-{uuid.uuid4().hex}"
    streams.run_batches(streams.ticks(spark, d), streams.enriched(v.funding(spark, d), ["rate"], sink), "stream-asof")
    return spark.read.parquet(sink).select("symbol", "trade_id", F.round(F.col("event_rate") * 1e6, 3).alias("rate"))
