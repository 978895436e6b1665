"""Queries on sweep cells, gates, orders and fills, and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream import views as v
from lodestream.functions import numbers as n
from lodestream.operators import features as ft
from lodestream.operators import joins, resample, sweeps, trades
from lodestream.plans.market import BK, TS, B, C, FL, FU, O, T
from lodestream.plans.registry import query
from lodestream.session import table, tune
from lodestream.sources import tables as src

S = v.SWEEP
LEAST = {"5m": 60, "1h": 50}
NEED = "CASE interval WHEN '5m' THEN 60 WHEN '1h' THEN 50 ELSE 40 END"
KEY = "strategy, symbol, interval, mode, days"
KEYS = KEY.split(", ")


@query("s2_2_coerce", f"WITH {S} SELECT {KEY}, try_cast(s_sharpe AS DOUBLE) AS s_sharpe FROM sweep")
def _(spark, d):
    return sweeps.coerce(v.sweep(spark, d), ["s_sharpe"]).select(*KEYS, "s_sharpe")


@query("s2_3_candidates", f"WITH {S} SELECT {KEY}, coalesce(avg_oos_sharpe > 0.3 AND oos_positive_frac >= 0.5 AND n_trades >= {NEED}, false) AS candidate FROM sweep")
def _(spark, d):
    return sweeps.candidates(v.sweep(spark, d), LEAST).select(*KEYS, "candidate")


@query("s2_5_funding_filter", f"WITH {FU} SELECT symbol, count(*) AS n, round(sum(rate) * 1e6, 3) AS rate FROM funding WHERE abs(rate) < 2e-5 GROUP BY 1")
def _(spark, d):
    return v.funding(spark, d).where(F.abs("rate") < 2e-5).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("rate") * 1e6, 3).alias("rate"))


DEGENERATE = f"""dg AS (SELECT *, CASE WHEN status = 'ok' AND days >= 30 THEN concat_ws('; ', CASE WHEN n_trades <= 0 THEN 'no trades' WHEN n_trades < {NEED} THEN 'too few trades' END, CASE WHEN mode = 'backtest' AND total_return <= -1 THEN 'capital lost' END,
    CASE WHEN mode = 'backtest' AND (profit_factor IS NULL OR isinf(profit_factor)) THEN 'profit factor undefined' END, CASE WHEN mode = 'backtest' AND abs(sharpe) > 20 THEN 'Sharpe implausible' END) ELSE '' END AS error FROM sweep)"""


@query("s2_8_degenerate", f"WITH {S}, {DEGENERATE} SELECT {KEY}, error, CASE WHEN error <> '' THEN 'degenerate' ELSE status END AS status FROM dg")
def _(spark, d):
    return sweeps.degenerate(v.sweep(spark, d), LEAST).select(*KEYS, "error", "status")


def _audit(spark, d):
    x = v.sweep(spark, d)
    return x.select(
        *KEYS, "status", F.lit(None).cast("string").alias("error"), "avg_oos_sharpe", "oos_positive_frac", "n_trades", "n_trades_oos", "sharpe", "total_return", (F.col("q") / 26).alias("dsr"), (F.col("profit_factor") - 0.8).alias("smoothness"), F.when(F.col("n_trades") % 2 == 0, F.col("q") / 52).alias("pbo"),
        (F.col("n_trades") % 7 != 0).alias("quintile_pass"), (F.col("n_trades") % 11 != 0).alias("time_decay_pass"), F.lit(None).cast("boolean").alias("stress_pass"), F.lit(1.0).alias("benchmark_sharpe"), F.when(F.col("n_trades") % 3 > 0, F.col("avg_oos_sharpe")).alias("holdout_sharpe"),
    )


@query("s2_9_cell_verdict", f"""WITH {S}, a AS (SELECT *, q / 26 AS dsr, profit_factor - 0.8 AS smoothness, CASE WHEN n_trades % 2 = 0 THEN q / 52 END AS pbo, CASE WHEN n_trades % 3 > 0 THEN avg_oos_sharpe END AS holdout FROM sweep),
    r AS (SELECT *, CASE WHEN status <> 'ok' THEN 'audit: unknown' ELSE concat_ws('; ', CASE WHEN NOT coalesce(avg_oos_sharpe > 0.3, false) THEN 'avg_oos_sharpe' END, CASE WHEN NOT coalesce(oos_positive_frac >= 0.5, false) THEN 'oos_pos_frac' END, CASE WHEN NOT coalesce(dsr > 0.95, false) THEN 'DSR' END,
    CASE WHEN NOT coalesce(smoothness > 0.3, false) THEN 'smoothness' END, CASE WHEN n_trades_oos < {NEED} THEN 'n_trades_oos' END, CASE WHEN pbo > 0.5 THEN 'PBO' END, CASE WHEN n_trades % 7 = 0 THEN 'quintile' END, CASE WHEN n_trades % 11 = 0 THEN 'time_decay' END, CASE WHEN sharpe <= 1 THEN 'benchmark' END,
    CASE WHEN holdout IS NULL THEN 'holdout missing' WHEN holdout <= 0 THEN 'holdout' END) END AS reasons FROM a) SELECT {KEY}, reasons, CASE WHEN reasons <> '' THEN 'FAIL' ELSE 'PASS' END AS verdict FROM r""")
def _(spark, d):
    return sweeps.cell_verdict(_audit(spark, d), LEAST, final=True).select(*KEYS, "reasons", "verdict")


@query("s2_10_gates", f"""WITH {S} SELECT {KEY}, concat_ws('; ', CASE WHEN n_trades_oos = 0 THEN 'no windows' WHEN oos_positive_frac < 0.5 THEN 'positive windows' END, CASE WHEN abs(total_return) > 0 AND abs(sharpe) > abs(total_return) * 2.5 THEN 'crash' END, CASE WHEN abs(total_return) > 0 AND abs(sharpe) * 1.5 > abs(total_return) * 4.0 THEN 'liquidity' END) AS pair_reasons,
    concat_ws('; ', CASE WHEN abs(sharpe) / 100 > 0.03 THEN 'tracking error' END, CASE WHEN oos_positive_frac < 0.7 THEN 'fill rate' END, CASE WHEN abs(sharpe) > abs(avg_oos_sharpe) * 1.5 THEN 'drawdown' END, CASE WHEN q / 10 > 3 THEN 'cost' END) AS paper_reasons,
    CASE WHEN q / 26 > 0.95 THEN 'significant' WHEN q / 26 > 0.5 THEN 'weak' ELSE 'none' END AS dsr_label, CASE WHEN total_return / n_trades > 0 THEN 'covers' WHEN total_return / n_trades > -0.0008 * 2 THEN 'near zero' ELSE 'drag' END AS hurdle FROM sweep""")
def _(spark, d):
    c = F.col
    pair = sweeps.pair_gate(c("oos_positive_frac"), c("n_trades_oos"), crash=F.abs("sharpe"), liquidity=F.abs("sharpe") * 1.5, base=F.abs("total_return"))
    paper = sweeps.paper_gate(F.abs("sharpe") / 100, c("oos_positive_frac"), F.abs("sharpe"), F.abs("avg_oos_sharpe"), c("q") / 10)
    return v.sweep(spark, d).select(*KEYS, pair.alias("pair_reasons"), paper.alias("paper_reasons"), sweeps.dsr_label(c("q") / 26).alias("dsr_label"), sweeps.hurdle_label(c("total_return") / c("n_trades"), 0.0008, 2).alias("hurdle"))


@query("s2_17_confidence", f"WITH {B} SELECT symbol, {TS}, CAST(CASE WHEN 0.5 + abs(close - open) / (2 * (high - low + 1)) >= 0.7 THEN sign(close - open) ELSE 0 END AS INTEGER) AS side FROM bars")
def _(spark, d):
    p = 0.5 + F.abs(F.col("close") - F.col("open")) / (2 * (F.col("high") - F.col("low") + 1))
    return v.bars(spark, d).select("symbol", "ts", n.confident(F.signum(F.col("close") - F.col("open")), p, 0.7).cast("int").alias("side"))


@query("s2_18_experiments", f"""WITH {S}, b AS (SELECT symbol, interval, sharpe AS s, total_return AS r FROM sweep WHERE strategy = 'carry' AND mode = 'backtest' AND days = 40),
    j AS (SELECT sweep.*, CASE WHEN sharpe > s + 0.1 AND total_return >= r THEN 'IMPROVED' WHEN sharpe < s OR total_return < r THEN 'REGRESSED' ELSE 'SKIPPED' END AS verdict FROM sweep JOIN b USING (symbol, interval)) SELECT {KEY}, verdict, verdict = 'IMPROVED' AND n_trades >= 30 AS oos FROM j""")
def _(spark, d):
    x = v.sweep(spark, d)
    base = x.where("strategy = 'carry' and mode = 'backtest' and days = 40")
    return sweeps.against_baseline(x, base, ["symbol", "interval"], 0.1).select(*KEYS, "verdict", "oos")


@query("s2_20_symbols", f"WITH {S} SELECT DISTINCT symbol, replace(upper(symbol || '/' || 'btcusdt'), 'USDT', '').replace('/', '-') AS pair, upper(symbol).replace('USDT', '') AS base FROM sweep")
def _(spark, d):
    x = v.sweep(spark, d).select("symbol").distinct()
    return x.select("symbol", sweeps.normal_symbol(F.concat_ws("/", "symbol", F.lit("btcusdt"))).alias("pair"), sweeps.normal_symbol(F.col("symbol")).alias("base"))


FEE_SQL = ", ".join(f"('{e}', '{t}', {m}, {k})" for e, ts in sweeps.FEES.items() for t, (m, k) in ts.items())


@query("s2_21_fees", f"""WITH {O}, f(e, t, maker, taker) AS (VALUES {FEE_SQL}), o AS (SELECT order_id, CASE WHEN account % 2 = 0 THEN 'Binance' ELSE ' bybit' END AS exchange, 'VIP' || (account % 8) AS tier, status = 'filled' AS discount FROM order_log)
    SELECT order_id, round(CAST(maker AS DOUBLE) * CASE WHEN discount AND e = 'binance' THEN 0.75 ELSE 1 END * 1e6, 3) AS maker, round(CAST(taker AS DOUBLE) * CASE WHEN discount AND e = 'binance' THEN 0.75 ELSE 1 END * 1e6, 3) AS taker FROM o LEFT JOIN f ON lower(trim(exchange)) = e AND lower(tier) = t""")
def _(spark, d):
    o = v.order_log(spark, d).select("order_id", F.when(F.col("account") % 2 == 0, "Binance").otherwise(" bybit").alias("exchange"), F.concat(F.lit("VIP"), F.col("account") % 8).alias("tier"), (F.col("status") == "filled").alias("discount"))
    return sweeps.fees(o, discount="discount").select("order_id", F.round(F.col("maker") * 1e6, 3).alias("maker"), F.round(F.col("taker") * 1e6, 3).alias("taker"))


@query("s2_22_closed_bars", f"WITH {B} SELECT symbol, {TS}, close FROM bars WHERE ts + INTERVAL 1 hour <= TIMESTAMP '2024-01-20 10:30:00'")
def _(spark, d):
    return resample.closed(v.bars(spark, d), "1 HOUR", F.lit("2024-01-20 10:30:00").cast("timestamp")).select("symbol", "ts", "close")


SPAN = "least(max(epoch(ts)), epoch(TIMESTAMP '2024-01-25')) - greatest(min(epoch(ts)), epoch(TIMESTAMP '2024-01-05'))"


@query("s2_23_coverage", f"WITH {T}, c AS (SELECT symbol, greatest(0, {SPAN}) / (20 * 86400) AS share FROM ticks GROUP BY 1) SELECT symbol, round(share, 6) AS share, share >= 0.95 AS covered FROM c")
def _(spark, d):
    return ft.coverage(v.ticks(spark, d), "2024-01-05", "2024-01-25", 0.95)


@query("s2_24_missing_windows", f"""WITH {B}, e AS (SELECT symbol, ts FROM bars WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-29' UNION SELECT DISTINCT symbol, TIMESTAMP '2024-01-02 23:00:00' FROM bars UNION SELECT DISTINCT symbol, TIMESTAMP '2024-01-29' FROM bars),
    x AS (SELECT symbol, ts, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS nx FROM e) SELECT symbol, CAST(epoch(ts) + 3600 AS BIGINT) AS start, CAST(epoch(nx) AS BIGINT) AS "end" FROM x WHERE epoch(nx) - epoch(ts) > 3600""")
def _(spark, d):
    return ft.missing_windows(v.bars(spark, d), "2024-01-03", "2024-01-29", 3600)


@query("s3_19_shadow_shift", f"WITH {B} SELECT symbol, {TS}, close, lead(close, 4) OVER (PARTITION BY symbol ORDER BY ts) AS later FROM bars")
def _(spark, d):
    return v.bars(spark, d).select("symbol", "ts", "close", F.lead("close", 4).over(ft.series()).alias("later"))


@query("s3_24_latest_job", f"""WITH {S}, {O}, c AS (SELECT {KEY}, row_number() OVER (ORDER BY {KEY}) % 1500 AS account FROM sweep), j AS (SELECT account, arg_max(order_id, (ts, order_id)) AS job, arg_max(status, (ts, order_id)) AS job_status FROM order_log GROUP BY 1) SELECT {KEY}, job, job_status FROM c LEFT JOIN j USING (account)""")
def _(spark, d):
    cells = v.sweep(spark, d).select(*KEYS).withColumn("account", F.row_number().over(Window.orderBy(*KEYS)) % 1500)  # a few hundred cells
    jobs = src.latest(v.order_log(spark, d), ["account"], ["ts", "order_id"]).select("account", F.col("order_id").alias("job"), F.col("status").alias("job_status"))
    return cells.join(jobs, "account", "left").select(*KEYS, "job", "job_status")


@query("s3_28_external_fills", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber > 2 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def _(spark, d):
    fills = v.fills(spark, d).where("l_linenumber > 2").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.not_in_journal(fills, v.order_log(spark, d).where("status <> 'cancelled'"), "l_orderkey", "order_id")


@query("s3_30_oos_range", f"""WITH {B}, r AS (SELECT symbol, max(ts) - INTERVAL 5 day AS a, max(ts) AS z FROM bars GROUP BY 1), u AS (SELECT symbol, ts AS a, ts + INTERVAL 1 hour AS z FROM bars WHERE volume > 400)
    SELECT symbol, CAST(epoch(a) AS BIGINT) AS start, CAST(epoch(z) AS BIGINT) AS "end", EXISTS (SELECT 1 FROM u WHERE u.symbol = r.symbol AND u.a <= r.z AND u.z >= r.a) AS burned FROM r""")
def _(spark, d):
    b = v.bars(spark, d)
    used = b.where("volume > 400").select("symbol", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("end"))
    ranges = b.groupBy("symbol").agg((F.max("ts") - F.expr("INTERVAL 5 DAYS")).alias("start"), F.max("ts").alias("end"))
    hit = joins.overlapping(ranges, used, ["symbol"]).select("symbol", F.lit(True).alias("burned"))
    return ranges.join(hit, "symbol", "left").fillna(False, ["burned"])


@query("s4_3_resample_series", f"WITH {FU} SELECT symbol, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS ts, round(arg_max(rate, (ts, seq)) * 1e6, 3) AS last, round(avg(rate) * 1e6, 3) AS mean, round(sum(rate) * 1e6, 3) AS sum FROM funding GROUP BY symbol, date_trunc('day', ts)")
def _(spark, d):
    x = resample.resample_series(v.funding(spark, d), "rate", "1 day", tie="seq")
    return x.select("symbol", "ts", *[F.round(F.col(c) * 1e6, 3).alias(c) for c in ("last", "mean", "sum")])


@query("s4_19_mean_equity", f"WITH {O}, l AS (SELECT date_trunc('day', ts) AS ts, status, arg_max(price, order_id) AS equity FROM order_log GROUP BY 1, 2) SELECT CAST(epoch(ts) AS BIGINT) AS ts, count(*) AS pairs, round(avg(equity), 4) AS equity FROM l GROUP BY ts")
def _(spark, d):
    o = v.order_log(spark, d).groupBy(F.date_trunc("day", "ts").alias("ts"), "status").agg(F.max_by("price", "order_id").alias("equity"))
    return o.groupBy("ts").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("equity"), 4).alias("equity"))


@query("s4_20_hourly_sharpe", f"WITH {T}, h AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_max(price, (ts, trade_id)) AS e FROM ticks GROUP BY 1, date_trunc('hour', ts)), r AS (SELECT symbol, e / lag(e) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM h) SELECT symbol, count(r) AS n, round(avg(r) / nullif(stddev_pop(r), 0), 6) AS sharpe_hourly, round(avg(r) / nullif(sqrt(avg(least(r, 0) ** 2)), 0), 6) AS sortino_hourly FROM r WHERE r IS NOT NULL GROUP BY 1")
def _(spark, d):
    return resample.hourly_ratios(v.ticks(spark, d), "price")


@query("s5_11_durations", f"""WITH {C}, x AS (SELECT symbol, (epoch(exit_ts) - epoch(entry_ts)) / 86400 AS d FROM closed) SELECT symbol, CASE WHEN d <= 7 THEN 'week' WHEN d <= 30 THEN 'month' WHEN d <= 90 THEN 'quarter' ELSE 'longer' END AS bucket, count(*) AS n, round(avg(d), 6) AS mean_days FROM x GROUP BY 1, 2""")
def _(spark, d):
    x = v.closed_trades(spark, d).withColumn("bucket", trades.duration_bucket(F.col("entry_ts"), F.col("exit_ts")))
    return x.groupBy("symbol", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg((F.unix_seconds("exit_ts") - F.unix_seconds("entry_ts")) / 86400).alias("mean_days"))


@query("s5_12_paper_trades", f"""WITH {FL}, {O} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(status, 'unknown') AS status, CASE WHEN status = 'filled' THEN qty ELSE 0 END AS filled, round(coalesce(o.price, f.price), 6) AS ref_price FROM fills f LEFT JOIN order_log o ON o.order_id = f.l_orderkey AND o.status <> 'cancelled'""")
def _(spark, d):
    return trades.normalised(v.fills(spark, d), v.order_log(spark, d).where("status <> 'cancelled'")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "status", "filled", "ref_price")


@query("s5_16_sweep_summary", f"WITH {S} SELECT strategy, round(avg(sharpe), 6) AS mean_sharpe, max(sharpe) AS max_sharpe, count(*) AS n, round(avg(n_trades), 6) AS mean_trades FROM sweep WHERE status = 'ok' GROUP BY 1")
def _(spark, d):
    return sweeps.summary(v.sweep(spark, d))


@query("s5_17_map_attribution", f"WITH {S} SELECT strategy, 'thin' AS filter, CAST(sum(n_trades % 7) AS BIGINT) AS n FROM sweep GROUP BY 1 UNION ALL SELECT strategy, 'wide', CAST(sum(n_trades_oos) AS BIGINT) FROM sweep GROUP BY 1")
def _(spark, d):
    x = v.sweep(spark, d).withColumn("blocked", F.to_json(F.create_map(F.lit("thin"), (F.col("n_trades") % 7).cast("int"), F.lit("wide"), F.col("n_trades_oos").cast("int"))))
    return sweeps.map_attribution(x)


@query("s5_18_winners", f"""WITH {S}, w AS (SELECT mode, interval, arg_max({{'strategy': strategy, 'symbol': symbol, 'value': avg_oos_sharpe}}, (avg_oos_sharpe, strategy, symbol)) AS b, count(*) AS n FROM sweep WHERE status = 'ok' AND avg_oos_sharpe IS NOT NULL GROUP BY 1, 2)
    SELECT mode, interval, 'avg_oos_sharpe' AS metric, b.strategy AS winner, b.symbol AS symbol, b.value AS value, n FROM w""")
def _(spark, d):
    """Without the haircut's columns, whose normal quantile SQL does not have; a test holds those against the library's."""
    return sweeps.winners(v.sweep(spark, d)).drop("selection_sr0", "deflated")


@query("s5_23_supervisor_vs_baseline", f"""WITH {B}, r AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS r, CASE WHEN lag(close) OVER w > lag(open) OVER w THEN 1 ELSE -1 END AS s FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), l AS (SELECT unnest([{{'n': 'hold', 'r': 0.01 * r}}, {{'n': 'supervisor', 'r': 0.01 * r * s}}, {{'n': 'half', 'r': 0.005 * r}}]) AS x FROM r WHERE r IS NOT NULL)
    SELECT x.n AS strategy, count(*) AS n, round(avg(x.r) * 1e4, 6) AS mean_bps, round(avg(x.r) / stddev_pop(x.r) * sqrt(8760), 6) AS sharpe, round(avg(CASE WHEN x.r > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate FROM l GROUP BY 1""")
def _(spark, d):
    w = ft.series()
    x = v.bars(spark, d).select((F.col("close") / F.lag("close").over(w) - 1).alias("r"), F.when(F.lag("close").over(w) > F.lag("open").over(w), 1).otherwise(-1).alias("s")).where("r is not null")
    return trades.compared(x, {"hold": 0.01 * F.col("r"), "supervisor": 0.01 * F.col("r") * F.col("s"), "half": 0.005 * F.col("r")}, 8760)


@query("s5_26_paper_kpis", f"""WITH {O}, e AS (SELECT status AS pair, arg_max(price, (ts, order_id)) AS last_equity, count(*) AS n FROM order_log GROUP BY 1), k AS (SELECT avg(CASE WHEN status = 'filled' THEN 1.0 ELSE 0 END) AS fill_rate FROM order_log) SELECT pair, round(last_equity, 4) AS last_equity, n, round(fill_rate, 6) AS fill_rate FROM e, k""")
def _(spark, d):
    o = v.order_log(spark, d)
    pairs = o.groupBy(F.col("status").alias("pair")).agg(F.round(F.max_by("price", F.struct("ts", "order_id")), 4).alias("last_equity"), F.count(F.lit(1)).alias("n"))
    return pairs.crossJoin(o.agg(F.avg((F.col("status") == "filled").cast("double")).alias("fill_rate")))  # one row


@query("s5_27_fill_stats", f"WITH {O} SELECT account % 10 AS pair, count(*) FILTER (WHERE status = 'filled') AS filled, count(*) FILTER (WHERE status = 'unfilled') AS unfilled, count(*) FILTER (WHERE status = 'cancelled') AS cancelled, round(count(*) FILTER (WHERE status = 'filled') / nullif(count(*) FILTER (WHERE status IN ('filled', 'unfilled')), 0), 6) AS fill_rate FROM order_log GROUP BY 1")
def _(spark, d):
    return trades.fill_stats(v.order_log(spark, d).withColumn("pair", F.col("account") % 10), ["pair"])


@query("s5_29_leaderboard", f"""WITH {S}, u AS (SELECT strategy, symbol, interval, avg_oos_sharpe, oos_positive_frac AS oos_pos_frac, q / 26 AS dsr, q / 52 AS pbo, NULL::DOUBLE AS port_sharpe, NULL::DOUBLE AS t_nw, CASE WHEN avg_oos_sharpe > 3 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM sweep
    UNION ALL SELECT strategy, 'portfolio_' || interval, interval, NULL, NULL, NULL, NULL, avg(sharpe), avg(sharpe) * 2, '' FROM sweep GROUP BY 1, 2, 3),
    t AS (SELECT *, CASE WHEN upper(symbol) LIKE 'PORTFOLIO%' THEN upper(symbol) ELSE replace(upper(symbol), 'USDT', '') END AS key FROM u),
    g AS (SELECT *, CASE WHEN strategy = 'pairs_arb' THEN 'rejected' WHEN port_sharpe >= 0.5 AND t_nw >= 2 THEN 'monitoring' WHEN port_sharpe >= 0.5 AND t_nw >= 1.5 THEN 'candidate' WHEN verdict = 'PASS' THEN 'paper' WHEN avg_oos_sharpe >= 0.15 AND verdict IN ('EXPLORATORY_PASS', 'FAIL') THEN 'candidate' ELSE 'rejected' END AS tier FROM t),
    s AS (SELECT *, coalesce(port_sharpe * 2, 0) + coalesce(avg_oos_sharpe, 0) + coalesce(t_nw * 0.15, 0) + coalesce(oos_pos_frac * 0.2, 0) + coalesce(dsr * 0.1, 0) + CASE WHEN pbo < 0.5 THEN 0.1 ELSE 0 END + CASE tier WHEN 'paper' THEN 4 WHEN 'monitoring' THEN 3 WHEN 'candidate' THEN 1 ELSE 0 END AS score FROM g)
    SELECT strategy, key AS symbol, interval, arg_max(tier, (score, tier)) AS tier, round(max(score), 4) AS score FROM s GROUP BY 1, 2, 3""")
def _(spark, d):
    x = v.sweep(spark, d)
    audits = x.select("strategy", "symbol", "interval", "avg_oos_sharpe", F.col("oos_positive_frac").alias("oos_pos_frac"), (F.col("q") / 26).alias("dsr"), (F.col("q") / 52).alias("pbo"), F.when(F.col("avg_oos_sharpe") > 3, "PASS").otherwise("FAIL").alias("verdict"))
    port = x.groupBy("strategy", "interval").agg(F.avg("sharpe").alias("port_sharpe")).select("strategy", F.concat(F.lit("portfolio_"), "interval").alias("symbol"), "interval", "port_sharpe", (F.col("port_sharpe") * 2).alias("t_nw"), F.lit("").alias("verdict"))
    return sweeps.leaderboard(audits.unionByName(port, allowMissingColumns=True)).withColumn("score", F.round("score", 4))


@query("s5_32_slippage", f"""WITH {FL}, x AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'chase' WHEN l_linenumber % 3 = 1 THEN 'maker' ELSE 'taker' END AS kind, CASE side WHEN 'buy' THEN price - p_retailprice ELSE p_retailprice - price END / p_retailprice * 1e4 AS bps FROM fills JOIN part ON l_partkey = p_partkey)
    SELECT 'all' AS kind, count(*) AS n, round(quantile_cont(bps, 0.5), 4) AS median_bps FROM x UNION ALL SELECT kind, count(*), round(quantile_cont(bps, 0.5), 4) FROM x GROUP BY 1""")
def _(spark, d):
    p = table(tune(spark), d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("mid"))
    kind = F.when(F.col("l_linenumber") % 3 == 0, "chase").when(F.col("l_linenumber") % 3 == 1, "maker").otherwise("taker")
    x = v.fills(spark, d).join(p, "l_partkey").select(kind.alias("kind"), n.shortfall_bps(F.col("side"), F.col("price"), F.col("mid")).alias("bps"))
    return trades.slippage(x).withColumn("median_bps", F.round("median_bps", 4))


@query("s5_33_chase_cost", f"""WITH {FL}, x AS (SELECT symbol, (l_extendedprice % 97) / 10 AS extra FROM fills), k AS (SELECT symbol, extra, row_number() OVER (PARTITION BY symbol ORDER BY extra) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM x)
    SELECT symbol, max(n) AS n, round(max(CASE WHEN k = n // 2 + 1 THEN extra END), 4) AS upper_median, max(CASE WHEN k = n // 2 + 1 THEN extra END) > 4.8 AS breach FROM k GROUP BY 1""")
def _(spark, d):
    x = v.fills(spark, d).select("symbol", (F.col("l_extendedprice") % 97 / 10).alias("extra"))
    return trades.chase_costs(x, 4.8).withColumn("upper_median", F.round("upper_median", 4))


@query("s5_35_snapshot_quality", f"""WITH {BK}, x AS (SELECT symbol, ts, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY symbol ORDER BY ts, seq) AS g FROM book)
    SELECT symbol, count(*) AS "rows", round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) AS span, round(count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6) * 3600, 6) AS per_hour, round(max(g), 3) AS max_gap, count(*) FILTER (WHERE g = 0) AS duplicates FROM x GROUP BY 1""")
def _(spark, d):
    x = ft.snapshot_quality(v.book(spark, d))
    return x.withColumn("span", F.round("span", 3)).withColumn("max_gap", F.round("max_gap", 3))


@query("s7_7_unique_winners", f"WITH {S}, k AS (SELECT *, row_number() OVER (PARTITION BY strategy, symbol ORDER BY sharpe DESC, interval, mode, days) AS k FROM sweep WHERE sharpe IS NOT NULL) SELECT {KEY}, sharpe FROM k WHERE k = 1 ORDER BY sharpe DESC, strategy, symbol LIMIT 12")
def _(spark, d):
    return sweeps.unique_winners(v.sweep(spark, d), 12).select(*KEYS, "sharpe")


@query("s7_8_recent_rows", f"WITH {O}, k AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY ts DESC, order_id DESC) AS k FROM order_log) SELECT status, order_id, {TS} FROM k WHERE k <= 20")
def _(spark, d):
    return src.recent(v.order_log(spark, d), ["status"], ["ts", "order_id"], 20).select("status", "order_id", "ts")


@query("s7_11_concatenate", f"WITH {T}, {FU} SELECT symbol, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, count(*) AS n FROM (SELECT symbol, ts FROM ticks UNION ALL SELECT symbol, ts FROM funding) GROUP BY 1, 2")
def _(spark, d):
    x = src.concatenated(v.ticks(spark, d).select("symbol", "ts", "price"), v.funding(spark, d).select("symbol", "ts", "rate"))
    return x.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("s7_14_distinct", f"WITH {S} SELECT DISTINCT strategy, interval FROM sweep")
def _(spark, d):
    return v.sweep(spark, d).select("strategy", "interval").distinct()


@query("s7_15_even_sample", f"WITH {B}, k AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), w AS (SELECT unnest(range(1, 11)) AS j) SELECT symbol, {TS} FROM k, w WHERE i = floor((n - 1) * j / 11)")
def _(spark, d):
    return src.even_sample(v.bars(spark, d), 10).select("symbol", "ts")


@query("s9_8_age_text", f"WITH {T}, a AS (SELECT symbol, CAST(floor((epoch(TIMESTAMP '2024-02-02') - epoch(max(ts))) / 3600) AS BIGINT) AS h FROM ticks GROUP BY 1) SELECT symbol, CASE WHEN h >= 48 THEN (h // 24) || 'd ' || (h % 24) || 'h' ELSE h || 'h' END AS age FROM a")
def _(spark, d):
    return v.ticks(spark, d).groupBy("symbol").agg(n.age_text(F.max("ts"), F.lit("2024-02-02").cast("timestamp")).alias("age"))


@query("s9_9_strings", f"""WITH {O} SELECT order_id, upper(trim(priority)) AS up, split_part(priority, '-', 2) AS word, starts_with(priority, '1') AS first, CAST(regexp_extract('15m', '[0-9]+') AS INTEGER) * CAST(regexp_extract(priority, '[0-9]+') AS INTEGER) AS minutes, replace(status, 'ed', '') || '/' || lower(priority) AS joined FROM order_log""")
def _(spark, d):
    number = F.regexp_extract(F.lit("15m"), "[0-9]+", 0).cast("int") * F.regexp_extract("priority", "[0-9]+", 0).cast("int")
    return v.order_log(spark, d).select("order_id", F.upper(F.trim("priority")).alias("up"), F.split_part("priority", F.lit("-"), F.lit(2)).alias("word"), F.startswith("priority", F.lit("1")).alias("first"), number.alias("minutes"), F.concat_ws("/", F.replace("status", F.lit("ed"), F.lit("")), F.lower("priority")).alias("joined"))


@query("s9_12_maps", f"WITH {O} SELECT status, count(*) AS n, round(sum(CASE status WHEN 'filled' THEN 1.0 WHEN 'unfilled' THEN 0.5 ELSE 0.1 END)::DOUBLE, 6) AS weight FROM order_log GROUP BY 1")
def _(spark, d):
    weights = F.create_map(F.lit("filled"), F.lit(1.0), F.lit("unfilled"), F.lit(0.5))
    return v.order_log(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.element_at(weights, F.col("status")), F.lit(0.1))).alias("weight"))


@query("s9_13_fingerprint", f"WITH {S} SELECT {KEY}, sha256('{{\"days\":' || days || ',\"interval\":\"' || interval || '\",\"strategy\":\"' || strategy || '\"}}') AS print FROM sweep")
def _(spark, d):
    return v.sweep(spark, d).select(*KEYS, n.fingerprint("days", "interval", "strategy").alias("print"))


@query("s9_14_money", f"WITH {FL} SELECT symbol, CAST(sum(CAST(qty AS DECIMAL(18, 2)) * CAST(l_extendedprice AS DECIMAL(18, 2))) AS VARCHAR) AS notional FROM fills GROUP BY 1")
def _(spark, d):
    return v.fills(spark, d).groupBy("symbol").agg(F.sum(n.money(F.col("qty"), 2) * n.money(F.col("l_extendedprice"), 2)).cast("decimal(38,4)").cast("string").alias("notional"))


@query("s9_15_costs", f"""WITH {B} SELECT symbol, {TS}, round((0.0005 + 0.0001 * greatest(1, (high - low) / close)) * 1e4, 6) AS taker_bps, round(2 * (0.0005 + 0.0001) * 1e4, 6) AS breakeven_bps, round(least(1.5, greatest(0, 0.5 * (0.002 / nullif(((high - low) / close) ** 2, 0)))), 6) AS kelly, round(100 * greatest(0.25, 1 - 0.5 * least(1, (high - low) / close)), 6) AS size FROM bars""")
def _(spark, d):
    span = (F.col("high") - F.col("low")) / F.col("close")
    return v.bars(spark, d).select("symbol", "ts", (n.taker_cost(0.0005, 1.0, span) * 1e4).alias("taker_bps"), F.lit(n.trade_cost(0.0005, 1.0) * 1e4).alias("breakeven_bps"), n.kelly_variance(F.lit(0.002), span**2, 0.5, 1.5).alias("kelly"), n.scaled_size(F.lit(100.0), F.least(F.lit(1.0), span), 0.25).alias("size"))


@query("s9_19_excursions", f"""WITH {B}, t AS (SELECT symbol, trade_id, ts AS a, ts + INTERVAL 6 hour AS z, price, CASE side WHEN 'buy' THEN 1 ELSE -1 END AS s FROM ticks), e AS (SELECT t.symbol, t.trade_id, any_value(price) AS p, any_value(s) AS s, min(low) AS lo, max(high) AS hi FROM t JOIN bars b ON b.symbol = t.symbol AND b.ts BETWEEN a AND z GROUP BY 1, 2)
    SELECT symbol, trade_id, round(greatest(0, CASE WHEN s > 0 THEN hi / p - 1 ELSE 1 - lo / p END), 6) AS mfe, round(greatest(0, CASE WHEN s > 0 THEN 1 - lo / p ELSE hi / p - 1 END), 6) AS mae FROM e""")
def _(spark, d):
    t = v.ticks(spark, d).select("symbol", "trade_id", "price", "side", F.col("ts").alias("a"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("z"))
    x = joins.range_join(t, v.bars(spark, d).select("symbol", "ts", "low", "high"), "a", "z").groupBy("symbol", "trade_id").agg(F.first("price").alias("p"), F.first("side").alias("s"), F.min("low").alias("lo"), F.max("high").alias("hi"))
    mfe, mae = n.excursions(F.col("p"), F.col("hi"), F.col("lo"), F.col("s") == "sell")
    return x.select("symbol", "trade_id", mfe.alias("mfe"), mae.alias("mae"))


@query("s9_20_bar_clock", f"WITH {T} SELECT symbol, trade_id, CAST((epoch_us(ts) // 14400000000 + 1) * 14400 AS BIGINT) AS next_close, CAST(ceil(amount / 4) AS BIGINT) AS bars FROM ticks")
def _(spark, d):
    return v.ticks(spark, d).select("symbol", "trade_id", F.window("ts", "4 hours")["end"].alias("next_close"), n.hours_to_bars(F.col("amount"), 4.0).alias("bars"))
