"""Queries on evaluation tables, calibration, further signals and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream import views as v
from lodestream.operators import evaluation as ev
from lodestream.operators import features as ft
from lodestream.operators import joins, resample, signals, stats
from lodestream.operators.scan import ewma_variance
from lodestream.plans.market import BK, LEGS, TS, B, C, FU, T, _r, _recursive, legs
from lodestream.plans.registry import query
from lodestream.plans.research import HELD, ORDER, PNL, TIE, _pnl
from lodestream.session import tune
from lodestream.streaming import streams


@query("s2_7_holdout", f"""WITH {B}, x AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
    SELECT symbol, CASE WHEN i > n - floor(n * 0.2) THEN 'holdout' ELSE 'research' END AS part, count(*) AS n, round(avg(close), 6) AS mean FROM x GROUP BY 1, 2""")
def _(spark, d):
    return ev.holdout(v.bars(spark, d), 0.2).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean"))


@query("s3_4_fused_asof", f"""WITH {B}, {FU}, i AS (SELECT symbol, time_bucket(INTERVAL 15 minute, ts) AS ts, sum(amount) AS flow FROM ticks GROUP BY 1, 2), x AS (SELECT b.symbol, b.ts, b.close, i.flow AS event_flow FROM bars b ASOF LEFT JOIN i ON b.symbol = i.symbol AND b.ts >= i.ts)
    SELECT x.symbol, CAST(epoch(x.ts) AS BIGINT) AS ts, close, event_flow, round(rate * 1e6, 3) AS event_rate FROM x ASOF LEFT JOIN funding f ON x.symbol = f.symbol AND x.ts >= f.ts""")
def _(spark, d):
    flow = v.ticks(spark, d).groupBy("symbol", F.window("ts", "15 minutes")["start"].alias("ts")).agg(F.sum("amount").alias("flow"))
    x = joins.asof_join(v.bars(spark, d).select("symbol", "ts", "close"), flow, cols=["flow"])
    return joins.asof_join(x, v.funding(spark, d), cols=["rate"], tie="seq").withColumn("event_rate", F.round(F.col("event_rate") * 1e6, 3))


@query("s3_16_entry_features", f"""WITH {B}, {C} SELECT c.symbol, CAST(epoch(c.entry_ts + INTERVAL 25 year) AS BIGINT) AS ts, {', '.join(x if x not in ('entry_ts', 'exit_ts') else f'CAST(epoch(c.{x}) AS BIGINT) AS {x}' for x in ORDER)}, side, ret,
    round(b.close, 6) AS entry_close, round(b.volume, 6) AS entry_volume FROM closed c LEFT JOIN bars b ON b.symbol = c.symbol AND b.ts = c.entry_ts + INTERVAL 25 year""")
def _(spark, d):
    b = v.bars(spark, d).select("symbol", "ts", F.col("close").alias("entry_close"), F.col("volume").alias("entry_volume"))
    c = v.closed_trades(spark, d).select("symbol", *ORDER, "side", "ret", (F.col("entry_ts") + F.expr("INTERVAL 25 YEARS")).alias("ts"))
    return c.join(joins.small(b), ["symbol", "ts"], "left")  # trades are not dealt a second time for the bars


@query("s3_29_cluster_room", """WITH p AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS size, unnest([o_custkey % 300, 300 + o_custkey % 7]) AS leg FROM orders), u AS (SELECT leg, sum(size) AS used FROM p GROUP BY 1), r AS (SELECT id, size, max(used) AS used FROM p JOIN u USING (leg) GROUP BY 1, 2)
    SELECT id, round(used, 2) AS used, round(greatest(0, least(1, (9e7 - used + size) / size)), 6) AS room FROM r""")
def _(spark, d):
    from lodestream.session import table

    p = table(tune(spark), d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("size"), F.array(F.col("o_custkey") % 300, F.col("o_custkey") % 7 + 300).alias("legs"))
    return joins.shortfall_room(p, 9e7).withColumn("used", F.round("used", 2))


@query("s4_7_dollar_bars", f"""WITH {T}, c AS (SELECT *, floor(sum(price * amount) OVER (PARTITION BY symbol ORDER BY ts, trade_id) / 50000.5) AS bar FROM ticks) SELECT symbol, CAST(bar AS BIGINT) AS bar, count(*) AS n, round(sum(price * amount), 4) AS dollars FROM c GROUP BY 1, 2""")
def _(spark, d):
    return resample.activity_bars(v.ticks(spark, d), 50000.5, dollars=True).select("symbol", "bar", "n", F.round("dollars", 4).alias("dollars"))


@query("s4_15_bars_from_cuts", f"""WITH {T}, c AS (SELECT *, coalesce(sum(CASE WHEN amount >= 95 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bar FROM ticks)
    SELECT symbol, CAST(bar AS BIGINT) AS bar, {TS.replace("epoch(ts)", "epoch(max(ts))")}, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(amount) AS volume FROM c GROUP BY 1, 2""")
def _(spark, d):
    return resample.bars_from_cuts(v.ticks(spark, d), F.col("amount") >= 95).drop("dollars")


@query("s5_19_regime_map", f"""WITH {B}, {HELD}, x AS (SELECT symbol, ts, sig, CASE WHEN volume > avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING) THEN 'busy' ELSE 'calm' END AS label, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS r FROM sig),
    y AS (SELECT label, 'reversion' AS strategy, sig * r AS ret FROM x WHERE r IS NOT NULL UNION ALL SELECT label, 'long', r FROM x WHERE r IS NOT NULL), g AS (SELECT label, strategy, count(*) AS n, avg(ret) / nullif(stddev_pop(ret), 0) AS sharpe FROM y GROUP BY 1, 2)
    SELECT label, strategy, n, round(sharpe, 6) AS sharpe, CAST(row_number() OVER (PARTITION BY label ORDER BY sharpe DESC, strategy) AS INTEGER) AS rank, round(coalesce(greatest(sharpe, 0) / nullif(sum(greatest(sharpe, 0)) OVER (PARTITION BY label), 0), 0), 6) AS weight FROM g""")
def _(spark, d):
    x = signals.zscore_reversion(v.bars(spark, d))
    x = x.withColumn("label", F.when(F.col("volume") > F.avg("volume").over(ft.last_n(24)), "busy").otherwise("calm")).withColumn("r", F.lead("close").over(ft.series()) / F.col("close") - 1).where("r is not null")
    long = x.select("label", F.explode(F.array(F.struct(F.lit("reversion").alias("strategy"), (F.col("sig") * F.col("r")).alias("ret")), F.struct(F.lit("long").alias("strategy"), F.col("r").alias("ret")))).alias("s")).select("label", "s.*")
    return ev.regime_map(long, 1)


@query("s6_34_ewma_volatility", _recursive("(close / 100) * (close / 100) AS v", "0.94 * r.v + 0.06 * (n.close / 100) * (n.close / 100)", "round(sqrt(v), 6) AS vol"))
def _(spark, d):
    x = ewma_variance(v.bars(spark, d).withColumn("x", F.col("close") / 100), "x", 0.94)
    return x.select("symbol", "ts", F.sqrt("ewma_var").alias("vol"))


@query("s6_38_hawkes", f"""WITH {T} SELECT a.symbol, a.trade_id, round(sum(exp(-0.001 * (epoch(a.ts) - epoch(b.ts)))), 6) AS intensity FROM ticks a JOIN ticks b ON a.symbol = b.symbol AND b.ts <= a.ts GROUP BY 1, 2""")
def _(spark, d):
    return ev.hawkes(v.ticks(spark, d), 0.001).select("symbol", "trade_id", "intensity")


@query("s6_48_day_coverage", f"""WITH {T}, x AS (SELECT symbol, date_trunc('day', ts) AS day, epoch(max(ts)) - epoch(min(ts)) AS span, count(*) AS n, max(trade_id) - min(trade_id) + 1 AS ids FROM ticks GROUP BY 1, 2) SELECT symbol, CAST(epoch(day) AS BIGINT) AS day, n, span >= 72000 AS whole, round(n / ids, 6) AS coverage FROM x""")
def _(spark, d):
    x = v.ticks(spark, d).groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("span"), (F.max("trade_id") - F.min("trade_id") + 1).alias("ids"))
    return x.select("symbol", "day", "n", (F.col("span") >= 72000).alias("whole"), (F.col("n") / F.col("ids")).alias("coverage"))


@query("s7_9_without_best", f"WITH {C}, k AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ret DESC, {TIE}) AS k FROM closed) SELECT symbol, round(sum(ret), 6) AS total, round(sum(CASE WHEN k > 50 THEN ret ELSE 0 END), 6) AS without_best FROM k GROUP BY 1")
def _(spark, d):
    return ev.without_best(v.closed_trades(spark, d), 50, ["symbol"], ORDER)


@query("s8_12_book_calibration", f"WITH {BK}, x AS (SELECT symbol, (ask - bid) / ((ask + bid) / 2) * 1e4 AS bps, least(bid_qty, ask_qty) AS q FROM book) SELECT symbol, round(quantile_cont(bps, 0.5), 6) AS p50, round(quantile_cont(bps, 0.9), 6) AS p90, quantile_cont(q, 0.5) AS qty FROM x GROUP BY 1")
def _(spark, d):
    x = v.book(spark, d).select("symbol", ((F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) * 1e4).alias("bps"), F.least("bid_qty", "ask_qty").alias("q"))
    return x.groupBy("symbol").agg(F.percentile("bps", F.lit(0.5)).alias("p50"), F.percentile("bps", F.lit(0.9)).alias("p90"), F.percentile("q", F.lit(0.5)).alias("qty"))


@query("s8_13_micro_price", f"WITH {BK} SELECT symbol, seq, round((bid * ask_qty + ask * bid_qty) / (bid_qty + ask_qty), 5) AS micro, round((bid_qty - ask_qty) / (bid_qty + ask_qty), 6) AS imbalance FROM book")
def _(spark, d):
    q = F.col("bid_qty") + F.col("ask_qty")
    return v.book(spark, d).select("symbol", "seq", F.round((F.col("bid") * F.col("ask_qty") + F.col("ask") * F.col("bid_qty")) / q, 5).alias("micro"), ((F.col("bid_qty") - F.col("ask_qty")) / q).alias("imbalance"))


@query("s11_12_momentum", f"""WITH {B}, m AS (SELECT symbol, ts, close / lag(close, 24) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS m FROM bars), q AS (SELECT *, list_filter(list(m) OVER (PARTITION BY symbol ORDER BY ts ROWS 95 PRECEDING), lambda e: e IS NOT NULL) AS l FROM m),
    k AS (SELECT *, list_aggregate(l, 'quantile_cont', 0.2) AS lo, list_aggregate(l, 'quantile_cont', 0.8) AS hi, len(l) AS c FROM q) SELECT symbol, {TS}, CAST(CASE WHEN c < 24 OR m IS NULL THEN 0 WHEN m > hi THEN 1 WHEN m < lo THEN -1 ELSE 0 END AS DOUBLE) AS sig FROM k""")
def _(spark, d):
    return signals.momentum(v.bars(spark, d)).select("symbol", "ts", "sig")


@query("s13_7_pairs_pnl", LEGS + f""", x AS (SELECT ts, ln(c1 / c2) AS s, ln(c1 / c2) - avg(ln(c1 / c2)) OVER (ORDER BY ts ROWS 47 PRECEDING) AS dv FROM p), y AS (SELECT *, coalesce(lag(-sign(dv)) OVER (ORDER BY ts), 0) AS pos, s - lag(s) OVER (ORDER BY ts) AS ds FROM x),
    z AS (SELECT *, abs(pos - coalesce(lag(pos) OVER (ORDER BY ts), 0)) AS t FROM y) SELECT {TS}, CAST(pos AS DOUBLE) AS pos, round(pos * coalesce(ds, 0) - 2 * t * 0.0004, 6) AS ret FROM z""")
def _(spark, d):
    w = Window.partitionBy("symbol").orderBy("ts")
    x = legs(spark, d).withColumn("symbol", F.lit("pair")).withColumn("s", F.ln(F.col("c1") / F.col("c2")))
    x = x.withColumn("dv", F.col("s") - F.avg("s").over(ft.last_n(48))).withColumn("pos", F.coalesce(F.lag(-F.signum("dv")).over(w), F.lit(0.0))).withColumn("ds", F.coalesce(F.col("s") - F.lag("s").over(w), F.lit(0.0)))
    x = x.withColumn("t", F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0.0))))
    return x.select("ts", (F.col("pos") + 0.0).alias("pos"), (F.col("pos") * F.col("ds") - 2 * F.col("t") * 0.0004).alias("ret"))


@query("s13_17_capacity", PNL.replace("SELECT symbol, ts, close, coalesce(lag(sig)", "SELECT symbol, ts, close, volume, coalesce(lag(sig)") + """, cc AS (SELECT *, unnest([1.0, 10.0, 100.0]) AS scale FROM eq), r2 AS (SELECT symbol, scale, ret - 0.001 * turnover * sqrt(turnover * scale / nullif(volume, 0)) AS r FROM cc)
    SELECT symbol, CAST(scale AS DOUBLE) AS scale, round(avg(r), 6) AS mean, round(avg(r) / nullif(stddev_pop(r), 0) * sqrt(count(*)), 6) AS sharpe FROM r2 GROUP BY 1, 2""")
def _(spark, d):
    return ev.capacity_curve(_pnl(spark, d), (1, 10, 100), 0.001)


@query("s13_19_stress", PNL + """, ss AS (SELECT *, sum(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING) AS s, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM eq), w AS (SELECT symbol, arg_min(i, s) AS z FROM ss WHERE i >= 24 GROUP BY 1)
    SELECT symbol, round(sum(ret), 6) AS base, round(sum(CASE WHEN i <= z AND i > z - 24 THEN ret * 2 ELSE ret END), 6) AS worst_window, round(sum(ret - turnover * 0.001), 6) AS costs FROM ss JOIN w USING (symbol) GROUP BY 1""")
def _(spark, d):
    return ev.stress(_pnl(spark, d), 24, 2.0, 0.001)


@query("s13_28_tracking", f"WITH {B}, x AS (SELECT symbol, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS a, ln(open / lag(open) OVER (PARTITION BY symbol ORDER BY ts)) AS b FROM bars) SELECT symbol, count(*) AS n, round(stddev_pop(a - b), 6) AS tracking_error, round(corr(a, b), 6) AS rho FROM x GROUP BY 1")
def _(spark, d):
    b = v.bars(spark, d)
    return ev.tracking(b.select("symbol", "ts", ft.log_ret("close").alias("ret")), b.select("symbol", "ts", ft.log_ret("open").alias("ret")))


@query("s13_33_exposure", f"WITH {B}, g AS (SELECT ts, sum(close * volume) AS gross, max(close * volume) AS largest FROM bars GROUP BY 1) SELECT {TS}, round(gross, 4) AS gross, round(gross / 10000, 6) AS leverage, round(largest / gross, 6) AS top_share, gross / 10000 > 2 OR largest / gross > 0.6 AS broken FROM g")
def _(spark, d):
    return ev.exposure(v.bars(spark, d).withColumn("notional", F.col("close") * F.col("volume")), 10000.0, 2.0, 0.6).withColumn("gross", F.round("gross", 4))


@query("s10_7_stream_sliding", f"""WITH {T}, m AS (SELECT max(ts) AS z FROM ticks), w AS (SELECT symbol, amount, unnest(generate_series(time_bucket(INTERVAL 30 minute, ts) + INTERVAL 30 minute, time_bucket(INTERVAL 30 minute, ts) + INTERVAL 60 minute, INTERVAL 30 minute)) AS ts FROM ticks)
    SELECT symbol, {TS}, round(sum(amount), 6) AS total FROM w, m WHERE w.ts <= z - INTERVAL 10 minute GROUP BY symbol, w.ts""".replace("epoch(ts)", "epoch(w.ts)"))
def _(spark, d):
    tune(spark)
    return streams.run_to_table(streams.sliding_sum(streams.ticks(spark, d), "1 hour", "30 minutes", "10 minutes"), "stream-sliding")


@query("s10_8_stream_sessions", f"""WITH {T}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 hour THEN 0 ELSE 1 END AS ch FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts)), s AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY ts) AS s FROM g), m AS (SELECT max(ts) AS z FROM ticks)
    SELECT symbol, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts) + INTERVAL 1 hour)) AS BIGINT) AS "end", count(*) AS n, sum(amount) AS amount FROM s, m GROUP BY symbol, s, z HAVING max(ts) + INTERVAL 1 hour <= z - INTERVAL 10 minute""")
def _(spark, d):
    tune(spark)
    return streams.run_to_table(streams.sessions(streams.ticks(spark, d), "1 hour", "10 minutes"), "stream-sessions")


@query("s8_7_rank_correlation", f"""WITH {B}, x AS (SELECT symbol, volume AS a, high / low AS b FROM bars), r AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY a) + (count(*) OVER (PARTITION BY symbol, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY symbol ORDER BY b) + (count(*) OVER (PARTITION BY symbol, b) - 1) / 2 AS rb FROM x)
    SELECT symbol, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY 1""")
def _(spark, d):
    return stats.rank_correlation(v.bars(spark, d).withColumn("b", F.col("high") / F.col("low")), "volume", "b", ["symbol"])


@query("s8_23_bootstrap")
def _(spark, d):
    return stats.bootstrap_sharpe(v.bars(spark, d).withColumn("r", ft.log_ret("close")), "r", 100, 24)


@query("s13_29_rebalanced_portfolio", f"""WITH {B}, r AS (SELECT symbol, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM bars), p AS (SELECT ts, sum(0.125 * coalesce(r, 0)) AS gross FROM r GROUP BY 1), f AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts) = 1 AS first FROM p)
    SELECT {TS}, round(gross - CASE WHEN first THEN 0.0005 ELSE 0 END, 6) AS ret FROM f""")
def _(spark, d):
    x = v.bars(spark, d).withColumn("r", ft.log_ret("close")).groupBy("ts").agg(F.sum(0.125 * F.coalesce("r", F.lit(0.0))).alias("gross"))
    day = Window.partitionBy(F.date_trunc("day", "ts")).orderBy("ts")
    return x.withColumn("first", F.row_number().over(day) == 1).select("ts", (F.col("gross") - F.when(F.col("first"), 0.0005).otherwise(0.0)).alias("ret"))


@query("s13_31_volatility_target", f"""WITH {B}, r AS (SELECT symbol, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM bars), v AS (SELECT symbol, ts, CASE WHEN count(r) OVER w >= 20 THEN stddev_pop(r) OVER w END AS vol FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING))
    SELECT symbol, {TS}, round(least(3, 0.5 / nullif(lag(vol) OVER (PARTITION BY symbol ORDER BY ts), 0)), 6) AS scale FROM v""")
def _(spark, d):
    x = v.bars(spark, d).withColumn("r", ft.log_ret("close"))
    x = x.withColumn("vol", F.when(F.count("r").over(ft.last_n(24)) >= 20, F.stddev_pop("r").over(ft.last_n(24)))).withColumn("vol", F.lag("vol").over(ft.series()))
    return x.select("symbol", "ts", F.least(F.lit(3.0), 0.5 / F.nullif("vol", F.lit(0.0))).alias("scale"))
