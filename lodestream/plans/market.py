"""Queries on scans, joins, bars and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream import views as v
from lodestream.functions import numbers as n
from lodestream.operators import features as ft
from lodestream.operators import joins, resample
from lodestream.operators.scan import ema, garch_variance
from lodestream.plans.registry import query
from lodestream.session import settle, table, tune
from lodestream.sources import tables as src

T, B, FU, BK, C, O, FL = v.TICKS, v.BARS, v.FUNDING, v.BOOK, v.CLOSED, v.ORDER_LOG, v.FILLS  # noqa: E741
E = "CAST(floor(epoch({0})) AS BIGINT) AS {0}"
TS = E.format("ts")


def _r(*names: str) -> str:
    return ", ".join(f"round({x}, 6) AS {x}" for x in names)


@query("s1_1_sql_over_parquet", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events WHERE value > 10 GROUP BY event_type")
def _(spark, d):
    return src.query_parquet(tune(spark), "SELECT event_type, count(*) AS n, avg(value) AS avg_value FROM t WHERE value > :least GROUP BY event_type", {"t": f"{d}/events.parquet"}, {"least": 10})


@query("s1_18_symbol_stats", f"WITH {T} SELECT symbol, count(*) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_ts, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_ts FROM ticks GROUP BY symbol")
def _(spark, d):
    return src.symbol_stats(v.ticks(spark, d))


@query("s1_19_inventory", f"""WITH {T}, s AS (SELECT symbol, max(ts) AS last_ts FROM ticks GROUP BY 1)
    SELECT symbol, date_diff('hour', last_ts, TIMESTAMP '2024-01-31') AS age_hours, CASE WHEN date_diff('hour', last_ts, TIMESTAMP '2024-01-31') <= 24 THEN 'fresh'
    WHEN date_diff('hour', last_ts, TIMESTAMP '2024-01-31') <= 72 THEN 'aging' ELSE 'stale' END AS state FROM s""")
def _(spark, d):
    x = src.inventory(v.ticks(spark, d).withColumn("ts", F.date_trunc("hour", "ts")), "2024-01-31")
    return x.select("symbol", "age_hours", "state")


@query("s1_23_upsert", f"""WITH {O}, r AS (SELECT account, status, price, ts, order_id, row_number() OVER (PARTITION BY account, status ORDER BY ts DESC, order_id DESC) AS k FROM order_log)
    SELECT account, status, round(price, 6) AS price, {TS}, order_id FROM r WHERE k = 1""")
def _(spark, d):
    o = v.order_log(spark, d).select("account", "status", "price", "ts", "order_id")
    return src.upsert(o.where("order_id % 2 = 0"), o.where("order_id % 2 = 1"), ["account", "status"], ["ts", "order_id"])


ASOF = f"WITH {T}, {FU} SELECT t.symbol, CAST(floor(epoch(t.ts)) AS BIGINT) AS ts, t.trade_id, round(t.price, 6) AS price, round(f.rate, 9) AS event_rate FROM ticks t ASOF LEFT JOIN funding f ON t.symbol = f.symbol AND t.ts >= f.ts"


@query("s3_1_asof", ASOF.replace("round(f.rate, 9)", "round(f.rate * 1e6, 3)"))
def _(spark, d):
    t = v.ticks(spark, d).select("symbol", "ts", "trade_id", "price")
    x = joins.asof_join(t, v.funding(spark, d), cols=["rate"], tie="seq")
    return x.withColumn("event_rate", F.round(F.col("event_rate") * 1e6, 3))


@query("s3_3_align_imbalance", f"""WITH {BK}, i AS (SELECT symbol, time_bucket(INTERVAL 15 minute, ts) AS ts, avg((bid_qty - ask_qty) / (bid_qty + ask_qty)) AS imb FROM book GROUP BY 1, 2),
    bars AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_max(price, ts) AS close FROM ticks GROUP BY 1, 2)
    SELECT b.symbol, CAST(floor(epoch(b.ts)) AS BIGINT) AS ts, round(close, 6) AS close, round(imb, 6) AS event_imb FROM bars b ASOF LEFT JOIN i ON b.symbol = i.symbol AND b.ts >= i.ts""")
def _(spark, d):
    b = v.book(spark, d).groupBy("symbol", F.window("ts", "15 minutes")["start"].alias("ts")).agg(F.avg((F.col("bid_qty") - F.col("ask_qty")) / (F.col("bid_qty") + F.col("ask_qty"))).alias("imb"))
    return joins.asof_join(v.bars(spark, d).select("symbol", "ts", "close"), b, cols=["imb"])


@query("s3_6_higher_timeframe", f"""WITH {B}, h AS (SELECT symbol, date_trunc('day', ts) + INTERVAL 1 day AS closed, arg_max(close, ts) AS day_close FROM bars GROUP BY symbol, date_trunc('day', ts))
    SELECT b.symbol, CAST(floor(epoch(b.ts)) AS BIGINT) AS ts, round(close, 6) AS close, round(day_close, 6) AS htf_day_close FROM bars b ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.ts >= h.closed""")
def _(spark, d):
    b = v.bars(spark, d)
    days = resample.coarsen(b, "1 day").select("symbol", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("closed"), F.col("close").alias("day_close"))
    return joins.asof_join(b.select("symbol", "ts", "close"), days, right_on="closed", cols=["day_close"], prefix="htf_")


@query("s3_7_funding_to_bars", f"""WITH {B}, {FU}, m AS (SELECT f.symbol, b.ts, sum(f.rate) AS rate, count(*) AS n FROM funding f ASOF JOIN bars b ON f.symbol = b.symbol AND f.ts >= b.ts GROUP BY 1, 2)
    SELECT symbol, {TS}, round(rate * 1e6, 3) AS rate, n FROM m""")
def _(spark, d):
    x = joins.asof_join(v.funding(spark, d), v.bars(spark, d).select("symbol", "ts"), cols=["ts"], prefix="bar_").where("bar_ts is not null")
    return x.groupBy("symbol", F.col("bar_ts").alias("ts")).agg(F.round(F.sum("rate") * 1e6, 3).alias("rate"), F.count(F.lit(1)).alias("n"))


@query("s3_9_nearest_price", f"""WITH {B}, {FU}, x AS (SELECT f.symbol, f.ts, f.seq, b.ts AS bt, b.close AS bc FROM funding f ASOF LEFT JOIN bars b ON f.symbol = b.symbol AND f.ts >= b.ts),
    y AS (SELECT x.*, b.ts AS nt, b.close AS ac FROM x ASOF LEFT JOIN bars b ON x.symbol = b.symbol AND x.ts <= b.ts)
    SELECT symbol, seq, round(CASE WHEN bt IS NULL OR abs(epoch_us(nt) - epoch_us(ts)) < abs(epoch_us(bt) - epoch_us(ts)) THEN ac ELSE bc END, 6) AS near_close FROM y""")
def _(spark, d):
    return joins.nearest_join(v.funding(spark, d), settle(v.bars(spark, d).select("symbol", "ts", "close"), "bars"), "ts", ["symbol"], ["close"]).select("symbol", "seq", "near_close")


LEGS = f"WITH {B}, p AS (SELECT a.ts, a.close AS c1, b.close AS c2, a.high AS l1_high, b.low AS l2_low FROM bars a JOIN bars b USING (ts) WHERE a.symbol = 'S0' AND b.symbol = 'S1')"


def legs(spark, d, a="S0", b="S1"):
    x = v.bars(spark, d)
    one = x.where(F.col("symbol") == a).select("ts", F.col("close").alias("c1"), F.col("high").alias("l1_high"))
    two = x.where(F.col("symbol") == b).select("ts", F.col("close").alias("c2"), F.col("low").alias("l2_low"))
    return one.join(two, "ts")


@query("s3_10_legs_and_basis", LEGS + f" SELECT {TS}, {_r('c1', 'c2', 'l1_high', 'l2_low')}, round(c1 / c2 - 1, 6) AS basis FROM p")
def _(spark, d):
    return legs(spark, d).withColumn("basis", F.col("c1") / F.col("c2") - 1)


@query("s3_13_all_pairs", f"WITH {B} SELECT a.symbol AS s1, b.symbol AS s2, count(*) AS n, round(corr(a.close, b.close), 6) AS rho FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1, 2 HAVING count(*) >= 80")
def _(spark, d):
    x = v.bars(spark, d).select("ts", "symbol", "close")
    y = x.select("ts", F.col("symbol").alias("s2"), F.col("close").alias("c2"))
    return x.join(y, "ts").where("symbol < s2").groupBy(F.col("symbol").alias("s1"), "s2").agg(F.count(F.lit(1)).alias("n"), F.corr("close", "c2").alias("rho")).where("n >= 80")


@query("s3_14_trade_range", f"""WITH {B}, t AS (SELECT symbol, trade_id, ts AS a, ts + INTERVAL 6 hour AS z, price FROM ticks)
    SELECT t.symbol, t.trade_id, round(min(low), 6) AS min_low, round(max(high), 6) AS max_high FROM t JOIN bars b ON b.symbol = t.symbol AND b.ts BETWEEN a AND z GROUP BY 1, 2""")
def _(spark, d):
    t = v.ticks(spark, d).select("symbol", "trade_id", F.col("ts").alias("a"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("z"))
    x = joins.range_join(t, v.bars(spark, d).select("symbol", "ts", "low", "high"), "a", "z")
    return x.groupBy("symbol", "trade_id").agg(F.min("low").alias("min_low"), F.max("high").alias("max_high"))


@query("s3_17_news_window", f"""WITH {T}, w AS (SELECT symbol, ts - INTERVAL 10 minute AS a, ts + INTERVAL 10 minute AS z FROM ticks WHERE amount >= 99)
    SELECT symbol, trade_id, round(price, 6) AS price FROM ticks t WHERE EXISTS (SELECT 1 FROM w WHERE w.symbol = t.symbol AND t.ts BETWEEN w.a AND w.z)""")
def _(spark, d):
    t = v.ticks(spark, d)
    w = t.where("amount >= 99").select("symbol", (F.col("ts") - F.expr("INTERVAL 10 MINUTES")).alias("a"), (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("z"))
    return joins.range_join(w, t, "a", "z", bucket_seconds=1200, how="left_semi").select("symbol", "trade_id", "price")


@query("s3_20_grid_resume", f"""WITH {B}, s AS (SELECT DISTINCT symbol FROM bars), g AS (SELECT s.symbol, a.x AS entry, b.x AS win FROM s, (VALUES (1), (2), (3)) a(x), (VALUES (12), (24)) b(x))
    SELECT * FROM g WHERE NOT (symbol = 'S0' AND entry = 2)""")
def _(spark, d):
    s = v.bars(spark, d).select("symbol").distinct()
    grid = s.withColumn("entry", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("win", F.explode(F.array(F.lit(12), F.lit(24))))
    done = s.where("symbol = 'S0'").withColumn("entry", F.lit(2))
    return grid.join(done, ["symbol", "entry"], "left_anti")


@query("s3_23_burned_windows", f"""WITH {C}, w AS (SELECT symbol, min(entry_ts) AS a, min(entry_ts) + INTERVAL 200 day AS z FROM closed GROUP BY 1)
    SELECT l_suppkey, count(*) AS n FROM closed c WHERE EXISTS (SELECT 1 FROM w WHERE w.symbol = c.symbol AND c.entry_ts <= w.z AND c.exit_ts >= w.a) GROUP BY 1""")
def _(spark, d):
    c = v.closed_trades(spark, d).select("symbol", "entry_ts", "exit_ts", "l_suppkey")
    w = c.groupBy("symbol").agg(F.min("entry_ts").alias("entry_ts")).withColumn("exit_ts", F.col("entry_ts") + F.expr("INTERVAL 200 DAYS"))
    return joins.overlapping(c, w, ["symbol"], "entry_ts", "exit_ts").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("s3_27_reconcile", f"""WITH {FL}, a AS (SELECT symbol || '-' || (l_partkey % 40) AS k, sum(CASE side WHEN 'buy' THEN qty ELSE -qty END) AS q FROM fills WHERE l_linenumber < 4 GROUP BY 1),
    b AS (SELECT symbol || '-' || (l_partkey % 40) AS k, sum(CASE side WHEN 'buy' THEN qty ELSE -qty END) AS q FROM fills WHERE l_linenumber > 1 AND l_partkey % 40 < 35 GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, a.q AS here, b.q AS there, CASE WHEN a.q IS NULL THEN 'missing here' WHEN b.q IS NULL THEN 'missing there' WHEN sign(a.q) <> sign(b.q) THEN 'side'
    WHEN abs(a.q - b.q) > 1e-9 THEN 'size' ELSE 'ok' END AS reason FROM a FULL JOIN b USING (k)""")
def _(spark, d):
    f = v.fills(spark, d).withColumn("k", F.concat_ws("-", "symbol", F.col("l_partkey") % 40))
    net = lambda x, name: x.groupBy("k").agg(F.sum(F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))).alias(name))
    x = net(f.where("l_linenumber < 4"), "here").join(net(f.where("l_linenumber > 1 and l_partkey % 40 < 35"), "there"), "k", "full")
    reason = F.when(F.col("here").isNull(), "missing here").when(F.col("there").isNull(), "missing there").when(F.signum("here") != F.signum("there"), "side").when(F.abs(F.col("here") - F.col("there")) > 1e-9, "size")
    return x.withColumn("reason", reason.otherwise("ok"))


@query("s4_1_resample", f"WITH {B} SELECT symbol, {TS}, {_r('open', 'high', 'low', 'close', 'volume')} FROM bars")
def _(spark, d):
    return v.bars(spark, d)


@query("s4_2_resample_week_whole", f"""WITH {B}, w AS (SELECT symbol, time_bucket(INTERVAL 7 day, ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY symbol, time_bucket(INTERVAL 7 day, ts)),
    m AS (SELECT symbol, max(ts) + INTERVAL 1 hour AS z FROM bars GROUP BY 1)
    SELECT symbol, {TS}, {_r('open', 'high', 'low', 'close', 'volume')} FROM w JOIN m USING (symbol) WHERE ts + INTERVAL 7 day <= z""")
def _(spark, d):
    return resample.coarsen(v.bars(spark, d), "7 days", whole="1 HOUR")


@query("s4_5_infer_interval", f"WITH {B}, g AS (SELECT symbol, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY symbol ORDER BY ts) AS s FROM bars) SELECT symbol, quantile_cont(s, 0.5) AS step FROM g GROUP BY 1")
def _(spark, d):
    x = v.bars(spark, d).withColumn("s", F.unix_seconds("ts") - F.lag(F.unix_seconds("ts")).over(ft.series()))
    return x.groupBy("symbol").agg(F.percentile("s", 0.5).alias("step"))


@query("s4_6_book_bars", f"""WITH {BK}, x AS (SELECT *, (bid + ask) / 2 AS mid, (ask - bid) / ((bid + ask) / 2) * 1e4 AS bps FROM book)
    SELECT symbol, CAST(floor(epoch(date_trunc('hour', ts))) AS BIGINT) AS ts, round(arg_min(mid, ts) + 1e-9, 6) AS open, round(max(mid) + 1e-9, 6) AS high, round(min(mid) + 1e-9, 6) AS low, round(arg_max(mid, ts) + 1e-9, 6) AS close,
    round(avg(bps), 6) AS spread_bps, round(max(bps), 6) AS max_spread_bps, round(avg(bid_qty), 6) AS bid_qty, round(avg(ask_qty), 6) AS ask_qty, count(*) AS n FROM x GROUP BY symbol, date_trunc('hour', ts)""")
def _(spark, d):
    # a mid price may lie halfway between two roundings
    x = resample.book_bars(v.book(spark, d), "1 hour")
    return x.withColumns({c: F.col(c) + 1e-9 for c in ("open", "high", "low", "close")})


def _activity_sql(value: str, thr: float, last: str = "") -> str:
    return f"""WITH {T}, c AS (SELECT *, floor(sum({value}) OVER (PARTITION BY symbol ORDER BY ts, trade_id) / {thr}) AS bar FROM ticks),
    g AS (SELECT symbol, CAST(bar AS BIGINT) AS bar, max(ts) AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(amount) AS volume, sum(price * amount) AS dollars,
    sum(CASE side WHEN 'buy' THEN amount ELSE 0 END) AS buy, sum(CASE side WHEN 'sell' THEN amount ELSE 0 END) AS sell, count(*) AS n FROM c GROUP BY 1, 2)
    SELECT symbol, bar, {TS}, {_r('open', 'high', 'low', 'close', 'volume', 'dollars', 'buy', 'sell')}, n FROM g {last}"""


@query("s4_9_volume_bars", _activity_sql("amount", 2500, "QUALIFY bar < max(bar) OVER (PARTITION BY symbol)"))
def _(spark, d):
    return resample.activity_bars(v.ticks(spark, d), 2500, drop_last=True)


@query("s4_10_tick_rule", f"""WITH {T}, x AS (SELECT *, nullif(sign(price - lag(price) OVER w), 0) AS s FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, trade_id))
    SELECT symbol, trade_id, CAST(coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING), 1) AS DOUBLE) AS b FROM x""")
def _(spark, d):
    return resample.tick_rule(v.ticks(spark, d)).select("symbol", "trade_id", "b")


@query("s4_16_volume_delta", f"""WITH {T}, h AS (SELECT symbol, date_trunc('hour', ts) AS ts, sum(CASE side WHEN 'buy' THEN amount ELSE -amount END) AS delta, sum(amount) AS volume, sum(CASE side WHEN 'buy' THEN amount ELSE 0 END) AS buys FROM ticks GROUP BY 1, 2),
    s AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 hour)) AS ts FROM h GROUP BY 1),
    f AS (SELECT s.symbol, s.ts, coalesce(delta, 0) AS delta, coalesce(volume, 0) AS volume, coalesce(buys, 0) AS buys FROM s LEFT JOIN h USING (symbol, ts)),
    c AS (SELECT *, sum(delta) OVER (PARTITION BY symbol ORDER BY ts) AS cvd FROM f)
    SELECT symbol, {TS}, {_r('delta', 'volume', 'cvd')}, round(cvd - lag(cvd, 12) OVER (PARTITION BY symbol ORDER BY ts), 6) AS momentum, round(buys / nullif(volume, 0), 6) AS buy_ratio FROM c""")
def _(spark, d):
    return resample.volume_delta(v.ticks(spark, d), "1 hour", "1 HOUR")


W20 = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("s6_5_bands_vwap_returns", f"""WITH {B}, x AS (SELECT *, ln(close / lag(close) OVER w) AS lr, close / lag(close) OVER w - 1 AS ret_1, close / lag(close, 5) OVER w - 1 AS ret_5 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    y AS (SELECT symbol, ts, ret_1, ret_5, avg(close) {W20} AS sma, avg(close) {W20} - 2 * stddev_pop(close) {W20} AS bb_low, avg(close) {W20} + 2 * stddev_pop(close) {W20} AS bb_high,
    sum(close * volume) {W20} / nullif(sum(volume) {W20}, 0) + 1e-9 AS vwap, stddev_samp(lr) {W20} * sqrt(8760) AS vol, volume / nullif(avg(volume) {W20}, 0) AS vol_ratio FROM x)
    SELECT symbol, {TS}, {_r('ret_1', 'ret_5', 'sma', 'bb_low', 'bb_high', 'vwap', 'vol', 'vol_ratio')} FROM y""")
def _(spark, d):
    lo, mid, hi = ft.bollinger("close", 20, 2.0)
    x = v.bars(spark, d).withColumn("lr", ft.log_ret("close"))
    return x.select("symbol", "ts", ft.ret("close").alias("ret_1"), ft.ret("close", 5).alias("ret_5"), mid.alias("sma"), lo.alias("bb_low"), hi.alias("bb_high"), (ft.vwap(20) + 1e-9).alias("vwap"), ft.realised_vol(20, 8760).alias("vol"), (F.col("volume") / F.nullif(ft.sma("volume", 20), F.lit(0.0))).alias("vol_ratio"))


def _recursive(select_first: str, step: str, out: str) -> str:
    return f"""WITH RECURSIVE {B}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars), r AS (SELECT symbol, i, ts, close, {select_first} FROM n WHERE i = 1
    UNION ALL SELECT n.symbol, n.i, n.ts, n.close, {step} FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1) SELECT symbol, {TS}, {out} FROM r"""


@query("s6_2_ema", _recursive("close AS e9, close AS e50", "r.e9 * 0.8 + n.close * 0.2, r.e50 * (1 - 2.0 / 51) + n.close * 2.0 / 51", "round(e9, 6) AS ema_9, round(e50, 6) AS ema_50"))
def _(spark, d):
    return ema(v.bars(spark, d), "close", 9, 50).select("symbol", "ts", "ema_9", "ema_50")


@query("s6_3_rsi_atr", f"""WITH RECURSIVE {B}, n AS (SELECT *, row_number() OVER w AS i, close - lag(close) OVER w AS dl, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    r AS (SELECT symbol, i, ts, CAST(0 AS DOUBLE) AS g, CAST(0 AS DOUBLE) AS l, tr AS t, CAST(1 AS DOUBLE) AS tw FROM n WHERE i = 1
    UNION ALL SELECT n.symbol, n.i, n.ts, r.g * 13 / 14 + greatest(n.dl, 0), r.l * 13 / 14 + greatest(-n.dl, 0), r.t * 13 / 14 + n.tr, r.tw * 13 / 14 + 1 FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)
    SELECT symbol, {TS}, round(CASE WHEN l = 0 AND g > 0 THEN 100 WHEN l = 0 THEN 50 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi, round(t / tw, 6) AS atr FROM r""")
def _(spark, d):
    return ft.rsi_atr(v.bars(spark, d)).select("symbol", "ts", "rsi", "atr")


@query("s6_8_zscore", f"WITH {B} SELECT symbol, {TS}, round(coalesce((close - avg(close) {W20}) / nullif(stddev_pop(close) {W20}, 0), 0), 6) AS z FROM bars")
def _(spark, d):
    return v.bars(spark, d).select("symbol", "ts", ft.zscore("close", 20).alias("z"))


@query("s6_13_microstructure", f"""WITH {B}, x AS (SELECT *, close - lag(close) OVER w AS dp, close / lag(close) OVER w - 1 AS r, ln(high / low) AS hl, CASE WHEN close >= open THEN volume ELSE -volume END AS sv FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    y AS (SELECT *, lag(dp) OVER (PARTITION BY symbol ORDER BY ts) AS dp1 FROM x),
    z AS (SELECT symbol, ts, 2 * sqrt(greatest(-coalesce(covar_samp(dp, dp1) {W20}, 0), 0)) AS roll, avg(abs(r) / nullif(close * volume, 0)) {W20} * 1e6 AS amihud, sqrt(avg(hl * hl) {W20} / (4 * ln(2))) AS parkinson,
    sum(sv * dp) {W20} / nullif(sum(CASE WHEN dp IS NOT NULL THEN sv * sv END) {W20}, 0) AS kyle FROM y)
    SELECT symbol, {TS}, {_r('roll', 'amihud', 'parkinson', 'kyle')} FROM z""")
def _(spark, d):
    w = ft.series()
    x = v.bars(spark, d).withColumn("dp", F.col("close") - F.lag("close").over(w)).withColumn("ret_1", ft.ret("close")).withColumn("sv", F.when(F.col("dp").isNotNull(), F.when(F.col("close") >= F.col("open"), F.col("volume")).otherwise(-F.col("volume"))))
    x = x.withColumn("dp1", F.lag("dp").over(w))
    return x.select("symbol", "ts", F.coalesce(ft.roll_spread(20), F.lit(0.0)).alias("roll"), (ft.amihud(20) * 1e6).alias("amihud"), ft.parkinson(20).alias("parkinson"), ft.kyle_rolling(20)[0].alias("kyle"))


@query("s6_19_time_range_sum", f"""WITH {T} SELECT symbol, trade_id, sum(amount) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 899999999 microsecond PRECEDING AND CURRENT ROW) AS last_15m FROM ticks""")
def _(spark, d):
    return joins.trailing_sum(v.ticks(spark, d), "amount", 900, "last_15m").select("symbol", "trade_id", "last_15m")


def _last(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"


VOLS = f"""lv AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS lr FROM {{0}}),
    rv AS (SELECT *, CASE WHEN count(lr) {_last(60)} >= 30 THEN stddev_samp(lr) {_last(60)} END AS rv, CASE WHEN count(*) {_last(50)} >= 50 THEN stddev_samp(close) {_last(50)} END AS dev FROM lv),
    rl AS (SELECT *, list(rv) {_last(500)} AS l FROM rv),
    rk AS (SELECT * EXCLUDE (l), CASE WHEN len(list_filter(l, lambda e: e IS NOT NULL)) >= 250 THEN len(list_filter(l, lambda e: e <= rv)) / len(l) END AS vol_rank FROM rl),
    vr AS (SELECT *, CASE WHEN vol_rank > 0.8 THEN 'high' WHEN vol_rank < 0.2 THEN 'low' ELSE 'normal' END AS vol FROM rk)"""


@query("s6_21_volatility_regime", f"WITH {B}, {VOLS.format('bars')} SELECT symbol, {TS}, round(vol_rank, 6) AS vol_rank, vol AS vol_regime FROM vr")
def _(spark, d):
    return ft.volatility_regime(v.bars(spark, d)).select("symbol", "ts", "vol_rank", "vol_regime")


@query("s6_28_cross_section", f"""WITH {B}, r AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY volume) + (count(*) OVER (PARTITION BY ts, volume) - 1) / 2 AS rk, count(*) OVER (PARTITION BY ts) AS n, avg(volume) OVER (PARTITION BY ts) AS m, stddev_samp(volume) OVER (PARTITION BY ts) AS s FROM bars)
    SELECT symbol, {TS}, round(rk / n, 6) AS pct_rank, round((volume - m) / nullif(s, 0), 6) AS cs_z FROM r""")
def _(spark, d):
    return ft.cross_section(v.bars(spark, d), "volume").select("symbol", "ts", "pct_rank", "cs_z")


@query("s6_31_gaps_fracdiff", f"""WITH {B}, x AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, close - 0.4 * lag(close) OVER w - 0.12 * lag(close, 2) OVER w - 0.064 * lag(close, 3) OVER w AS fd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, {TS}, round(CASE WHEN low > h2 THEN low - h2 END, 6) AS bull_gap, round(CASE WHEN high < l2 THEN l2 - high END, 6) AS bear_gap, round(fd, 6) AS fd FROM x""")
def _(spark, d):
    return ft.fair_value_gaps(v.bars(spark, d)).select("symbol", "ts", "bull_gap", "bear_gap", ft.frac_diff("close", 0.4, 4).alias("fd"))


@query("s6_35_garch", _recursive("CAST(1 AS DOUBLE) AS v, CAST(0 AS DOUBLE) AS r1, CAST(0 AS DOUBLE) AS e", "0.01 + 0.1 * (r.close / 100 - 0.3) * (r.close / 100 - 0.3) + 0.85 * r.v, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)", "round(v, 6) AS garch_var"))
def _(spark, d):
    x = v.bars(spark, d).withColumn("r", F.col("close") / 100 - 0.3)
    return garch_variance(x, "r", 0.01, 0.1, 0.85, 1.0).withColumn("_k", F.row_number().over(ft.series())).withColumn("garch_var", F.when(F.col("_k") == 1, 1.0).otherwise(F.col("garch_var"))).select("symbol", "ts", "garch_var")


@query("s6_41_half_life_beta", f"""WITH {B}, x AS (SELECT symbol, ts, close - lag(close) OVER w AS ds, lag(close) OVER w AS s1 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, round(regr_slope(ds, s1), 6) AS slope, round(CASE WHEN regr_slope(ds, s1) < 0 THEN -ln(2) / regr_slope(ds, s1) END, 6) AS half_life FROM x GROUP BY symbol""")
def _(spark, d):
    w = ft.series()
    x = v.bars(spark, d).withColumn("s1", F.lag("close").over(w)).withColumn("ds", F.col("close") - F.col("s1"))
    x = x.groupBy("symbol").agg(F.regr_slope("ds", "s1").alias("slope"))
    return x.withColumn("half_life", F.when(F.col("slope") < 0, -F.ln(F.lit(2.0)) / F.col("slope")))


@query("s6_44_drawdown_runs", f"""WITH {B}, x AS (SELECT symbol, ts, close / max(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS dd, close > open AS up FROM bars),
    y AS (SELECT *, CASE WHEN up IS NOT DISTINCT FROM lag(up) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, {TS}, round(dd, 6) AS dd, CAST(sum(ch) OVER (PARTITION BY symbol ORDER BY ts) AS BIGINT) AS run FROM y""")
def _(spark, d):
    x = v.bars(spark, d).withColumn("up", F.col("close") > F.col("open")).withColumn("dd", ft.drawdown("close"))
    return ft.runs(x, "up").select("symbol", "ts", "dd", "run")


@query("s6_47_gap_windows", f"""WITH {B}, x AS (SELECT symbol, ts, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS nx FROM bars)
    SELECT symbol, CAST(floor(epoch(ts) + 3600) AS BIGINT) AS start, CAST(floor(epoch(nx)) AS BIGINT) AS "end", CAST((epoch(nx) - epoch(ts)) / 3600 - 1 AS BIGINT) AS missing FROM x WHERE epoch(nx) - epoch(ts) > 5400""")
def _(spark, d):
    return ft.gaps(v.bars(spark, d), 3600)


@query("s6_47_merge_intervals", f"""WITH {C}, x AS (SELECT l_suppkey, entry_ts, exit_ts, max(exit_ts) OVER (PARTITION BY l_suppkey ORDER BY entry_ts, exit_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM closed),
    g AS (SELECT *, sum(CASE WHEN m IS NULL OR entry_ts > m THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY entry_ts, exit_ts ROWS UNBOUNDED PRECEDING) AS g FROM x)
    SELECT l_suppkey, CAST(floor(epoch(min(entry_ts))) AS BIGINT) AS entry_ts, CAST(floor(epoch(max(exit_ts))) AS BIGINT) AS exit_ts FROM g GROUP BY l_suppkey, g""")
def _(spark, d):
    return ft.merge_intervals(v.closed_trades(spark, d), "l_suppkey", "entry_ts", "exit_ts")


@query("s7_2_dedupe", f"""WITH {O}, r AS (SELECT *, row_number() OVER (PARTITION BY account, date_trunc('month', ts) ORDER BY ts DESC, order_id DESC) AS k FROM order_log) SELECT account, order_id, {TS} FROM r WHERE k = 1""")
def _(spark, d):
    o = v.order_log(spark, d).withColumn("m", F.date_trunc("month", "ts"))
    return src.latest(o, ["account", "m"], ["ts", "order_id"]).select("account", "order_id", "ts")


@query("s7_5_top_n", f"WITH {O} SELECT order_id, round(price, 6) AS price FROM order_log ORDER BY price DESC, order_id LIMIT 25")
def _(spark, d):
    return v.order_log(spark, d).orderBy(F.desc("price"), "order_id").limit(25).select("order_id", "price")


@query("s7_12_set_operations", f"""WITH {B}, a AS (SELECT ts FROM bars WHERE symbol = 'S0'), b AS (SELECT ts FROM bars WHERE symbol = 'S1')
    SELECT 'both' AS part, count(*) AS n FROM (SELECT ts FROM a INTERSECT SELECT ts FROM b) UNION ALL SELECT 'only S0', count(*) FROM (SELECT ts FROM a EXCEPT SELECT ts FROM b)""")
def _(spark, d):
    x = v.bars(spark, d)
    a, b = x.where("symbol = 'S0'").select("ts"), x.where("symbol = 'S1'").select("ts")
    n = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "only S0"))


@query("s9_6_bet_size_costs", f"""WITH {B}, x AS (SELECT symbol, ts, 0.5 + 0.4 * (close - low) / nullif(high - low, 0) AS p, high, low, close, volume FROM bars),
    z AS (SELECT *, (p - 0.5) / sqrt(greatest(p * (1 - p), 1e-12)) AS z FROM x WHERE p IS NOT NULL),
    t AS (SELECT symbol, ts, list_reduce(list_transform(range(60, 0, -1), lambda k: CAST(k AS DOUBLE)), lambda a, k: 1 + z * z / (2 * k + 1) * a, CAST(1 AS DOUBLE)) AS s, p, z, high, low, close, volume FROM z)
    SELECT symbol, {TS}, round(p, 6) AS p, round(least(greatest(0.5 * (p - (1 - p) / 1.5), 0), 1), 6) AS kelly, round(0.7 * ((high - low) / close) * sqrt(10 / volume), 6) AS impact,
    round(2 * z * exp(-z * z / 2) / sqrt(2 * pi()) * s, 6) AS bet FROM t""")
def _(spark, d):
    """The bet size's distribution function stands in the SQL as its power series; |z| stays below 2 here."""
    p = 0.5 + 0.4 * (F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    x = v.bars(spark, d).withColumn("p", p).where("p is not null")
    impact = n.impact(F.lit(10.0), F.col("volume"), (F.col("high") - F.col("low")) / F.col("close"), 0.7)
    return x.select("symbol", "ts", "p", n.kelly(F.col("p"), F.lit(1.5)).alias("kelly"), impact.alias("impact"), n.bet_size(F.col("p"), F.lit(1.0)).alias("bet"))
