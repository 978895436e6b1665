"""Queries on market states, gates and strategy rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream import views as v
from lodestream.operators import features as ft
from lodestream.operators import joins, resample, signals, trades
from lodestream.operators import regimes as rg
from lodestream.plans.market import BK, LEGS, TS, VOLS, B, FU, T, _last, _r, legs
from lodestream.plans.registry import query

#: fe: bars with e9, e50, rsi, atr by recursion; st: the same with vol_rank, vol, strength, structure and label.
STATE = f"""WITH RECURSIVE {B}, nn AS (SELECT *, row_number() OVER w AS i, close - lag(close) OVER w AS dl, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    rr AS (SELECT symbol, i, CAST(0 AS DOUBLE) AS g, CAST(0 AS DOUBLE) AS ls, tr AS t, CAST(1 AS DOUBLE) AS tw, close AS e9, close AS e50 FROM nn WHERE i = 1
    UNION ALL SELECT n.symbol, n.i, r.g * 13 / 14 + greatest(n.dl, 0), r.ls * 13 / 14 + greatest(-n.dl, 0), r.t * 13 / 14 + n.tr, r.tw * 13 / 14 + 1, r.e9 * 0.8 + n.close * 0.2, r.e50 * (1 - 2.0 / 51) + n.close * 2.0 / 51 FROM rr r JOIN nn n ON n.symbol = r.symbol AND n.i = r.i + 1),
    fe AS (SELECT n.symbol, n.ts, n.i, open, high, low, close, volume, e9, e50, CASE WHEN ls = 0 AND g > 0 THEN 100 WHEN ls = 0 THEN 50 ELSE 100 - 100 / (1 + g / ls) END AS rsi, t / tw AS atr FROM nn n JOIN rr r USING (symbol, i)),
    {VOLS.format('fe')},
    sg AS (SELECT *, least(1, coalesce(abs(e9 - e50) / nullif(dev, 0), 0)) AS strength FROM vr),
    ss AS (SELECT *, CASE WHEN strength < 0.35 THEN 'range' WHEN e9 > e50 THEN 'trend_up' ELSE 'trend_down' END AS structure FROM sg), st AS (SELECT *, structure || '|' || vol AS label FROM ss)"""
#: Entry and exit of the band rule: bb holds the bands, mr the position.
REVERSION = STATE + f""", bb AS (SELECT *, CASE WHEN count(*) {_last(20)} >= 20 THEN avg(close) {_last(20)} END AS mid, CASE WHEN count(*) {_last(20)} >= 20 THEN 2 * stddev_pop(close) {_last(20)} END AS wide FROM st),
    en AS (SELECT *, CASE WHEN rsi < 30 AND close < mid - wide THEN 1 WHEN rsi > 70 AND close > mid + wide THEN -1 ELSE 0 END AS raw FROM bb),
    ok AS (SELECT *, CASE WHEN raw <> 0 AND NOT (atr / nullif(close, 0) < 0.001 OR strength >= 0.6 OR vol = 'high') THEN raw END AS ent FROM en),
    hd AS (SELECT *, coalesce(last_value(ent IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM ok),
    se AS (SELECT *, CASE WHEN (held = 1 AND (close >= mid OR close < mid - 2 * atr)) OR (held = -1 AND (close <= mid OR close > mid + 2 * atr)) THEN 0 ELSE ent END AS st0 FROM hd),
    mr AS (SELECT *, CAST(coalesce(last_value(st0 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS DOUBLE) AS sig FROM se)"""


def state(spark, d):
    return rg.market_state(v.bars(spark, d))


@query("s6_22_trend_structure", STATE + f" SELECT symbol, {TS}, round(strength, 6) AS strength, structure FROM st")
def _(spark, d):
    return rg.market_structure(v.bars(spark, d)).select("symbol", "ts", "strength", "structure")


@query("s6_23_market_state", STATE + f" SELECT symbol, {TS}, structure, vol, label FROM st")
def _(spark, d):
    return state(spark, d).select("symbol", "ts", "structure", "vol", "label")


SKEW = """sk0 AS (SELECT *, CASE WHEN count(rate) OVER w >= 60 THEN least(3, greatest(-3, (rate - avg(rate) OVER w) / nullif(stddev_samp(rate) OVER w, 0))) END AS z, count(*) OVER (PARTITION BY symbol) AS n FROM funding WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS 119 PRECEDING)),
    sk AS (SELECT symbol, ts, seq, CASE WHEN n >= 120 THEN coalesce(z, 0) ELSE 0 END AS skew FROM sk0)"""


@query("s6_25_funding_skew", f"WITH {FU}, {SKEW} SELECT symbol, seq, round(skew, 4) AS skew FROM sk")
def _(spark, d):
    return rg.funding_skew(v.funding(spark, d), 120, ("ts", "seq")).select("symbol", "seq", F.round("skew", 4).alias("skew"))


LIQUID = f"""il0 AS (SELECT *, abs(coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1, 0)) / greatest(close * volume, 1e-12) AS ill FROM {{0}}),
    il AS (SELECT *, quantile_cont(ill, 0.5) {_last(120)} AS m, greatest(quantile_cont(ill, 0.75) {_last(120)} - quantile_cont(ill, 0.25) {_last(120)}, 1e-15) AS q, count(*) {_last(120)} AS c FROM il0),
    lq AS (SELECT *, CASE WHEN c < 60 THEN 'normal' WHEN ill < greatest(m - 0.5 * q, 0) THEN 'high' WHEN ill > m + 1.5 * q THEN 'low' ELSE 'normal' END AS liquidity FROM il)"""


@query("s6_26_liquidity_label", f"WITH {B}, {LIQUID.format('bars')} SELECT symbol, {TS}, liquidity FROM lq")
def _(spark, d):
    return rg.liquidity_label(v.bars(spark, d)).select("symbol", "ts", "liquidity")


@query("s6_27_detector", STATE + f""", {LIQUID.format('st')}, {FU}, {SKEW}, j AS (SELECT l.symbol, l.ts, structure, vol, label, liquidity, coalesce(skew, 0) AS skew FROM lq l ASOF LEFT JOIN (SELECT symbol, ts, arg_max(skew, seq) AS skew FROM sk GROUP BY symbol, ts) k ON l.symbol = k.symbol AND l.ts >= k.ts)
    SELECT symbol, {TS}, structure, vol, label, liquidity, round(skew, 4) AS skew, label || '|' || liquidity || '|' || CASE WHEN skew > 1 THEN 'long' WHEN skew < -1 THEN 'short' ELSE 'even' END AS joint FROM j""")
def _(spark, d):
    skew = rg.funding_skew(v.funding(spark, d), 120, ("ts", "seq"))
    x = joins.asof_join(rg.liquidity_label(state(spark, d)), skew, cols=["skew"], prefix="", tie="seq").fillna(0.0, ["skew"])
    side = F.when(F.col("skew") > 1, "long").when(F.col("skew") < -1, "short").otherwise("even")
    return x.select("symbol", "ts", "structure", "vol", "label", "liquidity", F.round("skew", 4).alias("skew"), F.concat_ws("|", "label", "liquidity", side).alias("joint"))


@query("s11_2_mean_reversion", REVERSION + f" SELECT symbol, {TS}, round(rsi, 6) AS rsi, round(mid, 6) AS mid, sig FROM mr")
def _(spark, d):
    return signals.mean_reversion(v.bars(spark, d)).select("symbol", "ts", "rsi", "mid", "sig")


@query("s11_3_traced_reversion", REVERSION + f""" SELECT symbol, {TS}, CAST(raw AS DOUBLE) AS raw, concat_ws(',', CASE WHEN atr / nullif(close, 0) < 0.001 THEN 'range' END, CASE WHEN strength >= 0.6 THEN 'trend' END, CASE WHEN vol = 'high' THEN 'volatility' END) AS blocked_by, sig FROM mr WHERE raw <> 0""")
def _(spark, d):
    x = signals.mean_reversion(v.bars(spark, d), traced=True).where("raw <> 0")
    return x.select("symbol", "ts", "raw", F.array_join("blocked_by", ",").alias("blocked_by"), "sig")


TRACE = REVERSION + """, sh AS (SELECT *, raw * (lead(close, 6) OVER (PARTITION BY symbol ORDER BY ts) / close - 1) AS shadow FROM mr),
    bl AS (SELECT symbol, ts, shadow, unnest([CASE WHEN atr / nullif(close, 0) < 0.001 THEN 'range' END, CASE WHEN strength >= 0.6 THEN 'trend' END, CASE WHEN vol = 'high' THEN 'volatility' END]) AS filter FROM sh WHERE raw <> 0)"""


@query("s5_14_shadow_pnl", TRACE + " SELECT filter, count(*) AS n, count(shadow) AS known, round(avg(shadow), 6) AS mean, round(avg(CASE WHEN shadow > 0 THEN 1.0 ELSE 0 END), 6) AS positive, round(sum(shadow), 6) AS total FROM bl WHERE filter IS NOT NULL GROUP BY 1")
def _(spark, d):
    return trades.shadow_pnl(signals.mean_reversion(v.bars(spark, d), traced=True), 6)


@query("s5_15_with_without_filters", TRACE + f""", pp AS (SELECT symbol, ts, i, close, sig, raw, blocked, lead(close, 6) OVER w / close - 1 AS fwd, coalesce(lag(sig) OVER w, 0) * 0.01 * coalesce(close / lag(close) OVER w - 1, 0) AS ret FROM (SELECT *, raw <> 0 AND ent IS NULL AS blocked FROM mr) WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    sp AS (SELECT symbol, unnest(range(i + 1, i + 7)) AS i, raw * 0.01 * fwd / 6 AS extra FROM pp WHERE blocked AND fwd IS NOT NULL), ex AS (SELECT symbol, i, sum(extra) AS extra FROM sp GROUP BY 1, 2),
    al AS (SELECT pp.symbol, pp.ts, ret, ret + coalesce(extra, 0) AS more FROM pp LEFT JOIN ex USING (symbol, i))
    SELECT symbol, {TS}, round(exp(sum(ln(1 + ret)) OVER w), 6) AS with_filters, round(exp(sum(ln(1 + greatest(more, -0.99))) OVER w), 6) AS without_filters FROM al WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(spark, d):
    return trades.with_without_filters(signals.mean_reversion(v.bars(spark, d), traced=True), 6, 0.01)


@query("s2_13_breakeven_gate", REVERSION + f" SELECT symbol, {TS}, CASE WHEN atr / nullif(close, 0) >= 0.5 THEN sig ELSE 0 END AS gated FROM mr")
def _(spark, d):
    x = signals.mean_reversion(v.bars(spark, d))
    return x.select("symbol", "ts", rg.breakeven_gate(F.col("sig"), F.col("atr"), F.col("close"), 0.5).alias("gated"))


SIDES = """, sd AS (SELECT *, CASE WHEN close > open THEN 1.0::DOUBLE WHEN close < open THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS sig FROM st)"""


def sides(x):
    """A simple signal: with the bar."""
    return x.withColumn("sig", F.when(F.col("close") > F.col("open"), 1.0).when(F.col("close") < F.col("open"), -1.0).otherwise(0.0))


@query("s2_14_regime_gates", STATE + SIDES + f" SELECT symbol, {TS}, CASE WHEN vol = 'high' OR (structure = 'trend_up' AND sig < 0) OR (structure = 'trend_down' AND sig > 0) THEN 0 ELSE sig END AS gated FROM sd")
def _(spark, d):
    x = sides(state(spark, d))
    return x.select("symbol", "ts", rg.regime_gates(F.col("sig"), F.col("vol"), F.col("structure")).alias("gated"))


@query("s2_15_preferred_regimes", STATE + SIDES + f""", ll AS (SELECT symbol, ts, label, structure, unnest([{{'s': 'revert', 'g': -sig}}, {{'s': 'follow', 'g': sig}}, {{'s': 'any', 'g': sig}}]) AS x FROM sd)
    SELECT symbol, {TS}, x.s AS strategy, CASE WHEN x.s = 'any' OR (x.s = 'revert' AND structure = 'range') OR (x.s = 'follow' AND label IN ('trend_up|normal', 'trend_down|normal')) THEN x.g + 0.0 ELSE 0 END AS sig FROM ll""")
def _(spark, d):
    x = sides(state(spark, d))
    long = x.select("symbol", "ts", "label", F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), g.alias("sig")) for k, g in (("revert", -F.col("sig")), ("follow", F.col("sig")), ("any", F.col("sig")))])).alias("_x"))
    long = long.select("symbol", "ts", "label", "_x.strategy", "_x.sig")
    return rg.preferred_only(long, {"revert": ["range"], "follow": ["trend_up|normal", "trend_down|normal"]}).select("symbol", "ts", "strategy", "sig")


@query("s3_8_regime_at_entry", STATE + f""", tk AS (SELECT symbol, trade_id, ts FROM ticks) SELECT t.symbol, t.trade_id, s.label AS entry_label FROM tk t ASOF LEFT JOIN st s ON t.symbol = s.symbol AND t.ts >= s.ts""")
def _(spark, d):
    return joins.asof_join(v.ticks(spark, d).select("symbol", "trade_id", "ts"), state(spark, d).select("symbol", "ts", "label"), cols=["label"], prefix="entry_").drop("ts")


ORDERED = [f"{s}|{w}" for s in ("range", "trend_up", "trend_down") for w in ("low", "normal", "high")]
RETS = STATE + SIDES + ", rt AS (SELECT *, coalesce(lag(sig) OVER w, 0) * 0.01 * coalesce(close / lag(close) OVER w - 1, 0) AS ret FROM sd WINDOW w AS (PARTITION BY symbol ORDER BY ts))"


def _rets(spark, d):
    w = ft.series()
    x = sides(state(spark, d))
    return x.withColumn("ret", F.coalesce(F.lag("sig").over(w), F.lit(0.0)) * 0.01 * F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)))


@query("s5_5_regime_breakdown", RETS + f""", o AS (SELECT unnest({ORDERED}) AS label, unnest(range({len(ORDERED)})) AS k) SELECT CAST(k AS INTEGER) AS k, o.label, count(ret) AS n, round(avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0 END), 6) AS win_rate, round(sum(ret), 6) AS total FROM o LEFT JOIN rt USING (label) GROUP BY 1, 2""")
def _(spark, d):
    x = _rets(spark, d).groupBy("label").agg(F.count("ret").alias("n"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.sum("ret").alias("total"))
    order = spark.createDataFrame([(k, s) for k, s in enumerate(ORDERED)], "k int, label string")
    return order.join(x, "label", "left").fillna(0, ["n"])


@query("s5_20_pooled_regime_matrix", RETS + " SELECT label, count(*) AS n, count(DISTINCT symbol) AS symbols, round(avg(ret) * 1e4, 6) AS mean_bps, round(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(8760), 6) AS sharpe FROM rt GROUP BY 1 HAVING count(*) >= 30")
def _(spark, d):
    x = _rets(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("symbols"), (F.avg("ret") * 1e4).alias("mean_bps"), (F.avg("ret") / F.nullif(F.stddev_pop("ret"), F.lit(0.0)) * F.sqrt(F.lit(8760.0))).alias("sharpe"))
    return x.where("n >= 30")


@query("s5_21_metrics_by_regime", RETS + """, cu AS (SELECT *, sum(ret) OVER (PARTITION BY symbol, structure ORDER BY ts) AS c FROM rt), dd AS (SELECT *, c - greatest(max(c) OVER (PARTITION BY symbol, structure ORDER BY ts), 0) AS dd FROM cu)
    SELECT symbol, structure, count(*) AS n, round(avg(ret) / nullif(stddev_pop(ret), 0), 6) AS sharpe, round(sum(greatest(ret, 0)) / nullif(-sum(least(ret, 0)), 0), 6) AS profit_factor, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(min(dd), 6) AS drawdown FROM dd GROUP BY 1, 2""")
def _(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("symbol", "structure").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    x = _rets(spark, d).withColumn("c", F.sum("ret").over(w)).withColumn("dd", F.col("c") - F.greatest(F.max("c").over(w), F.lit(0.0)))
    gain, loss = F.sum(F.greatest("ret", F.lit(0.0))), -F.sum(F.least("ret", F.lit(0.0)))
    return x.groupBy("symbol", "structure").agg(F.count(F.lit(1)).alias("n"), (F.avg("ret") / F.nullif(F.stddev_pop("ret"), F.lit(0.0))).alias("sharpe"), (gain / F.nullif(loss, F.lit(0.0))).alias("profit_factor"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.min("dd").alias("drawdown"))


@query("s5_22_regime_pnl_share", RETS + ", g AS (SELECT symbol, label, sum(ret) AS pnl FROM rt GROUP BY 1, 2) SELECT symbol, label, round(pnl, 6) AS pnl, round(pnl / nullif(sum(pnl) OVER (PARTITION BY symbol), 0), 4) AS share FROM g")
def _(spark, d):
    from pyspark.sql.window import Window

    g = _rets(spark, d).groupBy("symbol", "label").agg(F.sum("ret").alias("pnl"))
    return g.withColumn("share", F.round(F.col("pnl") / F.nullif(F.sum("pnl").over(Window.partitionBy("symbol")), F.lit(0.0)), 4))


@query("s5_25_regime_summary", STATE + SIDES + " SELECT symbol, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 6) AS share, round(avg(sig), 6) AS mean_signal FROM sd GROUP BY 1, 2")
def _(spark, d):
    from pyspark.sql.window import Window

    g = sides(state(spark, d)).groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("sig").alias("mean_signal"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("symbol")))


@query("s3_25_regime_weights", RETS + """, ll AS (SELECT symbol, ts, label, unnest([{'s': 'follow', 'g': sig, 'r': ret}, {'s': 'revert', 'g': -sig, 'r': -ret}]) AS x FROM rt),
    pm AS (SELECT label, x.s AS strategy, greatest(avg(x.r), 0) AS m FROM ll GROUP BY 1, 2), wt AS (SELECT label, strategy, CASE WHEN sum(m) OVER (PARTITION BY label) > 0 THEN m / sum(m) OVER (PARTITION BY label) ELSE 0.5 END AS w FROM pm)
    SELECT ll.symbol, CAST(floor(epoch(ll.ts)) AS BIGINT) AS ts, round(sum(ll.x.g * wt.w), 6) AS sig FROM ll JOIN wt ON ll.label = wt.label AND ll.x.s = wt.strategy GROUP BY 1, 2""")
def _(spark, d):
    long = signals.opposites(_rets(spark, d))
    return signals.regime_blend(long)


@query("s11_22_best_prior", RETS + """, ll AS (SELECT symbol, ts, label, unnest([{'s': 'follow', 'g': sig, 'r': ret, 'o': 0}, {'s': 'revert', 'g': -sig, 'r': -ret, 'o': 1}]) AS x FROM rt),
    pm AS (SELECT label, x.s AS strategy, avg(x.r) AS m FROM ll GROUP BY 1, 2), j AS (SELECT ll.symbol, ll.ts, ll.x.g AS g, row_number() OVER (PARTITION BY ll.symbol, ll.ts ORDER BY m DESC, strategy) AS k FROM ll JOIN pm ON ll.label = pm.label AND ll.x.s = pm.strategy)
    SELECT symbol, CAST(floor(epoch(ts)) AS BIGINT) AS ts, g + 0.0 AS sig FROM j WHERE k = 1""")
def _(spark, d):
    return signals.best_prior(signals.opposites(_rets(spark, d)))


@query("s11_21_regime_capital", STATE + f" SELECT symbol, {TS}, (CASE WHEN structure = 'range' THEN 1.0 ELSE 0.25 END * CASE WHEN vol IN ('low', 'normal') THEN 1.0 ELSE 0.25 END)::DOUBLE AS weight FROM st")
def _(spark, d):
    return state(spark, d).select("symbol", "ts", signals.regime_capital(["range"], ["low", "normal"], 0.25).alias("weight"))


@query("s11_24_hedge_by_regime", RETS + f""", ll AS (SELECT symbol, ts, i, label, unnest([{{'s': 'follow', 'l': CASE WHEN ret < 0 THEN 1.0 ELSE 0.0 END}}, {{'s': 'revert', 'l': CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END}}]) AS x FROM rt),
    cm AS (SELECT *, count(*) OVER w AS n, coalesce(sum(x.l) OVER w, 0) AS own, coalesce(sum(x.l) OVER g, 0) AS every FROM ll WINDOW w AS (PARTITION BY symbol, label, x.s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g AS (PARTITION BY symbol, x.s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    us AS (SELECT *, CASE WHEN n >= 20 THEN own ELSE every END AS c FROM cm), ee AS (SELECT *, exp(-0.1 * (c - min(c) OVER (PARTITION BY symbol, i))) AS e FROM us)
    SELECT symbol, {TS}, x.s AS expert, round(e / sum(e) OVER (PARTITION BY symbol, i), 6) AS weight FROM ee""")
def _(spark, d):
    x = _rets(spark, d)
    long = x.select("symbol", "ts", "label", F.explode(F.array(F.struct(F.lit("follow").alias("expert"), (F.col("ret") < 0).cast("double").alias("loss")), F.struct(F.lit("revert").alias("expert"), (F.col("ret") > 0).cast("double").alias("loss")))).alias("_x"))
    return signals.contextual_hedge(long.select("symbol", "ts", "label", "_x.expert", "_x.loss"), 0.1, 20).select("symbol", "ts", "expert", "weight")


HOLD = "SELECT *, CAST(coalesce(last_value(st0 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS DOUBLE) AS sig FROM "
BEFORE = "coalesce(last_value({0} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@query("s11_4_cvd_momentum", STATE + f""", dv AS (SELECT symbol, date_trunc('hour', ts) AS ts, sum(CASE side WHEN 'buy' THEN amount ELSE -amount END) AS delta FROM ticks GROUP BY 1, 2),
    c1 AS (SELECT s.*, sum(delta) OVER (PARTITION BY symbol ORDER BY ts) AS cvd, CASE WHEN count(*) {_last(20)} >= 5 THEN sum(volume) {_last(20)} END AS v20, volume / nullif(avg(volume) {_last(20)}, 0) AS ratio FROM st s JOIN dv USING (symbol, ts)),
    c2 AS (SELECT *, coalesce((cvd - lag(cvd, 12) OVER (PARTITION BY symbol ORDER BY ts)) / nullif(v20, 0), 0) AS mom FROM c1),
    c3 AS (SELECT *, CASE WHEN close < e9 AND mom < 0 AND ratio >= 1 THEN -1 WHEN close > e9 AND mom > 0 AND ratio >= 1 THEN 1 END AS ent FROM c2), c4 AS (SELECT *, {BEFORE.format('ent')} AS held FROM c3),
    c5 AS (SELECT *, CASE WHEN (held = 1 AND (close < e9 OR mom < 0)) OR (held = -1 AND (close > e9 OR mom > 0)) THEN 0 ELSE ent END AS st0 FROM c4), c6 AS ({HOLD}c5) SELECT symbol, {TS}, round(mom, 6) AS mom, sig FROM c6""")
def _(spark, d):
    t = v.ticks(spark, d)
    flow = t.groupBy("symbol", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum(F.when(F.col("side") == "buy", F.col("amount")).otherwise(-F.col("amount"))).alias("delta"))
    return signals.cvd_momentum(v.bars(spark, d).join(flow, ["symbol", "ts"])).select("symbol", "ts", "mom", "sig")


@query("s11_5_book_imbalance", f"""WITH {BK}, im AS (SELECT symbol, date_trunc('hour', ts) AS ts, avg((bid_qty - ask_qty) / (bid_qty + ask_qty)) AS imb FROM book GROUP BY 1, 2),
    z AS (SELECT *, CASE WHEN count(*) {_last(48)} >= 48 THEN coalesce((imb - avg(imb) {_last(48)}) / nullif(stddev_pop(imb) {_last(48)}, 0), 0) ELSE 0 END AS z FROM im),
    e AS (SELECT *, CASE WHEN z > 1.5 THEN 1 WHEN z < -1.5 THEN -1 END AS ent FROM z), h AS (SELECT *, {BEFORE.format('ent')} AS held FROM e),
    s AS (SELECT *, CASE WHEN (held = 1 AND z < 0) OR (held = -1 AND z > 0) THEN 0 ELSE ent END AS st0 FROM h), o AS ({HOLD}s) SELECT symbol, {TS}, round(z, 6) AS z, sig FROM o""")
def _(spark, d):
    imb = v.book(spark, d).groupBy("symbol", F.date_trunc("hour", "ts").alias("ts")).agg(F.avg((F.col("bid_qty") - F.col("ask_qty")) / (F.col("bid_qty") + F.col("ask_qty"))).alias("imb"))
    return signals.book_imbalance(imb, 48, 1.5).select("symbol", "ts", "z", "sig")


@query("s11_7_funding_arbitrage", f"""WITH {B}, {FU}, f AS (SELECT symbol, ts, seq, coalesce(lag(rate) OVER (PARTITION BY symbol ORDER BY ts, seq), 0) AS p FROM funding),
    g AS (SELECT symbol, ts, arg_max(CASE WHEN abs(p) < 2e-6 THEN 0 WHEN p > 6e-6 THEN 1 WHEN p < -6e-6 THEN -1 ELSE 0 END, seq) AS sig FROM f GROUP BY 1, 2)
    SELECT b.symbol, CAST(epoch(b.ts) AS BIGINT) AS ts, CAST(coalesce(sig, 0) AS DOUBLE) AS sig FROM bars b ASOF LEFT JOIN g ON b.symbol = g.symbol AND b.ts >= g.ts""")
def _(spark, d):
    f = signals.funding_arbitrage(v.funding(spark, d), 6e-6, 2e-6)
    return joins.asof_join(v.bars(spark, d).select("symbol", "ts"), f, cols=["sig"], prefix="", tie="seq").fillna(0.0, ["sig"])


@query("s11_8_basis_reversion", LEGS + f""", b AS (SELECT *, 'pair' AS symbol, c1 / c2 - 1 AS basis FROM p), z AS (SELECT *, CASE WHEN count(*) {_last(48)} >= 24 THEN coalesce((basis - avg(basis) {_last(48)}) / nullif(stddev_pop(basis) {_last(48)}, 0), 0) ELSE 0 END AS z FROM b),
    e AS (SELECT *, CASE WHEN z > 2 THEN 1 WHEN z < -2 THEN -1 END AS ent FROM z), h AS (SELECT *, {BEFORE.format('ent')} AS held FROM e),
    s AS (SELECT *, CASE WHEN held <> 0 AND (abs(basis) < 2e-4 OR abs(z) < 0.5) THEN 0 ELSE ent END AS st0 FROM h), o AS ({HOLD}s) SELECT {TS}, round(z, 6) AS z, sig FROM o""")
def _(spark, d):
    return signals.basis_reversion(legs(spark, d), 48).select("ts", "z", "sig")


@query("s11_14_stoch_rsi", STATE + f""", a AS (SELECT *, CASE WHEN count(*) {_last(14)} >= 14 THEN (rsi - min(rsi) {_last(14)}) / nullif(max(rsi) {_last(14)} - min(rsi) {_last(14)}, 0) * 100 END AS raw FROM fe),
    b AS (SELECT *, CASE WHEN count(raw) {_last(3)} >= 3 THEN avg(raw) {_last(3)} END AS k FROM a), c AS (SELECT *, CASE WHEN count(k) {_last(3)} >= 3 THEN avg(k) {_last(3)} END AS dd FROM b),
    x AS (SELECT *, lag(k) OVER w AS k1, lag(dd) OVER w AS d1 FROM c WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, {TS}, round(k, 6) AS k, round(dd, 6) AS d, CAST(CASE WHEN k1 <= d1 AND k > dd AND k < 20 THEN 1 WHEN k1 >= d1 AND k < dd AND k > 80 THEN -1 ELSE 0 END AS INTEGER) AS cross_side FROM x""")
def _(spark, d):
    """Crossings hang on the last digit where both lines are equal; stand-in values never are."""
    return signals.stoch_rsi(v.bars(spark, d)).select("symbol", "ts", "k", "d", "cross_side")


@query("s6_11_vpin", f"""WITH {T}, c AS (SELECT *, floor(sum(amount) OVER (PARTITION BY symbol ORDER BY ts, trade_id) / 1000) AS bar FROM ticks), g AS (SELECT symbol, CAST(bar AS BIGINT) AS bar, sum(CASE side WHEN 'buy' THEN amount ELSE -amount END) AS net FROM c GROUP BY 1, 2),
    l AS (SELECT * FROM g QUALIFY bar < max(bar) OVER (PARTITION BY symbol))
    SELECT symbol, bar, CASE WHEN count(*) OVER w >= 10 THEN round(sum(abs(net)) OVER w / 20000, 6) END AS vpin FROM l WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS 19 PRECEDING)""")
def _(spark, d):
    return ft.vpin(resample.activity_bars(v.ticks(spark, d), 1000, drop_last=True), 1000.0, 20).select("symbol", "bar", "vpin")


@query("s6_12_kyle_whole", f"""WITH {B}, f AS (SELECT symbol, date_trunc('hour', ts) AS ts, sum(CASE side WHEN 'buy' THEN amount ELSE -amount END) AS sv FROM ticks GROUP BY 1, 2), x AS (SELECT symbol, sv, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS dp FROM bars JOIN f USING (symbol, ts)),
    m AS (SELECT symbol, count(*) AS n, sum(sv * dp) AS xy, sum(sv * sv) AS xx, sum(dp * dp) AS yy FROM x WHERE dp IS NOT NULL GROUP BY 1)
    SELECT symbol, n, round(xy / xx, 6) AS lambda_, round(xy / xx / sqrt((yy - xy * xy / xx) / (n - 1) / xx), 6) AS t FROM m""")
def _(spark, d):
    flow = v.ticks(spark, d).groupBy("symbol", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum(F.when(F.col("side") == "buy", F.col("amount")).otherwise(-F.col("amount"))).alias("sv"))
    x = v.bars(spark, d).join(flow, ["symbol", "ts"]).withColumn("dp", F.col("close") - F.lag("close").over(ft.series()))
    return ft.kyle_whole(x).withColumnRenamed("lambda", "lambda_")


@query("s6_18_flow_autocorrelation", f"""WITH {T}, h AS (SELECT symbol, date_trunc('hour', ts) AS ts, sum(CASE side WHEN 'buy' THEN amount ELSE -amount END) AS delta FROM ticks GROUP BY 1, 2), s AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 hour)) AS ts FROM h GROUP BY 1),
    f AS (SELECT symbol, ts, coalesce(delta, 0) AS x FROM s LEFT JOIN h USING (symbol, ts)), l AS (SELECT *, lag(x) OVER (PARTITION BY symbol ORDER BY ts) AS y FROM f)
    SELECT symbol, {TS}, CASE WHEN count(y) {_last(120)} >= 60 THEN round(corr(x, y) {_last(120)}, 6) END AS autocorr FROM l""")
def _(spark, d):
    return ft.flow_autocorrelation(resample.volume_delta(v.ticks(spark, d), "1 hour", "1 HOUR"), 120).select("symbol", "ts", "autocorr")


@query("s6_16_corwin_schultz", f"""WITH {B}, x AS (SELECT symbol, ts, ln(high / low) ** 2 + ln(lag(high) OVER w / lag(low) OVER w) ** 2 AS b, ln(greatest(high, lag(high) OVER w) / least(low, lag(low) OVER w)) ** 2 AS g FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    a AS (SELECT *, (sqrt(2 * b) - sqrt(b)) / (3 - 2 * sqrt(2)) - sqrt(g / (3 - 2 * sqrt(2))) AS a FROM x WHERE b IS NOT NULL) SELECT symbol, {TS}, round(greatest(0, 2 * (exp(a) - 1) / (1 + exp(a))), 6) AS spread FROM a""")
def _(spark, d):
    x = v.bars(spark, d).withColumn("k", F.row_number().over(ft.series())).withColumn("spread", ft.corwin_schultz())
    return x.where("k > 1").select("symbol", "ts", "spread")


@query("s6_9_feature_table", STATE + f""", r2 AS (SELECT *, close / lag(close) OVER w - 1 AS ret_1, close / lag(close, 5) OVER w - 1 AS ret_5, 2 * stddev_pop(close) {_last(20)} AS wide, avg(close) {_last(20)} AS mid FROM lv WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, {TS}, round(rsi, 6) AS rsi, round(atr, 6) AS atr, round(e9, 6) AS ema_9, round(e50, 6) AS ema_50, {_r('ret_1', 'ret_5')}, round(2 * wide / nullif(mid, 0), 6) AS bb_width, round(stddev_samp(lr) {_last(20)} * sqrt(8760), 6) AS vol, round(volume / nullif(avg(volume) {_last(20)}, 0), 6) AS vol_ratio FROM r2""")
def _(spark, d):
    return ft.feature_table(v.bars(spark, d)).select("symbol", "ts", "rsi", "atr", "ema_9", "ema_50", "ret_1", "ret_5", "bb_width", "vol", "vol_ratio")
