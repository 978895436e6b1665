"""Queries on statistics, model tables, further accounting and state machines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream import views as v
from lodestream.operators import accounting as ac
from lodestream.operators import features as ft
from lodestream.operators import joins, labels, models, signals, states, stats
from lodestream.plans.market import BK, LEGS, TS, B, C, FL, FU, T, _last, legs
from lodestream.plans.regimes import REVERSION, STATE
from lodestream.plans.registry import query
from lodestream.plans.research import BARRIER, PNL, _pnl, _sided

RET = f"WITH {B}, r AS (SELECT *, ln(close / lag(close) OVER w) AS lr, close / lag(close) OVER w - 1 AS ret, row_number() OVER w AS i FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
RUN = "OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def _rets(spark, d):
    return v.bars(spark, d).withColumns({"lr": ft.log_ret("close"), "ret": ft.ret("close")})


@query("s6_20_oi_change", f"WITH {B} SELECT symbol, {TS}, round(volume - lag(volume, 5) OVER (PARTITION BY symbol ORDER BY ts), 6) AS change FROM bars")
def _(spark, d):
    return v.bars(spark, d).select("symbol", "ts", (F.col("volume") - F.lag("volume", 5).over(ft.series())).alias("change"))


DEPTH = f"WITH {BK}, dp AS (SELECT *, list_transform(range(5), lambda i: bid_qty + 3 * i) AS bq, list_transform(range(5), lambda i: ask_qty + 5 - i) AS aq FROM book)"


def _depth(spark, d):
    level = lambda f: F.array(*[f(i) for i in range(5)])
    return v.book(spark, d).withColumns({"bq": level(lambda i: F.col("bid_qty") + 3 * i), "aq": level(lambda i: F.col("ask_qty") + 5 - i)})


def _imb(w: str) -> str:
    side = lambda q: f"list_sum(list_transform(range(5), lambda i: {q}[i + 1] * {w}))"
    return f"round(({side('bq')} - {side('aq')}) / ({side('bq')} + {side('aq')}), 6)"


@query("s6_29_depth_imbalance", f"{DEPTH} SELECT symbol, seq, {_imb('1')} AS uniform, {_imb('(5 - i)')} AS linear, {_imb('(1 / sqrt(i + 1))')} AS sqrt, {_imb('(1.0 / (i + 1))')} AS harmonic, round((ask - bid) / ((ask + bid) / 2) * 1e4, 6) AS spread_bps FROM dp")
def _(spark, d):
    x = _depth(spark, d)
    return x.select("symbol", "seq", *[ft.depth_imbalance("bq", "aq", 5, s).alias(s) for s in ("uniform", "linear", "sqrt", "harmonic")], ((F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) * 1e4).alias("spread_bps"))


@query("s6_36_har_forecast", RET + f""", x AS (SELECT symbol, ts, abs(lr) AS y0, avg(abs(lr)) {_last(1)} AS x0, avg(abs(lr)) {_last(5)} AS x1, avg(abs(lr)) {_last(22)} AS x2 FROM r WHERE lr IS NOT NULL),
    p AS (SELECT *, lag(x0) OVER w AS p0, lag(x1) OVER w AS p1, lag(x2) OVER w AS p2, CASE WHEN lag(x0) OVER w IS NOT NULL THEN y0 END AS y FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    c AS (SELECT *, count(y) {RUN} AS n, avg(y) {RUN} AS my, avg(p0) {RUN} AS m0, avg(p1) {RUN} AS m1, avg(p2) {RUN} AS m2, covar_pop(p0, p0) {RUN} AS a, covar_pop(p0, p1) {RUN} AS b, covar_pop(p0, p2) {RUN} AS c, covar_pop(p1, p1) {RUN} AS d, covar_pop(p1, p2) {RUN} AS e, covar_pop(p2, p2) {RUN} AS f, covar_pop(p0, y) {RUN} AS u, covar_pop(p1, y) {RUN} AS v, covar_pop(p2, y) {RUN} AS w FROM p),
    s AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM c)
    SELECT symbol, {TS}, CASE WHEN n >= 100 THEN round(greatest(my + (u * (d * f - e * e) - b * (v * f - e * w) + c * (v * e - d * w)) / det * (x0 - m0) + (a * (v * f - e * w) - u * (b * f - e * c) + c * (b * w - v * c)) / det * (x1 - m1) + (a * (d * w - v * e) - b * (b * w - v * c) + u * (b * e - d * c)) / det * (x2 - m2), 1e-12), 5) END AS forecast FROM s""")
def _(spark, d):
    x = _rets(spark, d).where("lr is not null").withColumn("rv", F.abs("lr"))
    return models.har_forecast(x, "rv").select("symbol", "ts", F.round("forecast", 5).alias("forecast"))


@query("s6_37_arch_lm", RET + """, x AS (SELECT symbol, lr * lr AS y, lag(lr * lr) OVER w AS a, lag(lr * lr, 2) OVER w AS b FROM r WHERE lr IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    m AS (SELECT symbol, count(*) AS n, var_pop(a) AS aa, covar_pop(a, b) AS ab, var_pop(b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS b_y, var_pop(y) AS yy FROM x WHERE b IS NOT NULL GROUP BY 1)
    SELECT symbol, n, round(n * ((ay * bb - ab * b_y) * ay + (aa * b_y - ab * ay) * b_y) / (aa * bb - ab * ab) / yy, 5) AS lm FROM m""")
def _(spark, d):
    return models.arch_lm(_rets(spark, d), "lr").withColumn("lm", F.round("lm", 5))


@query("s6_39_hawkes_imbalance", f"""WITH {T}, s AS (SELECT a.symbol, a.trade_id, sum(CASE WHEN b.side = 'buy' THEN exp(-0.001 * (epoch(a.ts) - epoch(b.ts))) ELSE 0 END) AS u, sum(CASE WHEN b.side = 'sell' THEN exp(-0.001 * (epoch(a.ts) - epoch(b.ts))) ELSE 0 END) AS w FROM ticks a JOIN ticks b ON a.symbol = b.symbol AND b.ts <= a.ts GROUP BY 1, 2)
    SELECT symbol, trade_id, round((u - w) / (u + w), 6) AS imbalance FROM s""")
def _(spark, d):
    return ft.side_intensity(v.ticks(spark, d), 0.001).select("symbol", "trade_id", "imbalance")


@query("s6_40_kalman_level", f"""WITH RECURSIVE {B}, n AS (SELECT symbol, ts, close AS z, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars),
    r AS (SELECT symbol, ts, i, z * (1 + 1e-3::DOUBLE) / (1 + 1e-3::DOUBLE + 1e-1::DOUBLE) AS x, (1 - (1 + 1e-3::DOUBLE) / (1 + 1e-3::DOUBLE + 1e-1::DOUBLE)) * (1 + 1e-3::DOUBLE) AS p FROM n WHERE i = 1
    UNION ALL SELECT n.symbol, n.ts, n.i, r.x + (r.p + 1e-3::DOUBLE) / (r.p + 1e-3::DOUBLE + 1e-1::DOUBLE) * (n.z - r.x), (1 - (r.p + 1e-3::DOUBLE) / (r.p + 1e-3::DOUBLE + 1e-1::DOUBLE)) * (r.p + 1e-3::DOUBLE) FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1) SELECT symbol, {TS}, round(x, 6) AS level FROM r""")
def _(spark, d):
    return states.kalman_level(v.bars(spark, d), "close", 1e-3, 1e-1)


@query("s6_42_rolling_beta", LEGS + f""", l AS (SELECT ts, ln(c1) AS y, ln(c2) AS x FROM p) SELECT {TS}, CASE WHEN count(*) OVER w >= 60 THEN round(covar_pop(y, x) OVER w / nullif(var_pop(x) OVER w, 0), 6) END AS beta FROM l WINDOW w AS (ORDER BY ts ROWS 59 PRECEDING)""")
def _(spark, d):
    return ft.rolling_beta(legs(spark, d).select(F.lit("pair").alias("symbol"), "ts", F.ln("c1").alias("y"), F.ln("c2").alias("x")), 60).select("ts", "beta")


@query("s6_51_online_shortfall", f"""WITH RECURSIVE {FL}, f AS (SELECT symbol, ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE side WHEN 'buy' THEN price - p_retailprice ELSE p_retailprice - price END / p_retailprice * 1e4 AS bps FROM fills JOIN part ON l_partkey = p_partkey),
    n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM f),
    r AS (SELECT symbol, i, bps AS e FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.i, r.e * 0.95 + n.bps * 0.05 FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1) SELECT symbol, CAST(i AS INTEGER) AS i, round(e, 3) AS smooth FROM r WHERE i % 1 = 0""")
def _(spark, d):
    from lodestream.functions.numbers import shortfall_bps
    from lodestream.operators.scan import affine_scan, numbered
    from lodestream.session import table

    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("mid"))
    order = ("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x = v.fills(spark, d).join(p, "l_partkey").withColumn("bps", shortfall_bps(F.col("side"), F.col("price"), F.col("mid")))
    x = numbered(x, order, name="i", span="90 days")
    return affine_scan(x, 0.95, 0.05 * F.col("bps"), order, name="smooth", first=F.col("bps")).select("symbol", (F.col("i") + 1).cast("int").alias("i"), F.round("smooth", 3).alias("smooth"))


FWD = f"WITH {B}, f AS (SELECT symbol, ts, volume, (high - low) / close AS range, close - open AS body, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS r FROM bars), y AS (SELECT * FROM f WHERE r IS NOT NULL)"


def _fwd(spark, d):
    x = v.bars(spark, d)
    return x.select("symbol", "ts", "volume", ((F.col("high") - F.col("low")) / F.col("close")).alias("range"), (F.col("close") - F.col("open")).alias("body"), (F.lead("close").over(ft.series()) / F.col("close") - 1).alias("r")).where("r is not null")


def _bin(c: str, q: int) -> str:
    edges = ", ".join(f"quantile_cont({c}, {i / q})" for i in range(1, q))
    return f"e_{c} AS (SELECT list_filter(list_distinct([{edges}]), lambda z: z > lo AND z < hi) AS e FROM (SELECT *, min({c}) OVER () AS lo, max({c}) OVER () AS hi FROM y) GROUP BY lo, hi), b_{c} AS (SELECT '{c}' AS feature, r, CAST(len(list_filter(e, lambda z: z < {c})) AS INTEGER) AS bin FROM y, e_{c})"


REPORT = FWD + f""", {_bin('range', 5)}, {_bin('body', 5)}, u AS (SELECT * FROM b_range UNION ALL SELECT * FROM b_body), g AS (SELECT feature, bin, count(*) AS n, avg(r) AS mean, sum(r) AS s FROM u GROUP BY 1, 2), l AS (SELECT feature, bin, n, mean, mean - sum(s) OVER w / sum(n) OVER w AS lift FROM g WINDOW w AS (PARTITION BY feature))"""


@query("s8_4_lift_report", REPORT + " SELECT feature, bin, n, round(mean, 6) AS mean, round(lift, 6) AS lift FROM l")
def _(spark, d):
    return models.lift_report(_fwd(spark, d), ["range", "body"], "r", 5)


@query("s7_6_top_features", REPORT + " SELECT feature, round(max(abs(lift)), 6) AS max_lift, round(regr_slope(mean, bin), 6) AS slope FROM l GROUP BY 1 ORDER BY max(abs(lift)) DESC, feature LIMIT 1")
def _(spark, d):
    return models.lift_summary(models.lift_report(_fwd(spark, d), ["range", "body"], "r", 5)).orderBy(F.desc("max_lift"), "feature").limit(1)


@query("s8_1_quintiles", FWD + f""", {_bin('body', 5)}, g AS (SELECT bin, avg(r) AS mean FROM b_body GROUP BY 1), k AS (SELECT bin, mean, mean - lag(mean) OVER (ORDER BY bin) AS dm, rank() OVER (ORDER BY mean) AS rk FROM g)
    SELECT count(*) AS bins, round(min(mean), 6) AS lowest, round(max(mean), 6) AS highest, round(corr(bin, rk), 6) AS spearman, min(dm) >= -1e-12 OR max(dm) <= 1e-12 AS monotonic FROM k""")
def _(spark, d):
    return models.quintiles(_fwd(spark, d), "body", "r", 5)


@query("s8_6_alpha_half_life", f"""WITH {B}, h AS (SELECT volume AS f, unnest([{{'h': 1, 'r': lead(close, 1) OVER w / close - 1}}, {{'h': 6, 'r': lead(close, 6) OVER w / close - 1}}, {{'h': 24, 'r': lead(close, 24) OVER w / close - 1}}, {{'h': 72, 'r': lead(close, 72) OVER w / close - 1}}]) AS s FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    x AS (SELECT f, s.h AS horizon, s.r AS r FROM h WHERE s.r IS NOT NULL), k AS (SELECT *, rank() OVER (PARTITION BY horizon ORDER BY f) + (count(*) OVER (PARTITION BY horizon, f) - 1) / 2 AS rf, rank() OVER (PARTITION BY horizon ORDER BY r) + (count(*) OVER (PARTITION BY horizon, r) - 1) / 2 AS rr FROM x),
    i AS (SELECT horizon, corr(rf, rr) AS ic FROM k GROUP BY 1), m AS (SELECT count(*) AS n, regr_slope(ln(abs(ic)), horizon) AS slope FROM i WHERE abs(ic) > 1e-4) SELECT n, round(slope, 6) AS slope, round(CASE WHEN n >= 3 AND -slope > 1e-4 THEN ln(2) / -slope END, 4) AS half_life FROM m""")
def _(spark, d):
    return models.alpha_half_life(stats.information_coefficients(v.bars(spark, d), "volume", (1, 6, 24, 72)), 1e-4).withColumn("half_life", F.round("half_life", 4))


@query("s8_7_kendall", f"""WITH {B}, x AS (SELECT symbol, date_trunc('day', ts) AS day, ts, volume AS a, high - low AS b FROM bars), p AS (SELECT x.symbol, x.day, sign(x.a - y.a) * sign(x.b - y.b) AS s FROM x JOIN x y ON x.symbol = y.symbol AND x.day = y.day AND x.ts < y.ts) SELECT symbol, CAST(epoch(day) AS BIGINT) AS day, count(*) AS pairs, round(avg(s), 6) AS tau FROM p GROUP BY 1, day""")
def _(spark, d):
    x = v.bars(spark, d).select("symbol", F.date_trunc("day", "ts").alias("day"), "ts", F.col("volume").alias("a"), (F.col("high") - F.col("low")).alias("b"))
    return models.kendall(x, "a", "b", ["symbol", "day"])


@query("s8_8_quantiles_mad", RET + ", m AS (SELECT symbol, quantile_cont(lr, 0.5) AS med, quantile_cont(lr, 0.1) AS p10, quantile_cont(lr, 0.9) AS p90 FROM r GROUP BY 1) SELECT symbol, round(med, 6) AS median, round(p10, 6) AS p10, round(p90, 6) AS p90, round(quantile_cont(abs(lr - med), 0.5), 6) AS mad FROM r JOIN m USING (symbol) GROUP BY symbol, med, p10, p90")
def _(spark, d):
    return stats.quantiles_mad(_rets(spark, d), "lr", ["symbol"])


@query("s8_10_impact_constant", f"""WITH {B}, x AS (SELECT symbol, ts, volume, abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1) AS r, CASE WHEN count(*) {_last(20)} >= 10 THEN sqrt(avg(ln(high / low)) {_last(20)} / (4 * ln(2))) ELSE 0 END AS sg, CASE WHEN count(*) {_last(100)} >= 50 THEN avg(volume) {_last(100)} END AS adv FROM bars),
    k AS (SELECT symbol, r / nullif(sg * sqrt(least(1, coalesce(volume / nullif(adv, 0), 0))), 0) AS k FROM x) SELECT symbol, count(k) AS n, round(quantile_cont(k, 0.5), 6) AS k FROM k WHERE k IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return models.impact_constant(v.bars(spark, d))


SURV = """g AS (SELECT grp, t, count(*) AS n, sum(CAST(e AS INTEGER)) AS events FROM x GROUP BY 1, 2), q AS (SELECT *, CAST(sum(n) OVER (PARTITION BY grp ORDER BY t DESC) AS BIGINT) AS at_risk FROM g),
    s AS (SELECT *, CASE WHEN max(CASE WHEN events = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w) END AS survival FROM q WINDOW w AS (PARTITION BY grp ORDER BY t))"""


@query("s8_16_survival_by_bin", f"""WITH {C}, x AS (SELECT CAST(floor(least(l_quantity, 49.9) / 10) AS INTEGER) AS grp, CAST(greatest(1, date_diff('day', entry_ts, exit_ts)) AS INTEGER) AS t, exit_reason = 'F' AS e FROM closed), {SURV} SELECT grp, min(CASE WHEN survival <= 0.5 THEN t END) AS median, CAST(sum(events) AS BIGINT) AS events FROM s GROUP BY 1""")
def _(spark, d):
    x = v.closed_trades(spark, d).withColumns({"t": F.greatest(F.lit(1), F.date_diff("exit_ts", "entry_ts")), "grp": F.floor(F.least("l_quantity", F.lit(49.9)) / 10).cast("int")})
    curve = stats.kaplan_meier(x, "t", F.col("exit_reason") == "F", ["grp"])
    return models.survival_median(curve, ["grp"]).join(curve.groupBy("grp").agg(F.sum("events").alias("events")), "grp")


@query("s8_17_correlation_distance", RET + " SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(corr(a.lr, b.lr), 6) AS rho, round(sqrt(greatest(0, (1 - corr(a.lr, b.lr)) / 2)), 6) AS distance FROM r a JOIN r b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.lr IS NOT NULL AND b.lr IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return models.correlation_distance(_rets(spark, d), "lr")


@query("s10_15_markout", f"WITH {BK} SELECT symbol, seq, round(CASE WHEN bid_qty > ask_qty THEN 1 ELSE -1 END * (lead((bid + ask) / 2) OVER (PARTITION BY symbol ORDER BY ts, seq) / ((bid + ask) / 2) - 1) * 1e4, 4) AS markout_bps FROM book")
def _(spark, d):
    return ft.markout(v.book(spark, d)).select("symbol", "seq", F.round("markout_bps", 4).alias("markout_bps"))


@query("s10_16_var_halt", RET + f", q AS (SELECT symbol, ts, CASE WHEN count(ret) {_last(100)} >= 50 THEN quantile_cont(ret, 0.05) {_last(100)} END AS var_5 FROM r) SELECT symbol, {TS}, round(var_5, 6) AS var_5, coalesce(var_5 < -0.8, false) AS halt FROM q")
def _(spark, d):
    return ft.var_halt(_rets(spark, d), "ret", 100, 0.05, 0.8).select("symbol", "ts", "var_5", "halt")


@query("s12_4_volatility_target", f"""WITH RECURSIVE {B}, n AS (SELECT symbol, ts, row_number() OVER w AS i, ln(close / lag(close) OVER w) AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    e AS (SELECT symbol, ts, i, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS w2 FROM n WHERE i = 1 UNION ALL
    SELECT n.symbol, n.ts, n.i, e.a * (1 - 2.0::DOUBLE / 51) + n.r, e.b * (1 - 2.0::DOUBLE / 51) + n.r * n.r, e.w * (1 - 2.0::DOUBLE / 51) + 1, e.w2 * (1 - 2.0::DOUBLE / 51) * (1 - 2.0::DOUBLE / 51) + 1 FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)
    SELECT symbol, {TS}, CASE WHEN i - 1 >= 25 THEN round(sqrt((b / w - (a / w) * (a / w)) * w * w / (w * w - w2)), 6) END AS target FROM e""")
def _(spark, d):
    return models.ewm_volatility(_rets(spark, d), "lr", 50).select("symbol", "ts", "target")


@query("s12_6_dataset", STATE + f""", r2 AS (SELECT *, close / lag(close) OVER w - 1 AS ret_1, close / lag(close, 5) OVER w - 1 AS ret_5, lead(close, 6) OVER w / close - 1 AS fwd, stddev_samp(lr) {_last(20)} AS sd FROM lv WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, {TS}, round(rsi, 6) AS rsi, round(atr, 6) AS atr, round(ret_5, 6) AS ret_5, CAST(CASE WHEN abs(fwd) <= 0.1 THEN 0 ELSE sign(fwd) END AS INTEGER) AS label FROM r2 WHERE fwd IS NOT NULL AND ret_5 IS NOT NULL AND sd IS NOT NULL""")
def _(spark, d):
    return models.labelled_dataset(v.bars(spark, d), 6, 0.1).select("symbol", "ts", "rsi", "atr", "ret_5", "label")


@query("s12_9_time_decay", f"""WITH {B}, c AS (SELECT symbol, ts, volume, sum(volume) {RUN} AS c, sum(volume) OVER (PARTITION BY symbol) AS t FROM bars), w AS (SELECT *, greatest(0, 1 - 0.5 / t * (t - c)) AS w FROM c) SELECT symbol, {TS}, round(w / sum(w) OVER (PARTITION BY symbol), 8) * 1e3 AS decayed FROM w""".replace("round(w / sum(w) OVER (PARTITION BY symbol), 8) * 1e3", "round(w / sum(w) OVER (PARTITION BY symbol) * 1e3, 6)"))
def _(spark, d):
    return models.time_decay(v.bars(spark, d), "volume", 0.5).select("symbol", "ts", (F.col("decayed") * 1e3).alias("decayed"))


@query("s12_11_purged_by_end", BARRIER + f""", s AS (SELECT symbol, ts, coalesce(lt, et) AS t1, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM t), f AS (SELECT *, unnest(range(4)) AS fold, n // 4 AS size FROM s), g AS (SELECT *, max(CASE WHEN i = fold * size THEN ts END) OVER (PARTITION BY symbol, fold) AS start FROM f),
    r AS (SELECT symbol, fold, CASE WHEN i >= fold * size AND i < fold * size + size THEN 'test' WHEN (i < fold * size AND t1 > start) OR (i >= fold * size + size AND i < fold * size + size + floor(n * 0.02)) THEN 'purged' ELSE 'train' END AS role FROM g) SELECT symbol, CAST(fold AS INTEGER) AS fold, role, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def _(spark, d):
    e = labels.triple_barrier(_sided(v.bars(spark, d)), "target", 1.0, 1.0, 12, side="side").select("symbol", "ts", "t1")
    return models.purged_by_end(e, 4, 0.02).groupBy("symbol", "fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query("s12_15_prediction_scores", f"""WITH {B}, x AS (SELECT symbol, ts, close, 0.5 + 0.4 * (close - open) / (high - low + 1) AS p, CASE WHEN lead(close) OVER w > close THEN 1 ELSE 0 END AS up FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), y AS (SELECT *, coalesce(lag(sign(p - 0.5)) OVER w, 0) AS pos, coalesce(close / lag(close) OVER w - 1, 0) AS r FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    z AS (SELECT *, pos * r - abs(pos - coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY ts), 0)) * 0.0006 AS s FROM y) SELECT symbol, count(*) AS n, round(-avg(ln(greatest(1e-9, least(1 - 1e-9, CASE WHEN up = 1 THEN p ELSE 1 - p END)))), 6) AS logloss, round(avg(s) / nullif(stddev_pop(s), 0) * sqrt(count(*)), 6) AS sharpe FROM z GROUP BY 1""")
def _(spark, d):
    x = v.bars(spark, d).withColumns({"p": 0.5 + 0.4 * (F.col("close") - F.col("open")) / (F.col("high") - F.col("low") + 1), "up": F.when(F.lead("close").over(ft.series()) > F.col("close"), 1).otherwise(0)})
    return models.prediction_scores(x, "p", "up", 0.0006)


@query("s12_16_stacking", FWD + f""", i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) // 5 AS size FROM y), k AS (SELECT *, CAST(least(i // size, 4) AS INTEGER) AS fold FROM i),
    t AS (SELECT *, unnest(range(fold, 5)) AS f FROM k), m AS (SELECT symbol, CAST(f AS INTEGER) AS fold, sum(range * range) + 1 AS aa, sum(range * body) AS ab, sum(body * body) + 1 AS bb, sum(range * r) AS ay, sum(body * r) AS b_y, stddev_pop(r) AS sd FROM t WHERE f > 0 AND i < f * size - 5 GROUP BY 1, 2)
    SELECT k.symbol, CAST(floor(epoch(k.ts)) AS BIGINT) AS ts, k.fold, round(coalesce(greatest(-1, least(1, ((ay * bb - ab * b_y) / (aa * bb - ab * ab) * range + (aa * b_y - ab * ay) / (aa * bb - ab * ab) * body) / sd)), 0), 6) AS signal FROM k LEFT JOIN m ON k.symbol = m.symbol AND k.fold = m.fold""")
def _(spark, d):
    return models.stacked(_fwd(spark, d), ("range", "body"), "r", 5, 5).select("symbol", "ts", "fold", "signal")


@query("s12_20_dissimilarity", FWD + f""", m AS (SELECT symbol, avg(range) AS m1, stddev_pop(range) AS s1, avg(body) AS m2, stddev_pop(body) AS s2 FROM y WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), z AS (SELECT symbol, ts, body, sqrt((((range - m1) / s1) ** 2 + ((body - m2) / s2) ** 2) / 2) AS di FROM y JOIN m USING (symbol))
    SELECT symbol, {TS}, round(di, 6) AS di, CASE WHEN di <= 1.2 THEN sign(body) ELSE 0 END::DOUBLE AS kept_signal FROM z""")
def _(spark, d):
    x = _fwd(spark, d)
    x = models.dissimilarity(x, x.where("ts < '2024-01-15'"), ["range", "body"], 1.2)
    return x.select("symbol", "ts", "di", F.when(F.col("familiar"), F.signum("body")).otherwise(0.0).alias("kept_signal"))


def _adf_sql(src: str) -> str:
    return f"""a AS (SELECT run, ts, lag(x) OVER w AS l, x - lag(x) OVER w AS d FROM {src} WINDOW w AS (PARTITION BY run ORDER BY ts)), b AS (SELECT *, lag(d) OVER (PARTITION BY run ORDER BY ts) AS k FROM a),
    m AS (SELECT run, count(*) AS n, var_pop(l) AS s0, covar_pop(l, k) AS s1, var_pop(k) AS s2, covar_pop(l, d) AS s3, covar_pop(k, d) AS s4, var_pop(d) AS s5 FROM b WHERE k IS NOT NULL GROUP BY 1), c AS (SELECT *, (s3 * s2 - s4 * s1) / (s0 * s2 - s1 * s1) AS bb, (s0 * s4 - s1 * s3) / (s0 * s2 - s1 * s1) AS g FROM m),
    tt AS (SELECT run, bb / sqrt(n * (s5 - bb * s3 - g * s4) / (n - 3) * s2 / (s0 * s2 - s1 * s1) / n) AS t FROM c)"""


def _ffd(dd: float) -> str:
    return " + ".join(f"({w!r}) * lag(ln(close), {k}) OVER w" for k, w in enumerate(ft.ffd_weights(dd, 4)))


@query("s12_24_least_difference", f"""WITH {B}, v0 AS ({' UNION ALL '.join(f"SELECT symbol || '@{dd}' AS run, ts, {_ffd(dd)} AS x FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)" for dd in (0.0, 0.3, 0.6))}), v AS (SELECT * FROM v0 WHERE x IS NOT NULL), {_adf_sql('v')}
    SELECT split_part(run, '@', 1) AS symbol, min(CASE WHEN t < -20 THEN CAST(split_part(run, '@', 2) AS DOUBLE) END) AS least_d, round(min(t), 5) AS best_t FROM tt GROUP BY 1""")
def _(spark, d):
    x = v.bars(spark, d).withColumn("lc", F.ln("close"))
    return models.least_difference(x, "lc", (0.0, 0.3, 0.6), 4, -20.0).withColumn("best_t", F.round("best_t", 5))


@query("s13_2_pnl_funding", REVERSION + f""", {FU}, fb AS (SELECT f.symbol, b.ts, sum(f.rate) AS rate FROM funding f ASOF JOIN bars b ON f.symbol = b.symbol AND f.ts >= b.ts GROUP BY 1, 2), p AS (SELECT *, coalesce(lag(sig) OVER w, 0) AS pos, coalesce(close / lag(close) OVER w - 1, 0) AS br, (high - low) / close AS rg FROM mr WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    q AS (SELECT p.symbol, p.ts, pos * 0.01 AS pos, br, rg, abs(pos - coalesce(lag(pos) OVER (PARTITION BY p.symbol ORDER BY p.ts), 0)) * 0.01 AS turnover, coalesce(rate, 0) AS rate FROM p LEFT JOIN fb ON p.symbol = fb.symbol AND p.ts = fb.ts)
    SELECT symbol, {TS}, round(pos * br - turnover * (0.0005 + 0.0001 * greatest(1, rg)) - pos * rate, 8) * 1e2 AS ret FROM q""".replace("round(pos * br - turnover * (0.0005 + 0.0001 * greatest(1, rg)) - pos * rate, 8) * 1e2", "round((pos * br - turnover * (0.0005 + 0.0001 * greatest(1, rg)) - pos * rate) * 100, 6)"))
def _(spark, d):
    x = ac.positions(signals.mean_reversion(v.bars(spark, d)), 0.01)
    rates = joins.asof_join(v.funding(spark, d), v.bars(spark, d).select("symbol", "ts"), cols=["ts"], prefix="bar_").where("bar_ts is not null")
    rates = rates.groupBy("symbol", F.col("bar_ts").alias("ts")).agg(F.sum("rate").alias("rate"))
    return ac.funded_returns(x.join(rates, ["symbol", "ts"], "left"), 0.0005, 0.0001).select("symbol", "ts", (F.col("ret") * 100).alias("ret"))


@query("s13_5_stop_exits", f"""WITH {B}, s AS (SELECT *, CASE WHEN close > open THEN 1 ELSE -1 END AS sig FROM bars), p AS (SELECT *, coalesce(lag(sig) OVER w, 0) AS pos, lag(close) OVER w AS pc FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts)), c AS (SELECT *, CASE WHEN pos IS NOT DISTINCT FROM lag(pos) OVER (PARTITION BY symbol ORDER BY ts) THEN 0 ELSE 1 END AS ch FROM p),
    r AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM c), l AS (SELECT *, first_value(pc) OVER (PARTITION BY symbol, run ORDER BY ts) AS entry FROM r), h AS (SELECT *, pos <> 0 AND CASE WHEN pos > 0 THEN low <= entry * 0.6 ELSE high >= entry * 1.4 END AS st, pos <> 0 AND CASE WHEN pos > 0 THEN high >= entry * 1.8 ELSE low <= entry * 0.2 END AS tp FROM l),
    f AS (SELECT *, min(CASE WHEN st OR tp THEN ts END) OVER (PARTITION BY symbol, run) AS hit FROM h) SELECT symbol, {TS}, CASE WHEN hit IS NOT NULL AND ts > hit THEN 0.0 ELSE pos END::DOUBLE AS pos, round(CASE WHEN ts = hit THEN pos * (entry * CASE WHEN st THEN CASE WHEN pos > 0 THEN 0.6 ELSE 1.4 END ELSE CASE WHEN pos > 0 THEN 1.8 ELSE 0.2 END END / pc - 1) END, 6) AS exit_ret FROM f""")
def _(spark, d):
    x = v.bars(spark, d).withColumn("sig", F.when(F.col("close") > F.col("open"), 1.0).otherwise(-1.0))
    return ac.stop_exits(ac.positions(x), 0.4, 0.8).select("symbol", "ts", "pos", "exit_ret")


@query("s13_8_delta_neutral", LEGS + f""", b AS (SELECT *, c1 / c2 - 1 AS basis FROM p), {FU}, f AS (SELECT x.ts, sum(rate) AS rate FROM (SELECT * FROM funding WHERE symbol = 'S0') f ASOF JOIN b x ON f.ts >= x.ts GROUP BY 1), s AS (SELECT *, CASE WHEN basis > 0 THEN 1 ELSE -1 END AS sig FROM b), q AS (SELECT s.ts, basis, coalesce(lag(sig) OVER w, 0) * 0.01 AS pos, coalesce(basis - lag(basis) OVER w, 0) AS db FROM s WINDOW w AS (ORDER BY s.ts))
    SELECT CAST(floor(epoch(q.ts)) AS BIGINT) AS ts, round((-pos * db + pos * coalesce(rate, 0) - abs(pos - coalesce(lag(pos) OVER (ORDER BY q.ts), 0)) * 2 * 0.0002) * 100, 6) AS ret FROM q LEFT JOIN f ON q.ts = f.ts""")
def _(spark, d):
    x = legs(spark, d).withColumn("symbol", F.lit("S0")).withColumn("basis", F.col("c1") / F.col("c2") - 1).withColumn("sig", F.when(F.col("basis") > 0, 1.0).otherwise(-1.0))
    rates = joins.asof_join(v.funding(spark, d).where("symbol = 'S0'"), x.select("symbol", "ts"), cols=["ts"], prefix="bar_").where("bar_ts is not null").groupBy("symbol", F.col("bar_ts").alias("ts")).agg(F.sum("rate").alias("rate"))
    return ac.delta_neutral(ac.positions(x, 0.01).join(rates, ["symbol", "ts"], "left"), 0.0002).select("ts", (F.col("ret") * 100).alias("ret"))


@query("s13_9_pairs_portfolio", f"""WITH {B}, l AS (SELECT a.symbol || '-' || b.symbol AS pair, a.ts, 0.01 * (ln(a.close / lag(a.close) OVER w) - ln(b.close / lag(b.close) OVER w)) AS r FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol WINDOW w AS (PARTITION BY a.symbol, b.symbol ORDER BY a.ts)) SELECT {TS}, count(r) AS pairs, round(sum(coalesce(r, 0) / 28), 6) AS ret FROM l GROUP BY ts""")
def _(spark, d):
    x = v.bars(spark, d).select("ts", "symbol", "close")
    y = x.select("ts", F.col("symbol").alias("s2"), F.col("close").alias("c2"))
    p = x.join(y, "ts").where("symbol < s2").withColumn("pair", F.concat_ws("-", "symbol", "s2"))
    w = Window.partitionBy("pair").orderBy("ts")
    p = p.withColumn("r", 0.01 * (F.ln(F.col("close") / F.lag("close").over(w)) - F.ln(F.col("c2") / F.lag("c2").over(w))))
    return ac.portfolio(p, p.select("pair").distinct().withColumn("weight", F.lit(1 / 28)), "pair", "r").withColumnRenamed("n", "pairs")


@query("s13_11_buy_and_hold", RET + ", l AS (SELECT symbol, coalesce(lag(coalesce(ret, 0)) OVER (PARTITION BY symbol ORDER BY ts), 0) AS x FROM r) SELECT symbol, count(*) AS n, round(avg(x) / nullif(stddev_pop(x), 0) * sqrt(8760), 6) AS sharpe FROM l GROUP BY 1")
def _(spark, d):
    return ac.buy_and_hold(v.bars(spark, d), 8760)


@query("s13_15_sensitivity", f"""WITH {B}, z AS (SELECT *, CASE WHEN count(*) {_last(24)} >= 24 THEN coalesce((close - avg(close) {_last(24)}) / nullif(stddev_pop(close) {_last(24)}, 0), 0) END AS z, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS fwd FROM bars), g AS (SELECT *, unnest([0.5, 1.0, 1.5, 2.0])::DOUBLE AS enter FROM z),
    m AS (SELECT symbol, enter, avg(CASE WHEN z >= enter THEN -fwd WHEN z <= -enter THEN fwd ELSE 0 END) / nullif(stddev_pop(CASE WHEN z >= enter THEN -fwd WHEN z <= -enter THEN fwd ELSE 0 END), 0) AS metric FROM g WHERE fwd IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, abs(metric - lag(metric) OVER (PARTITION BY symbol ORDER BY enter)) AS d FROM m)
    SELECT symbol, arg_max(enter, metric) AS best, round(max(metric), 6) AS best_metric, round(CASE WHEN count(*) > 2 AND stddev_pop(metric) > 0 THEN 1 - least(1, avg(d) / greatest(stddev_pop(metric), 1e-9)) ELSE 1 END, 6) AS smoothness FROM s GROUP BY 1""")
def _(spark, d):
    x = v.bars(spark, d).withColumns({"z": ft.full(ft.zscore("close", 24), 24), "fwd": F.lead("close").over(ft.series()) / F.col("close") - 1}).where("fwd is not null")
    x = models.grid(x.select("symbol", "z", "fwd"), {"enter": (0.5, 1.0, 1.5, 2.0)})
    r = F.when(F.col("z") >= F.col("enter"), -F.col("fwd")).when(F.col("z") <= -F.col("enter"), F.col("fwd")).otherwise(0.0)
    m = x.groupBy("symbol", "enter").agg((F.avg(r) / F.nullif(F.stddev_pop(r), F.lit(0.0))).alias("metric"))
    return models.sensitivity(m, "enter", by=["symbol"])


@query("s13_20_cost_concentration", PNL + """, tr AS (SELECT symbol, run, sum(ret) AS r FROM (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM (SELECT *, CASE WHEN pos = lag(pos) OVER (PARTITION BY symbol ORDER BY ts) THEN 0 ELSE 1 END AS ch FROM eq)) WHERE pos <> 0 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY r DESC, run) AS k FROM tr)
    SELECT symbol, 'baseline' AS scenario, round(sum(ret), 6) AS total, count(*) AS n FROM eq GROUP BY 1 UNION ALL SELECT symbol, 'costs doubled', round(sum(ret - turnover * 0.0001), 6), count(*) FROM eq GROUP BY 1 UNION ALL SELECT symbol, 'without best', round(sum(r), 6), count(*) FROM k WHERE k > 5 GROUP BY 1""")
def _(spark, d):
    return ac.cost_concentration(_pnl(spark, d), 0.0001, 5)


@query("s13_22_simple_pbo", RET + """, s AS (SELECT symbol, date_trunc('day', ts) AS day, avg(ret) / nullif(stddev_pop(ret), 0) AS sr FROM r WHERE ret IS NOT NULL GROUP BY 1, date_trunc('day', ts)), m AS (SELECT symbol, count(*) AS n, avg(CASE WHEN sr < 0.1 THEN 1.0 ELSE 0 END) AS share FROM s WHERE sr IS NOT NULL GROUP BY 1)
    SELECT symbol, n, round(least(1, share ** n * log2(greatest(n, 2)) / log2(32)), 6) AS pbo FROM m""")
def _(spark, d):
    x = _rets(spark, d).where("ret is not null").groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg((F.avg("ret") / F.nullif(F.stddev_pop("ret"), F.lit(0.0))).alias("sr")).where("sr is not null")
    return ac.simple_pbo(x, "sr", 0.1)


@query("s11_25_overlay", f"""WITH RECURSIVE {B}, n AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, CASE WHEN close > open * 1.5 THEN 1.0::DOUBLE WHEN close < open * 0.7 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS want FROM bars),
    r AS (SELECT symbol, ts, i, want AS pos, CASE WHEN want <> 0 THEN 1 ELSE 0 END AS held, CASE WHEN want <> 0 THEN 1 ELSE 0 END AS today FROM n WHERE i = 1
    UNION ALL SELECT symbol, ts, i, CASE WHEN young THEN CASE WHEN want = 0 THEN 0 WHEN (want > 0) <> (pos > 0) THEN pos ELSE want END WHEN opens AND today >= 2 THEN pos ELSE want END,
    CASE WHEN young THEN CASE WHEN want = 0 THEN 0 ELSE held + 1 END WHEN opens AND today >= 2 THEN CASE WHEN pos <> 0 THEN held + 1 ELSE held END WHEN opens THEN 1 WHEN want = 0 THEN 0 ELSE held + 1 END, CASE WHEN NOT young AND opens AND today < 2 THEN today + 1 ELSE today END
    FROM (SELECT *, pos <> 0 AND held < 3 AS young, want <> 0 AND (pos = 0 OR (want > 0) <> (pos > 0)) AS opens FROM (SELECT n.symbol, n.ts, n.i, n.want, r.pos, r.held, CASE WHEN CAST(n.ts AS DATE) = CAST(r.ts AS DATE) THEN r.today ELSE 0 END AS today FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)))
    SELECT symbol, {TS}, pos FROM r""")
def _(spark, d):
    want = F.when(F.col("close") > F.col("open") * 1.5, 1.0).when(F.col("close") < F.col("open") * 0.7, -1.0).otherwise(0.0)
    return states.overlay(v.bars(spark, d).withColumn("want", want), "want", 3, 2)


@query("s11_11_time_stop", LEGS + f""", z AS (SELECT *, 'pair' AS symbol, ln(c1 / c2) AS sp, CASE WHEN ln(c1 / c2) > 0.5 THEN -1 WHEN ln(c1 / c2) < -0.5 THEN 1 ELSE 0 END AS sig FROM p), d AS (SELECT *, sp - lag(sp) OVER w AS ds, lag(sp) OVER w AS s1 FROM z WINDOW w AS (ORDER BY ts)),
    h AS (SELECT *, CASE WHEN count(ds) OVER w >= 60 AND covar_pop(ds, s1) OVER w < 0 THEN -ln(2) * var_pop(s1) OVER w / (covar_pop(ds, s1) OVER w) END AS hl FROM d WINDOW w AS (ORDER BY ts ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)), g AS (SELECT *, sum(CASE WHEN sig = 0 THEN 1 ELSE 0 END) OVER (ORDER BY ts) AS run FROM h), k AS (SELECT *, sum(CASE WHEN sig <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY ts) AS held FROM g)
    SELECT {TS}, CASE WHEN held > 2 * hl THEN 0 ELSE sig END::DOUBLE AS sig FROM k""")
def _(spark, d):
    x = legs(spark, d).withColumn("symbol", F.lit("pair")).withColumn("spread", F.ln(F.col("c1") / F.col("c2")))
    x = x.withColumn("sig", F.when(F.col("spread") > 0.5, -1.0).when(F.col("spread") < -0.5, 1.0).otherwise(0.0))
    return signals.time_stop(x, "spread", 2.0, 120).select("ts", "sig")
