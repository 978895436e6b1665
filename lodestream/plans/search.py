"""Queries on sweeps, searches, audits and gaps, each one job over all series."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream import views as v
from lodestream.operators import accounting as ac
from lodestream.operators import features as ft
from lodestream.operators import portfolio, search, signals, states
from lodestream.plans.market import BK, TS, B, T, _last
from lodestream.plans.models import FWD, _fwd, _rets
from lodestream.plans.regimes import STATE
from lodestream.plans.registry import ORACLE_SQL, query
from lodestream.plans.research import HELD

INTERVALS = {"1h": "1 hour", "4h": "4 hours", "1d": "1 day"}
CELL_BARS = f"WITH {T}, bars AS (" + " UNION ALL ".join(
    f"SELECT symbol || '@{k}' AS symbol, time_bucket(INTERVAL {e}, ts) AS ts, arg_min(price, (ts, trade_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, trade_id)) AS close, sum(amount) AS volume FROM ticks GROUP BY symbol, time_bucket(INTERVAL {e}, ts)"
    for k, e in INTERVALS.items()
) + ")"


def with_bar(x):
    return x.withColumn("sig", F.when(F.col("close") > F.col("open"), 1.0).when(F.col("close") < F.col("open"), -1.0).otherwise(0.0))


@query("s13_14_sweep", CELL_BARS + f""", {HELD}, sg AS (SELECT 'reversion' AS strategy, symbol, ts, close, sig FROM sig UNION ALL SELECT 'with_bar', symbol, ts, close, CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END FROM bars),
    p AS (SELECT *, 0.01 * coalesce(lag(sig) OVER w, 0) AS pos, coalesce(close / lag(close) OVER w - 1, 0) AS br FROM sg WINDOW w AS (PARTITION BY strategy, symbol ORDER BY ts)), q AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY strategy, symbol ORDER BY ts), 0) AS before FROM p), r AS (SELECT *, pos * br - abs(pos - before) * 0.0004 AS ret FROM q)
    SELECT strategy, split_part(symbol, '@', 1) AS symbol, split_part(symbol, '@', 2) AS interval, count(*) AS n, CAST(sum(CASE WHEN pos <> 0 AND pos <> before THEN 1 ELSE 0 END) AS BIGINT) AS trades, round(sum(ret), 6) AS total, round(avg(ret) / nullif(stddev_pop(ret), 0), 6) AS sharpe FROM r GROUP BY strategy, symbol""")
def _(spark, d):
    return search.sweep(search.interval_bars(v.ticks(spark, d), INTERVALS), {"reversion": signals.zscore_reversion, "with_bar": with_bar}, 0.01, 0.0004)


def _z(n: int) -> str:
    return f"CASE WHEN count(*) {_last(n)} >= {n} THEN coalesce((close - avg(close) {_last(n)}) / nullif(stddev_pop(close) {_last(n)}, 0), 0) END AS z{n}"


@query("s13_16_parameter_search", f"""WITH {B}, a AS (SELECT *, {_z(12)}, {_z(24)}, {_z(48)}, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS f, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, floor(count(*) OVER (PARTITION BY symbol) * 0.8::DOUBLE) AS m FROM bars),
    b AS (SELECT *, CASE WHEN i < m THEN floor(i * 4 / m) END AS fold FROM a), c AS (SELECT *, i - min(i) OVER (PARTITION BY symbol, fold) >= 2 AS late FROM b), g AS (SELECT symbol, fold, f, unnest([{{'n': 12, 'z': z12}}, {{'n': 24, 'z': z24}}, {{'n': 48, 'z': z48}}]) AS p FROM c WHERE f IS NOT NULL AND (fold IS NULL OR late)),
    h AS (SELECT *, unnest([1.0, 1.5, 2.0])::DOUBLE AS enter FROM g), r AS (SELECT symbol, fold, p.n AS n, enter, CASE WHEN p.z >= enter THEN -f WHEN p.z <= -enter THEN f ELSE 0 END AS r FROM h), e AS (SELECT symbol, n, enter, fold, coalesce(avg(r) / nullif(stddev_pop(r), 0), 0) AS s FROM r GROUP BY 1, 2, 3, 4),
    o AS (SELECT symbol, n, enter, avg(CASE WHEN fold IS NOT NULL THEN s END) AS objective, max(CASE WHEN fold IS NULL THEN s END) AS holdout FROM e GROUP BY 1, 2, 3), k AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS tried, row_number() OVER (PARTITION BY symbol ORDER BY objective DESC, n DESC, enter DESC) AS k FROM o)
    SELECT symbol, tried, n AS length, enter, round(objective, 6) AS objective, round(holdout, 6) AS holdout FROM k WHERE k = 1""")
def _(spark, d):
    return search.parameter_search(v.bars(spark, d), (12, 24, 48), (1.0, 1.5, 2.0))


@query("s12_22_garch_search", f"""WITH RECURSIVE {B}, x AS (SELECT symbol, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM bars), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, avg(r * r) OVER (PARTITION BY symbol) AS v, coalesce(lag(r) OVER (PARTITION BY symbol ORDER BY ts), 0) AS p FROM x WHERE r IS NOT NULL),
    ab AS (SELECT a::DOUBLE AS a, b::DOUBLE AS b FROM (VALUES (0.05), (0.1), (0.2)) t(a), (VALUES (0.6), (0.75)) u(b)), g AS (SELECT symbol, i, a, b, v AS g, r FROM n, ab WHERE i = 1 UNION ALL SELECT n.symbol, n.i, a, b, (1 - a - b) * n.v + a * n.p * n.p + b * g.g, n.r FROM g JOIN n ON n.symbol = g.symbol AND n.i = g.i + 1),
    l AS (SELECT symbol, CAST(floor((i - 1) / 240) AS BIGINT) AS part, a, b, -0.5 * sum(ln(g) + r * r / g) AS ll FROM g GROUP BY 1, 2, 3, 4), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, part ORDER BY ll DESC, a DESC, b DESC) AS k FROM l) SELECT symbol, part, a AS alpha, b AS beta, round(ll, 5) AS ll FROM k WHERE k = 1""")
def _(spark, d):
    x = v.bars(spark, d).withColumn("lr", ft.log_ret("close"))
    return search.garch_search(x, "lr", (0.05, 0.1, 0.2), (0.6, 0.75), 240).withColumn("ll", F.round("ll", 5))


AUDIT = f"""WITH {B}, {HELD}, a AS (SELECT symbol, ts, close, sig, coalesce(close / lag(close) OVER w - 1, 0) AS m, lead(close) OVER w / close - 1 AS f, row_number() OVER w AS i, coalesce(lag(sig, 1) OVER w, 0) AS p1, coalesce(lag(sig, 2) OVER w, 0) AS p2, coalesce(lag(sig, 3) OVER w, 0) AS p3 FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    b AS (SELECT *, p1 * 0.01 * m AS r1, p2 * 0.01 * m AS r2, p3 * 0.01 * m AS r3, sum(p1 * 0.01 * m) {_last(24)} AS s FROM a), zz AS (SELECT symbol, arg_min(i, (s, i)) AS z FROM b WHERE i >= 24 GROUP BY 1),
    cc AS (SELECT b.*, CASE WHEN i <= z AND i > z - 24 THEN r1 * 2 ELSE r1 END AS c FROM b LEFT JOIN zz USING (symbol)), q AS (SELECT *, sum(r1) OVER w AS q0, sum(c) OVER w AS q1 FROM cc WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
    dd AS (SELECT *, q0 - greatest(max(q0) OVER w, 0) AS d0, q1 - greatest(max(q1) OVER w, 0) AS d1 FROM q WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
    me AS (SELECT symbol, count(*) AS n, avg(f) FILTER (sig = -1) AS lo, coalesce(avg(f) FILTER (sig = 0), avg(f) FILTER (sig = -1)) AS mi, avg(f) FILTER (sig = 1) AS hi, (avg(f) FILTER (sig = 1) - avg(f) FILTER (sig = -1)) / nullif(sqrt(var_samp(f) FILTER (sig = 1) / count(f) FILTER (sig = 1) + var_samp(f) FILTER (sig = -1) / count(f) FILTER (sig = -1)), 0) AS welch_t,
    avg(r1) / nullif(stddev_pop(r1), 0) * sqrt(count(*)) AS sharpe_1, avg(r2) / nullif(stddev_pop(r2), 0) * sqrt(count(*)) AS sharpe_2, avg(r3) / nullif(stddev_pop(r3), 0) * sqrt(count(*)) AS sharpe_3, -min(d0) AS base_dd, -min(d1) AS crash_dd, avg(m) / nullif(stddev_pop(m), 0) * sqrt(count(*)) AS benchmark_sharpe FROM dd GROUP BY 1),
    au AS (SELECT *, coalesce((lo <= mi AND mi <= hi) OR (lo >= mi AND mi >= hi), false) AS monotonic, coalesce(sharpe_1 > 0 AND sharpe_2 < 0.5 * sharpe_1, false) AS decays, NOT (base_dd > 0 AND crash_dd > 2.5 * base_dd) AS stress_pass FROM me)"""


def _audit(spark, d):
    return search.extended_audit(signals.zscore_reversion(v.bars(spark, d)))


@query("s13_25_extended_audit", AUDIT + """ SELECT symbol, n, monotonic, round(welch_t, 5) AS welch_t, round(sharpe_1, 5) AS sharpe_1, round(sharpe_2, 5) AS sharpe_2, round(sharpe_3, 5) AS sharpe_3, round(base_dd, 5) AS base_dd, round(crash_dd, 5) AS crash_dd, round(benchmark_sharpe, 5) AS benchmark_sharpe, decays, stress_pass FROM au""")
def _(spark, d):
    x = _audit(spark, d)
    return x.select(*[F.round(c, 5).alias(c) if t == "double" else c for c, t in x.dtypes])


@query("s13_26_cell_audit", AUDIT + """, wi AS (SELECT symbol, ts, r1, i - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM b), wk AS (SELECT symbol, CAST(floor((i - 200) / 72) AS BIGINT) AS win, coalesce(avg(r1) / nullif(stddev_pop(r1), 0) * sqrt(count(*)), 0) AS s FROM wi WHERE n >= 272 AND i >= 200 AND floor((i - 200) / 72) <= floor((n - 272) / 72) GROUP BY 1, 2),
    oo AS (SELECT symbol, avg(s) AS o, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0 END) AS f FROM wk GROUP BY 1), ve AS (SELECT au.*, o, oo.f AS f, concat_ws('; ', CASE WHEN NOT coalesce(o > 0.3, false) THEN 'avg_oos_sharpe' END, CASE WHEN NOT coalesce(oo.f >= 0.5, false) THEN 'oos_pos_frac' END, CASE WHEN NOT monotonic THEN 'quintile' END,
    CASE WHEN decays THEN 'time_decay' END, CASE WHEN NOT stress_pass THEN 'stress' END, CASE WHEN sharpe_1 <= benchmark_sharpe THEN 'benchmark' END) AS reasons FROM au LEFT JOIN oo USING (symbol)) SELECT symbol, round(o, 5) AS avg_oos_sharpe, round(f, 5) AS oos_positive_frac, reasons, CASE WHEN reasons = '' THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ve""")
def _(spark, d):
    w = ft.series()
    x = signals.zscore_reversion(v.bars(spark, d))
    r = x.withColumn("ret", F.coalesce(F.lag("sig").over(w), F.lit(0.0)) * 0.01 * F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)))
    out = search.audit_verdict(search.extended_audit(x), ac.walk_forward(r, 200, 72))
    return out.select("symbol", F.round("avg_oos_sharpe", 5).alias("avg_oos_sharpe"), F.round("oos_positive_frac", 5).alias("oos_positive_frac"), "reasons", "verdict")


@query("s14_10_against_source", f"""WITH {BK}, bars AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_max(bid, (ts, seq)) AS close, arg_max(ask, (ts, seq)) AS other FROM book GROUP BY symbol, date_trunc('hour', ts)), x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
    k AS (SELECT DISTINCT symbol, CAST(floor(unnest(range(1, 41)) * n / 41) AS BIGINT) AS i FROM (SELECT DISTINCT symbol, n FROM x)) SELECT symbol, count(*) AS checked, CAST(sum(CASE WHEN abs(close / other - 1) > 5e-4 THEN 1 ELSE 0 END) AS BIGINT) AS mismatched, round(max(abs(close / other - 1)), 6) AS max_divergence FROM x JOIN k USING (symbol, i) GROUP BY 1""")
def _(spark, d):
    b = v.book(spark, d).groupBy("symbol", F.date_trunc("hour", "ts").alias("ts")).agg(F.max_by("bid", F.struct("ts", "seq")).alias("close"), F.max_by("ask", F.struct("ts", "seq")).alias("other"))
    return search.against_source(b.select("symbol", "ts", "close"), b.select("symbol", "ts", F.col("other").alias("close")), 40, 5e-4)


def _zone(side: str) -> str:
    born, top, bottom = ("low > h2", "low", "h2") if side == "bull" else ("high < l2", "l2", "high")
    src, broken, edge = ("g0", "min(low) OVER w < bo", "low") if side == "bull" else ("bull3", "max(high) OVER w > tp", "high")
    return f"""{side}0 AS (SELECT *, sum(CASE WHEN {born} THEN 1 ELSE 0 END) OVER u AS {side}_run, last_value(CASE WHEN {born} THEN {top} END IGNORE NULLS) OVER u AS tp, last_value(CASE WHEN {born} THEN {bottom} END IGNORE NULLS) OVER u AS bo FROM {src} WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
    {side}1 AS (SELECT *, {side}_run > 0 AND NOT coalesce({broken}, false) AND row_number() OVER w - 1 <= 24 AS live FROM {side}0 WINDOW w AS (PARTITION BY symbol, {side}_run ORDER BY ts ROWS UNBOUNDED PRECEDING)),
    {side}2 AS (SELECT * EXCLUDE (tp, bo, live), CASE WHEN live THEN tp END AS {side}_top, CASE WHEN live THEN bo END AS {side}_bottom, live AND {edge} <= tp AND {edge} >= bo AS touch FROM {side}1),
    {side}3 AS (SELECT * EXCLUDE (touch), touch AND NOT lag(touch, 1, true) OVER (PARTITION BY symbol ORDER BY ts) AS fresh_{side} FROM {side}2)"""


@query("s11_16_gap_strategy", STATE + f""", g0 AS (SELECT *, lag(high, 2) OVER (PARTITION BY symbol ORDER BY ts) AS h2, lag(low, 2) OVER (PARTITION BY symbol ORDER BY ts) AS l2 FROM fe), {_zone('bull')}, {_zone('bear')},
    gp AS (SELECT symbol, i, ts, 0 AS pos, CAST(NULL AS DOUBLE) AS st, CAST(NULL AS DOUBLE) AS tg FROM bear3 WHERE i = 1 UNION ALL SELECT n.symbol, n.i, n.ts, CASE w WHEN 'l' THEN 1 WHEN 's' THEN -1 WHEN 'o' THEN 0 ELSE p.pos END, CASE w WHEN 'l' THEN n.close - 0.5 * n.atr WHEN 's' THEN n.close + 0.5 * n.atr WHEN 'k' THEN p.st END, CASE w WHEN 'l' THEN n.close + n.atr WHEN 's' THEN n.close - n.atr WHEN 'k' THEN p.tg END
        FROM gp p JOIN bear3 n ON n.symbol = p.symbol AND n.i = p.i + 1, LATERAL (SELECT CASE WHEN p.pos = 0 THEN CASE WHEN fresh_bull THEN 'l' WHEN fresh_bear THEN 's' ELSE 'k' END WHEN p.pos = 1 THEN CASE WHEN fresh_bear THEN 's' WHEN low <= p.st OR high >= p.tg THEN 'o' ELSE 'k' END ELSE CASE WHEN fresh_bull THEN 'l' WHEN high >= p.st OR low <= p.tg THEN 'o' ELSE 'k' END END AS w) q)
    SELECT b.symbol, CAST(epoch(b.ts) AS BIGINT) AS ts, round(bull_top, 6) AS bull_top, round(bull_bottom, 6) AS bull_bottom, round(bear_top, 6) AS bear_top, round(bear_bottom, 6) AS bear_bottom, CAST(pos AS INTEGER) AS pos, round(st, 6) AS stop, round(tg, 6) AS target FROM bear3 b JOIN gp ON gp.symbol = b.symbol AND gp.i = b.i""")
def _(spark, d):
    z = search.gap_zones(ft.rsi_atr(v.bars(spark, d)))
    held = states.keyed_scan(z, "symbol", ["ts"], ["high", "low", "close", "atr", "fresh_bull", "fresh_bear"], search.GapState, search.gap_step(0.5, 1.0, True), [("pos", "int"), ("stop", "double"), ("target", "double")])
    return z.select("symbol", "ts", "bull_top", "bull_bottom", "bear_top", "bear_bottom").join(held, ["symbol", "ts"])


IMP = FWD + """, tr AS (SELECT symbol, var_pop(range) AS aa, covar_pop(range, body) AS ab, var_pop(body) AS bb, covar_pop(range, r) AS ay, covar_pop(body, r) AS bt, avg(r) AS my, avg(range) AS ma, avg(body) AS mb FROM y WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1),
    co AS (SELECT *, (ay * bb - bt * ab) / nullif(aa * bb - ab * ab, 0) AS b0, (aa * bt - ab * ay) / nullif(aa * bb - ab * ab, 0) AS b1 FROM tr), te AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM y WHERE ts >= TIMESTAMP '2024-01-15'),
    pe AS (SELECT t.symbol, t.range, t.body, t.r, o.range AS ora, o.body AS obo, t.r - my - b0 * (t.range - ma) - b1 * (t.body - mb) AS e, b0, b1 FROM te t JOIN te o ON o.symbol = t.symbol AND o.i = (t.i * 7919 + 13) % t.n JOIN co ON co.symbol = t.symbol)"""


@query("s12_17_importance", IMP + """ SELECT symbol, 'range' AS feature, round(covar_pop(range, r) ** 2 / nullif(var_pop(range) * var_pop(r), 0), 6) AS single, round(avg((e - b0 * (ora - range)) ** 2) - avg(e ** 2), 4) AS permuted FROM pe GROUP BY 1 UNION ALL SELECT symbol, 'body', round(covar_pop(body, r) ** 2 / nullif(var_pop(body) * var_pop(r), 0), 6), round(avg((e - b1 * (obo - body)) ** 2) - avg(e ** 2), 4) FROM pe GROUP BY 1""")
def _(spark, d):
    x = _fwd(spark, d).where("r is not null")
    out = search.importance(x.where("ts < '2024-01-15'"), x.where("ts >= '2024-01-15'"), ["range", "body"], "r")
    return out.withColumn("permuted", F.round("permuted", 4))


@query("s15_6_combinations", f"""WITH {B}, dy AS (SELECT symbol, CAST(extract(day FROM ts) AS BIGINT) % 6 AS block, count(*) AS n, sum(volume) AS volume FROM bars GROUP BY 1, 2), m AS (SELECT CAST(row_number() OVER (ORDER BY x DESC) - 1 AS BIGINT) AS combo, x FROM range(64) t(x) WHERE bit_count(x) = 3),
    e AS (SELECT combo, b.b AS block FROM m, range(6) b(b) WHERE (x >> (5 - b.b)) & 1 = 1) SELECT symbol, combo, CAST(sum(n) AS BIGINT) AS n, sum(volume) AS volume FROM e JOIN dy USING (block) GROUP BY 1, 2""")
def _(spark, d):
    blocks = v.bars(spark, d).groupBy("symbol", (F.dayofmonth("ts") % 6).alias("member")).agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))
    x = F.broadcast(search.combinations(spark, 6, 3)).join(blocks, "member")  # 60 rows
    return x.groupBy("symbol", F.col("combo").cast("bigint").alias("combo")).agg(F.sum("n").alias("n"), F.sum("volume").alias("volume"))


@query("s12_26_tensors", f"""WITH {BK}, w AS (SELECT symbol, seq, list([bid, bid_qty, ask, ask_qty]) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS 9 PRECEDING) AS t FROM book) SELECT symbol, seq, len(t) AS length, round(t[1][1], 6) AS first_bid, round(t[10][3] + 1e-8, 4) AS last_ask, round(list_sum(list_transform(t, lambda x: x[2] - x[4])), 4) AS balance FROM w WHERE len(t) = 10""")
def _(spark, d):
    x = search.tensors(v.book(spark, d), ["bid", "bid_qty", "ask", "ask_qty"], 10, ("ts", "seq"))
    balance = F.aggregate("tensor", F.lit(0.0), lambda a, r: a + r[1] - r[3])
    return x.select("symbol", "seq", F.size("tensor").cast("bigint").alias("length"), F.col("tensor")[0][0].alias("first_bid"), F.round(F.col("tensor")[9][2] + 1e-8, 4).alias("last_ask"), F.round(balance, 4).alias("balance"))


def _expanding_sql(dd: float, threshold: float) -> str:
    weights = [1.0]
    while abs(new := -weights[-1] * (dd - len(weights) + 1) / len(weights)) >= threshold:
        weights.append(new)
    return " + ".join(f"({x!r}) * coalesce(lag(ln(close), {k}) OVER w, 0)" for k, x in enumerate(weights))


@query("s6_33_expanding_difference", f"WITH {B} SELECT symbol, {TS}, round({_expanding_sql(0.4, 0.01)}, 6) AS fd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)")
def _(spark, d):
    x = v.bars(spark, d).withColumn("lc", F.ln("close"))
    return x.select("symbol", "ts", search.expanding_frac_diff("lc", 0.4, 0.01).alias("fd"))


def _cscv_sql(src: str) -> str:
    """CSCV over 8 blocks of a relation (variant, ts, r): combinations are bit masks, numbered as tuples are."""
    return f"""sb AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY variant ORDER BY ts) - 1) * 8 / count(*) OVER (PARTITION BY variant)) AS BIGINT) AS b FROM {src}), su AS (SELECT variant, b, sum(r) AS s, sum(r * r) AS q, count(r) AS n FROM sb GROUP BY 1, 2),
    ma AS (SELECT CAST(row_number() OVER (ORDER BY x DESC) - 1 AS INTEGER) AS combo, x FROM range(256) t(x) WHERE bit_count(x) = 4), pt AS (SELECT combo, (x >> (7 - b)) & 1 = 1 AS inside, variant, sum(s) AS s, sum(q) AS q, sum(n) AS n FROM su, ma GROUP BY 1, 2, 3),
    sh AS (SELECT *, coalesce(s / n / nullif(sqrt(greatest(q / n - (s / n) * (s / n), 0)), 0), 0) AS sr FROM pt), be AS (SELECT combo, arg_max(variant, (sr, variant)) AS variant FROM sh WHERE inside GROUP BY 1),
    rk AS (SELECT combo, variant, (rank() OVER (PARTITION BY combo ORDER BY sr) + (count(*) OVER (PARTITION BY combo, sr) - 1) / 2) / (count(*) OVER (PARTITION BY combo) + 1) AS w FROM sh WHERE NOT inside)
    SELECT combo, variant AS best, round(w, 6) AS rank, round(ln(w / (1 - w)), 6) AS logit FROM be JOIN rk USING (combo, variant)"""


ORACLE_SQL["s13_23_cscv"] = f"WITH {B}, lr AS (SELECT symbol AS variant, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM bars), vr AS (SELECT * FROM lr WHERE r IS NOT NULL), {_cscv_sql('vr')}"


@query("s12_27_variants", f"""WITH {B}, z AS (SELECT *, {_z(24)}, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS f FROM bars), en AS (SELECT *, unnest([0.5, 1.0, 1.5, 2.0])::DOUBLE AS enter FROM z WHERE f IS NOT NULL),
    vr AS (SELECT CAST(enter AS VARCHAR) AS variant, ts, avg(CASE WHEN z24 >= enter THEN -f WHEN z24 <= -enter THEN f ELSE 0 END) AS r FROM en GROUP BY 1, 2), {_cscv_sql('vr')}""")
def _(spark, d):
    x = v.bars(spark, d).withColumns({"z": ft.full(ft.zscore("close", 24), 24), "f": F.lead("close").over(ft.series()) / F.col("close") - 1}).where("f is not null")
    x = x.withColumn("enter", F.explode(F.array(*[F.lit(e) for e in (0.5, 1.0, 1.5, 2.0)])))
    r = F.when(F.col("z") >= F.col("enter"), -F.col("f")).when(F.col("z") <= -F.col("enter"), F.col("f")).otherwise(0.0)
    return ac.cscv(x.groupBy(F.col("enter").cast("string").alias("variant"), "ts").agg(F.avg(r).alias("r")), 8, ret="r")


@query("s13_32_risk_weights")
def _(spark, d):
    """Weights by equal risk and by hierarchical parity of all symbols, at each week's end."""
    x = _rets(spark, d).where("ret is not null")
    return portfolio.risk_weights(x, "ret", "week")
