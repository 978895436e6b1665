"""Queries on pairs of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream import views as v
from lodestream.functions import numbers
from lodestream.functions import unit_roots as roots
from lodestream.operators import accounting, joins, pairs, resample
from lodestream.operators import features as ft
from lodestream.plans.market import TS, B, _last
from lodestream.plans.models import _adf_sql
from lodestream.plans.regimes import BEFORE, HOLD, STATE, state
from lodestream.plans.registry import query

PR = "pr AS (SELECT a.symbol || '-' || b.symbol AS symbol, b.symbol AS leg, a.ts, a.close AS c1, b.close AS c2, ln(a.close / b.close) AS spread FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol)"


def _all(spark, d):
    return pairs.all_pairs(v.bars(spark, d))


def _position(x: str, src: str, n: int, enter: float, leave: float, tag: str = "") -> str:
    """CTEs that end in po<tag>: z and sig of the band rule on column x."""
    return f"""z{tag} AS (SELECT *, CASE WHEN count({x}) {_last(n)} >= {n // 2} THEN coalesce(({x} - avg({x}) {_last(n)}) / nullif(stddev_pop({x}) {_last(n)}, 0), 0) ELSE 0 END AS z FROM {src}),
    en{tag} AS (SELECT *, CASE WHEN z > {enter} THEN 1 WHEN z < -{enter} THEN -1 END AS ent FROM z{tag}), he{tag} AS (SELECT *, {BEFORE.format('ent')} AS held FROM en{tag}),
    se{tag} AS (SELECT *, CASE WHEN held <> 0 AND abs(z) < {leave} THEN 0 ELSE ent END AS st0 FROM he{tag}), po{tag} AS ({HOLD}se{tag})"""


@query("s3_26_legs", f"""WITH {B}, n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1), j AS (SELECT a.symbol AS a, b.symbol AS b, count(*) AS shared FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1, 2)
    SELECT a, b, shared, x.n - shared AS only_a, y.n - shared AS only_b FROM j JOIN n x ON x.symbol = a JOIN n y ON y.symbol = b""")
def _(spark, d):
    return pairs.legs_present(v.bars(spark, d))


def _phi(x: str) -> str:
    """The normal distribution function in SQL: rational below seven deviations, one tail term of a fraction beyond."""
    a = f"abs({x})"
    up, down = (" + ".join(f"{c!r} * pow({a}, {len(cs) - 1 - k})" for k, c in enumerate(cs)) for cs in (numbers._TAIL_UP, numbers._TAIL_DOWN))
    tail = f"exp(-{a} * {a} / 2) * CASE WHEN {a} < 7 THEN ({up}) / ({down}) ELSE 0.39894228 / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) END"
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"


def _root_sql(src: str, series: int) -> str:
    """A CTE rp: src with the probability p of column t."""
    k = series - 1
    poly = lambda cs: " + ".join(f"({c!r}) * pow(t, {j})" for j, c in enumerate(cs))
    return f"""rx AS (SELECT *, CASE WHEN t <= {roots.SPLIT[k]} THEN {poly(roots.SMALL[k])} ELSE {poly(roots.LARGE[k])} END AS u FROM {src}),
    rp AS (SELECT * EXCLUDE (u), CASE WHEN t < {roots.LEAST[k]} THEN 0 WHEN t > {roots.MOST[k]} THEN 1 WHEN t IS NOT NULL THEN {_phi('u')} END AS p FROM rx)"""


@query("s7_10_pair_ranking", f"""WITH {B}, {PR}, v AS (SELECT symbol AS run, ts, spread AS x FROM pr), {_adf_sql('v')},
    l AS (SELECT run, x - lag(x) OVER w AS d, lag(x) OVER w AS p FROM v WINDOW w AS (PARTITION BY run ORDER BY ts)), h AS (SELECT run, count(*) AS n, CASE WHEN regr_slope(d, p) < 0 THEN -ln(2) / regr_slope(d, p) END AS hl FROM l GROUP BY 1 HAVING count(*) >= 80),
    {_root_sql('tt', 1)}, r AS (SELECT run, n, t, p, hl, coalesce(p <= 0.05 AND hl > 1 AND hl < 200, false) AS tradable FROM h JOIN rp USING (run))
    SELECT run AS symbol, n, round(t, 5) AS t, round(p, 5) AS p, round(hl, 5) AS half_life, tradable, row_number() OVER (ORDER BY tradable DESC, p, hl, run) AS place FROM r""")
def _(spark, d):
    return pairs.rank_pairs(_all(spark, d)).select("symbol", "n", F.round("t", 5).alias("t"), F.round("p", 5).alias("p"), F.round("half_life", 5).alias("half_life"), "tradable", "place")


EG = """ix AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, ln(c1) AS y, ln(c2) AS x FROM {0}),
    es AS (SELECT DISTINCT symbol, i AS e FROM ix WHERE i >= 96 AND ((i - 96) % 24 = 0 OR i = n - 1)), ea AS (SELECT ix.*, e FROM ix JOIN es ON es.symbol = ix.symbol AND i < e AND i >= e - 96),
    fi AS (SELECT symbol, e, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM ea GROUP BY 1, 2), rs AS (SELECT ea.symbol, ea.e, i, y - a - b * x AS u FROM ea JOIN fi ON fi.symbol = ea.symbol AND fi.e = ea.e),
    r1 AS (SELECT *, lag(u) OVER w AS l, u - lag(u) OVER w AS d FROM rs WINDOW w AS (PARTITION BY symbol, e ORDER BY i)), r2 AS (SELECT *, lag(d) OVER (PARTITION BY symbol, e ORDER BY i) AS k FROM r1),
    mo AS (SELECT symbol, e, count(*) AS n, sum(l * l) AS ll, sum(l * k) AS lk, sum(k * k) AS kk, sum(l * d) AS ld, sum(k * d) AS kd, sum(d * d) AS dd FROM r2 WHERE k IS NOT NULL GROUP BY 1, 2),
    bc AS (SELECT *, (ld * kk - kd * lk) / (ll * kk - lk * lk) AS b, (ll * kd - lk * ld) / (ll * kk - lk * lk) AS c FROM mo), te AS (SELECT symbol, e, b / sqrt((dd - b * ld - c * kd) / (n - 2) * kk / (ll * kk - lk * lk)) AS t FROM bc)"""


@query("s8_21_cointegration", f"WITH {B}, {PR}, {EG.format('pr')}, {_root_sql('te', 2)} SELECT symbol, e AS \"end\", round(t, 5) AS t, round(p, 5) AS p, p > 0.05 AS block FROM rp")
def _(spark, d):
    return pairs.cointegration(_all(spark, d), 96, 24).withColumns({"t": F.round("t", 5), "p": F.round("p", 5)})


@query("s11_10_cointegration_gate", f"""WITH {B}, {PR}, {_position('spread', 'pr', 48, 1.5, 0.3)}, {EG.format('po')}, {_root_sql('te', 2)}, g AS (SELECT ix.symbol, ts, sig, coalesce(last_value(CASE WHEN rp.e IS NOT NULL THEN p > 0.05 END IGNORE NULLS) OVER (PARTITION BY ix.symbol ORDER BY i ROWS UNBOUNDED PRECEDING), false) AS b FROM ix LEFT JOIN rp ON rp.symbol = ix.symbol AND rp.e = i)
    SELECT symbol, {TS}, sig, CASE WHEN b THEN 0 ELSE sig END::DOUBLE AS gated FROM g""")
def _(spark, d):
    x = pairs.band_position(_all(spark, d), "spread", 48, 24, 1.5, 0.3)
    return pairs.cointegration_gate(x, pairs.cointegration(x, 96, 24)).select("symbol", "ts", "sig", "gated")


@query("s11_10_pair_gates", STATE + f""", {PR}, {_position('spread', 'pr', 48, 1.5, 0.3)}, mv AS (SELECT *, abs(spread - lag(spread) OVER (PARTITION BY symbol ORDER BY ts)) AS am FROM po),
    vc AS (SELECT *, floor(sum(amount) OVER (PARTITION BY symbol ORDER BY ts, trade_id) / 1000) AS bar FROM ticks), vg AS (SELECT symbol, bar, max(ts) AS ts, sum(CASE side WHEN 'buy' THEN amount ELSE -amount END) AS net FROM vc GROUP BY 1, 2),
    vl AS (SELECT * FROM vg QUALIFY bar < max(bar) OVER (PARTITION BY symbol)), vp AS (SELECT symbol, bar, ts, CASE WHEN count(*) OVER w >= 10 THEN sum(abs(net)) OVER w / 20000 END AS vpin FROM vl WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS 19 PRECEDING)),
    vt AS (SELECT symbol, ts, arg_max(vpin, bar) AS vpin FROM vp GROUP BY 1, 2),
    jn AS (SELECT m.*, s.structure, s.vol, v.vpin FROM mv m LEFT JOIN st s ON s.symbol = m.leg AND s.ts = m.ts ASOF LEFT JOIN vt v ON v.symbol = m.leg AND m.ts >= v.ts),
    g1 AS (SELECT *, coalesce(lag(sig) OVER w, 0) <> 0 AS inside, CASE WHEN count(am) {_last(14)} >= 7 THEN avg(am) {_last(14)} END AS atr FROM jn WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    g2 AS (SELECT *, CASE WHEN coalesce(atr, -1) >= 0.9 OR inside THEN sig ELSE 0 END::DOUBLE AS even, CASE WHEN coalesce(vpin > 0.3, false) AND NOT inside THEN 0 ELSE sig END::DOUBLE AS calm,
    CASE WHEN sig <> 0 AND NOT inside THEN CASE WHEN vol = 'high' OR structure IN ('trend_up', 'trend_down') THEN 0.5 ELSE 1 END END AS sc FROM g1)
    SELECT symbol, {TS}, sig, even, calm, CAST(sig * coalesce(last_value(sc IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 1) AS DOUBLE) AS scaled FROM g2""")
def _(spark, d):
    x = pairs.band_position(_all(spark, d), "spread", 48, 24, 1.5, 0.3)
    x = x.withColumn("_m", F.abs(F.col("spread") - F.lag("spread").over(ft.series())))
    x = x.withColumn("_atr", F.when(F.count("_m").over(ft.last_n(14)) >= 7, F.avg("_m").over(ft.last_n(14))))
    market = state(spark, d).select(F.col("symbol").alias("leg"), "ts", "structure", "vol")
    flow = ft.vpin(resample.activity_bars(v.ticks(spark, d), 1000, drop_last=True), 1000.0, 20).select(F.col("symbol").alias("leg"), "ts", "bar", "vpin")
    x = joins.asof_join(x.join(market, ["leg", "ts"], "left"), flow, cols=["vpin"], prefix="", by=["leg"], tie="bar")
    x = pairs.block_entries(x, F.coalesce(F.col("_atr"), F.lit(-1.0)) < 0.9, name="even")
    x = pairs.block_entries(x, F.col("vpin") > 0.3, name="calm")
    rough = (F.col("vol") == "high") | F.col("structure").isin("trend_up", "trend_down")
    return pairs.entry_scale(x, F.when(rough, 0.5).otherwise(1.0)).select("symbol", "ts", "sig", "even", "calm", "scaled")


def _hedge_sql(x: str, tag: str) -> str:
    return f"""{_position(x, 'hx', 48, 1.5, 0.3, tag)}, pp{tag} AS (SELECT *, coalesce(lag(sig) OVER (PARTITION BY symbol ORDER BY ts), 0) AS pos, coalesce({x} - lag({x}) OVER (PARTITION BY symbol ORDER BY ts), 0) AS ch FROM po{tag}),
    sr{tag} AS (SELECT symbol, count(*) AS n, coalesce(avg(-pos * ch) / nullif(stddev_pop(-pos * ch), 0) * sqrt(count(*)), 0) AS s FROM pp{tag} WHERE oos GROUP BY 1)"""


def _johansen_sql() -> str:
    """CTEs that end in jb: symbol, jb (the ratio of the first vector)."""
    names = ("d1", "d2", "l1", "l2", "z1", "z2")
    c = lambda a, b: min(a, b) + max(a, b)
    left = lambda a, b: f"{c(a, b)} - ({c(a, 'z1')} * (z2z2 * {c(b, 'z1')} - z1z2 * {c(b, 'z2')}) + {c(a, 'z2')} * (z1z1 * {c(b, 'z2')} - z1z2 * {c(b, 'z1')})) / (z1z1 * z2z2 - z1z2 * z1z2)"
    q = lambda a, b: f"(s_d2d2 * s_d1{a} * s_d1{b} - s_d1d2 * (s_d1{a} * s_d2{b} + s_d2{a} * s_d1{b}) + s_d1d1 * s_d2{a} * s_d2{b}) / (s_d1d1 * s_d2d2 - s_d1d2 * s_d1d2)"
    return f"""j0 AS (SELECT symbol, ts, y, x FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM h0) WHERE i < floor(n * 0.7)),
    j1 AS (SELECT symbol, ts, lag(y) OVER w AS l1, lag(x) OVER w AS l2, y - lag(y) OVER w AS d1, x - lag(x) OVER w AS d2 FROM j0 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    j2 AS (SELECT *, lag(d1) OVER w AS z1, lag(d2) OVER w AS z2 FROM j1 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    j3 AS (SELECT symbol, count(*) AS n, {', '.join(f'covar_pop({a}, {b}) AS {a}{b}' for i, a in enumerate(names) for b in names[i:])} FROM j2 WHERE z1 IS NOT NULL GROUP BY 1),
    j4 AS (SELECT symbol, n, {', '.join(f'{left(a, b)} AS s_{a}{b}' for i, a in enumerate(names[:4]) for b in names[i:4])} FROM j3),
    j5 AS (SELECT *, {q('l1', 'l1')} AS q11, {q('l1', 'l2')} AS q12, {q('l2', 'l2')} AS q22, s_l1l1 * s_l2l2 - s_l1l2 * s_l1l2 AS dt FROM j4),
    j6 AS (SELECT symbol, n, (s_l2l2 * q11 - s_l1l2 * q12) / dt AS m11, (s_l2l2 * q12 - s_l1l2 * q22) / dt AS m12, (s_l1l1 * q12 - s_l1l2 * q11) / dt AS m21, (s_l1l1 * q22 - s_l1l2 * q12) / dt AS m22 FROM j5),
    jb AS (SELECT symbol, CASE WHEN n + 2 >= 40 THEN abs(((m22 - m11) / 2 + sqrt(((m11 - m22) / 2) ** 2 + m12 * m21)) / m12) END AS jb FROM j6)"""


@query("s12_25_hedges", f"""WITH {B}, {PR}, h0 AS (SELECT *, ln(c1) AS y, ln(c2) AS x FROM pr), {_johansen_sql()}, h1 AS (SELECT *, CASE WHEN count(*) {_last(48)} >= 48 THEN covar_pop(y, x) {_last(48)} / nullif(var_pop(x) {_last(48)}, 0) END AS beta,
    row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 >= floor(count(*) OVER (PARTITION BY symbol) * 0.7) AS oos FROM h0), hx AS (SELECT *, y - beta * x AS hedged, y - jb * x AS vector FROM h1 LEFT JOIN jb USING (symbol)), {_hedge_sql('spread', '1')}, {_hedge_sql('hedged', '2')}, {_hedge_sql('vector', '3')},
    ha AS (SELECT a.symbol, a.n, jb, a.s AS ratio, b.s AS ols, CASE WHEN jb IS NOT NULL THEN c.s END AS jo FROM sr1 a JOIN sr2 b USING (symbol) JOIN sr3 c USING (symbol) LEFT JOIN jb USING (symbol))
    SELECT symbol, n, round(jb, 4) AS beta, round(ratio, 4) AS ratio, round(ols, 4) AS ols, round(jo, 4) AS johansen, CASE WHEN ols > ratio + 1e-9 AND (jo IS NULL OR ols >= jo) THEN 'ols' WHEN jo > ratio + 1e-9 AND jo > ols THEN 'johansen' ELSE 'ratio' END AS prefer FROM ha""")
def _(spark, d):
    x = pairs.compare_hedges(_all(spark, d), 48, 0.7, 1.5, 0.3)
    return x.select("symbol", "n", *[F.round(c, 4).alias(c) for c in ("beta", "ratio", "ols", "johansen")], "prefer")


@query("s11_10_toxicity_gate", f"""WITH {B}, {PR}, {_position('spread', 'pr', 48, 1.5, 0.3)},
    vc AS (SELECT *, floor(sum(amount) OVER (PARTITION BY symbol ORDER BY ts, trade_id) / 1000) AS bar FROM ticks), vg AS (SELECT symbol, bar, max(ts) AS ts, sum(CASE side WHEN 'buy' THEN amount ELSE -amount END) AS net FROM vc GROUP BY 1, 2),
    vl AS (SELECT * FROM vg QUALIFY bar < max(bar) OVER (PARTITION BY symbol)), vp AS (SELECT symbol, bar, ts, CASE WHEN count(*) OVER w >= 10 THEN sum(abs(net)) OVER w / 20000 END AS vpin FROM vl WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS 19 PRECEDING)),
    vt AS (SELECT symbol, ts, arg_max(vpin, bar) AS vpin FROM vp GROUP BY 1, 2), hk AS (SELECT a.symbol, a.side, a.ts, a.trade_id, sum(exp(-0.001 * (epoch(a.ts) - epoch(b.ts)))) AS h FROM ticks a JOIN ticks b ON a.symbol = b.symbol AND a.side = b.side AND (b.ts, b.trade_id) <= (a.ts, a.trade_id) GROUP BY ALL),
    hl AS (SELECT symbol, side, ts, arg_max(h, trade_id) AS h FROM hk GROUP BY ALL), hb AS (SELECT * FROM hl WHERE side = 'buy'), hs AS (SELECT * FROM hl WHERE side = 'sell'),
    jn AS (SELECT m.*, v.vpin, coalesce((coalesce(b.h, 0) - coalesce(s.h, 0)) / nullif(coalesce(b.h, 0) + coalesce(s.h, 0), 0), 0) AS imbalance FROM po m ASOF LEFT JOIN vt v ON v.symbol = m.leg AND m.ts >= v.ts ASOF LEFT JOIN hb b ON b.symbol = m.leg AND m.ts >= b.ts ASOF LEFT JOIN hs s ON s.symbol = m.leg AND m.ts >= s.ts),
    g AS (SELECT *, coalesce(lag(sig) OVER (PARTITION BY symbol ORDER BY ts), 0) <> 0 AS inside, coalesce(vpin, 0) > 0.3 OR abs(imbalance) > 0.5 AS toxic FROM jn)
    SELECT symbol, {TS}, sig, round(imbalance, 5) AS imbalance, toxic, CASE WHEN toxic AND NOT inside THEN 0 ELSE sig END::DOUBLE AS gated FROM g""")
def _(spark, d):
    x = pairs.band_position(_all(spark, d), "spread", 48, 24, 1.5, 0.3)
    ticks = v.ticks(spark, d)
    flow = ft.vpin(resample.activity_bars(ticks, 1000, drop_last=True), 1000.0, 20).select(F.col("symbol").alias("leg"), "ts", "bar", "vpin")
    x = joins.asof_join(x, flow, cols=["vpin"], prefix="", by=["leg"], tie="bar")
    x = pairs.toxic_flow(ticks.withColumnRenamed("symbol", "leg"), x, 0.001, by="leg")
    x = x.withColumn("toxic", (F.coalesce("vpin", F.lit(0.0)) > 0.3) | (F.abs("imbalance") > 0.5))
    return pairs.block_entries(x, F.col("toxic")).select("symbol", "ts", "sig", F.round("imbalance", 5).alias("imbalance"), "toxic", "gated")


WF = """wi AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM {0}), wk AS (SELECT symbol, CAST(unnest(range(0, CAST(floor((n - 360) / 120) AS BIGINT) + 1)) AS BIGINT) AS win FROM (SELECT DISTINCT symbol, n FROM wi WHERE n >= 360)),
    wr AS (SELECT wi.symbol, win, ret, CASE WHEN i < win * 120 + 240 THEN 'train' ELSE 'test' END AS role FROM wi JOIN wk ON wk.symbol = wi.symbol AND i >= win * 120 AND i < win * 120 + 360)
    SELECT symbol, win AS \"window\", role, count(*) AS n, round(avg(ret), 6) AS mean, round(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(count(*)), 4) AS sharpe FROM wr GROUP BY 1, 2, 3"""


def _walk(x):
    x = accounting.walk_forward(x, 240, 120)
    return x.select("symbol", F.col("window").cast("bigint").alias("window"), "role", "n", "mean", F.round("sharpe", 4).alias("sharpe"))


@query("s13_13_pairs_walk_forward", f"""WITH {B}, {PR}, {_position('spread', 'pr', 48, 1.5, 0.3)}, ps AS (SELECT *, coalesce(lag(sig) OVER (PARTITION BY symbol ORDER BY ts), 0) AS pos, coalesce(spread - lag(spread) OVER (PARTITION BY symbol ORDER BY ts), 0) AS ch FROM po),
    rt AS (SELECT symbol, ts, -pos * ch - abs(pos - coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY ts), 0)) * 0.0008 AS ret FROM ps), {WF.format('rt')}""")
def _(spark, d):
    return _walk(pairs.spread_returns(pairs.band_position(_all(spark, d), "spread", 48, 24, 1.5, 0.3), 0.0004))


@query("s13_13_neutral_walk_forward", f"""WITH {B}, {PR}, ba AS (SELECT *, c1 / c2 - 1 AS basis FROM pr), {_position('basis', 'ba', 48, 1.5, 0.3)}, ps AS (SELECT *, coalesce(lag(sig) OVER (PARTITION BY symbol ORDER BY ts), 0) AS pos, coalesce(basis - lag(basis) OVER (PARTITION BY symbol ORDER BY ts), 0) AS ch FROM po),
    rt AS (SELECT symbol, ts, -pos * ch - abs(pos - coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY ts), 0)) * 0.0008 AS ret FROM ps), {WF.format('rt')}""")
def _(spark, d):
    x = pairs.band_position(_all(spark, d).withColumn("basis", F.col("c1") / F.col("c2") - 1), "basis", 48, 24, 1.5, 0.3)
    x = x.withColumn("pos", F.coalesce(F.lag("sig").over(ft.series()), F.lit(0.0))).withColumn("rate", F.lit(0.0))
    return _walk(accounting.delta_neutral(x, 0.0004))
