"""Queries that write the given tables in the library's layouts and read them back, parse messages, and run streams with state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestream import views as v
from lodestream.operators import quality, states
from lodestream.plans.market import BK, TS, B, C, FL, FU, O, T, _r
from lodestream.plans.models import DEPTH, _depth
from lodestream.plans.registry import query
from lodestream.plans.research import IMB, _cuts_sql
from lodestream.plans.tables import KEY, KEYS, LEAST, S
from lodestream.session import shared_dir, tune
from lodestream.sources import tables as src
from lodestream.streaming import streams


def _root(spark, name: str) -> str:
    return f"{shared_dir(tune(spark))}/{name}-{uuid.uuid4().hex}"


def _klines(spark, d):
    return v.bars(spark, d).withColumn("interval", F.lit("1h"))


@query("s1_2_read_klines", f"WITH {B} SELECT symbol, '1h' AS interval, {TS}, {_r('open', 'high', 'low', 'close', 'volume')} FROM bars WHERE symbol IN ('S1', 'S4')")
def _(spark, d):
    root = _root(spark, "klines")
    src.write_partitioned(_klines(spark, d), root, ["symbol", "interval"])
    return src.read_klines(spark, root, ["S1", "S4"], "1h")


@query("s1_3_read_trades", f"WITH {T}, x AS (SELECT *, CASE WHEN trade_id % 9 = 0 THEN NULL ELSE trade_id END AS id FROM ticks) SELECT symbol, {TS}, coalesce(id, -row_number() OVER (PARTITION BY symbol, id IS NULL ORDER BY ts, price, amount, side)) AS trade_id, round(price, 6) AS price, amount, side FROM x")
def _(spark, d):
    root = _root(spark, "trades")
    src.write_partitioned(v.ticks(spark, d).withColumn("trade_id", F.when(F.col("trade_id") % 9 != 0, F.col("trade_id"))), root, ["symbol"])
    return src.read_trades(spark, root)


@query("s1_4_read_funding", f"WITH {FU} SELECT symbol, {TS}, seq, round(rate * 1e6, 3) AS rate FROM funding WHERE symbol = 'S3'")
def _(spark, d):
    root = _root(spark, "funding")
    src.save_funding(v.funding(spark, d), root, 1.0)
    return src.read_series(spark, root, src.FUNDING, "S3").withColumn("rate", F.round(F.col("rate") * 1e6, 3))


@query("s1_5_read_book", f"WITH {BK} SELECT symbol, {TS}, seq, {_r('bid', 'bid_qty', 'ask_qty')}, round(ask + 1e-9, 6) AS ask FROM book WHERE symbol = 'S2'")
def _(spark, d):
    root = _root(spark, "book")
    src.write_partitioned(v.book(spark, d), root, ["symbol"])
    return src.read_series(spark, root, src.BOOK, "S2").withColumn("ask", F.col("ask") + 1e-9)


@query("s1_6_file_audit", f"WITH {T} SELECT symbol, count(*) AS \"rows\" FROM ticks GROUP BY 1")
def _(spark, d):
    root = _root(spark, "files")
    src.write_partitioned(v.ticks(spark, d), root, ["symbol"])
    files = src.file_audit(spark, root, "part-*.parquet")
    return files.groupBy(F.regexp_extract("file", "symbol=([^/]+)", 1).alias("symbol")).agg(F.sum("rows").alias("rows"))


def _dumps(root, rows, header, read):
    """A dump a symbol, written in one job, and all of them read again."""
    writer = rows.write.partitionBy("symbol")
    (writer.option("header", "true") if header else writer).csv(root)
    spark = rows.sparkSession
    out = None
    for name in sorted(r.symbol for r in rows.select("symbol").distinct().collect()):
        x = read(spark, f"{root}/symbol={name}", name)
        out = x if out is None else out.unionByName(x)
    return out


@query("s1_7_trade_dump", f"WITH {T} SELECT symbol, {TS}, trade_id, round(price, 6) AS price, amount, side FROM ticks")
def _(spark, d):
    maker = F.when(F.col("side") == "sell", "True").otherwise("false")
    t = v.ticks(spark, d).select("trade_id", "price", "amount", F.col("trade_id").alias("f"), F.col("trade_id").alias("l"), F.unix_millis("ts").alias("transact_time"), maker.alias("is_buyer_maker"), "symbol")
    return _dumps(_root(spark, "dump"), t, True, src.read_trade_dump)


@query("s1_8_liquidation_dump", f"WITH {T} SELECT symbol, {TS}, side, round(price, 6) AS price, amount AS qty FROM ticks WHERE amount > 90")
def _(spark, d):
    t = v.ticks(spark, d).where("amount > 90").select(F.unix_millis("ts").alias("time"), F.upper("side").alias("side"), "price", F.col("amount").alias("qty"), "symbol")
    return _dumps(_root(spark, "liquidations"), t, False, src.read_liquidation_dump)


@query("s1_9_save_klines", f"WITH {B} SELECT symbol, '1h' AS interval, count(*) AS n, round(sum(volume), 6) AS volume FROM bars GROUP BY 1")
def _(spark, d):
    root = _root(spark, "saved")
    src.save_klines(_klines(spark, d), root)
    return src.read_klines(spark, root).groupBy("symbol", "interval").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query("s1_10_save_trades", f"WITH {T} SELECT symbol, count(*) AS n, round(sum(price * amount), 4) AS value FROM ticks GROUP BY 1")
def _(spark, d):
    root = _root(spark, "saved")
    src.save_trades(v.ticks(spark, d), root)
    return src.read_trades(spark, root).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("price") * F.col("amount")), 4).alias("value"))


@query("s1_12_append_days", f"WITH {T}, u AS (SELECT symbol, date_trunc('hour', ts) AS ts, price, trade_id AS arrival FROM ticks), k AS (SELECT symbol, ts, arg_max(price, arrival) AS price FROM u GROUP BY 1, 2) SELECT symbol, {TS}, round(price, 6) AS price FROM k")
def _(spark, d):
    root = _root(spark, "days")
    t = v.ticks(spark, d).select("symbol", F.date_trunc("hour", "ts").alias("ts"), "price", F.col("trade_id").alias("arrival"))
    src.append_days(t.where("arrival % 2 = 0"), root)
    src.append_days(t.where("arrival % 2 = 1"), root)
    return spark.read.parquet(root).select("symbol", "ts", "price")


@query("s1_15_replace_series", f"WITH {B} SELECT symbol, count(*) AS n, round(sum(CASE WHEN symbol = 'S0' THEN 2 * volume ELSE volume END), 6) AS volume FROM bars GROUP BY 1")
def _(spark, d):
    root = _root(spark, "replaced")
    src.write_partitioned(_klines(spark, d), root, ["symbol", "interval"])
    src.write_partitioned(_klines(spark, d).where("symbol = 'S0'").withColumn("volume", F.col("volume") * 2), root, ["symbol", "interval"])
    return src.read_klines(spark, root).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query("s1_17_list_series", f"WITH {B} SELECT DISTINCT symbol, '1h' AS interval FROM bars")
def _(spark, d):
    return src.list_series(_klines(spark, d))


@query("s1_20_inventory_kpis", f"WITH {T}, s AS (SELECT symbol, date_diff('hour', max(date_trunc('hour', ts)), TIMESTAMP '2024-02-01 06:00:00') AS age FROM ticks GROUP BY 1) SELECT count(*) AS series, count(*) FILTER (WHERE age <= 24) AS fresh, count(*) FILTER (WHERE age > 24 AND age <= 72) AS aging, count(*) FILTER (WHERE age > 72) AS stale FROM s")
def _(spark, d):
    return src.inventory_kpis(src.inventory(v.ticks(spark, d).withColumn("ts", F.date_trunc("hour", "ts")), "2024-02-01 06:00:00"))


@query("s1_21_load_symbol", f"WITH {B}, {FU} SELECT 'bars' AS kind, count(*) AS n FROM bars WHERE symbol = 'S7' UNION ALL SELECT 'funding', count(*) FROM funding WHERE symbol = 'S7' UNION ALL SELECT 'ticks', count(*) FROM ticks WHERE symbol = 'S7'")
def _(spark, d):
    frames = src.load_symbol({"bars": v.bars(spark, d), "funding": v.funding(spark, d), "ticks": v.ticks(spark, d)}, "S7")
    return src.concatenated(*[df.select(F.lit(k).alias("kind")) for k, df in frames.items()]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("s1_22_ensure_bars", f"""WITH {B}, w AS (SELECT symbol, time_bucket(INTERVAL 4 hour, ts) AS ts, arg_max(close, ts) AS close, max(high) AS high, sum(volume) AS volume FROM bars GROUP BY symbol, time_bucket(INTERVAL 4 hour, ts)), m AS (SELECT symbol, max(ts) + INTERVAL 1 hour AS z FROM bars GROUP BY 1),
    f AS (SELECT w.* FROM w JOIN m USING (symbol) WHERE ts + INTERVAL 4 hour <= z) SELECT symbol, {TS}, {_r('close', 'high', 'volume')} FROM f WHERE ts > (SELECT max(g.ts) FROM f g WHERE g.symbol = f.symbol) - INTERVAL 10 day""")
def _(spark, d):
    return src.ensure_bars(v.bars(spark, d), "1h", "4h", 10).select("symbol", "ts", "close", "high", "volume")


@query("s1_24_add_columns", f"WITH {S} SELECT {KEY}, 0.5::DOUBLE AS cost, 'none' AS note FROM sweep")
def _(spark, d):
    return src.add_columns(v.sweep(spark, d), {"cost": 0.5, "note": "none", "sharpe": 0.0}).select(*KEYS, "cost", "note")


SWEEP_DDL = "strategy string, symbol string, interval string, mode string, days int, n_trades bigint, sharpe double"


@query("s1_25_report", f"WITH {S} SELECT {KEY}, n_trades, sharpe FROM sweep")
def _(spark, d):
    from pyspark.sql.types import _parse_datatype_string

    path = _root(spark, "report")
    src.save_report(v.sweep(spark, d).select(*KEYS, "n_trades", "sharpe"), path, ["strategy", "symbol"])
    return src.read_report(spark, path, _parse_datatype_string(SWEEP_DDL))


@query("s1_26_journal", f"WITH {O} SELECT order_id, status, round(price, 6) AS price FROM order_log WHERE order_id % 3 > 0")
def _(spark, d):
    from pyspark.sql.types import _parse_datatype_string

    path = _root(spark, "journal")
    o = v.order_log(spark, d).select("order_id", "status", "price")
    src.append_journal(o.where("order_id % 3 = 1"), path)
    src.append_journal(o.where("order_id % 3 = 2"), path)
    o.where("order_id % 3 = 0").select(F.concat(F.lit('{"order_id": "x'), "order_id").alias("value")).write.mode("append").text(path)  # lines cut short
    return src.read_journal(spark, path, _parse_datatype_string("order_id bigint, status string, price double"))


@query("s1_27_trials", f"WITH {S} SELECT count(*) AS entries, CAST(sum(n_trades) AS BIGINT) AS trials FROM sweep WHERE strategy = 'carry' AND mode = 'backtest'")
def _(spark, d):
    path = _root(spark, "trials")
    x = v.sweep(spark, d).select("strategy", "symbol", F.col("mode").alias("purpose"), F.col("n_trades").alias("n_trials"), F.col("sharpe").alias("score"), F.current_timestamp().alias("ts"))
    src.append_journal(x, path)
    return src.count_trials(src.read_journal(spark, path, src.TRIALS), strategy="carry", purpose="backtest")


@query("s1_28_audits", f"WITH {S} SELECT strategy, count(*) AS n, round(sum(sharpe), 4) AS sharpe, count(*) FILTER (WHERE mode = 'walkforward') AS noted FROM sweep GROUP BY 1")
def _(spark, d):
    root = _root(spark, "audits")
    x = v.sweep(spark, d)
    x.where("mode = 'backtest'").select("strategy", "symbol", "sharpe").write.json(f"{root}/a/b")
    x.where("mode = 'walkforward'").select("strategy", "sharpe", F.lit("w").alias("note")).write.option("header", "true").csv(f"{root}/c")
    got = src.read_audits(spark, root)
    return got.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("sharpe").cast("double")), 4).alias("sharpe"), F.count("note").alias("noted"))


@query("s1_29_catalog", f"WITH {S} SELECT DISTINCT strategy, interval FROM sweep")
def _(spark, d):
    path = _root(spark, "catalog")
    x = v.sweep(spark, d).select("strategy", "interval").distinct()
    lines = x.select(F.concat(F.lit("| "), "strategy", F.lit(" | "), "interval", F.lit(" |")).alias("value")).unionByName(x.limit(1).select(F.lit("|---|---|").alias("value")))
    lines.write.text(path)
    return src.read_catalog(spark, path).select(F.col("cells")[0].alias("strategy"), F.col("cells")[1].alias("interval"))


@query("s1_30_equity_csv", f"WITH {O}, e AS (SELECT date_trunc('day', ts) AS ts, max(price) AS equity FROM order_log GROUP BY 1) SELECT {TS}, round(equity, 6) AS equity FROM e")
def _(spark, d):
    path = _root(spark, "equity")
    v.order_log(spark, d).groupBy(F.date_trunc("day", "ts").alias("ts")).agg(F.max("price").alias("equity")).write.option("header", "true").csv(path)
    return src.read_report(spark, path, src.EQUITY)


@query("s1_32_artefacts", f"WITH {O} SELECT status, count(*) AS n, round(sum(price), 2) AS value FROM order_log WHERE status <> 'cancelled' GROUP BY 1")
def _(spark, d):
    root = _root(spark, "runs")
    o = v.order_log(spark, d).select("order_id", "status", "price")
    src.save_artefacts(root, "first", orders=o)
    src.save_artefacts(root, "second", orders=o.limit(3))
    src.save_artefacts(root, "first", orders=o.where("status <> 'cancelled'"))
    return src.load_artefact(spark, root, "orders", "first").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("value"))


@query("s10_1_quote_messages", f"WITH {BK} SELECT symbol, {TS}, {_r('bid', 'bid_qty', 'ask_qty')}, round(ask + 1e-9, 6) AS ask FROM book")
def _(spark, d):
    b = v.book(spark, d)
    raw = b.select(F.to_json(F.struct(F.lit("bookTicker").alias("e"), F.unix_millis("ts").alias("E"), F.col("symbol").alias("s"), F.col("bid").alias("b"), F.col("bid_qty").alias("B"), F.col("ask").alias("a"), F.col("ask_qty").alias("A"))).alias("value"))
    return streams.quotes(raw.unionByName(raw.limit(5).select(F.lit("{broken").alias("value")))).withColumn("ask", F.col("ask") + 1e-9)


@query("s10_3_liquidation_messages", f"WITH {T} SELECT symbol, {TS}, side, round(price, 6) AS price, amount AS qty FROM ticks WHERE amount > 80")
def _(spark, d):
    t = v.ticks(spark, d).where("amount > 80")
    order = F.struct(F.col("symbol").alias("s"), F.upper("side").alias("S"), F.col("price").alias("p"), F.col("amount").alias("q"), F.unix_millis("ts").alias("T"))
    return streams.liquidations(t.select(F.to_json(F.struct(F.lit("forceOrder").alias("e"), order.alias("o"))).alias("value")))


@query("s10_19_order_messages", f"WITH {O} SELECT {TS}, 'S' || (account % 8) AS symbol, order_id, status, round(price, 6) AS qty, 0.0::DOUBLE AS filled FROM order_log WHERE order_id % 4 > 0")
def _(spark, d):
    o = v.order_log(spark, d)
    kind = F.when(F.col("order_id") % 4 > 0, "ORDER_TRADE_UPDATE").otherwise("ACCOUNT_UPDATE")
    body = F.struct(F.concat(F.lit("S"), F.col("account") % 8).alias("s"), F.col("order_id").alias("i"), F.upper("status").alias("X"), F.col("price").alias("q"), F.lit(0.0).alias("z"))
    return streams.order_events(o.select(F.to_json(F.struct(kind.alias("e"), F.unix_millis("ts").alias("E"), body.alias("o"))).alias("value")))[0]


@query("s10_10_stream_bars_adaptive", _cuts_sql("CAST(1 AS DOUBLE)", IMB[0], IMB[1].format(0), 100))
def _(spark, d):
    tune(spark)
    start, step = states.imbalance_machine(length=100)
    return streams.keyed_states(streams.ticks(spark, d), "symbol", ("ts", "trade_id"), ["price", "amount"], start, step, [("bar", "int"), ("ticks", "int")], "adaptive")


@query("s10_12_stream_hedge", f"""WITH {T}, a AS (SELECT symbol, ts, trade_id, coalesce(sign(price - lag(price) OVER w), 0) AS s FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, trade_id)),
    b AS (SELECT *, coalesce(last_value(nullif(s, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM a),
    c AS (SELECT *, coalesce(sum(CASE WHEN s * p < 0 THEN 1 WHEN s * p > 0 THEN -1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM b)
    SELECT symbol, {TS}, round(1 / (1 + exp(0.01 * g)), 6) AS weight FROM c""")
def _(spark, d):
    tune(spark)
    return streams.keyed_states(streams.ticks(spark, d), "symbol", ("ts", "trade_id"), ["price"], states.HedgeState, states.hedge_step(0.01), [("weight", "double")], "hedge")


@query("s10_13_stream_kalman", f"""WITH RECURSIVE {T}, n AS (SELECT symbol, ts, price AS z, row_number() OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS i FROM ticks),
    r AS (SELECT symbol, ts, i, z * (1 + 1e-3::DOUBLE) / (1 + 1e-3::DOUBLE + 1e-1::DOUBLE) AS x, (1 - (1 + 1e-3::DOUBLE) / (1 + 1e-3::DOUBLE + 1e-1::DOUBLE)) * (1 + 1e-3::DOUBLE) AS p FROM n WHERE i = 1
    UNION ALL SELECT n.symbol, n.ts, n.i, r.x + (r.p + 1e-3::DOUBLE) / (r.p + 1e-3::DOUBLE + 1e-1::DOUBLE) * (n.z - r.x), (1 - (r.p + 1e-3::DOUBLE) / (r.p + 1e-3::DOUBLE + 1e-1::DOUBLE)) * (r.p + 1e-3::DOUBLE) FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1) SELECT symbol, {TS}, round(x, 6) AS level FROM r""")
def _(spark, d):
    tune(spark)
    return streams.keyed_states(streams.ticks(spark, d), "symbol", ("ts", "trade_id"), ["price"], states.KalmanState, states.level_step(1e-3, 1e-1), [("level", "double")], "kalman")


@query("s14_4_critical", f"""WITH {B}, x AS (SELECT symbol, ts, CASE WHEN symbol = 'S3' AND hour(ts) = 5 THEN low * 2 ELSE high END AS high, low, open, close FROM bars), g AS (SELECT symbol, count(*) FILTER (WHERE high < greatest(open, close, low) OR low > least(open, close, high) OR low <= 0) AS bad_ohlc FROM x GROUP BY 1) SELECT symbol, bad_ohlc, bad_ohlc > 0 AS critical FROM g""")
def _(spark, d):
    b = v.bars(spark, d).withColumn("high", F.when((F.col("symbol") == "S3") & (F.hour("ts") == 5), F.col("low") * 2).otherwise(F.col("high")))
    return quality.bar_report(b).select("symbol", "bad_ohlc", quality.is_critical().alias("critical"))


@query("s14_8_depth_report", f"""{DEPTH} SELECT symbol, count(*) AS "rows", count(*) FILTER (WHERE bid > ask) AS crossed, count(*) FILTER (WHERE aq[1] - 50 < 0 OR aq[2] - 50 < 0 OR aq[3] - 50 < 0 OR aq[4] - 50 < 0 OR aq[5] - 50 < 0) AS negative, count(*) FILTER (WHERE bid_qty % 10 = 0) AS disorder FROM dp GROUP BY 1""")
def _(spark, d):
    x = _depth(spark, d)
    odd = F.when(F.col("bid_qty") % 10 == 0, 2.0).otherwise(1.0)
    wide = {}
    for k in range(5):
        wide |= {f"bid{k + 1}": F.col("bid") - 0.01 * k * (odd if k < 4 else 1.0) if k < 4 else F.when(odd > 1, F.col("bid") + 1).otherwise(F.col("bid") - 0.04), f"ask{k + 1}": F.col("ask") + 0.01 * k, f"bid{k + 1}_qty": F.col("bq")[k], f"ask{k + 1}_qty": F.col("aq")[k] - 50}
    return quality.depth_report(x.select("symbol", *[c.alias(n) for n, c in wide.items()]))
