"""Stand-in tables of market data, derived from the input tables.

ticks, bars, funding, book and fills come from events and lineitem, closed trades and orders from lineitem and orders. The
SQL texts below define the same views for an SQL engine that has the input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.resample import resample
from lodestream.session import settle, table, tune


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, trade_id, price, amount, side; prices are positive."""
    e = table(tune(spark), sf_dir, "events").where("value > 0")
    return e.select(
        F.concat(F.lit("S"), F.col("user_id") % 8).alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("trade_id"),
        F.col("value").alias("price"),
        (F.lit(1) + F.regexp_extract("props", "[0-9]+", 0).cast("int")).cast("double").alias("amount"),
        F.when(F.col("event_type").isin("click", "purchase"), "buy").otherwise("sell").alias("side"),
    )


def bars(spark: SparkSession, sf_dir: str, every: str = "1 hour") -> DataFrame:
    """symbol, ts (bar start), open, high, low, close, volume."""
    return resample(ticks(spark, sf_dir), every, price="price", volume="amount", tie="trade_id")


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, seq, rate."""
    e = table(tune(spark), sf_dir, "events").where("event_type = 'signup'")
    return e.select(F.concat(F.lit("S"), F.col("user_id") % 8).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.round((F.col("value") - 35) * 1e-6, 9).alias("rate"))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, seq, bid, ask, bid_qty, ask_qty."""
    return ticks(spark, sf_dir).select("symbol", "ts", F.col("trade_id").alias("seq"), F.col("price").alias("bid"), (F.col("price") * (1 + F.col("amount") / 1e5)).alias("ask"), F.col("amount").alias("bid_qty"), (101 - F.col("amount")).alias("ask_qty"))


def closed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with entry and exit times, side and return."""
    li, o = table(tune(spark), sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey).where("l_shipdate > o_orderdate")
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        F.concat(F.lit("S"), F.col("l_suppkey") % 8).alias("symbol"),
        F.col("o_orderdate").cast("timestamp").alias("entry_ts"), F.col("l_shipdate").cast("timestamp").alias("exit_ts"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("side"), F.round(F.col("l_discount") - F.col("l_tax"), 2).alias("ret"),
        F.col("l_linestatus").alias("exit_reason"),
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, ts, status, priority, price."""
    o = table(tune(spark), sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "filled").when(F.col("o_orderstatus") == "O", "unfilled").otherwise("cancelled")
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("account"), F.col("o_orderdate").cast("timestamp").alias("ts"), status.alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, side, qty, price and the columns that break ties."""
    li = table(tune(spark), sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("S"), F.col("l_suppkey") % 8).alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"),
        F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )


TICKS = """ticks AS (SELECT 'S' || CAST(user_id % 8 AS VARCHAR) AS symbol, CAST(ts AS TIMESTAMP) AS ts, event_id AS trade_id, value AS price,
    CAST(1 + CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS DOUBLE) AS amount,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'buy' ELSE 'sell' END AS side FROM events WHERE value > 0)"""
BARS = TICKS + """, bars AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, ts) AS close, sum(amount) AS volume FROM ticks GROUP BY 1, 2)"""
FUNDING = """funding AS (SELECT 'S' || CAST(user_id % 8 AS VARCHAR) AS symbol, CAST(ts AS TIMESTAMP) AS ts, event_id AS seq, round((value - 35) * 1e-6, 9) AS rate
    FROM events WHERE event_type = 'signup')"""
BOOK = TICKS + ", book AS (SELECT symbol, ts, trade_id AS seq, price AS bid, price * (1 + amount / 1e5) AS ask, amount AS bid_qty, 101 - amount AS ask_qty FROM ticks)"
CLOSED = """closed AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, 'S' || CAST(l_suppkey % 8 AS VARCHAR) AS symbol,
    CAST(o_orderdate AS TIMESTAMP) AS entry_ts, CAST(l_shipdate AS TIMESTAMP) AS exit_ts, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS side,
    round(l_discount - l_tax, 2) AS ret, l_linestatus AS exit_reason FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate)"""
ORDER_LOG = """order_log AS (SELECT o_orderkey AS order_id, o_custkey AS account, CAST(o_orderdate AS TIMESTAMP) AS ts,
    CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'unfilled' ELSE 'cancelled' END AS status, o_orderpriority AS priority, o_totalprice AS price FROM orders)"""
FILLS = """fills AS (SELECT 'S' || CAST(l_suppkey % 8 AS VARCHAR) AS symbol, CAST(l_shipdate AS TIMESTAMP) AS ts, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side,
    l_quantity AS qty, l_extendedprice / l_quantity AS price, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)"""


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a sweep: (strategy, symbol, interval, mode, days) with metrics of the trades that closed in it; text column s_sharpe.

    The cells are settled, so a query that reads them twice joins the trades once.
    """
    li, o = table(tune(spark), sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey).where("l_shipdate > o_orderdate")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    t = j.select(
        pick(F.col("l_linenumber") % 3, "zscore", "pairs_arb", "carry").alias("strategy"), F.concat(F.lit("s"), F.col("l_suppkey") % 8, F.lit("usdt")).alias("symbol"),
        pick(F.col("l_partkey") % 3, "5m", "1h", "4h").alias("interval"), F.when(F.col("l_returnflag") == "R", "walkforward").otherwise("backtest").alias("mode"), (F.lit(20) + F.col("l_suppkey") % 3 * 20).cast("int").alias("days"),
        F.round(F.col("l_discount") - F.col("l_tax"), 2).alias("ret"), (F.col("l_orderkey") % 3 == 0).alias("oos"), "l_quantity",
    )
    ratio = F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0))
    oos = F.when(F.col("oos"), F.col("ret"))
    m = t.groupBy("strategy", "symbol", "interval", "mode", "days").agg(
        F.count(F.lit(1)).alias("n_trades"), F.count(oos).alias("n_trades_oos"), F.round(ratio * 10, 6).alias("sharpe"), F.round(F.avg(oos) / F.nullif(F.stddev_samp(oos), F.lit(0.0)) * 10, 6).alias("avg_oos_sharpe"),
        F.round(F.avg((oos > 0).cast("double")), 6).alias("oos_positive_frac"), F.round(F.sum("ret"), 6).alias("total_return"),
        F.round(F.sum(F.greatest("ret", F.lit(0.0))) / F.nullif(-F.sum(F.least("ret", F.lit(0.0))), F.lit(0.0)), 6).alias("profit_factor"), F.round(F.avg("l_quantity"), 6).alias("q"),
    )
    return settle(m.withColumn("status", F.when(F.col("n_trades") % 17 == 0, "error").otherwise("ok")).withColumn("s_sharpe", F.when(F.col("n_trades") % 5 == 0, "n/a").otherwise(F.col("sharpe").cast("string"))), "sweep")


SWEEP = """sweep AS (SELECT *, CASE WHEN n_trades % 17 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN n_trades % 5 = 0 THEN 'n/a' ELSE CAST(sharpe AS VARCHAR) END AS s_sharpe FROM (
    SELECT ['zscore', 'pairs_arb', 'carry'][l_linenumber % 3 + 1] AS strategy, 's' || (l_suppkey % 8) || 'usdt' AS symbol, ['5m', '1h', '4h'][l_partkey % 3 + 1] AS interval, CASE WHEN l_returnflag = 'R' THEN 'walkforward' ELSE 'backtest' END AS mode, CAST(20 + l_suppkey % 3 * 20 AS INTEGER) AS days,
    count(*) AS n_trades, count(oos) AS n_trades_oos, round(avg(ret) / nullif(stddev_samp(ret), 0) * 10, 6) AS sharpe, round(avg(oos) / nullif(stddev_samp(oos), 0) * 10, 6) AS avg_oos_sharpe, round(avg(CASE WHEN oos > 0 THEN 1.0 WHEN oos IS NOT NULL THEN 0 END), 6) AS oos_positive_frac,
    round(sum(ret), 6) AS total_return, round(sum(greatest(ret, 0)) / nullif(-sum(least(ret, 0)), 0), 6) AS profit_factor, round(avg(l_quantity), 6) AS q
    FROM (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN ret END AS oos FROM (SELECT *, round(l_discount - l_tax, 2) AS ret FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate)) GROUP BY 1, 2, 3, 4, 5))"""
