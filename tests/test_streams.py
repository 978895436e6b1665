from pyspark.sql import functions as F

from lodestream.operators import evaluation, signals
from lodestream.streaming import streams


def raw(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_quotes_and_liquidations(spark):
    rows = raw(
        spark, '{"s": "A", "b": "1.5", "B": "10", "a": "1.6", "A": "20", "E": 1704067200000}', '{"s": "B", "b": "2", "B": "3", "a": "4", "A": "5", "T": 1704067201000}',
        '{"s": "C", "b": "2", "B": "3", "a": "4", "A": "5"}', "junk", '{"s": "D"}',
    )
    got = {r.symbol: r for r in streams.quotes(rows).withColumn("t", F.unix_seconds("ts")).collect()}
    assert set(got) == {"A", "B", "C"} and (got["A"].bid, got["A"].bid_qty, got["A"].ask, got["A"].ask_qty, got["A"].t) == (1.5, 10.0, 1.6, 20.0, 1704067200)
    assert got["B"].t == 1704067201 and got["C"].ts is not None
    rows = raw(spark, '{"E": 1, "o": {"s": "A", "S": "SELL", "p": "5", "q": "2", "T": 1704067200000}}', '{"E": 1}')
    (r,) = streams.liquidations(rows).collect()
    assert (r.symbol, r.side, r.price, r.qty) == ("A", "sell", 5.0, 2.0)


def test_order_events(spark):
    good, bad = streams.order_events(raw(spark, '{"e": "ORDER_TRADE_UPDATE", "E": 1, "o": {"s": "A", "i": 7, "X": "FILLED", "q": "2", "z": "1.5"}}', '{"e": "other"}', "junk"))
    (r,) = good.collect()
    assert (r.symbol, r.order_id, r.status, r.qty, r.filled) == ("A", 7, "filled", 2.0, 1.5) and bad.count() == 2


def test_stream_equals_batch(spark, sf):
    got = streams.run_to_table(streams.deduplicated(streams.ticks(spark, sf), "1 hour"), "t")
    from lodestream import views

    assert sorted((r.symbol, r.trade_id) for r in got.collect()) == sorted((r.symbol, r.trade_id) for r in views.ticks(spark, sf).collect())


def test_registry(spark):
    assert {"mean_reversion", "momentum", "cross_momentum", "volume_delta"} <= {r.strategy for r in signals.listing(spark).collect()}
    df = spark.createDataFrame([("A", 1)], "symbol string, ts int")
    try:
        signals.signals("volume_delta", df)
    except ValueError as e:
        assert "delta" in str(e)
    else:
        raise AssertionError


def test_exposure(spark):
    df = spark.createDataFrame([(1, "A", 50.0), (1, "B", -50.0), (2, "A", 300.0)], "ts int, symbol string, notional double")
    got = {r.ts: r for r in evaluation.exposure(df, 100.0, 2.0, 0.8).collect()}
    assert not got[1].broken and got[1].leverage == 1.0 and got[2].broken
