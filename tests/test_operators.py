import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestream import views
from lodestream.functions import numbers as n
from lodestream.operators import accounting, features, joins, labels, quality, resample, scan, signals, states, trades
from lodestream.sources import tables

T0 = datetime(2024, 1, 1)


def bars(spark, closes, symbol="A", step=3600):
    rows = [(symbol, T0 + timedelta(seconds=step * i), c, c * 1.01, c * 0.99, c, 10.0 + i % 3) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def walk(count, seed=1):
    rng, out = random.Random(seed), [100.0]
    while len(out) < count:
        out.append(out[-1] * math.exp(rng.gauss(0, 0.01)))
    return out


def column(df, c):
    return [r[c] for r in df.orderBy("ts").collect()]


def test_asof_by_hand(spark):
    ms = lambda k: T0 + timedelta(milliseconds=k)
    base = spark.createDataFrame([("A", ms(100), 1.0), ("A", ms(200), 2.0), ("A", ms(300), 3.0), ("A", ms(400), 4.0), ("B", ms(300), 5.0)], "symbol string, ts timestamp, price double")
    events = spark.createDataFrame([("A", ms(150), 0.0001, 1), ("A", ms(250), 0.0004, 2), ("A", ms(250), 0.0005, 3), ("A", ms(500), 9.0, 4)], "symbol string, ts timestamp, rate double, seq bigint")
    got = joins.asof_join(base, events, cols=["rate"], tie="seq").orderBy("symbol", "ts").collect()
    assert [r.event_rate for r in got] == [None, 0.0001, 0.0005, 0.0005, None]


@pytest.mark.parametrize("span", [2, 9, 50])
def test_ema_against_loop(spark, span):
    x = walk(400)
    alpha, y, want = 2 / (span + 1), None, []
    for v in x:
        y = v if y is None else (1 - alpha) * y + alpha * v
        want.append(y)
    got = column(scan.ema(bars(spark, x), "close", span, name="y"), "y")
    assert max(abs(a - b) / b for a, b in zip(got, want, strict=True)) < 1e-12


def test_no_lookahead(spark):
    x = walk(200)
    full, cut = bars(spark, x), bars(spark, x[:120])
    for f in (lambda b: features.feature_table(b), lambda b: signals.mean_reversion(b), lambda b: signals.momentum(b), lambda b: features.volatility_regime(b, 10, 30)):
        a, b = f(full).orderBy("ts").limit(120).collect(), f(cut).orderBy("ts").collect()
        for p, q in zip(a, b, strict=True):
            for u, v in zip(p, q, strict=True):
                assert u == v or (isinstance(u, float) and math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9)), (p, q)


def test_resample_counts(spark):
    x = bars(spark, [float(i) for i in range(1, 72 * 60 + 1)], step=60)
    for every, count in (("5 minutes", 864), ("15 minutes", 288), ("30 minutes", 144), ("1 hour", 72), ("4 hours", 18), ("1 day", 3)):
        got = resample.coarsen(x, every)
        assert got.count() == count
        assert got.agg(F.sum("volume")).first()[0] == x.agg(F.sum("volume")).first()[0]
    with pytest.raises(ValueError):
        resample.check_target("1h", "90m")


def test_normal_functions(spark):
    xs = [-8.0, -3.0, -1.0, -0.1, 0.0, 0.5, 2.0, 2.99, 3.01, 6.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", n.norm_cdf(F.col("x")).alias("p")).withColumn("q", n.norm_ppf(F.col("p"))).collect()
    for r in got:
        assert math.isclose(r.p, statistics.NormalDist().cdf(r.x), rel_tol=1e-9, abs_tol=1e-15)
        if abs(r.x) < 5:
            assert math.isclose(r.q, r.x, abs_tol=1e-6)


def test_cusum_dwell_against_loops(spark):
    x = walk(300, 3)
    up = down = 0.0
    want = []
    for i in range(1, len(x)):
        r = math.log(x[i] / x[i - 1])
        up, down = max(0.0, up + r), min(0.0, down + r)
        if up > 0.02 or down < -0.02:
            want.append((i, 1 if up > 0.02 else -1))
            up = down = 0.0
    got = [((r.ts - T0).total_seconds() // 3600, r.side) for r in states.cusum_events(bars(spark, x), "close", 0.02).orderBy("ts").collect()]
    assert got == want and len(want) > 5
    labels_ = ["a", "b", "a", "b", "b", "b", "a", None, "a", "a", "a"]
    df = spark.createDataFrame([("A", T0 + timedelta(hours=i), v) for i, v in enumerate(labels_)], "symbol string, ts timestamp, l string")
    assert column(states.dwell(df, "l", 3), "stable") == ["a"] * 5 + ["b"] * 5 + ["a"]


def test_fifo_against_loop(spark):
    rng = random.Random(7)
    rows = [("A", T0 + timedelta(minutes=i), rng.choice(["buy", "sell"]), float(rng.randint(1, 40)), float(rng.randint(10, 20))) for i in range(200)]
    lots, want = [], []
    for i, (_, _, side, qty, price) in enumerate(rows, 1):
        if side == "buy":
            lots.append([qty, price])
            continue
        left, cost = qty, 0.0
        while left > 0 and lots:
            take = min(left, lots[0][0])
            cost += take * lots[0][1]
            left -= take
            lots[0][0] -= take
            if lots[0][0] == 0:
                lots.pop(0)
        want.append((i, qty - left, cost))
    got = trades.fifo(spark.createDataFrame(rows, "symbol string, ts timestamp, side string, qty double, price double"), ["ts"]).orderBy("n").collect()
    assert [(r.n, r.matched, r.cost) for r in got] == want


def test_triple_barrier_tie_counts_as_loss(spark):
    df = bars(spark, [100.0, 100.0, 100.0]).withColumn("high", F.when(F.hour("ts") == 1, 200.0).otherwise(F.col("high"))).withColumn("low", F.when(F.hour("ts") == 1, 50.0).otherwise(F.col("low")))
    got = labels.triple_barrier(df.withColumn("t", F.lit(0.1)), "t", 1.0, 1.0, 2).orderBy("ts").collect()
    assert [r.label for r in got] == [-1, 0]


def test_deflated_sharpe_and_cscv(spark):
    rng = random.Random(1)
    rows = [(v, T0 + timedelta(hours=i), rng.gauss(0.001 if v == "good" else 0.0, 0.01)) for v in ("good", "b", "c", "d") for i in range(400)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, ret double")
    d = {r.symbol: r for r in accounting.deflated_sharpe(df, 10).collect()}
    for r in d.values():
        assert math.isclose(r.dsr, statistics.NormalDist().cdf(r.z), rel_tol=1e-9) and 0 <= r.dsr <= 1
    tests = accounting.cscv(df.withColumnRenamed("symbol", "variant"), 6)
    assert tests.count() == 20 and 0 <= accounting.pbo(tests).first().pbo <= 1


def test_gated_write_and_upsert(spark, tmp_path):
    good = bars(spark, walk(30)).withColumn("interval", F.lit("1h"))
    tables.save_klines(good, str(tmp_path / "k"))
    assert tables.read_klines(spark, str(tmp_path / "k"), ["A"], "1h").count() == 30
    with pytest.raises(ValueError, match="critical"):
        tables.save_klines(good.withColumn("high", F.lit(0.0)), str(tmp_path / "k"))
    assert tables.read_klines(spark, str(tmp_path / "k")).count() == 30
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("b", 0, "w")], "k string, t int, v string")
    assert sorted((r.k, r.v) for r in tables.upsert(old, new, ["k"], ["t"]).collect()) == [("a", "z"), ("b", "y")]


def test_sources(spark, tmp_path):
    (tmp_path / "dump.csv").write_text("agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker\n1,2.5,3,1,1,1704067200000,true\n2,2.6,1,2,2,1704067200500,False\n")
    got = tables.read_trade_dump(spark, str(tmp_path / "dump.csv"), "A").orderBy("trade_id").collect()
    assert [(r.side, r.price) for r in got] == [("sell", 2.5), ("buy", 2.6)]
    (tmp_path / "j.jsonl").write_text('{"strategy": "s", "n_trials": 3}\nnot json\n{"strategy": "t", "n_trials": 4}\n')
    assert tables.read_journal(spark, str(tmp_path / "j.jsonl"), tables.TRIALS).agg(F.sum("n_trials")).first()[0] == 7
    (tmp_path / "c.md").write_text("# t\n| a | b |\n|---|:-:|\n| 1 | x y |\n")
    assert [r.cells for r in tables.read_catalog(spark, str(tmp_path / "c.md")).collect()] == [["a", "b"], ["1", "x y"]]
    day = lambda k, v: spark.createDataFrame([("A", T0 + timedelta(days=k), v, v)], "symbol string, ts timestamp, v int, arrival int")
    for df in (day(0, 1), day(1, 2), day(0, 3)):
        tables.append_days(df, str(tmp_path / "days"))
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "days")).collect()) == [2, 3]


def test_reports(spark):
    x = bars(spark, [1.0, 1.0, 1.0, 5.0, 5.1]).where("hour(ts) <> 4")
    r = quality.bar_report(x.unionByName(x.limit(1))).first()
    assert (r["rows"], r.duplicates, r.flat_run) == (5, 1, 4)


def test_views_need_no_shuffle_for_ticks(spark, sf):
    plan = views.ticks(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_purge_and_windows():
    assert accounting.walk_forward_windows(10, 4, 2, purge=1) == [(0, 0, 3, 4, 6), (1, 2, 5, 6, 8), (2, 4, 7, 8, 10)]


def test_bootstrap_covers_the_sharpe(spark):
    from lodestream.operators import stats

    rng = random.Random(3)
    df = spark.createDataFrame([("A", T0 + timedelta(hours=i), rng.gauss(0.002, 0.01)) for i in range(300)], "symbol string, ts timestamp, r double")
    x = [r.r for r in df.collect()]
    sr = statistics.mean(x) / statistics.pstdev(x)
    got = stats.bootstrap_sharpe(df, "r", 60, 10).first()
    assert got.low < sr < got.high and abs(got.mid - sr) < 0.1
    again = stats.bootstrap_sharpe(df, "r", 60, 10).first()
    assert all(math.isclose(again[c], got[c], rel_tol=1e-9) for c in ("low", "mid", "high"))


def test_hawkes_against_loop(spark):
    from lodestream.operators import evaluation

    rng, at, rows, want, level, last = random.Random(5), 0.0, [], [], 0.0, 0.0
    for _ in range(200):
        at += rng.choice([0.5, 3.0, 400.0]) * rng.random()
        level = level * math.exp(-0.05 * (at - last)) + 1
        last = at
        rows.append(("A", T0 + timedelta(seconds=at)))
        want.append(level)
    got = column(evaluation.hawkes(spark.createDataFrame(rows, "symbol string, ts timestamp"), 0.05), "intensity")
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-4


def test_nearest_ranks_against_sorted_list(spark):
    rng = random.Random(4)
    of = {"a": [float(rng.randint(0, 300)) for _ in range(3001)], "b": [rng.gauss(0, 1) for _ in range(1000)], "c": [5.0], "d": [1.0, 2.0]}
    df = spark.createDataFrame([(s, x) for s, xs in of.items() for x in [*xs, None]], "side string, x double")
    shares = {"low": 0.0, "mid": 0.5, "high": 0.9, "top": 1.0}
    out = trades.nearest_ranks(df, "side", "x", shares)
    half_up = lambda x: math.floor(x + 0.5)
    assert {r.side: tuple(r)[1:] for r in out.collect()} == {s: tuple(sorted(xs)[half_up(q * (len(xs) - 1))] for q in shares.values()) for s, xs in of.items()}
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()


def test_shortfall_gathers_no_group(spark, sf):
    import __spark_entry__

    plan = __spark_entry__.queries()["s5_30_shortfall"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "percentile" not in plan
