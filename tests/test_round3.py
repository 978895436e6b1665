import datetime
import math
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lodestream.functions.numbers import share_of
from lodestream import views
from lodestream.operators import joins, pairs, quantiles, states, trades
from lodestream.plans import QUERIES
from lodestream.session import shared_dir
from lodestream.sources import tables
from lodestream.streaming import streams


def test_shares_of_counts_are_exact(spark):
    got = {r.id: r.m for r in spark.range(1, 1000).select("id", share_of(F.col("id"), 0.7).alias("m")).collect()}
    assert got == {n: n * 7 // 10 for n in range(1, 1000)}
    rows = [(f"S{k}", t, 100 + math.sin(t * (k + 1)) + k) for k in range(2) for t in range(720)]
    bars = spark.createDataFrame(rows, "symbol string, ts int, close double")
    (r,) = pairs.compare_hedges(pairs.all_pairs(bars), 48).collect()
    assert r.n == 216  # 720 less 504; in doubles 0.7 * 720 is below 504


def _events(path, ids, value, span=1):
    """A file of events of one symbol."""
    rows = {"event_id": list(ids), "ts": pa.array([k // span * 1_000_000 for k in ids], pa.timestamp("us")), "user_id": [8 * (k % 5) for k in ids], "event_type": ["view"] * len(ids), "value": [value(k) for k in ids], "props": ['{"k": 3}'] * len(ids)}
    pq.write_table(pa.table(rows), path)


def test_hedge_weight_far_from_even(spark, tmp_path):
    step, s = states.hedge_step(0.01), states.HedgeState()
    for k in range(120_000):  # every change turns: the losses of the follower pass what exp can take
        (w,) = step(s, 1.0 + k % 2)
    assert w < 1e-300
    s.follow, s.revert = 0.0, 120_000.0
    assert step(s, 1.0)[0] == 1.0


def test_stream_states_hold_no_series_and_go_on(spark, tmp_path):
    _events(tmp_path / "events.parquet", range(3000), lambda k: 1.0 + k * 7 % 11)
    time.sleep(1.1)  # files are taken in order of time
    _events(tmp_path / "events.parquet.2", range(3000, 5000), lambda k: 1.0 + k * 7 % 13)

    def run(step, out):
        return streams.keyed_states(streams.ticks(spark, str(tmp_path)), "symbol", ("ts", "trade_id"), ["price"], states.KalmanState, step, out, "kalman")

    rows = spark.read.schema(streams.EVENTS).parquet(str(tmp_path)).select(F.lit("S0").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("trade_id"), F.col("value").alias("price"))
    want = states.keyed_scan(rows, "symbol", ("ts", "trade_id"), ["price"], states.KalmanState, states.level_step(1e-3, 1e-1), [("level", "double")])
    got = run(states.level_step(1e-3, 1e-1), [("level", "double")])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 5000

    def largest(s, price):
        import gc

        import pandas

        frames = [len(x) for x in gc.get_objects() if isinstance(x, pandas.DataFrame)] if s.p == 1.0 else []
        s.p = 2.0
        return (max(frames, default=0),)

    assert max(r.rows for r in run(largest, [("rows", "int")]).collect()) <= 1000  # a batch of Arrow rows at most


def test_edges_between_values_a_unit_apart_are_rounded_once(spark):
    rng = random.Random(3)
    rows = []
    for g in range(400):
        x = rng.uniform(-50, 50)
        y = x if rng.random() < 0.3 else math.nextafter(x, math.inf) if rng.random() < 0.7 else x + rng.random()
        rows += [(g, x), (g, y), (g, y)]
    want = {}
    for k, q in (("a", 0.2), ("b", 0.3), ("c", 0.4)):
        d = q * 2
        for g in range(400):
            low, high = sorted(v for h, v in rows[3 * g : 3 * g + 3] if h == g)[:2]
            want[g, k] = low if low == high else math.fma(low, 1 - d, d * high)
    found = quantiles.quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", {"a": 0.2, "b": 0.3, "c": 0.4}).collect()
    assert {(r.g, k): r[k] for r in found for k in "abc"} == want


def test_overlap_repeats_no_row(spark):
    rng = random.Random(5)
    at = lambda day: datetime.datetime(2000, 1, 1) + datetime.timedelta(days=day)
    spans = lambda n, most: [(k, f"S{rng.randrange(3)}", at(a), at(a + rng.randrange(most))) for k in range(n) for a in [rng.randrange(4000)]]
    rows, windows = spans(300, 3000), spans(12, 200)
    r, w = (spark.createDataFrame(x, "id int, symbol string, start timestamp, end timestamp") for x in (rows, windows))
    want = sorted(i for i, s, a, z in rows if any(t == s and b <= z and a <= y for _, t, b, y in windows))
    for few in (64, 2):
        x = joins.overlapping(r, w, ["symbol"], few=few)
        assert sorted(q.id for q in x.collect()) == want and x.columns == r.columns
        assert "Generate" not in x._jdf.queryExecution().optimizedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_streaks_over_spans_against_loop(spark):
    rng = random.Random(8)
    rows = []
    for symbol, days in (("A", 900), ("B", 40), ("C", 1)):
        sign = 1.0
        for k in range(400):
            sign = rng.choice([-1.0, 0.0, 1.0]) if rng.random() < 0.08 else sign
            rows.append((symbol, datetime.datetime(2000, 1, 1) + datetime.timedelta(days=k * days // 400), k, sign))
    rows += [("D", datetime.datetime(2000, 1, 1) + datetime.timedelta(days=k), k, -1.0) for k in range(200)]  # one stretch over seven spans
    want = {}
    for symbol in "ABCD":
        best, run, last = {-1.0: 0, 0.0: 0, 1.0: 0}, 0, None
        for *_, r in sorted(x for x in rows if x[0] == symbol):
            run, last = run + 1 if r == last else 1, r
            best[r] = max(best[r], run)
        want[symbol] = (best[-1.0], best[1.0])
    x = trades.streaks(spark.createDataFrame(rows, "symbol string, ts timestamp, id int, ret double"), ["symbol"], ["ts", "id"])
    assert {r.symbol: (r.losing, r.winning) for r in x.collect()} == want and want["D"] == (200, 0)
    assert "windowspecdefinition(symbol#" in _plan(x) and ", _t#" in _plan(x)  # ranks run inside a span, not over a series


def test_nearest_frames_end_at_the_row(spark):
    at = lambda s: datetime.datetime(2000, 1, 1) + datetime.timedelta(seconds=s)
    rng = random.Random(9)
    left, right = [("A", at(rng.randrange(400_000)), k) for k in range(200)], [("A", at(s), float(s)) for s in sorted(rng.sample(range(400_000), 60))]
    x = joins.nearest_join(spark.createDataFrame(left, "symbol string, ts timestamp, id int"), spark.createDataFrame(right, "symbol string, ts timestamp, x double"), "ts", ["symbol"], ["x"])
    want = {k: min((abs((b - a).total_seconds()), b, v) for _, b, v in right)[2] for _, a, k in left}
    assert {r.id: r.near_x for r in x.collect()} == want
    assert "unboundedfollowing" not in _plan(x).lower()


def test_steps_that_are_read_twice_are_settled(spark, sf):
    assert "Join" not in _plan(views.sweep(spark, sf))
    report, seen = spark.range(50).select("id"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    path = f"{shared_dir(spark)}/report-{random.random()}"
    text = tables.save_report(report.mapInArrow(counted, "id bigint"), path, ["id"], top=2)
    assert text.splitlines()[2:] == ["| 0 |", "| 1 |"] and seen.value == 50
    assert "Window" not in _plan(trades.fifo(views.fills(spark, sf), ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty", "l_extendedprice"]))
    assert "strategy=broadcast" in _plan(QUERIES["s3_16_entry_features"](spark, sf)) and "strategy=broadcast" not in _plan(spark.range(3).join(joins.small(spark.range(9), 8), "id"))
