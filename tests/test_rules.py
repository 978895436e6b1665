"""State machines and two-level operators against plain loops, and plans without a window over a whole series."""

import math
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream import views as v
from lodestream.operators import accounting as ac
from lodestream.operators import features as ft
from lodestream.operators import joins, labels, models, resample, scan, signals, states, sweeps

T0 = datetime(2024, 1, 1)


def series(n, seed, gap=1.0):
    rng = random.Random(seed)
    price, out = 100.0, []
    t = T0
    for i in range(n):
        t += timedelta(hours=gap * rng.choice([1, 1, 1, 5, 40]))
        price *= math.exp(rng.gauss(0, 0.01))
        out.append((i, t, price, price * (1 + abs(rng.gauss(0, 0.006))), price * (1 - abs(rng.gauss(0, 0.006))), float(rng.randint(1, 50))))
    return out


def frame(spark, rows, symbol="A"):
    return spark.createDataFrame([(symbol, i, t, p, h, l, p, a) for i, t, p, h, l, a in rows], "symbol string, trade_id int, ts timestamp, price double, high double, low double, close double, amount double")


@pytest.mark.parametrize(("dollars", "runs"), [(False, False), (True, False), (False, True), (True, True)])
def test_adaptive_bars(spark, dollars, runs):
    rows = series(1500, 1, 0.01)
    b, last = [], 1
    for k, r in enumerate(rows):
        if k and r[2] != rows[k - 1][2]:
            last = 1 if r[2] > rows[k - 1][2] else -1
        b.append(last)
    size = [r[2] * r[5] if dollars else 1.0 for r in rows]
    a = 2 / 41

    def mean(x):
        out, num, den = [], 0.0, 0.0
        for y in x:
            num, den = num * (1 - a) + y, den * (1 - a) + 1
            out.append(num / den)
        return out

    buy, sell = [s if k > 0 else 0.0 for s, k in zip(size, b, strict=True)], [s if k < 0 else 0.0 for s, k in zip(size, b, strict=True)]
    flow, mb, ms = mean([x - y for x, y in zip(buy, sell, strict=True)]), mean(buy), mean(sell)
    want, expected, cut, tb, ts = [], 30.0, 0, 0.0, 0.0
    for i in range(1, len(rows)):
        tb, ts = tb + buy[i], ts + sell[i]
        have = max(tb, ts) if runs else abs(tb - ts)
        bar = max(mb[i], ms[i], 1e-6 if dollars else 0.5) if runs else max(abs(flow[i]), 1e-6 if dollars else 0.0)
        if have >= expected * bar:
            want.append((i, i - cut))
            expected = (expected * 40 + (i - cut)) / 41
            cut, tb, ts = i, 0.0, 0.0
    got = states.imbalance_cuts(frame(spark, rows), dollars, runs, 30.0, 40).orderBy("bar").collect()
    at = {r[1]: r[0] for r in rows}
    assert [(at[g.ts], g.ticks) for g in got] == want and len(want) > 10


def test_two_level_operators(spark):
    rows = series(900, 2, 3.0)
    df = frame(spark, rows)
    got = {r.trade_id: r for r in scan.scans(df, {"a": (0.8, 0.2 * F.col("price"), F.col("price")), "b": (0.99, F.col("amount"), None), "c": (0.0, F.col("amount"), None)}).collect()}
    a, c = rows[0][2], 0.0
    for r in rows:
        a = r[2] if r[0] == 0 else 0.8 * a + 0.2 * r[2]
        c = 0.99 * c + r[5]
        assert got[r[0]].a == pytest.approx(a, rel=1e-12) and got[r[0]].b == pytest.approx(c, rel=1e-12) and got[r[0]].c == r[5]
    right = df.where("trade_id % 7 = 3").select("symbol", "ts", F.col("amount").alias("x"))
    back = {r.trade_id: r.event_x for r in joins.asof_join(df, right, cols=["x"]).collect()}
    near = {r.trade_id: r.near_x for r in joins.nearest_join(df, right, "ts", ["symbol"], ["x"]).collect()}
    keyed = [r for r in rows if r[0] % 7 == 3]
    for r in rows:
        before = [k for k in keyed if k[1] <= r[1]]
        assert back[r[0]] == (before[-1][5] if before else None)
        assert near[r[0]] == min(keyed, key=lambda k: (abs(k[1] - r[1]), k[1]))[5]
    sums = {r.trade_id: r.s for r in joins.trailing_sum(df, "amount", 20 * 3600, "s").collect()}
    signs = {r.trade_id: r.b for r in resample.tick_rule(df).collect()}
    last = 1.0
    for k, r in enumerate(rows):
        assert sums[r[0]] == sum(x[5] for x in rows[: k + 1] if r[1] - x[1] < timedelta(hours=20))
        if k and r[2] != rows[k - 1][2]:
            last = math.copysign(1, r[2] - rows[k - 1][2])
        assert signs[r[0]] == last


def test_no_window_over_a_whole_series(spark, sf):
    """Windows over ticks are partitioned by time as well; only tables of one row a bucket or chunk are ordered whole."""
    t, f = v.ticks(spark, sf), v.funding(spark, sf)
    for df in (joins.asof_join(t, f, cols=["rate"], tie="seq"), resample.tick_rule(t), joins.trailing_sum(t, "amount", 900, "s"), scan.ema(t, "price", 9, order=("ts", "trade_id")), resample.bars_from_cuts(t, F.col("amount") > 90)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        for spec in re.findall(r"Window \[(.*?)\], \[(.*?)\], \[(.*?)\]", plan):
            if re.fullmatch(r"symbol#\d+", spec[1].strip()):
                assert re.search(r"_bucket|_c#|_span", spec[2]), spec


def test_barriers_with_side(spark):
    rows = series(300, 3)
    df = frame(spark, rows).withColumn("target", F.lit(0.01)).withColumn("side", F.when(F.col("trade_id") % 2 == 0, 1).otherwise(-1))
    got = {r.trade_id: (r.label, r.t1) for r in labels.triple_barrier(df, "target", 1.0, 1.5, 8, side="side").collect()}
    for k, r in enumerate(rows[:-1]):
        side, want = (1 if k % 2 == 0 else -1), None
        for x in rows[k + 1 : k + 9]:
            best, worst = (x[3], x[4]) if side > 0 else (x[4], x[3])
            if (worst / r[2] - 1) * side <= -0.015:
                want = (-1, x[1])
            elif (best / r[2] - 1) * side >= 0.01:
                want = (1, x[1])
            if want:
                break
        assert got[k] == (want or (0, rows[min(k + 8, len(rows) - 1)][1])), k


def test_mean_reversion(spark):
    rows = series(900, 4)
    close = np.array([r[2] for r in rows])
    high, low = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])

    def wilder(x):
        num = den = 0.0
        for y in x:
            num, den = num * 13 / 14, den * 13 / 14
            if y is not None:
                num, den = num + y, den + 1
            yield num / den if den else None

    d = [None, *np.diff(close)]
    gain, loss = list(wilder([None if x is None else max(x, 0.0) for x in d])), list(wilder([None if x is None else max(-x, 0.0) for x in d]))
    tr = [high[0] - low[0]] + [max(high[i] - low[i], abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])) for i in range(1, len(close))]
    atr = list(wilder(tr))
    fast = slow = close[0]
    lr = [None, *np.diff(np.log(close))]
    rv, want, held, entry = [], [], 0, 0
    for i, c in enumerate(close):
        fast, slow = (fast, slow) if i == 0 else (0.8 * fast + 0.2 * c, slow * (1 - 2 / 51) + c * 2 / 51)
        strength = min(1.0, abs(fast - slow) / np.std(close[i - 49 : i + 1], ddof=1)) if i >= 49 else 0.0
        got = [x for x in lr[max(0, i - 59) : i + 1] if x is not None]
        rv.append(np.std(got, ddof=1) if len(got) >= 30 else None)
        span = rv[max(0, i - 499) : i + 1]
        high_vol = sum(x is not None for x in span) >= 250 and sum(x is not None and x <= rv[i] for x in span) / len(span) > 0.8
        rsi = 50.0 if gain[i] is None or (loss[i] == 0 and gain[i] == 0) else 100.0 if loss[i] == 0 else 100 - 100 / (1 + gain[i] / loss[i])
        if i >= 19:
            mid, dev = close[i - 19 : i + 1].mean(), close[i - 19 : i + 1].std()
            new = 1 if rsi < 40 and c < mid - 2 * dev else -1 if rsi > 60 and c > mid + 2 * dev else 0
            new = new if atr[i] / c >= 0.001 and strength < 0.9 and not high_vol else 0
            leave = (entry == 1 and (c >= mid or c < mid - 2 * atr[i])) or (entry == -1 and (c <= mid or c > mid + 2 * atr[i]))
            held = 0 if leave else new or held
            entry = new or entry
        want.append(float(held))
    got = [r.sig for r in signals.mean_reversion(frame(spark, rows), 40.0, 60.0, max_trend=0.9).orderBy("trade_id").collect()]
    assert got == want and len(set(want)) == 3


def test_supertrend_and_kalman(spark):
    rows = series(250, 5)
    df = frame(spark, rows).withColumn("atr", F.lit(1.0))
    up = down = close = None
    side, want = 1, []
    for r in rows:
        mid = (r[3] + r[4]) / 2
        new_up, new_down = mid + 3, mid - 3
        if up is not None:
            new_up = new_up if new_up < up or close > up else up
            new_down = new_down if new_down > down or close < down else down
            side = -1 if side > 0 and r[2] < new_down else 1 if side < 0 and r[2] > new_up else side
        up, down, close = new_up, new_down, r[2]
        want.append((down if side > 0 else up, side))
    got = [(r.line, r.side) for r in states.supertrend(df).orderBy("ts").collect()]
    assert got == want and {s for _, s in want} == {1, -1}
    pairs = df.select(F.col("symbol").alias("pair"), "ts", F.ln("close").alias("y"), F.ln("amount").alias("x"))
    beta, p = 0.0, 1.0
    for r, g in zip(rows, states.kalman_hedge(pairs).orderBy("ts").collect(), strict=True):
        x, y, q = math.log(r[5]), math.log(r[2]), p + 1e-5
        e, gain = y - beta * x, q * x / (x * x * q + 1e-2)
        beta, p = beta + gain * e, (1 - gain * x) * q
        assert (g.beta, g.error) == (pytest.approx(beta, rel=1e-12), pytest.approx(e, rel=1e-12))


def test_stops_and_costs(spark):
    rows = series(120, 6)
    df = frame(spark, rows).withColumn("pos", F.when(F.col("trade_id") % 40 < 30, F.when(F.col("trade_id") < 60, 1.0).otherwise(-1.0)).otherwise(0.0))
    got = {r.trade_id: r for r in ac.stop_exits(df, 0.02, 0.03).collect()}
    hits = 0
    for a, z in ((0, 30), (40, 60), (60, 70), (80, 110)):
        if a == 0:
            continue  # decided before the first bar
        side = 1 if a < 60 else -1
        entry, done = rows[a - 1][2], False
        for k in range(a, z):
            assert got[k].pos == (0.0 if done else side)
            adverse, kind = (rows[k][4], rows[k][3]) if side > 0 else (rows[k][3], rows[k][4])
            stop, take = entry * (1 - 0.02 * side), entry * (1 + 0.03 * side)
            if not done and ((adverse - stop) * side <= 0 or (kind - take) * side >= 0):
                price = stop if (adverse - stop) * side <= 0 else take
                assert got[k].exit_ret == pytest.approx(side * (price / rows[k - 1][2] - 1))
                done, hits = True, hits + 1
            else:
                assert got[k].exit_ret is None
    assert hits >= 2


def test_haircut_of_winners(spark, sf):
    from statistics import NormalDist

    cells = v.sweep(spark, sf.replace("0.001", "0.01"))
    rows = [r for r in cells.collect() if r.status == "ok" and r.avg_oos_sharpe is not None]
    got = sweeps.winners(cells).collect()
    for g in got:
        own = [r.avg_oos_sharpe for r in rows if (r["mode"], r["interval"]) == (g["mode"], g["interval"])]
        n, inv = len(own), NormalDist().inv_cdf
        sr0 = math.sqrt(np.var(own, ddof=1)) * ((1 - 0.5772156649015329) * inv(1 - 1 / n) + 0.5772156649015329 * inv(1 - 1 / (n * math.e)))
        assert g.n == n and g.value == max(own) and g.selection_sr0 == pytest.approx(sr0, rel=1e-6) and g.deflated == pytest.approx(max(own) - sr0, rel=1e-6)
    assert len(got) == 6


def test_small_systems(spark):
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4):
        a, b = rng.normal(size=(n, n)), rng.normal(size=n)
        got = spark.range(1).select(*models.solve([[F.lit(float(x)) for x in row] for row in a], [F.lit(float(x)) for x in b])).first()
        assert np.allclose(list(got), np.linalg.solve(a, b))


def test_volatility_regime(spark):
    rows = series(700, 7)
    close = [r[2] for r in rows]
    lr = [None] + [math.log(b / a) for a, b in zip(close, close[1:], strict=False)]
    rv, want = [], []
    for i in range(len(close)):
        x = [y for y in lr[max(0, i - 59) : i + 1] if y is not None]
        rv.append(np.std(x, ddof=1) if len(x) >= 30 else None)
        w = rv[max(0, i - 499) : i + 1]
        share = sum(y is not None and rv[i] is not None and y <= rv[i] for y in w) / len(w) if sum(y is not None for y in w) >= 250 else None
        want.append("normal" if share is None else "high" if share > 0.8 else "low" if share < 0.2 else "normal")
    got = [r.vol_regime for r in ft.volatility_regime(frame(spark, rows)).orderBy("trade_id").collect()]
    assert got == want and len(set(want)) == 3
