"""Rolling windows by overlapping chunks, and hidden regimes, against plain loops."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from lodestream.operators import hidden as hd
from lodestream.operators import windows as wi

T0 = datetime(2024, 1, 1)


def frame(spark, values, symbols=("a", "b"), extra=""):
    rows = [(s, T0 + timedelta(minutes=i), v, i) for s in symbols for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, x double, n int").repartition(4)


def values(n, seed=0, nulls=0.05):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=n).round(1).tolist()  # ties
    return [None if rng.random() < nulls else v for v in out]


@pytest.mark.parametrize("n, chunk", [(1, 3), (5, 5), (7, 16), (40, 41), (300, None)])
def test_rank_and_apply(spark, n, chunk):
    x = values(250)
    rank, span = [], []
    for i in range(len(x)):
        w = x[max(0, i + 1 - n) : i + 1]
        rank.append(sum(v is not None and x[i] is not None and v <= x[i] for v in w) / len(w))
        there = [v for v in w if v is not None]
        span.append(max(there) - min(there) if len(there) >= min(n, 3) else None)
    df = frame(spark, x)
    got = wi.rolling_rank(df, "x", n, chunk=chunk).orderBy("symbol", "n").collect()
    assert [r.rank for r in got] == pytest.approx(rank * 2) and [r.x for r in got] == x * 2
    some = wi.rolling_rank(df, "x", n, least=3, chunk=chunk).orderBy("symbol", "n").collect()
    there = [sum(v is not None for v in x[max(0, i + 1 - n) : i + 1]) for i in range(len(x))]
    assert [r.rank for r in some] == pytest.approx([r if k >= 3 else None for r, k in zip(rank, there, strict=True)] * 2)
    got = wi.rolling_apply(df, "x", n, lambda w: np.nanmax(w) - np.nanmin(w), "span", least=min(n, 3), chunk=chunk).orderBy("symbol", "n").collect()
    assert [r.span for r in got] == pytest.approx(span * 2)


def test_order_dependent_function(spark):
    x = values(90, 1, 0)
    weights = 0.5 ** np.arange(10)[::-1]
    got = wi.rolling_apply(frame(spark, x), "x", 10, lambda w: float(w @ weights), "y", chunk=11).where("symbol = 'b'").orderBy("ts").collect()
    want = [None if i < 9 else float(np.array(x[i - 9 : i + 1]) @ weights) for i in range(len(x))]
    assert [r.y for r in got] == pytest.approx(want)


def test_no_task_holds_a_series(spark):
    df = spark.range(50_000).selectExpr("'a' AS symbol", "timestamp_seconds(id * 60) AS ts", "CAST(id % 97 AS double) AS x")
    got = wi.over_chunks(df, ["x"], 100, lambda x, first: np.full(len(x) - first, len(x)), "rows", chunk=500)
    assert got.agg({"rows": "max"}).first()[0] <= 599 and got.count() == 50_000
    assert wi.rolling_rank(df.where("false"), "x", 5).count() == 0


def test_refits(spark):
    for n, train, test, whole in ((100, 20, 10, True), (95, 20, 10, True), (95, 20, 10, False), (15, 20, 10, False), (33, 10, 7, False)):
        got = wi.refits(frame(spark, [1.0] * n, ("a",)), train, test, whole=whole).collect()
        have = {(r.window, r.n, r._test) for r in got}
        want, k = set(), 0
        while k * test + train + (test if whole else 1) <= n:
            want |= {(k, i, i >= k * test + train) for i in range(k * test, min(n, k * test + train + test))}
            k += 1
        assert have == want and len(got) == len(have)


def series(n=900, seed=3):
    rng = np.random.default_rng(seed)
    scale = np.where(np.arange(n) // 150 % 2, 0.02, 0.002)
    return (100 * np.exp(np.cumsum(rng.normal(0, scale)))).tolist()


def plain_fit(x, k, rounds, tolerance=1e-4):
    """Expectation maximisation by loops over rows and states, in logs."""
    n, d = x.shape
    rng = np.random.default_rng(42)
    q = [0.05 + 0.9 * i / (k - 1) for i in range(k)]
    mean = np.zeros((k, d))
    for j in range(d):
        mean[:, j] = np.quantile(x[:, j], q) + rng.normal(0, 0.01 * x[:, j].std(), k)
    whole = x.var(0) + 1e-12
    var = np.array([whole] * k)
    move = [[math.log(0.9 if i == j else 0.1 / (k - 1)) for j in range(k)] for i in range(k)]
    start, last, seen = [math.log(1 / k)] * k, -math.inf, []
    total = lambda v: max(v) + math.log(sum(math.exp(y - max(v)) for y in v))
    for _ in range(rounds):
        b = [[sum(-0.5 * ((x[t, j] - mean[i, j]) ** 2 / var[i, j] + math.log(2 * math.pi * var[i, j])) for j in range(d)) for i in range(k)] for t in range(n)]
        a = [[start[i] + b[0][i] for i in range(k)]]
        for t in range(1, n):
            a.append([total([a[-1][i] + move[i][j] for i in range(k)]) + b[t][j] for j in range(k)])
        z = [[0.0] * k]
        for t in range(n - 2, -1, -1):
            z.insert(0, [total([move[i][j] + b[t + 1][j] + z[0][j] for j in range(k)]) for i in range(k)])
        ll = total(a[-1])
        seen.append(ll)
        if abs(ll - last) < tolerance:
            break
        last = ll
        g = np.array([[math.exp(a[t][i] + z[t][i] - ll) for i in range(k)] for t in range(n)])
        xi = np.array([[sum(math.exp(a[t][i] + move[i][j] + b[t + 1][j] + z[t + 1][j] - ll) for t in range(n - 1)) for j in range(k)] for i in range(k)])
        start, move = np.log(g[0] + 1e-300).tolist(), np.log(xi / xi.sum(1, keepdims=True) + 1e-300).tolist()
        for i in range(k):
            mean[i] = (g[:, i : i + 1] * x).sum(0) / g[:, i].sum()
        for i in range(k):
            var[i] = np.maximum((g[:, i : i + 1] * (x - mean[i]) ** 2).sum(0) / g[:, i].sum(), 0.01 * whole)
    order = np.argsort(mean[:, 0], kind="stable")
    return mean[order], var[order], np.exp(np.array(move))[order][:, order], np.exp(np.array(start))[order], seen


def observed(close):
    ret = np.r_[0.0, np.diff(close) / np.array(close[:-1])]
    vol = [np.std(ret[max(0, i - 19) : i + 1], ddof=1) if i >= 9 else 0.0 for i in range(len(ret))]
    return np.column_stack([ret, np.abs(ret), vol])[20:]


def test_fit_against_loops():
    x = observed(series())[:160]
    for k in (2, 3):
        model = hd.fit(x, k, 12)
        mean, var, move, start, seen = plain_fit(x, k, 12)
        assert np.allclose(model.mean, mean, atol=1e-9) and np.allclose(model.variance, var, atol=1e-9) and np.allclose(model.move, move, atol=1e-6) and np.allclose(model.start, start, atol=1e-6)
        assert np.allclose(model.likelihoods, seen)
        assert all(b >= a - 1e-6 for a, b in zip(model.likelihoods, model.likelihoods[1:], strict=False))
    assert hd.fit(x[:20], 3) is None and hd.fit(np.ones((100, 2)), 3) is None


def test_regimes_by_window(spark):
    train, test, closes = 240, 100, {s: series(760, k) for k, s in enumerate("abc")}

    def run(upto):
        rows = [(s, T0 + timedelta(minutes=i), v) for s, c in closes.items() for i, v in enumerate(c[:upto])]
        df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double").repartition(3)
        return hd.regimes(hd.observations(df), train=train, test=test, rounds=15)

    got = {(r.symbol, r.ts): r for r in run(760).collect()}
    assert len(got) == 3 * (760 - 20 - train)
    for s, c in closes.items():
        x = observed(c)
        for k in range(-(-(len(x) - train) // test)):
            at = k * test
            model = hd.fit(x[at : at + train], 3, 15)
            now = model.start
            for i in range(at, min(len(x), at + train + test)):  # the filter, row by row
                p = [now[j] * math.exp(-0.5 * sum((x[i, d] - model.mean[j, d]) ** 2 / model.variance[j, d] + math.log(2 * math.pi * model.variance[j, d]) for d in range(3))) for j in range(3)]
                p = np.array(p) / sum(p)
                now = p @ model.move
                if i >= at + train:
                    r = got[s, T0 + timedelta(minutes=i + 20)]
                    assert r.window == k and np.allclose([r.p0, r.p1, r.p2], p, atol=1e-8) and r.state == int(p.argmax())
                    assert r.calm == pytest.approx(p[model.variance[:, 2].argmin()], abs=1e-8)
    # no row depends on a later one
    early = {(r.symbol, r.ts): r for r in run(600).collect()}
    assert len(early) == 3 * (600 - 20 - train) and all(got[k] == r for k, r in early.items())


def test_calm_gate(spark):
    x = frame(spark, [0.1, 0.2, 0.3], ("a",)).selectExpr("symbol", "ts", "1.0 AS sig")
    found = frame(spark, [0.4, 0.5, 0.9], ("a",)).where("n > 0").selectExpr("symbol", "ts", "CASE n WHEN 1 THEN 0.5 ELSE 0.4 END AS calm")
    assert [r.gated for r in hd.gate(x, found).orderBy("ts").collect()] == [0.0, 1.0, 0.0]
