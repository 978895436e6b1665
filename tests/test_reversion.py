"""Exponential GARCH, sparse baskets, unit roots, cointegrating vectors and toxic flow against plain computations."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.functions.numbers import norm_cdf
from lodestream.functions.unit_roots import root_probability
from lodestream.operators import baskets as bk
from lodestream.operators import pairs
from lodestream.operators import volatility as vo

T0 = datetime(2024, 1, 1)


def simulated(n, omega, alpha, beta, gamma, seed):
    rng, h, out = np.random.default_rng(seed), omega / (1 - beta), []
    for _ in range(n):
        z = rng.normal()
        out.append(math.exp(h / 2) * z)
        h = omega + beta * h + alpha * (abs(z) - math.sqrt(2 / math.pi)) + gamma * z
    return np.array(out)


def plain_ll(r, omega, alpha, beta, gamma):
    h, ll, path = math.log(np.var(r)), 0.0, []
    for x in r:
        path.append(h)
        ll -= 0.5 * (h + x * x / max(math.exp(h), 1e-12))
        z = x / max(math.exp(0.5 * h), 1e-8)
        h = min(50.0, max(-50.0, omega + beta * h + alpha * (abs(z) - math.sqrt(2 / math.pi)) + gamma * z))
    return ll, path, h


def test_recurrence_and_likelihood():
    r = simulated(300, -0.4, 0.2, 0.95, -0.1, 0)
    ps = [(-0.4, 0.2, 0.95, -0.1), (0.0, 0.5, 0.5, 0.3), (-90.0, 0.0, 0.0, 0.0)]
    h = vo.log_variances(r, math.log(np.var(r)), *np.array(ps).T)
    for k, p in enumerate(ps):
        ll, path, after = plain_ll(r, *p)
        assert np.allclose(h[:-1, k], path) and h[-1, k] == pytest.approx(after) and vo.likelihood(r, h[:-1])[k] == pytest.approx(ll)


def test_fit_is_likelier_than_where_it_starts_and_finds_the_parameters():
    for seed in range(4):
        r = simulated(1500, -0.5, 0.3, 0.94, -0.2, seed)
        found = vo.fit(r)
        long = math.log(np.var(r))
        assert found[4] == pytest.approx(plain_ll(r, *found[:4])[0])
        assert found[4] >= max(plain_ll(r, long * (1 - b), a, b, g)[0] for a in vo.ALPHAS for b in vo.BETAS for g in vo.GAMMAS) - 1e-9
        assert found[4] > plain_ll(r, -0.5, 0.3, 0.94, -0.2)[0] - 3
        assert abs(found[2] - 0.94) < 0.06 and abs(found[3] + 0.2) < 0.1
    assert vo.fit(np.zeros(100))[1:4] == (0.0, 1.0, 0.0) and vo.fit(r[:10])[1] == 0.0


def test_forecasts_by_window(spark):
    data = {s: simulated(260, -0.5, 0.3, 0.94, -0.2, k) for k, s in enumerate("ab")}
    rows = [(s, T0 + timedelta(minutes=i), None if i == 7 else float(x)) for s, r in data.items() for i, x in enumerate(r)]

    def run(upto):
        df = spark.createDataFrame([r for r in rows if r[1] < T0 + timedelta(minutes=upto)], "symbol string, ts timestamp, r double").repartition(3)
        return {(r.symbol, r.ts): r for r in vo.exponential_garch(df, "r", 100, 50).collect()}

    got, n = run(260), 0
    for s in data:
        own = [r for r in rows if r[0] == s and r[2] is not None]
        for k in range(-(-(len(own) - 100) // 50)):
            train = np.array([r[2] for r in own[k * 50 : k * 50 + 100]])
            p = vo.fit(train)
            h = math.log(np.var(train))
            for i in range(k * 50, min(len(own), k * 50 + 150)):
                z = own[i][2] / max(math.exp(0.5 * h), 1e-8)
                h = p[0] + p[2] * h + p[1] * (abs(z) - math.sqrt(2 / math.pi)) + p[3] * z
                if i >= k * 50 + 100:
                    r = got[s, own[i][1]]
                    assert r.window == k and r.vol == pytest.approx(math.exp(h / 2)) and r.alpha == p[1]
                    n += 1
    assert n == len(got)
    assert all(got[k].vol == r.vol for k, r in run(215).items())


def walks(n=400, seed=1):
    rng = np.random.default_rng(seed)
    common = np.cumsum(rng.normal(0, 0.01, n))
    out = np.column_stack([common + rng.normal(0, 0.004, n), 0.5 * common + rng.normal(0, 0.004, n), np.cumsum(rng.normal(0, 0.01, n)), np.cumsum(rng.normal(0, 0.01, n))])
    return out + 4


def plain_weights(p, most, penalty):
    level, change = np.cov((p - p.mean(0)).T) + 1e-6 * np.eye(p.shape[1]), np.cov(np.diff(p, axis=0).T) + 1e-6 * np.eye(p.shape[1])
    values, vectors = np.linalg.eig(np.linalg.inv(change) @ level)
    w = np.real(vectors[:, np.argmin(np.real(values))])
    w = w / math.sqrt(w @ change @ w)
    w = w if w[np.abs(w).argmax()] > 0 else -w
    w = np.array([math.copysign(max(abs(x) - penalty, 0), x) for x in w])
    for k in sorted(range(len(w)), key=lambda k: -abs(w[k]))[most:]:
        w[k] = 0
    return w / np.abs(w).sum() if np.abs(w).sum() > 1e-12 else np.array([0.5, -0.5, *[0] * (len(w) - 2)])


def test_weights_and_reversion():
    p = walks()
    for most, penalty in ((2, 0.05), (3, 0.0), (4, 5.0), (2, 1e9)):
        assert np.allclose(bk.weights(p[:150], most, penalty), plain_weights(p[:150], most, penalty), atol=1e-6)
    assert set(np.flatnonzero(bk.weights(p, 2, 0.05))) == {0, 1}  # the two that move together
    assert bk.weights(p[:10], 2, 0.05).tolist() == [0.25] * 4 and bk.weights(p[:, :1], 2, 0.0).tolist() == [1.0]
    rng, s = np.random.default_rng(2), np.zeros(400)
    for i in range(1, 400):
        s[i] = 0.9 * s[i - 1] + 0.3 + rng.normal()
    a, b = np.polyfit(s[:-1], s[1:], 1)
    theta, mu, sigma, half = bk.reversion(s)
    assert theta == pytest.approx(-math.log(a)) and mu == pytest.approx(b / (1 - a)) and half == pytest.approx(math.log(2) / theta)
    assert sigma == pytest.approx(np.std(s[1:] - a * s[:-1] - b) * math.sqrt(-2 * math.log(a) / (1 - a * a)))
    assert bk.reversion(np.arange(50.0))[3] is None and bk.reversion(s[:5]) == (0.0, 0.0, 0.0, None)


def test_basket_spreads_and_positions(spark):
    look, p = 40, walks(230)
    rows = [(s, T0 + timedelta(hours=i), float(math.exp(p[i, k]))) for k, s in enumerate("wxyz") for i in range(230) if not (s == "z" and i == 5)]
    members = spark.createDataFrame([("one", s) for s in "wxy"] + [("two", s) for s in "zw"], "basket string, symbol string")

    def run(upto):
        bars = spark.createDataFrame([r for r in rows if r[1] < T0 + timedelta(hours=upto)], "symbol string, ts timestamp, close double").repartition(4)
        return bk.spreads(bk.panels(bars, members), look, 2)

    found = run(230)
    got = {(r.basket, r.ts): r for r in found.collect()}
    n = 0
    for basket, own in (("one", [0, 1, 2]), ("two", [0, 3])):
        x = p[:, own] if basket == "one" else np.delete(p[:, own], 5, 0)
        times = [T0 + timedelta(hours=i) for i in range(230) if basket == "one" or i != 5]
        w, s = None, []
        for i in range(2 * look, len(x)):
            if (i - 2 * look) % (look // 2) == 0:
                w = plain_weights(x[i - 2 * look : i], 2, 0.05)
            r = got[basket, times[i]]
            s.append(x[i] @ w)
            assert r.spread == pytest.approx(s[-1], abs=1e-5) and np.allclose(r.weights, w, atol=1e-5)
            n += 1
        side, held = 0, []
        for i in range(len(s)):
            last = s[max(0, i - look + 1) : i + 1]
            z = (s[i] - np.mean(last)) / np.std(last, ddof=1) if len(last) >= 20 else 0.0
            side = (1 if z <= -1 else -1 if z >= 1 else 0) if side == 0 else 0 if (side == 1 and z >= -0.2) or (side == -1 and z <= 0.2) else side
            held.append(side)
        have = [r.pos for r in bk.positions(found, look, enter=1.0).where(F.col("basket") == basket).orderBy("ts").collect()]
        assert have == held and len(set(held)) == 3
    assert n == len(got)
    assert all(got[r.basket, r.ts].spread == r.spread for r in run(200).collect())


def test_normal_distribution(spark):
    xs = [x / 7 for x in range(-70, 71)] + [-38.0, -7.0, 7.0, 38.0]
    for x, got in zip(xs, [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(norm_cdf(F.col("x")).alias("p")).collect()], strict=True):
        assert got == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=1e-6, abs=1e-14)


def test_root_probabilities_at_tabled_values(spark):
    # critical values at 1, 5 and 10 % for long series, with a constant
    tabled = {1: (-3.43, -2.86, -2.57), 2: (-3.90, -3.34, -3.04), 3: (-4.29, -3.74, -3.45)}
    for n, ts in tabled.items():
        df = spark.createDataFrame([(t,) for t in (*ts, -100.0, 100.0, None)], "t double")
        p = [r.p for r in df.select(root_probability(F.col("t"), n).alias("p")).collect()]
        assert np.allclose(p[:3], (0.01, 0.05, 0.1), atol=0.002) and p[3:] == [0.0, 1.0, None]
        grid = [r.p for r in spark.range(-600, 60).select(root_probability(F.col("id") / 100, n).alias("p")).collect()]
        assert all(b >= a - 2e-3 for a, b in zip(grid, grid[1:], strict=False))


def test_cointegrating_vector(spark):
    rows, want = [], {}
    for k in range(6):
        rng = np.random.default_rng(k)
        x = np.cumsum(rng.normal(0, 0.02, 300)) + 3
        y = (0.5 + 0.3 * k) * x + rng.normal(0, 0.01, 300) + 1
        rows += [(f"p{k}", T0 + timedelta(hours=i), float(math.exp(y[i])), float(math.exp(x[i]))) for i in range(300)]
        u = np.column_stack([y, x])[:210]
        d, level = np.diff(u, axis=0), u[1:-1]
        z, d = d[:-1] - d[:-1].mean(0), d[1:] - d[1:].mean(0)
        level = level - level.mean(0)
        hat = lambda v, z=z: v - z @ np.linalg.lstsq(z, v, rcond=None)[0]
        r0, r1 = hat(d), hat(level)
        m = np.linalg.inv(r1.T @ r1) @ (r1.T @ r0) @ np.linalg.inv(r0.T @ r0) @ (r0.T @ r1)
        values, vectors = np.linalg.eig(m)
        v = np.real(vectors[:, np.argmax(np.real(values))])
        want[f"p{k}"] = abs(v[1] / v[0])
        assert abs(want[f"p{k}"] - 0.5 - 0.3 * k) < 0.1
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, c1 double, c2 double")
    got = {r.symbol: r.beta for r in pairs.johansen(df).collect()}
    assert got == pytest.approx(want, rel=1e-4)
    assert pairs.johansen(df.where(F.col("ts") < T0 + timedelta(hours=40))).first().beta is None


def test_places(spark):
    x = spark.range(3000).select(F.pmod(F.hash("id"), F.lit(50)).alias("a"), "id")
    got = [(r.a, r.id) for r in pairs.placed(x, [F.desc("a"), F.col("id")]).orderBy("place").collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1]))
    assert sorted(r.place for r in pairs.placed(x, [F.desc("a"), F.col("id")]).collect()) == list(range(1, 3001))


def test_toxic_flow(spark):
    rng = np.random.default_rng(4)
    ticks = [("A", T0 + timedelta(seconds=float(t)), k, "buy" if rng.random() < 0.6 else "sell") for k, t in enumerate(np.cumsum(rng.exponential(5, 200)))]
    at = [("A", T0 + timedelta(seconds=s)) for s in range(-10, 1100, 37)] + [("B", T0)]
    got = {(r.symbol, r.ts): r.imbalance for r in pairs.toxic_flow(spark.createDataFrame(ticks, "symbol string, ts timestamp, trade_id bigint, side string"), spark.createDataFrame(at, "symbol string, ts timestamp"), 0.05).collect()}
    for s, t in at:
        last = {}
        for side in ("buy", "sell"):
            own = [x[1] for x in ticks if x[0] == s and x[3] == side and x[1] <= t]
            last[side] = sum(math.exp(-0.05 * (own[-1] - u).total_seconds()) for u in own) if own else 0.0
        total = sum(last.values())
        assert got[s, t] == pytest.approx((last["buy"] - last["sell"]) / total if total else 0.0, abs=1e-6)
