"""Models by window: folds without leaks, and each number against a plain computation."""

import itertools
import math
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from lodestream.operators import learning as ln
from lodestream.operators.boosted import Boosted, Logistic, Settings

T0 = datetime(2024, 1, 1)
FEATURES = ["a", "b", "c", "d"]


def made(n=260, symbols=("x", "y"), seed=0):
    """Rows whose label follows a, and d is nearly a; series y starts later."""
    rng, rows = np.random.default_rng(seed), []
    for k, s in enumerate(symbols):
        a, b, c = rng.normal(size=(3, n))
        up = a + 0.4 * rng.normal(size=n) > 0
        for i in range(n):
            at = T0 + timedelta(hours=i + 70 * k)
            rows.append((s, at, at + timedelta(hours=int(rng.integers(0, 6))), float(a[i]), float(b[i]), None if i % 17 == 3 else float(c[i]), float(a[i] + 0.05 * rng.normal()), 1 if up[i] else -1, float(rng.normal()), float(1 + i % 3)))
    return rows


SCHEMA = "symbol string, ts timestamp, t1 timestamp, a double, b double, c double, d double, label int, fwd double, w double"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(5).cache()


def test_first_split_is_the_best():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 8, (120, 3)).astype(float), rng.integers(0, 2, 120)
    x[::11, 1] = np.nan
    model = Boosted(x, y, settings=Settings(trees=1, depth=1, rate=1.0, least=10, balanced=False, bins=64))
    p = y.mean()
    best = 0.0
    for f in range(3):
        for cut in [-np.inf, *np.unique(x[~np.isnan(x[:, f]), f])]:
            left = np.isnan(x[:, f]) | (x[:, f] <= cut)
            if min(left.sum(), (~left).sum()) < 10:
                continue
            gain = -((120 * p - y.sum()) ** 2) / (120 * p * (1 - p) + 1)
            for side in (left, ~left):
                gain += (side.sum() * p - y[side].sum()) ** 2 / (side.sum() * p * (1 - p) + 1)
            best = max(best, gain)
    assert model.gain.sum() == pytest.approx(best)
    assert len(np.unique(model.probability(x))) == 2


def test_trees_learn_what_lines_cannot():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] * x[:, 1] > 0) * 1
    model, line = Boosted(x[:2000], y[:2000]), Logistic(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9 > 0.7 > ((line.probability(x[2000:]) > 0.5) == y[2000:]).mean()
    assert min(model.gain[:2]) > 10 * max(model.gain[2:])
    assert np.allclose(Boosted(x[:50], np.ones(50)).probability(x[:3]), 1, atol=1e-6) and np.allclose(Boosted(x[:50], np.zeros(50)).probability(x[:3]), 0, atol=1e-6)
    same = Boosted(x[:2000], y[:2000]).probability(x[2000:])
    assert (same == model.probability(x[2000:])).all()


def test_logistic_gradient_is_zero():
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(300, 3)) * [1, 5, 0], rng.uniform(1, 2, 300)
    y = (x[:, 0] + rng.normal(size=300) > 0) * 1.0
    m = Logistic(x, y, w, 0.02)
    z, v = m._design(x), w / w.mean()
    slope = z.T @ (v * (y - m.probability(x))) - np.r_[0, 0.02 * v.sum() * m.beta[1:]]
    assert np.abs(slope).max() < 1e-6


def plain_windows(rows, train, test):
    """(symbol, window) -> training rows, test rows."""
    by, out = defaultdict(list), {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        by[r[0]].append(r)
    for s, own in by.items():
        k = 0
        while k * test + train < len(own):
            out[s, k] = own[k * test : k * test + train], own[k * test + train : k * test + train + test]
            k += 1
    return out


def xy(rows, features=FEATURES):
    at = {"a": 3, "b": 4, "c": 5, "d": 6}
    x = np.array([[np.nan if r[at[f]] is None else r[at[f]] for f in features] for r in rows], float).reshape(len(rows), len(features))
    return x, np.array([r[7] == 1 for r in rows]) * 1.0, np.array([r[9] for r in rows])


def test_walk_forward(df):
    rows = made()
    got = {(r.symbol, r.ts): r for r in ln.walk_forward(df, FEATURES, "label", 90, 40, 5, weight="w").collect()}
    n = 0
    for (s, k), (train, test) in plain_windows(rows, 90, 40).items():
        known = [r for r in train[:85] if r[2] <= test[0][1]]
        x, y, w = xy(known)
        p = Logistic(x, y, w).probability(xy(test)[0])
        for r, want in zip(test, p, strict=True):
            assert got[s, r[1]].window == k and got[s, r[1]].p == pytest.approx(want, abs=1e-9)
        n += len(test)
    assert len(got) == n


def test_no_look_ahead(df, spark):
    """A series that starts later changes nothing in another, nor do later rows change earlier predictions."""
    full = {(r.symbol, r.ts): r.p for r in ln.walk_forward(df, FEATURES, "label", 90, 40).collect()}
    cut = T0 + timedelta(hours=200)
    for part in (df.where(f"ts < timestamp'{cut}'"), df.where("symbol = 'x'")):
        for r in ln.walk_forward(part, FEATURES, "label", 90, 40).collect():
            assert full[r.symbol, r.ts] == r.p
    assert ln.walk_forward(df.limit(0), FEATURES, "label", 90, 40).count() == 0
    unlabelled = df.selectExpr("* except (label)", "CAST(NULL AS int) AS label")
    assert {r.p for r in ln.walk_forward(unlabelled, FEATURES, "label", 90, 40).collect()} == {None}


def plain_folds(train, test, folds=3, gap=10, embargo=0.01):
    kept = [r for r in train if r[2] <= test[0][1]]
    size, away = len(kept) // (folds + 1), int(len(kept) * embargo)
    out = {0: (kept, test)}
    for f in range(1, folds + 1):
        at = f * size
        out[f] = [r for i, r in enumerate(kept) if i < at - gap and (not away or i < at - away) and r[2] <= kept[at][1]], kept[at : at + size]
    return out


def test_meta_folds_have_no_leak(df):
    got = defaultdict(lambda: ([], []))
    for r in ln.meta_folds(df, 120, 40).collect():
        got[r.symbol, r.window, r.fold][0 if r.learns else 1].append(tuple(r)[:10])
    want = {(s, k, f): v for (s, k), (train, test) in plain_windows(made(), 120, 40).items() if len(test) == 40 for f, v in plain_folds(train, test).items()}
    assert set(got) == set(want)
    for key, (learn, give) in got.items():
        assert sorted(learn) == sorted(want[key][0]) and sorted(give) == sorted(want[key][1])
        first = min(r[1] for r in give)
        assert all(r[1] < first and r[2] <= first for r in learn)  # neither the row nor its label reaches what is predicted


@pytest.mark.parametrize("forward", [None, "fwd"])
def test_meta_labels(df, forward):
    model = ln.trees(trees=5, depth=2, least=5)
    got = {(r.symbol, r.ts): r for r in ln.meta_labels(df, FEATURES, "label", 120, 40, model=model, weight="w", forward=forward, fee=0.1).collect()}
    n = 0
    for (s, k), (train, test) in plain_windows(made(), 120, 40).items():
        if len(test) < 40:
            continue
        xs, ys, ws, first = [], [], [], None
        for f, (learn, give) in plain_folds(train, test).items():
            x, y, w = xy(learn)
            p = model(x, y, w).probability(xy(give)[0])
            side = np.where(p >= 0.5, 1, -1)
            if f == 0:
                first = (give, p, side)
                continue
            xs.append(np.column_stack([xy(give)[0], side]))
            ys.append(np.array([s_ * r[8] - 0.1 > 0 if forward else (s_ == 1) == (r[7] == 1) for s_, r in zip(side, give, strict=True)]) * 1.0)
            ws.append(xy(give)[2])
        give, p, side = first
        meta = model(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws)).probability(np.column_stack([xy(give)[0], side]))
        for r, a, b, c in zip(give, p, side, meta, strict=True):
            own = got[s, r[1]]
            assert own.window == k and own.side == b and own.p_side == pytest.approx(a) and own.p_meta == pytest.approx(c)
        n += len(give)
    assert len(got) == n > 100


def test_signal_from_probability(spark):
    x = spark.createDataFrame([(0.9, -1), (0.5, 1), (0.2, 1), (None, 1)], "p double, side int")
    size = math.erf((0.4 / math.sqrt(0.09)) / math.sqrt(2))
    assert [r.sig for r in ln.model_signal(x, "p", "side").collect()] == pytest.approx([-size, 0, 0, 0], abs=1e-9)
    got = [r.sig for r in ln.model_signal(x, "p", least=0.7).collect()]
    assert got == pytest.approx([size, 0, -math.erf((0.3 / 0.4) / math.sqrt(2)), 0], abs=1e-9)


def test_importance_folds(df):
    got = defaultdict(dict)
    for r in ln.importance_folds(df, 80, 4, 0.05).collect():
        got[r.symbol, r.window, r.fold][r._j] = r
    assert len(got) == 2 * 3 * 4
    for (_, _, fold), own in got.items():
        first = fold * 20
        for j, r in own.items():
            want = "test" if first <= j < first + 20 else ("train" if r.t1 <= own[first].ts else None) if j < first else "train" if j >= first + 20 + 4 else None
            assert r.role == want


def test_scores_against_plain(df):
    size, folds, model = 120, 3, ln.trees(trees=8, depth=2, least=5)
    got = {(r.symbol, r.window, r.fold, r.feature): r for r in ln.fold_scores(df, FEATURES, "label", size, folds, model=model, weight="w").collect()}
    by = defaultdict(list)
    for r in sorted(made(), key=lambda r: (r[0], r[1])):
        by[r[0]].append(r)
    n, tables = 0, defaultdict(list)
    for s, rows in by.items():
        for window in range(len(rows) // size):
            own = rows[window * size : (window + 1) * size]
            x, y, w = xy(own)
            rank = np.stack([[1 + sum(v < u for v in c) + (sum(v == u for v in c) - 1) / 2 for u in c] for c in np.nan_to_num(x).T], 1)
            cluster = plain_ward(np.sqrt(0.5 * (1 - np.corrcoef(rank.T))), 0.5)
            assert cluster == [1, 2, 3, 1]
            for fold in range(folds):
                a = fold * (size // folds)
                te = list(range(a, a + size // folds))
                tr = [j for j in range(size) if (j < a and own[j][2] <= own[a][1]) or j >= a + size // folds + 1]
                score = lambda p, t: np.mean([math.log(min(1 - 1e-9, max(1e-9, q if u else 1 - q))) for q, u in zip(p, t, strict=True)])
                whole = model(x[tr], y[tr], w[tr])
                base = score(whole.probability(x[te]), y[te])

                def moved(ks):
                    z = x[te].copy()
                    for k in ks:
                        z[:, k] = z[ln.permutation(len(te), window, fold, k), k]
                    return base - score(whole.probability(z), y[te])

                for k, f in enumerate(FEATURES):
                    r = got[s, window, fold, f]
                    alone = score(model(x[tr][:, [k]], y[tr], w[tr]).probability(x[te][:, [k]]), y[te])
                    together = moved([j for j in range(4) if cluster[j] == cluster[k]])
                    assert (r.base, r.drop, r.alone, r.cluster_drop, r.gain) == pytest.approx((base, moved([k]), alone, together, whole.gain[k])) and r.cluster == cluster[k]
                    tables[s, f].append((r.gain / sum(got[s, window, fold, g].gain for g in FEATURES), r.drop, r.base, r.alone))
                    n += 1
    assert n == len(got)
    scores = df.sparkSession.createDataFrame(list(got.values()))
    for r in ln.importance(scores).collect():
        gain, drop, base, alone = zip(*tables[r.symbol, r.feature], strict=True)
        used = [g for g in gain if g > 0]
        assert r.mda == pytest.approx(np.mean(drop) / abs(np.mean(base))) and r.sfi == pytest.approx(np.mean(alone)) and (r.mdi == pytest.approx(np.mean(used)) if used else r.mdi is None)
    for r in ln.clustered(scores).collect():
        own = [v for k, v in got.items() if k[0] == r.symbol and k[1] == r.window and v.cluster == r.cluster and v.feature == r.members[0]]
        assert r.mda == pytest.approx(np.mean([v.cluster_drop for v in own]) / abs(np.mean([v.base for v in own]))) and r.each == pytest.approx(r.mda / len(r.members))
    top = {r.symbol: max((x for x in ln.importance(scores).collect() if x.symbol == r.symbol), key=lambda x: x.sfi).feature for r in ln.importance(scores).collect()}
    assert set(top.values()) <= {"a", "d"}


def plain_ward(distance, threshold):
    """By the growth of squared distances to centres, from pairwise distances."""
    own = [[k] for k in range(len(distance))]

    def apart(p, q):
        inside = lambda u: sum(distance[i][j] ** 2 for i in u for j in u) / (2 * len(u))
        return math.sqrt(max(0.0, 2 * (inside(p + q) - inside(p) - inside(q))))

    while len(own) > 1:
        d, i, j = min((apart(own[i], own[j]), i, j) for i in range(len(own)) for j in range(i + 1, len(own)))
        if d > threshold:
            break
        own[i] = own[i] + own.pop(j)
    out = [0] * len(distance)
    for c, u in enumerate(sorted(own, key=min), 1):
        for k in u:
            out[k] = c
    return out


def test_ward_against_definition():
    rng = np.random.default_rng(5)
    for _ in range(60):
        x = rng.normal(size=(7, 2))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        t = float(rng.uniform(0.2, 4))
        assert ln.ward_clusters(d, t) == plain_ward(d, t)
        assert len(set(ln.ward_clusters(d, None, 3))) == 3


def plain_tau(x, y):
    def one(a, b):
        order = sorted(range(len(a)), key=lambda k: (a[k], b[k]), reverse=True)
        rank = {k: r for r, k in enumerate(order)}
        top = wa = wb = 0.0
        for i, j in itertools.combinations(range(len(a)), 2):
            w = 1 / (rank[i] + 1) + 1 / (rank[j] + 1)
            sa, sb = int(a[i] > a[j]) - int(a[i] < a[j]), int(b[i] > b[j]) - int(b[i] < b[j])
            top, wa, wb = top + w * sa * sb, wa + w * sa * sa, wb + w * sb * sb
        return top / math.sqrt(wa * wb)

    return (one(x, y) + one(y, x)) / 2


def test_component_agreement(df):
    rng = np.random.default_rng(6)
    for _ in range(30):
        x, y = rng.integers(0, 5, 8).astype(float), rng.permutation(8).astype(float)
        assert ln.weighted_tau(x, y) == pytest.approx(plain_tau(x, y))
    found = df.sparkSession.createDataFrame([(s, f, m) for s in "xy" for f, m in zip(FEATURES, (0.4, 0.1, None if s == "y" else 0.2, 0.3), strict=True)], "symbol string, feature string, mdi double")
    for largest in (False, True):
        got = {r.symbol: r for r in ln.component_agreement(df, found, FEATURES, 2, largest).collect()}
        for s in "xy":
            rows = [r for r in made() if r[0] == s]
            x = xy(rows)[0]
            use = [0, 1, 2, 3] if s == "x" else [0, 1, 3]
            c = np.ones((4, 4))
            for i, j in itertools.combinations(range(4), 2):
                both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
                c[i, j] = c[j, i] = np.corrcoef(x[both, i], x[both, j])[0, 1]
            vectors = np.linalg.eigh(c[np.ix_(use, use)])[1]
            load = np.abs(vectors[:, -2:] if largest else vectors[:, :2]).sum(1)
            mdi = np.array([0.4, 0.1, 0.2, 0.3])[use]
            assert got[s].features == len(use) and got[s].tau == pytest.approx(plain_tau(mdi, -load))
