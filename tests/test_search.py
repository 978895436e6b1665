"""Pairs, searches, audits and portfolio weights, held against SQL or plain computations."""

import numpy as np
import pytest

import __spark_entry__ as e
from lodestream.operators import portfolio, search
from tests.test_whole import by_sql

EXACT = ["s3_26_legs", "s7_10_pair_ranking", "s8_21_cointegration", "s12_25_hedges", "s13_14_sweep", "s12_22_garch_search", "s14_10_against_source", "s12_17_importance", "s15_6_combinations", "s13_23_cscv"]


@pytest.mark.parametrize("name", EXACT)
def test_sql(spark, sf, name):
    got, want = e.queries()[name](spark, sf), by_sql(sf, name)
    assert got.count() == len(want)
    texts = lambda rows: sorted(tuple(sorted(str(x) for x in r if isinstance(x, str | bool | int))) for r in rows)
    assert texts(map(tuple, got.collect())) == texts(want)


def test_equal_risk_and_parity():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(60, 5))
    cov = np.cov(a @ np.diag([1, 2, 3, 1, 0.5]), rowvar=False)
    w = portfolio.equal_risk(cov)
    part = w * (cov @ w)
    assert np.allclose(part / part.sum(), 0.2, atol=1e-8) and abs(w.sum() - 1) < 1e-12
    h = portfolio.hierarchical_parity(cov)
    assert (h > 0).all() and abs(h.sum() - 1) < 1e-12
    # two series: both are known in closed form
    two = np.array([[4.0, 0.5], [0.5, 1.0]])
    assert np.allclose(portfolio.equal_risk(two), [1 / 3, 2 / 3]) and np.allclose(portfolio.hierarchical_parity(two), [0.2, 0.8])
    dead = np.zeros((3, 3))
    assert np.allclose(portfolio.solve_weights(dead), 1 / 3)
    dead[1, 1] = 2.0
    assert np.allclose(portfolio.solve_weights(dead), [[0, 1, 0], [0, 1, 0]])


def test_weights_by_date(spark):
    rng = np.random.default_rng(5)
    rows = [(s, f"2024-01-{d:02d} {h:02d}:00:00", float(rng.normal() * (k + 1))) for d in range(1, 15) for h in range(24) for k, s in enumerate("ABC") if (d, s) != (3, "C")]
    df = spark.createDataFrame(rows, "symbol string, t string, ret double").selectExpr("symbol", "cast(t as timestamp) ts", "ret")
    got = {(str(r.ts)[:10], r.symbol): r for r in portfolio.risk_weights(df, "ret", "week").collect()}
    assert {k[0] for k in got} == {"2024-01-01", "2024-01-08"}
    cov = np.zeros((3, 3))
    value = {(s, t): x for s, t, x in rows}
    for i, a in enumerate("ABC"):
        for j, b in enumerate("ABC"):
            both = sorted(t for s, t in value if s == a and (b, t) in value)
            x, y = [value[a, t] for t in both], [value[b, t] for t in both]
            cov[i, j] = np.cov(x, y)[0, 1]
    erc, hrp = portfolio.solve_weights(cov)
    for k, s in enumerate("ABC"):
        assert abs(got["2024-01-08", s].equal_risk - erc[k]) < 1e-6 and abs(got["2024-01-08", s].parity - hrp[k]) < 1e-6


def test_gap_position():
    step, s = search.gap_step(2.0, 4.0, False), search.GapState()
    assert step(s, 11, 9, 10.0, 1.0, False, True) == (0, None, None)
    assert step(s, 11, 9, 10.0, 1.0, True, False) == (1, 8.0, 14.0)
    assert step(s, 13, 9, 12.0, 1.0, True, False) == (1, 8.0, 14.0)
    assert step(s, 14, 9, 12.0, 1.0, False, False) == (0, None, None)
