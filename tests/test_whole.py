"""Queries over whole tables, held against their SQL or plain loops."""

import math
from datetime import UTC
from itertools import combinations

import duckdb
import pytest

import __spark_entry__ as e
from lodestream import views
from lodestream.operators import states


def same(got, want):
    key = lambda r: tuple(str(x) for x in r if not isinstance(x, float))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-4)) for x, y in zip(a, b, strict=True)), (a, b)


def by_sql(sf, name):
    """Rows of a query's SQL, which filters no ids."""
    sql = e.oracle_sql()[name]
    assert " % 10 = 0" not in sql and " % 5 = 0" not in sql and " % 4 = 0" not in sql
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("events", "lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(sql).fetchall()


@pytest.mark.parametrize("name", ["s5_34_fifo", "s3_14_trade_range", "s3_29_cluster_room", "s6_38_hawkes"])
def test_whole_tables(spark, sf, name):
    same(e.queries()[name](spark, sf).collect(), by_sql(sf, name))


def test_kalman_hedge_of_all_pairs(spark, sf):
    close = {}
    for r in views.bars(spark, sf).collect():
        close.setdefault(r.symbol, {})[int(r.ts.replace(tzinfo=UTC).timestamp())] = r.close
    want = []
    for a, b in combinations(sorted(close), 2):
        beta, p = 0.0, states.KalmanState().p
        for ts in sorted(close[a].keys() & close[b].keys()):
            y, x = math.log(close[a][ts]), math.log(close[b][ts])
            p += 1e-5
            e_, g = y - beta * x, p * x / (x * x * p + 1e-2)
            beta, p = beta + g * e_, (1 - g * x) * p
            want.append((f"{a}-{b}", ts, beta, e_))
    got = e.queries()["s12_23_kalman_hedge"](spark, sf).collect()
    assert len({r.pair for r in got}) == 28
    same(got, want)


def test_entry_features_of_every_trade(spark, sf):
    bars = {(r.symbol, r.ts): (r.close, r.volume) for r in views.bars(spark, sf).collect()}
    want = []
    for r in views.closed_trades(spark, sf).collect():
        ts = r.entry_ts.replace(year=r.entry_ts.year + 25, day=min(r.entry_ts.day, 28) if r.entry_ts.month == 2 else r.entry_ts.day)
        want.append((r.symbol, r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_quantity, r.l_extendedprice, ts.replace(tzinfo=UTC).timestamp(), *bars.get((r.symbol, ts), (None, None))))
    got = e.queries()["s3_16_entry_features"](spark, sf).collect()
    key = lambda r: tuple(map(str, r[:8]))
    got = sorted(((r.symbol, r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_quantity, r.l_extendedprice, float(r.ts), r.entry_close, r.entry_volume) for r in got), key=key)
    assert len(got) == len(want) and got[0][0] == "S0" and any(r[8] is not None for r in got)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:8] == b[:8] and (a[8] is None) == (b[8] is None) and (b[8] is None or (abs(a[8] - b[8]) < 1e-6 and a[9] == b[9])), (a, b)
