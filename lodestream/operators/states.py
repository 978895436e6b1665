"""Sequential recurrences with resets: parallel over keys, in order inside one.

The rows of a key are streamed to the task in sorted order, and only the state is kept, so a long series needs no memory of
its own size.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keyed_scan(rows: DataFrame, key: str, order: Sequence[str], cols: Sequence[str], start: Callable[[], object], step: Callable, out: Sequence[tuple[str, str]], emit_ts: bool = True, before: DataFrame | None = None) -> DataFrame:
    """Run step(state, row values) -> output tuple or None over each key's rows in order.

    Output: key, the first order column and the columns of out, for each row whose output is not None. With before (key, _state: a row a
    key, from an earlier call) keys go on from those states, and each key's last state follows as a row with _state and NULLs elsewhere.
    """
    order_type = rows.schema[order[0]].dataType
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField(order[0], order_type)])
    sql = {"double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType()}
    for n, t in out:
        schema = schema.add(n, sql[t])
    arrow = {"double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    kinds = [arrow[t] for _, t in out]
    keeps = before is not None
    names = [key, order[0], *[n for n, _ in out], *["_state"] * keeps]
    schema = schema.add("_state", T.BinaryType()) if keeps else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        kept = pa.schema([])

        def last(ended: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([k for k, _ in ended], kept.field(0).type), *[pa.nulls(len(ended), t) for t in (kept.field(1).type, *kinds)], pa.array([pickle.dumps(s.__dict__) for _, s in ended], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            kept = batch.schema
            keys, times = batch.column(0).to_pylist(), batch.column(1)
            values = [batch.column(2 + k).to_pylist() for k in range(len(cols))]
            earlier = batch.column(2 + len(cols)).to_pylist() if keeps else None
            at, results, ended = [], [], []
            for i, k in enumerate(keys):
                if state is None or k != now:
                    if state is not None and keeps:
                        ended.append((now, state))
                    now, state = k, start()
                if keeps and earlier[i] is not None:
                    state.__dict__.update(pickle.loads(earlier[i]))
                    continue
                got = step(state, *[c[i] for c in values])
                if got is not None:
                    at.append(i)
                    results.append(got)
            index = pa.array(at, pa.int64())
            columns = list(zip(*results, strict=True)) if results else [()] * len(out)
            more = [pa.nulls(len(at), pa.binary())] if keeps else []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), times.take(index), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], *more], names)
            if ended:
                yield last(ended)
        if keeps and state is not None:
            yield last([(now, state)])

    wanted = rows.select(key, order[0], *cols, *[F.lit(None).cast("binary").alias("_state")] * keeps, *[F.col(o).alias(f"_o{j}") for j, o in enumerate(order[1:])])
    first = []
    if keeps:
        wanted = wanted.unionByName(before.select(key, "_state"), allowMissingColumns=True)
        first = [F.col("_state").isNull()]  # a key's state comes before its rows
    dealt = wanted.repartition(key).sortWithinPartitions(key, *first, order[0], *[f"_o{j}" for j in range(len(order) - 1)])
    return dealt.mapInArrow(run, schema)


class CusumState:
    def __init__(self) -> None:
        self.up = self.down = 0.0
        self.last: float | None = None


def cusum_events(rows: DataFrame, value: str, limit: float, key: str = "symbol", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Rows at which the sum of log returns, kept from below or above zero, passes limit: side 1 or -1. Both sums start again then."""

    def step(s: CusumState, x: float):
        if s.last is None or not x or x <= 0 or s.last <= 0:
            s.last = x
            return None
        r = math.log(x / s.last)
        s.last = x
        s.up, s.down = max(0.0, s.up + r), min(0.0, s.down + r)
        side = 1 if s.up > limit else -1 if s.down < -limit else 0
        if not side:
            return None
        s.up = s.down = 0.0
        return (side,)

    return keyed_scan(rows, key, order, [value], CusumState, step, [("side", "int")])


class DwellState:
    def __init__(self) -> None:
        self.label: str | None = None
        self.next: str | None = None
        self.count = 0


def dwell(rows: DataFrame, label: str, least: int, key: str = "symbol", order: Sequence[str] = ("ts",)) -> DataFrame:
    """A label changes only after the new one has stood for least rows in a row."""

    def step(s: DwellState, x: str | None):
        if s.label is None:
            s.label = x
        if x is None or x == s.label:
            s.next, s.count = None, 0
        else:
            s.count = s.count + 1 if x == s.next else 1
            s.next = x
            if s.count >= least:
                s.label, s.next, s.count = x, None, 0
        return (s.label,)

    return keyed_scan(rows, key, order, [label], DwellState, step, [("stable", "string")])


def imbalance_machine(dollars: bool = False, runs: bool = False, length: float = 1000.0, span: int = 100) -> tuple[Callable[[], object], Callable]:
    """Start and step of adaptive bars; a step takes price and amount."""
    keep, tiny = 1 - 2 / (span + 1), 1e-6 if dollars else 0.0

    class State:
        def __init__(self) -> None:
            self.expected, self.i, self.last_cut, self.bar = length, 0, 0, 0
            self.buy = self.sell = self.theta_buy = self.theta_sell = self.weight = 0.0
            self.price: float | None = None
            self.b = 1

    def step(s: State, price: float, amount: float):
        if s.price is not None and price != s.price:
            s.b = 1 if price > s.price else -1
        s.price = price
        size = price * amount if dollars else 1.0
        buy, sell = (size, 0.0) if s.b > 0 else (0.0, size)
        s.buy, s.sell, s.weight = s.buy * keep + buy, s.sell * keep + sell, s.weight * keep + 1
        s.i += 1
        if s.i == 1:
            return None
        s.theta_buy += buy
        s.theta_sell += sell
        mean_buy, mean_sell = s.buy / s.weight, s.sell / s.weight
        if runs:
            have, mean = max(s.theta_buy, s.theta_sell), max(mean_buy, mean_sell, tiny if dollars else 0.5)
        else:
            have, mean = abs(s.theta_buy - s.theta_sell), max(abs(mean_buy - mean_sell), tiny)
        if have < s.expected * mean:
            return None
        n = s.i - 1 - s.last_cut
        s.expected = (s.expected * span + n) / (span + 1)
        got = (s.bar, n)
        s.last_cut, s.bar, s.theta_buy, s.theta_sell = s.i - 1, s.bar + 1, 0.0, 0.0
        return got

    return State, step


def imbalance_cuts(ticks: DataFrame, dollars: bool = False, runs: bool = False, length: float = 1000.0, span: int = 100, key: str = "symbol") -> DataFrame:
    """End ticks of adaptive bars: symbol, ts, bar, ticks (since the end before).

    A tick's sign b follows the tick rule. Imbalance bars add up b (or b times price times amount) and end where the sum's size reaches
    the expected length times the size of the exponential mean of the same; run bars add up both sides and end where the larger
    reaches the expected length times the larger mean (of ticks: the larger share, at least a half). The mean runs over all ticks,
    weights (1 - 2 / (span + 1)) ** age; the expected length moves by 1 / (span + 1) to each finished bar's. The first tick starts
    the mean and belongs to no sum.
    """
    start, step = imbalance_machine(dollars, runs, length, span)
    return keyed_scan(ticks, key, ("ts", "trade_id"), ["price", "amount"], start, step, [("bar", "int"), ("ticks", "int")])


class TrendState:
    def __init__(self) -> None:
        self.up = self.down = self.close = None
        self.side = 1


def supertrend(bars: DataFrame, atr: str = "atr", k: float = 3.0, key: str = "symbol") -> DataFrame:
    """Ratcheting bands around the mid price: line and side, which flips when the close crosses the band."""

    def step(s: TrendState, high: float, low: float, close: float, a: float | None):
        if a is None:
            return (None, 0)
        mid = (high + low) / 2
        up, down = mid + k * a, mid - k * a
        if s.up is not None:
            up = up if up < s.up or s.close > s.up else s.up
            down = down if down > s.down or s.close < s.down else s.down
            if s.side > 0 and close < down:
                s.side = -1
            elif s.side < 0 and close > up:
                s.side = 1
        s.up, s.down, s.close = up, down, close
        return (down if s.side > 0 else up, s.side)

    return keyed_scan(bars, key, ("ts",), ["high", "low", "close", atr], TrendState, step, [("line", "double"), ("side", "int")])


class KalmanState:
    def __init__(self) -> None:
        self.beta, self.p = 0.0, 1.0


def kalman_hedge(pairs: DataFrame, q: float = 1e-5, r: float = 1e-2, key: str = "pair") -> DataFrame:
    """Hedge ratio of y on x by a one-state Kalman filter; the prediction error uses the ratio before the row."""

    def step(s: KalmanState, y: float, x: float):
        p = s.p + q
        e = y - s.beta * x
        g = p * x / (x * x * p + r)
        s.beta, s.p = s.beta + g * e, (1 - g * x) * p
        return (s.beta, e)

    return keyed_scan(pairs, key, ("ts",), ["y", "x"], KalmanState, step, [("beta", "double"), ("error", "double")])


def level_step(q: float, r: float) -> Callable:
    """Step of a Kalman filter of a random walk (variance q) seen with noise (variance r); starts at 0 with variance 1."""

    def step(s: KalmanState, z: float):
        p = s.p + q
        g = p / (p + r)
        s.beta, s.p = s.beta + g * (z - s.beta), (1 - g) * p
        return (s.beta,)

    return step


def kalman_level(rows: DataFrame, value: str, q: float, r: float, key: str = "symbol") -> DataFrame:
    """Level of each series by level_step."""
    return keyed_scan(rows, key, ("ts",), [value], KalmanState, level_step(q, r), [("level", "double")])


class HedgeState:
    def __init__(self) -> None:
        self.last: float | None = None
        self.side = 0
        self.follow = self.revert = 0.0


#: The largest exponent that is passed to exp: 1 / (1 + exp(700)) is 0 to 300 places, and exp(710) is no double.
_MOST = 700.0


def hedge_step(eta: float) -> Callable:
    """Weight of an expert that follows the last price change against one that goes the other way: exp(-eta * losses so far), normalised.

    A loss is a change against the expert's side; the weight that is given was known before the tick.
    """

    def step(s: HedgeState, price: float):
        weight = 1 / (1 + math.exp(min(-eta * (s.revert - s.follow), _MOST)))
        if s.last is not None:
            side = (price > s.last) - (price < s.last)
            s.follow += side * s.side < 0
            s.revert += side * s.side > 0
            s.side = side or s.side
        s.last = price
        return (weight,)

    return step


class OverlayState:
    def __init__(self) -> None:
        self.pos, self.held, self.today, self.day = 0.0, 0, 0, None


def overlay(rows: DataFrame, want: str, least_hold: int, most_a_day: int, key: str = "symbol") -> DataFrame:
    """A wanted position under rules: no turn before least_hold bars (flat is always allowed), at most so many entries a UTC day."""

    def step(s: OverlayState, target: float, day: int):
        if day != s.day:
            s.day, s.today = day, 0
        turn = target != 0 and s.pos != 0 and (target > 0) != (s.pos > 0)
        if s.pos != 0 and s.held < least_hold:
            if target == 0:
                s.pos, s.held = 0.0, 0
            else:
                s.pos, s.held = s.pos if turn else target, s.held + 1
            return (s.pos,)
        opens = turn or (s.pos == 0 and target != 0)
        if opens and s.today >= most_a_day:
            s.held += s.pos != 0
        elif opens:
            s.pos, s.held, s.today = target, 1, s.today + 1
        elif target == 0:
            s.pos, s.held = 0.0, 0
        else:
            s.pos, s.held = target, s.held + 1
        return (s.pos,)

    return keyed_scan(rows.withColumn("_day", F.unix_date(F.to_date("ts"))), key, ("ts",), [want, "_day"], OverlayState, step, [("pos", "double")])
