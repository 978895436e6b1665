"""Market states of a stream of closed bars, one bar at a time, with typed state per series.

The state of a series is a list of its last closes, a value with the running averages, and a timer that forgets a series from which
nothing has come for a while; Spark keeps both in its state store and restores them from the checkpoint. The rules are those of
operators.regimes.market_state on whole tables, so a stream gives the rows that the table gives.
"""

from __future__ import annotations

import math
from bisect import bisect_right, insort
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestream.operators.regimes import TREND_THRESHOLD
from lodestream.session import settle
from lodestream.streaming.streams import run_to_table

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "symbol string, ts timestamp, strength double, structure string, vol string, label string"


def state_store(spark: SparkSession) -> SparkSession:
    """Sets the state store that list states and timers need, for streams started from now on; changes the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


class MarketState(StatefulProcessor):
    """Structure and volatility regime after each bar; bars of a series come in order of time, by batch and inside it.

    fast, slow, threshold: as operators.regimes.market_structure; n, look, low, high: as operators.features.volatility_regime. A bar that is not
    later than the last one of its series is left out. A series is forgotten `forget` milliseconds of processing time after its last bar.
    """

    def __init__(self, fast: int = 9, slow: int = 50, threshold: float = TREND_THRESHOLD, n: int = 60, look: int = 500, low: float = 0.2, high: float = 0.8, forget: int | None = None):
        self.fast, self.slow, self.threshold, self.n, self.look, self.low, self.high, self.forget = fast, slow, threshold, n, look, low, high, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closes = handle.getListState("closes", "close double")
        self.deviations = handle.getListState("deviations", "rv double")
        self.averages = handle.getValueState("averages", "fast double, slow double, last_us bigint, bars bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (names of the interface)
        bars = pd.concat(list(rows)).sort_values("ts")
        closes = [r[0] for r in self.closes.get()] if self.closes.exists() else []
        deviations = [r[0] for r in self.deviations.get()] if self.deviations.exists() else []
        fast, slow, last, count = self.averages.get() if self.averages.exists() else (None, None, -(1 << 62), 0)
        held = sorted(v for v in deviations if v == v)
        out = []
        for ts, close in zip(bars["ts"], bars["close"], strict=True):
            if (now := int(pd.Timestamp(ts).value // 1000)) <= last:
                continue
            last, count = now, count + 1
            closes.append(float(close))
            fast, slow = (close, close) if fast is None else (fast + 2 / (self.fast + 1) * (close - fast), slow + 2 / (self.slow + 1) * (close - slow))
            deviation = float(np.std(closes[-self.slow :], ddof=1)) if count >= self.slow else 0.0
            strength = min(1.0, abs(fast - slow) / deviation) if deviation > 0 else 0.0
            structure = "range" if strength < self.threshold else "trend_up" if fast > slow else "trend_down"
            recent = closes[-self.n - 1 :]
            logs = [math.log(b / a) for a, b in zip(recent, recent[1:], strict=False)]
            rv = float(np.std(logs, ddof=1)) if len(logs) >= max(2, self.n // 2) else math.nan
            deviations.append(rv)
            if len(deviations) > self.look and (gone := deviations.pop(0)) == gone:
                held.remove(gone)
            if rv == rv:
                insort(held, rv)
            vol = "normal"
            if len(held) >= self.look // 2:
                rank = bisect_right(held, rv) / len(deviations) if rv == rv else 0.0
                vol = "high" if rank > self.high else "low" if rank < self.low else "normal"
            del closes[: -max(self.slow, self.n + 1)]
            out.append((key[0], ts, strength, structure, vol, f"{structure}|{vol}"))
        if out:
            self.closes.put([(c,) for c in closes])
            self.deviations.put([(v,) for v in deviations])
            self.averages.update((float(fast), float(slow), last, count))
            if self.forget:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget)
            yield pd.DataFrame(out, columns=["symbol", "ts", "strength", "structure", "vol", "label"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.closes, self.deviations, self.averages):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def market_states(bars: DataFrame, **more) -> DataFrame:
    """symbol, ts, strength, structure, vol and label for a stream of bars (symbol, ts, close); the session needs state_store()."""
    processor = MarketState(**more)
    mode = "ProcessingTime" if processor.forget else "None"
    return bars.select("symbol", "ts", "close").groupBy("symbol").transformWithStateInPandas(processor, OUT, "Append", mode)


def run_over(bars: DataFrame, name: str, **more) -> DataFrame:
    """Market states of a table of bars, read as a stream into a table of the shared folder; the session's state store is set for that time only."""
    spark = bars.sparkSession
    source = settle(bars.select("symbol", "ts", "close"), f"{name}-bars").inputFiles()[0].rpartition("/")[0]
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    try:
        stream = state_store(spark).readStream.schema("symbol string, ts timestamp, close double").parquet(source)
        return run_to_table(market_states(stream, **more), name)
    finally:
        spark.conf.set(key, old)
