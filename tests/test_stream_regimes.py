"""Market states of a stream against those of the whole table, over several batches and after a restart."""

import math
import shutil
import time
from datetime import datetime, timedelta

import numpy as np
import pytest

from lodestream.operators import regimes as rg
from lodestream.streaming import regimes as sr

T0 = datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp, close double"


def rows(n=420):
    out = []
    for k, s in enumerate("ab"):
        rng = np.random.default_rng(k)
        scale = np.where(np.arange(n) // 60 % 2, 0.03, 0.003) * np.where(np.arange(n) > 340, 3, 1)
        close = 100 * np.exp(np.cumsum(rng.normal(0, scale)))
        out += [(s, T0 + timedelta(hours=i), float(close[i])) for i in range(n)]
    return out


def run(spark, source, sink, **more):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = sr.market_states(stream, **more).writeStream.outputMode("append").option("checkpointLocation", str(sink) + "-state").trigger(availableNow=True).format("parquet").start(str(sink))
    q.awaitTermination()
    return spark.read.parquet(str(sink)).collect()


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    yield sr.state_store(spark)
    spark.conf.set(key, old)


def put(spark, source, data, name):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(source / name))


def test_stream_equals_table_over_batches_and_a_restart(store, tmp_path):
    data = rows()
    cuts = [0, 1, 130, 300, 420]
    source = tmp_path / "in"
    for k, (a, b) in enumerate(zip(cuts[:3], cuts[1:4], strict=True)):
        put(store, source, [r for r in data if a <= (r[1] - T0).total_seconds() / 3600 < b], f"b{k}")
    flat = tmp_path / "flat"
    flat.mkdir()

    def move():
        for d in sorted(source.iterdir()):
            for f in d.glob("part-*.parquet"):
                shutil.move(str(f), str(flat / f"{d.name}.parquet"))
                time.sleep(0.02)

    move()
    first = run(store, flat, tmp_path / "out")
    assert len(first) == 600
    # more comes later, with rows that have been seen: the query starts again from its checkpoint
    put(store, source, [r for r in data if (r[1] - T0).total_seconds() / 3600 >= 290], "b9")
    move()
    got = {(r.symbol, r.ts): r for r in run(store, flat, tmp_path / "out")}
    want = rg.market_state(store.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(want) == 840
    for r in want:
        own = got[r.symbol, r.ts]
        assert math.isclose(own.strength, r.strength, abs_tol=1e-9) and (own.structure, own.vol, own.label) == (r.structure, r.vol, r.label)
    assert {r.vol for r in want} == {"low", "normal", "high"} and len({r.structure for r in want}) == 3


def test_a_silent_series_is_forgotten(store, tmp_path):
    data, flat, sink = rows(60), tmp_path / "flat", str(tmp_path / "out")
    put = lambda rows_: store.createDataFrame(rows_, SCHEMA).coalesce(1).write.mode("append").parquet(str(flat))

    def wait(n):
        for _ in range(60):
            time.sleep(0.5)
            if q.exception() or store.read.schema(sr.OUT).parquet(sink).count() >= n:
                break
        assert q.exception() is None and store.read.schema(sr.OUT).parquet(sink).count() == n

    put(data)
    stream = store.readStream.schema(SCHEMA).parquet(str(flat))
    q = sr.market_states(stream, forget=1000).writeStream.outputMode("append").option("checkpointLocation", sink + "-state").trigger(processingTime="300 milliseconds").format("parquet").start(sink)
    try:
        wait(120)
        put([("c", T0, 1.0)])
        time.sleep(6)  # the timers of a and b go off
        # rows of a seen before would be left out if it were still known
        put([r for r in data if r[0] == "a"])
        wait(181)
    finally:
        q.stop()
