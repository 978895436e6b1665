"""Sparse mean-reverting baskets: weights by window from past rows alone, the basket's spread, its mean reversion, and a position with hysteresis.

Many baskets at once: a basket is a key with a fixed list of members. Rows at which all members have a price become one row with the list of
log prices, so what a task holds is a window's rows times the members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.operators import features as ft
from lodestream.operators.states import keyed_scan
from lodestream.operators.windows import refits

#: Added to the covariances' diagonals.
RIDGE = 1e-6
LEAST_ROWS = 30


def weights(p: np.ndarray, most: int, penalty: float) -> np.ndarray:
    """Of log prices (rows by members): the direction in which levels vary least against their changes, its parts moved towards 0 by the penalty,
    the `most` largest kept, sizes summing to 1.

    The direction has unit variance of changes; its sign is such that its largest part is positive. With too few rows all weigh alike; if nothing
    is left the first two weigh a half and minus a half.
    """
    n = p.shape[1]
    if n < 2 or len(p) < LEAST_ROWS:
        return np.full(n, 1 / max(n, 1))
    level = np.cov(p, rowvar=False) + RIDGE * np.eye(n)
    change = np.cov(np.diff(p, axis=0), rowvar=False) + RIDGE * np.eye(n)
    low = np.linalg.inv(np.linalg.cholesky(change))
    w = low.T @ np.linalg.eigh(low @ level @ low.T)[1][:, 0]
    w = w * np.sign(w[np.abs(w).argmax()])
    w = np.sign(w) * np.maximum(np.abs(w) - penalty, 0)
    if np.count_nonzero(w) > most:
        w[np.argsort(-np.abs(w), kind="stable")[most:]] = 0
    if (size := np.abs(w).sum()) > 1e-12:
        return w / size
    out = np.zeros(n)
    out[:2] = 0.5, -0.5
    return out


def reversion(s: np.ndarray) -> tuple[float, float, float, float | None]:
    """theta, mu, sigma and half-life of an Ornstein-Uhlenbeck process from a first-order regression; theta 0 and no half-life where it does not revert."""
    if len(s) < LEAST_ROWS:
        return 0.0, 0.0, 0.0, None
    x, y = s[:-1], s[1:]
    spread = float(((x - x.mean()) ** 2).sum())
    a = float(((x - x.mean()) * (y - y.mean())).sum()) / spread if spread > 0 else 1.0
    if not 0 < a < 1:
        return 0.0, float(s.mean()), float(s.std()), None
    b = float(y.mean() - a * x.mean())
    theta = -float(np.log(a))
    sigma = float(np.std(y - a * x - b) * np.sqrt(2 * theta / max(1 - a * a, 1e-6)))
    return theta, b / (1 - a), sigma, float(np.log(2) / max(theta, 1e-6))


def panels(bars: DataFrame, members: DataFrame, by: str = "symbol") -> DataFrame:
    """basket, ts, members (their names in order) and p (log prices) at the times at which all members of the basket have a price above 0; members: basket, symbol."""
    size = members.groupBy("basket").agg(F.count(F.lit(1)).alias("_n"))
    x = bars.where("close > 0").select(by, "ts", F.ln("close").alias("_p")).join(members.withColumnRenamed("symbol", by), by)
    g = x.groupBy("basket", "ts").agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("s"), F.col("_p").alias("p")))).alias("_m"))
    return g.join(size, "basket").where(F.size("_m") == F.col("_n")).select("basket", "ts", F.col("_m.s").alias("members"), F.col("_m.p").alias("p"))


def spreads(panel: DataFrame, look: int = 60, most: int = 3, penalty: float = 0.05) -> DataFrame:
    """basket, ts, window, weights, spread and theta, mu, sigma, half_life of the window's spread over its training rows.

    Weights come from the 2 * look rows before a window and are used for look / 2 rows, so no spread knows its own or a later price.
    """
    x = refits(panel.select("basket", "ts", "p"), 2 * look, max(look // 2, 1), "basket", whole=False)
    names = ["theta", "mu", "sigma", "half_life"]
    schema = T.StructType([panel.schema["basket"], panel.schema["ts"], T.StructField("window", T.LongType()), T.StructField("weights", T.ArrayType(T.DoubleType())), *[T.StructField(n, T.DoubleType()) for n in ("spread", *names)]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_j")
        p, late = np.array(table["p"].to_pylist()), table["_test"].to_numpy()
        w = weights(p[~late], most, penalty)
        own = table.filter(table["_test"])
        constant = [pa.array([v] * len(own), pa.float64()) for v in reversion(p[~late] @ w)]
        return pa.Table.from_arrays([own["basket"], own["ts"], own["window"], pa.array([w.tolist()] * len(own), pa.list_(pa.float64())), pa.array(p[late] @ w), *constant], names=[f.name for f in schema.fields])

    return x.groupBy("basket", "window").applyInArrow(run, schema)


class _Held:
    def __init__(self) -> None:
        self.side = 0


def positions(found: DataFrame, look: int = 60, least: int = 20, enter: float = 2.0, leave: float = 0.2) -> DataFrame:
    """basket, ts, z, pos: 1 from a rolling z of -enter on until it is at least -leave, -1 in the mirror case; z is 0 with fewer than `least` rows."""
    last = ft.last_n(look, "basket")
    z = (F.col("spread") - F.avg("spread").over(last)) / F.nullif(F.stddev_samp("spread").over(last), F.lit(0.0))
    x = found.withColumn("z", F.when(F.count("spread").over(last) >= least, F.coalesce(z, F.lit(0.0))).otherwise(0.0))

    def step(s: _Held, v: float):
        if s.side == 0:
            s.side = 1 if v <= -enter else -1 if v >= enter else 0
        elif (s.side == 1 and v >= -leave) or (s.side == -1 and v <= leave):
            s.side = 0
        return v, s.side

    return keyed_scan(x, "basket", ("ts",), ["z"], _Held, step, [("z", "double"), ("pos", "int")])
