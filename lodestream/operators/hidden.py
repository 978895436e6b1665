"""Hidden Markov regimes of many series: a Gaussian model of hidden states, fitted anew for each window of each series.

A (series, window) is one task's group: the window's rows to learn from and the rows after them to which it is applied, so its size is set
by parameters, and one long series is fitted by many tasks at once. Probabilities are filtered, that is from the rows so far: no row
depends on a later one, neither by its state nor by the model.

Defined results: rows before the first window is full have no state; a window whose rows are fewer than ten a state, or all alike in
each column, gives none either; rows with a null in an observed column are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestream.operators import features as ft
from lodestream.operators.windows import floats, refits

#: Densities are kept above this.
TINY = 1e-300
#: A state's variance is kept above this share of the variance of all rows.
LEAST_VARIANCE = 0.01
#: Where means start: evenly between these quantiles, moved by noise of this share of the deviation.
FIRST, LAST, NOISE = 0.05, 0.95, 0.01
STAY = 0.9


@dataclass(frozen=True)
class Hidden:
    """States in ascending order of the mean of the first column."""

    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    variance: np.ndarray
    likelihoods: tuple[float, ...]


def densities(x: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """Rows by states: the density of independent normal columns."""
    square = ((x[:, None, :] - mean) ** 2 / variance).sum(2)
    return np.maximum(np.exp(-0.5 * (square + np.log(2 * np.pi * variance).sum(1))), TINY)


def forward(b: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the states from the rows so far, and each row's density given the rows before."""
    a, c = np.empty_like(b), np.empty(len(b))
    now = start
    for t in range(len(b)):
        now = now * b[t]
        c[t] = now.sum()
        a[t] = now = now / c[t]
        now = now @ move
    return a, c


def backward(b: np.ndarray, move: np.ndarray, c: np.ndarray) -> np.ndarray:
    """How much likelier the later rows are from each state, in the same scale."""
    out = np.empty_like(b)
    out[-1] = now = np.ones(b.shape[1])
    for t in range(len(b) - 2, -1, -1):
        out[t] = now = move @ (b[t + 1] * now) / c[t + 1]
    return out


def fit(x: np.ndarray, states: int, rounds: int = 60, tolerance: float = 1e-4, seed: int | None = 42) -> Hidden | None:
    """Expectation maximisation from spread-out means, until the log likelihood changes by less than tolerance."""
    if len(x) < 10 * states or not x.shape[1] or not x.var(0).any():
        return None
    rng, whole = np.random.default_rng(seed), x.var(0) + 1e-12
    at = np.linspace(FIRST, LAST, states)
    mean = np.stack([np.quantile(col, at) + rng.normal(0, NOISE * col.std(), states) for col in x.T], 1)
    variance = np.tile(whole, (states, 1))
    move = np.full((states, states), (1 - STAY) / max(1, states - 1)) + np.eye(states) * (STAY - (1 - STAY) / max(1, states - 1))
    move = move / move.sum(1, keepdims=True)
    start, seen = np.full(states, 1 / states), []
    for _ in range(rounds):
        b = densities(x, mean, variance)
        a, c = forward(b, start, move)
        seen.append(float(np.log(c).sum()))
        if len(seen) > 1 and abs(seen[-1] - seen[-2]) < tolerance:
            break
        later = backward(b, move, c)
        share = a * later
        share /= share.sum(1, keepdims=True)
        steps = move * (a[:-1].T @ ((b * later)[1:] / c[1:, None]))
        weight = np.maximum(share.sum(0), TINY)
        start, move = share[0], steps / np.maximum(steps.sum(1, keepdims=True), TINY)
        mean = share.T @ x / weight[:, None]
        variance = np.maximum(np.einsum("ti,tid->id", share, (x[:, None, :] - mean) ** 2) / weight[:, None], whole * LEAST_VARIANCE)
    order = np.argsort(mean[:, 0], kind="stable")
    return Hidden(start[order], move[order][:, order], mean[order], variance[order], tuple(seen))


def filtered(model: Hidden, x: np.ndarray) -> np.ndarray:
    return forward(densities(x, model.mean, model.variance), model.start, model.move)[0]


def observations(bars: DataFrame, n: int = 20) -> DataFrame:
    """symbol, ts, close, ret, size of ret and the deviation of the last n returns; without the first n rows of a series."""
    x = bars.select("symbol", "ts", "close").withColumn("ret", F.coalesce(F.col("close") / F.lag("close").over(ft.series()) - 1, F.lit(0.0)))
    x = x.withColumn("vol", F.when(F.count("ret").over(ft.last_n(n)) >= n // 2, F.stddev_samp("ret").over(ft.last_n(n))))
    return x.withColumns({"abs_ret": F.abs("ret"), "vol": F.coalesce("vol", F.lit(0.0)), "_r": F.row_number().over(ft.series())}).where(F.col("_r") > n).drop("_r")


def regimes(rows: DataFrame, columns: Sequence[str] = ("ret", "abs_ret", "vol"), states: int = 3, train: int = 2000, test: int = 500, calm: str = "vol", rounds: int = 60, by: str = "symbol") -> DataFrame:
    """by, ts, window, state, calm and p0, p1, ... of every row after a series' first `train` rows.

    The state is the likeliest one, states go by the mean of the first column. calm is the probability of the state with the least
    variance in that column. A window's filter begins at its first row to learn from.
    """
    x = refits(rows.dropna(subset=list(columns)).select(by, "ts", *columns), train, test, by, whole=False)
    names = [f"p{k}" for k in range(states)]
    schema = T.StructType([rows.schema[by], rows.schema["ts"], T.StructField("window", T.LongType()), T.StructField("state", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in ("calm", *names)]])
    at = list(columns).index(calm)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_j")
        values, late = np.column_stack([floats(table[c]) for c in columns]), table["_test"].to_numpy()
        model = fit(values[~late], states, rounds)
        own = table.filter(table["_test"])
        if model is None:
            probabilities = np.full((len(own), states), np.nan)
            state = pa.nulls(len(own), pa.int32())
        else:
            probabilities = filtered(model, values)[late]
            state = pa.array(probabilities.argmax(1).astype(np.int32))
        quiet = probabilities[:, int(model.variance[:, at].argmin()) if model else 0]
        columns_ = [own[by], own["ts"], own["window"], state, *[pa.array(p, from_pandas=True) for p in (quiet, *probabilities.T)]]
        return pa.Table.from_arrays(columns_, names=[by, "ts", "window", "state", "calm", *names])

    return x.groupBy(by, "window").applyInArrow(run, schema)


def gate(rows: DataFrame, found: DataFrame, sig: str = "sig", least: float = 0.5, by: str = "symbol") -> DataFrame:
    """Adds calm and gated: the signal where the calm state is likely enough, else 0; rows without a state are not calm."""
    x = rows.join(found.select(by, "ts", "calm"), [by, "ts"], "left")
    return x.withColumn("gated", F.when(F.coalesce(F.col("calm") >= least, F.lit(False)), F.col(sig)).otherwise(0.0))


def stays(found: DataFrame, by: str = "symbol") -> DataFrame:
    """Rows, share and mean length of stays of each state in a series."""
    w = Window.partitionBy(by).orderBy("ts")
    x = found.where("state is not null").withColumn("_new", (F.coalesce(F.lag("state").over(w), F.lit(-1)) != F.col("state")).cast("int"))
    g = x.groupBy(by, "state").agg(F.count(F.lit(1)).alias("n"), F.sum("_new").alias("stays"), F.avg("calm").alias("calm"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by))).withColumn("mean_stay", F.col("n") / F.nullif("stays", F.lit(0)))
