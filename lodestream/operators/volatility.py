"""Exponential GARCH of many series, fitted anew by window: a recurrence that is not linear, so a window runs row by row, all parameters at once."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestream.operators.windows import floats, refits

#: Mean size of a standard normal variable.
MEAN_SIZE = math.sqrt(2 / math.pi)
#: Bounds: of log variances, and of what a return is divided by.
FAR, LEAST_DEVIATION = 50.0, 1e-8
ALPHAS, BETAS, GAMMAS = (0.02, 0.1, 0.25, 0.5), (0.3, 0.6, 0.8, 0.9, 0.97), (-0.3, -0.1, 0.0, 0.1, 0.3)
REFINED = 14


def log_variances(r: np.ndarray, first: float, omega: np.ndarray, alpha: np.ndarray, beta: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Rows by parameters: omega + beta * before + alpha * (|z| - its mean) + gamma * z, z the return before over its deviation."""
    out = np.empty((len(r) + 1, len(omega)))
    out[0] = first
    for t, x in enumerate(r.tolist()):
        z = x / np.maximum(np.exp(0.5 * out[t]), LEAST_DEVIATION)
        out[t + 1] = np.clip(omega + beta * out[t] + alpha * (np.abs(z) - MEAN_SIZE) + gamma * z, -FAR, FAR)
    return out


def likelihood(r: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Normal log likelihood of each parameter's column, without its constant."""
    return -0.5 * (h + (r * r)[:, None] / np.maximum(np.exp(h), 1e-12)).sum(0)


def fit(r: np.ndarray, alphas: Sequence[float] = ALPHAS, betas: Sequence[float] = BETAS, gammas: Sequence[float] = GAMMAS, refined: int = REFINED) -> tuple[float, float, float, float, float]:
    """omega, alpha, beta, gamma, likelihood: the likeliest of a grid whose long-run variance is the rows', then of steps around the best so far, in
    the long-run variance too, halved whenever none is better.

    Ties go to the first of the grid. Rows that are all alike, or fewer than 30, have alpha 0 and keep their variance.
    """
    var = float(np.var(r)) if len(r) else 0.0
    if len(r) < 30 or var <= 0:
        return 0.0, 0.0, 1.0, 0.0, float("nan")
    long = math.log(var)
    grid = np.array([(long, *p) for p in itertools.product(alphas, betas, gammas)])
    step, best = np.array([0.4, 0.08, 0.08, 0.08]), None
    around = np.array(list(itertools.product((-1, 0, 1), repeat=4)))
    for _ in range(refined + 1):
        m, alpha, beta, gamma = grid.T
        ll = likelihood(r, log_variances(r[:-1], long, m * (1 - beta), alpha, beta, gamma))
        at = int(np.argmax(np.where(np.isfinite(ll), ll, -np.inf)))
        if best is None or ll[at] > best[4]:
            best = (*grid[at].tolist(), float(ll[at]))
        else:
            step = step / 2
        grid = np.clip(around * step + np.array(best[:4]), (-FAR, 0, 0, -1), (FAR, 1, 0.999, 1))
    m, alpha, beta, gamma, ll = best
    return m * (1 - beta), alpha, beta, gamma, ll


def exponential_garch(rows: DataFrame, ret: str, train: int = 500, test: int = 100, by: str = "symbol") -> DataFrame:
    """by, ts, window, omega, alpha, beta, gamma, ll, vol: the deviation forecast for the row after each row, with parameters of its window.

    A window's recurrence starts at its first training row, at the training rows' variance; it goes on over the rows that it forecasts, each
    from returns up to that row. Rows without a return are left out.
    """
    x = refits(rows.select(by, "ts", ret).dropna(subset=[ret]), train, test, by, whole=False)
    names = ["omega", "alpha", "beta", "gamma", "ll", "vol"]
    schema = T.StructType([rows.schema[by], rows.schema["ts"], T.StructField("window", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_j")
        r, late = floats(table[ret]), table["_test"].to_numpy()
        found = fit(r[~late])
        first = math.log(v) if (v := float(np.var(r[~late]))) > 0 else -FAR
        h = log_variances(r, first, *[np.array([p]) for p in found[:4]])[1:, 0]
        own = table.filter(table["_test"])
        values = [*[np.full(len(own), p) for p in found], np.exp(0.5 * h[late])]
        return pa.Table.from_arrays([own[by], own["ts"], own["window"], *[pa.array(v, from_pandas=True) for v in values]], names=[by, "ts", "window", *names])

    return x.groupBy(by, "window").applyInArrow(run, schema)
