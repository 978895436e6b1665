"""Weights of a portfolio at rebalance dates: covariances by running sums on Spark, one small solve a date in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def equal_risk(cov: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Weights of equal risk contributions, by cyclic solution of w_i (cov w)_i = 1 / n, scaled to sum 1."""
    n = len(cov)
    w = 1 / np.sqrt(np.diag(cov))
    for _ in range(rounds):
        before = w.copy()
        for i in range(n):
            rest = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-rest + np.sqrt(rest * rest + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        if np.abs(w - before).max() <= 1e-12 * np.abs(w).max():
            break
    return w / w.sum()


def leaf_order(distance: np.ndarray) -> list[int]:
    """Order of the leaves of a single-linkage tree; a merge joins the two nearest clusters, ties by their first members."""
    clusters = [[i] for i in range(len(distance))]
    while len(clusters) > 1:
        near = min((float(distance[np.ix_(a, b)].min()), x, y) for x, a in enumerate(clusters) for y, b in enumerate(clusters) if x < y)
        _, x, y = near
        clusters[x] = clusters[x] + clusters.pop(y)
    return clusters[0]


def hierarchical_parity(cov: np.ndarray) -> np.ndarray:
    """Weights by halving the leaf order, each half in inverse proportion to its variance under inverse-variance weights."""
    dev = np.sqrt(np.diag(cov))
    corr = np.clip(cov / np.outer(dev, dev), -1, 1)

    def variance(part: list[int]) -> float:
        own = cov[np.ix_(part, part)]
        u = 1 / np.diag(own)
        u /= u.sum()
        return max(1e-12, float(u @ own @ u))

    w, parts = np.ones(len(cov)), [leaf_order(np.sqrt((1 - corr) / 2))]
    while parts:
        part = parts.pop()
        if len(part) < 2:
            continue
        left, right = part[: len(part) // 2], part[len(part) // 2 :]
        a, b = variance(left), variance(right)
        w[left] *= b / (a + b)
        w[right] *= a / (a + b)
        parts += [left, right]
    return w / w.sum()


def solve_weights(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both kinds of weights; series without variance get none, all the same if none varies.

    Covariances over different rows may not form a covariance matrix; too small eigenvalues are then raised.
    """
    dev = np.sqrt(np.maximum(np.diag(cov), 0))
    live = dev > max(dev.max() * 1e-10, 1e-12)
    if not live.any():
        return np.full(len(cov), 1 / len(cov)), np.full(len(cov), 1 / len(cov))
    own = cov[np.ix_(live, live)] + np.eye(live.sum()) * 1e-10
    values, vectors = np.linalg.eigh(own)
    if values[0] < 1e-8 * values[-1]:
        own = vectors @ np.diag(np.maximum(values, 1e-8 * values[-1])) @ vectors.T
    out = np.zeros((2, len(cov)))
    out[:, live] = equal_risk(own), hierarchical_parity(own)
    return out[0], out[1]


def risk_weights(panel: DataFrame, ret: str, every: str, by: str = "symbol") -> DataFrame:
    """ts (start of the period), symbol, n, equal_risk, parity: from the covariance of all common rows up to the end of each period.

    Sums of products per period and pair are one aggregate, running sums over periods the covariance; a date's matrix, as large as
    the number of series squared, is one group. Pairs that have not met yet count as uncorrelated.
    """
    x = panel.where(F.col(ret).isNotNull()).select("ts", F.col(by).alias("i"), F.col(ret).alias("a"))
    y = x.select("ts", F.col("i").alias("j"), F.col("a").alias("b"))
    s = x.join(y, "ts").where("i <= j").groupBy(F.date_trunc(every, "ts").alias("ts"), "i", "j").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("ab"))
    grid = s.select("ts").distinct().join(F.broadcast(s.select("i", "j").distinct()))  # pairs of series, as many as a matrix has cells
    s = grid.join(s, ["ts", "i", "j"], "left")
    run = Window.partitionBy("i", "j").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    s = s.select("ts", "i", "j", *[F.coalesce(F.sum(c).over(run), F.lit(0)).alias(c) for c in ("n", "a", "b", "ab")])
    cov = F.when(F.col("n") > 1, (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / (F.col("n") - 1)).otherwise(0.0)
    s = s.select("ts", "i", "j", "n", cov.alias("cov"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ts, cells in zip(batch.ts, batch.cells, strict=True):
                names = sorted({c["i"] for c in cells} | {c["j"] for c in cells})
                at = {k: p for p, k in enumerate(names)}
                m, n = np.zeros((len(names), len(names))), np.zeros(len(names), np.int64)
                for c in cells:
                    m[at[c["i"]], at[c["j"]]] = m[at[c["j"]], at[c["i"]]] = c["cov"]
                    if c["i"] == c["j"]:
                        n[at[c["i"]]] = c["n"]
                erc, hrp = solve_weights(m)
                yield pd.DataFrame({"ts": ts, by: names, "n": n, "equal_risk": erc, "parity": hrp})

    each = s.groupBy("ts").agg(F.collect_list(F.struct("i", "j", "n", "cov")).alias("cells"))
    return each.mapInPandas(solve, f"ts timestamp, {by} string, n bigint, equal_risk double, parity double")
