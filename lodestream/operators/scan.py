"""Recurrences y[t] = a * y[t-1] + b[t] along a series, with built-in functions.

Two levels: inside chunks of consecutive rows the recurrence is a running product and a running sum; one row a chunk then
carries its end value on. A chunk multiplies what comes in by a ** length, so the chunks before that still matter are few, and
are folded in order. Rows are numbered inside time spans, and spans by one row each, so no task holds a whole series. All
recurrences of a call share the numbering, one sort, one aggregate and one join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A chunk's product of factors stays above this, so that dividing by it loses no digits that matter.
LEAST_PRODUCT = 1e-6
#: What earlier chunks still weigh when they are left out.
NEGLIGIBLE = 1e-18
LONGEST_CHUNK = 4096


def numbered(rows: DataFrame, order: Sequence[str], by: str = "symbol", name: str = "_i", span: str = "30 days") -> DataFrame:
    """Adds the row's number from 0 along its series; order starts with a timestamp."""
    x = rows.withColumn("_span", F.window(order[0], span)["start"])
    counts = x.groupBy(by, "_span").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(by, "_span").orderBy(*order)) - 1
    return x.withColumn(name, inside).join(counts, [by, "_span"]).withColumn(name, F.col(name) + F.col("_before")).drop("_span", "_before")


def _fold(factor: float) -> Callable[[Column, Column], Column]:
    return lambda acc, end: acc * factor + end


def scans(rows: DataFrame, specs: Mapping[str, tuple[float, Column, Column | None]], order: Sequence[str] = ("ts",), by: str = "symbol") -> DataFrame:
    """Adds, for each name: (factor, add, first), a column y with y = factor * y_before + add; the first row has y = first (add if None).

    Factors are constants with 0 <= factor < 1.
    """
    if any(not 0 <= f < 1 for f, _, _ in specs.values()):
        raise ValueError("factors have to be in [0, 1)")
    live = {k: v for k, v in specs.items() if v[0] > 0}
    factors = [f for f, _, _ in live.values()]
    length = min([LONGEST_CHUNK, *[max(1, int(math.log(LEAST_PRODUCT) / math.log(f))) for f in factors]])
    x = numbered(rows, order, by)
    begin = F.col("_i") == 0
    x = x.withColumns({f"_b_{k}": F.when(begin, first).otherwise(add) if first is not None else add for k, (_, add, first) in specs.items()})
    x = x.withColumn("_c", F.floor(F.col("_i") / length)).withColumn("_j", F.col("_i") % length + 1)
    inside = Window.partitionBy(by, "_c").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    power = lambda f: F.pow(F.lit(f), F.col("_j"))
    # z is the chunk's own part: sum of b[j] * factor ** (i - j)
    x = x.withColumns({f"_z_{k}": F.sum(F.col(f"_b_{k}") / power(f)).over(inside) * power(f) for k, (f, _, _) in live.items()})
    ends = x.groupBy(by, "_c").agg(*[F.max_by(f"_z_{k}", "_i").alias(f"_e_{k}") for k in live]) if live else None
    if ends is not None:
        chunks, carries = Window.partitionBy(by).orderBy("_c"), {}
        for k, (f, _, _) in live.items():
            whole = f**length
            back = max(1, math.ceil(math.log(NEGLIGIBLE) / math.log(whole)))
            earlier = F.collect_list(f"_e_{k}").over(chunks.rowsBetween(-back, -1))
            carries[f"_carry_{k}"] = F.aggregate(earlier, F.lit(0.0), _fold(whole))
        x = x.join(ends.withColumns(carries).select(by, "_c", *carries), [by, "_c"])
    x = x.withColumns({k: F.col(f"_z_{k}") + power(f) * F.col(f"_carry_{k}") if f > 0 else F.col(f"_b_{k}") for k, (f, _, _) in specs.items()})
    return x.drop("_i", "_c", "_j", *[f"_{part}_{k}" for k in specs for part in ("b", "z", "carry")])


def affine_scans(rows: DataFrame, factor: float, adds: Mapping[str, tuple[Column, Column | None]], order: Sequence[str], by: str = "symbol") -> DataFrame:
    """scans of one factor."""
    return scans(rows, {k: (factor, add, first) for k, (add, first) in adds.items()}, order, by)


def affine_scan(rows: DataFrame, factor: float, add: Column, order: Sequence[str], by: str = "symbol", name: str = "y", first: Column | None = None) -> DataFrame:
    """One column of affine_scans."""
    return affine_scans(rows, factor, {name: (add, first)}, order, by)


def ema_spec(value: str, span: int) -> tuple[float, Column, Column]:
    """Exponential mean with alpha = 2 / (span + 1), started at the first value, for scans."""
    alpha = 2 / (span + 1)
    return 1 - alpha, alpha * F.col(value), F.col(value)


def ema(rows: DataFrame, value: str, *spans: int, order: Sequence[str] = ("ts",), by: str = "symbol", name: str | None = None) -> DataFrame:
    """Adds ema_<span> (or name) for each span."""
    return scans(rows, {name or f"ema_{n}": ema_spec(value, n) for n in spans}, order, by)


def wilders(rows: DataFrame, values: Mapping[str, Column], n: int, order: Sequence[str] = ("ts",), by: str = "symbol", more: Mapping[str, tuple[float, Column, Column | None]] | None = None) -> DataFrame:
    """For each name a weighted mean with weights (1 - 1/n) ** age over the rows so far (NULL values count as zero weight); more are other scans to run along."""
    x = rows.withColumns({f"_v_{k}": v for k, v in values.items()})
    specs: dict[str, tuple[float, Column, Column | None]] = dict(more or {})
    own = []
    for k in values:
        own += [f"num_{k}", f"den_{k}"]
        specs[f"num_{k}"] = (1 - 1 / n, F.coalesce(F.col(f"_v_{k}"), F.lit(0.0)), None)
        specs[f"den_{k}"] = (1 - 1 / n, F.when(F.col(f"_v_{k}").isNotNull(), 1.0).otherwise(0.0), None)
    x = scans(x, specs, order, by)
    return x.withColumns({k: F.col(f"num_{k}") / F.nullif(f"den_{k}", F.lit(0.0)) for k in values}).drop(*own, *[f"_v_{k}" for k in values])


def ewma_variance(rows: DataFrame, ret: str, lam: float, order: Sequence[str] = ("ts",), by: str = "symbol", name: str = "ewma_var") -> DataFrame:
    """v = lam * v_before + (1 - lam) * r^2, started at r^2."""
    return affine_scan(rows, lam, (1 - lam) * F.col(ret) ** 2, order, by, name, first=F.col(ret) ** 2)


def garch_variance(rows: DataFrame, ret: str, omega: float, alpha: float, beta: float, start: float, order: Sequence[str] = ("ts",), by: str = "symbol", name: str = "garch_var") -> DataFrame:
    """v = omega + alpha * r_before^2 + beta * v_before with given parameters, started at start."""
    w = Window.partitionBy(by).orderBy(*order)
    x = rows.withColumn("_r1", F.lag(ret).over(w))
    return affine_scan(x, beta, omega + alpha * F.coalesce(F.col("_r1"), F.lit(0.0)) ** 2, order, by, name, first=F.lit(start)).drop("_r1")
