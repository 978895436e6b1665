"""Work on stretches of a series in Arrow tasks: rolling windows by chunks that overlap, and windows on which models are fitted anew.

A series is numbered in two levels and cut into chunks of rows; a chunk also gets the n - 1 rows before it. So any function of the last n
rows runs on many chunks of one series at once, and no task holds more than a chunk and what it overlaps.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.operators.scan import numbered

#: Rows of a chunk, if windows are not longer.
CHUNK = 8192


def floats(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Values as doubles, NaN for null."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.float64()).to_numpy()


def over_chunks(rows: DataFrame, values: Sequence[str], n: int, work: Callable[..., np.ndarray], name: str, by: str = "symbol", order: Sequence[str] = ("ts",), chunk: int | None = None) -> DataFrame:
    """Adds the double column `name`: work(*arrays of values, first) of each chunk with the n - 1 rows before it.

    work gives a value for each row from `first` on; NaN becomes null.
    """
    chunk = max(n, chunk or max(CHUNK, 4 * n))
    x = numbered(rows, order, by)
    own = F.floor(F.col("_i") / chunk)
    x = x.withColumn("_k", F.explode(F.sequence(own, F.floor((F.col("_i") + n - 1) / chunk)))).withColumn("_own", F.col("_k") == F.floor(F.col("_i") / chunk))
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != name], T.StructField(name, T.DoubleType())])
    kept = [f.name for f in schema.fields[:-1]]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        first = len(table) - int(np.sum(table["_own"].to_numpy()))
        # there may be only rows of the chunk before
        got = np.asarray(work(*[floats(table[v]) for v in values], first), float) if first < len(table) else np.zeros(0)
        return pa.Table.from_arrays([*[table[c].slice(first) for c in kept], pa.array(got, from_pandas=True)], names=[*kept, name])

    return x.groupBy(by, "_k").applyInArrow(run, schema)


def rolling_apply(rows: DataFrame, value: str, n: int, function: Callable[[np.ndarray], float], name: str, least: int | None = None, by: str = "symbol", order: Sequence[str] = ("ts",), chunk: int | None = None) -> DataFrame:
    """Adds function(array of the last n values), in order and the row's own last; null where fewer than `least` (n) of them are there.

    A window at a series' begin is shorter; null values are NaN in the array.
    """
    least = n if least is None else least

    def work(x: np.ndarray, first: int) -> np.ndarray:
        there = np.cumsum(np.r_[0, ~np.isnan(x)])
        out = np.full(len(x) - first, np.nan)
        for i in range(first, len(x)):
            low = max(0, i + 1 - n)
            if there[i + 1] - there[low] >= least:
                out[i - first] = function(x[low : i + 1])
        return out

    return over_chunks(rows, [value], n, work, name, by, order, chunk)


def rolling_rank(rows: DataFrame, value: str, n: int, name: str = "rank", least: int = 0, by: str = "symbol", order: Sequence[str] = ("ts",), chunk: int | None = None) -> DataFrame:
    """Adds the share of the last n rows whose value is at most the row's own; rows without a value are never so, and have 0.
    Null where fewer than `least` of them have a value.

    The window's values are kept in order: one comes in, one goes, and the rank is a binary search.
    """

    def work(x: np.ndarray, first: int) -> np.ndarray:
        held: list[float] = []
        out, values = np.zeros(len(x) - first), x.tolist()
        for i, v in enumerate(values):
            if i >= n and (gone := values[i - n]) == gone:
                del held[bisect_left(held, gone)]
            if v == v:
                insort(held, v)
            if i >= first:
                out[i - first] = math.nan if len(held) < least else bisect_right(held, v) / min(i + 1, n) if v == v else 0.0
        return out

    return over_chunks(rows, [value], n, work, name, by, order, chunk)


def refits(rows: DataFrame, train: int, test: int, by: str = "symbol", order: Sequence[str] = ("ts",), whole: bool = True) -> DataFrame:
    """Rows of each window: window k learns from `train` rows from row k * test on, and is used on the `test` rows after them.

    Adds window, _i (the row's number in its series), _j (its number in the window) and _test. A row is in train / test + 1 windows at most.
    With whole, the last window has all its test rows; else it may have fewer.
    """
    x = numbered(rows, order, by)
    n = x.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    x = x.join(n, by)
    last = F.floor((F.col("_n") - train - (test if whole else 1)) / test)
    low = F.greatest(F.lit(0), F.ceil((F.col("_i") - train - test + 1) / test))
    x = x.withColumn("_low", low.cast("bigint")).withColumn("_high", F.least(F.floor(F.col("_i") / test), last).cast("bigint")).where("_low <= _high")
    x = x.withColumn("window", F.explode(F.sequence("_low", "_high"))).withColumn("_j", F.col("_i") - F.col("window") * test)
    return x.withColumn("_test", F.col("_j") >= train).drop("_low", "_high", "_n")
