"""Models learned window by window: walk-forward probabilities, meta-labels, importance of features alone and in clusters.

What a model learns from is decided by columns, before any model is made: a row is repeated for each (window, fold) in which it
takes part, with its role. Each (series, window, fold) is then one group of bounded size, set by the window's parameters, so all
series, windows and folds are fitted in one job, and tests can look for leaks in the table of folds alone.

Labels are 1 and other (counted as 0 or -1). t1 is the time at which a row's label is known.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestream.functions import numbers as nb
from lodestream.operators.boosted import Boosted, Logistic, Settings
from lodestream.operators.windows import floats, refits

Model = Callable[[np.ndarray, np.ndarray, np.ndarray | None], Boosted | Logistic]


def trees(**more) -> Model:
    return lambda x, y, w: Boosted(x, y, w, Settings(**more))


def logistic(penalty: float = 0.01) -> Model:
    return lambda x, y, w: Logistic(x, y, w, penalty)


def _matrix(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    return np.column_stack([floats(table[c]) for c in columns])


def _first_test(by: str) -> Column:
    return F.min(F.when(F.col("_test"), F.col("ts"))).over(Window.partitionBy(by, "window"))


def walk_forward(rows: DataFrame, features: Sequence[str], label: str, train: int, test: int, purge: int = 0, model: Model | None = None, weight: str | None = None, by: str = "symbol", whole: bool = False) -> DataFrame:
    """by, ts, window, p: probability of label 1 for the rows after each window's training rows, of each series by a model of its own.

    The last purge training rows are left out, and, if there is a column t1, rows whose label is known only after the first test row. Rows
    without a label are predicted, but not learned from; with nothing to learn from p is null. Where there is one label only, p is its share.
    """
    model = model or logistic()
    x = refits(rows, train, test, by, whole=whole)
    learns = ~F.col("_test") & (F.col("_j") < train - purge) & F.col(label).isNotNull()
    if "t1" in rows.columns:
        learns = learns & F.coalesce(F.col("t1") <= _first_test(by), F.lit(False))
    x = x.select(by, "ts", "window", "_test", learns.alias("_learns"), *[F.col(f).cast("double").alias(f"_x{k}") for k, f in enumerate(features)], (F.col(label) == 1).cast("double").alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    x = x.where("_test or _learns")
    names = [f"_x{k}" for k in range(len(features))]
    schema = T.StructType([rows.schema[by], rows.schema["ts"], T.StructField("window", T.LongType()), T.StructField("p", T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("ts")
        known, own = table.filter(table["_learns"]), table.filter(table["_test"])
        p = model(_matrix(known, names), floats(known["_y"]), floats(known["_w"])).probability(_matrix(own, names)) if len(known) else np.full(len(own), np.nan)
        return pa.Table.from_arrays([own[by], own["ts"], own["window"], pa.array(p, from_pandas=True)], names=[by, "ts", "window", "p"])

    return x.groupBy(by, "window").applyInArrow(run, schema)


def meta_folds(rows: DataFrame, train: int, test: int, folds: int = 3, gap: int = 10, embargo: float = 0.01, by: str = "symbol") -> DataFrame:
    """Rows with window, fold and learns for a model of sides: fold 0 learns from all the window's training rows and gives its test rows, folds 1 to
    `folds` learn from earlier training rows and give later ones.

    Training rows are those whose label is known at the first test row (t1). Numbered among themselves, fold f gives the f-th of folds + 1 equal
    runs, and learns from rows that end more than gap rows and the embargo's share of rows before it, with labels known at its first row.
    """
    x = refits(rows, train, test, by).withColumn("_start", _first_test(by)).where(F.col("_test") | (F.coalesce("t1", "ts") <= F.col("_start")))
    each = Window.partitionBy(by, "window", "_test")
    x = x.withColumns({"_p": (F.row_number().over(each.orderBy("_j")) - 1).cast("bigint"), "_n": F.count(F.lit(1)).over(each)})
    size = F.floor(F.col("_n") / (folds + 1))
    x = x.withColumn("_size", size)
    starts = [F.max(F.when(~F.col("_test") & (F.col("_p") == f * F.col("_size")), F.col("ts"))).over(Window.partitionBy(by, "window")) for f in range(1, folds + 1)]
    x = x.withColumn("_starts", F.array(*starts))
    away = F.floor(F.col("_n") * F.lit(embargo))

    def role(f: int) -> Column:
        first = f * F.col("_size")
        gives = (F.col("_p") >= first) & (F.col("_p") < first + F.col("_size"))
        learns = (F.col("_p") < first - gap) & ((away == 0) | (F.col("_p") < first - away)) & (F.coalesce("t1", "ts") <= F.col("_starts")[f - 1])
        return F.when(~F.col("_test") & (gives | F.coalesce(learns, F.lit(False))), F.struct(F.lit(f).alias("fold"), (~gives).alias("learns")))

    all_ = F.struct(F.lit(0).alias("fold"), (~F.col("_test")).alias("learns"))
    x = x.withColumn("_f", F.explode(F.array_compact(F.array(all_, *[role(f) for f in range(1, folds + 1)]))))
    return x.select(*rows.columns, "window", "_f.fold", "_f.learns")


def meta_labels(rows: DataFrame, features: Sequence[str], label: str, train: int, test: int, folds: int = 3, gap: int = 10, embargo: float = 0.01, model: Model | None = None, weight: str | None = None, forward: str | None = None, fee: float = 0.0, by: str = "symbol") -> DataFrame:
    """by, ts, window, side, p_side, p_meta for the test rows of each window: a first model gives the side, a second how likely it is to pay.

    The second learns from the training rows to which a fold of meta_folds gave a side, with the side as one more feature. Its label is
    whether the side was the label, or, if forward (the next return) is named, whether side * forward is above the fee. With one such
    label only, or none, p_meta is 0.5. Training rows that no fold gives a side to are not learned from.
    """
    model = model or trees()
    x = meta_folds(rows, train, test, folds, gap, embargo, by)
    names = [f"_x{k}" for k in range(len(features))]
    more = [("_y", F.col(label).cast("double")), ("_w", F.col(weight).cast("double") if weight else F.lit(1.0)), ("_r", F.col(forward).cast("double") if forward else F.lit(None).cast("double"))]
    x = x.select(by, "ts", "window", "fold", "learns", *[F.col(f).cast("double").alias(n) for n, f in zip(names, features, strict=True)], *[c.alias(n) for n, c in more])
    carried = [by, "ts", "window", "fold", *names, "_y", "_w", "_r"]
    schema = T.StructType([*[x.schema[c] for c in carried], T.StructField("p_side", T.DoubleType())])

    def sides(table: pa.Table) -> pa.Table:
        table = table.sort_by("ts")
        known, own = table.filter(pa.compute.and_(table["learns"], pa.compute.is_valid(table["_y"]))), table.filter(pa.compute.invert(table["learns"]))
        p = np.full(len(own), np.nan)
        if len(known) >= 2:
            p = model(_matrix(known, names), (floats(known["_y"]) == 1) * 1.0, floats(known["_w"])).probability(_matrix(own, names))
        return pa.Table.from_arrays([*[own[c] for c in carried], pa.array(p, from_pandas=True)], names=[*carried, "p_side"])

    given = x.groupBy(by, "window", "fold").applyInArrow(sides, schema)
    out = T.StructType([x.schema[by], x.schema["ts"], T.StructField("window", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("p_side", T.DoubleType()), T.StructField("p_meta", T.DoubleType())])

    def pays(table: pa.Table) -> pa.Table:
        table = table.sort_by("ts")
        first, p = floats(table["fold"]) == 0, floats(table["p_side"])
        side = np.where(p >= 0.5, 1.0, -1.0)
        y = (side * floats(table["_r"]) - fee > 0) * 1.0 if forward else ((side == 1) == (floats(table["_y"]) == 1)) * 1.0
        seen = ~first & ~np.isnan(p) & ~np.isnan(floats(table["_r" if forward else "_y"]))
        xs = np.column_stack([_matrix(table, names), side])
        meta = np.full(int(first.sum()), 0.5)
        if len(np.unique(y[seen])) == 2:
            meta = model(xs[seen], y[seen], floats(table["_w"])[seen]).probability(xs[first])
        own = table.filter(pa.array(first))
        sides_ = pa.array(side[first].astype(np.int32), mask=np.isnan(p[first]))
        return pa.Table.from_arrays([own[by], own["ts"], own["window"], sides_, own["p_side"], pa.array(meta)], names=[f.name for f in out.fields])

    return given.groupBy(by, "window").applyInArrow(pays, out)


def model_signal(found: DataFrame, p: str, side: str | None = None, least: float = 0.5, step: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Adds sig. With a side (meta-labels): side times the size of p, nothing below one half. Else the sign of p - 1/2, nothing within `least`
    of being sure, times the size of p. Sizes come from numbers.bet_size, in steps if wanted."""
    size = nb.bet_size(F.col(p), F.lit(1.0), 2, step)
    if side:
        sig = F.col(side) * F.greatest(size, F.lit(0.0)) * scale
    else:
        sure = F.greatest(F.col(p), 1 - F.col(p)) >= least
        sig = F.when(sure, F.when(F.col(p) >= 0.5, 1.0).otherwise(-1.0) * F.abs(size) * scale).otherwise(0.0)
    return found.withColumn("sig", nb.clip(F.coalesce(sig, F.lit(0.0)), -1, 1))


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties at their mean."""
    values, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def correlations(x: np.ndarray, by_rank: bool = True) -> np.ndarray:
    """Of columns, 0 where one does not vary."""
    z = np.stack([average_ranks(c) for c in x.T], 1) if by_rank else x
    z = z - z.mean(0)
    size = np.sqrt((z**2).sum(0))
    return np.clip(z.T @ z / np.where(np.outer(size, size) > 0, np.outer(size, size), np.inf), -1, 1)


def ward_clusters(distance: np.ndarray, threshold: float | None = 0.5, most: int | None = None) -> list[int]:
    """Cluster numbers from 1, in order of each cluster's first member: the two nearest clusters by Ward's update are joined until they
    are further apart than the threshold, or, if most is given, until there are no more than that."""
    n = len(distance)
    members, size = {k: [k] for k in range(n)}, dict.fromkeys(range(n), 1)
    d2 = {(i, j): float(distance[i, j]) ** 2 for i in range(n) for j in range(i + 1, n)}
    while len(members) > (most or 1):
        (i, j), near = min(d2.items(), key=lambda e: (e[1], e[0]))
        if most is None and threshold is not None and near**0.5 > threshold:
            break
        for k in members:
            if k not in (i, j):
                a, b = (min(i, k), max(i, k)), (min(j, k), max(j, k))
                d2[a] = ((size[i] + size[k]) * d2[a] + (size[j] + size[k]) * d2[b] - size[k] * near) / (size[i] + size[j] + size[k])
        d2 = {e: v for e, v in d2.items() if j not in e}
        members[i] += members.pop(j)
        size[i] += size.pop(j)
    out = [0] * n
    for c, own in enumerate(sorted(members.values(), key=min), 1):
        for k in own:
            out[k] = c
    return out


def clusters_of(x: np.ndarray, threshold: float | None, most: int | None) -> list[int]:
    return ward_clusters(np.sqrt(0.5 * (1 - correlations(x))), threshold, most)


def importance_folds(rows: DataFrame, size: int, folds: int = 4, embargo: float = 0.01, by: str = "symbol") -> DataFrame:
    """Rows with window (runs of `size` rows of a series; the rest is left out), fold and role: test, train, or none.

    Of a window's folds equal runs one is tested; rows whose label is known only after its first row, though they stand before it, and rows within
    the embargo's share of rows after it are in neither.
    """
    x = refits(rows, 0, size, by)
    run = size // folds
    x = x.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    first = F.col("fold") * run
    start = F.max(F.when(F.col("_j") == first, F.col("ts"))).over(Window.partitionBy(by, "window", "fold"))
    inside = (F.col("_j") >= first) & (F.col("_j") < first + run)
    early = (F.col("_j") < first) & (F.coalesce("t1", "ts") <= F.col("_start"))
    late = F.col("_j") >= first + run + int(size * embargo)
    return x.withColumn("_start", start).withColumn("role", F.when(inside, "test").when(early | late, "train")).select(*rows.columns, "window", "fold", "_j", "role")


def _score(p: np.ndarray, y: np.ndarray) -> float:
    """Mean log of the probability given to what happened."""
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(np.mean(np.log(np.where(y == 1, p, 1 - p))))


def permutation(n: int, *seed: int) -> np.ndarray:
    """A fixed one for each seed."""
    return np.random.default_rng(seed).permutation(n)


def fold_scores(rows: DataFrame, features: Sequence[str], label: str, size: int, folds: int = 4, embargo: float = 0.01, threshold: float | None = 0.5, most: int | None = None, model: Model | None = None, weight: str | None = None, by: str = "symbol") -> DataFrame:
    """by, window, fold, feature, cluster, base, drop, alone, cluster_drop, gain: one row a feature of each fold.

    base is the score of the test rows under a model of all features; drop what it loses when the feature's test values are permuted, cluster_drop
    when those of its whole cluster are, each feature by a permutation of its own; alone is the score of a model of this feature only; gain
    is what the trees' splits on it gain. Clusters join features near in rank correlation over the window's rows.
    """
    model = model or trees()
    x = importance_folds(rows, size, folds, embargo, by)
    names = [f"_x{k}" for k in range(len(features))]
    x = x.select(by, "window", "fold", "_j", "role", *[F.col(f).cast("double").alias(n) for n, f in zip(names, features, strict=True)], (F.col(label) == 1).cast("double").alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    doubles = ("base", "drop", "alone", "cluster_drop", "gain")
    schema = T.StructType([rows.schema[by], T.StructField("window", T.LongType()), T.StructField("fold", T.IntegerType()), T.StructField("feature", T.StringType()), T.StructField("cluster", T.IntegerType()), *[T.StructField(d, T.DoubleType()) for d in doubles]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_j")
        everything = np.nan_to_num(_matrix(table, names))
        cluster = clusters_of(everything, threshold, most)
        role, y, w = np.array(table["role"].to_pylist(), object), floats(table["_y"]), floats(table["_w"])
        labelled = ~np.isnan(y)
        tr, te = (role == "train") & labelled, (role == "test") & labelled
        window, fold = table["window"][0].as_py(), table["fold"][0].as_py()
        if not tr.any() or not te.any():
            return schema_table([])
        xs = _matrix(table, names)
        whole = model(xs[tr], y[tr], w[tr])
        base = _score(whole.probability(xs[te]), y[te])
        moved = [xs[te][:, k][permutation(int(te.sum()), window, fold, k)] for k in range(len(features))]

        def without(which: Sequence[int]) -> float:
            z = xs[te].copy()
            for k in which:
                z[:, k] = moved[k]
            return base - _score(whole.probability(z), y[te])

        lost = {c: without([k for k in range(len(features)) if cluster[k] == c]) for c in set(cluster)}
        gain = getattr(whole, "gain", np.zeros(len(features)))
        out = []
        for k, f in enumerate(features):
            alone = _score(model(xs[tr][:, [k]], y[tr], w[tr]).probability(xs[te][:, [k]]), y[te])
            out.append((table[by][0].as_py(), window, fold, f, cluster[k], base, without([k]), alone, lost[cluster[k]], float(gain[k])))
        return schema_table(out)

    arrow = pa.schema([(by, pa.string()), ("window", pa.int64()), ("fold", pa.int32()), ("feature", pa.string()), ("cluster", pa.int32()), *[(d, pa.float64()) for d in doubles]])

    def schema_table(out: list[tuple]) -> pa.Table:
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(arrow), arrow, strict=True)], schema=arrow)

    return x.groupBy(by, "window", "fold").applyInArrow(run, schema)


def importance(scores: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """mdi, mda, sfi and folds of each feature over the windows and folds of fold_scores.

    mdi: the mean share of the gain; null where no split uses the feature. mda: the mean drop over the mean score's size. sfi: the mean score alone.
    """
    share = F.col("gain") / F.nullif(F.sum("gain").over(Window.partitionBy(*by, "window", "fold")), F.lit(0.0))
    g = scores.withColumn("_g", share).groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("folds"), F.avg(F.nullif("_g", F.lit(0.0))).alias("mdi"), F.avg("drop").alias("_d"), F.avg("base").alias("_b"), F.avg("alone").alias("sfi"))
    return g.select(*by, "feature", "folds", "mdi", F.coalesce(F.col("_d") / F.nullif(F.abs("_b"), F.lit(0.0)), F.lit(0.0)).alias("mda"), "sfi")


def clustered(scores: DataFrame, by: Sequence[str] = ("symbol", "window")) -> DataFrame:
    """cluster, members, mda of the cluster and each member's equal part of it, over the folds of a window."""
    keys = [*by, "cluster"]
    whole = scores.groupBy(*keys).agg(F.array_sort(F.collect_set("feature")).alias("members"), F.avg("cluster_drop").alias("_d"), F.avg("base").alias("_b"))
    x = whole.select(*keys, "members", (F.col("_d") / F.nullif(F.abs("_b"), F.lit(0.0))).alias("mda"))
    return x.withColumn("each", F.col("mda") / F.size("members"))


def weighted_tau(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau with pairs weighted by 1 / rank of either, the mean of ranking by x and by y (largest first); NaN without any order."""

    def one(a: np.ndarray, b: np.ndarray) -> float:
        order = np.lexsort((b, a))[::-1]
        rank = np.empty(len(a))
        rank[order] = np.arange(len(a))
        w = 1 / (rank + 1)
        w = np.triu(w[:, None] + w[None, :], 1)
        sa, sb = np.sign(a[:, None] - a[None, :]), np.sign(b[:, None] - b[None, :])
        base = np.sqrt((w * sa**2).sum() * (w * sb**2).sum())
        return float((w * sa * sb).sum() / base) if base > 0 else float("nan")

    return (one(x, y) + one(y, x)) / 2


def component_agreement(rows: DataFrame, found: DataFrame, features: Sequence[str], components: int = 3, largest: bool = False, by: str = "symbol") -> DataFrame:
    """by, features, tau: agreement of the order of mdi (of importance()) with that of the features' loads on principal components, reversed.

    Correlations come from one aggregate over all rows of a series, so no task holds them; a task gets one row a series. A feature's load is the
    sum of the sizes of its parts of `components` eigenvectors, those of the least eigenvalues, or of the largest. Features without mdi
    are left out; below three tau is 0.
    """
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    fill = lambda f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(None))
    moments = rows.groupBy(by).agg(*[F.coalesce(F.corr(fill(features[i]), fill(features[j])), F.lit(0.0)).alias(f"_c{i}_{j}") for i, j in pairs])
    per = found.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("feature", "mdi"))).alias("_m"))
    x = moments.join(per, by).select(by, F.array(*[f"_c{i}_{j}" for i, j in pairs]).alias("_c"), F.array(*[F.element_at("_m", F.lit(f)) for f in features]).alias("_mdi"))
    schema = T.StructType([rows.schema[by], T.StructField("features", T.IntegerType()), T.StructField("tau", T.DoubleType())])

    def run(batches):
        for batch in batches:
            n, tau = [], []
            for c, mdi in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                m = np.zeros((len(features),) * 2)
                for (i, j), v in zip(pairs, c, strict=True):
                    m[i, j] = m[j, i] = v
                use = [k for k, v in enumerate(mdi) if v is not None]
                n.append(len(use))
                if len(use) < 3:
                    tau.append(0.0)
                    continue
                vectors = np.linalg.eigh(m[np.ix_(use, use)])[1]
                load = np.abs(vectors[:, ::-1] if largest else vectors)[:, :components].sum(1)
                tau.append(weighted_tau(average_ranks(np.array([mdi[k] for k in use])), average_ranks(-load)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(tau, pa.float64(), from_pandas=True)], [by, "features", "tau"])

    return x.mapInArrow(run, schema)
