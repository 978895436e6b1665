"""Exact top-k search by inner product, with block-at-a-time pruning.

Vectors are turned into integers; a component is a term, its value the term's weight. Rows are sorted by vec_id and cut into
shards, a shard into blocks, so blocks are ranges of ids. A block keeps, per term, the largest and smallest weight, and a
forward index: the block's rows as one matrix. For a query the sum over terms of its weight times the better of the two bounds
what any row of the block can score. Blocks are visited by falling bound and scored through the forward index until the bound
falls below the k-th score so far; blocks whose bound equals it are still visited, as a smaller id wins a tie.

Queries are a stated set, so they meet all rows in blocks: shards and chunks of queries are paired by number, salted over
PAIR_SALTS, and each pair is one row of at most SHARD_ROWS and QUERY_CHUNK vectors; a Python task holds one Arrow batch of such
rows, so Spark's limit of bytes a batch bounds it. A first pass over one shard a chunk gives every query a score to beat before
all shards are read. Every shard gives back at most k rows a query. Nothing is broadcast, and shards are cut while sorted rows
stream by, so many rows with one vec_id are spread like any others.

Defined results: a null vector, or one with null, NaN or infinite components (or one whose SCALE-fold is infinite), is neither
query nor candidate; vectors of different lengths never meet; rows with the query's own vec_id are its own rows; repeated rows
each count as candidates, but equal query rows are one query; a query with fewer than k candidates gets all of them; rows without
a vec_id take no part. Scores are exact; one beyond the range of a 64-bit integer becomes the end of that range that it
passed, and is ranked as such.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.session import settle, table, tune

BLOCK_ROWS = 64
SHARD_ROWS = 8192
QUERY_CHUNK = 256
SCALE = 256.0
EVERY = 50
PAIR_SALTS = 64
#: Scores are kept within the range of a 64-bit integer.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """vec_id, n, dims (integers as doubles): floor of SCALE times each component."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) != float("inf")))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(v.isNotNull() & F.col("vec_id").isNotNull()).where(finite & (F.size("v") > 0))
    # doubles from 2^53 on have no fraction, and floor would not fit a bigint
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    return rows.select("vec_id", F.size("v").alias("n"), F.transform("v", lambda x: whole(x * SCALE)).alias("dims"))


def _packed(rows: DataFrame, size: int, number: str) -> DataFrame:
    """(n, number, ids, rows): runs of at most size rows of one length in the order of vec_id, as bytes.

    Rows are dealt by ranges of (n, vec_id, place), place being any distinct number, so that one id can lie in several ranges.
    """
    parts = max(1, -(-rows.count() // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        length, ids, vectors = None, [], []

        def flush() -> pa.RecordBatch:
            nonlocal made, ids, vectors
            made += 1
            out = [[length], [base + made], [np.array(ids, np.int64).tobytes()], [np.array(vectors, np.float64).tobytes()]]
            ids, vectors = [], []
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["n", number, "ids", "rows"])

        for batch in batches:
            for n, i, v in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if ids and (n != length or len(ids) >= size):
                    yield flush()
                length = n
                ids.append(i)
                vectors.append(v)
        if ids:
            yield flush()

    placed = rows.select("n", "vec_id", "dims", F.monotonically_increasing_id().alias("place"))
    dealt = placed.repartitionByRange(parts, "n", "vec_id", "place").sortWithinPartitions("n", "vec_id", "place")
    return dealt.mapInArrow(run, f"n bigint, {number} bigint, ids binary, rows binary")


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact and kept within [LEAST, MOST].

    In doubles where no partial sum can reach 2^53; pairs of rows for which it might are done again in Python's integers.
    """
    most = np.abs(q).max(1, initial=0)[:, None] * np.abs(x).max(1, initial=0)[None, :] * q.shape[1]
    if not (unsafe := ~(most < 2**53)).any():
        return (q @ x.T).astype(np.int64)
    with np.errstate(all="ignore"):
        out = np.where(unsafe, 0, q @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    for i in np.flatnonzero(unsafe.any(1)):
        at = np.flatnonzero(unsafe[i])
        out[i, at] = [min(MOST, max(LEAST, int(s))) for s in whole(x[at]) @ whole(q[i])]
    return out


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of (query, block) scores, never too low, and by query how much a double may be off a score."""
    with np.errstate(all="ignore"):
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        size = np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T
        # doubles are exact below 2^53; beyond, their error is a tiny share of the sum of all sizes
        bounds = np.where(size < 2**53, bounds, bounds + size * 1e-12 + 1)
        slack = np.where(size.max(1, initial=0) < 2**53, 0.0, 4096.0)
    return np.nan_to_num(bounds, nan=np.inf, posinf=np.inf, neginf=-np.inf), slack


def search_shard(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None, block: int = BLOCK_ROWS) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score): each query's best k of the shard, but for those below its floor.

    ids are ascending, so blocks are ranges of ids. Queries whose next block is the same are scored together.
    """
    n = len(ids)
    starts = np.arange(0, n, block)
    bounds, slack = _bounds(q, np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts))
    order = np.argsort(-bounds, axis=1, kind="stable")
    scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
    kth = np.full(len(q), -np.inf) if floor is None else floor - slack
    open_ = np.arange(len(q))
    for step in range(len(starts)):
        at = order[open_, step]
        # kept scores end at MOST, so a bound beyond it may only tie with it
        keep = bounds[open_, at] >= kth[open_]
        open_, at = open_[keep], at[keep]
        if not len(open_):
            break
        for b in np.unique(at):
            who = open_[at == b]
            span = slice(b * block, min(n, (b + 1) * block))
            got = _products(q[who], x[span])
            for r, w in enumerate(who):
                other = ids[span] != q_ids[w]
                s, v = np.concatenate([scores[w], got[r][other]]), np.concatenate([found[w], ids[span][other]])
                if len(s) > k:
                    # ~s falls as s rises, and unlike -s never overflows
                    best = np.lexsort((v, ~s))[:k]
                    s, v = s[best], v[best]
                scores[w], found[w] = s, v
                if len(s) == k:
                    kth[w] = max(kth[w], float(s.min()) - slack[w])
    return [(int(q_ids[w]), int(v), int(s)) for w in range(len(q)) for v, s in zip(found[w], scores[w], strict=True)]


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """Best k of each pair of a shard and a query chunk: n, query_id, vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                n = r["n"]
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.float64).reshape(-1, n)
                q_ids, q = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_rows"], np.float64).reshape(-1, n)
                floor = None if r["floor"] is None else np.frombuffer(r["floor"], np.float64)
                got = search_shard(q_ids, q, ids, x, k, floor)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([n] * len(got), *zip(*got, strict=True))], ["n", "query_id", "vec_id", "score"])

    return pairs.select("n", "ids", "rows", "q_ids", "q_rows", "floor").mapInArrow(run, "n bigint, query_id bigint, vec_id bigint, score bigint")


def top_k(rows: DataFrame, k: int = 5, every: int = EVERY, vector: str = "embedding", shard_rows: int = SHARD_ROWS, query_chunk: int = QUERY_CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: queries are the rows whose vec_id is divisible by every, candidates all other rows."""
    base = usable(rows, vector)
    base = settle(base.withColumn("n", F.col("n").cast("bigint")), "vectors")
    queries = settle(base.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "dims"]), "asked")
    shards = settle(_packed(base, shard_rows, "shard"), "shards")
    chunks = settle(_packed(queries, query_chunk, "chunk").select("n", "chunk", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows")), "queries")
    # numbers only: every chunk meets every shard of its length, dealt by salt
    salts = F.explode(F.sequence(F.lit(0), F.lit(PAIR_SALTS - 1)))
    pairs = chunks.select("n", "chunk", salts.alias("salt")).join(shards.select("n", "shard", F.pmod("shard", F.lit(PAIR_SALTS)).cast("int").alias("salt")), ["n", "salt"]).drop("salt")
    one = pairs.groupBy("n", "chunk").agg(F.min_by("shard", F.xxhash64("chunk", "shard")).alias("shard")).join(chunks, ["n", "chunk"])
    first = _search(one.withColumn("floor", F.lit(None).cast("binary")).join(shards, ["n", "shard"]), k)
    floors = first.groupBy("n", "query_id").agg(F.count(F.lit(1)).alias("c"), F.min("score").cast("double").alias("s")).where(F.col("c") >= k)
    known = settle(_with_floors(chunks, settle(floors.select("n", "query_id", "s"), "floors")), "known")
    full = pairs.join(known, ["n", "chunk"]).join(shards, ["n", "shard"])
    ranked = _search(full, k).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "n")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _with_floors(chunks: DataFrame, floors: DataFrame) -> DataFrame:
    """Adds floor: for each query of the chunk the k-th score that its first shard gave, -inf without one."""
    scores = floors.groupBy(F.col("n").alias("f_n"), F.col("query_id").alias("f_id")).agg(F.max("s").alias("s"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, chunk, at, ids = [], [], [], []
            for a, c, raw in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                own = np.frombuffer(raw, np.int64).tolist()
                ids += own
                at += range(len(own))
                n += [a] * len(own)
                chunk += [c] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (n, chunk, at, ids)], ["n", "chunk", "at", "query_id"])

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s = rows.sort_values("at").s.fillna(-np.inf).to_numpy(np.float64)
        return pd.DataFrame({"n": [key[0]], "chunk": [key[1]], "floor": [s.tobytes()]})

    each = chunks.select("n", "chunk", "q_ids").mapInArrow(unpack, "n bigint, chunk bigint, at bigint, query_id bigint")
    each = each.join(scores, (F.col("n") == F.col("f_n")) & (F.col("query_id") == F.col("f_id")), "left").select("n", "chunk", "at", "s")
    # a group is one chunk: at most QUERY_CHUNK rows
    made = each.groupBy("n", "chunk").applyInPandas(pack, "n bigint, chunk bigint, floor binary")
    return chunks.join(made, ["n", "chunk"])


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the 5 best of embeddings for every vector whose id is divisible by 50."""
    return top_k(table(tune(spark), sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e, len(embedding) AS n, row_number() OVER () AS k
    FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT vec_id, k, n, unnest(e) AS x, unnest(range(n)) AS d FROM v),
a AS (SELECT vec_id, e, n, row_number() OVER () AS k FROM (SELECT DISTINCT vec_id, e, n FROM v WHERE vec_id % 50 = 0)),
u AS (SELECT vec_id, k, n, unnest(e) AS x, unnest(range(n)) AS d FROM a),
s AS (SELECT q.vec_id AS query_id, c.vec_id, c.k, sum(q.x * c.x) AS score FROM u q JOIN t c ON q.d = c.d AND q.n = c.n AND q.vec_id <> c.vec_id
    GROUP BY q.vec_id, q.k, c.vec_id, c.k),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
"""
