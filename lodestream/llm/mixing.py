"""Mixing sources to target weights.

Each source's words, in a fixed order of its documents, form one stream that is packed into blocks of fixed length (the last
may be shorter). The mix is a sequence of output shards with a fixed number of slots; for each shard a multinomial
draw says how many slots each source gets, in proportion to what it is still to give, so the draws add up to the sources' targets.
A source's slots are numbered through all shards and mapped to its blocks by one pseudorandom permutation of the
block numbers after another: each block comes once before any comes twice. Blocks are then joined by (source, block).

Shards are drawn by halving: the driver draws what each source gives to runs of shards, at most DRIVER_NUMBERS numbers in all, and
tasks draw the shards of a run, each run from its own seed. Draws of a shard follow what each source has left.

Offsets in a source's stream come from three-level sums over hashed chunks of documents and runs of chunks, so a source that
holds a third of all rows is no hot group, nor is a row that stands there often. What passes through the driver is one row a source and those numbers.

Defined results: null or blank text has no words, is in no block and is never taken; a null source is a source of its
own, last in order; documents that are the same row are taken each for itself; an empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.session import settle, table, tune

BLOCK_WORDS = 256
SHARD_SLOTS = 4096
CHUNK_DOCUMENTS = 512
RUN_CHUNKS = 1024
WEIGHTS = (3.0, 1.0, 2.0)
#: Up to so many sources' rows (about 100 bytes each) are handed to all tasks.
BROADCAST_SOURCES = 100_000
DRIVER_NUMBERS = 2_000_000
MAX_RUNS = 1024
SEED = 20


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Share of all sizes split by weight; none above most times its size, the excess split again by weight."""
    total, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = [k for k, s in enumerate(sizes) if s > 0]
    while open_:
        weight = sum(weights[k] for k in open_)
        full = [k for k in open_ if total * weights[k] / weight > most * sizes[k]]
        if not full:
            for k in open_:
                out[k] = total * weights[k] / weight
            break
        for k in full:
            out[k] = most * sizes[k]
            total -= out[k]
        open_ = [k for k in open_ if k not in set(full)]
    return out


@dataclass(frozen=True)
class Plan:
    """What each source gives: slots of blocks, the last of them perhaps cut, and the permutation of each pass."""

    size: int
    blocks: int
    words: int
    slots: int
    last: int
    passes: tuple[tuple[int, int], ...]


def _permutation(rng: np.random.Generator, n: int) -> tuple[int, int]:
    """Factor and shift of i -> (factor * i + shift) mod n, a permutation as the factor has no divisor in common with n."""
    while True:
        a = int(rng.integers(1, max(2, min(n, 1 << 31))))
        if math.gcd(a, n) == 1:
            return a, int(rng.integers(0, n))


def plan_source(size: int, target: float, block: int, rng: np.random.Generator) -> Plan:
    """The slots that give round(target) words in passes over the permuted blocks."""
    blocks, words = -(-size // block), round(target)
    short = size - (blocks - 1) * block if blocks else 0
    passes, slots, left, last = [], 0, words, 0
    while left > 0:
        a, b = _permutation(rng, blocks)
        passes.append((a, b))
        if left >= size:
            slots, left, last = slots + blocks, left - size, block
            continue
        at = (pow(a, -1, blocks) * (blocks - 1 - b)) % blocks if blocks > 1 else 0  # where the short block comes in this pass
        n = -(-left // block)
        if n > at:  # the short block is among them
            more = left - (at * block + short)
            n = at + 1 + max(0, -(-more // block))
            last = short + more if more <= 0 else more - (n - at - 2) * block
        else:
            last = left - (n - 1) * block
        slots, left = slots + n, 0
    return Plan(size, blocks, words, slots, last, tuple(passes))


def draw(left: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """size slots: multinomial in proportion to what is left of each source, none above it."""
    if size >= (rest := int(left.sum())):
        return left.copy()
    got = np.minimum(rng.multinomial(size, left / rest), left)
    while (missing := size - int(got.sum())) > 0:  # a source has run out: its slots are drawn again
        open_ = left - got
        got = np.minimum(got + rng.multinomial(missing, open_ / open_.sum()), left)
    return got


def draw_runs(slots: Sequence[int], shard_slots: int, seed: int, most: int) -> list[tuple[int, int, np.ndarray]]:
    """(first shard, shards, slots of each source) of at most `most` runs of shards, by halving."""
    total = sum(slots)
    todo = [(0, -(-total // shard_slots), np.array(slots, np.int64))] if total else []
    done: list[tuple[int, int, np.ndarray]] = []
    while todo:
        if len(done) + len(todo) >= most or all(n == 1 for _, n, _ in todo):
            return sorted(done + todo, key=lambda r: r[0])
        at, n, left = todo.pop(0)
        if n == 1:
            done.append((at, n, left))
            continue
        half = n // 2
        got = draw(left, half * shard_slots, np.random.default_rng([seed, at, n]))
        todo += [(at, half, got), (at + half, n - half, left - got)]
    return sorted(done, key=lambda r: r[0])


def draw_shards(left: np.ndarray, shards: int, shard_slots: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Slots of each source in each of a run's shards; the last takes what is left."""
    left = left.copy()
    for k in range(shards):
        got = draw(left, shard_slots, rng) if k < shards - 1 else left
        left = left - got
        yield got


def _spread_copies(base: DataFrame, keys: Sequence[str], chunks: int) -> DataFrame:
    """Adds chunk, by a hash of id and text. Of a row that stands more than CHUNK_DOCUMENTS times the copies, which are alike, are made anew from their
    number, each with a chunk of its own: no task holds all of them, and reruns agree."""
    hot = settle(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > CHUNK_DOCUMENTS), "hot")
    chunk = lambda *more: F.pmod(F.xxhash64("doc_id", "h", *more), F.lit(chunks))
    if hot.isEmpty():
        return base.withColumn("chunk", chunk())
    hot = hot.select(*[F.col(k).alias(f"hot_{k}") for k in keys], "copies")
    same = [F.col(k).eqNullSafe(F.col(f"hot_{k}")) for k in keys]
    rest = base.join(hot, same, "left_anti").withColumn("chunk", chunk())
    one = base.join(hot, same, "left_semi").dropDuplicates(list(keys)).join(hot, same)
    copies = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("chunk", chunk("copy"))
    return rest.unionByName(copies.select(*rest.columns))


def place(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, start (words of the source before it) and the columns to keep; written to the shared folder."""
    n = docs.count()
    chunks = max(1, -(-n // CHUNK_DOCUMENTS))
    base = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"),
        F.xxhash64("text").alias("h"), *[F.col(c).alias(f"kept_{c}") for c in keep],
    )
    base = _spread_copies(base, ["doc_id", "source", "h", *[f"kept_{c}" for c in keep if c != "text"]], chunks)
    inside = Window.partitionBy("source", "chunk").orderBy("doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    rows = settle(base.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))), "placed")
    # one row a source and chunk, and one a source and run of chunks: no window of a hot source holds all its chunks
    sums = rows.groupBy("source", "chunk").agg(F.sum("size").alias("s")).withColumn("run", F.floor(F.col("chunk") / RUN_CHUNKS))
    earlier = lambda *by: Window.partitionBy("source", *by).rowsBetween(Window.unboundedPreceding, -1)
    runs = sums.groupBy("source", "run").agg(F.sum("s").alias("r"))
    runs = runs.select(F.col("source").alias("r_source"), F.col("run").alias("r_run"), F.coalesce(F.sum("r").over(earlier().orderBy("run")), F.lit(0)).alias("base"))
    sums = sums.withColumn("in_run", F.coalesce(F.sum("s").over(earlier("run").orderBy("chunk")), F.lit(0)))
    sums = sums.join(runs, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("run") == F.col("r_run")))
    sums = sums.select(F.col("source").alias("s_source"), F.col("chunk").alias("s_chunk"), (F.col("in_run") + F.col("base")).alias("before"))
    out = rows.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("chunk") == F.col("s_chunk")))
    return out.select("doc_id", "source", "size", (F.col("start") + F.col("before")).alias("start"), *[c for c in rows.columns if c.startswith("kept_")])


def sources_of(placed: DataFrame, weights: Sequence[float], share: float, most: float) -> pd.DataFrame:
    """One row a source, by code point and null last: source, rank, source_size, target."""
    rows = placed.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.n for r in rows]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(rows))], share, most)
    return pd.DataFrame({"source": pd.Series([r.source for r in rows], dtype=object), "rank": range(len(rows)), "source_size": sizes, "target": goal})


def _small(per_source: DataFrame, n: int) -> DataFrame:
    """Sources are few as a rule; a table of many of them is joined by a shuffle."""
    return F.broadcast(per_source) if n <= BROADCAST_SOURCES else per_source


def slots_of(spark: SparkSession, sources: pd.DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """The mix: (shard, source_rank, slot, block, words) - the first words of the block stand in the slot."""
    rng = np.random.default_rng(seed)
    plans = [plan_source(int(s), t, block, rng) for s, t in zip(sources.source_size, sources.target, strict=True)]
    runs = draw_runs([p.slots for p in plans], shard_slots, seed, max(1, min(MAX_RUNS, DRIVER_NUMBERS // max(1, len(plans)))))
    firsts = np.cumsum([np.zeros(len(plans), np.int64), *[got for _, _, got in runs]], 0)
    made = pd.DataFrame({"shard": [r[0] for r in runs], "shards": [r[1] for r in runs], "left": [r[2].tolist() for r in runs], "first": [f.tolist() for f in firsts[: len(runs)]]})

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                first = np.array(r["first"], np.int64)
                own = np.random.default_rng([seed, r["shard"], r["shards"], 1])
                for k, got in enumerate(draw_shards(np.array(r["left"], np.int64), r["shards"], shard_slots, own)):
                    on = np.flatnonzero(got)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(on), r["shard"] + k), on, first[on], got[on])], ["shard", "source_rank", "first", "n"])
                    first = first + got

    plan = spark.createDataFrame(made, "shard bigint, shards bigint, left array<bigint>, first array<bigint>")
    drawn = plan.repartition(max(1, len(runs)), "shard").mapInArrow(shards, "shard bigint, source_rank bigint, first bigint, n bigint")
    rows = [(k, e, p.blocks, p.slots, p.last, a, b) for k, p in enumerate(plans) for e, (a, b) in enumerate(p.passes)]
    passes = spark.createDataFrame(rows, "source_rank bigint, pass bigint, blocks bigint, slots bigint, last bigint, a bigint, b bigint")
    slots = drawn.select("shard", "source_rank", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
    per = passes.groupBy("source_rank").agg(F.max("blocks").alias("blocks"), F.max("slots").alias("slots"), F.max("last").alias("last"), F.map_from_entries(F.collect_list(F.struct("pass", F.struct("a", "b")))).alias("ab"))
    out = slots.join(_small(per, len(plans)), "source_rank")
    ab = F.element_at("ab", F.floor(F.col("slot") / F.col("blocks")))
    number = F.pmod(ab["a"] * F.pmod("slot", F.col("blocks")) + ab["b"], F.col("blocks"))
    return out.select("shard", "source_rank", "slot", number.alias("block"), F.when(F.col("slot") == F.col("slots") - 1, F.col("last")).otherwise(block).alias("words"), F.floor(F.col("slot") / F.col("blocks")).alias("pass"))


def pieces_of(placed: DataFrame, sources: pd.DataFrame, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """What the mix takes: (shard, source_rank, slot, pass, start, lo, hi) - words lo to hi of the document that starts there.

    start and source_rank tell documents apart, also those with equal ids.
    """
    spark = placed.sparkSession
    ranks = spark.createDataFrame(sources[["source", "rank"]], "source string, rank bigint").select(F.col("source").alias("r_source"), F.col("rank").alias("source_rank"))
    docs = placed.where("size > 0").join(_small(ranks, len(sources)), F.col("source").eqNullSafe(F.col("r_source"))).select("source_rank", "start", "size")
    spread = docs.select("source_rank", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    begin = F.col("block") * block
    spread = spread.withColumn("lo", F.greatest(F.lit(0), begin - F.col("start"))).withColumn("hi", F.least(F.col("size"), begin + block - F.col("start")))
    both = slots_of(spark, sources, block, shard_slots, seed).join(spread, ["source_rank", "block"])
    cut = F.least(F.col("hi"), begin + F.col("words") - F.col("start"))
    return both.withColumn("hi", cut).where("hi > lo").select("shard", "source_rank", "slot", "pass", "start", "lo", "hi")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken (words of the document in the mix, repeats counted) of every document."""
    placed = settle(place(docs), "mix")
    sources = sources_of(placed, weights, share, most)
    spark = docs.sparkSession
    taken = pieces_of(placed, sources, block, shard_slots, seed).groupBy("source_rank", "start").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    ranks = spark.createDataFrame(sources, "source string, rank bigint, source_size bigint, target double")
    ranks = ranks.select(F.col("source").alias("r_source"), F.col("rank").alias("source_rank"), "source_size", "target")
    full = placed.join(_small(ranks, len(sources)), F.col("source").eqNullSafe(F.col("r_source")))
    some, none = full.where("size > 0"), full.where("size = 0")
    out = some.join(taken, ["source_rank", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    return out.unionByName(none.select("doc_id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken")))


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix as documents (doc_id, text, lang, source, n_chars): one row for each pass in which words of a document are taken.

    A document taken whole keeps its text as it is; else the text goes from the first to the last word of each taken
    stretch, stretches joined by a line end.
    """
    placed = settle(place(docs, ["text", "lang"]), "mix")
    sources = sources_of(placed, weights, share, most)
    spark = docs.sparkSession
    spans = (
        pieces_of(placed.drop("kept_text", "kept_lang"), sources, block, shard_slots, seed)
        .groupBy("source_rank", "start", "pass")
        .agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    )
    ranks = spark.createDataFrame(sources[["source", "rank"]], "source string, rank bigint").select(F.col("source").alias("r_source"), F.col("rank").alias("source_rank"))
    full = placed.where("size > 0").join(_small(ranks, len(sources)), F.col("source").eqNullSafe(F.col("r_source"))).join(spans, ["source_rank", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        words = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            texts = []
            for text, size, spans in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s in spans:
                    if merged and merged[-1][1] == s["lo"]:
                        merged[-1][1] = s["hi"]
                    else:
                        merged.append([s["lo"], s["hi"]])
                if merged != [[0, size]]:
                    at = [m.span() for m in words.finditer(text)]
                    text = "\n".join(text[at[lo][0] : at[hi - 1][1]] for lo, hi in merged)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(1), batch.column(2)], ["doc_id", "text", "lang", "source"])

    out = full.select("doc_id", F.col("kept_lang").cast("string"), "source", F.col("kept_text").cast("string"), "size", "spans").mapInArrow(run, "doc_id bigint, text string, lang string, source string")
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents, weights 3, 1, 2 by source, 150 % of all words, at most twice each source."""
    return mix(table(tune(spark), sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix of the documents as documents."""
    return mix_documents(docs)
