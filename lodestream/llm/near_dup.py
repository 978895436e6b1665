"""MinHash near-dedup with tensored banding.

Two small collections of m subkeys each are made from minhashes, r hashes a subkey. The tables of a locality-sensitive
index are all pairs of a subkey of the first and one of the second collection: m * m tables of 2r hashes each, for the price of
2 * m * r hashes. m is chosen so that a pair at the threshold is missed with a probability below MISS.

Texts with equal shingle sets are one class; only a class's smallest id goes on. Rows are dealt by the first subkey; in its
partition each meets the second subkeys, and the rows of a table cell are linked to the smallest of them. A key with more than
HOT rows is salted into parts of about HOT, whose smallest rows are then compared by a partial aggregate and a join, so no
window holds more however large the table. Cells linked together are a family: no link leaves a family but for the stated miss.

Links are then confirmed on full sets. A family is cut by hash into blocks; each block is compared with itself and with the
first block, and tasks give back only a spanning forest of the links they find. What is then outside the family's largest component is
compared with all of the family, block by block. No pairs are listed, and no group meets in one task.

Defined results: a text without words, or null, has the empty set and is linked with nothing; with fewer words than a
shingle has, the whole sequence is its one shingle; rows with equal ids and texts are one document; a null id is
compared with nothing and has no component. Rows with equal ids but different texts each have their own text's group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.operators.components import connected_components
from lodestream.session import settle, table, tune

WIDTH, PERCENT = 5, 80
HASHES_PER_SUBKEY = 4
MISS = 5e-6
BLOCK = 96
#: Rows of one key that meet in one window.
HOT = 1024
#: Up to so many ids (16 bytes each) are handed to all tasks; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def shingles(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of width words of a text in UTF-8."""
    words = raw.translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, _U)
    if n < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), n)], _U)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), _U, n)
    s = np.zeros(n - width + 1, _U)
    for k in range(width):
        s = _mixed(s + h[k : n - width + 1 + k]) * _U(2 * k + 3)
    return np.unique(s)


def subkeys_for(percent: int, r: int = HASHES_PER_SUBKEY, miss: float = MISS) -> int:
    """Subkeys a collection needs so that a pair at the threshold matches in one with probability above 1 - miss."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - min(0.999999, (percent / 100) ** r))))


class MinHasher:
    def __init__(self, m: int, r: int = HASHES_PER_SUBKEY, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.m, self.r = m, r
        self.a = rng.integers(1, 1 << 63, 2 * m * r, dtype=np.uint64) * _U(2) + _U(1)
        self.b = rng.integers(0, 1 << 63, 2 * m * r, dtype=np.uint64)

    def subkeys(self, s: np.ndarray) -> np.ndarray:
        """2m subkeys of 32 bits; the first m are the first collection."""
        low = np.full(2 * self.m * self.r, np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(s), 512):
            part = s[at : at + 512, None]
            low = np.minimum(low, ((part * self.a + self.b) >> _U(32)).astype(np.uint32).min(0))
        key = np.zeros(2 * self.m, _U)
        for k in range(self.r):
            key = _mixed(key + low.reshape(2 * self.m, self.r)[:, k].astype(_U) + _U(1))
        return (key >> _U(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, sig (128 bits of the set; null for the empty one), th (hash of the text), first and second subkeys."""
    m = subkeys_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(m)
        for batch in batches:
            n, sig, first, second = [], [], [], []
            for raw in batch.column(2).cast(pa.binary()).to_pylist():
                s = shingles(raw or b"", width)
                n.append(len(s))
                if len(s):
                    keys = hasher.subkeys(s)
                    sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                    first.append(keys[:m])
                    second.append(keys[m:])
                else:
                    sig.append(None)
                    first.append(None)
                    second.append(None)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, t) for x, t in zip((n, sig, first, second), kinds, strict=True)]], ["doc_id", "th", "n_shingles", "sig", "first", "second"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, th bigint, n_shingles bigint, sig binary, first array<int>, second array<int>")


def _cell_edges(rows: DataFrame, most: int = HOT, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Edges from each representative to the smallest one in its table cells; a row: rep, key (first subkey), second."""
    hot = rows.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).alias("parts"))
    hot = settle(hot, "hot")  # one row in more than `most` of the keyed rows
    marked = rows.join(F.broadcast(hot) if hot.count() <= broadcast_ids else hot, "key", "left")
    cells = lambda df: df.select(*[c for c in df.columns if c != "second"], F.posexplode("second").alias("j", "cell"))
    cold = marked.where("parts is null").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    cold = cells(cold.select("key", "rep", "second")).withColumn("leader", F.min("rep").over(Window.partitionBy("key", "j", "cell")))
    warm = marked.where("parts is not null").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("parts")))
    warm = cells(warm.select("key", "salt", "rep", "second")).withColumn("leader", F.min("rep").over(Window.partitionBy("key", "salt", "j", "cell")))
    tops = warm.select("key", "j", "cell", "leader").distinct()
    top = tops.join(tops.groupBy("key", "j", "cell").agg(F.min("leader").alias("m")), ["key", "j", "cell"])
    edges = cold.select("rep", "leader").unionByName(warm.select("rep", "leader")).unionByName(top.select(F.col("leader").alias("rep"), F.col("m").alias("leader")))
    return edges.where("rep <> leader").distinct()


def _links(ids: list[int], sets: list[np.ndarray], comps: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets; ids with equal comps count as linked."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets], np.int64)
    out = []

    def link(i: int, j: int) -> None:
        a, b = root(comps[i]), root(comps[j])
        if a != b:
            parent[a] = b
            out.append((ids[i], ids[j]))

    g = len(ids)
    if g <= 6:
        for i in range(g):
            for j in range(i + 1, g):
                lo, hi = sorted((int(sizes[i]), int(sizes[j])))
                if 100 * lo >= percent * hi and root(comps[i]) != root(comps[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (lo + hi - both):
                        link(i, j)
        return out
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(g), sizes)
    _, number, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[number] > 1
    number, owner = number[shared], owner[shared]
    _, number = np.unique(number, return_inverse=True)
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    inter = np.zeros((g, g), np.float32)
    columns = int(number[-1]) + 1 if len(number) else 0
    for at in range(0, columns, 4096):
        lo, hi = np.searchsorted(number, (at, at + 4096))
        part = np.zeros((g, min(4096, columns - at)), np.float32)
        part[owner[lo:hi], number[lo:hi] - at] = 1
        inter += part @ part.T
    inter = inter.astype(np.int64)
    i, j = np.nonzero(np.triu(100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter), 1))
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        link(a, b)
    return out


def _compare(tasks: DataFrame, percent: int) -> DataFrame:
    """(u, v) links found within each task; a row: task, rep, comp, members (the set's bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids, comps, sets = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1 and (found := _links(ids, sets, comps, percent)):
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            for t, rep, comp, raw in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if t != task:
                    yield from close()
                    task, ids, comps, sets = t, [], [], []
                ids.append(rep)
                comps.append(comp)
                sets.append(np.frombuffer(raw, _U))
        yield from close()

    dealt = tasks.select("task", "rep", "comp", "members").repartition("task").sortWithinPartitions("task", "rep")
    return dealt.mapInArrow(run, "u bigint, v bigint")


def _sets(docs: DataFrame, members: DataFrame, width: int, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """rep, family, members of the families' representatives, their sets made anew from whole texts."""
    if members.count() <= broadcast_ids:
        members = F.broadcast(members)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("rep"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text")).join(members, ["rep", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(raw or b"", width).tobytes() for raw in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["rep", "family", "members"])

    return rows.select("rep", "family", "text").mapInArrow(run, "rep bigint, family bigint, members binary")


def _all_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect what full sets connect, within families."""
    sizes = sets.groupBy("family").agg(F.countDistinct("rep").alias("n")).select("family", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    cut = sets.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")))
    # every block meets itself and the first one
    first = F.when(F.col("block") == 0, F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).otherwise(F.array("block"))
    tasks = cut.withColumn("t", F.explode(first)).select(F.xxhash64("family", "t").alias("task"), "rep", F.col("rep").alias("comp"), "members")
    found = settle(_compare(tasks, percent), "links")
    large = sizes.where("blocks > 1")
    if large.isEmpty():
        return found
    comps = connected_components(found).select(F.col("id").alias("rep"), "component")
    ids = sets.select("rep", "family").distinct().join(large, "family").join(comps, "rep", "left").select("rep", "family", F.coalesce("component", "rep").alias("comp"))
    ids = settle(ids, "parts")
    best = ids.groupBy("family", "comp").count().groupBy("family").agg(F.max_by("comp", F.struct("count", "comp")).alias("giant"), F.max("count").alias("inside"), F.sum("count").alias("n")).where("inside < n")
    best = best.select("family", "giant", F.ceil(F.col("inside") / BLOCK).alias("g"), F.ceil((F.col("n") - F.col("inside")) / BLOCK).alias("r"))
    rest = ids.join(best, "family").join(sets.select("rep", "members"), "rep")
    number = lambda k: F.pmod(F.xxhash64("rep", F.lit(2)), F.col(k))
    upto = lambda k: F.sequence(F.lit(0).cast("bigint"), F.col(k) - 1)
    inside = rest.where("comp = giant").withColumn("j", number("g")).withColumn("i", F.explode(upto("r"))).withColumn("kind", F.lit("g"))
    outside = rest.where("comp <> giant").withColumn("b", number("r"))
    with_giant = outside.withColumn("i", F.col("b")).withColumn("j", F.explode(upto("g"))).withColumn("kind", F.lit("g"))
    among = outside.withColumn("o", F.explode(upto("r"))).withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o")).withColumn("kind", F.lit("r"))
    parts = [x.select(F.xxhash64("family", "kind", "i", "j").alias("task"), "rep", "comp", "members") for x in (inside, with_giant, among)]
    return found.unionByName(_compare(parts[0].unionByName(parts[1]).unionByName(parts[2]), percent))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, hot: int = HOT, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets; a component's smallest id is kept.
    """
    sigs = settle(signatures(docs, width, percent), "signatures")
    classes = sigs.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("first").alias("first"), F.first("second").alias("second"))
    classes = settle(classes.select("sig", F.col("rep.doc_id").alias("rep"), F.col("rep.th").alias("th"), "first", "second"), "classes")
    keyed = classes.select("rep", "second", F.posexplode("first").alias("i", "k")).select("rep", "second", F.xxhash64("i", "k").alias("key"))
    family = connected_components(_cell_edges(keyed, hot, broadcast_ids), "rep", "leader").select(F.col("id").alias("rep"), F.col("component").alias("family"))
    members = settle(classes.select("rep", "th").join(family, "rep"), "families")
    sets = settle(_sets(docs, members, width, broadcast_ids), "sets")
    labels = connected_components(_all_links(sets, percent)).select(F.col("id").alias("rep"), "component")
    named = classes.select("sig", "rep").join(labels, "rep", "left").select("sig", F.coalesce("component", "rep").alias("component"))
    out = sigs.select("doc_id", "n_shingles", "sig").join(named, "sig", "left")
    component = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component"))).alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents, three words, 85 %."""
    return near_duplicates(table(tune(spark), sf_dir, "documents"), 3, 85)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group one document stays, that with the smallest id."""
    found = near_duplicates(docs)
    gone = settle(found.where("not kept").select("doc_id"), "gone")
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    out = base.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        return out
    # rows with equal ids: the first of each text and id stays
    some, none = out.where("doc_id is not null"), out.where("doc_id is null")
    return some.dropDuplicates(["doc_id", "text"]).unionByName(none)
