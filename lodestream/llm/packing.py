"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document's ids and its end id are cut into pieces of at most the sequence's capacity; only longer documents are cut. Pieces are
then packed best-fit decreasing: the longest first, each into the open sequence with the least room that still takes it.

Best-fit decreasing looks at lengths alone, and pieces of one length are alike. So it runs on the histogram of lengths, which has
`capacity` entries at most however many documents there are: a segment tree over remaining capacities finds the tightest open
sequences, and as many pieces of the length as they take go there in one step. A step is a run of the length's pieces, by number.
A sequence holds at most k different lengths with 1 + ... + k <= capacity, and each length opens or splits at most three runs of
equal sequences, so there are at most 3 * capacity * k steps (about a million for 4096), and as a rule a few thousand.

Tasks number their own pieces of each length; running sums over (length, task) make these the numbers of the whole table, a search
among the steps gives sequence and offset. Nothing is sorted or dealt by length, so a length that most pieces have is no hot group.

Defined results: null and empty text have only the end id; documents that are the same row are packed each for itself; a null id
is kept; an empty table gives no pieces. Which of the pieces of one length goes where depends on the tasks that read them.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm.token_file import encoder
from lodestream.session import settle, table, tune

CAPACITY = 4096
#: Bits of a key that hold a piece's number among those of its length; the length takes the rest.
NUMBER_BITS = 40


class RoomTree:
    """Segment tree over remaining capacities: which of them an open sequence has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.size)

    def set(self, room: int, on: bool) -> None:
        at = room + self.size
        self.some[at] = on
        while at > 1:
            at >>= 1
            self.some[at] = self.some[2 * at] | self.some[2 * at + 1]

    def at_least(self, room: int) -> int | None:
        """The least remaining capacity from `room` on."""
        at = room + self.size
        while not self.some[at]:
            while at & 1:  # a right child: go up until there is something on the right
                at >>= 1
            if at == 0:
                return None
            at += 1
        while at < self.size:
            at = 2 * at + (not self.some[2 * at])
        return at - self.size


@dataclass(frozen=True)
class Steps:
    """Runs of pieces: those of `length` numbered from `first` on stand `per` to a sequence, from sequence `sequence` and place `at` on."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    per: np.ndarray
    at: np.ndarray
    n_sequences: int


def best_fit_decreasing(counts: Mapping[int, int], capacity: int) -> Steps:
    """Packs counts[length] pieces of each length, 1 to capacity."""
    tree, open_, steps, n = RoomTree(capacity), defaultdict(list), [], 0

    def leave(room: int, first: int, many: int) -> None:
        if many and room:
            open_[room].append((first, many))
            tree.set(room, True)

    for length in sorted((k for k, c in counts.items() if c), reverse=True):
        given, all_ = 0, counts[length]
        while given < all_:
            room = tree.at_least(length)
            if room is None:  # as many new sequences as the rest needs
                room, first, many = capacity, n, -(-(all_ - given) // (capacity // length))
                n += many
            else:
                first, many = open_[room].pop()
                if not open_[room]:
                    tree.set(room, False)
            per = room // length
            full = min(many, (all_ - given) // per)
            if full:
                steps.append((length, given, first, per, capacity - room))
                given += full * per
                leave(room - per * length, first, full)
            if full < many and given < all_:
                steps.append((length, given, first + full, all_ - given, capacity - room))
                leave(room - (all_ - given) * length, first + full, 1)
                given, full = all_, full + 1
            leave(room, first + full, many - full)
    steps.sort()
    return Steps(*np.array(steps, np.int64).reshape(-1, 5).T, n)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, and its task and number among the task's pieces of its length; with_ids adds ids."""
    names = ["part", "nth", "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
    wide = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words, end, seen = TaskContext.get().partitionId(), encoder(vocabulary), struct.pack("<I", end_id), Counter()
        for batch in batches:
            out = []
            for doc_id, packed in zip(batch.column(0).to_pylist(), words.encode_batch([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = packed + end
                for k, at in enumerate(range(0, len(ids), wide)):
                    own = ids[at : at + wide]
                    length = len(own) // 4
                    out.append((part, seen[length], doc_id, k, at // 4, length, zlib.crc32(own), *[own] * with_ids))
                    seen[length] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "part bigint, nth bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece; with_ids adds ids (little-endian u32)."""
    if not 0 < capacity < 1 << (63 - NUMBER_BITS):
        raise ValueError(capacity)
    rows = settle(pieces(docs, vocabulary, capacity, end_id, with_ids), "pieces")
    counts = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    steps = best_fit_decreasing({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = rows.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"), *["ids"] * with_ids)
    keys = (steps.length << NUMBER_BITS) | steps.first
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            step = np.searchsorted(keys, (length << NUMBER_BITS) | number, "right") - 1
            nth, per = number - steps.first[step], steps.per[step]
            own = pa.array(steps.sequence[step] + nth // per), pa.array(steps.at[step] + nth % per * length)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *own, *batch.columns[6:]], names)

    return numbered.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids and documents (offset, length, doc_id, start) of each sequence, from pack(with_ids=True); a group holds capacity ids at most."""
    own = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias("own"))
    ids = F.unhex(F.array_join(F.transform("own", lambda p: F.hex(p["ids"])), ""))
    return own.select("sequence_id", "n_tokens", ids.alias("ids"), F.transform("own", lambda p: p.dropFields("ids")).alias("documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the pieces of all documents, packed into sequences of 4096 ids."""
    import public_tokenizers

    return pack(table(tune(spark), sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
