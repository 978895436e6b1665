"""Token-ID output in a bit-plane format.

Documents are range-partitioned and sorted by id; each partition becomes one shard of consecutive ids, and many rows with one id lie in
several shards. A shard's ids,
documents one after the other, are cut into blocks of BLOCK_IDS. A block is transposed into byte planes (byte k of every
id) or bit planes (bit k of every id), planes that are all zero are left out, and each plane is compressed with zstandard.

The files are Parquet written by Spark, so a lost executor leaves no half file: one row a block, with the planes in one
column and the chunk index in the others (shard, chunk, first id's place in the shard, number of ids, and the documents' parts
that lie in the block). The index is read without the planes. A document may run over any number of blocks.

Defined results: null and empty text have only the end id; equal ids of documents stand next to each other, in the order of a
hash of their texts, null first; null document ids come first; an empty table gives an empty file.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.session import shared_dir, table, tune

BLOCK_IDS = 1 << 16
LEVEL = 3
CACHE_WORDS = 500_000
WORDS_AT_ONCE = 500
#: A shard holds about so many documents at most.
SHARD_DOCUMENTS = 20_000

#: How a vocabulary's file says that it cuts texts as this module does. Any other vocabulary gets its texts whole.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}

_PART = pa.struct([("doc_no", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("offset", pa.int64()), ("total", pa.int64())])
_CHUNK = pa.schema(
    [("shard", pa.int32()), ("chunk", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int32()), ("mode", pa.string()), ("parts", pa.list_(_PART)), ("plane_no", pa.list_(pa.int32())), ("planes", pa.list_(pa.binary()))]
)
_CHUNK_DDL = "shard int, chunk bigint, first bigint, n_ids int, mode string, parts array<struct<doc_no: bigint, doc_id: bigint, at: int, n: int, offset: bigint, total: bigint>>, plane_no array<int>, planes array<binary>"


class WordEncoder:
    """Ids of whole texts from the tokenizers library, which is asked once for each new word.

    The vocabulary's pattern cuts a text into words that are encoded each by itself; for texts of ASCII and Latin-1
    letters the same cut is made here and words are remembered. All other texts go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        letters = "a-zß-öø-ÿ"
        self.other = re.compile("[^\\t-\\r -~À-ÖØ-öø-ÿ]|<[|]").search
        if not self._cuts_alike(path):
            self.other = re.compile("").search  # found in every text
        self.find = re.compile(rf"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t-\r {letters}0-9]+").findall
        self.known: dict[str, bytes] = {}
        size = self.library.get_vocab_size()
        self.final = np.array([(self.library.id_to_token(k) or "").endswith("</w>") for k in range(size)])

    @staticmethod
    def _cuts_alike(path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        steps = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        split = steps[0].get("pattern") == SPLIT and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        plain = [s.get("type") for s in steps[1:]] == ["ByteLevel"] and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        tokens = all(t["content"].startswith("<|") for t in file.get("added_tokens", []))
        return bool(file.get("normalizer") == NORMALIZER and split and plain and tokens and not file["model"].get("dropout"))

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word: many words are one text for the library, cut again after tokens that end a word."""
        out: list[bytes] = []
        groups = [words[at : at + WORDS_AT_ONCE] for at in range(0, len(words), WORDS_AT_ONCE)]
        for own, e in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.final[ids]) + 1)).tolist()
            raw = ids.tobytes()
            if len(ends) == len(own) and ends[-1] == len(raw):
                out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            else:  # not each word ends in one such token
                out += self.whole(own)
        return out

    def whole(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 200):
            cut = [None if self.other(t) else self.find(t.lower()) for t in texts[at : at + 200]]
            seen = self.known.__contains__
            new = list(set().union(*[filterfalse(seen, c) for c in cut if c]))
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known.clear()
                new = list(set().union(*[c for c in cut if c]))
            if new:
                self.known.update(zip(new, self.words(new), strict=True))
            get = self.known.__getitem__
            for t, c in zip(texts[at : at + 200], cut, strict=True):
                out.append(self.whole([t])[0] if c is None else b"".join(map(get, c)))
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def to_planes(ids: np.ndarray, mode: str, pack: zstandard.ZstdCompressor) -> tuple[list[int], list[bytes]]:
    """Numbers and compressed bytes of the planes that are not all zero."""
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    planes = [np.ascontiguousarray(raw[:, k]) for k in range(4)]
    if mode == "bit":
        planes = [np.packbits(p >> b & 1) for p in planes for b in range(8)]
    on = [k for k, p in enumerate(planes) if p.any()]
    return on, [pack.compress(planes[k].tobytes()) for k in on]


def from_planes(n: int, mode: str, numbers: list[int], planes: list[bytes]) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    unpack = zstandard.ZstdDecompressor()
    for k, packed in zip(numbers, planes, strict=True):
        plane = np.frombuffer(unpack.decompress(packed), np.uint8)
        if mode == "bit":
            raw[:, k // 8] |= np.unpackbits(plane, count=n) << (k % 8)
        else:
            raw[:, k] = plane
    return raw.reshape(-1).view("<u4")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, mode: str = "byte", block_ids: int = BLOCK_IDS, shards: int | None = None) -> DataFrame:
    """Blocks of the documents' ids in ascending doc_id order; one row a block."""
    if mode not in ("byte", "bit"):
        raise ValueError(mode)
    spark = docs.sparkSession
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(docs.count() / SHARD_DOCUMENTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        words, pack = encoder(vocabulary), zstandard.ZstdCompressor(level=LEVEL)
        end = struct.pack("<I", end_id)
        buffer, held, parts = [], 0, []
        chunk, doc_no = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal buffer, held, parts, chunk
            ids = np.concatenate(buffer)
            numbers, planes = to_planes(ids, mode, pack)
            row = {"shard": shard, "chunk": chunk, "first": chunk * block_ids, "n_ids": len(ids), "mode": mode, "parts": parts, "plane_no": numbers, "planes": planes}
            buffer, held, parts, chunk = [], 0, [], chunk + 1
            return pa.RecordBatch.from_pylist([row], _CHUNK)

        for batch in batches:
            for doc_id, packed in zip(batch.column(0).to_pylist(), words.encode_batch([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.frombuffer(packed + end, "<u4")
                at = 0
                while at < len(ids):
                    n = min(len(ids) - at, block_ids - held)
                    parts.append({"doc_no": doc_no, "doc_id": doc_id, "at": held, "n": n, "offset": at, "total": len(ids)})
                    buffer.append(ids[at : at + n])
                    held, at = held + n, at + n
                    if held == block_ids:
                        yield flush()
                doc_no += 1
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows with one id, null ids too, are dealt by their texts, and equal rows, which are alike, by any number
    order = ["doc_id", "h", "place"]
    ordered = rows.withColumns({"h": F.when(F.col("text").isNotNull(), F.xxhash64("text")), "place": F.monotonically_increasing_id()}).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return ordered.select("doc_id", "text").mapInArrow(run, _CHUNK_DDL)


def write_documents(docs: DataFrame, path: str, vocabulary: str, **more) -> None:
    """Write the token file; planes are compressed already, so Parquet does not compress again."""
    pack_documents(docs, vocabulary, **more).write.option("compression", "none").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk index, without reading planes, with each block's place among all ids."""
    index = spark.read.schema(_CHUNK_DDL).parquet(path).select("shard", "chunk", "first", "n_ids", "mode", "parts")
    return index.join(F.broadcast(_bases(index)), "shard").withColumn("start", F.col("base") + F.col("first"))


def _bases(index: DataFrame) -> DataFrame:
    """Number of ids before each shard. One row a shard, so small that one window orders them."""
    sums = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files; with_ids adds ids (little-endian u32)."""
    blocks = spark.read.schema(_CHUNK_DDL).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "doc_no", "doc_id", "place", "offset", "n", "crc", "ids"]
        kinds = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes(row["n_ids"], row["mode"], row["plane_no"], row["planes"]).tobytes()
                out = []
                for p in row["parts"]:
                    own = ids[4 * p["at"] : 4 * (p["at"] + p["n"])]
                    whole = p["n"] == p["total"]
                    out.append((row["shard"], p["doc_no"], p["doc_id"], row["first"] + p["at"], p["offset"], p["n"], zlib.crc32(own) if whole else None, own if with_ids or not whole else None))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    parts = blocks.mapInArrow(run, "shard int, doc_no bigint, doc_id bigint, place bigint, offset bigint, n bigint, crc bigint, ids binary")
    docs = parts.groupBy("shard", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.min("place").alias("place"), F.sum("n").alias("n_tokens"), F.max("crc").alias("crc"),
        F.array_sort(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("offset", "ids")))).alias("pieces"),
    )
    joined = F.array_join(F.transform("pieces", lambda p: F.hex(p["ids"])), "")
    docs = docs.withColumn("ids", F.unhex(joined)).join(F.broadcast(_bases(blocks.select("shard", "n_ids"))), "shard")
    out = docs.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", F.coalesce("crc", F.crc32("ids")).alias("ids_crc32"), "ids")
    return out if with_ids else out.drop("ids")


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents written to a token file in the shared folder and read back."""
    import public_tokenizers

    path = f"{shared_dir(tune(spark))}/tokens-{uuid.uuid4().hex}"
    write_documents(table(spark, sf_dir, "documents"), path, str(public_tokenizers.path("word_bpe_49k.json")))
    return read_documents(spark, path)
