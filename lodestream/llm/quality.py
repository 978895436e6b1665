"""Quality rules: cross-document line frequency, besides per-document counts.

Lines are normalised (A-Z lower-cased, white space squeezed) and hashed. For every host, here the documents' source, the
distinct documents that hold a line are counted, and lines above a limit are removed; a document left with
too small a share of its words is rejected. The limit is a share of the host's distinct documents, so that it means the same on
a host of a thousand and of a billion documents, but never below a least number.

Copies must not count as many documents: a page copied a thousand times is not boilerplate, and one of the
copies should stay. So documents are told apart by the set of their normalised lines, however many copies there are. Near
copies differ in a line, so they are different documents here.

Defined results: null text has no words and fails the base rule; an empty source and a null one are different hosts;
repeated rows are copies; documents of the same single line count once. No table is needed beyond the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.session import settle, table, tune

#: Different documents of one host that may hold a line: this share of them, or this number where that is more.
MAX_SHARE = 0.002
MAX_DOCUMENTS = 20
#: Share of its words that a document must keep.
MIN_LEFT = 0.2
#: Up to so many removed lines are handed to all tasks (8 bytes each); more are joined.
BROADCAST_LINES = 500_000

SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _signed(key: int) -> int:
    return key - (1 << 64) if key >= 1 << 63 else key


def host_key(host: bytes | None) -> int:
    """64-bit hash of a host."""
    return 1 if host is None else xxhash.xxh64_intdigest(host, 2)


def line_key(host: bytes | None, line: bytes) -> int:
    """64-bit signed hash of a line under its host; line holds a word."""
    return _signed(xxhash.xxh64_intdigest(b" ".join(line.translate(_LOWER).split()), host_key(host)))


def set_key(keys: set[int]) -> int:
    """64-bit signed hash of a set of line keys."""
    return _signed(xxhash.xxh64_intdigest(np.sort(np.fromiter(keys, np.int64, len(keys))).tobytes(), 3))


def counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = raw.split()
    inner = b"".join(words)
    chars = len(inner) if inner.isascii() else len(inner.decode("utf-8", "replace"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    n = len(words)
    repeat = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    distinct = set(windows)
    if len(distinct) < len(windows):
        number = {w: k for k, w in enumerate(distinct)}
        at = np.fromiter(map(number.__getitem__, windows), np.int64, len(windows))
        twice = np.bincount(at)[at] > 1
        covered = np.zeros(n, bool)
        for d in range(3):
            covered[d : d + len(at)] |= twice
        repeat = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeat


def _lines(docs: DataFrame) -> DataFrame:
    """(host, line, doc): a document's host, each of its distinct lines, and a key of the set of its lines.

    One more row a document has line null; it stands for the document itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys, owners = [], [], []
            for host, raw in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own: set[int] = {line_key(host, x) for x in (raw or b"").split(b"\n") if x and not x.isspace()}
                if own:
                    keys.extend([None, *own])
                    hosts.extend([_signed(host_key(host))] * (len(own) + 1))
                    owners.extend([set_key(own)] * (len(own) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hosts, keys, owners)], ["host", "line", "doc"])

    return docs.select(F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, "host bigint, line bigint, doc bigint")


def common_lines(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """Keys of the lines above the limit: (line, documents).

    Counted in two steps with partial sums, so a line of a third of all documents is no hot group: rows of one line and one
    document become one before and after the first shuffle, and are summed before the second. Only lines above the least
    number meet the counts of their hosts.
    """
    counted = settle(_lines(docs).distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")).where((F.col("documents") > max_documents) | F.col("line").isNull()), "counted")
    hosts = counted.where("line is null").select("host", F.col("documents").alias("all"))
    return counted.where("line is not null").join(hosts, "host").where(F.col("documents") > max_share * F.col("all")).select("line", "documents")


_OUT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_removed_lines bigint, words_left bigint, base_failed boolean, kept boolean"


def _judge(host: bytes | None, raw: bytes, removed, min_left: float):
    n, chars, symbols, dup, repeat = counts(raw)
    gone, text = 0, None
    left = n
    if removed is not None and len(removed):
        stay = []
        for line in raw.split(b"\n"):
            if line and not line.isspace() and line_key(host, line) in removed:
                gone += 1
                left -= len(line.split())
            else:
                stay.append(line)
        if gone:
            text = b"\n".join(stay)
    failed = n < 50 or 100 * repeat > 50 * n
    return (n, chars, symbols, dup, repeat, gone, left, failed, not failed and left >= min_left * n), raw if text is None else text


def judge_documents(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, with_text: bool = False, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """doc_id and the columns of _OUT for every document; with_text adds lang, source and the text that is left."""
    spark = docs.sparkSession
    common = settle(common_lines(docs, max_documents, max_share).select("line"), "lines")
    base = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"),
        *([F.col("lang").cast("string").alias("lang")] if with_text else []),
    )
    few = None
    if common.count() <= broadcast_lines:
        few = spark.sparkContext.broadcast(frozenset(r.line for r in common.collect()))
    else:
        # too many lines to hand out: each document meets its own by a join on the line, split where a line is hot
        key = F.xxhash64("doc_id", "source", "text")
        base = base.withColumn("doc_key", key)
        own = _own_lines(base).join(common, "line").groupBy("doc_key").agg(F.collect_set("line").alias("removed"))
        base = base.join(own, "doc_key", "left").drop("doc_key")
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {c: batch.column(k) for k, c in enumerate(names)}
            hosts = of["source"].cast(pa.binary()).to_pylist()
            texts = of["text"].cast(pa.binary()).to_pylist()
            lists = of["removed"].to_pylist() if few is None else None
            rows, left = [], []
            for k, raw in enumerate(texts):
                row, text = _judge(hosts[k], raw or b"", few.value if few is not None else set(lists[k] or ()), min_left)
                rows.append(row)
                left.append(None if raw is None else text)
            kinds = [pa.int64()] * 7 + [pa.bool_()] * 2
            cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            head = [of["doc_id"]]
            if with_text:
                head += [pa.array(left, pa.binary()).cast(pa.string()), of["lang"], of["source"]]
            yield pa.RecordBatch.from_arrays(head + cols, [f"c{k}" for k in range(len(head) + len(cols))])

    head = "doc_id bigint, " + ("text string, lang string, source string, " if with_text else "")
    return base.mapInArrow(run, head + _OUT)


def _own_lines(base: DataFrame) -> DataFrame:
    """(doc_key, line) of each document's distinct lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = [], []
            for d, host, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                own = {line_key(host, x) for x in (raw or b"").split(b"\n") if x and not x.isspace()}
                keys.extend(own)
                docs.extend([d] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.int64())], ["doc_key", "line"])

    return base.select("doc_key", "source", "text").mapInArrow(run, "doc_key bigint, line bigint")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: counts and verdict of every whole text of documents."""
    return judge_documents(table(tune(spark), sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: lines above the limit go, and so do documents that the rules reject."""
    left = judge_documents(docs, with_text=True).where("kept")
    return left.select("doc_id", "text", "lang", "source", F.char_length("text").cast("bigint").alias("n_chars"))
