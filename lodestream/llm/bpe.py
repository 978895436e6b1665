"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word starts as single symbols. The leaves of a segment tree hold, for every adjacent pair, the key
``rank << 32 | position`` (or a large value when the pair cannot be merged); an inner node holds the smaller key of its
children, so the root is the lowest rank and, among equal ranks, the leftmost pair. A merge changes at most
three leaves, each repaired in O(log n), until the root says that no pair is left. A word of n symbols takes
O(n log n), so one very long word is no trouble.

Defined results: null text is encoded as the empty text (no ids); texts are encoded whole; repeated rows each
give a row; special tokens of the vocabulary that stand in a text become their ids, as the tokenizers library
has it. Input columns other than the id and the text are not touched, so clashing names do no harm.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.session import table, tune

_NONE = 1 << 62
#: Pieces of text kept per Python worker; beyond that the memory is emptied and filled anew. Only speed depends on it.
CACHE_WORDS = 250_000
#: Words of up to so many bytes are encoded many at a time.
CACHE_BYTES = 64


def merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge symbol ids by rank; ranks maps a pair to (rank, merged id)."""
    n = len(symbols) - 1
    if n < 1:
        return symbols
    width = 1 << (n - 1).bit_length() if n > 1 else 1
    tree = [_NONE] * (2 * width)
    get = ranks.get
    for i in range(n):
        found = get((symbols[i], symbols[i + 1]))
        if found:
            tree[width + i] = found[0] << 32 | i
    for node in range(width - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    if tree[1] == _NONE:
        return symbols
    symbols = symbols[:]
    after = list(range(1, n + 2))
    before = list(range(-1, n))
    alive = bytearray(b"\1") * (n + 1)

    def put(i: int, key: int) -> None:
        node = width + i
        if tree[node] == key:
            return
        tree[node] = key
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            key = a if a < b else b
            if tree[node] == key:
                return
            tree[node] = key

    while (top := tree[1]) != _NONE:
        i = top & 0xFFFFFFFF
        j = after[i]
        symbols[i] = get((symbols[i], symbols[j]))[1]
        alive[j] = 0
        k = after[i] = after[j]
        if j < n:
            put(j, _NONE)
        if k <= n:
            before[k] = i
            found = get((symbols[i], symbols[k]))
            put(i, found[0] << 32 | i if found else _NONE)
        else:
            put(i, _NONE)
        h = before[i]
        if h >= 0:
            found = get((symbols[h], symbols[i]))
            put(h, found[0] << 32 | h if found else _NONE)
    return [s for s, a in zip(symbols, alive, strict=True) if a]


def byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


def merge_many(symbols: np.ndarray, ranks: PairRanks) -> np.ndarray:
    """Merge many short words at once: one segment tree per row, all advanced in step.

    symbols is (words, symbols) padded with -1 at the end; the result has -1 in place of what was merged away.
    """
    words, columns = symbols.shape
    width = 1 << max(1, (columns - 2).bit_length())
    tree = np.full((words, 2 * width), _NONE, np.int64)
    tree[:, width : width + columns - 1] = ranks.keys(symbols[:, :-1], symbols[:, 1:], np.arange(columns - 1))
    for node in range(width - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
    out = np.full((words, width + 2), -1, np.int64)  # the last column takes what falls off the end
    out[:, :columns] = symbols
    after = np.tile(np.minimum(np.arange(1, width + 3), width + 1), (words, 1))
    before = np.tile(np.maximum(np.arange(-1, width + 1), -1), (words, 1))
    rows = np.flatnonzero(tree[:, 1] != _NONE)
    while len(rows):
        top = tree[rows, 1]
        i = top & 0xFFFFFFFF
        j = after[rows, i]
        out[rows, i] = ranks.merged[top >> 32]
        out[rows, j] = -1
        k = after[rows, j]
        after[rows, i] = k
        before[rows, k] = i
        h = before[rows, i]
        left = np.maximum(h, 0)
        new = ((i, ranks.keys(out[rows, i], out[rows, k], i)), (j, np.full(len(rows), _NONE)), (left, np.where(h >= 0, ranks.keys(out[rows, left], out[rows, i], left), 0)))
        for at, key in new[:2]:
            on = at < width
            tree[rows[on], width + at[on]] = key[on]
        on = h >= 0
        tree[rows[on], width + left[on]] = new[2][1][on]
        for at, _ in new:
            node = (width + np.minimum(at, width - 1)) >> 1
            while node[0]:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node >>= 1
        rows = rows[tree[rows, 1] != _NONE]
    return out[:, :columns]


class PairRanks:
    """Ranks of pairs for arrays: sorted pair keys, their ranks, and the id each rank makes."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]):
        made = sorted((a << 32 | b, r) for (a, b), (r, _) in ranks.items())
        self.pairs = np.array([x for x, _ in made] + [_NONE], np.int64)
        self.rank = np.array([r for _, r in made] + [0], np.int64)
        self.merged = np.zeros(1 + max((r for r, _ in ranks.values()), default=0), np.int64)
        for r, m in ranks.values():
            self.merged[r] = m

    def keys(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        pair = np.where((a < 0) | (b < 0), -1, a << 32 | b)
        k = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[k] == pair, self.rank[k] << 32 | at, _NONE)


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizer file in JSON."""

    #: The pattern by which byte-level vocabularies of this kind cut a text into words (a fixed value).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, spec: dict):
        import regex

        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("not a byte-level BPE vocabulary without a normalizer")
        vocab = model["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.start = [vocab[letters[b]] for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *special.values()])
        self.bytes_of = [b""] * size
        for word, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in word)
        for word, i in special.items():
            self.bytes_of[i] = word.encode()
        self.pair_ranks = PairRanks(self.ranks)
        self.start_array = np.array(self.start, np.int64)
        self.special = {w: struct.pack("<I", i) for w, i in special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.find = regex.compile(self.PATTERN).findall
        #: Most texts hold only these characters; for them a plainer pattern finds the same words faster.
        self.other = re.compile(r"[^\n -~\u00C0-\u00FF]").search
        letters = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF"
        self.find_plain = re.compile(rf" ?[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^ \n{letters}0-9]+|[ \n]+(?![^ \n])|[ \n]+").findall
        self.pieces: dict[str, bytes] = {}

    def word_ids(self, word: bytes) -> list[int]:
        start = self.start
        return merge([start[b] for b in word], self.ranks)

    def words_ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word: short words together, long ones each with a tree of its own."""
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if 2 <= len(w) <= CACHE_BYTES:
                groups.setdefault(max(4, (len(w) - 1).bit_length() + 1), []).append(k)
            else:
                ids = self.word_ids(w)
                out[k] = struct.pack(f"<{len(ids)}I", *ids)
        for members in groups.values():
            sizes = np.array([len(words[k]) for k in members])
            columns = int(sizes.max())
            symbols = np.full((len(members), columns), -1, np.int64)
            symbols[np.arange(columns) < sizes[:, None]] = self.start_array[np.frombuffer(b"".join(words[k] for k in members), np.uint8)]
            done = merge_many(symbols, self.pair_ranks)
            stays = done >= 0
            packed = done[stays].astype("<u4").tobytes()
            ends = 4 * np.cumsum(stays.sum(1))
            at = 0
            for k, end in zip(members, ends.tolist(), strict=True):
                out[k] = packed[at:end]
                at = end
        return out

    def cut_up(self, text: str) -> list[str]:
        return self.find(text) if self.other(text) else self.find_plain(text)

    def learn(self, words: set[str]) -> None:
        """Encode words that are not known yet."""
        order = list(words)
        self.pieces.update(zip(order, self.words_ids([w.encode() for w in order]), strict=True))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        cut = []
        for text in texts:
            if self.cut and any(s in text for s in self.special):
                parts = [p if p in self.special else self.cut_up(p) for p in self.cut.split(text) if p]
            else:
                parts = [self.cut_up(text)] if text else []
            cut.append(parts)
        out, at = [], 0
        while at < len(cut):  # some texts at a time: what is new in them is encoded together
            size, end = 0, at
            while end < len(cut) and size < CACHE_WORDS:
                size += sum(len(p) for p in cut[end])
                end += 1
            new: set[str] = set()
            for parts in cut[at:end]:
                for p in parts:
                    if not isinstance(p, str):
                        new.update(p)
            known = self.pieces
            new = {w for w in new if w not in known}
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = {x for parts in cut[at:end] for p in parts if not isinstance(p, str) for x in p}
            if new:
                self.learn(new)
            get = known.__getitem__
            for parts in cut[at:end]:
                out.append(b"".join([self.special[p] if isinstance(p, str) else b"".join(map(get, p)) for p in parts]))
            at = end
        return out

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """The vocabulary at path, kept per process. The file must be present on every executor."""
    with open(path, encoding="utf-8") as f:
        return ByteBPE(json.load(f))


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts: (id, ids binary of little-endian u32, n_tokens). One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            ids = bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], [id_col, "ids", "n_tokens"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, ids binary, n_tokens bigint")


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """Decode ids back to text: (id, text). Null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            texts = [bpe.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} {kind}, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        sha = hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for packed in bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()]):
                n.append(len(packed) // 4)
                a.append(sha(packed).hexdigest())
                b.append(sha(bpe.decode(packed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary lies on this machine and, alike, on the executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every whole text of documents, encoded and decoded."""
    return round_trip(table(tune(spark), sf_dir, "documents"), vocabulary_path())
