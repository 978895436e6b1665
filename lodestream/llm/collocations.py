"""Phrase collocations, mined over a prefix-free parse.

Texts are cut into pieces, and pieces into chunks: wherever a hash of the last max_words - 1 words says so, a chunk ends and the next
begins with those same words. So no chunk is the beginning of another, and a phrase of up to max_words words lies wholly in one
chunk at least. The distinct chunks of a language with their numbers of occurrences are the dictionary, and all counting is done
inside them, weighted: a passage that a thousand documents share is looked at once. A phrase that lies wholly in a chunk's first
max_words - 1 words stands in the chunk before, too, and is counted there; a piece's first chunk has none before it.

Phrases are counted level by level. For each length but the longest, 64-bit hashes of phrases are counted, summed inside tasks first; those
that reach `least` set bits of a filter of bounded size, and a phrase of one more word is looked at only if both its parts are in
it. A filter that is too small, and two phrases with one hash, only let more phrases through: the last pass counts exact
phrases. Beyond FILTER_BITS / 16 frequent phrases of a length filters lose force and more is shuffled, but nothing changes.

Everything else is joins and sums over phrases that occur `least` times. Ranks come from a range partition and running counts per
partition, so a language that holds most phrases is no hot group.

Defined results: null and empty text have no words and give nothing; a null lang is `und`, together with rows that say so; documents that are
the same row count each; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.session import settle, table, tune

MAX_WORDS, LEAST, TOP = 4, 30, 2000
SCALE, COVERED_PERCENT = 2_000_000, 80
#: A chunk ends at one window of words in so many.
ONE_IN = 16
FILTER_BITS = 1 << 26
PROBES = 3
#: What a task holds at most before it gives partial sums: distinct words, chunks, phrases; and how many chunks make a block.
MOST_WORDS, MOST_CHUNKS, MOST_PHRASES = 300_000, 200_000, 1_000_000
BLOCK_BYTES = 1 << 20
ROWS_AT_ONCE = 50_000
BLOCK_CHUNKS = 100_000

#: A-Z lower-cased, separators of pieces as line ends, tabs as spaces.
_CLEAN = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BREAK = 1
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Words(dict):
    """Numbers of the words a task has seen, from 2 on; 0 is the empty string, 1 the end of a piece."""

    def __init__(self) -> None:
        super().__init__({b"": 0, b"\n": _BREAK})
        self.text = [b"", b"\n"]
        self._hashes, self._new = np.zeros(2, _U), []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.text)
        self.text.append(word)
        self._new.append(xxhash.xxh3_64_intdigest(word))
        return n

    def hashes(self) -> np.ndarray:
        if self._new:
            self._hashes = np.concatenate([self._hashes, np.array(self._new, _U)])
            self._new = []
        return self._hashes

    def numbers(self, data: bytes) -> np.ndarray:
        """Numbers of words and breaks; data has a space on either side of each."""
        out, at, get = [], 0, self.__getitem__
        while at < len(data):
            end = data.find(b" ", at + BLOCK_BYTES)
            tokens = data[at : end if end >= 0 else len(data)].split(b" ")
            out.append(np.fromiter(map(get, tokens), np.int32, len(tokens)))
            at = end + 1 if end >= 0 else len(data)
        ids = np.concatenate(out) if out else np.zeros(0, np.int32)
        return ids[ids > 0]


def cut(ids: np.ndarray, hashes: np.ndarray, overlap: int, one_in: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and whether it is its piece's first, of the chunks of words and breaks."""
    n = len(ids)
    word = ids > _BREAK
    after_break = np.r_[True, ~word[:-1]] if n else np.zeros(0, bool)
    before_break = np.r_[~word[1:], True] if n else np.zeros(0, bool)
    ends_here = np.zeros(n, bool)
    if n >= overlap:
        h, whole = np.zeros(n - overlap + 1, _U), np.ones(n - overlap + 1, bool)
        for k in range(overlap):
            own = slice(k, n - overlap + 1 + k)
            h = _mixed(h + hashes[ids[own]]) * _U(2 * k + 3)
            whole &= word[own]
        ends_here[overlap - 1 :] = whole & (_mixed(h) % _U(one_in) == 0)
    go_on = ends_here & ~before_break
    first = word & after_break
    begin = np.flatnonzero(first | np.r_[False, go_on[:-1]]) if n else np.zeros(0, np.int64)
    end = np.flatnonzero(word & (before_break | go_on)) + 1
    is_first = first[begin]
    return np.where(is_first, begin, begin - overlap), end, is_first


def _spread(by: dict[str, list[bytes]]) -> Iterator[tuple[str, bytes]]:
    for lang, parts in by.items():
        yield lang, b" \n ".join(parts)


def chunks(docs: DataFrame, max_words: int = MAX_WORDS, one_in: int = ONE_IN) -> DataFrame:
    """The dictionary: lang, first, chunk (words joined by a space) and n, how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = Words(), {}

        def given() -> Iterator[pa.RecordBatch]:
            text = words.text
            for (lang, first), counts in found.items():
                keys = list(counts)
                for at in range(0, len(keys), ROWS_AT_ONCE):
                    own = keys[at : at + ROWS_AT_ONCE]
                    made = pa.array([b" ".join([text[i] for i in np.frombuffer(k, np.int32)]) for k in own], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array([first] * len(own)), made, pa.array([counts[k] for k in own], pa.int64())], ["lang", "first", "chunk", "n"])
            found.clear()

        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    by.setdefault(lang, []).append(text.translate(_CLEAN).replace(b"\n", b" \n "))
            for lang, data in _spread(by):
                ids = words.numbers(data)
                raw = ids.tobytes()
                starts, ends, firsts = cut(ids, words.hashes(), max_words - 1, one_in)
                for first in (False, True):
                    own = firsts == first
                    found.setdefault((lang, first), Counter()).update([raw[4 * a : 4 * b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
            if sum(map(len, found.values())) > MOST_CHUNKS or len(words.text) > MOST_WORDS:
                yield from given()
                if len(words.text) > MOST_WORDS:
                    words = Words()
        yield from given()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, first boolean, chunk string, n bigint").groupBy("lang", "first", "chunk").agg(F.sum("n").alias("n"))


_BLOCK = [("lang", pa.string()), ("words", pa.binary()), ("hashes", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("firsts", pa.binary()), ("n", pa.binary())]
_BLOCK_DDL = "lang string, words binary, hashes binary, ids binary, sizes binary, firsts binary, n binary"


def blocks(dictionary: DataFrame) -> DataFrame:
    """The dictionary cut into words once for all passes: a row holds many chunks of one language as numbers of the row's own words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[bool, bytes, int]]] = {}
        rows = 0

        def given() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                words = Words()
                ids = words.numbers(b" \n ".join(r[1] for r in own))
                word = ids > _BREAK
                sizes = np.diff(np.flatnonzero(np.r_[True, ~word, True])) - 1
                columns = (b"\n".join(words.text[2:]), words.hashes()[2:].tobytes(), (ids[word] - 2).tobytes(), sizes.astype(np.int32).tobytes(), np.array([r[0] for r in own], np.uint8).tobytes(), np.array([r[2] for r in own], np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([lang]), *[pa.array([c], pa.binary()) for c in columns]], [n for n, _ in _BLOCK])
            held.clear()

        for batch in batches:
            for lang, *own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                held.setdefault(lang, []).append(own)
            rows += len(batch)
            if rows >= BLOCK_CHUNKS:
                yield from given()
                rows = 0
        yield from given()

    return dictionary.select("lang", "first", "chunk", "n").mapInArrow(run, _BLOCK_DDL)


class Grams:
    """A block's words in a row, with each word's place in its chunk, weight, and hashes of the phrases that begin at it."""

    def __init__(self, row: dict, overlap: int):
        self.lang, self.text = row["lang"], row["words"].split(b"\n")
        self.ids, size = np.frombuffer(row["ids"], np.int32), np.frombuffer(row["sizes"], np.int32)
        own = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(own)) - (np.cumsum(size) - size)[own]
        skip = np.where(np.frombuffer(row["firsts"], np.uint8), 0, overlap)
        self.n = np.frombuffer(row["n"], np.int64)[own]
        self.left, self.new = size[own] - place, place - skip[own]
        self.hash_of = np.frombuffer(row["hashes"], _U)
        self.of_word = _mixed(self.hash_of + _U(xxhash.xxh3_64_intdigest(self.lang.encode())))
        self.hashes = [self.of_word[self.ids]]

    def hash(self, n: int) -> np.ndarray:
        """Hashes of the phrases of n words that begin at each word; those that run over the chunk mean nothing."""
        while len(self.hashes) < n:
            k = len(self.hashes)
            more = np.r_[self.hash_of[self.ids[k:]], np.zeros(min(k, len(self.ids)), _U)]
            self.hashes.append(_mixed(self.hashes[-1] * _U(0x100000001B3) + more + _U(k)))
        return self.hashes[n - 1]

    def counted(self, n: int) -> np.ndarray:
        """Where a phrase of n words begins that lies in its chunk, and not wholly in what the chunk before has."""
        return np.flatnonzero((self.left >= n) & (self.new + n > 0))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The block's words that are counted, and how often they occur."""
        at = self.counted(1)
        (ids,), n = summed([self.ids[at]], self.n[at])
        return ids, n


def among(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have all their bits set; the filter's size is a power of two."""
    low, step, on = h & _U(0xFFFFFFFF), h >> _U(32) | _U(1), np.ones(len(h), bool)
    for k in range(PROBES):
        at = (low + step * _U(k)) & _U(64 * len(bits) - 1)
        on &= (bits[at >> _U(6)] >> (at & _U(63)) & _U(1)).astype(bool)
    return on


def filter_of(hashes: DataFrame, most_bits: int = FILTER_BITS) -> np.ndarray:
    """The filter of a table of hashes: made in tasks; its words, most_bits / 64 at most, come to the driver and go to all tasks."""
    size = min(most_bits, 1 << max(10, (16 * hashes.count() - 1).bit_length()))
    low, step = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("h", 32).bitwiseOR(F.lit(1).cast("bigint"))
    at = F.explode(F.array(*[(low + step * k).bitwiseAND(F.lit(size - 1).cast("bigint")) for k in range(PROBES)]))
    made = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toPandas()
    out = np.zeros(size // 64, np.int64)
    out[made["word"].to_numpy(np.int64)] = made["bits"].to_numpy(np.int64)
    return out.view(_U)


def summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys with the sum of n."""
    if not len(n):
        return keys, n
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0])
    keys, n = [k[order] for k in keys], n[order]
    new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], 0)]
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(n, at)


class _Sums:
    """Sums by keys, put together whenever so many rows have come in."""

    def __init__(self, most: int):
        self.most, self.parts, self.rows = most, [], 0

    def add(self, keys: list[np.ndarray], n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.rows += len(n)

    def take(self) -> tuple[list[np.ndarray], np.ndarray]:
        parts, self.parts, self.rows = self.parts, [], 0
        if not parts:
            return [], np.zeros(0, np.int64)
        return summed([np.concatenate(k) for k in zip(*[p[0] for p in parts], strict=True)], np.concatenate([p[1] for p in parts]))

    def full(self) -> bool:
        """Whether there are too many distinct keys to go on."""
        if self.rows <= 2 * self.most:
            return False
        self.add(*self.take())
        return self.rows > self.most


def frequent(packed: DataFrame, n: int, below: np.ndarray | None, least: int, max_words: int) -> DataFrame:
    """h: hashes of phrases of n words that occur `least` times; below is the filter of those of n - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(MOST_PHRASES)

        def given() -> Iterator[pa.RecordBatch]:
            keys, many = sums.take()
            for at in range(0, len(many), ROWS_AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array(keys[0][at : at + ROWS_AT_ONCE].view(np.int64)), pa.array(many[at : at + ROWS_AT_ONCE])], ["h", "n"])

        for batch in batches:
            for row in batch.to_pylist():
                g = Grams(row, max_words - 1)
                if n == 1:
                    ids, many = g.words()
                    sums.add([g.of_word[ids]], many)
                else:
                    at, h = g.counted(n), g.hash(n - 1)
                    at = at[among(below, h[at])]
                    at = at[among(below, h[at + 1])]
                    sums.add([g.hash(n)[at]], g.n[at])
                if sums.full():
                    yield from given()
        yield from given()

    return packed.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")


def counts(packed: DataFrame, filters: list[np.ndarray], least: int, max_words: int) -> DataFrame:
    """lang, words, phrase, a: exact numbers of the phrases that occur `least` times; words 0 has the language's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = Words(), {}

        def given() -> Iterator[pa.RecordBatch]:
            text = words.text
            for (lang, n), own in sums.items():
                keys, many = own.take()
                for at in range(0, len(many), ROWS_AT_ONCE):
                    ids = np.stack([part for k in keys for part in (k[at : at + ROWS_AT_ONCE] >> 32, k[at : at + ROWS_AT_ONCE] & 0xFFFFFFFF)], 1)[:, :n].tolist() if n else [[]]
                    made = pa.array([b" ".join([text[i] for i in row]) for row in ids], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids)), pa.array([n] * len(ids), pa.int32()), made, pa.array(many[at : at + ROWS_AT_ONCE])], ["lang", "words", "phrase", "a"])
            sums.clear()

        for batch in batches:
            for row in batch.to_pylist():
                g = Grams(row, max_words - 1)
                own = np.fromiter(map(words.__getitem__, g.text), np.int64, len(g.text))
                for n in range(max_words + 1):
                    to = sums.setdefault((g.lang, n), _Sums(MOST_PHRASES))
                    if n < 2:
                        ids, many = g.words()
                        if n:
                            on = among(filters[0], g.of_word[ids])
                            to.add([own[ids[on]] << 32], many[on])
                        else:
                            to.add([np.zeros(1, np.int64)], np.array([many.sum()]))
                        continue
                    at = g.counted(n)
                    for k, h in [(0, g.hash(n))] if n < max_words else [(0, g.hash(n - 1)), (1, g.hash(n - 1))]:
                        at = at[among(filters[min(n, max_words - 1) - 1], h[at + k])]
                    part = [own[g.ids[at + k]] for k in range(n)] + [np.zeros(len(at), np.int64)] * (n % 2)
                    to.add(*summed([a << 32 | b for a, b in zip(part[::2], part[1::2], strict=True)], g.n[at]))
                full = [s.full() for s in sums.values()]
                if any(full) or sum(s.rows for s in sums.values()) > 3 * MOST_PHRASES or len(words.text) > MOST_WORDS:
                    yield from given()
                    if len(words.text) > MOST_WORDS:
                        words = Words()
        yield from given()

    rows = packed.mapInArrow(run, "lang string, words int, phrase string, a bigint")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | (F.col("words") == 0))


def _decimal(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def scores(phrases: DataFrame, scale: int = SCALE) -> DataFrame:
    """lang, phrase, a, l, r, score of each phrase of two words or more, by its lowest-scoring cut; the first of equal ones."""
    k = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = phrases.where("words > 1").select("lang", "phrase", "words", "a", k)
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first_part"), F.expr("substring_index(phrase, ' ', k - words)").alias("rest"))
    part = lambda name, n: phrases.where("words > 0").select(F.col("lang"), F.col("phrase").alias(name), F.col("a").alias(n))
    both = cuts.join(part("first_part", "l"), ["lang", "first_part"]).join(part("rest", "r"), ["lang", "rest"])
    # of counts that are at least a, so the score fits; the product is of 19 + 10 digits
    both = both.withColumn("_a", F.lit(scale).cast("decimal(10,0)") * _decimal("a")).withColumn("_lr", _decimal("l") + _decimal("r"))
    best = both.withColumn("score", F.expr("CAST(_a div _lr AS BIGINT)")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", F.col("best")["l"].alias("l"), F.col("best")["r"].alias("r"), F.col("best")["score"].alias("score"))


def not_covered(scored: DataFrame, phrases: DataFrame, percent: int = COVERED_PERCENT) -> DataFrame:
    """Without phrases whose words stand inside a longer phrase that occurs at least percent as often."""
    inside = phrases.where("words > 2").select("lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inside = inside.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.col("size"), F.col("words"))).alias("end"))
    inside = inside.select("lang", F.expr("substring_index(substring_index(phrase, ' ', end), ' ', -size)").alias("phrase"), "a")
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.coalesce(100 * _decimal("longer") >= percent * _decimal("a"), F.lit(False))
    return scored.join(longer, ["lang", "phrase"], "left").where(~covered).drop("longer")


def first_of(rows: DataFrame, by: str, order: list[Column], top: int) -> DataFrame:
    """The first `top` rows of each value of `by`, with their rank from 1: ranks are a partition's running counts on a range partition."""
    sorts = [F.col(by), *order]
    placed = settle(rows.repartitionByRange(*sorts).sortWithinPartitions(*sorts).withColumn("at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy(by, "part").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("low"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(by, "part", "low", before.alias("before"))
    return placed.join(parts, [by, "part"]).withColumn("rank", F.col("before") + F.col("at") - F.col("low") + 1).where(F.col("rank") <= top).drop("at", "part", "low", "before")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP, one_in: int = ONE_IN, most_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases of 2 to max_words words."""
    if max_words < 2:
        raise ValueError(max_words)
    packed = settle(blocks(chunks(docs, max_words, one_in)), "chunks")
    filters: list[np.ndarray] = []
    for n in range(1, max_words):
        filters.append(filter_of(settle(frequent(packed, n, filters[-1] if filters else None, least, max_words), "frequent"), most_bits))
    phrases = settle(counts(packed, filters, least, max_words), "phrases")
    rows = not_covered(scores(phrases), phrases)
    best = first_of(rows, "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], top)
    total = phrases.where("words = 0").select("lang", F.col("a").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: each language's first 2000 phrases of all documents."""
    return collocations(table(tune(spark), sf_dir, "documents"))


OP12_SQL = """WITH pieces AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0b\\x0c\\r]')) AS piece FROM documents)),
  total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
  grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 5) AS t(k) WHERE len(w) >= k)),
  f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
  cuts AS (SELECT lang, phrase, k, a, c, string_split(phrase, ' ') AS w FROM (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k > 1)),
  scored AS (SELECT u.lang, u.phrase, u.k, u.a, u.c, x.a AS l, y.a AS r, CAST((2000000::HUGEINT * u.a) // (x.a::HUGEINT + y.a) AS BIGINT) AS score FROM cuts u
    JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:u.c], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[u.c + 1:u.k], ' ')),
  best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
  longer AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM (SELECT lang, string_split(phrase, ' ') AS w, k, a, unnest(range(2, k)) AS s FROM f WHERE k > 2)) GROUP BY ALL),
  kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.longer IS NULL OR 100::HUGEINT * g.longer < 80::HUGEINT * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept) JOIN total USING (lang) WHERE rank <= 2000"""
