"""Toxicity: a learned lexicon in a trie, matched by Levenshtein automata, with context-window scores.

The lexicon starts from a few common insults (SEEDS) and is learned from labelled rows: words, and stems (the first letters of
words), whose share of toxic documents stands out and which together cover the toxic documents of a bounded sample several times;
a seed that harmless rows use is dropped. It is kept in a trie. A word is
looked up by walking the trie together with the Levenshtein automaton of the word: one edit is allowed for entries of 5 to 7
letters and two beyond, none for shorter ones, and the first letter stays. Learned stems and seeds that no toxic row of the sample
uses are matched exactly, as other words lie too near them; an entry given as a fuzzy stem is matched by the nearest beginning of a word.
Spellings within that distance that harmless rows of the sample use are learned as exceptions.

A hit counts less inside a quotation: between quotation marks, or near a reporting word, within WINDOW words to either
side. A document's evidence is the sum over its hits of entry weight, spelling and context; one logistic curve, fitted on the same
sample (PER_LABEL rows a label, so its prior is the sample's), turns it into a score.

Defined results: null and empty text have no evidence and get the curve's value there; without labelled rows of both
kinds every score is 0; repeated rows each give a row; a document labelled more than once is toxic if any label says so.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.sampling import held_out, sample_by
from lodestream.session import settle, table, tune

#: Rows of each label that the model learns from, at most about so many.
PER_LABEL = 2500
MIN_DOCUMENTS = 3
CHANCE = 0.05
#: Log of the odds ratio that an entry has to have.
LEAST_ODDS = 3.0
COVER = 3
#: Toxic and harmless documents that a seed counts for before any row is seen.
SEED_TOXIC, SEED_PLAIN = 3.0, 0.5
WINDOW = 4
FUZZY, QUOTED = 0.7, 0.3
THRESHOLD = 0.3
CACHE_WORDS = 250_000

#: Words by which a text reports what someone else said (fixed).
REPORTING = frozenset("said says saying called calls quote quoted quotes wrote reported word words sagte nannte zitat dit appelle citation dijo llama cita".split())
#: Common insults of four languages, lower case (fixed; general vocabulary, not taken from any table).
SEEDS = tuple(
    "idiot stupid moron loser pathetic worthless trash scum clown disgusting dumb fool imbecile garbage filth filthy jerk bastard bitch asshole retard freak cretin vermin "
    "dumm dumme dummkopf trottel abschaum versager widerlich wertlos blödmann müll erbärmlich ekelhaft arschloch depp blöd idioten dreckig lächerlich "
    "idiote imbécile stupide crétin abruti minable ordure pathétique dégoûtant déchet bouffon débile connard nul salaud répugnant ridicule perdant "
    "idiota estúpido estúpida imbécil tonto basura patético inútil asqueroso payaso perdedor escoria cretino despreciable miserable".split()
)
_MARKS = "\"'«»“”„‘’‹›"
_EDGE = ".,;:!?()[]{}|#%&$*<>-_/\\" + _MARKS
_TOKENS = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Entry:
    """A word of the lexicon, or a stem with which words begin."""

    text: str
    stem: bool
    weight: float
    #: Whether misspellings count, too.
    fuzzy: bool = True

    @property
    def edits(self) -> int:
        return edits(self.text) if self.fuzzy else 0


def edits(entry: str) -> int:
    return 0 if len(entry) < 5 else 1 if len(entry) < 8 else 2


@dataclass
class _Node:
    next: dict[str, _Node] = field(default_factory=dict)
    word: int = -1
    stem: int = -1


class LexiconTrie:
    """Entries in a trie; look up by intersection with the Levenshtein automaton of a word."""

    def __init__(self, entries: Sequence[Entry], exceptions: frozenset[str] = frozenset()):
        self.entries, self.exceptions = list(entries), exceptions
        self.most = max((e.edits for e in self.entries), default=0)
        self.root = _Node()
        halves: set[str] = set()
        ends: set[str] = set()
        for k, e in enumerate(self.entries):
            node = self.root
            for c in e.text:
                node = node.next.setdefault(c, _Node())
            if e.stem:
                node.stem = k
            else:
                node.word = k
            d = e.edits
            if not d:
                halves.add(e.text)
                continue
            # with d edits one of d + 1 parts is whole: the first at the begin, a word's last at the end, others within
            n = len(e.text)
            cut = [n * j // (d + 1) for j in range(d + 2)]
            parts = [e.text[a:b] for a, b in zip(cut, cut[1:], strict=False)]
            halves.add(parts[0])
            ends.update(f"{re.escape(p)}.*" for p in (parts[1:] if e.stem else parts[1:-1]))
            if not e.stem:
                ends.add(f"{re.escape(parts[-1])}$")
        begin = "|".join(map(re.escape, sorted(halves)))
        firsts = "".join(sorted({re.escape(e.text[0]) for e in self.entries if e.edits}))
        end = f"[{firsts}].*(?:{'|'.join(sorted(ends))})" if ends else "(?!)"
        #: Only words that this finds can match; it spares the walk for most.
        self.may = re.compile(f"(?:{begin or '(?!)'})|{end}", re.S).match

    def exact(self, word: str) -> int:
        """The entry that the word is, or the longest stem it begins with; -1 without."""
        node, best = self.root, -1
        for c in word:
            node = node.next.get(c)
            if node is None:
                return best
            if node.stem >= 0:
                best = node.stem
        return node.word if node.word >= 0 else best

    def nearest(self, word: str) -> tuple[int, int]:
        """(entry, edits) of the closest entry within its allowed distance, a stem's to a beginning of the word; (-1, 0) without."""
        if len(word) < 4 or word[0] not in self.root.next:
            return -1, 0
        most = self.most
        tail = word[1:]
        best = (-1, most + 1)
        # a state of the automaton is its row of distances; rows above the limit are dead
        stack = [(self.root.next[word[0]], list(range(len(tail) + 1)))]
        while stack:
            node, row = stack.pop()
            if node.word >= 0 and row[-1] <= self.entries[node.word].edits and row[-1] < best[1]:
                best = (node.word, row[-1])
            if node.stem >= 0 and (d := min(row)) <= self.entries[node.stem].edits and d < best[1]:
                best = (node.stem, d)
            for c, child in node.next.items():
                new = [row[0] + 1]
                for j, x in enumerate(tail):
                    new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != c)))
                if min(new) <= most:
                    stack.append((child, new))
        return best if best[0] >= 0 else (-1, 0)

    def match(self, word: str) -> tuple[int, int]:
        """(entry, edits) by exact match, else by the automaton, exceptions left out; (-1, 0) without a match."""
        if not self.may(word):
            return -1, 0
        if (k := self.exact(word)) >= 0:
            return k, 0
        return (-1, 0) if word in self.exceptions else self.nearest(word)


def clean(token: str) -> str:
    """The word in a token: lower case, without punctuation at its ends."""
    return token.lower().strip(_EDGE)


def terms_of(text: str) -> set[str]:
    """What the lexicon may hold of a text: its words as ``=word`` and their first 3 to 7 letters as ``^stem``."""
    words = {clean(t) for t in _TOKENS.findall(text)}
    out = {"=" + w for w in words if len(w) > 2}
    for n in range(3, 8):
        out.update("^" + w[:n] for w in words if len(w) > n)
    return out


@dataclass(frozen=True)
class ToxicityModel:
    entries: tuple[Entry, ...]
    exceptions: frozenset[str]
    slope: float
    bias: float
    usable: bool

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-(self.slope * np.log1p(evidence) + self.bias)))


class _Weights(dict):
    """Token -> weight; asks once for each token."""

    def __init__(self, ask: Callable[[str], float]):
        self.ask = ask

    def __missing__(self, token: str) -> float:
        weight = self[token] = self.ask(token)
        return weight


class Matcher:
    """Evidence of texts; remembers tokens."""

    def __init__(self, model: ToxicityModel):
        self.trie = LexiconTrie(model.entries, model.exceptions)
        self.known = _Weights(self._weight)

    def _weight(self, token: str) -> float:
        word = clean(token)
        if not word:
            return 0.0
        k, d = self.trie.match(word)
        return self.trie.entries[k].weight * FUZZY**d if k >= 0 else 0.0

    def hits(self, tokens: list[str]) -> list[tuple[int, float, bool]]:
        """(place, weight, quoted) of each hit."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        return [(i, w, self._quoted(tokens, i)) for i, w in enumerate(map(self.known.__getitem__, tokens)) if w]

    @staticmethod
    def _quoted(tokens: list[str], i: int) -> bool:
        near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        if any(clean(t) in REPORTING for t in near):
            return True
        before = any(t[:1] in _MARKS for t in tokens[max(0, i - WINDOW) : i + 1])
        after = any(t.rstrip(".,;:!?")[-1:] in _MARKS and t.rstrip(".,;:!?") for t in tokens[i : i + WINDOW + 1])
        return before and after

    def evidence(self, text: str) -> tuple[float, int, int]:
        """Weighted sum over hits, number of hits, number of quoted ones."""
        found = self.hits(_TOKENS.findall(text))
        return sum(w * (QUOTED if q else 1.0) for _, w, q in found), len(found), sum(q for _, _, q in found)


def choose(incidence: list[tuple[int, list[int]]], terms: list[str]) -> list[int]:
    """Terms that together cover each toxic row COVER times with few harmless ones: greedy, by rows newly covered."""
    pos = [ks for y, ks in incidence if y == 1]
    rows_of: list[list[int]] = [[] for _ in terms]
    for r, ks in enumerate(pos):
        for k in ks:
            rows_of[k].append(r)
    cost = 2.0 * np.bincount([k for y, ks in incidence if y == 0 for k in ks], minlength=len(terms))
    alone = np.array([len(x) for x in rows_of], float)
    need = np.array([min(COVER, len(ks)) for ks in pos])
    fresh = alone.copy()
    free = np.ones(len(terms), bool)
    out: list[int] = []
    # a word is preferred to a stem of it that says the same, a longer stem to a shorter one
    exact = np.array([1.2 if t[0] == "=" else 1 + 0.02 * len(t) for t in terms])
    stems: dict[str, list[int]] = {}
    for c, t in enumerate(terms):
        if t[0] == "^":
            stems.setdefault(t[1:], []).append(c)
    while (need > 0).any():
        gain = np.where(free, fresh - cost, -np.inf)
        k = int(np.argmax(np.where(gain > 0, gain * exact, gain)))
        if gain[k] < max(2, 0.004 * len(pos)):
            break
        out.append(k)
        free[k] = False
        for r in rows_of[k]:
            if need[r] > 0:
                need[r] -= 1
                if need[r] == 0:
                    fresh[pos[r]] -= 1
        # a stem that says little more than a longer entry which begins with it would only catch strangers
        for n in range(1, len(terms[k])):
            for c in stems.get(terms[k][1 : 1 + n], ()):
                if c != k and alone[c] <= 1.2 * alone[k]:
                    free[c] = False
    return out


def fit_curve(evidence: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of the logistic curve over log(1 + evidence), by Newton's method with a light penalty."""
    x = np.stack([np.log1p(evidence), np.ones(len(evidence))], 1)
    w = np.array([1.0, -1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.05 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), grad)
        w = w - np.clip(step, -2, 2)
    return float(max(w[0], 0.0)), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> ToxicityModel:
    """A model from labelled rows that are not held out; at most about per_label rows of each label, distinct texts."""
    spark = docs.sparkSession
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    marks = sample_by(marks.where(~held_out(F.col("doc_id"))), "toxic", per_label)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # the sample is bounded by per_label, so its ids are the side to hand out
    rows = settle(texts.join(F.broadcast(marks), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "toxic")
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return ToxicityModel((), frozenset(), 0.0, 0.0, False)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = list(terms_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(own), pa.int32()), pa.array(own, pa.string())], ["toxic", "term"])

    a, b = F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    weight = F.log((F.col("a") + 0.5) / (sizes[1] + 1)) - F.log((F.col("b") + 0.5) / (sizes[0] + 1))
    share = sizes[1] / (sizes[0] + sizes[1])
    counted = settle(rows.select("toxic", "text").mapInArrow(terms, "toxic int, term string").groupBy("term").agg(a, b).where((F.col("a") + F.col("b") >= MIN_DOCUMENTS) | F.col("term").isin(["=" + w for w in SEEDS])), "terms")
    # so many terms are tried that some stand out by chance: the log-likelihood ratio has to outweigh their number
    n = F.col("a") + F.col("b")
    part = lambda x, q: F.when(x > 0, x * F.log(x / (n * q))).otherwise(0.0)
    ratio = 2 * (part(F.col("a"), share) + part(F.col("b"), 1 - share))
    enough = n >= MIN_DOCUMENTS
    bar = 2 * np.log(max(1, counted.where(enough).count()) / CHANCE)
    good = counted.withColumn("w", weight).where(enough & (ratio > float(bar)) & (F.col("w") > LEAST_ODDS))
    # bounded as the sample is: a term stands in MIN_DOCUMENTS of its rows at least
    found = good.orderBy(F.desc(F.col("a") * F.col("w")), "term").collect()
    names = [r.term for r in found]
    number = {t: k for k, t in enumerate(names)}

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = [sorted(number[t] for t in terms_of(x) if t in number) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ks, pa.list_(pa.int32()))], ["toxic", "ks"])

    incidence = sorted((r.toxic, r.ks) for r in rows.select("toxic", "text").mapInArrow(marked, "toxic int, ks array<int>").collect())
    picked = choose(incidence, names) if names else []
    entries = [Entry(names[k][1:], names[k][0] == "^", min(3.0, found[k].w / 2), names[k][0] != "^") for k in picked]
    seen = {r.term[1:]: (r.a, r.b) for r in counted.where(F.col("term").isin(["=" + w for w in SEEDS])).collect()}
    for w in sorted(set(SEEDS) - {e.text for e in entries if not e.stem}):
        toxic, plain_ = seen.get(w, (0, 0))
        odds_ = float(np.log((toxic + SEED_TOXIC) / (sizes[1] + SEED_TOXIC)) - np.log((plain_ + SEED_PLAIN) / (sizes[0] + 1)))
        if plain_ == 0 or odds_ > LEAST_ODDS:
            entries.append(Entry(w, False, min(3.0, max(odds_, LEAST_ODDS) / 2), toxic > 0))
    entries = tuple(entries)

    plain = ToxicityModel(entries, frozenset(), 0.0, 0.0, True)

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = LexiconTrie(plain.entries)
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sorted({w for w in {clean(t) for t in _TOKENS.findall(text)} if w and trie.match(w)[1]})
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(own), pa.int32()), pa.array(own, pa.string())], ["toxic", "word"])

    near = rows.select("toxic", "text").mapInArrow(spelt, "toxic int, word string").groupBy("word").agg(a, b)
    odds = (F.col("b") + 0.0) / sizes[0] >= 0.25 * (F.col("a") + 0.0) / sizes[1]
    exceptions = frozenset(r.word for r in near.where((F.col("b") > 0) & odds).collect())
    model = ToxicityModel(entries, exceptions, 0.0, 0.0, True)
    seen = sorted((r.toxic, r.evidence) for r in measure(rows.select("toxic", "text"), model, "toxic", "int").collect())
    y, x = np.array([s[0] for s in seen], float), np.array([s[1] for s in seen])
    slope, bias = fit_curve(x, y)
    # the sample takes a larger share of toxic rows than there are; the curve is fitted on what it saw
    return ToxicityModel(entries, exceptions, slope, bias, True)


_MATCHERS: dict[str, Matcher] = {}


def measure(rows: DataFrame, model: ToxicityModel, key: str, kind: str) -> DataFrame:
    """key, evidence, n_hits, n_quoted of every whole text (columns key and text)."""
    shared, tag = rows.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[tag] = Matcher(shared.value)
        matcher = _MATCHERS[tag]
        for batch in batches:
            got = [matcher.evidence(t or "") for t in batch.column(1).to_pylist()]
            columns = list(zip(*got, strict=True)) if got else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.float64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], [key, "evidence", "n_hits", "n_quoted"])

    return rows.select(key, "text").mapInArrow(run, f"{key} {kind}, evidence double, n_hits bigint, n_quoted bigint")


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, n_hits, n_quoted of every whole text."""
    rows = measure(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), model, "doc_id", "bigint")
    score = 1 / (1 + F.exp(-(F.lit(model.slope) * F.log1p("evidence") + F.lit(model.bias)))) if model.usable else F.lit(0.0)
    return rows.withColumn("score", score).select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits", "n_quoted")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every whole text of documents, learned from labels of rows that are not held out."""
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    out = score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_hits", "n_quoted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go. The model is learned from the labelled rows among all documents."""
    model = learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    if not model.usable:
        return base
    shared, tag = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    limit = THRESHOLD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[tag] = Matcher(shared.value)
        matcher = _MATCHERS[tag]
        for batch in batches:
            seen = np.array([matcher.evidence(t or "")[0] for t in batch.column(1).to_pylist()])
            if len(seen):
                yield batch.filter(pa.array(shared.value.score(seen) < limit))

    return base.mapInArrow(run, base.schema)
