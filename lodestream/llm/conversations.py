"""Repair of the turn structure of conversations by a grammar-compressed dynamic programme.

A row is one symbol: its role's initial (s, u, a or other), whether it is truncated, and one symbol for rows that have to go. The
cheapest way through a run of symbols is a 4 x 4 matrix over the places in `(s?(ua)+)?` (start, after s, after u, after a): least
cost, and a rope of edits that is the ASCII-least of that cost. Matrices multiply by (min, +), so a run of any length has one.

Symbols of all conversations are compressed by Re-Pair: rounds of jobs count adjacent symbols over the distinct runs, weighted by
how many conversations hold them, and the most frequent pairs become rules. A rule's matrix is the product of its two parts'
matrices, made once, bottom-up, and shared by all conversations; a conversation is then a product over a few symbols.

Ropes are pairs of ropes, written out only for the answer. Ties never compare them: edits of one run from one place end with a row's edit and
lead to one place each, so none begins with another, and ranks of the left parts, then of the right parts, order the wholes.

Equal rows of a conversation are one row with a count. Rows are dealt and sorted by (conversation, turn), so a conversation that
holds a third of all rows is cut over tasks, into runs of SEGMENT symbols; one row a run goes on. Only the digest of a repaired
conversation passes its rows through one task, in order, as a SHA-256 has to; that task holds one Arrow batch and the edits.

Defined results: null roles and texts are one space; a null conv_id is a conversation of its own; null turns come first and count for
no gap; rows of one turn are ordered by role, then by the text's MD5; roles that begin with none of s, u, a (the empty one too) can't be
kept; gaps beyond a 64-bit integer are null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.session import settle, table, tune

START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Where a role's initial leads from each place; the grammar has one user or assistant turn that may come next.
NEXT = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
TURN = ("u", "u", "a", "u")
ENDS = (START, AFTER_A)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}

#: Symbols of rows: initials of whole and of truncated rows, and of rows that have to go.
WHOLE, CUT, GONE = "suao", "SUAO", "x"
SEGMENT = 4096
#: Matrices of runs up to this length are remembered in a task.
REMEMBERED = 64
ROUNDS, PAIRS_A_ROUND, LEAST_PAIRS = 6, 24, 4
#: Rules' symbols are characters of a private area.
FIRST_RULE = 0xE000

#: Least cost, rank of the edits among those of the same row of the matrix, rope of edits; None where there is no way.
Entry = tuple[int, int, object]
Matrix = tuple[tuple[Entry | None, ...], ...]


def _ranked(row: Sequence[tuple[int, tuple, object] | None]) -> tuple[Entry | None, ...]:
    order = {key: k for k, key in enumerate(sorted(e[1] for e in row if e))}
    return tuple(e and (e[0], order[e[1]], e[2]) for e in row)


def leaf(symbol: str) -> Matrix:
    """Matrix of one row: any inserts before it, then the row kept, given another role, or deleted."""
    out = []
    for i in range(4):
        best: list[tuple[int, tuple, object] | None] = [None] * 4
        at, before, cost = i, "", 0
        for _ in range(4):
            ways = [(DELETE, "D", at)]
            if symbol != GONE:
                more = TRUNCATED * (symbol in CUT)
                ways.append((REROLE + more, "R", NEXT[at][TURN[at]]))
                if symbol.lower() in NEXT[at]:
                    ways.append((more, "K", NEXT[at][symbol.lower()]))
            for c, letter, j in ways:
                edits = before + letter
                if best[j] is None or (cost + c, edits) < (best[j][0], best[j][2]):
                    best[j] = (cost + c, (edits,), edits)
            at, before, cost = NEXT[at][TURN[at]], before + "I", cost + INSERT
        out.append(_ranked(best))
    return tuple(out)


def times(a: Matrix, b: Matrix) -> Matrix:
    """The matrix of a's run followed by b's."""
    out = []
    for row in a:
        best: list[tuple[int, tuple, object] | None] = [None] * 4
        for k, left in enumerate(row):
            for j, right in enumerate(b[k]) if left else ():
                if right:
                    key = (left[0] + right[0], (left[1], right[1]))
                    if best[j] is None or key < best[j][:2]:
                        best[j] = (*key, (left[2], right[2]))
        out.append(_ranked(best))
    return tuple(out)


def written(rope: object) -> str:
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += (x[1], x[0])
    return "".join(out)


#: Nothing done yet, at the start.
EMPTY: Matrix = ((((0, 0, ""), None, None, None)),)


def finish(done: Matrix) -> tuple[int, str]:
    """Least cost and edits of a whole conversation, inserts after the last row included."""
    ends = []
    for j, e in enumerate(done[0]):
        at, n = j, 0
        while e and at not in ENDS:
            at, n = NEXT[at][TURN[at]], n + 1
        if e:
            ends.append((e[0] + INSERT * n, e[1], (e[2], "I" * n)))
    cost, _, rope = min(ends, key=lambda e: e[:2])
    return cost, written(rope)


class Grammar:
    """Rules in the order they were made; each is two symbols, of rows or of earlier rules."""

    def __init__(self, rules: Sequence[str] = ()):
        self.rules: list[str] = []
        self.matrices = {c: leaf(c) for c in WHOLE + CUT + GONE}
        for pair in rules:
            self.add(pair)

    def add(self, pair: str) -> None:
        self.matrices[chr(FIRST_RULE + len(self.rules))] = times(self.matrices[pair[0]], self.matrices[pair[1]])
        self.rules.append(pair)

    def compress(self, symbols: str, first: int = 0) -> str:
        for k in range(first, len(self.rules)):
            symbols = symbols.replace(self.rules[k], chr(FIRST_RULE + k))
        return symbols


def pairs_of(runs: DataFrame, n_symbols: int) -> list[tuple[str, int]]:
    """Adjacent symbols of runs (symbols, n), with how often they stand, the most frequent first; n_symbols squared at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for pair, many in Counter(map("".join, zip(s, s[1:], strict=False))).items():
                    found[pair] += many * n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pair", "n"])

    rows = runs.mapInArrow(count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).limit(n_symbols * n_symbols).collect()
    return sorted(((r.pair, r.n) for r in rows), key=lambda x: (-x[1], x[0]))


def learn(runs: DataFrame, rounds: int = ROUNDS, most: int = PAIRS_A_ROUND, least: int = LEAST_PAIRS) -> Grammar:
    """Re-Pair over runs (symbols, n): each round the most frequent pairs that share no symbol become rules."""
    grammar = Grammar()
    for _ in range(rounds):
        known, first = list(grammar.rules), len(grammar.rules)

        def shorter(batches: Iterator[pa.RecordBatch], known: list[str] = known) -> Iterator[pa.RecordBatch]:
            own = Grammar(known)
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(map(own.compress, batch.column(0).to_pylist()), pa.string()), batch.column(1)], ["symbols", "n"])

        left, right, new = set(), set(), []
        for pair, n in pairs_of(runs.mapInArrow(shorter, "symbols string, n bigint"), len(grammar.matrices)):
            if n < least or len(new) == most:
                break
            if pair[0] not in right and pair[1] not in left:  # no chosen pair overlaps another
                left.add(pair[0])
                right.add(pair[1])
                new.append(pair)
        for pair in new:
            grammar.add(pair)
        if len(grammar.rules) == first:
            break
    return grammar


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: 0 for a dropped row, 2 for a repeated one; the kind of damage follows crc32 of `conv_id:turn`."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text)))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, th (MD5 of the text), n (equal rows), blank, again (role and text stood at an earlier turn), cut; each once."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    each = rows.where("copies > 0").select("conv_id", "turn", "role", _digest("text").alias("th"), "copies", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    each = each.groupBy("conv_id", "turn", "role", "th").agg(F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    turn = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("at"))  # null turns are first
    often = each.groupBy("conv_id", "role", "th").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    often = often.select(F.col("conv_id").alias("o_conv"), F.col("role").alias("o_role"), F.col("th").alias("o_th"), F.col("first")["at"].alias("o_turn"))
    both = each.join(often, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("role") == F.col("o_role")) & (F.col("th") == F.col("o_th")), "left")
    again = F.col("o_th").isNotNull() & ~F.col("turn").eqNullSafe(F.col("o_turn"))
    return both.select("conv_id", "turn", "role", "th", "n", "blank", again.alias("again"), "cut")


_RUN = [
    ("conv_id", pa.int64()), ("part", pa.int32()), ("run", pa.int64()), ("symbols", pa.string()), ("from_turn", pa.int64()), ("to_turn", pa.int64()), ("turns", pa.int64()),
    ("from_role", pa.string()), ("to_role", pa.string()), ("illegal", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
]
_RUN_DDL = "conv_id bigint, part int, run bigint, symbols string, from_turn bigint, to_turn bigint, turns bigint, from_role string, to_role string, illegal bigint, blank bigint, duplicate bigint, truncated bigint"
_LEGAL = {"su", "ua", "au"}


class _Run:
    """A stretch of one conversation's rows in order."""

    def __init__(self, conv: int | None):
        self.conv, self.symbols, self.n = conv, [], 0
        self.low = self.high = self.first = self.last = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0]

    def add(self, turn: int | None, role: str, symbol: str, fault: int | None) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.last is None:
            self.first = role
        else:
            self.illegal += self.last + role not in _LEGAL
        self.last = role
        if fault is not None:
            self.faults[fault] += 1
        self.symbols.append(symbol)
        self.n += 1


def runs_of(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Runs of at most `segment` symbols of the rows of faults(), each in one task, with what counts need of their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, now, n_runs = TaskContext.get().partitionId(), [], None, 0

        def close() -> None:
            nonlocal n_runs
            done.append((now.conv, part, n_runs, "".join(now.symbols), now.low, now.high, now.turns, now.first, now.last, now.illegal, *now.faults))
            n_runs += 1

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*done, strict=True), _RUN, strict=True)], [n for n, _ in _RUN])
            done.clear()
            return out

        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                conv, turn, role, _, n, blank, again, cut = r
                initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
                for k in range(n):
                    if now is None or now.conv != conv or now.n == segment:
                        if now is not None:
                            close()
                            if len(done) == 1000:
                                yield given()
                        now = _Run(conv)
                    fault = 0 if blank else 1 if again or k else 2 if cut else None
                    now.add(turn, initial, GONE if fault in (0, 1) else CUT[WHOLE.index(initial)] if fault == 2 else initial, fault)
        if now is not None:
            close()
        if done:
            yield given()

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("th")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _RUN_DDL)


_AUDIT = [("conv_id", pa.int64()), ("from_turn", pa.int64()), ("to_turn", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]
_AUDIT_DDL = "conv_id bigint, from_turn bigint, to_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def audits(runs: DataFrame, grammar: Grammar) -> DataFrame:
    """Counts, least cost and edits of each conversation that has rows, from its runs in order."""
    rules = grammar.rules

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(rules)

        def product(symbols: str) -> Matrix:
            parts = [own.matrices[c] for c in own.compress(symbols)]
            out = parts[0]
            for p in parts[1:]:
                out = times(out, p)
            return tuple(tuple(e and (e[0], e[1], written(e[2])) for e in row) for row in out)

        known = lru_cache(maxsize=20_000)(product)

        state, out, now = None, [], None

        def close() -> tuple:
            s = state
            return (now, s["low"], s["high"], s["turns"], *s["faults"], s["illegal"], *finish(s["done"]))

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _AUDIT, strict=True)], [n for n, _ in _AUDIT])

        for batch in batches:
            for conv, _, _, symbols, low, high, turns, first, last, illegal, *faults in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append(close())
                    now, state = conv, {"low": None, "high": None, "turns": 0, "faults": [0, 0, 0], "illegal": 0, "last": None, "done": EMPTY}
                s = state
                if s["last"] is not None:
                    illegal += s["last"] + first not in _LEGAL
                turns -= turns > 0 and low == s["high"]  # a turn that goes on from the run before
                s.update(low=low if s["low"] is None else s["low"], high=s["high"] if high is None else high, turns=s["turns"] + turns, illegal=s["illegal"] + illegal, last=last)
                s["faults"] = [a + b for a, b in zip(s["faults"], faults, strict=True)]
                s["done"] = times(s["done"], known(symbols) if len(symbols) <= REMEMBERED else product(symbols))
            if out:
                yield given()
                out = []
        if state is not None:
            out = [close()]
            yield given()

    return runs.repartition("conv_id").sortWithinPartitions("conv_id", "part", "run").mapInArrow(fold, _AUDIT_DDL)


def digests(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """conv_id, audit and repaired_sha256 of every conversation; a conversation's edits come before its rows, which are streamed."""
    kind = lambda k: F.lit(k).alias("kind")
    both = rows.select("conv_id", kind(1), "turn", "role", "text", _digest("text").alias("th"), F.col("copies").cast("bigint").alias("copies")).unionByName(
        audit.select("conv_id", kind(0), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("th"), F.lit(1).cast("bigint").alias("copies"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple = ()  # of one conversation, once there is one
        edits, at, hasher, place, lines = "", 0, None, START, 0
        out: list[tuple] = []

        def put(role: str, text: str) -> None:
            nonlocal lines
            hasher.update((("\n" if lines else "") + role + ":" + text).encode())
            lines += 1

        def inserts() -> None:
            nonlocal at, place
            while at < len(edits) and edits[at] == "I":
                put(ROLES[TURN[place]], "")
                place, at = NEXT[place][TURN[place]], at + 1

        def close() -> None:
            inserts()
            out.append((now[0], edits, hasher.hexdigest()))

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], ["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            for conv, kind, role, text, copies in zip(*[batch.column(k).to_pylist() for k in (0, 1, 3, 4, 6)], strict=True):
                if now != (conv,):
                    if now:
                        close()
                    now, edits, at, hasher, place, lines = (conv,), "", 0, hashlib.sha256(), START, 0
                if kind == 0:
                    edits = text
                    continue
                for _ in range(copies):
                    inserts()
                    e, at = edits[at], at + 1
                    if e != "D":
                        turn = role[:1] if e == "K" else TURN[place]
                        put(role if e == "K" else ROLES[turn], text)
                        place = NEXT[place][turn]
            if out:
                yield given()
                out.clear()
        if now:
            close()
            yield given()

    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "th")
    return ordered.mapInArrow(run, "conv_id bigint, audit string, repaired_sha256 string")


def repair(conversations: DataFrame, segment: int = SEGMENT, rounds: int = ROUNDS) -> DataFrame:
    """Damages the conversations and repairs them: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = damage(conversations)
    runs = settle(runs_of(faults(rows), segment), "runs")
    distinct = settle(runs.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "symbols")
    found = settle(audits(runs, learn(distinct, rounds)), "audits")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    gaps = F.when(F.col("from_turn").isNull(), 0).otherwise((wide("to_turn") - wide("from_turn") + 1 - wide("turns")).try_cast("bigint"))
    own = found.select(F.col("conv_id").alias("f_conv"), gaps.cast("bigint").alias("f_gaps"), *[F.col(c).alias(f"f_{c}") for c in ("blank", "duplicate", "truncated", "illegal", "cost")])
    all_ = digests(rows, found).join(own, F.col("conv_id").eqNullSafe(F.col("f_conv")), "left")
    counts = [F.when(F.col("f_cost").isNull(), 0).otherwise(F.col(f"f_{c}")).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_.select("conv_id", *counts, "audit", "repaired_sha256")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all conversations damaged and repaired."""
    return repair(table(tune(spark), sf_dir, "conversations"))
