import hashlib
import itertools
import random
import re
import zlib

import pytest

from lodestream.llm import conversations as c
from lodestream.session import table

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAME = {"u": "user", "a": "assistant"}


def plain_edits(rows):
    """(cost, edits) of rows (initial, must go, truncated), by trying all edits from each place on."""
    best = {}
    for i in range(len(rows), -1, -1):
        for at in range(4):
            options = []
            for n in range(3):  # inserts first
                place, edits = at, ""
                for _ in range(n):
                    place, edits = (3 if place == 2 else 2), edits + "I"
                if i == len(rows):
                    if place in (0, 3):
                        options.append((2 * n, edits))
                    continue
                initial, gone, cut = rows[i]
                turn = "a" if place == 2 else "u"
                ways = [("D", 3, place)]
                if not gone:
                    ways.append(("R", 2 + cut, NEXT[place][turn]))
                    if initial in NEXT[place]:
                        ways.append(("K", cut, NEXT[place][initial]))
                for letter, cost, after in ways:
                    rest = best[i + 1, after]
                    options.append((2 * n + cost + rest[0], edits + letter + rest[1]))
            best[i, at] = min(options)
    return best[0, 0]


def plain(rows):
    """Result row of each conversation."""
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = {}
    for conv, own in by.items():
        kept = []
        for _, turn, role, text in own:
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        turns = {r[0] for r in kept if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, counts, rows_ = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in kept:
            bare = text.rstrip("\t\n\x0b\x0c\r ")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            if fault:
                counts[fault] += 1
            seen.add((role, text))
            rows_.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows_))
        cost, edits = plain_edits(rows_) if rows_ else (0, "")
        lines, place, at = [], 0, 0
        for e in edits:
            turn = "a" if place == 2 else "u"
            if e == "I":
                role, text = NAME[turn], ""
            else:
                _, role, text = kept[at]
                at += 1
                if e == "D":
                    continue
                turn = role[:1] if e == "K" else turn
                role = role if e == "K" else NAME[turn]
            lines.append(f"{role}:{text}")
            place = NEXT[place][turn]
        assert at == len(kept) and place in (0, 3)
        out[conv] = (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def same(got, rows):
    want = plain(rows)
    have = {r.conv_id: tuple(r[x] for x in COLUMNS) for r in got}
    assert len(got) == len(have) == len(want)
    assert have == want


def test_matrices_against_all_edits():
    rng = random.Random(1)
    symbols = c.WHOLE + c.CUT + c.GONE
    grammar = c.Grammar(["ua", chr(c.FIRST_RULE) * 2, "su", "xa", "aU", chr(c.FIRST_RULE + 1) + "u"])
    for _ in range(1500):
        s = "".join(rng.choice(symbols if rng.random() < 0.5 else "uaxU") for _ in range(rng.randint(0, 14)))
        done = c.EMPTY
        for x in grammar.compress(s):
            done = c.times(done, grammar.matrices[x])
        want = plain_edits([(x.lower(), x == c.GONE, x in c.CUT) for x in s])
        assert c.finish(done) == want, s
    for s in itertools.product(symbols, repeat=3):
        done = c.EMPTY
        for x in s:
            done = c.times(done, grammar.matrices[x])
        assert c.finish(done) == plain_edits([(x.lower(), x == c.GONE, x in c.CUT) for x in s])


def test_grammar_keeps_runs(spark):
    rng = random.Random(2)
    runs = [("".join(rng.choice("uaUx") for _ in range(rng.randint(1, 40))), rng.randint(1, 9)) for _ in range(300)] + [("ua" * 500, 1000), ("aaaa", 3)]
    grammar = c.learn(spark.createDataFrame(runs, "symbols string, n bigint"))
    assert len(grammar.rules) > 20 and grammar.rules[0] == "ua"
    full = lambda x: x if ord(x) < c.FIRST_RULE else "".join(map(full, grammar.rules[ord(x) - c.FIRST_RULE]))
    for s, _ in runs:
        assert "".join(map(full, grammar.compress(s))) == s
    assert len(grammar.compress("ua" * 500)) < 100


def test_whole_table(spark, sf):
    for path in (sf, sf.replace("sf0.001", "sf0.01")):
        rows = table(spark, path, "conversations").select("conv_id", "turn", "role", "text").collect()
        same(c.op13_conversations(spark, path).collect(), [tuple(r) for r in rows])


@pytest.mark.parametrize("segment", [3, 4096])
def test_odd_rows(spark, segment):
    rng = random.Random(3)
    texts = ["Yes.", "No", "", " \t\n", None, "Sure! ", "ok?\r\n", "ж.", "long " * 2000 + "end.", "x\x1c", ".", "Yes. \xa0"]
    roles = ["user", "assistant", "system", "tool", "", None, "U", "unknown"]
    rows = [(k, t, rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts)) for k in range(120) for t in range(rng.randint(1, 9))]
    rows += [(None, t, rng.choice(roles), rng.choice(texts)) for t in [None, None, None, 1, 5, 5]]
    rows += [(7000, None, "user", "Again.")] * 25 + [(7001, 3, rng.choice(roles[:3]), rng.choice(texts)) for _ in range(30)]
    rows += [(7002, t, ("user", "assistant")[t % 2], f"Turn {t % 40}.") for t in range(300)]  # one conversation over several runs
    rows += [(7003, -(1 << 63), "user", "First."), (7004, -5, "user", "A."), (7004, 90, "assistant", "B.")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS kind", "2 AS n", "'x' AS audit")
    same(c.repair(df.repartition(3), segment).collect(), rows)


def test_gaps_beyond_a_long_and_empty(spark):
    rows = [(k, t, "user", "A.") for k in range(40) for t in (-(1 << 63), (1 << 63) - 1)]
    got = c.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert len(got) == 40 and any(r.gaps is None for r in got)
    assert c.repair(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_hot_conversation_is_cut(spark):
    rows = spark.range(20_000).selectExpr("CAST(CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS bigint) AS conv_id", "id AS turn", "'user' AS role", "concat('Turn ', id, '.') AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        parts = c.runs_of(c.faults(c.damage(rows)), 500).where("conv_id = 1").selectExpr("part", "length(symbols) AS n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.part for r in parts}) > 1 and max(r.n for r in parts) <= 500
