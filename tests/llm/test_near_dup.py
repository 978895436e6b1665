import random

import pytest

from lodestream.llm import near_dup as nd
from lodestream.operators.components import connected_components
from lodestream.session import table


def sets_of(text, width):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def plain(rows, width, percent):
    sets = [sets_of(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for k, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        both = {}
        for x in s:
            for o in index[x]:
                if o < k:
                    both[o] = both.get(o, 0) + 1
        for o, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                parent[root(k)] = root(o)
    low = {}
    for k, (d, _) in enumerate(rows):
        r = root(k)
        low[r] = min(low.get(r, d), d)
    return sorted((d, len(sets[k]), low[root(k)], d == low[root(k)]) for k, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_against_plain(spark, sf, width, percent):
    df = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    rng = random.Random(1)
    base = [f"w{j}" for j in range(120)]
    for i in range(260):  # a family of many different texts, larger than some blocks
        w = base[:]
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((10000 + i, " ".join(w)))
    rows += [(20000, ""), (20001, " \n"), (20002, "One two"), (20003, "one TWO"), (20004, "one"), (20005, "x " * 9000), (20006, "x " * 9000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS rep", "2 AS sig")
    got = sorted(map(tuple, nd.near_duplicates(frame, width, percent).collect()))
    want = plain(rows, width, percent)
    assert got == want
    assert sum(not r[3] for r in want) > 100
    if width == 3:  # small bounds: salted keys, a join in place of a broadcast
        assert sorted(map(tuple, nd.near_duplicates(frame, width, percent, hot=8, broadcast_ids=0).collect())) == want


def test_query_on_a_larger_table(spark, sf):
    base = sf.replace("0.001", "0.01")
    want = plain([(r.doc_id, r.text) for r in table(spark, base, "documents").collect()], 3, 85)
    assert sorted(map(tuple, nd.op9_near_dup(spark, base).collect())) == want
    assert sum(not r[3] for r in want) > 50


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, None), (1, None), (2, "a b c d e"), (2, "a b c d e"), (3, "a b c d e")], "doc_id bigint, text string")
    got = sorted(map(tuple, nd.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 1, None, True), (1, 0, 1, True), (1, 0, 1, True), (2, 1, 2, True), (2, 1, 2, True), (3, 1, 2, False)], key=str)
    full = df.selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    assert sorted(str(r.doc_id) for r in nd.stage(spark, full, "").collect()) == ["1", "2", "None"]
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(500, k) for k in range(501, 600)] + [(None, 1), (7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for k in near:
        seen, todo = {k}, [k]
        while todo:
            for o in near[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        assert got[k] == min(seen)
    assert set(got) == set(near)
