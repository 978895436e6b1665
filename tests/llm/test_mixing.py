import re
from collections import Counter

import numpy as np
import pytest

from lodestream.llm import mixing as m
from lodestream.session import table


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets():
    assert m.targets([100, 100, 100], [3, 1, 2], 1.5, 2.0) == [200.0, 250 / 3, 500 / 3]
    assert m.targets([1, 1000], [3, 1], 1.5, 2.0) == [2.0, 1499.5]
    assert m.targets([0, 10], [3, 1], 1.5, 2.0) == [0.0, 15.0] and m.targets([], [], 1.5, 2.0) == []


def test_plans_take_the_target():
    rng = np.random.default_rng(0)
    for _ in range(600):
        n, block = int(rng.integers(1, 400)), int(rng.integers(1, 60))
        target = float(rng.uniform(0, 2 * n))
        p = m.plan_source(n, target, block, rng)
        taken = 0
        for i in range(p.slots):
            a, b = p.passes[i // p.blocks]
            k = (a * (i % p.blocks) + b) % p.blocks
            length = min(block, n - k * block)
            taken += min(length, p.last) if i == p.slots - 1 else length
        assert taken == round(target), (n, block, target, p)


@pytest.mark.parametrize("most", [1, 3, 64])
def test_draws(most):
    slots = [1000, 10, 0, 500, 3]
    runs = m.draw_runs(slots, 64, 7, most)
    assert len(runs) <= max(most, 1) and [r[0] for r in runs] == list(np.cumsum([0, *[r[1] for r in runs[:-1]]]))
    got = [g for at, n, left in runs for g in m.draw_shards(left, n, 64, np.random.default_rng(at))]
    assert sum(got).tolist() == slots and all(g.sum() == 64 for g in got[:-1]) and 0 < got[-1].sum() <= 64
    again = m.draw_runs(slots, 64, 7, most)
    assert all((a[2] == b[2]).all() for a, b in zip(runs, again, strict=True)) and m.draw_runs([0, 0], 64, 7, most) == []


def test_draws_follow_the_weights():
    rng = np.random.default_rng(1)
    got = np.array([m.draw(np.array([30_000, 10_000, 20_000]), 600, rng) for _ in range(400)])
    assert np.allclose(got.mean(0), [300, 100, 200], atol=4) and got.std(0).min() > 5


def check(df, **more):
    rows, got = df.collect(), m.mix(df, **more).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r.doc_id), size(r.text)) for r in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    per = Counter()
    for r in got:
        per[r.target, r.source_size] += r.taken
    return got, per


def plain_targets(sizes, weights):
    """Water filling by bisection on the level: each target is the lesser of level * weight and twice the size."""
    total = 1.5 * sum(sizes)
    lo, hi = 0.0, 10.0 * total + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(mid * w, 2 * s) for s, w in zip(sizes, weights, strict=True)) < total else (lo, mid)
    return [min(hi * w, 2 * s) for s, w in zip(sizes, weights, strict=True)]


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_query_on_tables(spark, sf, scale):
    base = sf.replace("0.001", scale)
    rows = table(spark, base, "documents").collect()
    got = m.op10_mixing(spark, base).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, m.op10_mixing(spark, base).collect()))
    source, sizes, taken, goal = {r.doc_id: r.source for r in rows}, Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += size(r.text)
    text = {r.doc_id: r.text for r in rows}
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    want = dict(zip(names, plain_targets([sizes[x] for x in names], [(3, 1, 2)[k % 3] for k in range(len(names))]), strict=True))
    assert len(got) == len(rows) and len(names) == 20
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size(text[r.doc_id]) and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        taken[s] += r.taken
        goal[s] = r.target
    assert all(taken[s] == round(goal[s]) for s in names)


def test_every_piece_of_the_mix(spark, sf):
    """The mix's blocks against streams laid out in plain Python: each slot's words are those of its block."""
    df = table(spark, sf, "documents")
    placed = m.settle(m.place(df), "t")
    sources = m.sources_of(placed, m.WEIGHTS, 1.5, 2.0)
    spans = {}
    for r in placed.collect():
        spans.setdefault(r.source, []).append((r.start, r["size"]))
    for s, own in spans.items():  # offsets lay documents end to end
        own = sorted(x for x in own if x[1])
        assert [a for a, _ in own] == list(np.cumsum([0, *[n for _, n in own]]))[: len(own)]
    slots = m.slots_of(spark, sources, 64, 32, 5).collect()
    assert Counter(r.shard for r in slots).most_common()[0][1] == 32
    names = dict(zip(sources["rank"], sources["source"], strict=True))
    want = Counter()
    for r in slots:
        for start, n in spans[names[r.source_rank]]:
            lo, hi = max(0, r.block * 64 - start), min(n, r.block * 64 + r.words - start)
            if n and hi > lo:
                want[r.shard, r.source_rank, r.slot, start, lo, hi] += 1
    got = Counter((r.shard, r.source_rank, r.slot, r.start, r.lo, r.hi) for r in m.pieces_of(placed, sources, 64, 32, 5).collect())
    assert got == want


def test_odd_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (None, " ", None), (3, "w " * 5000, None), (4, "one", "é"), (5, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS size", "2 AS start", "'l' AS lang")
    got, _ = check(df, block=16, shard_slots=8)
    assert {r.taken for r in got if r.doc_id in (2, None, 5)} == {0}
    assert m.mix(df.limit(0)).count() == 0
    mixed = m.mix_documents(df, block=16, shard_slots=8).collect()
    assert sum(size(r.text) for r in mixed) == sum(r.taken for r in got)
    assert m.mix_documents(df.limit(0)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("keep", [(), ("text", "lang")])
def test_equal_rows_are_dealt_over_chunks(spark, keep):
    rows = [(5, "one two three", "en", "web")] * 4000 + [(None, None, None, None)] * 900 + [(k, f"word {k} " * (k % 4), "de", "web") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(5)
    placed = m.place(df, keep)
    got = Counter((r.doc_id, r.source, r["size"]) for r in placed.collect())
    assert got == Counter((a, d, size(b)) for a, b, _, d in rows)
    for source in ("web", None):  # starts have no gap and no overlap
        at = 0
        for r in sorted(((r.start, r["size"]) for r in placed.collect() if r.source == source and r["size"])):
            assert r[0] == at
            at += r[1]
    base = df.selectExpr("doc_id", "source", "xxhash64(text) AS h")
    held = [r["count"] for r in m._spread_copies(base, ["doc_id", "source", "h"], 40).groupBy("chunk").count().collect()]
    assert len(held) == 40 and max(held) < 2 * sum(held) / 40
    again = m.place(df.repartition(3), keep)
    assert Counter((r.doc_id, r.start) for r in placed.collect()) == Counter((r.doc_id, r.start) for r in again.collect())
