import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestream.llm import packing as p
from lodestream.session import table

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def plain(lengths, capacity):
    """Contents of sequences: each piece, longest first, into the one with the least room that takes it."""
    rooms, held = [], []
    for n in sorted(lengths, reverse=True):
        fit = min((r, k) for k, r in enumerate(rooms) if r >= n) if any(r >= n for r in rooms) else None
        if fit is None:
            rooms.append(capacity - n)
            held.append([n])
        else:
            rooms[fit[1]] -= n
            held[fit[1]].append(n)
    return held


def spread(steps, counts):
    """Contents by sequence, from the steps; checks that places have no gap."""
    places = {}
    keys = (steps.length << p.NUMBER_BITS) | steps.first
    for n, c in counts.items():
        for j in range(c):
            s = np.searchsorted(keys, (n << p.NUMBER_BITS) | j, "right") - 1
            assert steps.length[s] == n
            nth = j - steps.first[s]
            places.setdefault(int(steps.sequence[s] + nth // steps.per[s]), []).append((int(steps.at[s] + nth % steps.per[s] * n), n))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
    assert sorted(places) == list(range(steps.n_sequences))
    return places


def test_same_as_piece_by_piece():
    rng = random.Random(5)
    for _ in range(300):
        capacity = rng.randint(1, 60)
        lengths = [rng.choice([capacity, rng.randint(1, capacity), rng.randint(1, max(1, capacity // 4))]) for _ in range(rng.randint(0, 120))]
        counts = Counter(lengths)
        got = spread(p.best_fit_decreasing(counts, capacity), counts)
        # sequences with equal room may hold different pieces, so how full they are is what is settled
        full = [sum(n for _, n in own) for own in got.values()]
        assert sorted(full) == sorted(map(sum, plain(lengths, capacity))), (capacity, lengths)


def test_steps_stay_few():
    counts = {n: 10**9 + 7 * n for n in range(1, 4097)}
    steps = p.best_fit_decreasing(counts, 4096)
    assert len(steps.first) < 100_000
    total = sum(n * c for n, c in counts.items())
    assert -(-total // 4096) <= steps.n_sequences <= 1.01 * total / 4096


def check(rows, docs, capacity, library):
    want = Counter()
    for doc_id, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want[doc_id, k, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return held


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_whole_table(spark, sf, library):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(None, "null id", 1), (None, None, 1), (7, "", 2), *[(5, "one row often", 3)] * 40], "doc_id bigint, text string, length int")
    docs = docs.unionByName(extra, allowMissingColumns=True).repartition(5)
    rows = [tuple(r)[:2] for r in docs.collect()]
    for capacity in (4096, 100):
        out = p.pack(docs, PATH, capacity).collect()
        held = check(out, rows, capacity, library)
        assert len(held) == len(plain([r.length for r in out], capacity))


def test_sequences(spark, sf):
    docs = table(spark, sf, "documents").limit(60)
    out = p.pack(docs, PATH, 512, with_ids=True).cache()
    rows = {(r.doc_id, r.start): r.ids for r in out.collect()}
    for s in p.sequences(out).collect():
        assert len(s.ids) == 4 * s.n_tokens <= 4 * 512
        for d in s.documents:
            assert bytes(s.ids[4 * d.offset : 4 * (d.offset + d.length)]) == bytes(rows[d.doc_id, d.start])


def test_empty_and_limits(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert p.pack(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        p.pack(empty, PATH, 0)
