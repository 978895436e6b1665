import random
import re
import zlib

import numpy as np
import pytest

from lodestream.llm import toxicity as tx
from lodestream.session import table


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_plain_distances():
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(40)]
    trie = tx.LexiconTrie([tx.Entry(w, k % 3 == 0, 1.0) for k, w in enumerate(dict.fromkeys(words))])
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 10)))
        near = []
        for e in trie.entries:
            ends = range(1, len(w) + 1) if e.stem else (len(w),)
            if e.text[0] == w[0] and (d := min(distance(w[1:n], e.text[1:]) for n in ends)) <= tx.edits(e.text):
                near.append(d)
        k, d = trie.match(w)
        if len(w) >= 4 or w in words:
            assert (k >= 0) == bool(near) and (k < 0 or d == min(near)), (w, near, k, d)


def test_scores_of_a_table_against_plain(spark, sf):
    """Every row of a table by plain loops: tokens, distances to all entries, quotation windows, the curve."""
    base = sf.replace("0.001", "0.01")
    docs, labels = table(spark, base, "documents"), table(spark, base, "labels")
    model = tx.learn(docs, labels)
    memo = {}

    def weight(token):
        w = token.lower().strip(tx._EDGE)
        if w not in memo:
            best = (99, 0.0)
            for k, e in enumerate(model.entries):
                if w == e.text and not e.stem:
                    best = (0, e.weight)
                    break
                if e.stem and w.startswith(e.text):
                    best = min(best, (-1 - len(e.text), e.weight))
            if best[0] == 99 and len(w) >= 4 and w not in model.exceptions:
                for e in model.entries:
                    if e.edits and e.text[0] == w[0] and abs(len(e.text) - len(w)) <= (99 if e.stem else 2):
                        d = min(distance(w[1:n], e.text[1:]) for n in (range(1, len(w) + 1) if e.stem else (len(w),)))
                        if d <= e.edits and d < best[0]:
                            best = (d, e.weight * tx.FUZZY**d)
            memo[w] = best[1] if best[0] < 99 else 0.0
        return memo[w]

    got = {r.doc_id: r for r in tx.score_documents(docs, model).collect()}
    rows = docs.where("doc_id % 7 = 0").collect()
    for r in rows:
        tokens = [t for t in re.split(r"[\x20\x09-\x0D]+", r.text or "") if t]
        total = n = 0
        for i, t in enumerate(tokens):
            if w := weight(t):
                total, n = total + w * (tx.QUOTED if tx.Matcher._quoted(tokens, i) else 1.0), n + 1
        want = 1 / (1 + np.exp(-(model.slope * np.log1p(total) + model.bias)))
        assert got[r.doc_id].n_hits == n and got[r.doc_id].score == pytest.approx(want, abs=1e-9), r.doc_id
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)


def test_held_out_small(spark, sf):
    base = sf.replace("0.001", "0.01")
    docs, labels = table(spark, base, "documents"), table(spark, base, "labels")
    y = {r.doc_id: r.toxic for r in labels.collect()}
    got = tx.op8_toxicity(spark, base).where("held_out").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, tx.op8_toxicity(spark, base).where("held_out").collect()))
    toxic = [r.predicted for r in got if y.get(r.doc_id) == 1]
    clean = [r.predicted for r in got if y.get(r.doc_id) == 0]
    # 37 toxic rows to learn from, a handful a language: terms of the rarer languages stay below the bar of chance (README)
    assert np.mean(toxic) >= 0.6 and np.mean(clean) <= 0.05


def test_stems_and_quotes():
    m = tx.Matcher(tx.ToxicityModel((tx.Entry("idiot", False, 2.0), tx.Entry("lowe", True, 2.0)), frozenset(), 1.0, 0.0, True))
    assert m.evidence("You IDIOT, lowenx")[:2] == (4.0, 2)
    fuzzy = tx.LexiconTrie([tx.Entry("wertl", True, 2.0)])
    assert fuzzy.match("wertloser") == (0, 0) and fuzzy.match("wetrloser")[0] == -1 and fuzzy.match("wertxloser") == (0, 1) and fuzzy.match("wrtlosigkeit") == (0, 1)
    assert m.evidence("you idiott")[0] == pytest.approx(2 * tx.FUZZY) and m.evidence("slowe")[1] == 0
    assert m.evidence('she cried "you idiot" and left')[0] == pytest.approx(2 * tx.QUOTED)
    assert m.evidence("he said idiot to them")[2] == 1 and m.evidence("")[1] == 0


def test_held_out(spark, sf):
    base = sf.replace("0.001", "0.1")
    docs, labels = table(spark, base, "documents"), table(spark, base, "labels")
    y = {r.doc_id: r.toxic for r in labels.collect()}
    model = tx.learn(docs, labels)
    got = [r for r in tx.score_documents(docs, model).collect() if r.doc_id in y and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = np.mean([r.predicted == y[r.doc_id] for r in got])
    toxic = [r for r in got if y[r.doc_id]]
    recall = np.mean([r.predicted for r in toxic])
    print(len(got), right, recall, len(model.entries), sorted((e.text, e.stem) for e in model.entries)[:60], sorted(model.exceptions)[:20], model.slope, model.bias)
    assert right > 0.97 and recall > 0.93


def test_odd_rows(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = tx.learn(docs, labels)
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "x", 1), (3, "idiot " * 30000, 1)], "doc_id bigint, text string, score int")
    got = tx.score_documents(df, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and tx.score_documents(df.limit(0), model).count() == 0
    none = tx.learn(docs, labels.limit(0))
    assert {r.score for r in tx.score_documents(df, none).collect()} == {0.0}
    kept = tx.stage(spark, docs, sf)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
