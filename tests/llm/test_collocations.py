import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestream.llm import collocations as c
from lodestream.session import table

SCHEMA = "doc_id bigint, text string, lang string"


def plain(rows, least, top=2000, longest=4):
    """Result rows, by listing every phrase."""
    n, f = Counter(), defaultdict(Counter)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        often = {p: a for p, a in own.items() if a >= least}
        kept, longer = [], defaultdict(list)
        for q, b in often.items():
            for size in range(2, len(q)):
                for i in range(len(q) - size + 1):
                    longer[q[i : i + size]].append(b)
        for p, a in often.items():
            if len(p) < 2:
                continue
            score, _, l, r = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            if not any(100 * b >= 80 * a for b in longer[p]):
                kept.append((score, a, " ".join(p), l, r))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, k + 1, p, a, l, r, n[lang], score) for k, (score, a, p, l, r) in enumerate(kept[:top])]
    return sorted(out)


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_chunks_keep_every_phrase():
    rng = random.Random(4)
    for overlap in (1, 2, 3):
        for _ in range(60):
            words = c.Words()
            pieces = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))] for _ in range(rng.randint(0, 6))]
            ids = words.numbers(b" \n ".join(" ".join(p).encode() for p in pieces))
            starts, ends, firsts = c.cut(ids, words.hashes(), overlap, 4)
            have = Counter()
            for a, b, first in zip(starts, ends, firsts, strict=True):
                own = [words.text[i].decode() for i in ids[a:b]]
                assert b"\n".decode() not in own
                for k in range(1, overlap + 2):
                    have.update(tuple(own[i : i + k]) for i in range(len(own) - k + 1) if first or i + k > overlap)
            want = Counter(tuple(p[i : i + k]) for p in pieces for k in range(1, overlap + 2) for i in range(len(p) - k + 1))
            assert have == want


def test_no_chunk_begins_another():
    rng = random.Random(5)
    words = c.Words()
    ids = words.numbers(" ".join(rng.choice("abcdefghijklmnop") for _ in range(20_000)).encode())
    starts, ends, firsts = c.cut(ids, words.hashes(), 3, 16)
    inner = {tuple(ids[a:b]) for a, b, f in zip(starts, ends, firsts, strict=True) if not f and b < len(ids)}
    assert len(inner) > 500 and 10 < np.mean([len(x) for x in inner]) < 30
    assert not any(x[:k] in inner for x in inner for k in range(1, len(x)))


@pytest.mark.parametrize("least", [30, 4])
def test_whole_table(spark, sf, least):
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    assert got(c.collocations(docs, least=least)) == plain(rows, least)


def odd():
    rng = random.Random(6)
    vocabulary = ["New", "york", "CITY", "the", "a", "of", "ß", "É", "é", "中文", "\xa0x", "\x1c", "don't", "\x00", "x" * 300]
    phrase = "One two three four five six seven eight nine ten eleven twelve"
    rows = [(k, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t", "  ", ", ", ".\n", "\x0b", "\r\n"]) for _ in range(rng.randint(0, 80))), rng.choice(["en", "en", "de", None, "und", ""])) for k in range(300)]
    rows += [(1000 + k, phrase, "en") for k in range(50)] + [(1, "new york " * 3000, "de"), (None, None, None), (None, "", "en"), (5, "new york " * 3000, "de")]
    return rows + [(7, "the same row, the same row", "fr")] * 40


def test_odd_rows(spark):
    rows = odd()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "'x' AS phrase", "2 AS rank")
    for least in (2, 30):
        assert got(c.collocations(df.repartition(3), least=least, one_in=5)) == plain(rows, least)
    assert got(c.collocations(df, least=20, top=3)) == plain(rows, 20, 3)
    assert got(c.collocations(df, least=10, max_words=2)) == plain(rows, 10, longest=2)


def test_small_filters_and_tasks_change_nothing(spark, monkeypatch):
    rows = odd()
    for name in ("MOST_WORDS", "MOST_CHUNKS", "MOST_PHRASES", "ROWS_AT_ONCE", "BLOCK_CHUNKS"):
        monkeypatch.setattr(c, name, 7)
    assert got(c.collocations(spark.createDataFrame(rows, SCHEMA), least=5, most_bits=64)) == plain(rows, 5)


def test_counts_beyond_32_bits(spark):
    big = 1 << 61
    phrases = spark.createDataFrame([("en", 1, "a", big + 1), ("en", 1, "b", big), ("en", 2, "a b", big), ("en", 0, "", 4 * big - 1)], "lang string, words int, phrase string, a bigint")
    r = c.scores(phrases).collect()
    assert [tuple(x) for x in r] == [("en", "a b", big, big + 1, big, 2_000_000 * big // (2 * big + 1))]
    assert c.not_covered(c.scores(phrases), phrases).count() == 1


def test_empty(spark):
    assert c.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert c.collocations(spark.createDataFrame([(1, None, "en"), (2, " .,", None)], SCHEMA)).count() == 0
