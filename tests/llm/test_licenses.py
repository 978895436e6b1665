import random
import re

import pytest

from lodestream.llm import licenses as li
from lodestream.session import table


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in li.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_suffix_automaton_lengths():
    rng = random.Random(5)
    texts = [("t", " ".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))) for _ in range(6)]
    a = li.LicenseAutomaton((), texts, 2, 3, 0.5)
    inside = {tuple(t.split()[i:j]) for _, t in texts for i in range(len(t.split())) for j in range(i + 1, len(t.split()) + 1)}
    for _ in range(300):
        w = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
        state = 0
        for x in w:
            state = a.next[state].get(a.vocabulary.get(x.encode(), -1), -1)
            if state < 0:
                break
        assert (state >= 0) == (tuple(w) in inside)


def test_phrases_against_plain(spark, sf):
    rng = random.Random(6)
    bits = ["MIT", "License", "apache", "general", "public", "the", "é", "x1", "\n", "\x00", "-", "Mozilla"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(900, None), (900, None), (901, ""), (None, "mit license"), (902, "mit license " * 3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS labels")
    for frame in (df, table(spark, sf, "documents")):
        text = sorted((str(r.doc_id), *plain(r.text)) for r in frame.collect())
        got = li.scan_documents(frame).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == text or sorted(map(str, [(str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got])) == sorted(map(str, text))
        assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got)
    assert li.scan_documents(df.limit(0)).count() == 0


def test_templates():
    a = li.LicenseAutomaton()
    for label, text in li.TEMPLATES:
        (span,) = a.scan(li.words_of(f"some words before {text} and some after".encode()))[1]
        assert span.label == label and span.cover == 1.0, (label, span)
    opening = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    assert [s.label for s in a.scan(li.words_of(opening.encode()))[1]] == ["mit"]
    bsd = next(t for label, t in li.TEMPLATES if label == "bsd").split()
    bsd[9] = "changed"
    (span,) = a.scan(li.words_of(" ".join(bsd).encode()))[1]
    assert span.label == "bsd" and 0.9 < span.cover < 1
    assert a.scan(li.words_of(b"this program is good and the software is free of bugs, without any doubt"))[1] == []


def follows(a, b, gap):
    """Words that b adds to a chain that ends with a, or 0 if it can't be next: counted word by word."""
    text, place = set(range(a[0] + a[1])), set(range(a[2] + a[1]))
    if b[0] + b[1] <= a[0] + a[1] or b[2] + b[1] <= a[2] + a[1] or b[0] - a[0] - a[1] > gap or b[2] - a[2] - a[1] > gap:
        return 0
    return sum(b[0] + k not in text and b[2] + k not in place for k in range(b[1]))


def plain_chains(anchors, gap, least, every):
    """Rounds of best chains; every: by listing all chains, else by the best chain that ends with each anchor."""
    todo, found = list(anchors), []
    while todo:
        if every:
            ends, stack = {a: [] for a in todo}, [((a,), a[1]) for a in todo]
            while stack:
                chain, covered = stack.pop()
                ends[chain[-1]].append((covered, chain[0][0]))
                stack += [((*chain, b), covered + more) for b in todo if (more := follows(chain[-1], b, gap))]
            best = {a: max(v) for a, v in ends.items()}
        else:
            best = {}
            for b in sorted(todo, key=lambda a: a[0] + a[1]):
                best[b] = max([(b[1], b[0])] + [(v[0] + more, v[1]) for a, v in best.items() if a[0] + a[1] >= b[0] - gap and (more := follows(a, b, gap))])
        taken, again = [], False
        for covered, first, last in sorted((-c, f, a[0] + a[1]) for a, (c, f) in best.items() if c >= least):
            if any(f < last and first < z for f, z in taken):
                again = True
            else:
                taken.append((first, last))
                found.append((first, last, -covered))
        if not again:
            break
        todo = [a for a in todo if not any(f < a[0] + a[1] and a[0] < z for f, z in taken)]
    return found


def plain_spans(words, templates, least, gap, cover, enough, every=False):
    """Matching statistics by looking every stretch up in a set, then chains by the stated rule."""
    texts = [(label, li.words_of(t.encode())) for label, t in templates]
    longest = max((len(t) for _, t in texts), default=0)
    inside = {tuple(t[i:j]) for _, t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    stat, size = [], 0
    for i in range(len(words)):
        size = min(size + 1, longest)
        while size and tuple(words[i + 1 - size : i + 1]) not in inside:
            size -= 1
        stat.append(size)
    matches = [(i + 1 - n, n) for i, n in enumerate(stat) if n >= least and (i + 1 == len(words) or stat[i + 1] <= n)]
    spans = []
    for label, own in texts:
        anchors = [(f, n, k) for f, n in matches for k in range(len(own) - n + 1) if own[k : k + n] == words[f : f + n]]
        for first, last, covered in plain_chains(anchors, gap, min(enough, cover * len(own)), every):
            spans.append((covered, first, last, label, covered / len(own)))
    spans.sort(key=lambda s: (-s[0], s[1], s[3], -s[4]))
    stay = []
    for s in spans:
        own = set(range(s[1], s[2]))
        if not any(2 * len(own & set(range(o[1], o[2]))) > len(own) for o in stay):
            stay.append(s)
    return matches, sorted((s[3], s[1], s[2], s[4]) for s in stay)


def test_matches_and_chains_against_plain():
    rng = random.Random(8)
    templates = [("xyz"[k % 3], " ".join(rng.choice("abcde") for _ in range(rng.randint(4, 14)))) for k in range(7)]
    a = li.LicenseAutomaton((), templates, 2, 3, 0.6, 7)
    found = 0
    for _ in range(400):
        words = []
        for _ in range(rng.randint(0, 6)):
            t = rng.choice(templates)[1].split()
            words += t[rng.randint(0, 3) : rng.randint(3, len(t))] if rng.random() < 0.6 else [rng.choice("abcdeq") for _ in range(rng.randint(1, 5))]
        words = [w.encode() for w in words]
        matches, spans = plain_spans(words, templates, 2, 3, 0.6, 7, every=True)
        assert [(f, n) for f, n, _ in a.matches(words)[1]] == matches, words
        got = sorted((s.label, s.first, s.last, s.cover) for s in a.scan(words)[1])
        assert got == spans, words
        found += len(spans)
    assert found > 200


def put_in(words, n):
    """A word of its own after every n-th."""
    return [x for k, w in enumerate(words, 1) for x in ([w, b"zzz"] if k % n == 0 else [w])]


def test_template_that_holds_a_stretch_twice():
    template = "a b c d e f g h i j a b c d k l m n o p"
    a = li.LicenseAutomaton((), [("x", template)], 4, 8, 0.6, 20)
    words = [w.encode() for w in "a b c d e f g h i j zz a b c d zz k l m n o p".split()]
    assert [(s.first, s.last, s.cover) for s in a.scan(words)[1]] == [(0, 22, 1.0)]
    # twice in a row, and with a piece of it once more in between
    assert [(s.first, s.last, s.cover) for s in a.scan(words + words)[1]] == [(0, 22, 1.0), (22, 44, 1.0)]


@pytest.mark.parametrize("n", [5, 7, 9])
def test_whole_licences_with_words_put_in(n):
    a = li.LicenseAutomaton(li.PHRASES, li.TEMPLATES, li.MIN_MATCH, li.MAX_GAP, li.MIN_COVER, li.MIN_WORDS)
    for label, text in li.TEMPLATES:
        own = li.words_of(text.encode())
        words, rest = put_in(own, n), len(own) % n
        spans = a.scan(words)[1]
        best = max(spans, key=lambda s: s.words)
        covered = len(own) - (rest if rest < li.MIN_MATCH else 0)
        assert best.label == label and len([s for s in spans if s.label == label]) == 1 and best.words >= covered, (label, n, spans)


def test_many_copies_in_one_text():
    a = li.LicenseAutomaton(li.PHRASES, li.TEMPLATES, li.MIN_MATCH, li.MAX_GAP, li.MIN_COVER, li.MIN_WORDS)
    one = li.words_of(dict(li.TEMPLATES)["mit"].encode())
    spans = a.scan(one * 2000)[1]
    assert len(spans) == 2000 and all(s.cover == 1.0 for s in spans)


def test_whole_query_against_plain(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: r for r in li.op3_licenses(spark, sf).collect()}
    for r in docs.collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        _, spans = plain_spans([w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)], li.TEMPLATES, li.MIN_MATCH, li.MAX_GAP, li.MIN_COVER, li.MIN_WORDS)
        base = plain(r.text)[4]
        labels = ",".join(sorted({*filter(None, base.split(",")), *(s[0] for s in spans)}))
        assert (got[r.doc_id].labels, got[r.doc_id].score) == (labels, 1.0 if base else max([s[3] for s in spans], default=0.0)), r.doc_id
