import re
from collections import Counter

from lodestream.llm import quality as q
from lodestream.session import table


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if seen[w] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


TEXTS = ["", " \n\t", "a b c a b c", "é ü\x1c ü \xa0x\ny\n\ny\n y", "a a a a a a a", "# * $%&|<>\n#", "one\x0btwo\x0cthree\r\nfour \r\nfour ", "x y z " * 40, "中文 字 😀 😀"]


def test_counts():
    for t in TEXTS:
        assert q.counts(t.encode()) == plain(t), t


def documents(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate([*TEXTS, None])]
    unique = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows += [(100 + i, f"{unique(i)}\nSubscribe  now to our letter", "en", "s") for i in range(30)]  # boilerplate under much text
    rows += [(200 + i, f"{'Buy this now and here ' * 4}\n{' '.join(f'b{j}' for j in range(60))}\nq{i}" if i else "x", "en", "t") for i in range(30)]
    rows += [(300 + i, f"{unique('c')}\nand a last line", "en", "s") for i in range(50)]  # copies are no boilerplate
    shared = "\n".join(" ".join(f"n{k}m{j}" for j in range(8)) for k in range(9))
    rows += [(400 + i, f"{shared}\n{' '.join(f'own{i}z{j}' for j in range(10))} {'y' * 90}", None, None) for i in range(25)]  # depleted
    rows += [(400, f"{shared}\n{' '.join(f'own0z{j}' for j in range(10))} {'y' * 90}", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "1 AS kept", "2 AS line")


def test_documents(spark):
    df = documents(spark)
    rows = df.collect()
    got = q.judge_documents(df, with_text=True).collect()
    assert len(got) == len(rows)
    text_of = {r.doc_id: r.text for r in rows}
    for r in got:
        n = plain(text_of[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)
        if 100 <= r.doc_id < 130:
            assert r.n_removed_lines == 1 and r.kept and "letter" not in r.text
        if 300 <= r.doc_id < 350:
            assert r.n_removed_lines == 0 and r.kept
        if 400 <= r.doc_id:
            assert r.n_removed_lines == 9 and not r.kept and not r.base_failed
    joined = q.judge_documents(df, with_text=True, broadcast_lines=0).collect()
    assert sorted(map(tuple, joined), key=str) == sorted(map(tuple, got), key=str)
    assert q.judge_documents(df.limit(0)).count() == 0
    assert {r.doc_id for r in q.stage(spark, df, "").collect()} == {r.doc_id for r in got if r.kept}


def test_boilerplate_is_counted_by_documents(spark):
    own = lambda k, n: [f"{k}x{i}\n{k}y{i} and more" for i in range(n)]
    long = [" ".join(f"{k}{j}" for j in range(50)) for k in "pq"]
    texts = {
        "longest": [f"{long[0]}\n{x}" for x in own("a", 30)],  # the shared line is the longest of all that hold it
        "two": [f"{long[0]}\n{x}\n{long[1]}" for x in own("b", 30)],
        "skew": [f"{' '.join(f'{x}{j}' for j in range(60))}\nshared line" for x in [*(f"c{i}_" for i in range(40)), *["d_"] * 45]],
        "copies": [f"{long[0]}\nfixed", f"{long[0]}\nother"] * 60,
        "limit": [f"{long[0]}\n{x}" for x in own("e", 20)],
    }
    rows = [(i, t, s) for s, x in texts.items() for i, t in enumerate(x)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = {(q.line_key(b"longest", long[0].encode()), 30), (q.line_key(b"skew", b"shared line"), 41), *((q.line_key(b"two", x.encode()), 30) for x in long)}
    assert {(r.line, r.documents) for r in q.common_lines(df).collect()} == want
    gone = {s: set() for s in texts}
    for r in q.judge_documents(df.withColumn("lang", df.source), with_text=True).collect():
        gone[r.source].add(r.n_removed_lines)
    assert gone == {"longest": {1}, "two": {2}, "skew": {1}, "copies": {0}, "limit": {0}}


def common_by_counting(rows):
    """(source, normalised line) -> documents of the lines above the limit, counted by sets in plain Python."""
    holders, hosts = {}, {}
    for r in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        lines = frozenset(" ".join(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in low.split("\n")) - {""}
        if lines:
            hosts.setdefault(r.source, set()).add(lines)
        for x in lines:
            holders.setdefault((r.source, x), set()).add(lines)
    return {k: len(v) for k, v in holders.items() if len(v) > max(q.MAX_DOCUMENTS, q.MAX_SHARE * len(hosts[k[0]]))}


def test_common_lines_of_the_tables(spark, sf):
    seen = 0
    for base in (sf.replace("0.001", "0.01"), sf.replace("0.001", "0.1")):
        df = table(spark, base, "documents").unionByName(table(spark, base, "documents").limit(50))
        rows = df.collect()
        want = common_by_counting(rows)
        seen += len(want)
        assert {(r.line, r.documents) for r in q.common_lines(df).collect()} == {(q.line_key(None if s is None else s.encode(), x.encode()), n) for (s, x), n in want.items()}
        gone = {k for k in want}
        judged = {r.doc_id: r for r in q.judge_documents(df).collect()}
        for r in rows:
            lines = [x for x in (r.text or "").split("\n") if x.strip(" \t\n\v\f\r")]
            norm = [" ".join(re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x))) for x in lines]
            cut = [len(n.split(" ")) for n in norm if (r.source, n) in gone]
            n = plain(r.text)[0]
            got = judged[r.doc_id]
            assert (got.n_removed_lines, got.words_left) == (len(cut), n - sum(cut))
            assert got.kept == (not got.base_failed and n - sum(cut) >= q.MIN_LEFT * n)
    assert seen > 0


def test_limit_is_a_share_of_the_host(spark):
    rows = [(i, f"own{i} line\n{'common' if i < 60 else 'other'} {i % 2 if i >= 60 else ''}", "s") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = lambda share: sorted(r.documents for r in q.common_lines(df, 20, share).collect())
    assert found(0.0) == [60, 70, 70] and found(0.32) == [70, 70] and found(0.5) == []
