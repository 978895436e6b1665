import random

import pytest
from pyspark.sql import functions as F

from lodestream.llm import url_filter as u
from lodestream.session import table


def plain(url, rules=u.RULES, hosts=u.BLOCKED_HOSTS, listed=()):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.key), len(r.host)), default=None)
    if best:
        return host, path, best.key, best.verdict
    return host, path, None, "block" if host and host + path in listed or any(host == h or host.endswith("." + h) for h in hosts) else "allow"


def test_against_plain(spark):
    urls = [None, "", "nothing", "http://", "http://A.COM", "https://x.com/", "http://example.com/en/", "http://www.Example.com/en/a?b=/fr/", "ftp://a.net/es/1#x",
            "x://net/fr/", "http://.com/", "http://spam-farm.example.org", "http://a.spam-farm.example.org/x", "http://notspam-farm.example.org/", "://com/", "http://a://b.com/en/", "http://ünï.COM/\n?", "http://" + "a." * 3000 + "net/fr/" + "z" * 9000]
    rng = random.Random(2)
    urls += [f"http://{rng.choice(['www.', 'a.b.', ''])}{rng.choice(['example', 'q', 'net'])}.{rng.choice(['com', 'net', 'org'])}{rng.choice(['', '/', '/en', '/en/x', '/es/', '/fr/q?'])}" for _ in range(300)]
    df = spark.createDataFrame([(i // 2, x, "clash") for i, x in enumerate(urls + urls[:5])], "page_id bigint, url string, rule string")
    got = sorted(map(tuple, u.filter_urls(df).collect()), key=str)
    want = sorted([(i // 2, *plain(x)) for i, x in enumerate(urls + urls[:5])], key=str)
    assert got == want
    assert u.filter_urls(df.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = [f"k{i}" for i in range(0, 20000, 37)] + ["absent"]
    c = u.build_cascade(universe, listed)
    assert len(c.levels) > 1
    got = {r.key for r in universe.where(c.contains(F.col("key"))).collect()}
    assert got == set(listed) - {"absent"}
    assert u.build_cascade(universe, []).levels == () and not universe.where(u.Cascade(()).contains(F.col("key"))).count()


@pytest.mark.parametrize("max_bits", [u.MAX_FILTER_BITS, 1500])
def test_listed_table(spark, sf, max_bits):
    pages = table(spark, sf.replace("0.001", "0.1"), "pages")
    odd = spark.createDataFrame([(-1, None, None), (-2, "none", "x"), (-3, "http://q.org/a", None), (-4, "http://Q.org/a?b", "y" * 2000), (-4, "http://Q.org/a?b", "y" * 2000)], "page_id bigint, url string, html string")
    pages = pages.select("page_id", "url", "html").unionByName(odd)
    rows = pages.collect()
    listed = {h + p for h, p, _, _ in (plain(r.url) for r in rows if len(r.html or "") < u.STUB_CHARS)} - {""}
    out = u.filter_urls(pages.drop("html"), listed=u.stub_addresses(pages), max_bits=max_bits)
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(r.page_id, *plain(r.url, listed=listed)) for r in rows], key=str)
    assert sum(v == "block" and r is None for _, _, _, r, v in got) > 50
    assert u.filter_urls(pages.limit(0), listed=u.stub_addresses(pages.limit(0)), max_bits=max_bits).count() == 0
