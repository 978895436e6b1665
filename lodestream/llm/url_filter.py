"""URL filters by a Bloom filter cascade, in SQL expressions only.

A cascade holds a set of listed keys exactly with respect to a universe: level 1 is a Bloom filter of the listed
keys, level 2 of the universe's other keys that pass level 1, level 3 of the listed keys that pass level 2, and so on
until a level lets nothing through that it should not. As the universe is every key that occurs in the corpus, the answer
for a url of the corpus is exact, and no join is needed. Level 1 is sized for a false positive rate of about
listed / universe, so that all levels together take some tens of bits a listed key, however large the corpus.

There are two lists. Rules and hosts are few; their keys are a url's host and parent domains joined with the leading parts
of its path whose lengths occur in the rules. The other list is a table of addresses (host and path), here those of stubs: pages
with less than STUB_CHARS characters of html. A filter goes into the plan as a literal; where a list needs more than
MAX_FILTER_BITS, urls and list are cut into parts by a hash of the address, and each part has a cascade and a job of its own.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and is allowed by
the method; repeated rows each give a row; very long hosts only yield as many parents as the rules' hosts have labels; null html
is a stub.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.session import settle, table, tune

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a filter that go into one plan as a literal.
MAX_FILTER_BITS = 1 << 26
#: Characters of html below which a page is a stub, whose address the method blocks where no rule speaks.
STUB_CHARS = 1000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
#: Hosts that the method blocks where no rule speaks.
BLOCKED_HOSTS = ("spam-farm.example.org",)


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int

    def passes(self, key: Column) -> Column:
        words = F.array(*[F.lit(w) for w in self.words]) if len(self.words) <= 64 else F.from_json(F.lit(str(list(self.words))), "array<bigint>")
        # the words stand in the plan once, not once a hash
        at = F.array(*_positions(key, self.bits, self.hashes, self.seed))
        return F.forall(at, lambda p: F.getbit(F.get(words, (p / 64).cast("int")), (p % 64).cast("int")) == 1)


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), F.lit(i), key), F.lit(bits)) for i in range(hashes)]


def _bits(n: int, rate: float) -> int:
    return max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64) * 64)


def _rate(n_listed: int, n_universe: int) -> float:
    """False positive rate of the first level."""
    return min(0.5, max(1e-9, n_listed / max(1, n_universe)))


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of the column key: its words are or-ed before they are shuffled."""
    bits = _bits(n, rate)
    hashes = max(1, min(16, round(bits / max(1, n) * math.log(2))))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed))).alias("at"))
    rows = at.groupBy((F.col("at") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("v")).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r.w] = r.v
    return Level(tuple(words), bits, hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Whether key is listed; exact for keys of the universe it was built over."""
        inside = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels), 0, -1):
            # failing an odd level means not listed, failing an even level means listed
            inside = F.when(self.levels[depth - 1].passes(key), inside).otherwise(F.lit(depth % 2 == 0))
        return F.coalesce(inside, F.lit(False))


def build_cascade(universe: DataFrame, listed: Iterable[str] | DataFrame, n_universe: int | None = None) -> Cascade:
    """universe: distinct values in the column key. listed: strings, or a frame with the column key."""
    spark = universe.sparkSession
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(x,) for x in sorted(set(listed))], "key string")
    else:
        listed = listed.select("key").where("key is not null").distinct()
    n_listed = listed.count()
    if not n_listed:
        return Cascade(())
    n_universe = universe.count() if n_universe is None else n_universe
    marked = (
        universe.select("key", F.lit(0).alias("on"))
        .unionByName(listed.select("key", F.lit(1).alias("on")))
        .groupBy("key")
        .agg(F.max("on").alias("on"))
    )
    yes, no = marked.where("`on` = 1").select("key"), marked.where("`on` = 0").select("key")
    levels: list[Level] = []
    inside, outside, n = yes, no, n_listed
    while n:
        depth = len(levels) + 1
        rate = _rate(n_listed, n_universe) if depth == 1 else 0.5
        levels.append(_level(inside, n, rate, depth))
        # what the level wrongly lets through is the set that the next level has to hold
        inside, outside = outside.where(levels[-1].passes(F.col("key"))), inside
        if depth == 1:
            inside = settle(inside, "cascade")
        n = inside.count()
    return Cascade(tuple(levels))


def parse(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """All keys under which a rule could stand: parents of the host, each with the path parts of the rules' lengths."""
    depths = sorted({r.host.count(".") + 1 for r in rules})
    lengths = sorted({len(r.path) for r in rules})
    labels = F.split(host, r"\.")
    keys = []
    for d in depths:
        parent = F.array_join(F.slice(labels, F.greatest(F.size(labels) - d + 1, F.lit(1)), F.lit(d)), ".")
        for n in lengths:
            keys.append(F.when((F.size(labels) >= d) & (F.length(path) >= n), F.concat(parent, F.substring(path, 1, n))))
    return F.array_compact(F.array(*keys))


def parents(host: Column, hosts: Sequence[str]) -> Column:
    """The host's parents with as many labels as some listed host has."""
    labels = F.split(host, r"\.")
    return F.array_compact(
        F.array(*[F.when(F.size(labels) >= d, F.array_join(F.slice(labels, F.greatest(F.size(labels) - d + 1, F.lit(1)), F.lit(d)), ".")) for d in sorted({h.count(".") + 1 for h in hosts})])
    )


def stub_addresses(pages: DataFrame, url_col: str = "url", html_col: str = "html", least: int = STUB_CHARS) -> DataFrame:
    """key: host and path of every page whose html has less than `least` characters."""
    host, path = parse(F.col(url_col).cast("string"))
    short = F.coalesce(F.length(F.col(html_col).cast("string")), F.lit(0)) < least
    return pages.where(short).select(host.alias("host"), path.alias("path")).where("host <> ''").select(F.concat("host", "path").alias("key")).distinct()


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, blocked_hosts: Sequence[str] = BLOCKED_HOSTS, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", max_bits: int = MAX_FILTER_BITS
) -> DataFrame:
    """id, host, path, rule, verdict of every url.

    The longest rule that fits decides (of equal lengths, the one with the longer host); else a url is blocked if
    its host or a parent is in blocked_hosts, or its address in listed (column key). Rules may share a key only with the same
    verdict. All answers come from cascades; no url meets a list in a join.
    """
    if len({r.key for r in rules}) != len({(r.key, r.verdict) for r in rules}):
        raise ValueError("two rules with the same key and different verdicts")
    host, path = parse(F.col(url_col).cast("string"))
    base = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    base = base.withColumn("keys", candidates(F.col("host"), F.col("path"), rules) if rules else F.array().cast("array<string>"))
    base = base.withColumn("names", parents(F.col("host"), blocked_hosts) if blocked_hosts else F.array().cast("array<string>"))
    keys = base.select(F.explode(F.concat("keys", F.transform("names", lambda h: F.concat(F.lit("//"), h)))).alias("key")).distinct()
    universe = settle(keys, "keys")
    n = universe.count()
    known = build_cascade(universe, [r.key for r in rules], n)
    blocked = build_cascade(universe, [r.key for r in rules if r.verdict == "block"] + ["//" + h for h in blocked_hosts], n)
    fits = F.filter("keys", known.contains)
    best = F.aggregate(fits, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (F.length(x) > F.length(a)) | ((F.length(x) == F.length(a)) & (F.instr(x, "/") > F.instr(a, "/"))), x).otherwise(a))
    by_host = F.exists("names", lambda h: blocked.contains(F.concat(F.lit("//"), h)))

    def judged(rows: DataFrame, by_list: Column) -> DataFrame:
        is_blocked = F.when(F.col("rule").isNotNull(), blocked.contains(F.col("rule"))).otherwise(by_host | by_list)
        return rows.withColumn("rule", best).select(id_col, "host", "path", "rule", F.when(is_blocked, "block").otherwise("allow").alias("verdict"))

    if listed is None:
        return judged(base, F.lit(False))
    address = F.when(F.col("host") != "", F.concat("host", "path"))
    addresses = settle(base.select(address.alias("key")).where("key is not null").distinct(), "addresses")
    listed = settle(listed.select("key").where("key is not null").distinct(), "listed")
    n, n_listed = addresses.count(), listed.count()
    parts = max(1, -(-_bits(n_listed, _rate(n_listed, n)) // max_bits))
    if parts == 1:
        return judged(base, build_cascade(addresses, listed, n).contains(address))
    part = lambda key: F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts))
    dealt = settle(base.withColumn("part", F.coalesce(part(address), F.lit(0))), "urls", "part")
    split = [settle(df.withColumn("part", part(F.col("key"))), "part", "part") for df in (addresses, listed)]
    done = []
    for k in range(parts):  # a job a part: the driver holds one part's filters at a time
        cascade = build_cascade(*[df.where(F.col("part") == k).select("key") for df in split])
        done.append(settle(judged(dealt.where(F.col("part") == k), cascade.contains(address)), "judged"))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every url of pages; stubs are the listed addresses."""
    pages = table(tune(spark), sf_dir, "pages")
    return filter_urls(pages.select("page_id", "url"), listed=stub_addresses(pages))


OP4_SQL = """
WITH r(host, path, rule, verdict) AS (VALUES
    ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'),
    ('www.example.com', '/en/', 'www.example.com/en/', 'allow'), ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS k, coalesce(length(html), 0) < 1000 AS stub FROM pages),
p AS (SELECT k, page_id, stub, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT p.k, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
    FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.k),
l AS (SELECT DISTINCT host || path AS address FROM p WHERE stub AND host <> '')
SELECT p.page_id, p.host, p.path, b.rule,
    coalesce(b.verdict, CASE WHEN p.host = 'spam-farm.example.org' OR ends_with(p.host, '.spam-farm.example.org') OR l.address IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN b USING (k) LEFT JOIN l ON l.address = p.host || p.path
"""
