import math
import random

import pytest

from lodestream.llm import top_k as tk
from lodestream.session import table


def plain(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            clip = lambda s: min(tk.MOST, max(tk.LEAST, s))
            best = sorted((-clip(sum(a * b for a, b in zip(q, v, strict=True))), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard_rows", "query_chunk"), [(200, 7), (10_000, 256)])
def test_table(spark, sf, shard_rows, query_chunk):
    df = table(spark, sf, "embeddings").selectExpr("*", "1 AS score")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(map(tuple, tk.top_k(df, shard_rows=shard_rows, query_chunk=query_chunk).collect()))
    assert got == plain(rows, 5, 50)


def test_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]) for i in range(300)]  # many ties
    rows += [(i, [1.0, 1.0, 1.0]) for i in range(300, 420)] + [(500, None), (501, []), (550, [1.0, None, 2.0]), (551, [float("nan"), 1.0, 1.0]), (552, [float("inf"), 1.0, 1.0])]
    rows += [(600, [1.0, 2.0]), (601, [0.5, 0.5]), (650, [3e8, -3e8, 1e8]), (651, [3e8, 3e8, 1e8]), (None, [1.0, 1.0, 1.0]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, tk.top_k(df, shard_rows=100, query_chunk=3).collect())) == plain(rows, 5, 50)
    assert tk.top_k(df.limit(0)).count() == 0
    assert sorted(map(tuple, tk.top_k(df.where("vec_id in (50, 51)")).collect())) == plain([r for r in rows if r[0] in (50, 51)], 5, 50)


def test_large_components_through_the_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-3, 38) for _ in range(6)]) for i in range(260)]
    rows += [(300 + i, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(5, 10) for _ in range(6)]) for i in range(260)]
    rows += [(50 * i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(20, 24)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]  # as floats hold them
    assert sorted(map(tuple, tk.op2_top_k(spark, str(tmp_path)).collect())) == plain(rows, 5, 50)


def test_one_hot_id(spark):
    rows = [(50, [1.0, float(i % 7)]) for i in range(400)] + [(i, [float(i), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = sorted(map(tuple, tk.top_k(df, shard_rows=50, query_chunk=2).collect()))
    assert [r for r in got if r[0] == 0] == [(0, k, 50, 256 * 256 * 6) for k in range(1, 6)]
    assert len([r for r in got if r[0] == 50]) == 5
