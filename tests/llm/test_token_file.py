import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestream.llm import token_file as t
from lodestream.session import table

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_as_library(library):
    own = t.encoder(PATH)
    rng = random.Random(3)
    alphabet = "ab cdeéÉßÆ×÷ÿ\n\t\r\x0b'smtrevl12 !?<|>İΣς́ \x1c中"
    texts = ["", " ", "<|endoftext|>", "a<|startoftext|>b", "DON'T'S'LL", "!'s", "x" * 3000] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(800)]
    texts += ["".join(rng.choice("abE'stÉ é1!\n,") for _ in range(rng.randint(0, 50))) for _ in range(800)]
    for x, got in zip(texts, own.encode_batch(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(x, add_special_tokens=False).ids, repr(x)


def test_planes():
    rng = np.random.default_rng(0)
    for mode in ("byte", "bit"):
        for ids in (rng.integers(0, 1 << 32, 1000), rng.integers(0, 50000, 777), np.zeros(5)):
            ids = ids.astype("<u4")
            numbers, planes = t.to_planes(ids, mode, zstandard.ZstdCompressor())
            assert (t.from_planes(len(ids), mode, numbers, planes) == ids).all()


def want(rows, library):
    out, start = [], 0
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h is not None, r.h or 0)):
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_round_trip(spark, sf, tmp_path, library, mode):
    docs = table(spark, sf, "documents")
    extra = spark.createDataFrame([(None, "null id", 1), (7, None, 2), (7, "again", 3), (9, "", 4)], "doc_id bigint, text string, start bigint")
    df = docs.select("doc_id", "text").unionByName(extra, allowMissingColumns=True)
    t.write_documents(df, str(tmp_path / "x"), PATH, mode=mode, block_ids=1000, shards=3)
    got = sorted(map(tuple, t.read_documents(spark, str(tmp_path / "x")).collect()), key=str)
    assert got == want(df.withColumn("h", F.expr("CASE WHEN text IS NOT NULL THEN xxhash64(text) END")).collect(), library)
    for r in t.read_documents(spark, str(tmp_path / "x"), with_ids=True).limit(50).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens
    index = t.read_index(spark, str(tmp_path / "x")).orderBy("start").collect()
    assert all(a.start + a.n_ids == b.start for a, b in zip(index, index[1:], strict=False))


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    t.write_documents(df, str(tmp_path / "e"), PATH)
    assert t.read_documents(spark, str(tmp_path / "e")).count() == 0


def test_hot_ids_are_dealt_over_shards(spark, tmp_path, library):
    rows = [(None, f"text {k % 700}") for k in range(2400)] + [(k, "one") for k in range(300)] + [(7, "the same row")] * 300
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    t.write_documents(df, str(tmp_path / "h"), PATH, shards=8)
    got = t.read_documents(spark, str(tmp_path / "h"))
    assert sorted(map(tuple, got.collect()), key=str) == want(df.withColumn("h", F.xxhash64("text")).collect(), library)
    held = [r.n for r in spark.read.parquet(str(tmp_path / "h")).selectExpr("shard", "size(parts) AS n").groupBy("shard").sum("n").withColumnRenamed("sum(n)", "n").collect()]
    assert len(held) == 8 and max(held) < 2 * sum(held) / 8


def test_other_vocabularies_get_whole_texts(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    file["normalizer"] = {"type": "NFC"}  # keeps capitals
    (tmp_path / "v.json").write_text(json.dumps(file), encoding="utf-8")
    own, other = t.WordEncoder(str(tmp_path / "v.json")), Tokenizer.from_file(str(tmp_path / "v.json"))
    for x in ("Some Capitals HERE", "", "a'S"):
        assert np.frombuffer(own.encode_batch([x])[0], "<u4").tolist() == other.encode(x, add_special_tokens=False).ids
