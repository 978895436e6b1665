import random

import pytest
from tokenizers import Tokenizer

from lodestream.llm import bpe


@pytest.fixture(scope="module")
def both():
    path = bpe.vocabulary_path()
    return bpe.load(path), Tokenizer.from_file(path)


def ids(b):
    return [int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)]


def test_same_as_library(both):
    own, lib = both
    rng = random.Random(1)
    texts = ["", " ", "Hello  world\n\n it's <|endoftext|>x", "a" * 5000, "ééé über 中文字 ​　x\x1c\x85y", "😀😀 don't'll 12345", "\x00\x01"]
    alphabet = "abc eé\n\t ß'12中́ \xa0<|endoftext|>"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for t in texts:
        e = lib.encode(t, add_special_tokens=False).ids
        assert ids(own.encode(t)) == e, t
        assert own.decode(own.encode(t)) == lib.decode(e, skip_special_tokens=False), t


def test_every_code_point_is_cut_alike(both):
    own, lib = both
    for lo in range(0, 0x110000, 0x400):
        t = "".join(f"a{chr(c)} 1{chr(c)}" for c in range(lo, min(lo + 0x400, 0x110000)) if not 0xD800 <= c < 0xE000)
        assert ids(own.encode(t)) == lib.encode(t, add_special_tokens=False).ids, hex(lo)


def test_documents(spark, both):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the whole\ttext", "x"), (3, "the whole\ttext", "x"), (None, "a", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens) for r in bpe.round_trip(df, bpe.vocabulary_path()).collect()}
    assert got == {(1, 0), (2, 0), (3, len(both[1].encode("the whole\ttext").ids)), (None, 1)}
    enc = bpe.encode_documents(df, bpe.vocabulary_path())
    assert sorted(r.text for r in bpe.decode_documents(enc, bpe.vocabulary_path()).collect()) == ["", "", "a", "the whole\ttext", "the whole\ttext"]
    assert bpe.round_trip(df.limit(0), bpe.vocabulary_path()).count() == 0
