import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cairnflow.llm import bpe, packing

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "abcdefghijklmnopqrstuvwxyzABC'’  \n\t.,!?0123456789éÉßñΣσς中文ЖдİıﬁÅ  　\u0085\x1c½²Ⅷ😀👍🏽<|>/w\x00"


def cases():
    rng = random.Random(5)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(1500)]
    return [*made, "", " ", "   ", "a  b", "a \n b", "\n a", " \x1c a", "we'll they're 'S", "</w></w>", "<|endoftext|>a<|startoftext|> b", "a" * 37, "thingingtionthere" * 50, "x" * 3000]


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_equals_the_library(kind):
    path, codec = (WORD, bpe.WordCodec(WORD)) if kind == "word" else (BYTE, packing.ByteCodec(BYTE))
    t = Tokenizer.from_file(path)
    for x in cases():
        want = t.encode(x, add_special_tokens=False).ids
        ids = codec.encode(x)
        assert memoryview(ids).cast("I").tolist() == want, x
        if kind == "word":
            assert b"".join(codec.decode(ids)).decode() == t.decode(want, skip_special_tokens=False)


def test_long_texts_are_cut_without_effect(monkeypatch):
    monkeypatch.setattr(bpe, "TEXT_STEP", 50)
    monkeypatch.setattr(bpe, "DECODE_STEP", 7)
    monkeypatch.setattr(bpe.pieces, "__defaults__", (50,))
    t, c = Tokenizer.from_file(WORD), bpe.WordCodec(WORD)
    x = "Some words, and MORE of them! " * 40
    want = t.encode(x, add_special_tokens=False).ids
    assert memoryview(c.encode(x)).cast("I").tolist() == want
    assert b"".join(c.decode(c.encode(x))).decode() == t.decode(want, skip_special_tokens=False)
    monkeypatch.setattr(packing, "_STEP", 40)
    b, c = Tokenizer.from_file(BYTE), packing.ByteCodec(BYTE)
    assert memoryview(c.encode(x)).cast("I").tolist() == b.encode(x, add_special_tokens=False).ids


def test_edge_cases(edge, empty, texts):
    t = Tokenizer.from_file(WORD)
    got = {r["doc_id"]: r for r in bpe.digests(edge, "doc_id", "text", WORD).collect()}
    for k, x in texts.items():
        want = t.encode(x, add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(want)
        assert got[k]["decoded_sha256"] == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(empty, "doc_id", "text", WORD).count() == 0


def test_round_trip_through_frames(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None)], "k long, t string")
    back = bpe.decode(bpe.encode(df, "k", "t", WORD), "k", "ids", WORD)
    assert {r["k"]: r["text"] for r in back.collect()} == {1: "hello</w> world</w>", 2: ""}
