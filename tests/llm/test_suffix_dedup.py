import random

import pytest

from cairnflow.llm import suffix_dedup as s


def brute(docs, length=100):
    seen, out = set(), {}
    for k, b in docs:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                mask[i : i + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))
        out[k] = len(b), sum(mask), spans, bytes(x for x, m in zip(b, mask, strict=True) if not m)
    return out


def corpus(seed):
    rng = random.Random(seed)
    made = lambda n: "".join(rng.choice("abcde é") for _ in range(n))
    passages = [made(n) for n in (90, 99, 100, 101, 130, 400)]
    docs = []
    for k in range(60):
        parts = [made(rng.randrange(200)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(6)]
        docs.append((k, "".join(parts)))
    docs += [(100, "z" * 450), (101, "z" * 120), (102, "ab" * 200), (103, None), (104, ""), (105, docs[3][1]), (106, docs[3][1]), (107, passages[5][:100]), (108, passages[5][:99])]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, shard string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in s.removed(df, "doc_id", "text").collect()}
    assert got == brute([(k, (t or "").encode()) for k, t in docs])


def test_small_steps_give_the_same(monkeypatch):
    import numpy as np
    import zstandard

    body = "".join(t or "" for _, t in corpus(3)).encode()
    packed = zstandard.ZstdCompressor().compress(body)
    ids, sizes = np.array([1], np.int64).tobytes(), np.array([len(body)], np.int64).tobytes()
    none = np.zeros(0, np.int64)
    whole = s.Shard(ids, sizes, packed, 100, 32)
    all_open = np.arange(len(whole.first))
    want = s.covered(whole, none, all_open, none)
    monkeypatch.setattr(s, "STEP", 777)
    small = s.Shard(ids, sizes, packed, 100, 32)
    assert (s.covered(small, none, np.arange(len(small.first)), none) == want).all()
    assert want.sum() == brute([(1, body)])[1][1]


def test_edge_cases(edge, empty, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in s.removed(edge, "doc_id", "text").collect()}
    assert got == brute(sorted((k, t.encode()) for k, t in texts.items()))
    assert s.removed(empty, "doc_id", "text").count() == 0


def test_text_form_drops_broken_characters(spark):
    base = "é" * 60
    df = spark.createDataFrame([(1, base + "x" * 200), (2, "è" + base[:55] + "q")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in s.removed(df, "doc_id", "text", kept="text").collect()}
    assert rows[2]["kept"] in ("è" + "q", "q", "èq")
