import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.llm import jaccard_join as j
from cairnflow.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts, share=80):
    sets, top = {k: shingle_set(t or "") for k, t in texts.items()}, {k: k for k in texts}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    keys = sorted(k for k in sets if sets[k])
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= share * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


def corpus(seed):
    """Near copies of all sizes, chains whose ends don't link, a shared passage, and tiny sets."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    made = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, out = made(60), []
    for n in (1, 3, 5, 6, 9, 10, 12, 30, 62, 64, 70, 101, 103, 160, 300, 900):
        base = made(n)
        out.append(base)
        for _ in range(5):
            now = list(out[-1]) if rng.random() < 0.5 else list(base)
            for _ in range(rng.randrange(1, max(2, n // 25 + 2))):
                now[rng.randrange(len(now))] = rng.choice(vocabulary)
            out.append(now)
        out.append(base[: max(1, n * 8 // 10)])
        out.append(base + made(n // 5))
    for _ in range(30):
        out.append(passage + made(rng.randrange(3, 40)))
    texts = dict(enumerate(" ".join(x) for x in out))
    texts |= {5000: None, 5001: "", 5002: " \t\n", 5003: texts[20], 5004: texts[20].upper(), 5005: "one two"}
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame([(k, t, "n") for k, t in texts.items()], "doc_id long, text string, n string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.classes(df, "doc_id", "text").collect()}
    assert got == brute(texts)


def test_edge_cases(edge, empty, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.classes(edge, "doc_id", "text").collect()}
    assert got == brute(texts)
    assert j.classes(empty, "doc_id", "text").count() == 0


@pytest.mark.parametrize("share", [80, 90])
def test_similar_sets_share_a_signature(share):
    rng = np.random.default_rng(2)
    for k in range(600):
        n = int(rng.integers(1, 80 if k % 2 else 2000))
        a = np.unique(rng.integers(0, 2**63, n, np.uint64) * np.uint64(2))
        if k % 3 == 0:  # subsets
            b = np.sort(a[rng.permutation(n)[: -(-share * n // 100)]])
            assert np.intersect1d(j.signatures(a, share), j.signatures(b, share)).size
            continue
        most = len(a) * (100 - share) // (100 + share)  # changed elements differ on both sides
        b = a.copy()
        at = rng.permutation(len(a))[: int(rng.integers(0, most + 1))]
        b[at] = rng.integers(0, 2**63, len(at), np.uint64) * np.uint64(2) + np.uint64(1)
        b = np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= share * (len(a) + len(b) - both):
            assert np.intersect1d(j.signatures(a, share), j.signatures(b, share)).size


def test_sets_that_no_band_can_cut_are_compared_anyway(spark, monkeypatch):
    plain = j.described
    monkeypatch.setattr(j, "described", lambda *a: plain(*a).where("bucket IS NULL").withColumn("rest", F.col("n") > 5))
    texts = {k: t for k, t in corpus(3).items() if k % 7 < 2}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.classes(df, "doc_id", "text").collect()} == brute(texts)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (95, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("forest", [False, True])
@pytest.mark.parametrize("others", [[2] * 130, [2 + i % 40 for i in range(130)]])
def test_large_sets_are_compared_in_blocks(spark, monkeypatch, forest, others):
    monkeypatch.setattr(j, "BLOCK", 50)
    label = dict(enumerate([1] * 500 + others))
    placed = spark.createDataFrame([(9, k, c) for k, c in label.items()] + [(8, k, 1 + k % 2) for k in range(20)] + [(7, k, 1) for k in range(90)], "set long, node long, class long")
    described_ = spark.createDataFrame([(k, 100, b"") for k in label], "node long, n long, sketch binary")
    work = {}
    for r in j.work_rows(placed, described_, forest).collect():
        work.setdefault((r["set"], r["low"], r["high"]), []).append((r["block"], r["node"]))
    assert {k for k in work if k[0] != 9} == {(8, 0, 0)} and len(work[8, 0, 0]) == 20
    met = []
    for (set_, low, high), m in work.items():
        assert len(m) < 4 * j.BLOCK and {b for b, _ in m} <= {low, high}
        if set_ == 9:
            assert {label[rep] for _, rep in m} != {1}  # the largest class isn't compared with itself
            met += [(min(x, y), max(x, y)) for b, x in m for c, y in m if label[x] != label[y] and (x < y if low == high else b < c)]
    assert len(met) == len(set(met))
    if not forest:
        assert set(met) == {(x, y) for x in label for y in label if x < y and label[x] != label[y]}


def test_small_blocks_give_the_same_classes(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK", 4)
    monkeypatch.setattr(j, "CHUNK", 3)
    texts = corpus(4)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.classes(df, "doc_id", "text").collect()} == brute(texts)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for n, m in ((40, 50), (500, 513), (900, 1100)):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.r_[a[: n - n // 10], rng.integers(0, 2**64, m - n + n // 10, np.uint64)])
        bits = min(j.parities(len(a)), j.parities(len(b)))
        x, y = j.folded([j._sketch(a), j._sketch(b)], bits)
        assert int(j._apart(x, y)) <= len(np.setxor1d(a, b))
        assert int(j._apart(x, y)) >= 0.6 * len(np.setxor1d(a, b))


def test_cuts_of_random_sets_have_enough_full_groups():
    rng = np.random.default_rng(8)
    cut = [j.signatures(np.sort(rng.integers(0, 2**64, n, np.uint64))) is not None for n in [64, 65, 80, 88, 89, 90, 125, 126, 200, 500] * 200]
    assert sum(cut) > len(cut) - 5


def test_a_signature_of_thousands_of_dissimilar_documents(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK", 500)
    rng = random.Random(9)
    made = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = made(40)  # a third of each text, so that signatures of its words only are common
    texts = {k: " ".join(passage + made(80)) for k in range(1500)}
    texts |= {5000 + k: " ".join([*texts[k].split()[:-2], "x", "y"]) for k in range(0, 1500, 100)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in j.classes(rows, "doc_id", "text").collect()}
    assert got == {k: k if k < 5000 else k - 5000 for k in texts}


def test_rows_of_one_id(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, long), (1, None), (1, other), (2, long + " end"), (3, other + " end"), (4, None), (4, long), (4, long)]
    got = sorted(map(tuple, j.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text").drop("mark").collect()))
    assert got == sorted([(1, 56, 1), (1, 0, 1), (1, 56, 1), (2, 57, 1), (3, 57, 1), (4, 0, 4), (4, 56, 1), (4, 56, 1)])


def test_another_similarity(spark):
    texts = {k: t for k, t in corpus(6).items() if k % 2}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.classes(df, "doc_id", "text", share=90).collect()}
    assert got == brute(texts, 90)
